"""Words of many texts at once, as NumPy arrays over one buffer of UTF-8 bytes, and XXH64 of stretches of that buffer."""

from __future__ import annotations

import numpy as np
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


class Words:
    """The words of a list of texts (None: no words).

    data: all words, each followed by one space, then 8 bytes 0; starts, ends: of each word in data; counts: words of each
    text; first: number of each text's first word. lower: A-Z become a-z.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        raw = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        text_ends = np.cumsum(lengths + 1)  # behind each text's closing space
        space = SPACE[raw]
        keep = ~space
        keep[1:] |= ~space[:-1]
        closes = space & keep
        data = (LOWER[raw] if lower else raw)[keep]
        ends = np.flatnonzero(closes[keep])
        data[ends] = 32
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.ends = ends
        self.starts = np.empty_like(ends)
        self.starts[:1] = 0
        self.starts[1:] = ends[:-1] + 1
        self.first = np.zeros(len(texts), np.int64)
        upto = np.searchsorted(np.flatnonzero(closes), text_ends)
        self.first[1:] = upto[:-1]
        self.counts = upto - self.first

    def text_of(self) -> np.ndarray:
        """Number of the text that each word is from."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def groups(texts: list[bytes | None], most: int = 1 << 20):
    """Ranges of texts of up to `most` bytes in all, more only for a single longer text."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        if b > a and held + len(t or b"") > most:
            yield a, b
            a, held = b, 0
        held += len(t or b"")
    if a < len(texts):
        yield a, len(texts)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of data[start:end] for each pair; data ends with 8 bytes that belong to none."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    fours = np.ndarray(len(data) - 7, "<u4", data, strides=(1,))
    n = ends - starts
    at = starts.copy()
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        acc = np.full(len(n), seed + P5, np.uint64) + n.astype(np.uint64)
        for k in np.flatnonzero(n >= 32).tolist():  # few: by the library
            acc[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), int(seed))
        short = n < 32
        for turn in range(3):
            s = np.flatnonzero(short & (n >= 8 * turn + 8))
            if not len(s):
                break
            acc[s] = _rotate(acc[s] ^ (_rotate(eights[at[s]] * P2, 31) * P1), 27) * P1 + P4
            at[s] += 8
        s = np.flatnonzero(short & (n & 4 > 0))
        acc[s] = _rotate(acc[s] ^ (fours[at[s]].astype(np.uint64) * P1), 23) * P2 + P3
        at[s] += 4
        for turn in range(3):
            s = np.flatnonzero(short & (n & 3 > turn))
            acc[s] = _rotate(acc[s] ^ (data[at[s]].astype(np.uint64) * P5), 11) * P1
            at[s] += 1
        s = np.flatnonzero(short)
        x = acc[s]
        x = (x ^ x >> np.uint64(33)) * P2
        x = (x ^ x >> np.uint64(29)) * P3
        acc[s] = x ^ x >> np.uint64(32)
    return acc
