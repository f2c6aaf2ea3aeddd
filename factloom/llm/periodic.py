"""Periodic run detection by heavy/light lag counting.

A run is a stretch of consecutive words with a smallest period q, at least `shortest` words and `times` periods long, that no neighbouring word extends keeping the period.

Lag counting: how many words equal the word q places on, for every lag q up to a third of the text, exactly. Frequent words add theirs by FFT autocorrelation of where they stand (whole numbers, so rounding makes it exact), rare ones
by the differences of the places of each pair. A run of period q makes max(shortest - q, (times - 1) * q) matches in a row at its lag, so other lags need no look.

Island scans: at a lag with enough matches, words are probed at an eighth of that length; only where eight probes in a row match are all words compared, and the islands of matches of that length are the runs.
A run of period q has matches at the multiples of q too: its islands there are known, so they are taken from those lags' counts, and a text that only repeats itself is scanned at its own period alone.
Lags go upward, so a stretch is found at its smallest period first.

Defined cases: a null or empty text, or one of fewer than `shortest` words, has no runs; repeated rows and equal ids are separate documents; a null id is returned as it is; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import short

RUN = "struct<start: long, length: long, period: long>"


def lag_counts(ids: np.ndarray, most: int, frequent: int | None = None, cells: int = 1 << 21) -> np.ndarray:
    """At [q], for q up to `most`: how many i have ids[i] == ids[i + q]. ids: 0.. without gaps. frequent: words seen oftener than this are counted by FFT; cells: how many numbers a block of transforms holds."""
    n = len(ids)
    times = np.bincount(ids)
    if frequent is None:
        frequent = max(8, int(np.sqrt(n * np.log2(n + 2)) / 4))
    heavy = np.flatnonzero(times > frequent)
    out = np.zeros(most + 1, np.int64)
    if len(heavy):
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        column = np.full(len(times), -1)
        step = max(1, cells // size)
        for at in range(0, len(heavy), step):
            block = heavy[at : at + step]
            column[:] = -1
            column[block] = np.arange(len(block))
            there = np.flatnonzero(column[ids] >= 0)
            marks = np.zeros((len(block), size))
            marks[column[ids[there]], there] = 1
            spectrum = np.fft.rfft(marks)
            power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    place = np.flatnonzero(times[ids] <= frequent)
    place = place[np.argsort(ids[place], kind="stable")]
    word = ids[place]
    # first: positions whose next occurrence, k places on in the list, is still to be looked at.
    first = np.arange(len(place))
    k = 1
    while len(first):
        first = first[first + k < len(place)]
        lag = place[first + k] - place[first]
        ok = (word[first + k] == word[first]) & (lag <= most)
        first = first[ok]
        if len(first):
            out += np.bincount(lag[ok], minlength=most + 1)
        k += 1
    out[0] = n
    return out


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of places i with ids[i] == ids[i + lag], at least `least` (16 or more) long."""
    n = len(ids) - lag
    step = least // 8
    probe = np.arange(0, n, step)
    hit = np.flatnonzero(ids[probe] == ids[probe + lag])
    if len(hit) < 8:
        return []
    cut = np.flatnonzero(np.diff(hit) != 1)
    begins, ends = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(hit) - 1]])
    out = []
    for g in np.flatnonzero(ends - begins >= 7).tolist():
        low, high = max(0, (int(hit[begins[g]]) - 1) * step + 1), min(n, (int(hit[ends[g]]) + 1) * step)
        same = np.zeros(high - low + 2, np.int8)
        same[1:-1] = ids[low:high] == ids[low + lag : high + lag]
        turn = np.diff(same)
        starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = stops - starts >= least
        out += zip((starts[long] + low).tolist(), (stops - starts)[long].tolist())
    return out


def runs(ids: np.ndarray, shortest: int = 24, times: int = 3, **how) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start, then period."""
    n = len(ids)
    if n < shortest:
        return []
    most = n // times
    counts = lag_counts(ids, most, **how)
    lags = np.arange(most + 1)
    least = np.maximum(np.maximum(shortest - lags, (times - 1) * lags), 16)
    found: dict[tuple[int, int], int] = {}
    open_ = counts >= least
    open_[0] = False
    for q in np.flatnonzero(open_).tolist():
        if counts[q] < least[q]:
            continue
        for start, matches in islands(ids, q, max(shortest - q, (times - 1) * q)):
            length = matches + q
            if (start, length) not in found:  # else it has a smaller period
                found[start, length] = q
                # At a multiple m of q the island of this run is all of it, if it is at least m + q long.
                multiples = np.arange(2 * q, min(length - q, most) + 1, q)
                counts[multiples] -= length - multiples
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def dropped_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers, from 0 without gaps."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, times: int = 3) -> DataFrame:
    """(id, n_words, runs: their start (word number), length and period, by start, then period; collapsed: the words that no run repeats, joined by one space) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in short(batches):
            n_words, every, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                found = runs(numbered(words), shortest, times) if len(words) >= shortest else []
                n_words.append(len(words))
                every.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                if found:
                    gone = dropped_words(len(words), found).tolist()
                    words = [w for w, x in zip(words, gone, strict=True) if not x]
                texts.append(b" ".join(words))
            kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(every, pa.list_(kinds)), pa.array(texts, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<{RUN}>, collapsed string")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): of every text whose id's CRC-32 ends with the digit 0, words from a place on repeat with a period, both given by that number (the rows that op11 works on)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in short(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for k, h in enumerate(batch.column(2).to_pylist()):
                if h is None or h % 10 or not (words := (texts[k] or b"").split()):
                    continue
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                whole, rest = divmod(n - a, p)
                texts[k] = b" ".join(words[:a] + words[a : a + p] * whole + words[a : a + rest])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=[id_col, text_col])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}`", f"crc32(cast(cast(`{id_col}` as string) as binary)) as h").mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """detect()'s rows as (id, n_runs; start, length, period, exponent_milli of the run of greatest length over period, ties by start, then period; runs_sha256, collapsed_sha256)."""
    best = f"aggregate(runs, cast(null as {RUN}), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    one = found.selectExpr(f"`{id_col}`", "n_words", "cast(size(runs) as long) as n_runs", f"{best} as best", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256")
    return one.selectExpr(f"`{id_col}`", "n_words", "n_runs", "best.start", "best.length", "best.period", "1000 * best.length div best.period as exponent_milli", "runs_sha256", "collapsed_sha256")
