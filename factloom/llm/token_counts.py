"""Token counts: a linear longest-match automaton.

A trie of the vocabulary is given failure links and, for each link, the number of pieces it pops, so one pass over a
word's bytes gives the number of pieces that greedy longest-match cutting would make, without building a piece.
At a node that has no edge for the next symbol, the longest piece at the node's front is popped and the rest of the
node's string is matched anew: pops(v) and fail(v), found once, in order of depth.

A word is a run of anything but ASCII white space; A-Z count as a-z; a word's last symbol is followed by the
end-of-word mark. Vocabularies map bytes to letters as byte-level BPE files do.

Defined cases: null or empty text counts 0 words and 0 tokens; a symbol that is in no piece counts as one token of its
own; repeated rows are counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, short

END = 256  # the end-of-word symbol, beside the bytes 0-255


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level BPE files: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def vocabulary(tokenizer_path: str, mark: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level BPE file with end-of-word marks, as symbols."""
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    out = []
    for piece in pieces:
        body = piece.removesuffix(mark)
        out.append((*(letters[c] for c in body), *([END] if piece.endswith(mark) and piece != body else [])))
    return [p for p in out if p]


class Automaton:
    """count(word): pieces of greedy longest match, in time linear in the word."""

    def __init__(self, pieces):
        self.edges: list[dict[int, int]] = [{}]
        parent, symbol, whole, depth = [0], [0], [False], [0]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    parent.append(at)
                    symbol.append(c)
                    whole.append(False)
                    depth.append(depth[at] + 1)
                at = nxt
            whole[at] = True
        n = len(self.edges)
        self.fail, self.pops = [0] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if whole[v]:
                self.fail[v], self.pops[v] = 0, 1  # the whole string is a piece, and the root is what's left
            elif parent[v] == 0:
                self.fail[v], self.pops[v] = 0, 1  # in no piece alone: a token of its own
            else:
                at, k, c = self.fail[parent[v]], self.pops[parent[v]], symbol[v]
                while c not in self.edges[at] and at:
                    at, k = self.fail[at], k + self.pops[at]
                nxt = self.edges[at].get(c)
                self.fail[v], self.pops[v] = (nxt, k) if nxt is not None else (0, k + 1)

    def count(self, word) -> int:
        edges, fail, pops, at, n = self.edges, self.fail, self.pops, 0, 0
        for c in word:
            nxt = edges[at].get(c)
            while nxt is None and at:
                n += pops[at]
                at = fail[at]
                nxt = edges[at].get(c)
            if nxt is None:
                n += 1
            else:
                at = nxt
        while at:
            n += pops[at]
            at = fail[at]
        return n


def greedy(pieces: set, word) -> int:
    """The same count by cutting pieces: what the automaton must equal. (Slow; for tests.)"""
    longest, n, at = max(map(len, pieces), default=1), 0, 0
    word = tuple(word)
    while at < len(word):
        for m in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + m] in pieces or m == 1:
                at += m
                break
        n += 1
    return n


@lru_cache(maxsize=2)
def word_counts(tokenizer_path: str) -> Memo:
    """word -> its number of pieces, remembered in each Python worker."""
    count = Automaton(vocabulary(tokenizer_path)).count
    return Memo(lambda word: count((*word, END)), 350_000)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of each document. The automaton is built once in each Python worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo = word_counts(tokenizer_path)
        for batch in short(batches):
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode().lower().split()
                words.append(len(found))
                tokens.append(sum(map(memo.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")
