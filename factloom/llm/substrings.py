"""Substring dedup: prefix-partitioned suffix trees.

A window is `window` consecutive words of a document. A window is repeated if its words also start in a document with a
smaller id; words that repeated windows cover are removed.

Suffixes: of each window, one suffix is kept for the tree: that which starts at the window's anchor, the place of the
least hash among the window's starts of a prefix's words. Equal windows have equal anchors, so equal windows meet in one group,
and neighbouring windows mostly share an anchor, so a group's suffix comes with the few words around it instead of with a copy for each window.

Partition, by prefixes of variable length: suffixes are grouped by their first `prefixes[0]` words. A prefix that only one document has starts no repeat and goes no
further. One whose suffixes fit `limit` bytes, with all the words around them, is one subtree. The windows of a more crowded one are anchored anew by the next longer prefix, and so
parted by more words. A group that is still over the limit at the longest prefix is dealt, suffix by suffix, to as many subtrees as keep to it.
What is first in its own subtree, and only that, is then grouped by the longest prefix there is, the whole window. So no task holds all the suffixes of a common passage, and a passage
gives few rows a subtree, however often it occurs, even if one document repeats it in ever other words.

Copies: a text that a smaller id has too is repeated whole, and only the first of equal texts (by two 64-bit hashes of it) gives suffixes.

Subtrees: a task sorts its groups' suffixes and takes the common lengths of neighbours, which give the nodes of the subtree
at any depth, and likewise of the words before the anchors, read backwards. A window that starts j words before its anchor is
repeated where its node at depth window - j of the one and at depth j of the other hold a smaller id together:
the deep nodes, from which maximal repeats are the unions of neighbouring windows (`maximal_repeats` lists them).

Words are compared by 64-bit hashes. Within a subtree two windows are equal if all their hashes are; between the subtrees of one group if the 128-bit digests of their hashes are.

Defined cases: doc_id must be a whole number; null text has no words; a document with fewer words than a window keeps all; repeats within a document, or
between rows of equal id, are kept; a null id counts as larger than any other, and null ids as equal; equal rows have
equal results; an empty table gives no rows; further columns are passed through, but for names that the result itself uses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, counted_join, dropped, short, written
from .words import Words, groups, xxh64

WINDOW, PREFIXES, LIMIT = 50, (16, 32), 48 << 10
BASE = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1


def rolled(hashes: np.ndarray, n: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each n consecutive values: of spans of 1, 2, 4, ..., joined as n is written in binary."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out, at, span, width, power = np.zeros(count, np.uint64), 0, hashes, 1, base
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                out = out * power + span[at : at + count]
                at += width
            if 2 * width > n:
                return out
            span = span[:-width] * power + span[width:]
            power, width = power * power, 2 * width


def least_at(values: np.ndarray, span: int) -> np.ndarray:
    """Where the (first) least of each `span` consecutive values is."""
    at, width = np.arange(len(values)), 1
    while width < span and len(at):
        step = min(width, span - width)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        width += step
    return at


class Segments:
    """The anchors of some texts: for each run of windows with one anchor, the text, the anchor's word, the run's first and last window, and the hash of the prefix there.

    A text's windows that start at words in `only` (all, if None) count.
    """

    def __init__(self, words: Words, hashes: np.ndarray, window: int, prefix: int, only: np.ndarray | None = None):
        text = words.text_of()
        if len(text) < window:
            self.text = self.anchor = self.low = self.high = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            keys = rolled(hashes, prefix)
            keys = (keys ^ keys >> np.uint64(32)) * BASE
            keys ^= keys >> np.uint64(29)
        starts = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :]) if only is None else only
        anchors = least_at(keys, window - prefix + 1)[starts]
        # A run ends where the anchor changes, and where windows that do not count lie between.
        change = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        self.anchor = anchors[change]
        self.low = starts[change]
        self.high = starts[np.append(change[1:], len(starts))[: len(change)] - 1]
        self.text = text[self.anchor]
        self.key = keys[self.anchor]


def word_hashes(words: Words) -> np.ndarray:
    return xxh64(words.data, words.starts, words.ends)


def id_order(doc_id: Column) -> Column:
    """Ids to compare, null last."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def keyed(docs: DataFrame) -> DataFrame:
    """(ord, digest, text): a row's id to compare and a digest of its text; rows equal in both have equal results."""
    return docs.select(id_order(F.col("doc_id")).alias("ord"), F.xxhash64("text").alias("digest"), "text")


def prefixes_of(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """(key, ord, digest, times): the prefix of each suffix that is kept, once a document, and how many of its suffixes begin so."""

    def run(batches):
        for batch in short(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in groups(texts):
                words = Words(texts[a:b])
                found = Segments(words, word_hashes(words), window, prefix)
                order = np.lexsort((found.key, found.text))
                key, text = found.key[order], found.text[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(key))).astype(np.int32)
                take = pa.array(text[new] + a)
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(times)], names=["key", "ord", "digest", "times"])

    return rows.mapInArrow(run, "key long, ord long, digest long, times int")


SUFFIX = "key long, ord long, digest long, anchors array<int>, first int, last int, words binary"
SUFFIX_NAMES = [x.split()[0] for x in SUFFIX.split(", ")]
SUFFIX_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]


def suffixes(rows: DataFrame, window: int, prefix: int, longer: int) -> DataFrame:
    """rows: ord, digest, text, keys: array<struct<key, crowded>> -> the suffixes at those prefixes; of crowded ones, the suffixes of their windows at the longer prefix.

    anchors: the words where the suffix stands, more than
    one if the document repeats it with all the words around it; first, last: how far before an anchor the nearest and farthest window start;
    words: the hashes from the farthest window's start to the nearest one's end.
    """

    def run(batches):
        for batch in short(batches):
            ids, digests_, texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)
            for a, b in groups(texts):
                words = Words(texts[a:b])
                hashes = word_hashes(words)
                found = Segments(words, hashes, window, prefix)
                # Which segments have a wanted key of their text, and which of these a crowded one.
                hit, crowded = np.zeros(len(found.key), bool), np.zeros(len(found.key), bool)
                at = np.searchsorted(found.text, np.arange(b - a + 1))
                for t in range(a, b):
                    low, high = int(at[t - a]), int(at[t - a + 1])
                    if low == high:
                        continue
                    flat = wanted[t].values
                    keys, full = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
                    order = np.argsort(keys)
                    k = order[np.minimum(np.searchsorted(keys, found.key[low:high], sorter=order), len(keys) - 1)]
                    hit[low:high] = keys[k] == found.key[low:high]
                    crowded[low:high] = hit[low:high] & full[k]
                parts = [(found, np.flatnonzero(hit & ~crowded))]
                if crowded.any():
                    deeper = Segments(words, hashes, window, longer, spans(found.low[crowded], found.high[crowded] + 1))
                    parts.append((deeper, np.arange(len(deeper.key))))
                mine: dict[tuple, list[int]] = {}
                for some, which in parts:
                    for key, t, p, q, anchor in zip(some.key[which].view(np.int64).tolist(), some.text[which].tolist(), some.low[which].tolist(), some.high[which].tolist(), some.anchor[which].tolist(), strict=True):
                        mine.setdefault((key, t, anchor - q, anchor - p, hashes[p : q + window].tobytes()), []).append(anchor - int(words.first[t]))
                if mine:
                    out = [(key, ids[t + a], digests_[t + a], anchors, first, last, held) for (key, t, first, last, held), anchors in mine.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), SUFFIX_TYPES, strict=True)], names=SUFFIX_NAMES)

    return rows.mapInArrow(run, SUFFIX)


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges low..high-1, one range after the other."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def sorted_nodes(key: np.ndarray, sequences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the rows by key and sequence. Order, and the number of leading values that each row has in common with the one before it (-1: not even the key)."""
    columns = np.column_stack([key, sequences])
    order = np.argsort(np.ascontiguousarray(columns.astype(">u8")).view(f"S{8 * columns.shape[1]}")[:, 0], kind="stable")
    ranked = columns[order]
    common = np.full(len(key), -1, np.int64)
    if len(key) > 1:
        common[1:] = np.cumprod(ranked[1:] == ranked[:-1], axis=1, dtype=np.int8).sum(axis=1) - 1
    return order, common


def repeats(key, ord_, first, last, words: list[bytes], window: int) -> list[int]:
    """For each suffix a bit mask over j, the words before the anchor that a window starts: set where a smaller ord has the same window.

    The subtrees of the suffixes and, of the words before the anchors, of what stands before them read backwards.
    """
    n = len(key)
    reach = int(last.max()) if n else 0
    after = np.zeros((n, window - int(first.min()) if n else 0), np.uint64)
    before = np.zeros((n, reach), np.uint64)
    for i, data in enumerate(words):
        values = np.frombuffer(data, np.uint64)
        j = last[i]
        after[i, : len(values) - j] = values[j:]
        before[i, :j] = values[:j][::-1]
    order_a, common_a = sorted_nodes(key, after)
    order_b, common_b = sorted_nodes(key, before)
    masks = np.zeros(n, object if reach > 62 else np.int64)
    node_a, node_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(int(first.min()) if n else 0, reach + 1):
        here = np.flatnonzero((first <= j) & (j <= last))
        if len(here) < 2:
            continue
        node_a[order_a] = np.cumsum(common_a < window - j)
        node_b[order_b] = np.cumsum(common_b < j)
        node = node_a[here] * (n + 1) + node_b[here]
        rank = np.lexsort((ord_[here], node))
        node, own = node[rank], ord_[here][rank]
        head = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
        least = np.repeat(own[head], np.diff(np.append(head, len(node))))
        masks[here[rank[own > least]]] |= 1 << j
    return masks.tolist()


REPEATS = "ord long, digest long, starts array<int>, keys array<struct<h: long, h2: long>>, anchors array<int>, offsets array<int>"
PAIR = pa.struct([("h", pa.int64()), ("h2", pa.int64())])
TREE = ["key", "tree", "shared", "ord", "digest", "anchors", "first", "last", "words"]


def window_digest(hashes: bytes) -> dict[str, int]:
    """128 bits of a window's word hashes."""
    x = xxhash.xxh3_128_digest(hashes)
    return {"h": int.from_bytes(x[:8], "big", signed=True), "h2": int.from_bytes(x[8:], "big", signed=True)}


def subtree_repeats(found: DataFrame, window: int, most: int = 16 << 20) -> DataFrame:
    """Rows of TREE, sorted by (key, tree) -> REPEATS: `starts` of the windows that are repeated within their tree; and, from prefixes with several trees (`shared`),
    the windows that are first in theirs: the digest of each, how far before the anchors it starts, and the anchors. Whole trees at a time, up to `most` bytes of words together.
    """

    def close(rows):
        key, tree, shared, ord_, digest, anchors, first, last, words = (list(x) for x in zip(*rows, strict=True))
        node = np.cumsum([0, *((a, b) != (c, d) for a, b, c, d in zip(key[1:], tree[1:], key, tree, strict=False))])
        masks = repeats(node.astype(np.uint64), np.array(ord_, np.int64), np.array(first), np.array(last), words, window)
        out = []
        for i, m in enumerate(masks):
            js = range(first[i], last[i] + 1)
            starts = [a - j for j in js if m >> j & 1 for a in anchors[i]]
            offsets = [j for j in js if not m >> j & 1] if shared[i] else []
            keys = [window_digest(words[i][8 * (last[i] - j) : 8 * (last[i] - j + window)]) for j in offsets]
            if starts or keys:
                out.append((ord_[i], digest[i], starts, keys, anchors[i] if keys else [], offsets))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(PAIR), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["ord", "digest", "starts", "keys", "anchors", "offsets"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    def run(batches):
        held, size = [], 0
        for batch in short(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > most and row[:2] != held[-1][:2]:
                    yield close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[8])
        if held:
            yield close(held)

    return found.select(*TREE).mapInArrow(run, REPEATS)


def copies(docs: DataFrame) -> DataFrame:
    """(ord, digest) of the documents whose text a document with a smaller id has too."""
    sums = written(docs.select(id_order(F.col("doc_id")).alias("ord"), F.xxhash64("text").alias("digest"), F.xxhash64(F.lit(1), F.col("text")).alias("other")))
    total = sums.count()
    first = written(sums.groupBy("digest", "other").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"), total)
    out = written(counted_join(sums, first, ["digest", "other"], total).where("ord > least").select("ord", "digest").distinct(), total)
    dropped(sums, first)
    return out


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, int] = PREFIXES, limit: int = LIMIT) -> DataFrame:
    """(ord, digest, starts, whole): for each document that has any, the words at which its repeated windows start; whole: it is a copy, so all do (starts is empty)."""
    if not isinstance(docs.schema["doc_id"].dataType, (T.IntegralType, T.NullType)):
        raise ValueError("doc_id must be a column of whole numbers")
    short_, longer = (min(p, window) for p in prefixes)
    rows = keyed(docs)
    size = F.lit(8 * (2 * window - short_))  # bytes of a suffix with the words around it, at most
    every = written(prefixes_of(rows, window, short_))
    total = every.count()
    ends = F.min("ord").alias("least"), F.max("ord").alias("most"), F.count("*").alias("n")
    shared = every.groupBy("key").agg(*ends, (F.sum("times") * size > limit).alias("crowded")).where("least < most").select("key", "n", "crowded")
    shared = written(shared, total)
    again = copies(docs)
    wanted = counted_join(every, shared, ["key"], total).groupBy("ord", "digest").agg(F.collect_set(F.struct("key", "crowded")).alias("keys")).join(again, ["ord", "digest"], "left_anti")
    found = written(suffixes(rows.join(wanted, ["ord", "digest"]).select("ord", "digest", "text", "keys"), window, short_, longer))
    dropped(every, shared)
    # What is left without the copies, and by the longer prefixes: groups of one document end here, and crowded ones are dealt to several trees.
    held = F.sum(F.octet_length("words"))
    n_found = found.count()
    parted = found.groupBy("key").agg(*ends, F.ceil(held / F.lit(float(limit))).cast("int").alias("trees")).where("least < most").select("key", "n", "trees")
    parted = written(parted, n_found)
    both = counted_join(found, parted, ["key"], n_found).withColumn("tree", F.pmod(F.xxhash64("ord", "digest", "words"), "trees").cast("int")).withColumn("shared", F.col("trees") > 1)
    inside = written(subtree_repeats(both.select(*TREE).repartition("key", "tree").sortWithinPartitions("key", "tree"), window))
    dropped(found, parted)
    # The prefix grown to the whole window: of each, the first of each tree.
    windows = inside.select("ord", "digest", "anchors", F.explode(F.arrays_zip("keys", "offsets")).alias("w")).select("ord", "digest", "anchors", F.col("w.keys.h").alias("h"), F.col("w.keys.h2").alias("h2"), F.col("w.offsets").alias("offset"))
    n_windows = windows.count()
    least = written(windows.groupBy("h", "h2").agg(*ends).where("least < most").select("h", "h2", "n", "least"), n_windows)
    across = counted_join(windows, least, ["h", "h2"], n_windows).where("ord > least").select("ord", "digest", F.transform("anchors", lambda a: a - F.col("offset")).alias("starts"))
    partly = inside.where(F.size("starts") > 0).select("ord", "digest", "starts").unionByName(across)
    partly = partly.groupBy("ord", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"), F.lit(False).alias("whole"))
    out = written(partly.unionByName(again.select("ord", "digest", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))))
    dropped(inside, least, again)
    return out


def maximal_repeats(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, start, n_words): the stretches of each document that repeated windows cover, each as long as it can be (a copy: the whole text)."""
    window = how.get("window", WINDOW)
    rows = docs.select("doc_id", id_order(F.col("doc_id")).alias("ord"), F.xxhash64("text").alias("digest"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    found = rows.join(repeated_windows(docs.select("doc_id", "text"), **how), ["ord", "digest"])
    # Windows whose starts are no more than a window apart touch: a stretch begins and ends where the next start is farther.
    begins = F.filter("starts", lambda s, i: (i == 0) | (s - F.get("starts", i - 1) > window))
    ends = F.filter("starts", lambda s, i: (i == F.size("starts") - 1) | (F.get("starts", i + 1) - s > window))
    joined = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.struct(x["a"].alias("start"), (x["b"] + window).alias("end")))
    whole = F.when(F.col("n") >= window, F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))).otherwise(F.array().cast("array<struct<start: int, end: int>>"))
    spans_ = found.select("doc_id", F.explode(F.when(F.col("whole"), whole).otherwise(joined)).alias("s"))
    return spans_.select("doc_id", F.col("s.start").alias("start"), (F.col("s.end") - F.col("s.start")).alias("n_words"))


def dedup(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, int] = PREFIXES, limit: int = LIMIT, layout: bool = False) -> DataFrame:
    """docs with text reduced to the kept words, joined by one space, and n_words and n_removed. layout: a text that keeps all its words stays as it is."""
    found = repeated_windows(docs.select("doc_id", "text"), window, prefixes, limit)
    rows = docs.drop("n_words", "n_removed")
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(F.struct(*others).alias("row"), "text", id_order(F.col("doc_id")).alias("ord"), F.xxhash64("text").alias("digest"))
    marked = rows.join(found, ["ord", "digest"], "left").select("row", "text", "starts", "whole")
    row_kind = marked.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in short(batches):
            texts, starts, whole = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept, counts, removed = [], [], []
            for text, at, copy in zip(texts, starts, whole, strict=True):
                words = (text or b"").split()
                gone = 0
                if copy and len(words) >= window:
                    left, gone = [], len(words)
                elif at:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(at)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = (np.cumsum(edge)[:-1] == 0).tolist()
                    gone = len(words) - sum(keep)
                    left = [w for w, k in zip(words, keep, strict=True) if k]
                else:
                    left = words
                kept.append(text if layout and not gone else b" ".join(left))
                counts.append(len(words))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "n_words", "n_removed"])

    out = marked.mapInArrow(run, f"row {row_kind}, text string, n_words long, n_removed long")
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in rows_order(docs)], "n_words", "n_removed")


def rows_order(docs: DataFrame) -> list[str]:
    """The input's columns, without the names that the result adds."""
    return [c for c in docs.columns if c not in ("n_words", "n_removed")]


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text's SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
