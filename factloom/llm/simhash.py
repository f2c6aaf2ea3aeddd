"""SimHash near-dedup: a self-join of the binary trie of fingerprints.

Fingerprints: 64 bits, each 1 if it is set in over half of the XXH64 hashes of a text's word shingles.

Join: the distinct fingerprints form a binary trie. Pairs of its nodes are traversed together from the root, adding up
the bits in which their paths differ, and a pair is pruned as soon as that exceeds the budget. The top of the trie
is traversed as Spark joins of node pairs with their children, a few bits at a time, until a pair's two subtrees
fit one task (so a crowded subtree is split deeper than others); below, each task goes on with the same traversal over its sorted fingerprints.
A task returns a spanning forest of the links it finds: no link between classes of equal fingerprints is lost, and its
rows stay below its input's. Components are found by alternating large and small stars.

Defined cases: a text without words (null and empty too) has fingerprint zero, linked like any other; a text with fewer words
than a shingle has one shingle, all its words; repeated rows are separate documents; a null id counts as larger than
any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE_ROWS, short, written
from .words import Words, groups, xxh64

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def simhashes(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (unsigned) of a few texts."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in groups(texts):
        words = Words(texts[a:b], lower=True)
        n, first = words.counts, words.first
        if not n.sum():
            continue
        text = words.text_of()
        last = (first + n - 1)[text]
        here = np.arange(len(text))
        begins = (here + shingle - 1 <= last) | (here == first[text])
        here = here[begins]
        hashes = xxh64(words.data, words.starts[here], words.ends[np.minimum(here + shingle - 1, last[here])], seed)
        text = text[here]
        total = np.bincount(text, minlength=b - a)
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            seen = np.bincount(text * 256 + lanes[:, lane], minlength=256 * (b - a)).reshape(b - a, 256)
            bits = 2 * (seen @ BYTE_BITS) > total[:, None]
            out[a:b] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * lane)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint's bits as a signed long) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in short(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhashes(texts, shingle, seed).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


# -- links --------------------------------------------------------------------------------------------------------


def top_bits(column, depth: int):
    """The first `depth` bits of a fingerprint as a number: its node at that depth."""
    return F.shiftrightunsigned(column, 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(fps: DataFrame, budget: int, capacity: int, step: int) -> list[tuple[int, DataFrame]]:
    """[(depth, pairs a, b, differing)]: pairs of subtrees within the budget, a <= b, each small enough for a task (or at full depth)."""
    spark = fps.sparkSession
    done, depth = [], 0
    size = fps.count()
    few = size // capacity * 256  # about how many pairs of nodes are open at once
    open_ = written(spark.createDataFrame([(0, 0, 0, size, size)] if size else [], "a long, b long, differing int, n_a long, n_b long"), few)
    while True:
        fits = (F.col("n_a") + F.col("n_b") <= 2 * capacity) if depth < 64 else F.lit(True)
        done.append((depth, open_.where(fits).select("a", "b", "differing")))
        rest = open_.where(~fits)
        if depth >= 64 or rest.isEmpty():
            return done
        wider = min(step, 64 - depth)
        child = fps.groupBy(top_bits(F.col("fp"), depth + wider).alias("node")).agg(F.count("*").alias("n")).withColumn("parent", F.shiftrightunsigned("node", wider))
        left = child.select(F.col("parent").alias("a"), F.col("node").alias("child_a"), F.col("n").alias("n_a"))
        right = child.select(F.col("parent").alias("b"), F.col("node").alias("child_b"), F.col("n").alias("n_b"))
        open_ = written(
            rest.select("a", "b", "differing")
            .join(left, "a")
            .join(right, "b")
            .withColumn("differing", (F.col("differing") + F.bit_count(F.col("child_a").bitwiseXOR(F.col("child_b")).bitwiseAND(F.lit((1 << wider) - 1)))).cast("int"))
            .where((F.col("differing") <= budget) & (F.col("child_a") <= F.col("child_b")))
            .select(F.col("child_a").alias("a"), F.col("child_b").alias("b"), "differing", "n_a", "n_b"),
            few,
        )
        depth += wider


def traverse(left: np.ndarray, right: np.ndarray | None, depth: int, differing: int, budget: int, most: int = 1 << 15):
    """Links (positions in left, in right) between two sorted arrays of fingerprints below nodes `depth` bits deep, in blocks.

    A frontier of node pairs goes down bit by bit; a node is a range of its sorted array. Frontiers of over `most` pairs are cut in two, so memory is bounded.
    """
    same = right is None
    right = left if same else right
    one = np.ones(1, np.int64)
    work = [(depth, 0 * one, len(left) * one, 0 * one, len(right) * one, differing * one)]
    small = 16  # ranges of so few pairs are compared at once
    while work:
        depth, al, ah, bl, bh, diff = work.pop()
        flat = (ah - al) * (bh - bl) <= small if depth < 64 else np.ones(len(al), bool)
        if flat.any():
            i, j = product(al[flat], ah[flat], bl[flat], bh[flat])
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            yield i[near], j[near]
            al, ah, bl, bh, diff = (x[~flat] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        if len(al) > most:
            h = len(al) // 2
            work += [(depth, al[:h], ah[:h], bl[:h], bh[:h], diff[:h]), (depth, al[h:], ah[h:], bl[h:], bh[h:], diff[h:])]
            continue
        am, bm = split(left, al, ah, depth), split(right, bl, bh, depth)
        nxt = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), (am, ah, bl, bm, diff + 1)]
        if same:  # of a node with itself, one of the two crossings
            nxt[3] = tuple(x[al != bl] for x in nxt[3])
        kept = []
        for pair in nxt:
            ok = (pair[0] < pair[1]) & (pair[2] < pair[3]) & (pair[4] <= budget)
            kept.append([x[ok] for x in pair])
        work.append((depth + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


def split(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where, in each range of a sorted array whose values agree in the first bits, bit `depth` turns from 0 to 1."""
    bit = np.uint64(1 << (63 - depth))
    mask = np.uint64((1 << 64) - (1 << (63 - depth)))
    edge = (values[low] & mask) | bit
    return np.clip(np.searchsorted(values, edge), low, high)


def product(al, ah, bl, bh):
    """All (i, j) of pairs of ranges."""
    na, nb = ah - al, bh - bl
    n = na * nb
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(nb, n)
    return np.repeat(al, n) + k // width, np.repeat(bl, n) + k % width


def forest(n: int, blocks) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph on 0..n-1 that the blocks of edges form."""
    label = np.arange(n)
    for i, j in blocks:
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                deeper = label[label]
                if (deeper == label).all():
                    break
                label = deeper
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def links(fps: DataFrame, budget: int = 2, capacity: int = 4096, step: int = 3) -> DataFrame:
    """fps: distinct `fp` -> u, v: a forest for each pair of subtrees, together spanning all links of `budget` bits or fewer."""
    every = []
    for depth, pairs in node_pairs(fps, budget, capacity, step):
        node = fps.select(top_bits(F.col("fp"), depth).alias("node"), "fp")
        sides = pairs.withColumn("side", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
        sides = sides.withColumn("node", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
        every.append(sides.join(node, "node").select(F.lit(depth).alias("depth"), "a", "b", "differing", "side", "fp"))
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        depth, differing = int(key[0]), int(key[3])
        values = pdf["fp"].to_numpy().view(np.uint64)
        side = pdf["side"].to_numpy()
        left = np.sort(values[side == 0])
        if key[1] == key[2]:
            node, root = forest(len(left), traverse(left, None, depth, differing, budget))
            found = left
        else:
            right = np.sort(values[side == 1])
            found = np.concatenate([left, right])
            node, root = forest(len(found), ((i, j + len(left)) for i, j in traverse(left, right, depth, differing, budget)))
        return pd.DataFrame({"u": found[node].view(np.int64), "v": found[root].view(np.int64)})

    return rows.groupBy("depth", "a", "b", "differing").applyInPandas(run, "u long, v long")


def spanned(most: int = 1 << 20):
    """The task that gives star edges u, v (v the least) of the components of the edges it reads; of over `most` edges at once, some are reduced to such before it reads on."""

    def run(batches):
        held, rows, limit = [], 0, most

        def reduced():
            u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            node, root = forest(len(ids), [(at[: len(u)], at[len(u) :])])
            return ids[node], ids[root]

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows > limit:
                held = [reduced()]
                rows = len(held[0][0])
                limit = max(most, 2 * rows)
        if held:
            u, v = reduced()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def components(edges: DataFrame, rows: int = FILE_ROWS) -> DataFrame:
    """edges u, v -> node, root: each node of an edge but the roots with the least node of its component. Tasks of about `rows` edges make them forests of stars; those of several tasks are joined by alternating large and small stars."""
    flip = lambda e: e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    e = edges if hasattr(edges, "written_at") else written(edges)
    n = e.count()
    tasks = n // rows + 1
    e = written(e.select("u", "v").where("u != v").coalesce(tasks).mapInArrow(spanned(), "u long, v long"))
    state = None
    while tasks > 1:
        both = e.unionByName(flip(e))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n)
        before, state = state, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(found: DataFrame, budget: int = 2, id_col: str = "doc_id", **how) -> DataFrame:
    """found: (id, fp) -> fp, component_id: the smallest id reachable from a fingerprint over links, its own documents included."""
    own = written(found.groupBy("fp").agg(F.min(id_col).alias("least")), found.count())
    root = components(links(own.select("fp"), budget, **how))
    rooted = own.join(root, own.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(of_root, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, seed: int = 42, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    found = written(fingerprints(docs, shingle, seed))
    of = classes(found, budget, **how)
    return found.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, budget: int = 2, shingle: int = 3, seed: int = 42, **how) -> DataFrame:
    """The rows of docs that stay: of each component the one of smallest doc_id (null last; then by its text's hash), once."""
    digest = F.xxhash64("text").alias("digest")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in short(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(simhashes(texts, shingle, seed).view(np.int64))], names=["doc_id", "digest", "fp"])

    found = written(docs.select("doc_id", digest, "text").mapInArrow(run, f"doc_id {kind}, digest long, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")
    own = written(found.groupBy("fp").agg(first), found.count())
    root = components(links(own.select("fp"), budget, **how))
    stays = own.join(root, own.fp == root.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keys = stays.select(F.coalesce("first.doc_id", F.lit(0)).alias("_id"), F.col("first.doc_id").isNull().alias("_null"), F.col("first.digest").alias("_digest"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.xxhash64("text").alias("_digest"))
    once = rows.join(keys, ["_id", "_null", "_digest"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_null", "_digest").orderBy(F.lit(0)))).where("_n = 1")
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
