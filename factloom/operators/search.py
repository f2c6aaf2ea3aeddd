"""Search by vectors and words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, query: list[float], k: int = 8) -> DataFrame:
    """The k rows (fragment_id, embedding) of highest inner product with the query, ties by id: each task keeps k."""
    scored = vectors.select("fragment_id", F.round(dot(F.col("embedding"), _literal(query)), 8).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "fragment_id").limit(k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, a row each; without a Python object for any of them."""
    sizes = pc.list_value_length(column).to_numpy()
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return pc.list_flatten(column).to_numpy().astype(np.float64, copy=False).reshape(len(sizes), sizes[0])


def _best(k: int):
    """The task that keeps, of a block of queries and a block of vectors, k vectors a query."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        asked, chosen, similarity = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(a) and len(b):
            order = pc.sort_indices(b["fragment_id"]).to_numpy()
            queries, held = _matrix(a["embedding"]), _matrix(b["embedding"])[order]
            for at in range(0, len(a), 128):
                similar = np.round(queries[at : at + 128] @ held.T, 8)
                least = np.partition(similar, -min(k, len(held)), axis=1)[:, -min(k, len(held))]
                for query, (row, low) in enumerate(zip(similar, least, strict=True), at):
                    at_least = np.flatnonzero(row >= low)
                    first = at_least[np.argsort(-row[at_least], kind="stable")][:k]
                    asked.append(np.full(len(first), query))
                    chosen.append(order[first].astype(np.int64))
                    similarity.append(row[first])
        return pa.table({"query_id": a["query_id"].take(np.concatenate(asked)), "fragment_id": b["fragment_id"].take(np.concatenate(chosen)), "similarity": np.concatenate(similarity)})

    return best


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 8, query_rows: int = 4096, vector_rows: int = 16384) -> DataFrame:
    """query_id, fragment_id, similarity: for each of many queries (query_id, embedding) its k rows of `vectors` (fragment_id, embedding) of highest inner product, ties by id.

    Both sides are dealt by hash to blocks of about `query_rows` and `vector_rows`; a task multiplies one block with one other and keeps k rows a query, and these are merged by query.
    Rows without id or embedding are left out; an empty side gives no rows.
    """
    own = vectors.where("fragment_id is not null and embedding is not null").select("fragment_id", "embedding")
    asked = queries.where("query_id is not null and embedding is not null").select("query_id", "embedding")
    n_own, n_asked = own.count() // vector_rows + 1, asked.count() // query_rows + 1
    deal = lambda rows, key, mine, n_mine, other, n_other: rows.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n_mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    left, right = deal(asked, "query_id", "a", n_asked, "b", n_own), deal(own, "fragment_id", "b", n_own, "a", n_asked)

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, fragment_id string, similarity double"
    near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_best(k), kinds)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "fragment_id")
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


# -- an inverted-file index -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """centroids: of the lists; probes: how many lists a query looks into; recall: the share of the sample queries' true neighbours in these."""

    centroids: np.ndarray
    probes: int
    recall: float

    def lists(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n lists of each vector whose centroids have the highest inner products, best first."""
        similar = vectors @ self.centroids.T
        near = np.argpartition(-similar, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(similar, near, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def _usable(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(f"{key} is not null and embedding is not null").select(key, "embedding")


def fit_index(vectors: DataFrame, k: int = 10, target: float = 0.95, sample: int = 16384, checks: int = 256, most_lists: int = 4096, turns: int = 10, seed: int = 7) -> VectorIndex:
    """An index for vectors (fragment_id, embedding): centroids by k-means on up to `sample` rows, then as few probes as give `target` recall.

    Bounds: `sample` rows and `checks` query rows come to the driver, those of the lowest hashes. The checks' true neighbours are found over all rows.
    """
    own = _usable(vectors, "fragment_id")
    n = own.count()
    by_hash = lambda salt: F.xxhash64("fragment_id", F.lit(seed + salt))
    rows = np.array([r[0] for r in own.orderBy(by_hash(0), "fragment_id").limit(sample).select("embedding").collect()], np.float64)
    if not len(rows):
        return VectorIndex(np.zeros((1, 1)), 1, 1.0)
    m = int(min(most_lists, max(1, np.sqrt(n)), len(rows)))
    centroids = rows[np.random.default_rng(seed).permutation(len(rows))[:m]]
    for _ in range(turns):
        norms = (centroids**2).sum(axis=1)
        at = np.concatenate([(rows[k : k + 2048] @ centroids.T * 2 - norms).argmax(axis=1) for k in range(0, len(rows), 2048)])
        sums, counts = np.zeros_like(centroids), np.bincount(at, minlength=m)
        np.add.at(sums, at, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    every = VectorIndex(centroids, m, 1.0)
    asked = own.orderBy(by_hash(1), "fragment_id").limit(checks).select(F.col("fragment_id").alias("query_id"), "embedding")
    true = nearest_each(own, asked, k).select("query_id", "fragment_id").join(asked, "query_id").join(own.withColumnRenamed("embedding", "near"), "fragment_id").select("embedding", "near").collect()
    order = every.lists(np.array([r[0] for r in true], np.float64), m)
    rank = (order == every.lists(np.array([r[1] for r in true], np.float64), 1)).argmax(axis=1)  # how far down a query's lists its neighbour lies
    probes = int(np.sort(rank)[max(0, int(np.ceil(target * len(rank))) - 1)]) + 1
    return VectorIndex(centroids, probes, float((rank < probes).mean()))


def in_lists(rows: DataFrame, index: VectorIndex, key: str, probes: int = 1) -> DataFrame:
    """rows (key, embedding) with `list`: once for each of the `probes` lists nearest to it."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                pdf["lists"] = list(index.lists(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), probes))
                yield pdf

    found = _usable(rows, key).mapInPandas(run, f"`{key}` {kind}, embedding array<double>, lists array<int>")
    return found.select(key, "embedding", F.explode("lists").alias("list"))


def nearest_in_index(indexed: DataFrame, queries: DataFrame, index: VectorIndex, k: int = 10, query_rows: int = 4096, vector_rows: int = 16384) -> DataFrame:
    """query_id, fragment_id, similarity: for each query the k rows of highest inner product among those of its lists, compared exactly, ties by id.

    indexed: in_lists(vectors, index, "fragment_id"), every row in one list. A list of over `vector_rows` rows, and the queries that look into it, are dealt to blocks by hash, so a crowded list is several tasks.
    """
    asked = in_lists(queries, index, "query_id", index.probes)
    count = lambda rows, name, most: rows.groupBy("list").agg((F.count("*") / most + 1).cast("int").alias(name))
    blocks = F.broadcast(count(indexed, "n_b", vector_rows).join(count(asked, "n_a", query_rows), "list"))  # a row for each list
    deal = lambda rows, key, mine, n_mine, other, n_other: rows.join(blocks, "list").withColumn(mine, F.pmod(F.xxhash64(key), F.col(n_mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("n_a", "n_b")
    left, right = deal(asked, "query_id", "a", "n_a", "b", "n_b"), deal(indexed, "fragment_id", "b", "n_b", "a", "n_a")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, fragment_id string, similarity double"
    near = left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInArrow(_best(k), kinds)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "fragment_id")
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def _word_share(question: str) -> Column:
    """The share of the question's words that `text` holds."""
    terms = sorted({t for t in question.lower().replace("ё", "е").split() if t})
    hay = F.translate(F.lower("text"), "ё", "е")
    return sum((F.contains(hay, F.lit(t)).cast("int") for t in terms), F.lit(0)) / max(len(terms), 1)


def hybrid_each(vectors: DataFrame, fragments: DataFrame, queries: DataFrame, question: str, hidden: DataFrame | None = None, k: int = 8, fetch: int = 3) -> DataFrame:
    """query_id, fragment_id, score: `hybrid` for each of many queries (query_id, embedding) with the words of one question."""
    rows = fragments.join(hidden, "document_id", "left_anti") if hidden is not None else fragments
    near = nearest_each(vectors.join(rows.select("fragment_id"), "fragment_id", "left_semi"), queries, fetch * k)
    # The words of a fragment are looked for once, however many queries it is near to.
    shares = rows.select("fragment_id", _word_share(question).alias("share"))
    both = near.join(shares, "fragment_id").withColumn("score", F.round(F.col("similarity") * 0.72 + F.col("share") * 0.28, 4)).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "fragment_id")
    return both.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).select("query_id", "fragment_id", "score")


def hybrid(vectors: DataFrame, fragments: DataFrame, query: list[float], question: str, hidden: DataFrame | None = None, k: int = 8, fetch: int = 3) -> DataFrame:
    """fragment_id, score: of the fetch * k nearest visible fragments, 0.72 of similarity and 0.28 of the share of the question's words they hold.

    Hidden documents are left out before the cut, so a page of k is full whenever there are k.
    """
    rows = fragments.join(hidden, "document_id", "left_anti") if hidden is not None else fragments
    near = nearest(vectors.join(rows.select("fragment_id"), "fragment_id", "left_semi"), query, fetch * k)
    # At most fetch * k rows on one side.
    both = rows.join(F.broadcast(near), "fragment_id").withColumn("score", F.round(F.col("similarity") * 0.72 + _word_share(question) * 0.28, 4))
    return both.where("score > 0").orderBy(F.col("score").desc(), "fragment_id").limit(k).select("fragment_id", "score")
