"""Hard-negative mining by a Voronoi-partition distributed nearest-neighbour join.

Vectors: components become floor(scale * x), whole numbers; a score is an inner product of two such vectors. With M the greatest norm of all rows, a row x is taken as (x, sqrt(M^2 - |x|^2))
and an anchor a as (a, 0): then their squared distance is |a|^2 + M^2 - 2 * score, so the best scores are the nearest rows.

Partitions: rows and anchors go to the cell of their nearest pivot. The anchors of a cell are a group, in parts of up to `anchors_per_task`; with R the greatest distance of one of them from its
pivot p, and T the greatest distance that a row may have and still serve one of them, a row x is copied to the group only if |x - p| <= R + T, and not if |x - p| + R is less than the least distance asked for.
T comes from the anchors' own cells first (the distance of the k-th row there), then for negatives from the scores of the positives. Copies of a row are dealt over tasks of about `rows_per_task` rows by a
hash, so no cell, label or repeated vector burdens one task. A task multiplies its anchors with its rows and keeps the best of each; a ranked window, which Spark cuts before the shuffle, merges them.

Pivots change the cost only, never the result: where vectors have no neighbourhoods (random directions), bounds leave out little and each group meets most rows, in blocks.

Defined cases: rows with a null id, a null label, a null vector, a null or non-finite component take no part, nor do rows whose whole-number vector has a squared norm of 2^62 or more (scores would not fit a long).
Shorter vectors count as followed by zeros. Rows equal in id, label and vector count once; rows of the anchor's own id are never its positives. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, short, written

#: Squared norms from which scores might not fit a long.
MOST = float(1 << 62)


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of rows (vec_id, label, embedding) that take part: v is the vector as little-endian longs, all of one length."""
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in short(batches, 4096):
            vectors = batch.column(2)
            flat, at = vectors.flatten().cast(pa.float64()), np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            x = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            n = np.diff(at)
            row, column = np.repeat(np.arange(len(n)), n), np.arange(len(x)) - np.repeat(at[:-1], n)
            full = np.zeros((len(n), width))
            full[row, column] = x
            with np.errstate(invalid="ignore", over="ignore"):
                fits = (full * full).sum(axis=1) < MOST  # false for what is not finite too
            full[~fits] = 0
            blobs = pa.array([v.tobytes() for v in full.astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs], names=["vec_id", "label", "v"]).filter(pa.array(fits))

    asked = rows.where("vec_id is not null and label is not null and embedding is not null").select("vec_id", "label", "embedding")
    return asked.mapInArrow(run, f"vec_id long, label {kind}, v binary").dropDuplicates()


def matrix(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(-1, width)


def squares(v: np.ndarray) -> np.ndarray:
    """Squared norms, as doubles."""
    return (v.astype(np.float64) ** 2).sum(axis=1)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, exact: by doubles where every sum of products stays below 2^53, by longs else."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if squares(anchors).max() * squares(rows).max() < 2.0**104:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def distances(v: np.ndarray, pivots: np.ndarray, pivot_last: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of vectors with the added component `last` from every pivot."""
    a, b = v.astype(np.float64), pivots.astype(np.float64)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T + (last[:, None] - pivot_last[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0))


class Cells:
    """The pivots: up to `most` rows, those of the lowest hashes, so their number has a bound; and the greatest norm."""

    def __init__(self, points: DataFrame, n: int, top: float, width: int):
        chosen = points.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id", "v").limit(4 * n).toArrow()["v"].to_pylist()
        self.width, self.top = width, top
        self.pivots = matrix(list(dict.fromkeys(chosen))[:n], width)
        self.last = np.sqrt(np.maximum(top - squares(self.pivots), 0))
        #: What rounding may add to a distance.
        self.slack = 1e-6 * (1 + np.sqrt(top))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        return distances(v, self.pivots, self.last, np.sqrt(np.maximum(self.top - squares(v), 0)))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        return distances(v, self.pivots, self.last, np.zeros(len(v)))


def assigned(points: DataFrame, cells: Cells, anchors: bool) -> DataFrame:
    """points with their cell and their distance from its pivot."""
    kind = points.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in short(batches, 4096):
            d = (cells.of_anchors if anchors else cells.of_rows)(matrix(batch.column(2).to_pylist(), cells.width))
            cell = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d.min(axis=1))], names=["vec_id", "label", "v", "cell", "d"])

    return points.mapInArrow(run, f"vec_id long, label {kind}, v binary, cell int, d double")


def routed(owned: DataFrame, cells: Cells, radius: np.ndarray, low: np.ndarray, high: np.ndarray, own: bool) -> DataFrame:
    """Rows with `groups`: the groups whose anchors might be served; without that of the row's own cell, if `own` is false.

    low, high: of each group, the least and greatest distance that a serving row has from an anchor; radius: negative where a group has no anchors.
    """
    kind = owned.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in short(batches, 4096):
            d = cells.of_rows(matrix(batch.column(2).to_pylist(), cells.width))
            meets = (radius >= 0) & (d - cells.slack <= radius + high) & (d + radius + cells.slack >= low)
            if not own:
                meets[np.arange(len(d)), batch.column(3).to_numpy()] = False
            group = np.nonzero(meets)[1].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(meets.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(group))], names=["vec_id", "label", "v", "groups"])

    return owned.select("vec_id", "label", "v", "cell").mapInArrow(run, f"vec_id long, label {kind}, v binary, groups array<int>")


def met(anchors: DataFrame, rows: DataFrame, join, schema: str, parts: np.ndarray, rows_per_task: int) -> DataFrame:
    """join(anchors, rows) for every group and block. anchors: cell, part; rows: vec_id, label, v, groups; parts: of each group, how many parts its anchors are in."""
    spark = anchors.sparkSession
    sent = {r[0]: r[1] for r in rows.select(F.explode("groups").alias("cell")).groupBy("cell").count().collect()}  # a row for each pivot at most
    table = [(int(c), int(parts[c]), -(-int(n) // rows_per_task)) for c, n in sent.items()]
    plan = F.broadcast(spark.createDataFrame(table, "cell int, parts int, blocks int"))
    a = anchors.join(plan.select("cell", "blocks"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    b = rows.select("vec_id", "label", "v", F.explode("groups").alias("cell")).join(plan, "cell")
    b = b.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")
    keys = ["cell", "part", "block"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(join, schema)


def best_of(row: np.ndarray, column: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The first k of each row by score, then id: positions in the three arrays."""
    order = np.lexsort((ids[column], -score, row))
    row = row[order]
    first = np.searchsorted(row, row)
    return order[np.arange(len(row)) - first < k]


def nearest(width: int, k: int):
    """The task that keeps, of each anchor, the k best rows of its label."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            rows, ids, labels = matrix(b["v"], width), b["vec_id"].to_numpy(), b["label"].to_numpy()
            for at in range(0, len(a), 128):
                part = a[at : at + 128]
                s = scores(matrix(part["v"], width), rows)
                ok = (part["label"].to_numpy()[:, None] == labels[None, :]) & (part["vec_id"].to_numpy()[:, None] != ids[None, :])
                s[~ok] = np.iinfo(np.int64).min
                least = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]
                row, column = np.nonzero(ok & (s >= least[:, None]))
                score = s[row, column]
                keep = best_of(row, column, score, ids, k)
                found.append(pd.DataFrame({"anchor_id": part["vec_id"].to_numpy()[row[keep]], "anchor": part["anchor"].to_numpy()[row[keep]], "vec_id": ids[column[keep]], "score": score[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"anchor_id": [], "anchor": [], "vec_id": [], "score": []}).astype("int64")

    return run


def between(width: int, k: int, low: int, high: int):
    """The task that keeps, of each anchor and positive, the k best rows of other labels with low * p <= 100 * score <= high * p, p the positive's score."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            rows, ids, labels = matrix(b["v"], width), b["vec_id"].to_numpy(), b["label"].to_numpy()
            for at in range(0, len(a), 128):
                part = a[at : at + 128]
                n = part["positive_scores"].map(len).to_numpy()
                of, p = np.repeat(np.arange(len(part)), n), np.concatenate([np.asarray(x, np.int64) for x in part["positive_scores"]])
                positive = np.concatenate([np.asarray(x, np.int64) for x in part["positive_ids"]])
                # Whole numbers: the least and greatest scores of each positive.
                least, most = np.array([-(-low * x // 100) for x in p.tolist()]), np.array([high * x // 100 for x in p.tolist()])
                s = scores(matrix(part["v"], width), rows)
                other = part["label"].to_numpy()[:, None] != labels[None, :]
                bottom, top = np.full(len(part), np.iinfo(np.int64).max), np.full(len(part), np.iinfo(np.int64).min)
                np.minimum.at(bottom, of, least)
                np.maximum.at(top, of, most)
                row, column = np.nonzero(other & (s >= bottom[:, None]) & (s <= top[:, None]))
                score = s[row, column]
                order = np.lexsort((ids[column], -score, row))
                row, column, score = row[order], column[order], score[order]
                begins = np.searchsorted(row, np.arange(len(part) + 1))
                for j in range(len(p)):
                    mine = score[begins[of[j]] : begins[of[j] + 1]]
                    x = begins[of[j]] + np.searchsorted(-mine, -most[j])
                    y = min(x + k, begins[of[j]] + np.searchsorted(-mine, -least[j], side="right"))
                    if x < y:
                        r = part.iloc[of[j]]
                        found.append(pd.DataFrame({"anchor_id": r["vec_id"], "anchor": r["anchor"], "positive_id": positive[j], "positive_score": p[j], "negative_id": ids[column[x:y]], "negative_score": score[x:y]}))
        names = ["anchor_id", "anchor", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in names}).astype("int64")

    return run


def by_cell(rows: DataFrame, n: int, absent: float, *values) -> list[np.ndarray]:
    """Aggregates of rows by cell, as arrays over all cells."""
    out = [np.full(n, float(absent)) for _ in values]
    for r in rows.groupBy("cell").agg(*values).collect():  # a row for each pivot at most
        for array, x in zip(out, r[1:], strict=True):
            array[r[0]] = np.inf if x is None else x
    return out


def mine(
    rows: DataFrame,
    is_anchor,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    anchors_per_task: int = 512,
    rows_per_task: int = 2048,
    least_pivots: int = 8,
    most_pivots: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, embedding).

    is_anchor: a condition on vec_id. Positives: an anchor's first `positives` other rows of its label. For each of them the first `negatives` rows of other labels whose score is `low` to `high` percent of its own.
    """
    points = written(whole_vectors(rows, scale))
    n_anchors, some = points.where(is_anchor).count(), points.select(F.octet_length("v")).first()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = some[0] // 8
    norm = F.pandas_udf(lambda v: pd.Series(squares(matrix(v, width))), "double")
    cells = Cells(points, min(most_pivots, max(least_pivots, -(-n_anchors // anchors_per_task))), points.agg(F.max(norm("v"))).first()[0], width)
    m = len(cells.pivots)

    anchors = assigned(points.where(is_anchor), cells, anchors=True).withColumns({"anchor": F.xxhash64("vec_id", "label", "v"), "norm": norm("v")})
    counts, radius = by_cell(anchors, m, -1, F.count("*"), F.max("d"))
    parts = np.maximum(-(-counts // anchors_per_task), 1).astype(int)
    n_parts = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("cell") + 1)
    anchors = written(anchors.withColumn("part", F.pmod(F.xxhash64("anchor"), n_parts).cast("int")))
    owned = written(assigned(points, cells, anchors=False).drop("d"))
    dropped(points)
    asks = ["cell", "part", "vec_id", "anchor", "label", "v"]

    # The anchors' own cells give a first distance; of the other cells only what is nearer can help.
    found, first = "anchor_id long, anchor long, vec_id long, score long", Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("score"), "vec_id")
    rank = F.row_number().over(first)
    own = met(anchors.select(*asks), owned.withColumn("groups", F.array("cell")), nearest(width, positives), found, parts, rows_per_task)
    near = written(own.withColumn("rank", rank).where(F.col("rank") <= positives).drop("rank"))
    last = near.groupBy("anchor_id", "anchor").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    of_anchor = anchors.select("cell", F.col("vec_id").alias("anchor_id"), "anchor", "norm")
    square = lambda score: F.greatest(F.lit(0.0), F.col("norm") + F.lit(cells.top) - 2.0 * score.cast("double"))
    reach = of_anchor.join(last, ["anchor_id", "anchor"], "left").withColumn("far", F.when(F.col("n") == positives, F.sqrt(square(F.col("score")))))
    (far,) = by_cell(reach, m, 0, F.when(F.count("*") == F.count("far"), F.max("far")))
    others = written(routed(owned, cells, radius, np.zeros(m), far, own=False))
    more = met(anchors.select(*asks), others, nearest(width, positives), found, parts, rows_per_task)
    best = written(near.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= positives))

    # Between which distances the negatives of each anchor lie.
    asked = best.where("score >= 0").groupBy("anchor_id", "anchor").agg(F.collect_list("vec_id").alias("positive_ids"), F.collect_list("score").alias("positive_scores"), F.min("score").alias("least"), F.max("score").alias("most"))
    ring = of_anchor.join(asked, ["anchor_id", "anchor"]).select("cell", F.sqrt(square(F.col("least").cast("double") * low / 100)).alias("outer"), F.sqrt(square(F.col("most").cast("double") * high / 100)).alias("inner"))
    outer, inner = by_cell(ring, m, -1, F.max("outer"), F.min("inner"))
    serving = written(routed(owned, cells, np.where(outer < 0, -1, radius), np.maximum(inner, 0), outer, own=True))
    asking = anchors.select(*asks).join(asked.select(F.col("anchor_id").alias("vec_id"), "anchor", "positive_ids", "positive_scores"), ["vec_id", "anchor"])
    ringed = "anchor_id long, anchor long, positive_id long, positive_score long, negative_id long, negative_score long"
    hits = met(asking, serving, between(width, negatives, low, high), ringed, parts, rows_per_task)
    first = Window.partitionBy("anchor_id", "anchor", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hits = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return hits.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
