"""Lists of sets that share a shingle: which pairs of a list can be alike enough, by size and position, by known overlaps with a leader and by parity bitmaps. Pairs that are skipped are never rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short, shuffle_width
from .simhash import product


def parity(hashes: np.ndarray) -> bytes:
    """Bits that tell which of 2^k slots an odd number of a set's hashes fall in, at least one slot a hash. Two such bitmaps differ in no more bits than the sets in hashes; half of one folded on the other is the one for half the slots."""
    slots = max(64, 1 << int(max(len(hashes) - 1, 1)).bit_length())
    seen = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(seen.astype(np.uint8), bitorder="little").tobytes()


def alike(p: int, q: int, overlap, n_a, n_b):
    """Whether an overlap gives a similarity of p / q."""
    return (p + q) * overlap >= p * (n_a + n_b)


def folded(bitmap: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bitmap, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differing(bitmaps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of bitmaps, each pair at the smaller one's size."""
    sizes = np.array([len(x) for x in bitmaps])
    pair_size, out = np.minimum(sizes[a], sizes[b]), np.zeros(len(a), np.int64)
    for size in np.unique(pair_size).tolist():
        here = np.flatnonzero(pair_size == size)
        used, at = np.unique(np.concatenate([a[here], b[here]]), return_inverse=True)
        rows = np.stack([folded(bitmaps[k], size) for k in used.tolist()])
        left, right = at[: len(here)], at[len(here) :]
        for k in range(0, len(here), 4096):
            out[here[k : k + 4096]] = np.bitwise_count(rows[left[k : k + 4096]] ^ rows[right[k : k + 4096]]).sum(axis=1, dtype=np.int64)
    return out


def open_pairs(n: np.ndarray, at: np.ndarray, root: np.ndarray, p: int, q: int):
    """Of one list, the positions a, b of pairs of different roots whose blocks could give the similarity; in turns."""
    blocks, block = np.unique(n << 32 | at, return_inverse=True)
    size, position = blocks >> 32, blocks & 0xFFFFFFFF
    _, of, times = np.unique(root, return_inverse=True, return_counts=True)
    minor = np.flatnonzero(of != times.argmax())  # each pair of different roots has one outside the largest
    rank = np.full(len(n), -1)
    rank[minor] = np.arange(len(minor))
    step = max(1, (1 << 22) // len(n))
    for k in range(0, len(minor), step):
        x = minor[k : k + step]
        mine, own = np.unique(block[x], return_inverse=True)
        rest = np.minimum((size - position)[mine][:, None], (size - position)[None, :])
        fits = alike(p, q, rest, size[mine][:, None], size[None, :])  # once for two blocks
        a, b = np.nonzero(fits[own][:, block] & (of[x][:, None] != of[None, :]) & ((rank[None, :] < 0) | (rank[None, :] > rank[x][:, None])))
        yield x[a], b


ENTRY = ["token", "low", "high", "side", "sid", "n", "at", "root", "hub", "overlap", "n_hub", "bits"]


def pairs_of(columns: dict[str, np.ndarray], bitmaps: list[bytes], p: int, q: int, best_only: bool, few: int = 24) -> pd.DataFrame:
    """u, v and known (1 for a link that is derived, 0 for a pair to be computed) of whole lists, or pairs of their blocks (side 0 and 1), one behind the other."""
    sid, n, at, root, side = (columns[c] for c in ("sid", "n", "at", "root", "side"))
    hub, overlap, n_hub = (columns[c] for c in ("hub", "overlap", "n_hub"))
    turn = turns(columns)
    turn[:1] = True
    begins = np.flatnonzero(turn)
    ends = np.append(begins[1:], len(sid))
    of = np.cumsum(turn) - 1
    found = []

    def refine(a, b):
        two = columns["low"][a] != columns["high"][a]  # pairs within a block are another task's
        keep = ~two | (side[a] != side[b])
        a, b = a[keep], b[keep]
        shared = (overlap[a] >= 0) & (overlap[b] >= 0) & (hub[a] == hub[b])
        most = np.minimum(n[a], n[b])
        most = np.where(shared, np.minimum(most, np.minimum(overlap[a], overlap[b]) + np.minimum(n[a] - overlap[a], n[b] - overlap[b])), most)
        least = np.where(shared, overlap[a] + overlap[b] - n_hub[a], 0)
        keep = alike(p, q, most, n[a], n[b])
        a, b, most, least = a[keep], b[keep], most[keep], least[keep]
        most = np.minimum(most, (n[a] + n[b] - differing(bitmaps, a, b)) // 2)
        keep = alike(p, q, most, n[a], n[b])
        a, b, most, least = a[keep], b[keep], most[keep], least[keep]
        known = alike(p, q, least, n[a], n[b]).astype(np.int64)
        one = pd.DataFrame({"u": np.maximum(sid[a], sid[b]), "v": np.minimum(sid[a], sid[b]), "known": known})
        if best_only:  # of two components in a list the pair that is furthest above the similarity
            one["list"], one["r"], one["s"], one["short"] = of[a], np.maximum(root[a], root[b]), np.minimum(root[a], root[b]), p * (n[a] + n[b]) - (p + q) * most
            one = one.sort_values(["known", "short"], ascending=[False, True], kind="stable").drop_duplicates(["list", "r", "s"])
        found.append(one[["u", "v", "known"]].drop_duplicates())

    small = ends - begins <= few
    low, high = begins[small], ends[small]
    for k in range(0, len(low), 1 << 13):
        a, b = product(low[k : k + (1 << 13)], high[k : k + (1 << 13)], low[k : k + (1 << 13)], high[k : k + (1 << 13)])
        keep = (a < b) & (root[a] != root[b])
        a, b = a[keep], b[keep]
        keep = alike(p, q, np.minimum(n[a] - at[a], n[b] - at[b]), n[a], n[b])
        refine(a[keep], b[keep])
    for low, high in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
        for a, b in open_pairs(n[low:high], at[low:high], root[low:high], p, q):
            refine(a + low, b + low)
    return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"u": [], "v": [], "known": []}).astype("int64")


def turns(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Where the next list, or pair of its blocks, begins."""
    turn = np.zeros(len(columns["token"]), bool)
    for c in ("token", "low", "high"):
        turn[1:] |= columns[c][1:] != columns[c][:-1]
    return turn


def whole_lists(handed, rows: int = 1 << 15):
    """The task that reads entries in the order of their lists and gives about `rows` at once, whole lists, to handed(table)."""

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            cut = np.flatnonzero(turns({c: part[c].to_numpy() for c in ("token", "low", "high")}))
            if len(cut):
                yield handed(part.slice(0, cut[-1]))
                held = part.slice(cut[-1]).to_batches()
        if held:
            yield handed(pa.Table.from_batches(held).combine_chunks())

    return run


def viable(p: int, q: int, few: int = 24):
    """The task that keeps the entries of a list that have a partner there, by size and position. A block without one is skipped with all its entries."""

    def handed(part: pa.Table):
        columns = {c: part[c].to_numpy() for c in ("token", "low", "high", "n", "at")}
        n, at, keep = columns["n"], columns["at"], np.zeros(part.num_rows, bool)
        begins = np.flatnonzero(turns(columns) | (np.arange(part.num_rows) == 0))
        ends = np.append(begins[1:], part.num_rows)
        small = ends - begins <= few
        low, high = begins[small], ends[small]
        for k in range(0, len(low), 1 << 13):
            a, b = product(low[k : k + (1 << 13)], high[k : k + (1 << 13)], low[k : k + (1 << 13)], high[k : k + (1 << 13)])
            fits = (a != b) & alike(p, q, np.minimum(n[a] - at[a], n[b] - at[b]), n[a], n[b])
            keep[a[fits]] = True
        for low, high in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
            blocks, block, times = np.unique(n[low:high] << 32 | at[low:high], return_inverse=True, return_counts=True)
            size, rest = blocks >> 32, (blocks >> 32) - (blocks & 0xFFFFFFFF)
            served = np.zeros(len(blocks), bool)
            for k in range(0, len(blocks), 1024):
                own = np.arange(k, min(k + 1024, len(blocks)))
                fits = alike(p, q, np.minimum(rest[own][:, None], rest[None, :]), size[own][:, None], size[None, :])
                fits[np.arange(len(own)), own] &= times[own] > 1  # of a block's only entry, itself is no partner
                served[own] = fits.any(axis=1)
            keep[low:high] = served[block]
        return part.select(["token", "hot", "sid", "n", "at"]).filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else pa.RecordBatch.from_pylist([], part.select(["token", "hot", "sid", "n", "at"]).schema)

    return whole_lists(handed)


def met_pairs(p: int, q: int, best_only: bool):
    """The task of pairs_of()."""

    def handed(part: pa.Table):
        columns = {c: part[c].to_numpy() for c in ENTRY[:-1]}
        return pa.RecordBatch.from_pandas(pairs_of(columns, part["bits"].to_pylist(), p, q, best_only), preserve_index=False)

    return whole_lists(handed)


def of_token(rows: DataFrame, **values) -> DataFrame:
    """rows (token, hot, ...) with aggregates of their token: of hot tokens, which are few, by a broadcast, of the others by a window."""
    token = Window.partitionBy("token")
    cold = rows.where("not hot").withColumns({k: v.over(token) for k, v in values.items()})
    few = rows.where("hot").groupBy("token").agg(*[v.alias(k) for k, v in values.items()])
    return cold.unionByName(rows.where("hot").join(F.broadcast(few), "token").select(cold.columns))


def tiled(entries: DataFrame, list_rows: int) -> DataFrame:
    """entries with low, high and side, in the order of their lists; those of a list of over `list_rows` entries by pairs of its blocks (side 0 and 1)."""
    rows = of_token(entries, lists=F.count("sid")).withColumn("parts", F.ceil(F.col("lists") / list_rows).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("side", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1))
    rows = rows.select(*entries.columns, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "side")
    return rows.repartition(shuffle_width(entries.sparkSession), "token", "low", "high").sortWithinPartitions("token", "low", "high")


def possible(pairs: DataFrame, members: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs u, v that could be alike enough by their parity bitmaps. members: sid, n, bits."""

    def run(batches):
        for batch in short(batches, 4096):
            a, n_u, n_v = np.arange(batch.num_rows), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = differing(batch.column(4).to_pylist() + batch.column(5).to_pylist(), a, a + batch.num_rows)
            keep = alike(p, q, np.minimum(np.minimum(n_u, n_v), (n_u + n_v - apart) // 2), n_u, n_v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: members.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v")
    return both.mapInArrow(run, "u long, v long")
