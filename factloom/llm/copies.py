"""Near copies: texts whose sets of word shingles have a Jaccard similarity of `least` or more, all of them. SimHash near-dedup where a similarity is asked for.

Sets: XXH64 of the runs of `shingle` words. Equal sets are one set from then on.

First the method of `simhash`: the sets' fingerprints are self-joined as a binary trie within a Hamming budget. A pair it finds is a link only if the two whole sets are alike enough.
No budget that a trie can be searched with finds all pairs of a similarity of 0.8 (they differ in 9 or 10 of 64 bits on average), so the links are completed:

With all shingles in one order, two sets that are alike enough share one of the first n - ceil(least * n) + 1 shingles of
each (n: a set's size). So sets meet on these alone, and an entry without a partner by size and position is left out before anything is joined with it.
The order changes the cost only, never the result: shingles that a sample of the texts holds often come last.
The sets of each shingle are compared with a few of them (`rounds`), unless parity bitmaps rule the pair out; with the links by fingerprints, most groups then are one component. Of the others all remaining pairs of different components
are judged in blocks of their lists, by size, position and parity bitmap (`lists`); only pairs that pass all three become rows and are compared: first the likeliest pair of two components in each list, then all.
Components are found by `simhash.components`.

Defined cases: a text without words (null and empty too) has the empty set, a copy of any other such text; a text with fewer words than a
shingle has one shingle, all its words; repeated rows are separate documents; a null id counts as larger than any other; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import collected, dropped, short, written
from .lists import ENTRY, alike, met_pairs, parity, possible, tiled, viable
from .simhash import components, links
from .words import Words, groups, xxh64


def shingle_sets(texts: list[bytes | None], shingle: int = 5, seed: int = 42):
    """The sorted distinct hashes of each text's shingles."""
    for a, b in groups(texts):
        words = Words(texts[a:b], lower=True)
        n, first = words.counts, words.first
        if not n.sum():
            yield from [np.empty(0, np.uint64)] * (b - a)
            continue
        text = words.text_of()
        last = (first + n - 1)[text]
        here = np.arange(len(text))
        here = here[(here + shingle - 1 <= last) | (here == first[text])]
        hashes = xxh64(words.data, words.starts[here], words.ends[np.minimum(here + shingle - 1, last[here])], seed)
        cuts = np.searchsorted(text[here], np.arange(b - a + 1))
        for k in range(b - a):
            yield np.unique(hashes[cuts[k] : cuts[k + 1]])


def set_digest(hashes: np.ndarray) -> int:
    """A set's number: a signed 64-bit digest of its sorted hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def prefix(hashes: np.ndarray, often: np.ndarray, times: np.ndarray, least: Fraction) -> np.ndarray:
    """The first hashes of a set, in the common order: by how often the sample holds them, then by value."""
    n = len(hashes)
    length = n - -(-least.numerator * n // least.denominator) + 1 if n else 0
    at = np.minimum(np.searchsorted(often, hashes), max(len(often) - 1, 0))
    count = np.where(often[at] == hashes, times[at], 0) if len(often) else np.zeros(n, np.int64)
    return hashes[np.lexsort((hashes, count))[:length]]


def frequent(docs: DataFrame, shingle: int, seed: int, sample: int = 8192, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The up to `most` shingles that about `sample` texts hold oftenest, sorted, and how many hold them."""
    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(docs.count() // sample + 1)) == 0)

    def run(batches):
        for batch in short(batches):
            for hashes in shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), shingle, seed):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["token"])

    counted = part.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    rows = counted.orderBy(F.col("n").desc(), "token").limit(most).toArrow()
    often, times = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(often)
    return often[order], times[order]


def fingerprint(hashes: np.ndarray) -> int:
    """A set's SimHash: the bits that over half of its hashes have, as a signed number."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def verified(pairs: DataFrame, texts: DataFrame, least: Fraction, shingle: int, seed: int) -> DataFrame:
    """u, v of the pairs whose sets are alike enough. texts: sid, text, each sid once."""
    side = lambda name: texts.select(F.col("sid").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "text_u", "text_v")

    def run(batches):
        for batch in batches:
            for part in short([batch], 64):
                a, b = (shingle_sets(part.column(k).cast(pa.binary()).to_pylist(), shingle, seed) for k in (2, 3))
                keep = []
                for x, y in zip(a, b, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(least.denominator * shared >= least.numerator * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def deduplicate(docs: DataFrame, least: Fraction = Fraction(4, 5), shingle: int = 5, seed: int = 42, budget: int = 2, rounds: int = 3, list_rows: int = 1024) -> DataFrame:
    """The rows of docs that stay: of each component of near copies the one of smallest doc_id (null last; then by its text's hash), once."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    collected(spark)
    shared_order = spark.sparkContext.broadcast(frequent(docs, shingle, seed))

    def run(batches):
        often, times = shared_order.value
        seen = set()
        for batch in short(batches):
            sids, sizes, firsts, prints, bits = [], [], [], [], []
            for hashes in shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), shingle, seed):
                sid = set_digest(hashes)
                sids.append(sid)
                sizes.append(len(hashes))
                # A set that a task has met needs no second prefix; what is forgotten is only dropped later.
                new = sid not in seen
                firsts.append(prefix(hashes, often, times, least).view(np.int64) if new else None)
                prints.append(fingerprint(hashes) if new else None)
                bits.append(parity(hashes) if new else None)
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "sid", "n", "fp", "bits", "tokens"],
            )

    p, q = least.numerator, least.denominator
    found = written(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, f"doc_id {kind}, digest long, sid long, n long, fp long, bits binary, tokens array<long>"))
    own = written(found.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bits").alias("bits")))

    # Pairs by fingerprints: of equal ones each set with the least, and the least sets of those that the trie join links.
    of_print = written(own.groupBy("fp").agg(F.min("sid").alias("hub"), F.count("*").alias("sets")))
    equal = own.join(of_print.where("sets > 1"), "fp").where("sid != hub").select(F.col("sid").alias("u"), F.col("hub").alias("v"))
    near = links(of_print.select("fp"), budget)
    near = near.join(of_print.select(F.col("fp").alias("u"), F.col("hub").alias("a")), "u").join(of_print.select(F.col("fp").alias("v"), F.col("hub").alias("b")), "v")
    by_print = equal.unionByName(near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))

    # What meets on the first shingles: entries without a partner by size and position go before they meet anything else.
    token = Window.partitionBy("token")
    posted = found.where("tokens is not null").select("sid", "n", F.posexplode("tokens").alias("at", "token"))
    met = posted.withColumn("one", F.min("sid").over(token)).withColumn("end", F.max("sid").over(token)).where("one < end")
    listed = written(met.select("token", "sid", "n", "at").dropDuplicates(["token", "sid"]))
    dropped(found)
    served = tiled(listed.withColumn("hot", F.lit(False)), list_rows).mapInArrow(viable(p, q), "token long, hot boolean, sid long, n long, at int")
    open_ = written(served.select("token", "sid", "n", "at").distinct())
    dropped(listed)

    # Each set with some sets of its lists, of lowest hashes: another one each round.
    hub = lambda turn: F.min_by(F.struct("sid", "n", "at"), F.struct(F.xxhash64("sid", F.lit(turn)), "sid"))
    hubs = open_.groupBy("token").agg(F.array_distinct(F.array(*[hub(turn) for turn in range(max(1, rounds))])).alias("hubs"))
    led = open_.join(hubs, "token").withColumn("hub", F.explode("hubs")).where(F.col("sid") != F.col("hub.sid"))
    rest = F.least(F.col("n") - F.col("at"), F.col("hub.n") - F.col("hub.at"))
    led = led.where(alike(p, q, rest, F.col("n"), F.col("hub.n"))).select(F.greatest("sid", "hub.sid").alias("u"), F.least("sid", "hub.sid").alias("v"))
    tested = written(possible(by_print.unionByName(led).distinct(), own, p, q))
    dropped(of_print)
    collected(spark)

    def row_key(id_col, digest):
        return [F.coalesce(id_col, F.lit(0)).alias("_id"), id_col.isNull().alias("_null"), digest.alias("_digest")]

    # The texts of sets that meet others, each once.
    needed = open_.select("sid").unionByName(tested.select(F.explode(F.array("u", "v")).alias("sid"))).distinct()
    needed = own.join(needed, "sid", "left_semi").select("sid", *row_key(F.col("first.doc_id"), F.col("first.digest")))
    texts = docs.select(*row_key(F.col("doc_id"), F.xxhash64("text")), "text").join(needed, ["_id", "_null", "_digest"]).select("sid", "text")
    texts = written(texts.groupBy("sid").agg(F.first("text").alias("text")))
    root = components(written(verified(tested, texts, least, shingle, seed)))

    for best_only in (True, False):
        rooted = open_.drop("root").join(root.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        rooted = rooted.withColumn("low", F.min("root").over(token)).withColumn("high", F.max("root").over(token)).where("low < high")
        before, open_ = open_, written(rooted.select("token", "sid", "n", "at", "root"))
        dropped(before)
        collected(spark)
        if open_.isEmpty():
            break
        entries = open_.join(own.select("sid", "bits"), "sid").select("*", F.lit(False).alias("hot"), *[F.lit(k).cast("long").alias(c) for c, k in (("hub", 0), ("overlap", -1), ("n_hub", 0))])
        pairs = tiled(entries, list_rows).select(*ENTRY).mapInArrow(met_pairs(p, q, best_only), "u long, v long, known long").select("u", "v")
        pairs = written(pairs.distinct().join(tested, ["u", "v"], "left_anti"))
        tested = tested.unionByName(pairs)
        more = written(verified(pairs, texts, least, shingle, seed))
        if not more.isEmpty():
            # The components so far are stars, which the new links join.
            root = components(written(root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)))

    stays = own.join(root, own.sid == root.node, "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))

    keys = written(stays.select(*row_key(F.col("first.doc_id"), F.col("first.digest"))))
    dropped(own, texts, open_)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_key(F.col("doc_id"), F.xxhash64("text")))
    once = rows.join(keys, ["_id", "_null", "_digest"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_null", "_digest").orderBy(F.lit(0)))).where("_n = 1")
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
