"""N-gram Jaccard join with set-relation skipping: all links of texts whose sets of word shingles have a Jaccard similarity of `least` or more, as components.

Sets: XXH64 of a text's runs of `shingle` words, each once. Texts of equal sets are one set from then on (by a 64-bit digest of the sorted hashes and their number).

Index: in one order of all shingles, two sets that are alike enough share one of the first n - ceil(least * n) + 1 shingles of each (n: a set's size), and what follows the first shared one bounds their overlap.
So sets are listed under these shingles alone, each with its size and position there. The order, by how often the whole corpus holds the frequent ones, changes the cost only.

Skipping by position: the entries of a list are in blocks of one size and position, and two blocks are compared once: if they cannot give the similarity, all their pairs are skipped.
Skipping by answers: overlaps are computed with a leader first, the set that shares most lists, unless parity bitmaps rule the link out: so small an overlap answers nothing. Where sets are in one component, no pair of theirs is looked at again. For two sets x and y of different components with
a common leader h, their overlap is derived from the computed ones: at least o(x,h) + o(y,h) - |h| and at most min(o(x,h), o(y,h)) + min(|x| - o(x,h), |y| - o(y,h)). So it is a link, or none, without being computed.
What is still open is bounded by parity bitmaps (their differing bits are at most the sets' differing shingles), and only then compared in full: first the likeliest pair of two components in each list, then all.

A list with over `list_rows` sets is cut in blocks by a hash, which meet in pairs, so no frequent shingle and no group of copies burdens one task; pairs that are skipped are never rows.

Defined cases: a text without words (null and empty too) has the empty set and is linked with nothing; a text with fewer words than a shingle has one, all its words; repeated rows are separate documents;
a null id counts as larger than any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted_join, dropped, short, written
from .copies import prefix, set_digest, shingle_sets
from .lists import ENTRY, alike, differing, met_pairs, of_token, pairs_of, parity, possible, tiled, viable  # noqa: F401
from .simhash import components


def counted(tokens: np.ndarray, counts: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal tokens added up; of those only the `keep` largest counts, if there are more."""
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    tokens, counts = tokens[begins], np.add.reduceat(counts, begins) if len(begins) else counts
    if len(tokens) > keep:
        few = np.sort(np.argpartition(counts, len(counts) - keep)[-keep:])
        tokens, counts = tokens[few], counts[few]
    return tokens, counts


def frequent(docs: DataFrame, shingle: int, seed: int, keep: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of the whole corpus hold, sorted, and about how many hold them: at most `keep`. Each task counts what it reads in a summary of bounded size."""

    def run(batches):
        tokens, counts, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged():
            fresh = np.sort(np.concatenate(new)) if new else np.zeros(0, np.uint64)
            begins = np.flatnonzero(np.concatenate([[True], fresh[1:] != fresh[:-1]])) if len(fresh) else np.zeros(0, np.int64)
            many = np.diff(np.append(begins, len(fresh)))
            again = many > 1  # what a thousand texts or so hold once is not frequent
            return counted(np.concatenate([tokens, fresh[begins[again]]]), np.concatenate([counts, many[again]]), 4 * keep)

        for batch in short(batches):
            new += shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), shingle, seed)
            if sum(map(len, new)) > 8 * keep:
                (tokens, counts), new = merged(), []
        tokens, counts = merged()
        often = counts > 2
        tokens, counts = counted(tokens[often], counts[often], keep)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(keep).toArrow()
    often, times = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(often)
    return often[order], times[order]


def perhaps(rows: DataFrame, named: DataFrame, words: int = 1 << 18) -> DataFrame:
    """The rows whose sid is among the named ones, and some others: those that share a bit of 64 * words, which sids, as hashes, fall in evenly. What is broadcast is bounded by `words`, and no row is moved."""
    word, bit = F.shiftright("sid", 6).bitwiseAND(F.lit(words - 1)), F.expr("shiftleft(1L, cast(sid & 63 as int))")
    seen = named.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("seen"))
    return rows.withColumn("word", word).join(F.broadcast(seen), "word").where(bit.bitwiseAND(F.col("seen")) != 0).select(rows.columns)


def overlaps(pairs: DataFrame, members: DataFrame, shingle: int, seed: int) -> DataFrame:
    """u, v and their overlap, as a written table. members: sid, text, each sid once. Texts are not moved: only the sets that the pairs name (and the few that `perhaps` takes for such) are made where their texts lie."""

    def made(batches):
        for batch in short(batches):
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "tokens"])

    def compared(batches):
        for batch in short(batches, 64):
            found = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                found.append(int((b[at] == a).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["u", "v", "overlap"])

    pairs = written(pairs.select("u", "v"))
    sets = written(perhaps(members.select("sid", "text"), pairs.select(F.explode(F.array("u", "v")).alias("sid"))).mapInArrow(made, "sid long, tokens binary"))
    side = lambda name: sets.select(F.col("sid").alias(name), F.col("tokens").alias(f"t_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "t_u", "t_v")
    out = written(both.mapInArrow(compared, "u long, v long, overlap long"))
    dropped(pairs, sets)
    return out


def link_components(docs: DataFrame, least: Fraction = Fraction(85, 100), shingle: int = 4, seed: int = 42, rounds: int = 2, list_rows: int = 1024) -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id (the smallest doc_id that links reach, itself included) of each document."""
    spark = docs.sparkSession
    p, q = least.numerator, least.denominator
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared_order = spark.sparkContext.broadcast(frequent(docs, shingle, seed))

    def run(batches):
        often, times = shared_order.value
        seen = set()
        for batch in short(batches):
            sids, sizes, firsts, hots = [], [], [], []
            for hashes in shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), shingle, seed):
                sid = set_digest(hashes) if len(hashes) else None
                sids.append(sid)
                sizes.append(len(hashes))
                # A set that a task has met needs no second entry; what is forgotten is only dropped later.
                new = sid is not None and sid not in seen
                first = prefix(hashes, often, times, least) if new else None
                firsts.append(first.view(np.int64) if new else None)
                hots.append(int((often[np.minimum(np.searchsorted(often, first), len(often) - 1)] == first).sum()) if new and len(often) else 0)
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hots, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "sid", "n", "hots", "tokens"],
            )

    found = written(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, f"doc_id {kind}, digest long, sid long, n long, hots int, tokens array<long>"))
    # In the common order frequent shingles come last, so the last `hots` of a prefix are the hot ones.
    posted = found.where("tokens is not null").select("sid", "n", (F.size("tokens") - F.col("hots")).alias("hot_from"), F.posexplode("tokens").alias("at", "token"))
    posted = posted.select("token", (F.col("at") >= F.col("hot_from")).alias("hot"), "sid", "n", "at")
    met = of_token(posted, one=F.min("sid"), end=F.max("sid")).where("one < end").drop("one", "end")
    # Written before it is cut in blocks: that reads it three times, and no filter passes a window, so each time would shuffle all prefixes.
    listed = written(met.dropDuplicates(["token", "sid"]))
    met = written(tiled(listed, list_rows).mapInArrow(viable(p, q), "token long, hot boolean, sid long, n long, at int").distinct())
    dropped(listed)

    own = written(found.where("sid is not null").groupBy("sid").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")))
    docs_of = written(found.select("doc_id", F.col("n").alias("n_shingles"), "sid"))
    dropped(found)
    members = written(member_texts(docs, own.join(met.select("sid").distinct(), "sid", "left_semi"), shingle, seed))

    known = spark.createDataFrame([], "u long, v long, overlap long")
    tested, root = known, spark.createDataFrame([], "node long, root long")
    size = members.select(F.col("sid").alias("v"), F.col("n").alias("n_hub"))
    open_ = met
    linked = lambda o: o.where(alike(p, q, F.col("overlap"), F.col("n"), F.col("n_hub")))
    sized = lambda o: o.join(members.select(F.col("sid").alias("u"), "n"), "u").join(size, "v")
    links = None
    for turn in range(rounds + 2):
        rooted = open_.drop("root").join(root.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        rooted = of_token(rooted.select("token", "hot", "sid", "n", "at", "root"), low=F.min("root"), high=F.max("root")).where("low < high").drop("low", "high")
        before, open_ = open_, written(rooted)
        dropped(before)
        if open_.isEmpty():
            break
        if turn < rounds:
            led = leaders(open_, turn, p, q).join(tested.select("u", "v"), ["u", "v"], "left_anti")
            new = overlaps(possible(led, members, p, q), members, shingle, seed)
            tested = tested.unionByName(new)
            more = linked(sized(new)).select("u", "v")
        else:
            # Of the leaders that a set was compared with, the one of greatest overlap.
            led = sized(tested)
            led = led.select(F.col("u").alias("sid"), F.col("v").alias("hub"), "overlap", "n_hub").unionByName(led.select(F.col("v").alias("sid"), F.col("v").alias("hub"), F.col("n_hub").alias("overlap"), "n_hub"))
            led = led.groupBy("sid").agg(F.max(F.struct("overlap", "hub", "n_hub")).alias("led")).select("sid", "led.*")
            entries = open_.join(members.select("sid", "bits"), "sid").join(led, "sid", "left").fillna({"hub": 0, "overlap": -1, "n_hub": 0})
            pairs = written(tiled(entries, list_rows).select(*ENTRY).mapInArrow(met_pairs(p, q, turn == rounds), "u long, v long, known long").groupBy("u", "v").agg(F.max("known").alias("known")))
            new = overlaps(pairs.where("known = 0").join(tested.select("u", "v"), ["u", "v"], "left_anti"), members, shingle, seed)
            more = linked(sized(new)).select("u", "v").unionByName(pairs.where("known = 1").select("u", "v"))
        links = written(more if links is None else links.unionByName(more))
        root = components(links)
    dropped(open_, members)

    rooted = own.join(root, own.sid == root.node, "left").select("sid", "n", "least", F.coalesce("root", "sid").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    one = written(rooted.join(of_root, "root").select("sid", "n", "component_id"))
    alone = docs_of.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return counted_join(docs_of.where("sid is not null"), one, ["sid"], docs_of.count()).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def member_texts(docs: DataFrame, needed: DataFrame, shingle: int, seed: int) -> DataFrame:
    """sid, n, bits (the parity bitmap) and text of the sets that are listed with others. needed: sid and the row (`first`) that has it."""
    keys = ["_id", "_null", "_digest"]
    key = lambda id_col, digest: [F.coalesce(id_col, F.lit(0)).alias("_id"), id_col.isNull().alias("_null"), digest.alias("_digest")]
    needed = needed.select("sid", *key(F.col("first.doc_id"), F.col("first.digest")))
    texts = docs.select(*key(F.col("doc_id"), F.xxhash64("text")), "text").join(needed, keys).dropDuplicates(keys).select("sid", "text")

    def run(batches):
        for batch in short(batches):
            sets = list(shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), shingle, seed))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "n", "bits", "text"])

    return texts.mapInArrow(run, "sid long, n long, bits binary, text string")


def leaders(open_: DataFrame, turn: int, p: int, q: int) -> DataFrame:
    """u, v: each set with one leader, that of most of its lists. A list's leader is the set of lowest hash, another one each turn."""
    hub = F.min_by(F.struct("sid", "n", "at", "root"), F.struct(F.xxhash64("sid", F.lit(turn)), "sid"))
    with_hub = of_token(open_, hub=hub).where(F.col("root") != F.col("hub.root"))
    rest = F.least(F.col("n") - F.col("at"), F.col("hub.n") - F.col("hub.at"))
    pairs = with_hub.where(alike(p, q, rest, F.col("n"), F.col("hub.n"))).groupBy("sid", F.col("hub.sid").alias("hub")).agg(F.count("*").alias("lists"))
    best = pairs.groupBy("sid").agg(F.max(F.struct("lists", "hub")).alias("best"))
    return best.select(F.col("sid").alias("u"), F.col("best.hub").alias("v"))
