"""Toxicity: nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Terms: the runs of letters of a text, lower-cased, and the first `STEM` letters of the longer ones, so that other endings of a word still meet.

Fitting: the examples are the labelled documents that are not held out, up to `sample` of them and `most_chars` characters in all (those whose texts have the least hashes; both
are parameters, and what the driver holds and broadcasts is bounded by them). Equal term sets of one label count once. All terms of the examples
count: a term weighs log(documents / documents with it), counted over all documents, times its label contrast. That is how far (as Kullback-Leibler divergence) the share of
toxic examples among those with the term, drawn to the whole share by `shrink` examples, lies from the whole share, plus `floor`; no term is left out, and the contrast does not grow with the sample.

Scoring: a whole text's vector is compared with the examples by cosine. The index keeps, for each term, its examples in blocks of 64 and each block's largest weight.
The blocks of highest bound are compared first; blocks whose bound is below the k-th cosine then cannot hold a nearer example and are left out (a text in which no term stands out leaves
almost none out, so its lists are added up at once), so the `k` nearest are exact; all that tie with the last of them vote too.
Votes are weighted by 1 / (distance + 0.1) and mixed with `prior_votes` votes at the base rate; a text without any of the terms has the share of toxic examples among those without any.
Last, a rising curve (isotonic regression) maps this share to a probability: it is fitted to the examples' own shares, each quarter of them voted on by an index of the others. The nearest examples are the evidence.

Ids are never inputs of a score, except that they say which rows are held out; scores do not depend on the partitions of the tables.

Defined cases: null text is empty, and an empty text has a score like any text without terms; repeated rows are scored
each; labels without id or label, and of no document, do not matter; ids must be numbers or their text (others end in a cast error); a text over the characters that are left is no example, the others stay; of a document labelled twice the higher label counts; of rows with one id and several texts the text of
least hash is the example; without any usable label every score is 0; an empty table gives no rows; further columns are passed through, but for the names of the result's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, short, written

TERM = re.compile(r"[^\W\d_]+")
BLOCK = 64
FOLDS = 5
STEM = 4
#: The weight in a unit vector from which a term stands out. It changes the cost of a search, not its result: bounds of blocks, which are worked out from it on,
#: leave most blocks out for a third of the texts with a weight of 0.7 and for hardly any below.
LEAD = 0.7


#: Of the ASCII characters only letters are part of terms.
ASCII_TERMS = {c: chr(c).lower() if chr(c).isalpha() else " " for c in range(128)}


def terms_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    text = text or ""
    if text.isascii():
        return text.translate(ASCII_TERMS).split()
    found: list[str] = []
    for word in text.lower().split():
        if word.isalpha():
            found.append(word)
        else:
            found += TERM.findall(word)
    return found


def counted(text: str | None) -> Counter:
    """How often a text has each term: its words, and the stems of its longer words (marked by a star)."""
    words = Counter(terms_of(text))
    stems: Counter = Counter()
    for word, n in words.items():
        if len(word) > STEM:
            stems[word[:STEM] + "*"] += n
    words.update(stems)
    return words


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def family(terms) -> bytes:
    """What texts of the same terms share, and no others: a 128-bit digest of the sorted terms."""
    return xxhash.xxh3_128_digest(" ".join(sorted(terms)))


def contrast(n: np.ndarray, toxic: np.ndarray, base: float, shrink: float = 8, floor: float = 0.01) -> np.ndarray:
    """The label contrast of terms that n examples have, `toxic` of them toxic."""
    if not 0 < base < 1:
        return np.full(len(n), floor)
    share = (toxic + shrink * base) / (n + shrink)
    return share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)) + floor


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges low..high-1, one range after the other."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


class Index:
    """Examples with the weight of each term. examples: (sorted term numbers, counts, label, id), in an order of their own."""

    def __init__(self, weights: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, int, int]], base: float, k: int, prior_votes: float):
        self.weights, self.base, self.k, self.prior_votes, self.curve = weights, base, k, prior_votes, None
        bare = [label for terms, _, label, _ in examples if not len(terms)]
        self.bare = (sum(bare) + prior_votes * base) / (len(bare) + prior_votes) if examples else 0.0
        vectors = [(*self.vector(terms, counts), label, doc_id) for terms, counts, label, doc_id in examples if len(terms)]
        # Examples with the same heaviest term stand together, so that few blocks have high bounds for it.
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        vectors = [vectors[i] for i in order]
        self.labels = np.array([v[2] for v in vectors], np.float64)
        self.ids = [v[3] for v in vectors]
        self.blocks = -(-len(vectors) // BLOCK)
        terms = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[0]) for v in vectors])
        posting = np.lexsort((owner, terms))
        self.owner = owner[posting]
        self.weight = (np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0))[posting].astype(np.float32)
        # A cell is a term in a block: its postings, and the largest weight of them.
        cell = terms[posting] * max(self.blocks, 1) + self.owner // BLOCK
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.posted = np.append(start, len(cell)).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.weight, start) if len(start) else np.empty(0, np.float32)
        self.cell_block = (cell[start] % max(self.blocks, 1)).astype(np.int32)
        self.cells = np.searchsorted(cell[start] // max(self.blocks, 1), np.arange(len(weights) + 1)).astype(np.int32)
        # The lists of the terms that over a sixteenth of the examples have, written out in full: row 0 is for all others.
        often = np.flatnonzero(np.diff(self.posted[self.cells]) * 16 > max(len(vectors), BLOCK))
        self.row = np.zeros(len(weights), np.int32)
        self.row[often] = np.arange(1, len(often) + 1)
        self.full = np.zeros((len(often) + 1, len(vectors)), np.float32)
        for row, t in enumerate(often.tolist(), 1):
            low, high = self.posted[self.cells[t]], self.posted[self.cells[t + 1]]
            self.full[row, self.owner[low:high]] = self.weight[low:high]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length weights."""
        weights = (1 + np.log(counts)) * self.weights[terms]
        return terms, weights / math.sqrt(weights @ weights)

    def nearest(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the k nearest with a cosine over 0, and of those that tie with the last, nearest first.

        A text with terms that stand out has few blocks that matter: the two most promising ones give a first k-th cosine, and blocks whose bound is below it are left out.
        Where no term stands out, or few blocks can be left out, whole lists are added up instead.
        """
        terms, weights = self.vector(terms, counts)
        cosine = self.by_blocks(terms, weights) if weights.max() >= LEAD else None
        if cosine is None:
            cosine = self.by_lists(terms, weights)
        found = np.flatnonzero((cosine > 0) & (cosine >= self.kth(cosine) - 1e-12))
        found = found[np.lexsort((found, -cosine[found]))]
        return found, cosine[found]

    def by_blocks(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
        """Cosines of the examples in all blocks that can hold one of the nearest; None if these are over a quarter."""
        low, high = self.cells[terms].astype(np.int64), self.cells[terms + 1].astype(np.int64)
        cells, weight = spans(low, high), np.repeat(weights, high - low)
        block = self.cell_block[cells]
        bound = np.bincount(block, weight * self.cell_most[cells], self.blocks)

        def within(chosen: np.ndarray) -> np.ndarray:
            mine = np.flatnonzero(chosen[block])
            low, high = self.posted[cells[mine]].astype(np.int64), self.posted[cells[mine] + 1].astype(np.int64)
            at = spans(low, high)
            return np.bincount(self.owner[at], np.repeat(weight[mine], high - low) * self.weight[at], len(self.ids))

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[:2]] = True
        alive = (bound > 0) & (bound >= self.kth(within(first)) - 1e-9)
        return within(alive) if alive.sum() * 4 <= self.blocks else None

    def by_lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of all examples."""
        row = self.row[terms]
        few = np.flatnonzero(row == 0)
        low, high = self.posted[self.cells[terms[few]]].astype(np.int64), self.posted[self.cells[terms[few] + 1]].astype(np.int64)
        at = spans(low, high)
        cosine = np.bincount(self.owner[at], np.repeat(weights[few], high - low) * self.weight[at], len(self.ids))
        return cosine + np.einsum("i,ij->j", weights[row > 0].astype(np.float32), self.full[row[row > 0]])

    def kth(self, cosine: np.ndarray) -> float:
        """The k-th largest, 0 if there are fewer."""
        return float(np.partition(cosine, -self.k)[-self.k]) if len(cosine) >= self.k else 0.0

    def share(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        """The weighted share of toxic votes and the evidence: (id, cosine, label) of the three nearest."""
        found, cosine = self.nearest(terms, counts) if len(terms) and self.blocks else (np.empty(0, np.int64), np.empty(0))
        if not len(found):
            return self.bare, []
        votes = 1 / (np.maximum(0, 1 - cosine) + 0.1)
        toxic = float(votes @ self.labels[found]) + self.prior_votes * self.base
        evidence = [(self.ids[f], float(c), int(self.labels[f])) for f, c in zip(found[:3].tolist(), cosine[:3], strict=True)]
        return toxic / (float(votes.sum()) + self.prior_votes), evidence

    def probability(self, share: float) -> float:
        """The share of votes on the calibrated scale."""
        return float(np.interp(share, *self.curve)) if self.curve else share

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        share, evidence = self.share(terms, counts)
        return self.probability(share), evidence


def build(idf: np.ndarray, examples: list, shrink: float, floor: float, k: int, prior_votes: float) -> Index:
    """The index of some examples, with the label contrasts that they show."""
    labels = np.array([e[2] for e in examples], np.float64)
    base = float(labels.mean()) if len(labels) else 0.0
    terms = np.concatenate([e[0] for e in examples]) if examples else np.empty(0, np.int64)
    n = np.bincount(terms, minlength=len(idf))
    toxic = np.bincount(terms, np.repeat(labels, [len(e[0]) for e in examples]) if examples else None, minlength=len(idf))
    return Index(idf * contrast(n, toxic, base, shrink, floor), examples, base, k, prior_votes)


def rising(shares: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve from shares to probabilities: isotonic regression over bins of 4 to 32 neighbouring shares (equal ones together), each step's share of labels drawn to the whole by one vote."""
    order = np.argsort(shares, kind="stable")
    x, y = shares[order], labels[order].astype(np.float64)
    starts = np.unique(np.searchsorted(x, x[:: max(4, min(32, len(x) // 40))], side="left"))
    steps: list[list[float]] = []  # labels, rows, shares of each step
    for row in zip(np.add.reduceat(y, starts).tolist(), np.diff(np.append(starts, len(x))).tolist(), np.add.reduceat(x, starts).tolist(), strict=True):
        steps.append(list(row))
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            steps[-2:] = [[a + b for a, b in zip(*steps[-2:], strict=True)]]
    base = float(y.mean())
    return np.array([s / n for _, n, s in steps]), np.maximum.accumulate([(t + base) / (n + 1) for t, n, _ in steps])


class Terms:
    """The numbers of the known terms, words and stems apart."""

    def __init__(self, terms: list[str]):
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}
        self.numbers = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.count = len(terms)

    def code(self, word: str) -> int:
        """A word's own number and its stem's in one, each plus 1; 0 for an unknown one."""
        return (self.numbers.get(word, -1) + 1) << 32 | (self.stems.get(word[:STEM], -1) + 1 if len(word) > STEM else 0)

    @cached_property
    def codes(self) -> Memo:
        return Memo(self.code)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text, sorted, and their counts."""
        words = Counter(terms_of(text))
        code, n = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))
        both, n = np.concatenate([code >> 32, code & 0xFFFFFFFF]), np.tile(n, 2)
        terms, place = np.unique(both[both > 0] - 1, return_inverse=True)
        return terms, np.bincount(place, n[both > 0], len(terms)).astype(np.int64)

    def distinct(self, text: str | None) -> np.ndarray:
        """The known terms of a text, each once."""
        words = set(terms_of(text))
        code = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        both = np.unique(np.concatenate([code >> 32, code & 0xFFFFFFFF]))
        return both[both > 0] - 1


def examples_of(docs: DataFrame, labels: DataFrame, sample: int, most_chars: int) -> DataFrame:
    """(digest, doc_id, toxic, text) of the labelled rows that are examples, one row an id."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    own = own.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("digest", "chars")).alias("own")).select("own.digest", "doc_id", "toxic", "own.chars")
    # `sample` short rows at most, so they may be gathered and broadcast.
    short_rows = own.orderBy("digest", "doc_id").limit(sample).toArrow()
    inside, room = [], most_chars
    for i, chars in enumerate(short_rows["chars"].to_pylist()):  # a text that no longer fits is passed over, the others stay
        if chars <= room:
            inside.append(i)
            room -= chars
    picked = docs.sparkSession.createDataFrame(short_rows.take(pa.array(inside, pa.int64())).drop_columns(["chars"])) if inside else own.limit(0).drop("chars")
    texts = docs.select(F.xxhash64("text").alias("digest"), "doc_id", "text").join(F.broadcast(picked), ["digest", "doc_id"])
    return texts.dropDuplicates(["digest", "doc_id"]).select("digest", "doc_id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, most_chars: int = 32 << 20, k: int = 15, prior_votes: float = 1, shrink: float = 8, floor: float = 0.01) -> tuple[list[str], Index]:
    """The terms, in order of their numbers, and the index. labels: doc_id, toxic (0 or 1)."""
    rows = examples_of(docs.select("doc_id", "text"), labels, sample, most_chars)

    def count(batches):
        for batch in short(batches):
            found = [sorted(counted(text).items()) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([family(t for t, _ in f) for f in found], pa.binary()), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))],
                names=["digest", "doc_id", "toxic", "family", "terms", "counts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    vectors = rows.mapInArrow(count, f"digest long, doc_id {kind}, toxic int, family binary, terms array<string>, counts array<int>")
    # `sample` examples of `most_chars` characters together, at most.
    held = vectors.select("digest", F.col("doc_id").cast("long").alias("doc_id"), "toxic", "family", "terms", "counts").toArrow().sort_by([("digest", "ascending"), ("doc_id", "ascending")])
    single, taken = {}, []
    for i, key in enumerate(zip(held["family"].to_pylist(), held["toxic"].to_pylist(), strict=True)):
        if single.setdefault(key, i) == i:  # copies count once for each label
            taken.append(i)
    held = held.take(pa.array(taken, pa.int64()))
    toxic = held["toxic"].to_numpy()
    base = float(toxic.mean()) if len(toxic) else 0.0
    listed = held["terms"].combine_chunks()
    coded = listed.flatten().dictionary_encode() if len(taken) else pa.array([], pa.string()).dictionary_encode()
    terms = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64)
    lengths = np.diff(listed.offsets.to_numpy()) if len(taken) else np.empty(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms))

    def frequencies(batches):
        known, of, total = shared.value, np.zeros(shared.value.count, np.int64), 0
        for batch in short(batches):
            for text in batch.column(0).to_pylist():
                of[known.distinct(text)] += 1
                total += 1
        seen = np.flatnonzero(of)
        for at in range(0, len(seen) + 1, 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(part, -1), pa.int32()), pa.array(np.append(of[part], total if at == 0 else 0))], names=["number", "n"])

    # One row a term at most.
    frequent = docs.select("text").mapInArrow(frequencies, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    df = np.zeros(len(terms) + 1, np.int64)
    df[frequent["number"].to_numpy()] = frequent["n"].to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    cuts, counts = np.append(0, np.cumsum(lengths)), held["counts"].combine_chunks().flatten().to_numpy() if len(taken) else np.empty(0, np.int64)
    examples = []
    for i, (label, doc_id) in enumerate(zip(toxic.tolist(), held["doc_id"].to_pylist(), strict=True)):
        mine = codes[cuts[i] : cuts[i + 1]]
        order = np.argsort(mine)
        examples.append((mine[order], counts[cuts[i] : cuts[i + 1]][order].astype(np.int64), label, doc_id))
    how = (shrink, floor, k, prior_votes)
    index = build(idf, examples, *how)
    calibrate(docs.sparkSession, index, idf, examples, how)
    return terms, index


def calibrate(spark, index: Index, idf: np.ndarray, examples: list, how: tuple, parts: int = 4) -> None:
    """Sets the index's curve: each part of the examples is voted on by an index of the others, as new texts are."""
    shared = spark.sparkContext.broadcast((idf, examples))

    def run(batches):
        idf, every = shared.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                others = build(idf, [e for i, e in enumerate(every) if i % parts != part], *how)
                known = np.diff(others.cells) > 0
                mine = [(e[0][known[e[0]]], e[1][known[e[0]]], e[2]) for e in every[part::parts]]
                yield pa.RecordBatch.from_arrays([pa.array([others.share(t, n)[0] for t, n, _ in mine], pa.float64()), pa.array([y for *_, y in mine], pa.int32())], names=["share", "toxic"])

    # Two numbers an example.
    rows = spark.range(0, parts, 1, parts).mapInArrow(run, "share double, toxic int").toArrow().sort_by([("share", "ascending"), ("toxic", "ascending")])
    shared.destroy()
    if rows.num_rows:
        index.curve = rising(rows["share"].to_numpy(), rows["toxic"].to_numpy())


RESULT = ("score", "predicted", "evidence")


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """docs with score, predicted (1 from the threshold on) and evidence (the nearest examples' ids, cosines and labels)."""
    terms, index = fit(docs, labels, **how)
    shared = docs.sparkSession.sparkContext.broadcast((Terms(terms), index))
    kept = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(F.struct(*kept).alias("row"), "text")

    def run(batches):
        known, at = shared.value
        seen = Memo(lambda text: at.score(*known.of(text)), 2_000)
        for batch in short(batches):
            found = [seen[text] for text in batch.column(1).to_pylist()]
            scores = [f[0] for f in found]
            evidence = [[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in f[1]] for f in found]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(evidence, kind)], names=["row", *RESULT])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *RESULT)
