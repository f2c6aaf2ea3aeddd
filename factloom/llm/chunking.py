"""Document fingerprints: content-defined chunking.

A text's UTF-8 bytes are cut where a gear hash of the last 32 bytes meets a mask. The mask is normalised: it asks for more bits before a chunk
has its normal size and for fewer after, so sizes gather round it; no chunk is under the least or, the last one apart, over the most size.
Boundaries depend on nearby bytes only, so an insertion moves them along instead of changing them.

A fingerprint is the sorted set of the chunks' digests, each with its chunk's length. Likeness of A to B is the share of
A's distinct chunk bytes that B holds too (containment weighted by length).

Next documents: rows are dealt into ranges of descending id, each sorted in its task, where neighbours meet; a range's last row
then meets the next range's first in a join of two rows a range, so there is no global window.

Defined cases: null text is empty; an empty text has the empty fingerprint, which is like an empty text (1) and unlike any other (0);
repeated ids stand next to each other, in order of their text; a null id comes last; one row is its own next document; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short, shuffle_width, written

LEAST, NORMAL, MOST = 24, 96, 384
#: log2(NORMAL) is between 6 and 7: two bits more before the normal size, two fewer after.
HARD_BITS, EASY_BITS = 8, 5
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4")


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR of the last 32 bytes, each shifted by its distance: by doubling, in 5 steps."""
    h = GEAR[data]
    reach = 1
    while reach < 32:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def boundaries(data: bytes, least: int = LEAST, normal: int = NORMAL, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if not n:
        return []
    h = gear(np.frombuffer(data, np.uint8))
    easy = np.flatnonzero((h >> np.uint32(32 - EASY_BITS)) == 0)
    hard = easy[(h[easy] >> np.uint32(32 - HARD_BITS)) == 0].tolist()
    easy = easy.tolist()
    ends, at = [], 0
    while n - at > least:
        # A cut lies behind the byte that meets the mask.
        k = bisect.bisect_left(hard, at + least - 1)
        if k < len(hard) and hard[k] < at + normal - 1:
            end = hard[k] + 1
        else:
            k = bisect.bisect_left(easy, at + normal - 1)
            end = min(easy[k] + 1 if k < len(easy) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> dict[int, int]:
    """Digest (48 bits) -> length of the distinct chunks of a text."""
    out, at = {}, 0
    for end in boundaries(data):
        piece = data[at:end]
        out[xxhash.xxh3_64_intdigest(piece) >> 16] = end - at
        at = end
    return out


def fingerprint(found: dict[int, int]) -> str:
    """Eight bytes for each chunk, digest and length, in order of digest; base64."""
    values = np.array(sorted(d << 16 | n for d, n in found.items()), ">u8")
    return base64.b64encode(values.tobytes()).decode()


def parse(text: str) -> dict[int, int]:
    """The chunks of a fingerprint."""
    return {int(v) >> 16: int(v) & 0xFFFF for v in np.frombuffer(base64.b64decode(text), ">u8")}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes that b holds too."""
    if not a or not b:
        return 1.0 if len(a) == len(b) else 0.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in short(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(chunks(t or b"")) for t in texts], pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text, its last third (rounded down, in code points) replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


PAIR_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PAIR_NAMES = [x.split()[0] for x in PAIR_FIELDS.split(", ")]
PAIR_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in PAIR_FIELDS.split(", ")]


def pair(text: str, own: dict[int, int], following: str, its: dict[int, int]) -> tuple:
    """PAIR_FIELDS of a text and the one behind it."""
    changed = edited(text, following).encode()
    after = chunks(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), fingerprint(own), fingerprint(after), likeness(own, after), likeness(own, its)


INNER, FIRST, LAST = 0, 1, 2


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id and PAIR_FIELDS of each document (doc_id, text) and the next in descending doc_id; behind the last comes the first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = docs.select("doc_id", text.alias("text")).repartitionByRange(shuffle_width(docs.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())
    names = ["doc_id", "range", "role", "text", *PAIR_NAMES]
    schema = f"doc_id {kind}, range int, role int, text string, {PAIR_FIELDS}"

    def run(batches):
        before, id_type = None, None  # (id, range, text, chunks) of the row before
        for batch in short(batches):
            id_type = batch.schema.field(0).type
            ids, ranges, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for row in zip(ids, ranges, texts, strict=True):
                found = chunks(row[2].encode())
                if before is None:
                    rows.append((*row[:2], FIRST, row[2], *[None] * len(PAIR_NAMES)))
                else:
                    rows.append((*before[:2], INNER, None, *pair(before[2], before[3], row[2], found)))
                before = (*row, found)
            yield table_of(rows, id_type)
        if before is not None:
            yield table_of([(*before[:2], LAST, before[2], *[None] * len(PAIR_NAMES))], id_type)

    def table_of(rows, id_type):
        types = [id_type, pa.int32(), pa.int32(), pa.string(), *PAIR_TYPES]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows, strict=True)) or [[]] * len(types), types, strict=True)], names=names)

    # A range's first and last row come out as they are, with their texts: two rows a range, joined with the ranges beside it.
    found = written(ranged.select("doc_id", "text", "range").mapInArrow(run, schema))
    first = found.where(F.col("role") == FIRST)
    behind = first.select("range").withColumn("to", F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy())))
    following = first.join(behind, "range").select(F.col("to").alias("range"), F.col("text").alias("following"))
    ends = found.where(F.col("role") == LAST).select("doc_id", "range", "text").join(following, "range").select("doc_id", "text", "following")

    def close(batches):
        for batch in short(batches):
            rows = [pair(t, chunks(t.encode()), n, chunks(n.encode())) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            values = list(zip(*rows, strict=True)) or [[]] * len(PAIR_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(values, PAIR_TYPES, strict=True))], names=["doc_id", *PAIR_NAMES])

    return found.where(F.col("role") == INNER).select("doc_id", *PAIR_NAMES).unionByName(ends.mapInArrow(close, f"doc_id {kind}, {PAIR_FIELDS}"))
