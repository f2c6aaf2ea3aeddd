"""Packing: power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are the powers of two in the binary form of their number,
longest first, with as many pieces of `max_tokens` as fit before. A piece is a sequence of its own: no sequence crosses
documents, equal lengths share a bucket, and a sequence of a power of two needs no padding. Cutting needs no shuffle.

Sequence ids run bucket by bucket: the bucket in the top bits, below it the row's place in its partition of the input.

Defined cases: null or empty text has only the end token, so one piece of length 1; repeated rows are separate
documents with sequences of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, short


def piece_lengths(n: int, most: int) -> list[int]:
    """n as whole pieces of `most` (a power of two), then the powers of two in the binary form of the rest, falling."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if n % most >> b & 1]


#: A full stop or comma between an ASCII letter or digit and white space: always a token of its own.
CLOSING = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \t-\r]|$)")


@lru_cache(maxsize=2)
def token_ids(tokenizer_path: str):
    """text -> its ids as little-endian unsigned 32-bit numbers. Words between ASCII white space are encoded apart and remembered, once in each Python worker.

    So that fewer words are to be remembered, A-Z are lower-cased before (the tokenizer would do it after) and closing marks cut off;
    texts that may hold the tokenizer's special tokens are left as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)

    def encode(word: bytes) -> bytes:
        ids = tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    memo = Memo(encode, 600_000)

    def ids_of(text: str | None) -> bytes:
        data = (text or "").encode()
        if b"<|" not in data:
            data = CLOSING.sub(rb" \1", data.lower())
        return b"".join(map(memo.__getitem__, data.split()))

    return ids_of


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: id, start, length, ids (binary), doc_tokens, bucket (log2 of length), sequence_id, offset.

    The tokenizer must drop white space and treat the words between it apart, as word_bpe_49k does.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    end = struct.pack("<I", end_id)
    kind = docs.schema[id_col].dataType.simpleString()
    limit = 8 << 20

    def run(batches):
        ids_of = token_ids(tokenizer_path)
        for batch in short(batches):
            rows, starts, lengths, ids, totals, held = [], [], [], [], [], 0

            def out():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                    names=[id_col, "start", "length", "ids", "doc_tokens"],
                )

            for k, text in enumerate(batch.column(1)):
                data = ids_of(text.as_py()) + end
                n, at = len(data) // 4, 0
                for m in piece_lengths(n, max_tokens):
                    rows.append(k)
                    starts.append(at)
                    lengths.append(m)
                    ids.append(data[4 * at : 4 * (at + m)])
                    totals.append(n)
                    at += m
                held += len(data)
                if held > limit:
                    yield out()
                    rows, starts, lengths, ids, totals, held = [], [], [], [], [], 0
            yield out()

    pieces = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2("length").cast("int")
    # 33 bits of row, 25 of partition, 4 of bucket.
    return pieces.withColumns(
        {"bucket": bucket, "sequence_id": F.shiftleft(bucket.cast("long"), 58) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the ids' CRC-32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
