import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import packing
from factloom.llm.queries import tokenizer_file

from .texts import AWKWARD, documents


def test_pieces_cover_each_id_once(spark):
    tokenizer = Tokenizer.from_file(tokenizer_file())
    docs = documents(spark, [*AWKWARD, AWKWARD[5]])
    pieces = packing.pack(docs, tokenizer_file(), max_tokens=1024)
    rows = sorted(packing.digests(pieces).collect(), key=lambda r: (r.doc_id, r.start))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate([*AWKWARD, AWKWARD[5]]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in by_doc[k]:
            assert r.start == at and r.doc_tokens == len(ids) and r.offset == 0
            assert r.length & (r.length - 1) == 0 and r.length <= 1024 and 1 << r.bucket == r.length
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.bucket for r in order] == sorted(r.bucket for r in rows)


def test_repeated_rows_and_empty(spark):
    docs = documents(spark, ["one two three"])
    rows = packing.pack(docs.union(docs), tokenizer_file()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 2 * len(packing.pack(docs, tokenizer_file()).collect())
    assert packing.pack(documents(spark, []), tokenizer_file()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sSÉé\u0301Σσ \t\n\x0b\u00a0\u2003\x1c12<|endoftxstar>!?🙂ß\u0130.,ABKZ\u212a")))
def test_words_apart_equal_the_whole(text):
    whole = Tokenizer.from_file(tokenizer_file()) if not hasattr(test_words_apart_equal_the_whole, "t") else test_words_apart_equal_the_whole.t
    ids_of = getattr(test_words_apart_equal_the_whole, "i", None) or packing.token_ids(tokenizer_file())
    test_words_apart_equal_the_whole.t, test_words_apart_equal_the_whole.i = whole, ids_of
    ids = whole.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_piece_lengths():
    assert packing.piece_lengths(1, 4096) == [1]
    assert packing.piece_lengths(4096 * 2 + 13, 4096) == [4096, 4096, 8, 4, 1]
