import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import tiff

from .texts import AWKWARD, documents


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=20).map(lambda x: b"".join(bytes([a]) * n for a, n in x))))
def test_codecs_round_trip(data):
    for codec, pack in tiff.PACK.items():
        assert tiff.UNPACK[codec](pack(data)) == data


def test_lzw_over_full_tables():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"ab" * 9000
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


@pytest.mark.parametrize("codec", list(tiff.PACK))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(spark, codec, predictor, tile):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 9, shape).astype(np.uint8) for shape in ((70, 50), (1, 1), (33, 64))]
    files = spark.createDataFrame([(7, tiff.encode(images, codec, predictor, rows=20, tile=tile), 1)], "doc_id long, content binary, page int")
    rows = sorted(tiff.pages(files).collect(), key=lambda r: r.page)
    assert [(r.doc_id, r.page, r.height, r.width, r.error) for r in rows] == [(7, k, *i.shape, None) for k, i in enumerate(images)]
    assert [bytes(r.samples) for r in rows] == [i.tobytes() for i in images]
    (nested,) = tiff.pages(files, nested=True).collect()
    assert [bytes(p.samples) for p in nested.pages] == [i.tobytes() for i in images]


def test_damaged_files_keep_their_row(spark):
    good = tiff.encode([np.zeros((5, 5), np.uint8)] * 2)
    short = bytearray(tiff.encode([np.arange(100, dtype=np.uint8).reshape(10, 10)], tiff.STORED, 1))
    loop = bytearray(good)
    at = int.from_bytes(loop[4:8], "little")
    n = int.from_bytes(loop[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = at.to_bytes(4, "little")
    files = [None, b"", b"II*\0", b"junk" * 9, good[:-30], bytes(loop), bytes(short[:40])]
    rows = tiff.pages(spark.createDataFrame(list(enumerate(files)), "doc_id long, content binary")).collect()
    assert {r.doc_id for r in rows} == set(range(len(files)))
    assert {r.doc_id for r in rows if r.error} >= {0, 1, 2, 3, 5}
    assert tiff.pages(spark.createDataFrame([], "doc_id long, content binary")).count() == 0


def test_big_endian_16_bit_page():
    import struct

    pixels = np.array([[1, 300], [65535, 2]], ">u2")
    fields = [(256, 2), (257, 2), (258, 16), (259, 1), (273, 8), (277, 1), (278, 2), (279, 8)]
    data = b"MM" + struct.pack(">HI", 42, 16) + pixels.tobytes() + struct.pack(">H", len(fields))
    for tag, v in fields:
        data += struct.pack(">HHI", tag, 3, 1) + struct.pack(">HH", v, 0)
    (page,) = tiff.decode(data + b"\0\0\0\0")
    assert np.frombuffer(page[8], "<u2").tolist() == [1, 300, 65535, 2]


def test_foreign_lzw_and_packbits():
    """Worked by hand from the format's text: its PackBits example; LZW codes written bit by bit, with a code for the string just being made, and with tables that no clear ends."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")

    def written(codes):
        out, entries, first = "", 258, True
        for code in codes:
            width = 9 if entries < 511 else 10 if entries < 1023 else 11 if entries < 2047 else 12
            out += format(code, f"0{width}b")
            if code == 256:
                entries, first = 258, True
            elif first:
                first = False
            else:
                entries += 1
        out += "0" * (-len(out) % 8)
        return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8))

    assert tiff.unpack_lzw(written([256, 7, 258, 8, 8, 258, 6, 6, 257])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unpack_lzw(written([256, 65, 258, 259, 260, 257])) == b"A" * 10
    assert tiff.unpack_lzw(written([256, 1, 2, 256, 256, 3, 257, 99])) == bytes([1, 2, 3])
    plain = [k % 251 for k in range(6000)]
    assert tiff.unpack_lzw(written([256, *plain, 257])) == bytes(plain)
    with pytest.raises(ValueError):
        tiff.unpack_lzw(written([256, 7, 300, 257]))


def directory(fields, body=b""):
    """A little-endian file of one directory: fields (tag, kind, count, value), the body behind it."""
    out = b"II*\0\x08\0\0\0" + struct.pack("<H", len(fields))
    for tag, kind, count, value in sorted(fields):
        out += struct.pack("<HHII", tag, kind, count, value)
    return out + bytes(4) + body


MALFORMED = {
    "width without values": [(256, 4, 0, 0), (257, 4, 1, 1), (258, 4, 1, 8)],
    "huge page, four bytes": [(256, 4, 1, 2_000_000), (257, 4, 1, 2_000_000), (258, 4, 1, 8), (273, 4, 1, 8), (279, 4, 1, 4)],
    "wide page, four bytes": [(256, 4, 1, 4_000_000_000), (257, 4, 1, 1), (258, 4, 1, 8), (273, 4, 1, 8), (279, 4, 1, 4)],
    "large page that deflate could not hold": [(256, 4, 1, 30_000), (257, 4, 1, 30_000), (258, 4, 1, 8), (259, 4, 1, 8), (273, 4, 1, 8), (279, 4, 1, 4)],
    "tiles without size": [(256, 4, 1, 4), (257, 4, 1, 4), (258, 4, 1, 8), (324, 4, 1, 8), (325, 4, 1, 4)],
    "tiles without lengths": [(256, 4, 1, 4), (257, 4, 1, 4), (258, 4, 1, 8), (322, 4, 1, 4), (323, 4, 1, 4), (324, 4, 1, 8)],
    "strip behind the end": [(256, 4, 1, 4), (257, 4, 1, 4), (258, 4, 1, 8), (273, 4, 1, 4_000_000_000), (279, 4, 1, 4_000_000_000)],
    "field number 0": [(0, 4, 1, 5), (256, 4, 1, 4), (257, 4, 1, 4), (258, 4, 1, 8)],
    "many samples": [(256, 4, 1, 4), (257, 4, 1, 4), (258, 4, 1, 8), (277, 4, 1, 4_000_000_000), (273, 4, 1, 8), (279, 4, 1, 4)],
}


def test_malformed_directories(spark):
    """Each gives one row with its reason, beside a good file, and none of them an array of the size it claims."""
    good = tiff.encode([np.arange(64, dtype=np.uint8).reshape(8, 8)])
    files = {**{name: directory(fields) for name, fields in MALFORMED.items()}, "values behind the end": directory([(256, 4, 1_000_000_000, 8)]), "cut": good[:-9], "good": good}
    rows = {r.name: r for r in tiff.pages(spark.createDataFrame(list(files.items()), "name string, content binary"), "name").collect()}
    assert len(rows) == len(files) and rows["good"].error is None and rows["good"].samples == bytes(range(64))
    assert all(r.error and r.samples is None for name, r in rows.items() if name != "good")
    assert rows["wide page, four bytes"].width == 4_000_000_000
    # A deflated strip that would unpack to far more than the page takes is read as far as needed.
    packed = zlib.compress(bytes(50_000_000))
    fields = [(256, 4, 1, 4), (257, 4, 1, 4), (258, 4, 1, 8), (259, 4, 1, 8), (273, 4, 1, 0), (279, 4, 1, len(packed))]
    fields[4] = (273, 4, 1, 10 + 12 * len(fields) + 4)
    (page,) = tiff.decode(directory(fields, packed))
    assert page[8] == bytes(16) and page[9] is None


def test_form_does_not_follow_size(spark):
    """Every codec, predictor and layout gets its share of short and of long texts, and of the bytes."""
    texts = [f"{k} " + "some words of text " * (1 if k % 2 else 400) for k in range(240)]
    for kind in (texts[::2], texts[1::2]):
        assert {tiff.form_of(tiff.payload(t)) for t in kind} == set(tiff.FORMS)
    size = {}
    for r in tiff.round_trip(documents(spark, texts)).collect():
        size[r.codec] = size.get(r.codec, 0) + r.payload_bytes
    assert set(size) == {"packbits", "lzw", "deflate"} and all(n > sum(size.values()) / 5 for n in size.values())


def test_texts_survive_storage(spark):
    texts = [*AWKWARD, "long " * 40_000, *[f"{k} " + "seventeen long pages " * 50_000 for k in range(6)]]
    for r in tiff.round_trip(documents(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-64:]) and r.n_pages == -(-len(data) // 65536)
