"""Media columns: TIFF. One row per page, decoded from strips or tiles.

`pages(files)` walks the image directories of each file, decodes PackBits, LZW or deflate (or stored) strips and
tiles, undoes the horizontal predictor, and gives one row per directory. `encode` writes the files that the tests
and the round-trip query read: 8-bit greyscale, strips or tiles, any of the codecs, one or more pages.

Defined cases: null content, or bytes that are no TIFF, give one row with page -1, no samples and the reason in
`error`; a page that can't be decoded (unknown codec, short data, no width or height, fields without values, more
samples than its segments can hold or than `MOST_BYTES`) gives its row with the reason, and the file's other pages
stand; a damaged list of directories or a loop in it ends the file with such a row. Nothing is allocated for a page
before its segments are found to be there and long enough. Samples are kept unsigned, in file order, 8 or 16 bits (16: in the file's byte
order turned to little-endian). Further columns of the input do not matter: only the id and content are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short

#: Fixed values of the format: tag numbers, codec numbers, bytes per value of each field type.
WIDTH, HEIGHT, BITS, CODEC, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
STORED, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}

#: Bytes that a byte of data can stand for at most: PackBits makes 128 of 2, an LZW code of 9 bits and more a string of under 4096, deflate 258 of 2 bits.
GROWTH = {STORED: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Samples of a page that one row can hold (a row of Arrow has at most 2 GiB); a larger page gives an error row.
MOST_BYTES = 1 << 30

PAGE_SCHEMA = "page int, width long, height long, samples_per_pixel long, bits long, codec long, predictor long, n_segments int, samples binary, error string"


# -- codecs -------------------------------------------------------------------------------------------------------


def unpack_bits(data: bytes) -> bytes:
    """PackBits: n < 128: n + 1 bytes as they are; n > 128: the next byte 257 - n times; 128: nothing."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of 3 bytes and more as runs, the rest as it is."""
    out, n = bytearray(), len(data)
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(values)) + 1 if n else np.empty(0, np.int64)
    starts, ends = np.r_[0, edges], np.r_[edges, n]
    plain = 0  # start of the stretch that is not yet written

    def flush(upto: int) -> None:
        for a in range(plain, upto, 128):
            b = min(a + 128, upto)
            out.append(b - a - 1)
            out.extend(data[a:b])

    for a, b in zip(starts[ends - starts >= 3].tolist(), ends[ends - starts >= 3].tolist(), strict=True):
        flush(a)
        for c in range(a, b, 128):
            m = min(128, b - c)
            out.extend((257 - m, data[c]) if m > 1 else (0, data[c]))
        plain = b
    flush(n)
    return bytes(out)


#: Codes of LZW, as values of the format: 256 clears the table, 257 ends the data; codes have 9 to 12 bits.
CLEAR, END, WIDEST = 256, 257, 12
SINGLE = [bytes([i]) for i in range(256)]


def code_widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear: the k-th is read with 257 + k table entries, and widths grow one entry early."""
    entries = np.arange(n) + 257
    return np.minimum(9 + (entries >= 511) + (entries >= 1023) + (entries >= 2047), WIDEST)


WIDTHS = code_widths(4096)


def read_codes(data: bytes) -> Iterator[list[int]]:
    """The codes of LZW data, most significant bit first: one list for each stretch between clears. What follows the end is left."""
    bits = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    at, end = 0, 8 * len(data)
    while at + 9 <= end:
        found, rest = [], WIDTHS
        while True:  # a table that is never cleared goes on with the widest codes
            places = at + np.append(0, np.cumsum(rest))
            rest = rest[: int(np.searchsorted(places[1:], end, side="right"))]
            places = places[: len(rest)]
            first = places >> 3
            window = bits[first] << 16 | bits[first + 1] << 8 | bits[first + 2]
            codes = window >> (24 - (places & 7) - rest).astype(np.uint32) & ((1 << rest) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == CLEAR) | (codes == END))
            if len(stop):
                upto = int(stop[0])
                found += codes[:upto].tolist()
                at = end if codes[upto] == END else int(places[upto] + rest[upto])
                break
            found += codes.tolist()
            at = int(places[-1] + rest[-1]) if len(rest) else end
            if at + WIDEST > end:
                at = end
                break
            rest = np.full(4096, WIDEST)
        yield found


def unpack_lzw(data: bytes) -> bytes:
    """Variable-width codes: each stands for a string of the table, and each but the first adds one: the last string and the first byte of this one."""
    out = []
    for codes in read_codes(data):
        table, last = [*SINGLE, b"", b""], b""
        for code in codes:
            if code < len(table):
                word = table[code]
                if last and len(table) < 4096:
                    table.append(last + word[:1])
            elif code == len(table) and last:
                word = last + last[:1]
                table.append(word)
            else:
                raise ValueError("LZW code out of range")
            out.append(word)
            last = word
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """The inverse of unpack_lzw. The table is cleared before it is full."""
    codes, widths, begun = [CLEAR], [9], 1
    if data:
        table: dict[int, int] = {}
        get, word, following = table.get, data[0], 258
        for byte in data[1:]:
            code = get(word << 8 | byte)
            if code is not None:
                word = code
                continue
            codes.append(word)
            table[word << 8 | byte] = following
            following += 1
            word = byte
            if following == 4094:
                codes.append(CLEAR)
                widths += WIDTHS[: len(codes) - begun].tolist()
                begun, following = len(codes), 258
                table.clear()
        codes.append(word)
    codes.append(END)
    widths += WIDTHS[: len(codes) - begun].tolist()
    width = np.array(widths)
    bits = np.array(codes)[:, None] >> (width[:, None] - 1 - np.arange(WIDEST)).clip(0) & 1
    return np.packbits(bits[np.arange(WIDEST) < width[:, None]].astype(np.uint8)).tobytes()


UNPACK = {STORED: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}
PACK = {STORED: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1)}


# -- reading ------------------------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[dict]:
    """Tag -> list of numbers, for each image directory in turn; under 0 the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directory loop")
        seen.add(at)
        tags: dict = {0: order}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = FIELD_BYTES.get(kind, 0) * count
            where = at + 10 + 12 * k
            if size > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if kind in (1, 3, 4) and tag:
                tags[tag] = list(struct.unpack_from(f"{order}{count}{'.BHHI'[kind] if kind != 3 else 'H'}", data, where))
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def first(tags: dict, tag: int, other: int) -> int:
    """A field's first value; `other` where the field is absent or has no values."""
    return (tags.get(tag) or [other])[0]


def inflate(data: bytes, need: int) -> bytes:
    """The first `need` bytes of deflated data, so that no segment unpacks to more than its page takes."""
    return zlib.decompressobj().decompress(data, need) if need else b""


def image(data: bytes, tags: dict) -> np.ndarray:
    """The samples of one page: height x width x samples per pixel."""
    one = lambda tag, other: first(tags, tag, other)
    width, height, spp, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    codec, predictor = one(CODEC, STORED), one(PREDICTOR, 1)
    if bits not in (8, 16) or predictor not in (1, 2) or codec not in GROWTH or (spp > 1 and one(PLANAR, 1) != 1):
        raise ValueError(f"unsupported page: bits {bits}, predictor {predictor}, codec {codec}")
    kind = np.dtype(np.uint8 if bits == 8 else tags[0] + "u2")
    if not (width and height and spp):
        raise ValueError("no width, height or samples")
    tiled = TILE_AT in tags
    if tiled:
        seg_w, seg_h, places, lengths = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_AT], tags.get(TILE_BYTES, [])
    else:
        seg_w, seg_h, places = width, min(one(STRIP_ROWS, height), height), tags.get(STRIP_AT, [])
        lengths = tags.get(STRIP_BYTES, [len(data)])
    if not (seg_w and seg_h):
        raise ValueError("segments without width or height")
    across = -(-width // seg_w)
    n, row_bytes = across * -(-height // seg_h), seg_w * spp * kind.itemsize
    if height * width * spp * kind.itemsize > MOST_BYTES or seg_h * row_bytes > MOST_BYTES:
        raise ValueError(f"page of {width} x {height} x {spp} samples is larger than a row can hold")
    if min(len(places), len(lengths)) < n:
        raise ValueError(f"{min(len(places), len(lengths))} segments of {n}")
    rows_of = lambda k: seg_h if tiled else min(seg_h, height - k // across * seg_h)
    for k in range(n):
        if min(lengths[k], max(0, len(data) - places[k])) * GROWTH[codec] < rows_of(k) * row_bytes:
            raise ValueError(f"segment {k} is short")
    out = np.zeros((height, width, spp), kind.newbyteorder("<"))
    for k in range(n):
        top, left, rows = k // across * seg_h, k % across * seg_w, rows_of(k)
        packed, need = data[places[k] : places[k] + lengths[k]], rows * row_bytes
        raw = inflate(packed, need) if codec in (DEFLATE, OLD_DEFLATE) else UNPACK[codec](packed)
        if len(raw) < need:
            raise ValueError(f"segment {k} is short")
        block = np.frombuffer(raw, kind, need // kind.itemsize).reshape(rows, seg_w, spp)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        h, w = min(rows, height - top), min(seg_w, width - left)
        out[top : top + h, left : left + w] = block[:h, :w]
    return out


def decode(data: bytes | None) -> Iterator[tuple]:
    """PAGE_SCHEMA's values for each page of a file."""
    page = -1
    try:
        if data is None:
            raise ValueError("no content")
        for page, tags in enumerate(directories(data)):
            head = [first(tags, t, d) for t, d in ((WIDTH, 0), (HEIGHT, 0), (SAMPLES, 1), (BITS, 1), (CODEC, STORED), (PREDICTOR, 1))]
            segments = len(tags.get(TILE_AT) or tags.get(STRIP_AT) or [])
            try:
                yield (page, *head, segments, image(data, tags).tobytes(), None)
            except (ValueError, KeyError, IndexError, zlib.error) as e:
                yield (page, *head, segments, None, str(e) or type(e).__name__)
    except (ValueError, struct.error) as e:
        yield (page + 1 if page >= 0 else -1, None, None, None, None, None, None, 0, None, str(e))


# -- writing ------------------------------------------------------------------------------------------------------


def encode(pages: list[np.ndarray], codec: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """8-bit greyscale pages (height x width) as a little-endian TIFF file, in strips of `rows` rows or in tiles (height, width)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        seg_h, seg_w = tile or (rows, width)
        places, lengths = [], []
        for top in range(0, height, seg_h):
            for left in range(0, width, seg_w):
                block = page[top : top + seg_h, left : left + seg_w]
                if tile:
                    block = np.pad(block, ((0, seg_h - block.shape[0]), (0, seg_w - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                data = PACK[codec](block.tobytes())
                places.append(len(out))
                lengths.append(len(data))
                out += data
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (CODEC, [codec]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        fields += [(TILE_WIDTH, [seg_w]), (TILE_HEIGHT, [seg_h]), (TILE_AT, places), (TILE_BYTES, lengths)] if tile else [(STRIP_AT, places), (STRIP_ROWS, [seg_h]), (STRIP_BYTES, lengths)]
        body = bytearray(struct.pack("<H", len(fields)))
        spare = len(out) + 2 + 12 * len(fields) + 4
        tail = bytearray()
        for tag, values in sorted(fields):
            body += struct.pack("<HHI", tag, 4, len(values))
            body += struct.pack("<I", values[0] if len(values) == 1 else spare + len(tail))
            if len(values) > 1:
                tail += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + len(body)
        out += body + b"\0\0\0\0" + tail
    return bytes(out)


# -- the operator -------------------------------------------------------------------------------------------------


def pages(files: DataFrame, id_col: str = "doc_id", content_col: str = "content", keep: tuple[str, ...] = (), nested: bool = False) -> DataFrame:
    """One row per page of each file: the id, the columns in `keep` and PAGE_SCHEMA. nested: one row per file, the pages as an array."""
    cols = [id_col, *keep]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in cols)
    fields = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in PAGE_SCHEMA.split(", ")))
    kind = pa.struct(list(zip(PAGE_NAMES, PAGE_TYPES, strict=True)))
    limit = 8 << 20  # bytes of samples in a batch, more only for a single larger file

    def run(batches):
        for batch in short(batches):
            picked, decoded, held = [], [], 0
            content = batch.column(len(cols))

            def out():
                kept = [batch.column(c).take(pa.array(picked, pa.int64())) for c in range(len(cols))]
                if nested:
                    arrays = [pa.array([[dict(zip(PAGE_NAMES, row, strict=True)) for row in rows] for rows in decoded], pa.list_(kind))]
                    return pa.RecordBatch.from_arrays([*kept, *arrays], names=[*cols, "pages"])
                values = list(zip(*decoded, strict=True)) or [[]] * len(PAGE_NAMES)
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(values, PAGE_TYPES, strict=True))], names=[*cols, *PAGE_NAMES])

            for k in range(batch.num_rows):
                rows = list(decode(content[k].as_py()))
                picked += [k] if nested else [k] * len(rows)
                decoded += [rows] if nested else rows
                held += sum(len(r[8] or b"") for r in rows)
                if held > limit:
                    yield out()
                    picked, decoded, held = [], [], 0
            yield out()

    return files.select(*cols, content_col).mapInArrow(run, f"{schema}, " + (f"pages array<struct<{fields}>>" if nested else PAGE_SCHEMA))


PAGE_NAMES = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
PAGE_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in PAGE_SCHEMA.split(", ")]


def payload(text: str | None) -> bytes:
    """The text's UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


#: How texts are stored: each codec with each predictor, in strips and in tiles.
FORMS = [(codec, predictor, tiled) for codec in (PACKBITS, LZW, DEFLATE) for predictor in (1, 2) for tiled in (False, True)]


def form_of(data: bytes) -> tuple[int, int, bool]:
    """Codec, predictor and layout of a payload: by its CRC-32, whatever its size."""
    return FORMS[zlib.crc32(data) % len(FORMS)]


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, page_rows: int = 1024) -> DataFrame:
    """(id, n_bytes, content): each text as a TIFF file of 8-bit pages, `width` samples wide.

    A page has up to `page_rows` rows, so a long text has several. Codec, predictor and strips or tiles follow from the payload's CRC-32,
    so that texts of all sizes go through each of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in short(batches, 64):
            sizes, files = [], []
            for text in batch.column(1):
                text = text.as_py()
                data = payload(text)
                sizes.append(len((text or "").encode()))
                image_rows = np.frombuffer(data, np.uint8).reshape(-1, width)
                codec, predictor, tiled = form_of(data)
                # Tiles are 16 rows high and more, by 16; half a page wide.
                tile = (min(256, -(-len(image_rows) // 16) * 16), max(16, width // 32 * 16)) if tiled else None
                files.append(encode([image_rows[a : a + page_rows] for a in range(0, len(image_rows), page_rows)], codec, predictor, tile=tile))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "content"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, content binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each text as TIFF, reads the stored bytes back and describes what was read: one row per document."""
    read = pages(stored(docs), keep=("n_bytes", "content"), nested=True)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in short(batches, 64):
            payloads = [b"".join(p["samples"] for p in row.as_py()) for row in batch.column(3)]
            counts = [len(row) for row in batch.column(3)]
            codecs = [CODEC_NAMES[row[0]["codec"].as_py()] for row in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(payloads, pa.binary()), pa.array([feature(p) for p in payloads]), pa.array(counts, pa.int32()), pa.array(codecs, pa.string())],
                names=["doc_id", "n_bytes", "content", "payload", "feature", "n_pages", "codec"],
            )

    described = read.mapInArrow(run, f"doc_id {kind}, n_bytes long, content binary, payload binary, feature string, n_pages int, codec string")
    return described.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        "feature",
        "n_pages",
        "codec",
    )


CODEC_NAMES = {PACKBITS: "packbits", LZW: "lzw", DEFLATE: "deflate"}


def feature(samples: bytes) -> str:
    """Mean, deviation and mean step between neighbours of the samples, then their shares in 8 equal ranges, in thousandths."""
    v = np.frombuffer(samples, np.uint8)
    if not len(v):
        return "empty"
    shares = np.bincount(v >> 5, minlength=8) * 1000 // len(v)
    step = np.abs(np.diff(v.astype(np.int16))).mean() if len(v) > 1 else 0.0
    return f"{v.mean():.3f} {v.std():.3f} {step:.3f} " + " ".join(map(str, shares))
