"""Files to fragments: text, CSV, DOCX, PPTX, XLSX, PDF; any other file gives a placeholder, so none is lost.

Input: document_id, filename, content (as the binaryFile source gives it). Output: FRAGMENTS. Office files are zip archives of XML; a small reader lists
their blocks and rows, and everything after that is column functions.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as tx
from . import pdf

FRAGMENTS = "document_id string, filename string, ordinal int, element_type string, section string, table int, row int, page int, text string"
PAGES = "document_id string, filename string, pages array<struct<text: string, scan: boolean>>, reason string"

#: extension -> kind of reader.
KINDS = {"csv": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "docx": "docx", "docm": "docx", "pptx": "pptx", "txt": "text", "md": "text", "json": "text", "pdf": "pdf"}
CAPTION = re.compile(r"^\s*(таблица|табл\.?|table)\s*\d", re.IGNORECASE)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """document_id, filename, content of the files under a path; the id is the content's SHA-256."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.sha2("content", 256).alias("document_id"), F.regexp_extract("path", r"[^/]+$", 0).alias("filename"), "content")


def kind_of(filename: Column) -> Column:
    """The reader for a file, by its last extension; null for none."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(known, F.regexp_extract(F.lower(filename), r"\.([^.\\/]+)$", 1))


def decoded(content) -> str:
    """UTF-8 (a mark at the start is dropped), else Windows-1251, else UTF-8 with replacements."""
    data = bytes(content or b"")
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", errors="replace")


@F.pandas_udf(StringType())
def decode(content: pd.Series) -> pd.Series:
    """decoded, for a column."""
    return content.map(decoded)


def unique_headers(raw: list[str]) -> list[str]:
    """Column names: empty ones by position, repeated ones with _2, _3, ..."""
    names, seen = [], {}
    for k, value in enumerate(raw, 1):
        name = (value or "").strip() or f"column_{k}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


def _pairs(names: list[str], values: list[str]) -> str:
    return "; ".join(f"{names[k] if k < len(names) else f'column_{k + 1}'}={v}" for k, v in enumerate(values) if v)


def csv_rows(text: str) -> Iterator[tuple]:
    """(element, section, table, row, text) of each row after the first that has cells."""
    rows = [r for r in csv.reader(io.StringIO(text))]
    names = unique_headers(rows[0]) if rows else []
    for k, values in enumerate((r for r in rows[1:] if r), 1):
        yield "table_row", "Uploaded CSV", None, k, _pairs(names, values)


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _run_text(e) -> str:
    """The text of a paragraph or cell: its runs, a line break between paragraphs."""
    inner = [p for p in e.iter() if _tag(p) == "p"] if _tag(e) != "p" else [e]
    return "\n".join("".join((t.text or "") if _tag(t) == "t" else "\t" if _tag(t) == "tab" else "" for t in p.iter()) for p in inner)


def docx_blocks(data: bytes) -> Iterator[tuple]:
    """Paragraphs and table rows in the order of the page. A heading's text is the section of what follows; a table's is its caption, if the paragraph before is one."""
    body = next(e for e in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).iter() if _tag(e) == "body")
    section, before, table = "DOCX evidence unit", "", 0
    for item in body:
        if _tag(item) == "p":
            text = _run_text(item).strip()
            if text:
                style = next((v for s in item.iter() if _tag(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
                if style.lower().startswith("heading"):
                    section = text[:180]
                yield "docx_paragraph", section, None, None, text
                before = text
        elif _tag(item) == "tbl":
            table += 1
            caption = before[:180] if CAPTION.match(before) else ""
            for k, row in enumerate((r for r in item if _tag(r) == "tr"), 1):
                cells = [_run_text(c).strip().replace("\n", " ") for c in row if _tag(c) == "tc"]
                if any(cells):
                    yield "docx_table_row", caption or section, table, k, " | ".join(c for c in cells if c)
            before = ""


def pptx_blocks(data: bytes) -> Iterator[tuple]:
    """For each slide its text, then its tables' rows."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for number, name in enumerate(names, 1):
        root, table = ElementTree.fromstring(archive.read(name)), 0
        # The bodies of cells belong to the tables' rows alone.
        cells = {body for t in root.iter() if _tag(t) == "tbl" for body in t.iter() if _tag(body) == "txBody"}
        for shape in root.iter():
            if _tag(shape) == "txBody" and shape not in cells and _run_text(shape).strip():
                yield "pptx_text", f"Slide {number}", None, None, _run_text(shape).strip()
        for t in (e for e in root.iter() if _tag(e) == "tbl"):
            table += 1
            for k, row in enumerate((r for r in t if _tag(r) == "tr"), 1):
                cells = [_run_text(c).strip().replace("\n", " ") for c in row if _tag(c) == "tc"]
                if any(cells):
                    yield "pptx_table_row", f"Slide {number}", table, k, " | ".join(c for c in cells if c)


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """File and title of each sheet, in the workbook's order; which file a sheet is in its relations say. Without relations sheets go by the numbers of their files."""
    listed = [s for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
    files = sorted((n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if "xl/_rels/workbook.xml.rels" not in archive.namelist():
        return list(zip(files, [s.attrib.get("name", "") for s in listed] + [""] * len(files), strict=False))
    targets = {r.attrib.get("Id"): r.attrib.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for sheet in listed:
        target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None), "")
        path = target[1:] if target.startswith("/") else f"xl/{target}"
        if path in archive.namelist():
            found.append((path, sheet.attrib.get("name", "")))
    return found


def xlsx_rows(data: bytes) -> Iterator[tuple]:
    """For each sheet its first filled row as head, the others as name=value pairs."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _tag(s) == "si"]
    for number, (name, title) in enumerate(_sheets(archive)):
        section, heads = f"XLSX sheet {title or number + 1}", []
        for row in (e for e in ElementTree.fromstring(archive.read(name)).iter() if _tag(e) == "row"):
            values: dict[int, str] = {}
            for cell in (c for c in row if _tag(c) == "c"):
                letters = re.match("[A-Z]*", cell.attrib.get("r", ""))[0]
                column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(values)
                raw = "".join(t.text or "" for t in cell.iter() if _tag(t) in ("v", "t"))
                values[column] = (shared[int(raw)] if cell.attrib.get("t") == "s" and raw else raw).strip()
            line = [values.get(k, "") for k in range(max(values, default=-1) + 1)]
            if any(line):
                k = int(row.attrib.get("r", 0))
                if heads:
                    yield "xlsx_row", section, number + 1, k, _pairs(heads, line)
                else:
                    heads = [v or f"column_{i}" for i, v in enumerate(line, 1)]
                    yield "xlsx_header", section, number + 1, k, " | ".join(heads)


READERS = {"docx": docx_blocks, "pptx": pptx_blocks, "xlsx": xlsx_rows}


def pdf_pages(files: DataFrame) -> DataFrame:
    """PAGES of PDF files (document_id, filename, content): each page's text and whether it is a scan; without pages, the reason."""

    def run(batches):
        for rows in batches:
            out = []
            for document_id, filename, content in zip(rows["document_id"], rows["filename"], rows["content"], strict=True):
                pages, reason = None, None
                try:
                    pages = [{"text": text, "scan": scan} for text, scan in pdf.page_texts(bytes(content or b""))]
                except (ValueError, TypeError, AttributeError, KeyError, IndexError, OverflowError) as e:
                    reason = f"could not be read: {e if type(e) is ValueError else type(e).__name__}"
                out.append((document_id, filename, pages, reason))
            yield pd.DataFrame(out, columns=["document_id", "filename", "pages", "reason"])

    return files.select("document_id", "filename", "content").mapInPandas(run, PAGES)


def pdf_fragments(files: DataFrame) -> DataFrame:
    """FRAGMENTS of PDF files: the blocks of each page, numbered through; a page without text says so, a file without pages gives a placeholder."""

    def of_page(page: Column, at: Column) -> Column:
        number, text = (at + 1).cast("int"), tx.strip(tx.sanitize(page["text"]))
        said = F.when(text != "", text).otherwise(F.concat(F.lit("PDF page "), number.cast("string"), F.lit(" has no text layer; visual OCR adapter is required.")))
        blocks = tx.merge_short(tx.split_blocks(said))
        return F.transform(F.when(F.size(blocks) > 0, blocks).otherwise(F.array(said)), lambda b: F.struct(F.lit("pdf_page_text").alias("element_type"), F.lit("PDF evidence unit").alias("section"), number.alias("page"), b.alias("text")))

    none = F.struct(F.lit("placeholder").alias("element_type"), F.lit("Uploaded file").alias("section"), F.lit(None).cast("int").alias("page"), F.concat("filename", F.lit(": "), "reason").alias("text"))
    found = F.when(F.col("pages").isNotNull(), F.flatten(F.transform("pages", of_page))).otherwise(F.array(none))
    rows = pdf_pages(files).select("document_id", "filename", F.posexplode(found).alias("at", "f"))
    empty = F.lit(None).cast("int")
    return rows.select("document_id", "filename", (F.col("at") + 1).alias("ordinal"), "f.element_type", "f.section", empty.alias("table"), empty.alias("row"), "f.page", "f.text")


def fragments(files: DataFrame) -> DataFrame:
    """FRAGMENTS of all files. Text goes through column functions; archives through READERS, a task's rows at a time."""
    routed = files.withColumn("kind", kind_of(F.col("filename")))
    text = routed.where("kind = 'text'").select("document_id", "filename", decode("content").alias("text"))
    blocks = text.select("document_id", "filename", F.posexplode(tx.merge_short(tx.split_blocks(F.col("text")))).alias("at", "text"))
    none = lambda kind: F.lit(None).cast(kind)
    plain = blocks.select("document_id", "filename", (F.col("at") + 1).alias("ordinal"), F.lit("paragraph").alias("element_type"), F.lit("Uploaded text").alias("section"), none("int").alias("table"), none("int").alias("row"), none("int").alias("page"), "text")

    def run(batches):
        for pdf in batches:
            rows = []
            for document_id, filename, content, kind in zip(pdf["document_id"], pdf["filename"], pdf["content"], pdf["kind"], strict=True):
                found, reason = [], f"no reader for {kind or 'this kind of file'}"
                try:
                    if kind == "csv":
                        found, reason = list(csv_rows(decoded(content))), "no rows"
                    elif kind in READERS:
                        found, reason = list(READERS[kind](bytes(content or b""))), "no readable text"
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, ValueError, IndexError, csv.Error) as e:
                    reason = f"could not be read: {type(e).__name__}"
                if kind != "csv" or found or reason.startswith("could"):
                    found = found or [("placeholder", "Uploaded file", None, None, f"{filename}: {reason}")]
                rows += [(document_id, filename, k, *f[:4], int(f[1][6:]) if kind == "pptx" and f[1].startswith("Slide ") else None, f[4]) for k, f in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["document_id", "filename", "ordinal", "element_type", "section", "table", "row", "page", "text"]).astype({"table": "Int32", "row": "Int32", "page": "Int32"})

    other = routed.where("kind is null or kind not in ('text', 'pdf')").select("document_id", "filename", "content", "kind").mapInPandas(run, FRAGMENTS)
    return plain.unionByName(other).unionByName(pdf_fragments(routed.where("kind = 'pdf'"))).withColumn("text", tx.sanitize(F.col("text"))).withColumn("normalized_text", tx.normalize_text(F.col("text")))
