import io
import zipfile

from pyspark.sql import functions as F

from factloom.sources import files, traits

W = 'xmlns:w="http://w"'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def para(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def row(*cells):
    return "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"


DOCX = archive(word__document_xml=f"<w:document {W}><w:body>{para('Введение', 'Heading1')}{para('Текст о меди.')}{para('Таблица 1 - Режимы')}<w:tbl>{row('a', 'b')}{row('', '')}{row('1', '')}</w:tbl></w:body></w:document>")
PPTX = archive(ppt__slides__slide1_xml='<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p><a:r><a:t>line</a:t></a:r></a:p></p:txBody></p:sp><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:sld>')
XLSX = archive(
    xl__workbook_xml='<workbook xmlns="m"><sheets><sheet name="S"/></sheets></workbook>',
    xl__sharedStrings_xml='<sst xmlns="m"><si><t>name</t></si><si><t>Cu</t></si></sst>',
    xl__worksheets__sheet1_xml='<worksheet xmlns="m"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>q</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>7</v></c><c r="D3"><v>9</v></c></row></sheetData></worksheet>',
)


def test_all_formats(spark, tmp_path):
    data = {
        "a.txt": "Заголовок\n\n".encode("cp1251") + ("слово " * 20).encode("cp1251"),
        "b.CSV": b"\xef\xbb\xbfa,a,\n1,2,3,4\n\n,5,\n",
        "c.docx": DOCX, "d.pptx": PPTX, "e.xlsx": XLSX, "f.bin": b"\0\1", "g.docx": b"not a zip", "h.pdf": b"%PDF", "i.md": b"",
    }
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in files.fragments(files.read_files(spark, str(tmp_path))).orderBy("filename", "ordinal").collect():
        got.setdefault(r.filename, []).append((r.element_type, r.section, r.row, r.text))
    assert got["a.txt"] == [("paragraph", "Uploaded text", None, "Заголовок\n" + ("слово " * 20).strip())]
    assert [x[2:] for x in got["b.CSV"]] == [(1, "a=1; a_2=2; column_3=3; column_4=4"), (2, "a_2=5")]
    assert [(x[0], x[1], x[3]) for x in got["c.docx"]] == [("docx_paragraph", "Введение", "Введение"), ("docx_paragraph", "Введение", "Текст о меди."), ("docx_paragraph", "Введение", "Таблица 1 - Режимы"), ("docx_table_row", "Таблица 1 - Режимы", "a | b"), ("docx_table_row", "Таблица 1 - Режимы", "1")]
    assert [(x[0], x[3]) for x in got["d.pptx"]] == [("pptx_text", "Title\nline"), ("pptx_table_row", "x | y")]
    assert [(x[0], x[3]) for x in got["e.xlsx"]] == [("xlsx_header", "name | column_2 | q"), ("xlsx_row", "name=Cu; column_2=7; column_4=9")]
    assert all(got[n][0][0] == "placeholder" for n in ("f.bin", "g.docx", "h.pdf"))


def test_traits(spark):
    names = spark.createDataFrame([("ОИП-07-2022.pdf",), ("отчёт 09.06.22.docx",), ("x.doc",)], "n string")
    assert [r.y for r in names.select(traits.filename_year(F.col("n"), 2026).alias("y")).collect()] == [2022, 2022, None]
    frags = spark.createDataFrame([("d", 1, 1, "изд. 2019 и 2019"), ("d", 1, 2, "год 2021"), ("d", 2, 1, "b"), ("d", 3, 1, "c"), ("d", 4, 1, "конец")], "document_id string, page int, ordinal int, text string")
    assert traits.year_mode(frags).first().year == 2021
    assert tuple(traits.title_pages(frags).first()) == ("d", "изд. 2019 и 2019 год 2021 b", "конец")
    # Both pages count as one text, and the last page gives its start even if it is one of the first two.
    assert tuple(traits.title_pages(frags.where("page < 3"), 24, 1).first()) == ("d", "изд. 2019 и 2019 год 202", "b")
    assert tuple(traits.title_pages(frags.where("page = 1"), 100, 4).first()) == ("d", "изд. 2019 и 2019 год 2021", "изд.")
    assert {r.document_id: r.origin for r in traits.origin(spark.createDataFrame([("a", "Latin text"), ("b", "русский x")], "document_id string, text string")).collect()} == {"a": "foreign", "b": "ru"}
    names = spark.createDataFrame([("d", 1, "Утверждаю Директор И.И. Косов Я.И., Л.Б. Цымбулов"), ("d", 2, "Затицкий Борис Эдуардович; D.M. Bogatyrev; косов Косов Б.Б.")], "document_id string, ordinal int, text string")
    assert traits.authors(names).first().authors == ["Косов Я.И.", "Цымбулов Л.Б.", "Bogatyrev D.M.", "Затицкий Б.Э."]


def test_bodies_of_slide_cells_are_rows_only(spark):
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    slide = f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp><a:tbl><a:tr>{cell("x")}{cell("y")}</a:tr></a:tbl></p:sld>'
    assert [(x[0], x[-1]) for x in files.pptx_blocks(archive(ppt__slides__slide1_xml=slide))] == [("pptx_text", "Title"), ("pptx_table_row", "x | y")]


def test_sheets_follow_the_relations(spark):
    import io
    import zipfile

    sheet = lambda t: f'<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{t}</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="First" r:id="rId9"/><sheet name="Second" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("in one"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("in two"))
    assert [(x[1], x[-1]) for x in files.xlsx_rows(out.getvalue())] == [("XLSX sheet First", "in two"), ("XLSX sheet Second", "in one")]


def test_years_of_the_first_pages_and_origin_of_the_head(spark):
    schema = "document_id string, page int, ordinal int, text string"
    rows = [("a", 1, 1, "2001 2001 2001"), ("a", 2, 2, "Москва, 2003 г."), ("a", 5, 3, "год 2010 2010"), ("b", 3, 1, "1999 и 2999, x2005"), ("c", 1, 1, None), ("c", 2, 2, "none"), ("c", 3, 3, "2004")]
    assert {r.document_id: r.year for r in traits.year_mode(spark.createDataFrame(rows, schema)).collect()} == {"a": 2003, "b": 1999}
    long = [("l", 1, k, "latin words" if k <= 40 else "русские слова " * 99) for k in range(1, 80)]
    assert traits.origin(spark.createDataFrame(long, schema)).first().origin == "foreign"
    names = spark.createDataFrame([("a 9-6-22.doc",), ("b 1.1.99 2.2.21.doc",), ("c_2020.doc",), ("d 2020 2031.doc",), (None,)], "n string")
    assert [r.y for r in names.select(traits.filename_year(F.col("n"), 2026).alias("y")).collect()] == [2022, 2021, None, 2020, None]
