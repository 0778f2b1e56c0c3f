"""Golden office files, and files that are damaged in every way that comes to mind."""

import io
import struct
import zipfile

import pytest

from lodestrand.plans.extract import extract
from lodestrand.sources.documents import read_files
from lodestrand.sources.office import office_text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body):
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def links(*targets):
    return "<Relationships>" + "".join(f"<Relationship Id='rId{k}' Target='{t}'/>" for k, t in enumerate(targets, 1)) + "</Relationships>"


BOX = "<w:p><w:r><w:t>host</w:t></w:r><w:r><mc:AlternateContent><mc:Choice><w:drawing><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:drawing></mc:Choice><mc:Fallback><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:pict></mc:Fallback></mc:AlternateContent></w:r><w:r><w:t> rest</w:t></w:r></w:p>"


@pytest.mark.parametrize("body, want", [
    ("<w:p><w:pPr><w:tabs><w:tab w:val='left'/><w:tab w:val='left'/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>", "a\tb"),
    (BOX, "host rest\nbox"),
    ("<w:p><w:r><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p><w:p/>", "x\ny\n"),
    ("<w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>", "1\n2"),
    ("<w:p><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>", "new"),
    ("<w:p><w:r><w:instrText>PAGE</w:instrText></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>", "link"),
    ("<w:p><w:r><w:ruby><w:rt><w:r><w:t>guide</w:t></w:r></w:rt><w:rubyBase><w:r><w:t>base</w:t></w:r></w:rubyBase></w:ruby></w:r></w:p>", "base"),
])
def test_docx(body, want):
    assert office_text(docx(body), "docx") == want


def test_xlsx():
    rows = (
        "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='D1'><v>4</v></c></row><row r='2'><c r='B2' t='inlineStr'><is><t>in</t></is></c><c t='b'><v>1</v></c></row>"
        "<row r='4'/><row r='5'><c r='AA5'><f>1+1</f><v>2</v></c></row>"
    )
    sheet = lambda x: f"<worksheet {S}><sheetData>{x}</sheetData></worksheet>"
    shared = f"<sst {S}><si><r><t>漢</t></r><r><t>字</t></r><rPh sb='0' eb='2'><t>kanji</t></rPh></si></sst>"
    book = f"<workbook {S} {R}><sheets><sheet name='b' r:id='rId2'/><sheet name='a' r:id='rId1'/></sheets></workbook>"
    last = sheet("<row><c><v>second</v></c></row>")
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links("worksheets/sheet1.xml", "/xl/worksheets/sheet2.xml"), "xl/sharedStrings.xml": shared}
    got = office_text(zipped(parts | {"xl/worksheets/sheet1.xml": last, "xl/worksheets/sheet2.xml": sheet(rows)}), "xlsx")
    assert got == "漢字\t\t\t4\n\tin\tTRUE\n\n" + "\t" * 26 + "2\nsecond"
    with pytest.raises(ValueError):
        office_text(zipped({"xl/worksheets/sheet1.xml": sheet("<row><c r='ZZZZZZ1'><v>1</v></c></row>")}), "xlsx")


def test_pptx():
    slide = lambda x: f"<p:sld {A}><p:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></p:txBody></p:sld>"
    show = f"<p:presentation {A} {R}><p:sldIdLst><p:sldId id='256' r:id='rId2'/><p:sldId id='257' r:id='rId1'/></p:sldIdLst></p:presentation>"
    parts = {"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": links("slides/slide1.xml", "slides/slide2.xml")}
    parts |= {"ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide("two"), "ppt/notesSlides/notesSlide1.xml": slide("note")}
    assert office_text(zipped(parts), "pptx") == "two\none\nnote"


def damaged():
    good = docx("<w:p><w:r><w:t>" + "text " * 2000 + "</w:t></w:r></w:p>")
    at = good.index(b"word/document.xml") + len("word/document.xml")
    data = good[: at + 4] + b"\xff" * 16 + good[at + 20 :]
    encrypted = bytearray(good)
    for mark, place in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        encrypted[good.index(mark) + place] |= 1
    method = bytearray(good)
    for mark, place in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):
        method[good.index(mark) + place : good.index(mark) + place + 2] = struct.pack("<H", 99)
    deep = zipped({"word/document.xml": f"<w:document {W}>" + "<w:sdt>" * 50_000 + "</w:sdt>" * 50_000 + "</w:document>"})
    return {"data.docx": data, "encrypted.docx": bytes(encrypted), "method.docx": bytes(method), "truncated.docx": good[: len(good) // 2], "deep.docx": deep,
            "missing.docx": zipped({"a": ""}), "text.xlsx": b"not a zip", "index.xlsx": zipped({"xl/worksheets/sheet1.xml": f"<w {S}><row><c t='s'><v>9</v></c></row></w>"})}


def test_each_damaged_file_is_a_row(spark, tmp_path):
    bad = damaged()
    for name, raw in bad.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "good.txt").write_text("Nothing here.")
    docs = read_files(spark, str(tmp_path)).withColumnRenamed("path", "doc_id")
    got = {r.filename: (r.status, r.error) for r in extract(docs).collect()}
    assert got.pop("good.txt")[0] == 404 and got.pop("missing.docx")[0] == 422
    assert set(got) == set(bad) - {"missing.docx"} and all(s == 500 and e.startswith("unreadable: ") for s, e in got.values())


def test_large_files_are_rows(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x" * 5000)
    (tmp_path / "big.docx").write_bytes(b"x" * 5000)
    (tmp_path / "small.txt").write_text("x")
    got = {r.filename: (r.size, r.text, r.error) for r in read_files(spark, str(tmp_path), 4000).collect()}
    assert got == {"big.txt": (5000, None, "too large"), "big.docx": (5000, None, "too large"), "small.txt": (1, "x", None)}
    plan = read_files(spark, str(tmp_path), 4000).where("error = 'too large'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,4000)" in plan
