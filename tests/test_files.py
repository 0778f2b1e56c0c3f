"""Files on disk to blocks: text, notebooks and office formats, and files that can't be read."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import blocks as B
from lodestrand.plans.extract import block_rows, extract
from lodestrand.sources.documents import read_files

CODE = "def area(w, h):\n    return w * h\nimport math\nprint(area(2, math.pi))"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    cell = {"cell_type": "code", "source": CODE.splitlines(keepends=True)}
    (d / "a.ipynb").write_text(json.dumps({"cells": [cell], "nbformat": 4}), encoding="utf-8")
    (d / "b.md").write_text(f"# Notes é\n```python\n{CODE}\n```\n", encoding="utf-8")
    (d / "c.txt").write_text("nothing here", encoding="utf-8")
    (d / "d.txt").write_bytes(b"\xff\xfe broken")
    (d / "e.html").write_bytes(b" \n")
    paragraphs = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{x}</w:t></w:r></w:p>" for x in ["Kode program:", *CODE.split("\n"), "penugasan"])
    archive(d / "f.docx", word__document=f"<w:document {W}><w:body>{paragraphs}</w:body></w:document>", word__styles=f"<w:x {W}/>")
    slide = lambda *xs: f"<a:s {A}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in xs) + "</a:s>"
    archive(d / "g.pptx", ppt__slides__slide10=slide("three"), ppt__slides__slide2=slide("two", "and"), ppt__slides__slide1=slide("one"))
    sheet = "<sheetData><row><c t='s'><v>1</v></c><c><v>2.5</v></c></row><row><c t='inlineStr'><is><t>in</t></is></c></row></sheetData>"
    shared = "<si><t>no</t></si><si><r><t>ye</t></r><r><t>s</t></r></si>"
    archive(d / "h.xlsx", xl__sharedStrings=f"<sst {S}>{shared}</sst>", xl__worksheets__sheet1=f"<worksheet {S}>{sheet}</worksheet>")
    (d / "i.docx").write_bytes(b"no archive")
    archive(d / "j.docx", word__document="<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>")
    (d / "k.pdf").write_bytes(b"%PDF-1.4")
    return read_files(spark, str(d))


def test_texts_and_errors(read):
    got = {r.filename: (r.text, r.error) for r in read.collect()}
    assert got["f.docx"] == ("\n".join(["Kode program:", *CODE.split("\n"), "penugasan"]), None)
    assert got["g.pptx"] == ("one\ntwo\nand\nthree", None) and got["h.xlsx"] == ("yes\t2.5\nin", None)
    assert got["d.txt"] == (None, "not UTF-8") and got["k.pdf"] == (None, "no reader for .pdf") and got["e.html"] == (" \n", None)
    assert got["i.docx"] == (None, "unreadable: BadZipFile") and got["j.docx"] == (None, "unreadable: ValueError")
    assert len(got) == 11


def test_files_to_blocks(read):
    docs = read.withColumn("doc_id", F.xxhash64("path"))
    found = extract(docs)
    assert {r.filename: r.status for r in found.collect()} == {
        "a.ipynb": 200, "b.md": 200, "c.txt": 404, "d.txt": 500, "e.html": 422, "f.docx": 200, "g.pptx": 404, "h.xlsx": 404,
        "i.docx": 500, "j.docx": 500, "k.pdf": 500,
    }
    rows = block_rows(found).join(docs.select("doc_id", "filename"), "doc_id").collect()
    assert {(r.filename, r.lang) for r in rows} == {("a.ipynb", "python"), ("b.md", "python"), ("f.docx", "python")}


def test_result_state_waits(spark):
    state = lambda n, e: spark.range(1).select(B.result_state(F.lit(n), F.lit(e).cast("string"))).first()[0]
    assert [state(2, None), state(0, "x"), state(0, None), state(0, "")] == ["2 BLOK", "GAGAL", "MENUNGGU", "MENUNGGU"]
