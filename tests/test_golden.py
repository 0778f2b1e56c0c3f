"""Golden cases of the extraction."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import strategies as S
from lodestrand.operators.normalize import normalize
from lodestrand.plans.extract import block_rows, extract


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("given, want", [
    ("x < - 5\ny <-3", "x <- 5\ny <- 3"), ("data $ col", "data$col"), ("a    b\t\tc", "a b c"),
    ("  def f():\n      return 1", "def f():\nreturn 1"), ("x\n 12 \n## [1] 3\ny", "x\ny"), ("# keep\n#! keep", "# keep\n#! keep"),
    ("if (x < -5)", "if (x <- 5)"), ("a\n\nb", "a\n\nb"), ("`a ${b}`", "`a${b}`"), ("12.5\n1 2\n١٢", "12.5\n1 2\n١٢"),
    ("x <<- y", "x < <- y"), ("\xa0a\xa0", "a"), ("", ""),
])
def test_normalize(spark, given, want):
    assert one(spark, normalize(F.col("t")), t=given) == want
    assert one(spark, normalize(normalize(F.col("t"))), t=given) == want


@pytest.mark.parametrize("given, want", [
    ("```python\nimport os, sys\n```", [("python", "import os, sys")]), ("```js\nconst a = 1;\n```", [("js", "const a = 1;")]),
    ("```\nSELECT a FROM t\n```", [("", "SELECT a FROM t")]), ("~~~sql\nSELECT a FROM t\n~~~", [("sql", "SELECT a FROM t")]),
    ("```python title=x\nimport os, sys\n```", [("python", "title=x\nimport os, sys")]), ("```c++\nint main(){}\n```", [("c", "++\nint main(){}")]),
    ("```r\nx<-1\n```", []), ("```python\nimport os", []), ("`````` ```py\nprint(12345)\n```", [("py", "print(12345)")]),
    ("pre ```PYTHON print(12345)``` post", [("python", "print(12345)")]), ("```python\r\nimport os, sys\r\n```", [("python", "import os, sys")]),
    ("````\nabcdefghijk\n````", [("", "`\nabcdefghijk")]),
])
def test_fences(spark, given, want):
    assert [(x.hint, x.code) for x in one(spark, S.fence_sections(F.col("t")), t=given)] == want


@pytest.mark.parametrize("given, want", [
    ("Syntax: first part here Program: second part", ["first part here Program: second part", "second part"]),
    ("typescript: some code here", ["some code here"]), ("Kode R:Contoh 1 and more", [""]),
    ("Script: " + "x" * 4000 + " penugasan " + "y" * 1000, ["x" * 4000]), ("Script:" + "x" * 5000, ["x" * 2000]),
    ("kode  " * 300, []),
])
def test_anchor_candidates(spark, given, want):
    assert one(spark, S.anchor_candidates(F.col("t")), t=given) == want


CODE = {"cell_type": "code", "source": ["import os\n", "print(os)"]}


@pytest.mark.parametrize("cells, want", [
    ([CODE, {"cell_type": "code", "source": "print(1234567)"}, CODE], 1), ([CODE, None, CODE], 1),
    ([CODE, {"cell_type": "markdown", "source": "text"}, CODE], 2), ([], 0),
])
def test_notebooks(spark, cells, want):
    text = json.dumps({"cells": cells, "about": '"source" "cell_type"'})
    got = one(spark, S.notebook_codes(F.col("t")), t=text.replace("\\", "") if not cells else text)
    assert len(got or []) == want


def test_notebook_with_trailing_text(spark):
    assert one(spark, S.notebook_codes(F.col("t")), t=json.dumps({"cells": [CODE]}) + " trailing") is None


def test_envelope_and_cascade(spark):
    fence, labelled = "```python\nimport os, sys\n```", "Program: public static void main(String[] args) { System.out.println(1); } penugasan "
    docs = [(1, "a.md", fence), (2, "a.md", labelled + fence), (3, None, fence), (4, "a.md", None), (5, "a.md", " \xa0\n"), (6, "a.md", "no code"), (7, "a.md", "Syntax: qqqq wwww eeee rrrr " + fence)]
    found = extract(spark.createDataFrame(docs, "doc_id bigint, filename string, text string"))
    status = {r.doc_id: r.status for r in found.collect()}
    assert status == {1: 200, 2: 200, 3: 400, 4: 422, 5: 422, 6: 404, 7: 200}
    rows = [(r.doc_id, r["index"], r.lang) for r in block_rows(found).orderBy("doc_id", "index").collect()]
    assert rows == [(1, 0, "python"), (2, 0, "java"), (7, 0, "python")]
    assert found.where("status = 200 and total <> size(blocks)").count() == 0


def test_scalars(spark):
    assert [one(spark, T.size_kb(F.col("n")), n=n) for n in (256, 768)] == ["0.3", "0.8"]
    assert [one(spark, T.expired(F.col("a"), F.lit(n)), a=0) for n in (3_600_000, 3_600_001)] == [False, True]
    assert one(spark, T.file_ext(F.col("t")), t="noext") == "noext"
    assert one(spark, T.display_date(F.lit("2026-05-07").cast("date")), t="") == "7 Mei 2026"
    assert one(spark, T.cookie_millis(F.col("t")), t="a=1; splash_at=42; b") == 42


def test_extract_stream(spark, tmp_path):
    from lodestrand.streaming.extract import extract_stream

    schema = "doc_id bigint, filename string, size bigint, text string"
    spark.createDataFrame([(1, "a.md", 9, "```python\nimport os, sys\n```")], schema).write.parquet(str(tmp_path / "in"))
    stream = extract_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("blocks").trigger(availableNow=True).start().awaitTermination(120)
    assert [r.lang for r in spark.table("blocks").collect()] == ["python"]


@pytest.mark.parametrize("unit", ["kode ", "kode kode. ", "script ", "kode a:", "a:", "kode\n", "output ", "```", "syntax  : x\n"])
def test_labels_take_linear_time(spark, unit):
    """A megabyte of what might begin a label, or 100 KB of labels: each of these heads 2,000 characters. The session is warm by then."""
    many = (100_000 if unit in ("kode a:", "syntax  : x\n") else 1_000_000) // len(unit)
    text = unit * many
    df = spark.range(1).select(F.repeat(F.lit(unit), many).alias("t")).select(F.size(S.anchor_candidates(F.col("t"))).alias("n"))
    began = time.perf_counter()
    assert df.first().n == (text.count(":") if unit in ("kode a:", "syntax  : x\n") else 0)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("given, want", [
    ("a kode b.c kode d: one two three four", ["one two three four"]), ("kode: none here at all", []), ("my-kode x y : some code", ["some code"]),
    ("kode a\nb:first program : second", ["first program : second", "second"]), ("kode é : not one, kode e : one", ["one"]), ("syntax x: none", []),
])
def test_labels(spark, given, want):
    assert list(one(spark, S.anchor_candidates(F.col("t")), t=given)) == want


@pytest.mark.parametrize("given, want", [("abc", 3), ("😀", 2), ("a😀é", 4), ("", 0)])
def test_units(spark, given, want):
    assert one(spark, T.units(F.col("t")), t=given) == want


def test_first_units(spark):
    for n, want in ((1, "a"), (2, "a"), (3, "a😀"), (4, "a😀b"), (9, "a😀b")):
        assert one(spark, T.first_units(F.col("t"), n), t="a😀b") == want


@pytest.mark.parametrize("given", [
    "{}", ' {"a": [1, {"b": "}"}]} \n', '{"a": "\\""}', "{} x", "{}{}", '{} "a"', "[{}]", "{", "}", "", '{"a": 1}]', "{},", "x{}", "\ufeff{}", "{}\xa0", '{"a": "\\\\"}{', "{]", '{"a":"x\ny"}',
])
def test_one_json_object(spark, given):
    def strict():
        try:
            return isinstance(json.loads(given, strict=False), dict)
        except ValueError:
            return False

    assert one(spark, F.coalesce(T.one_json_object(F.col("t")), F.lit(False)), t=given) == strict()
