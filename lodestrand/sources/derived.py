"""A synthetic corpus with code: documents wrapped with snippets by arithmetic on their ids.

The tables at hand hold prose only, on which extraction would find nothing. Each document gets one of six wrappers
(doc_id % 6: label with end, label without, backtick fence, tilde fence, notebook, none) and one of eight snippets
(doc_id div 6 % 8). The same parts make the Spark expression and its SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Our own snippets, by language, in the order of doc_id div 6 % 8.
SNIPPETS = (
    ("python", "def area(w, h):\n    return w * h\n\nimport math\nprint(area(2, math.pi))\n12\nif __name__ is None: print(len([]))"),
    ("r", "library(stats)\nx < - c(1, 2, 3)\ny <-   mean(x)\nd < - data.frame(a = x)\nd $ a\n## [1] 2"),
    ("javascript", "const twice = (n) => n * 2;\nlet total = 0;\nconsole.log(twice(total) === 0);"),
    ("typescript", "interface Point { x: number; y: number }\nconst origin: Point = { x: 0, y: 0 };\nexport type Name = string;"),
    ("java", "public class Box {\n  private final int size;\n  public static void main(String[] args) {\n    System.out.println(1);\n  }\n}"),
    ("cpp", "#include <vector>\nint main() {\n  std::vector<int> v;\n  return 0;\n}"),
    ("sql", "select city, count(*)\nfrom orders\nwhere total > 5\ngroup by city\norder by city"),
    ("kotlin", "data class Item(val id: Int)\nfun main() {\n  val one = Item(1)\n  println(one)\n}"),
)
#: What a fence of each language says: ids, an alias, and nothing, which leaves the label to the detector.
HINTS = ("python", "R", "js", "", "java", "cpp", "sql", "kt")
EXTENSIONS = ("pdf", "docx", "md", "html", "ipynb", "txt", "TEX", "bin")


def _notebook(code: str) -> str:
    cells = [
        {"cell_type": "markdown", "source": ["# notes\n", "text"]},
        {"cell_type": "code", "source": code.splitlines(keepends=True)},
        {"cell_type": "code", "source": ["x = 1"]},
    ]
    return json.dumps({"cells": cells, "nbformat": 4})


#: Of each wrapper: what stands before and after the snippet; {t} is the document's text, {h} the hint.
WRAPPERS = (
    ("{t}\nKode program:\n", "\nOutput yang dihasilkan:\n"),
    ("{t}\nSyntax : ", "\n{t}"),
    ("{t}\n```{h}\n", "\n```\n{t}"),
    ("{t}\n~~~{h}\n", "\n~~~\nend"),
)


def corpus(documents: DataFrame) -> DataFrame:
    """(doc_id, filename, size, text)."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    kind, which = F.col("doc_id") % 6, F.floor(F.col("doc_id") / 6).cast("long") % 8

    def fill(template: str):
        out = F.lit(template)
        for name, value in (("{h}", pick(HINTS, which)), ("{t}", F.coalesce("text", F.lit("")))):
            out = F.replace(out, F.lit(name), value) if name in template else out
        return out

    text = F.coalesce("text", F.lit(""))
    for k, (before, after) in enumerate(WRAPPERS):
        text = F.when(kind == k, F.concat(fill(before), pick([s for _, s in SNIPPETS], which), fill(after))).otherwise(text)
    text = F.when(kind == 4, pick([_notebook(s) for _, s in SNIPPETS], which)).otherwise(text)
    return documents.select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), pick(EXTENSIONS, F.col("doc_id") % 8)).alias("filename"),
        text.alias("text"),
    ).select("doc_id", "filename", F.octet_length("text").cast("bigint").alias("size"), "text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def corpus_sql() -> str:
    """The same as a DuckDB query over the view documents."""
    pick = lambda values, n: f"([{', '.join(map(quoted, values))}])[({n}) + 1]"
    which = "doc_id // 6 % 8"

    def fill(template: str) -> str:
        out = quoted(template)
        for name, value in (("{h}", pick(HINTS, which)), ("{t}", "coalesce(text, '')")):
            out = f"replace({out}, '{name}', {value})" if name in template else out
        return out

    cases = " ".join(f"WHEN {k} THEN {fill(a)} || {pick([s for _, s in SNIPPETS], which)} || {fill(b)}" for k, (a, b) in enumerate(WRAPPERS))
    notebook = pick([_notebook(s) for _, s in SNIPPETS], which)
    name = f"'doc_' || doc_id || '.' || {pick(EXTENSIONS, 'doc_id % 8')}"
    return (
        f"SELECT doc_id, filename, strlen(text)::BIGINT AS size, text FROM (SELECT doc_id, {name} AS filename, "
        f"CASE doc_id % 6 {cases} WHEN 4 THEN {notebook} ELSE coalesce(text, '') END AS text FROM documents)"
    )
