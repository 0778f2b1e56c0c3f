"""The whole extraction: documents -> blocks with an envelope per document.

Failures are rows with a status and an error, not failed jobs. No step shuffles; the first strategy that finds
something wins, and each is a projection of its own so that its result is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import line_count, trim
from ..operators.strategies import anchor_blocks, fence_blocks, notebook_blocks

#: The errors of the envelope.
NO_FILE, EMPTY, NOTHING = "Tidak ada file yang dikirim", "File kosong atau tidak dapat dibaca", "Tidak ditemukan kode dalam dokumen ini"
FAILED = "Gagal memproses file"


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, filename, size, text, ...) with blocks array<struct<index, lang, code, lines>>, total, status and error.

    A null filename is a missing file (400), an `error` column that isn't null a failed reading (500), a null or blank
    text is empty (422), a text without blocks is not found (404). Blocks are null but for status 200.
    """
    failed = F.col("error").isNotNull() if "error" in docs.columns else F.lit(False)
    message = F.coalesce("error", F.lit(FAILED)) if "error" in docs.columns else F.lit(FAILED)
    base = docs.withColumn("_why", F.when(F.col("filename").isNull(), 400).when(failed, 500).when(F.coalesce(trim(F.col("text")), F.lit("")) == "", 422))
    if "error" in docs.columns:
        base = base.withColumn("_message", message).drop("error")
    else:
        base = base.withColumn("_message", message)
    text = F.when(F.col("_why").isNull(), F.col("text"))
    none = F.array().cast("array<struct<lang:string,code:string>>")
    found = base.withColumn("_one", F.coalesce(anchor_blocks(text), none))
    found = found.withColumn("_two", F.when(F.size("_one") > 0, F.col("_one")).otherwise(F.coalesce(fence_blocks(text), none)))
    found = found.withColumn("_found", F.when(F.size("_two") > 0, F.col("_two")).otherwise(notebook_blocks(text)))
    # Of one array, one row: filters on the results don't pass this, as they would evaluate the strategies once more each.
    found = found.withColumn("_all", F.explode_outer(F.array("_found")))
    blocks = F.transform(
        "_all", lambda b, i: F.struct(i.alias("index"), b["lang"].alias("lang"), b["code"].alias("code"), line_count(b["code"]).alias("lines"))
    )
    status = F.coalesce("_why", F.when(F.size("_all") > 0, 200).otherwise(404))
    errors = F.when(status == 400, NO_FILE).when(status == 422, EMPTY).when(status == 404, NOTHING).when(status == 500, F.col("_message"))
    return found.select(
        *(c for c in docs.columns if c not in ("error", "blocks", "total", "status")),
        F.when(status == 200, blocks).alias("blocks"), F.when(status == 200, F.size("_all")).alias("total"),
        status.alias("status"), errors.alias("error"),
    )


STATUSES = (200, 400, 404, 422, 500)


def observed(extracted: DataFrame, langs: tuple[str, ...]) -> tuple[DataFrame, Callable[[], list[tuple[str, str, int]]]]:
    """extracted, and a function for its counts, (kind, name, n) by status and by language, that are more than 0.

    The counts are metrics of whatever action runs over the rows first, and wait for it: they cost no job of their own.
    Languages are those of the list; others, which there are none of with the detector's own, count as ''.
    """
    watch = Observation()
    by_status = {f"status {s}": F.count_if(F.col("status") == s) for s in STATUSES}
    named = lambda name: F.size(F.filter("blocks", lambda b: b["lang"] == name))
    by_lang = {f"lang {name}": F.sum(F.coalesce(named(name), F.lit(0))) for name in langs}
    other = F.sum(F.coalesce(F.size(F.filter("blocks", lambda b: ~b["lang"].isin(*langs))), F.lit(0)))
    rows = extracted.observe(watch, *(c.cast("long").alias(n) for n, c in (by_status | by_lang | {"lang ": other}).items()))
    return rows, lambda: [(*key.split(" ", 1), n) for key, n in watch.get.items() if n]


def block_rows(extracted: DataFrame) -> DataFrame:
    """One row per block: doc_id, index, lang, code, lines.

    The outer explode keeps Spark from inferring a filter on `blocks`, which would evaluate the strategies twice.
    """
    rows = extracted.select("doc_id", F.explode_outer("blocks").alias("b")).where(F.col("b").isNotNull())
    return rows.select("doc_id", "b.index", "b.lang", "b.code", "b.lines")
