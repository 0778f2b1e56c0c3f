"""Operations on block lists, on selections of blocks, and look-ups of languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands between merged blocks.
SEPARATOR = "\n\n# ── next block ──\n\n"


def distinct_langs(blocks: Column) -> Column:
    return F.array_distinct(F.transform(blocks, lambda b: b["lang"]))


def langs_first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "lang").agg(F.min("index").alias("first_index"))


def filter_lang(rows: DataFrame, lang: str = "all") -> DataFrame:
    return rows if lang == "all" else rows.where(F.col("lang") == lang)


def active_block(blocks: Column, selected: Column) -> Column:
    """The first block of the language, else the first one, else null."""
    mine = F.filter(blocks, lambda b: b["lang"] == selected)
    return F.coalesce(F.try_element_at(mine, F.lit(1)), F.try_element_at(blocks, F.lit(1)))


def active_visible(blocks: Column, lang: Column, index: Column) -> Column:
    """Of the blocks that a language filter leaves, the one with the index, else the first, else null."""
    visible = F.filter(blocks, lambda b: (lang == "all") | (b["lang"] == lang))
    mine = F.filter(visible, lambda b: b["index"] == index)
    return F.coalesce(F.try_element_at(mine, F.lit(1)), F.try_element_at(visible, F.lit(1)))


def with_language(rows: DataFrame, languages: DataFrame, lang: str = "lang") -> DataFrame:
    """Label, emoji and ext of each row's language; without an entry the id, a page and txt. The 8 rows are broadcast."""
    dim = languages.select(F.col("id").alias("_id"), F.col("label").alias("_label"), F.col("emoji").alias("_emoji"), F.col("ext").alias("_ext"))
    joined = rows.join(F.broadcast(dim), rows[lang] == dim["_id"], "left")
    return joined.select(
        *(rows[c] for c in rows.columns), F.coalesce("_label", rows[lang]).alias("label"), F.coalesce("_emoji", F.lit("📄")).alias("emoji"),
        F.coalesce("_ext", F.lit("txt")).alias("ext"),
    )


def language_or_default(selected: Column, field: int, table: tuple[tuple[str, ...], ...]) -> Column:
    """A field of the selected language, or of the table's first."""
    out = F.lit(table[0][field])
    for row in table:
        out = F.when(selected == row[0], row[field]).otherwise(out)
    return out


def toggle(selection: Column, index: Column) -> Column:
    return F.when(F.array_contains(selection, index), F.array_remove(selection, index)).otherwise(F.array_append(selection, index))


def all_selected(visible: Column, selection: Column) -> Column:
    return (F.size(visible) > 0) & F.forall(visible, lambda i: F.array_contains(selection, i))


def toggle_all(visible: Column, selection: Column) -> Column:
    return F.when(all_selected(visible, selection), F.array_except(selection, visible)).otherwise(F.array_union(selection, visible))


def selected_rows(rows: DataFrame, selections: DataFrame) -> DataFrame:
    """Block rows whose index is in their document's selection: a semi join, however long the selections are."""
    chosen = selections.select(F.col("doc_id").alias("_doc"), F.explode("sel").alias("_index"))
    return rows.join(chosen, (rows["doc_id"] == chosen["_doc"]) & (rows["index"] == chosen["_index"]), "left_semi")


def merge_by_lang(rows: DataFrame) -> DataFrame:
    """A document's blocks by language, joined in block order: doc_id, lang, first_index, n_blocks, content."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "code")))
    return rows.groupBy("doc_id", "lang").agg(
        F.min("index").alias("first_index"), F.count("*").alias("n_blocks"), F.array_join(F.transform(ordered, lambda x: x["code"]), SEPARATOR).alias("content")
    )


def download_name(lang: Column, ext: Column, prefix: str = "blocks") -> Column:
    return F.concat(F.lit(prefix + "_"), lang, F.lit("."), ext)


def merged(rows: DataFrame, languages: DataFrame, prefix: str = "blocks") -> DataFrame:
    """The merged files: doc_id, filename, lang, content."""
    return with_language(merge_by_lang(rows), languages).select("doc_id", download_name(F.col("lang"), F.col("ext"), prefix).alias("filename"), "content", "lang")


def write_merged(rows: DataFrame, languages: DataFrame, path: str, prefix: str = "blocks") -> None:
    """The merged files as rows (doc_id, filename, content), in folders by language."""
    merged(rows, languages, prefix).write.partitionBy("lang").parquet(path)


def next_language(blocks: Column, previous: Column) -> Column:
    """The first block's language, unless there is none or it is unknown."""
    first = F.try_element_at(blocks, F.lit(1))["lang"]
    return F.when(first != "unknown", first).otherwise(previous)


def result_state(n_blocks: Column, error: Column) -> Column:
    return F.when(n_blocks > 0, F.concat(n_blocks.cast("string"), F.lit(" BLOK"))).when(error.isNotNull() & (error != ""), "GAGAL").otherwise("MENUNGGU")


def status_badge(ok: Column, status: Column) -> Column:
    return F.concat(F.when(ok, "✅ ").otherwise("❌ "), status)
