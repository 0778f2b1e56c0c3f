"""The registered queries of these operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from . import alignment, conversations, decontamination, exact_copies, licences, near_duplicates, packing, quality, repeated_spans, sharding, token_files, toxicity, url_rules
from .store import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where they lie in fewer partitions."""
    return spread(table(spark, sf_dir, "documents"))


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select(
        "page_id", "host", "path", "rule", "verdict", "mined"
    )


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(documents(spark, sf_dir))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.POLICIES[-1]).alias("kept"), "failed",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule costs under each policy, from the ledger's bits alone."""
    return quality.ablations(quality.ledger(documents(spark, sf_dir)))


def op3_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), every=True)


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(documents(spark, sf_dir))


def op6_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remaining(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir)).drop("spans")


def op11_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_copies.CopyIndex(spark, f"{sf_dir}/documents.parquet")
    index.update()
    return index.verdicts().select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": op1_url_rules,
    "op2_quality_ledger": op2_quality_ledger,
    "quality_ablations": quality_ablations,
    "op3_template_leaks": op3_template_leaks,
    "op4_byte_shards": op4_byte_shards,
    "op5_bag_minhash": op5_bag_minhash,
    "op6_ftrl_toxicity": op6_ftrl_toxicity,
    "op7_suffix_family": op7_suffix_family,
    "op8_token_files": op8_token_files,
    "op9_best_fit": op9_best_fit,
    "op10_licence_automaton": op10_licence_automaton,
    "op11_segment_alignment": op11_segment_alignment,
    "op12_stream_dedup": op12_stream_dedup,
    "op13_turn_fold": op13_turn_fold,
}
