"""The corpus pipeline: five stages over `documents`, each a step of lodestrand.llm.

Stages take (spark, docs, sf_dir). Each works on all documents that its predecessor kept, and all but the last return the
columns of `documents`. `docs` is a written table, so that a stage may read it more than once. No stage fails on null
ids or texts, empty or very long texts, repeated rows, more columns of any names, or an empty table: each says what it
makes of them, and packing gives every row that is left its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import decontamination, near_duplicates, packing, repeated_spans, toxicity
from lodestrand.llm.store import materialise, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the classifier, fitted on `labels`, says that they aren't toxic.

    Null and empty texts get the score of the bias. Rows with a null id are judged by their text; copies stand or fall together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each class of near duplicates.

    Rows without an id, and texts without words, are like nothing and stay. Rows that share an id are judged by their own
    texts; those of a class's first id all stay.
    """
    return near_duplicates.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that an earlier one has; n_chars follows the text.

    Null ids come first; rows of one id with different texts are different documents; a text may become empty, but stays.
    """
    out = repeated_spans.cut(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Rows without a text stay; those that share an id, or have none, are judged by their own texts."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null or empty text is a piece of the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("suffix-dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The stages learn weights, draw signatures and tokenize: SQL can't express them, tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the written rows of the one before; a stage's own tables go as soon as its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.pop()
    return STAGES[-1][1](spark, docs, sf_dir)
