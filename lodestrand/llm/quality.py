"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule, so
any policy (a named, versioned set of rules) is a mask: a document passes when no masked bit is set. Changing
policy, comparing versions and asking what a rule costs never read the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import NOT_NEWLINE, NOT_SPACE, U64, Texts, byte_class, mix, slices, windows

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs",
)

#: Bit position by place; SQL over the measurements, true where the rule fails.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "3 * n_bangs > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))
BANG = byte_class((0x21, 0x21))
#: First bytes of characters; the rest are UTF-8 continuation bytes.
CHARS = ~byte_class((0x80, 0xBF))


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("prose", 1, (*BASE.rules, "symbols", "duplicate_lines")),
    Policy("prose", 2, (*BASE.rules, "symbols", "duplicate_lines", "shouting", "short_words", "long_words")),
)


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The measurements of each text. Words are runs without ASCII white space; hashes stand for equal words and lines."""
    n, data = len(texts), texts.data
    per_text = lambda owner, weights=None: np.bincount(owner, weights, minlength=n).astype(np.int64)
    sums = texts.prefix_hash()
    starts, ends, owner = texts.runs(NOT_SPACE)
    chars = np.concatenate(([0], np.cumsum(CHARS[data] & NOT_SPACE[data])))
    symbols, bangs = (np.concatenate(([0], np.cumsum(table[data]))) for table in (SYMBOLS, BANG))
    of_texts = lambda running: np.diff(running[texts.bounds]).astype(np.int64)

    line_starts, line_ends, line_owner = texts.runs(NOT_NEWLINE)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[worded], line_ends[worded], line_owner[worded]
    lines = texts.hashes(sums, line_starts, line_ends) ^ mix(line_owner.astype(U64))
    again = pd.Series(lines).duplicated().to_numpy()

    keys, at = windows(texts.hashes(sums, starts, ends), owner, 3)
    keys = keys ^ mix(owner[at].astype(U64))
    twice = at[pd.Series(keys).duplicated(keep=False).to_numpy()]
    covered = np.zeros(len(starts), dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": per_text(owner),
        "word_chars": of_texts(chars),
        "n_symbols": of_texts(symbols),
        "n_dup_lines": per_text(line_owner[again]),
        "n_repeat_words": per_text(owner[covered]),
        "n_lines": per_text(line_owner),
        "n_bangs": of_texts(bangs),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements, in one pass over the texts and without a shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = measure(part)
                ids = batch.column(0).slice(part.row, len(part))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES])

    schema = f"doc_id {id_type}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed`, with bit k set where rule k fails.

    A null text counts as empty: no words, so it fails few_words alone of the ratio rules, which are written as
    products and hold for zero words. Repeated rows and null ids each give their own row; texts of any length are read whole;
    an empty table gives no rows; other columns are ignored.
    """
    bits = " + ".join(f"(case when {test} then {BIT[name]} else 0 end)" for name, test in RULES)
    return measured(docs, id_col, text_col).withColumn("failed", F.expr(f"bigint({bits})"))


def passes(policy: Policy, failed: str = "failed"):
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def histogram(book: DataFrame) -> DataFrame:
    """Documents by bit pattern: at most 2**rules rows, from which any policy's figures follow."""
    return book.groupBy("failed").agg(F.count("*").alias("n_docs"))


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that fail it alone, and that the policy keeps."""
    entries = [
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).alias("mask"),
                 F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"))
        for p in policies for r in p.rules
    ]
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n_docs"))), F.lit(0))
    return (
        histogram(book)
        .select("failed", "n_docs", F.inline(F.array(*entries)))
        .groupBy("policy", "version", "rule")
        .agg(
            count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            count(hit == F.col("bit")).alias("n_failed_alone"),
            count(hit == 0).alias("n_kept"),
        )
    )
