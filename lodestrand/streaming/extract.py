"""The extraction over a stream of documents: the same projection, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.extract import block_rows, extract


def extract_stream(docs: DataFrame) -> DataFrame:
    """Block rows of a streaming DataFrame with (doc_id, filename, size, text)."""
    return block_rows(extract(docs))
