"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs with one word between, hashed to 24 bits; nothing but the
text is an input. Training takes a bounded sample of labelled documents (SAMPLE), in one small task: every coordinate
has its own learning rate, and the L1 term leaves few weights that aren't zero. Those weights, sorted by
feature, go out with the scoring function; documents are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import ALNUM, U64, Texts, mix, slices

BITS = 24
#: Labelled documents that training takes at most: those with the smallest hashes of their ids.
SAMPLE = 16_384
EPOCHS = 5
ALPHA, BETA, L1, L2 = 8.0, 1.0, 8.0, 0.0
THRESHOLD = 0.7
_KINDS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers with the text that each stands in; a feature may come several times."""
    low = texts.lowered()
    starts, ends, owner = low.runs(ALNUM)
    words = low.hashes(low.prefix_hash(), starts, ends)
    found, owners = [], []
    for gap, salt in enumerate(_KINDS):
        n = max(0, len(words) - gap)
        keys = words * salt if gap == 0 else words[:n] * salt + (words[gap:] ^ (words[gap:] >> U64(29)))
        same = slice(None) if gap == 0 else owner[:n] == owner[gap:]
        found.append((mix(keys[same]) >> U64(64 - BITS)).astype(np.int64))
        owners.append(owner[:n][same])
    return np.concatenate(found), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """The weights that aren't zero, by ascending feature."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: Texts, known: np.ndarray) -> np.ndarray:
        """known: a boolean per feature, true where its weight isn't zero."""
        feature, owner = features(texts)
        hit = known[feature]
        once = np.unique(owner[hit] << BITS | feature[hit])
        w = self.weight[np.searchsorted(self.at, once & (1 << BITS) - 1)]
        total = self.bias + np.bincount(once >> BITS, w, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))

    def table(self) -> np.ndarray:
        known = np.zeros(1 << BITS, dtype=bool)
        known[self.at] = True
        return known


def train(examples: list[np.ndarray], labels: list[int]) -> Model:
    """FTRL-proximal over examples in their order. No examples: no weights, and a score of 0.5."""
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias = bias_n = 0.0
    for _ in range(EPOCHS):
        for x, y in zip(examples, labels):
            zi, ni = z[x], n[x]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -50, 50))) - y
            z[x] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[x] = ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    at = np.flatnonzero(np.abs(z) > L1)
    zi = z[at].astype(np.float64)
    return Model(at, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at].astype(np.float64))) / ALPHA + L2), float(bias))


def held_out(id_column: Column) -> Column:
    """The fold that training never sees; a null id counts as an empty text and is not in it."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        sample: int = SAMPLE) -> Model:
    """A model from labelled documents outside the held-out fold.

    `labels` has (label_id, toxic). Labels of one document that differ count as toxic; null labels and ids don't count.
    The sample's ids and labels are broadcast (at most `sample` rows), so no text is shuffled but the sample's. Of rows
    that share an id one is taken, whatever their number; null texts are empty; long texts are read whole. Empty tables
    give a model that scores everything 0.5. Other columns are ignored.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(label_id).isNotNull() & ~held_out(F.col(label_id)))
        .groupBy(F.col(label_id).alias("_id")).agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(3)):
                feature, owner = features(part)
                keys = np.unique(owner << BITS | feature)
                parts = np.split((keys & (1 << BITS) - 1).astype("<u4"), np.searchsorted(keys >> BITS, np.arange(1, len(part))))
                rows = [c.slice(part.row, len(part)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([p.tobytes() for p in parts], pa.binary())], ["_id", "place", "toxic", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, toxic = [], []
        for batch in batches:
            toxic += batch.column(1).to_pylist()
            examples += [np.frombuffer(x, dtype="<u4") for x in batch.column(2).to_pylist()]
        model = train(examples, toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.at.astype("<u4").tobytes()], pa.binary()), pa.array([model.weight.astype("<f8").tobytes()], pa.binary()), pa.array([model.bias])],
            ["at", "weight", "bias"],
        )

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    examples = (
        texts.join(F.broadcast(chosen), "_id")
        .select("_id", F.xxhash64("_id", "text").alias("place"), F.col("_toxic").cast("int").alias("toxic"), "text")
    )
    # An id's rows are one example, the one with the least hash: so no more than the sample's rows reach the one task.
    id_type = docs.schema[id_col].dataType.simpleString()
    examples = examples.mapInArrow(look, f"_id {id_type}, place bigint, toxic int, features binary")
    examples = examples.groupBy("_id").agg(F.min(F.struct("place", "toxic", "features")).alias("x")).select("x.*")
    row = examples.repartition(1).sortWithinPartitions("place", "toxic").mapInArrow(learn, "at binary, weight binary, bias double").first()
    if row is None:
        return train([], [])
    return Model(np.frombuffer(row.at, "<u4").astype(np.int64), np.frombuffer(row.weight, "<f8"), row.bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs: the chance in 0..1 that the whole text is toxic.

    Null and empty texts have no features and get the score of the bias. Repeated rows and null ids each get a score. Texts of
    any length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.table()
        for batch in batches:
            for part in slices(batch.column(1)):
                ids = batch.column(0).slice(part.row, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(part, known))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold.

    Null and empty texts score the bias, so they stay unless that reaches the threshold. Repeated rows and null ids are judged by
    their text alone. Columns of any names are kept. An empty table gives no rows.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.table()
        for batch in batches:
            scores = [model.scores(part, known) for part in slices(batch.column(place))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
