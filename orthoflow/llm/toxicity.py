"""Toxicity (operator 6): FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Method: a document is the set of its hashed words, word pairs and pairs with one word between.
A bounded sample of the labelled rows is learned online, one row after the other: every coordinate
has its own rate and an L1 penalty keeps rare and weak coordinates at exactly zero. One task
streams over the sample in each epoch, holding a batch and the 2^bits states and nothing else.
The weights, sparse and of a fixed size, are broadcast for scoring all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import ALNUM, Words, mix, prepare, small, stage, word_runs

BITS = 18
#: odd factors that tell the kinds of features apart
_PAIR, _SKIP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def feature_ids(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, word pair and skip pair; coordinate 0 is the bias and
    given by nothing else."""
    h = words.hashes()
    row = words.row_of()
    shift = np.uint64(64 - bits)
    rows, ids = [row], [h >> shift]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        same = row[:-gap] == row[gap:] if len(row) > gap else np.empty(0, bool)
        first, second = h[: len(same)][same], h[gap:][: len(same)][same]
        rows.append(row[: len(same)][same])
        ids.append(mix(first * factor + second) >> shift)
    return np.concatenate(rows), np.maximum(np.concatenate(ids).astype(np.int64), 1)


class Ftrl:
    """Online learner: a weight is zero unless |z| passes l1, else scaled by its own rate."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = z, n
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def _epoch(state, bits: int, options: dict):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = (a.copy() for a in state.value)
        model = Ftrl(z, n, **options)
        for batch, words in word_runs(batches, "text", ALNUM, lower=True):
            row, ids = feature_ids(words, bits)
            both = np.unique(row << bits | ids)
            ends = np.searchsorted(both, np.arange(words.rows + 1) << bits)
            for i, label in enumerate(batch.column("label").to_pylist()):
                model.learn(np.concatenate(([0], both[ends[i] : ends[i + 1]] & ((1 << bits) - 1))), label)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32)]), pa.array([z[at]]), pa.array([n[at]])], ["at", "z", "n"])

    return train


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
    sample_rows: int = 20_000, bits: int = BITS, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0,
) -> np.ndarray:
    """Weights learned from at most ``sample_rows`` labelled rows, the first by a hash of their id.

    ``held_out`` is a condition on the label rows; those for which it is true are never read.
    Rows with a null id or label are left out; of several labels of one id the largest counts; a
    null text counts as empty. Without any labelled row all weights are 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    given = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if held_out is not None:
        given = given.filter(~held_out)
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    given = given.withColumn("turn", F.xxhash64(F.col("id").cast("string"))).orderBy("turn", "id").limit(sample_rows)
    given = stage(given, "toxicity-sample")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small(given, 40), "id")
    rows = stage(rows.select("turn", "id", "label", "text"), "toxicity-texts").repartition(1).sortWithinPartitions("turn", "id", "text")
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    options = {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
    for _ in range(epochs):
        state = spark.sparkContext.broadcast((z, n))
        for r in rows.select("label", "text").mapInArrow(_epoch(state, bits, options), "at array<int>, z array<double>, n array<double>").collect():  # one row
            z, n = z.copy(), n.copy()
            z[r["at"]], n[r["at"]] = r["z"], r["n"]
        state.unpersist()
    return Ftrl(z, n, **options).weights(slice(None)).astype(np.float32)


def _scorer(weights, text: str, bits: int, column: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch, words in word_runs(batches, text, ALNUM, lower=True):
            row, ids = feature_ids(words, bits)
            told = w[ids] != 0
            both = np.unique(row[told].astype(np.int64) << bits | ids[told])  # each feature counts once a document
            total = np.bincount(both >> bits, weights=w[both & ((1 << bits) - 1)], minlength=words.rows) + w[0]
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], [*batch.schema.names, column])

    return score


def score_toxicity(docs: DataFrame, weights: np.ndarray, text_col: str = "text", column: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with the score, 0 to 1, in ``column``; one of that name is replaced.
    A null or empty text gets the bias alone. An empty table gives an empty result."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(column)
    sent = spark.sparkContext.broadcast(weights)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {column} double"
    return docs.mapInArrow(_scorer(sent, text_col, int(np.log2(len(weights))), column), schema)
