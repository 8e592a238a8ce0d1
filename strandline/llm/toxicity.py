"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, word pairs, and pairs with one word between,
hashed to 2**BITS coordinates. A word counts in full and by its beginnings, so that what is
learned of a stem holds for its inflected forms. Training keeps two numbers for each coordinate, so each has a
learning rate of its own, and the L1 term leaves most weights at exactly zero: what is sent to
the executors is the short list of the others.

Training is one pass after another over a bounded sample of labelled rows (``max_labelled``,
those of the documents at hand with the smallest hashes of their ids), in one task, in hash order: the model doesn't
depend on partitioning. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh
from ._text import fold, mix, word_hashes

BITS = 20
#: Bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6)
#: Labelled rows to learn from, at most.
MAX_LABELLED = 20_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1
EPOCHS = 8
#: A text is predicted toxic from this score on.
THRESHOLD = 0.3
_BIAS = 1 << BITS


def held_out(doc_id: Column) -> Column:
    """True for ids that are kept from learning: CRC32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def coordinates(text: str | None) -> np.ndarray:
    """Coordinates of all n-grams of a text, in text order, with repeats."""
    w, *stems = word_hashes(fold(text), BEGINNINGS)
    pairs = mix(w[:-1] * np.uint64(0xD6E8FEB86659FD93) + w[1:] * np.uint64(0xA0761D6478BD642F))
    skips = mix(w[:-2] * np.uint64(0xE7037ED1A0B428DB) + w[2:] * np.uint64(0x8EBC6AF09C88C6E3))
    return (np.concatenate([w, pairs, skips, *stems]) >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]] | _Sample, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and their weights, the bias last; rows: (distinct coordinates, 0 or 1)."""
    z, n = np.zeros(_BIAS + 1), np.zeros(_BIAS + 1)
    toxic = sum(y for _, y in rows)
    start = np.log((toxic + 0.5) / (len(rows) - toxic + 0.5))
    bias, bias_n = start, 0.0
    for _ in range(epochs):
        for at, y in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    at = np.flatnonzero(w)
    return np.append(at, _BIAS).astype(np.int32), np.append(w[at], bias)


def score_text(text: str | None, weights: np.ndarray) -> float:
    at = coordinates(text)
    at = np.unique(at[weights[at] != 0])
    return float(1 / (1 + np.exp(-np.clip(weights[at].sum() + weights[_BIAS], -35, 35))))


def compact(at: np.ndarray) -> bytes:
    """Sorted coordinates: how many there are of each upper part, then their lower 16 bits."""
    uppers = np.bincount(at >> 16, minlength=1 << (BITS - 16)).astype("<u4")
    return uppers.tobytes() + at.astype("<u2").tobytes()


def expand(coded: np.ndarray) -> np.ndarray:
    """The coordinates of bytes that :func:`compact` made."""
    head = 4 << (BITS - 16)
    uppers = np.repeat(np.arange(1 << (BITS - 16), dtype=np.int32) << 16, coded[:head].view("<u4"))
    return uppers | coded[head:].view("<u2")


class _Sample:
    """Rows for :func:`ftrl` whose coordinates are expanded as they are read."""

    def __init__(self, rows: list[tuple[np.ndarray, int]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        return ((expand(coded), y) for coded, y in self.rows)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [compact(np.unique(coordinates(t))) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["place", "y", "at"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        # views of the batch: the sample is held once
        coded = b.column(2)
        ends = np.frombuffer(coded.buffers()[1], dtype=np.int32)[coded.offset : coded.offset + len(coded) + 1]
        data = np.frombuffer(coded.buffers()[2], dtype=np.uint8) if coded.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        rows += [(data[i:j], y) for i, j, y in zip(ends, ends[1:], b.column(1).to_pylist(), strict=False)]
    if rows:
        at, w = ftrl(_Sample(rows))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED
) -> np.ndarray | None:
    """Dense weights (bias last), or None if there is no labelled row to learn from.

    Null labels and null ids teach nothing; of several labels of one id the largest holds.
    """
    place = F.xxhash64(id_col)
    # labels of documents that aren't there take no places of the sample
    there = docs.select(F.col(id_col).alias("d_id"))
    sample = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
        .join(there, F.col(id_col) == F.col("d_id"), "left_semi")
        .orderBy(place, id_col).limit(max_labelled)
        .select(F.col(id_col).alias("l_id"), "y")
    )
    # the sample has at most max_labelled rows of two numbers
    narrow = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"))
    rows = narrow.join(F.broadcast(sample), F.col("d_id") == F.col("l_id")).select(F.xxhash64("d_id").alias("place"), "y", "text")
    coded = rows.mapInArrow(_encode, "place long, y int, at binary")
    found = coded.repartition(1).sortWithinPartitions("place", "at").mapInArrow(_learn, "at int, w double").toPandas()
    if found.empty:
        return None
    weights = np.zeros(_BIAS + 1)
    weights[found["at"].to_numpy()] = found["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``: the probability that the label is 1.

    Null and empty texts have no features and score the bias; without a model all score 0. A
    column of that name in ``docs`` is replaced.
    """
    if weights is None:
        return docs.withColumn(score_col, F.lit(0.0))
    at = np.flatnonzero(weights)
    sparse = (at.astype(np.int32), weights[at])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(_BIAS + 1)
        dense[sparse[0]] = sparse[1]
        for texts in batches:
            yield pa.array([score_text(t, dense) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(run, "double")(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every row of ``docs``.

    Defined cases: null and empty texts score the model's bias; null ids aren't held out; repeated rows
    are scored each; without labelled rows to learn from all score 0; other columns aren't looked
    at; an empty table gives no rows.
    """
    weights = train(docs, labels, id_col=id_col, text_col=text_col)
    own, text = fresh(docs, "own_id", "own_text")
    narrow = docs.select(F.col(id_col).alias(own), F.col(text_col).alias(text))
    return score(narrow, weights, text, "score").select(
        F.col(own).alias("doc_id"), held_out(F.col(own)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns, whatever their names.
    Defined cases: as of :func:`toxicity`."""
    (own,) = fresh(docs, "score")
    return score(docs, train(docs, labels), "text", own).filter(F.col(own) < THRESHOLD).drop(own)
