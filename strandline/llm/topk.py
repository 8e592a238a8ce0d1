"""Exact top-k inner-product search by vector-approximation files.

Vectors stand for integers, floor(64 * x). Two tables are written: the exact vectors, and an
approximation file with one row for each block of vectors, which keeps for every component the
cell that it lies in, 2**BITS cells of equal width between the block's least and greatest
integer of that component. From the cells alone a score lies within a radius of the product of
the query with the cells' centres. Scans read cells only; exact vectors are then read by position:

1. a scan finds, for every query, the k vectors with the highest lower bounds; their exact scores
   are read, and the least of the k is a threshold that the k-th best score can't be under;
2. a second scan keeps the vectors whose upper bounds reach the threshold, and their exact vectors
   are read too. No vector that is left can be among the k best, ties included, so the result is
   certain.

The stated queries are broadcast in rounds of at most MAX_QUERIES vectors; a round's results are
written and its broadcast is released before the next one. A scan's tasks are bounded in number,
so what they send for each query doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_written, written

SCALE = 64
#: Bits of a cell number.
BITS = 6
#: Queries of a round, at most; what is broadcast is bounded by this many vectors.
MAX_QUERIES = 8_192
#: Queries that a task compares with a block at a time, and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4_096
#: Tasks of a scan, at most; each sends k rows for a query.
SCAN_TASKS = 256
#: Vectors of a scan's task, at least, where there are fewer tasks.
ROWS_PER_TASK = 2_048
#: Integers beyond this have no cells; their vectors are read exactly for every query.
_WIDE = 2.0**100
_LONG = (1 << 63) - 1


def floors(vectors: list[list], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as float64, which holds it exactly; shorter vectors are filled with zeros."""
    wide = max(map(len, vectors), default=0)
    if all(len(v) == wide for v in vectors):
        x = np.array(vectors, dtype=np.float64).reshape(len(vectors), wide)
    else:
        x = np.array([[*v, *[0.0] * (wide - len(v))] for v in vectors], dtype=np.float64)
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


class Cells:
    """A block of vectors as cells. ``low`` and ``step``: the first integer and the integers of a
    cell of each component; ``cells``: one byte for each component of each vector."""

    def __init__(self, low: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.low, self.step, self.cells = low, step, cells
        self.half = (step - 1) / 2
        self.centres = low + cells * step + self.half

    @classmethod
    def of(cls, x: np.ndarray, bits: int = BITS) -> Cells:
        low, high = x.min(axis=0), x.max(axis=0)
        step = np.maximum(1.0, np.ceil((high - low + 1) / (1 << bits)))
        return cls(low, step, np.minimum((x - low) // step, (1 << bits) - 1).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries with centres, and each query's radius: scores lie within it."""
        wide = max(queries.shape[1], self.centres.shape[1])
        queries, centres = _fill(queries, wide), _fill(self.centres, wide)
        most = float(np.abs(centres).max(initial=0)) + float(self.half.max(initial=0))
        kind = np.float32 if most < 1 << 16 and float(np.abs(queries).max(initial=0)) < 1 << 16 else np.float64
        size = np.abs(queries).sum(axis=1)
        # what the rounding of sums and products may add
        slack = size * most * (wide + 2) * float(np.finfo(kind).eps)
        return queries.astype(kind) @ centres.astype(kind).T, size_by(queries, self.half, wide) + slack + 1e-9


def size_by(queries: np.ndarray, half: np.ndarray, wide: int) -> np.ndarray:
    return np.abs(queries) @ np.pad(half, (0, wide - len(half)))


def _fill(x: np.ndarray, wide: int) -> np.ndarray:
    return x if x.shape[1] >= wide else np.hstack([x, np.zeros((len(x), wide - x.shape[1]), dtype=x.dtype)])


def exact_scores(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Inner products of rows of integers, held within a long."""
    wide = max(q.shape[1], v.shape[1])
    q, v = _fill(q, wide), _fill(v, wide)
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, wide) < 2.0**53:
        return (q * v).sum(axis=1).astype(np.int64).tolist()
    return [max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(q, v, strict=True)]


def approximation(exact: DataFrame, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """The approximation file of (pos, v): for each block its positions, low, step and cells. Vectors
    with integers that are too great have positions alone."""

    def row(pos: list[int], x: np.ndarray | None) -> pa.RecordBatch:
        made = None if x is None else Cells.of(x, bits)
        pack = lambda a: None if made is None else a(made).tobytes()
        values = [np.array(pos, dtype=np.int64).tobytes(), pack(lambda c: c.low), pack(lambda c: c.step), pack(lambda c: c.cells)]
        return pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in values], names=["pos", "low", "step", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), VECTOR_BLOCK):
                part = b.slice(at, VECTOR_BLOCK)
                pos = np.array(part.column(0).to_pylist(), dtype=np.int64)
                x = floors(part.column(1).to_pylist(), scale)
                fits = (np.abs(x) < _WIDE).all(axis=1)
                if fits.any():
                    yield row(pos[fits], x[fits])
                if not fits.all():
                    yield row(pos[~fits], None)

    return exact.select("pos", "v").mapInArrow(run, "pos binary, low binary, step binary, cells binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Cells | None]]:
    for b in batches:
        for pos, low, step, cells in zip(*[c.to_pylist() for c in b.columns], strict=True):
            at = np.frombuffer(pos, dtype=np.int64)
            if cells is None:
                yield at, None
            else:
                yield at, Cells(np.frombuffer(low), np.frombuffer(step), np.frombuffer(cells, dtype=np.uint8).reshape(len(at), -1))


def _others(own: np.ndarray, pos: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``of`` (queries by vectors) with minus infinity where a query meets its own row."""
    order = np.argsort(pos, kind="stable")
    at = np.searchsorted(pos[order], own)
    there = np.flatnonzero(at < len(pos))
    there = there[pos[order[at[there]]] == own[there]]
    of[there, order[at[there]]] = -np.inf
    return of


def _highest_lower(batches: Iterator[pa.RecordBatch], own: np.ndarray, queries: np.ndarray, tame: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(q, pos, lower): the k vectors with the highest lower bounds of this task, for each query."""
    best = np.full((len(own), k), -np.inf)
    held = np.full((len(own), k), -1, dtype=np.int64)
    for pos, cells in _blocks(batches):
        for start in range(0, len(own), QUERY_BLOCK):
            part = slice(start, start + QUERY_BLOCK)
            if cells is None:
                # nothing is known of these scores but that they are there
                lower = np.full((len(own[part]), len(pos)), -1e300)
            else:
                base, radius = cells.bounds(queries[part])
                lower = base.astype(np.float64) - radius[:, None]
                lower[~tame[part]] = -1e300
            lower = _others(own[part], pos, lower)
            both = np.hstack([best[part], lower])
            ids = np.hstack([held[part], np.broadcast_to(pos, lower.shape)])
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best[part], held[part] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
    q, at = np.nonzero(best > -np.inf)
    yield pa.RecordBatch.from_pydict({"q": pa.array(q.astype(np.int32)), "pos": held[q, at], "lower": best[q, at]})


def _reaching(batches: Iterator[pa.RecordBatch], own: np.ndarray, queries: np.ndarray, tame: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(q, pos): the vectors whose upper bounds reach each query's threshold."""
    for pos, cells in _blocks(batches):
        for start in range(0, len(own), QUERY_BLOCK):
            part = slice(start, start + QUERY_BLOCK)
            if cells is None:
                upper = np.full((len(own[part]), len(pos)), np.inf)
            else:
                base, radius = cells.bounds(queries[part])
                upper = base.astype(np.float64) + radius[:, None]
                upper[~tame[part]] = np.inf
            upper = _others(own[part], pos, upper)
            q, at = np.nonzero((upper >= least[part, None]) & (upper > -np.inf))
            if len(q):
                yield pa.RecordBatch.from_pydict({"q": pa.array((q + start).astype(np.int32)), "pos": pos[at]})


def _scored(pairs: DataFrame, exact: DataFrame, sent, scale: int) -> DataFrame:
    """Pairs (q, pos) with vec_id and the exact score, which is computed from the exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value[1]
        for b in batches:
            if len(b):
                q = b.column(0).to_numpy()
                scores = exact_scores(queries[q], floors(b.column(2).to_pylist(), scale))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.int64())], names=["q", "vec_id", "score"])

    read = pairs.join(exact.select(F.col("pos").alias("e_pos"), "vec_id", "v"), F.col("pos") == F.col("e_pos"))
    return read.select("q", "vec_id", "v").mapInArrow(run, "q int, vec_id long, score long")


def exact_topk(
    vectors: DataFrame, asked: Column | str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, bits: int = BITS, max_queries: int = MAX_QUERIES
) -> DataFrame:
    """The k other rows of ``vectors`` with the highest inner products, for every row where ``asked`` holds.

    Columns: query_id, rank (from 1), vec_id, score. Ties go to the smaller id. Only the query's own
    row is no candidate of it.

    Defined cases: null vectors, those with null or non-finite components and rows with null ids
    take no part; shorter vectors are filled with zeros; rows are told apart by their place, so
    repeated ids are candidates each, also of each other, and queries each; scores beyond a long are held
    at its ends; with fewer than k others, all are returned; other columns aren't looked at; empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(F.expr(asked) if isinstance(asked, str) else asked, F.lit(False)).alias("asked"))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", whole))
    exact = written(rows.withColumn("pos", F.monotonically_increasing_id()), "vectors")
    total, n = exact.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0))).first()
    # a scan has few tasks, however long the table is
    tasks = max(1, min(-(-total // ROWS_PER_TASK), SCAN_TASKS))
    cells = written(approximation(exact.coalesce(tasks), scale, bits), "vector-cells")
    rounds = max(1, -(-n // max_queries))
    found = None
    for r in range(rounds):
        # a round's queries are at most about max_queries vectors
        now = exact.filter("asked").filter(F.pmod(F.xxhash64("pos"), F.lit(rounds)) == r).select("pos", "vec_id", "v").toArrow()
        own, queries = np.array(now.column(0).to_pylist(), dtype=np.int64), floors(now.column(2).to_pylist(), scale)
        if not len(own):
            continue
        named = np.array(now.column(1).to_pylist(), dtype=np.int64)
        # the sums of wilder queries aren't bounded: all rows are read for them
        tame = (np.abs(queries) < _WIDE).all(axis=1)
        sent = spark.sparkContext.broadcast((own, queries, tame))

        def first(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _highest_lower(batches, *sent.value, k)

        scan = cells.coalesce(tasks)
        likely = scan.mapInArrow(first, "q int, pos long, lower double")
        order = Window.partitionBy("q").orderBy(F.col("lower").desc(), "pos")
        likely = likely.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("q", "pos")
        # one threshold for each query of the round; a query with fewer than k others reads them all
        sure = _scored(likely, exact, sent, scale).groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        least = np.full(len(own), -np.inf)
        for t in sure.toLocalIterator():
            least[t.q] = float(t.least)
        # a score that a double can't hold counts as the next lower one
        least = np.where(np.abs(least) >= 2.0**53, np.nextafter(least, -np.inf), least)
        limits = spark.sparkContext.broadcast(least)

        def second(batches: Iterator[pa.RecordBatch], sent=sent, limits=limits) -> Iterator[pa.RecordBatch]:
            return _reaching(batches, *sent.value, limits.value)

        scored = _scored(scan.mapInArrow(second, "q int, pos long"), exact, sent, scale)
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"n_q": pa.array(np.arange(len(own), dtype=np.int32)), "query_id": named}))
        best = best.join(F.broadcast(names), F.col("q") == F.col("n_q")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best = written(best, "neighbours")
        sent.destroy()
        limits.destroy()
        found = best if found is None else found.unionByName(best)
    drop_written(exact)
    drop_written(cells)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found
