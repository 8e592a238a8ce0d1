"""Best-fit packing of tokenised documents with large-item matching.

A document's ids are cut only where it is longer than a sequence; its remainder comes first,
then full pieces. Lengths are small integers, so the packing itself is done on the histogram of
lengths, which has at most ``capacity`` entries whatever the number of documents:

1. pieces of more than a third of the capacity are matched, at most two in a sequence: from the
   longest down, each is joined with the longest other large piece that still fits;
2. smaller pieces, longest first, go to the tightest gap that holds them;
3. what is left opens new sequences, filled the same way.

The result is a short list of patterns with multiplicities. A piece finds its place from its
rank among the pieces of its length; ranks are counted in each task and offset by the counts of
earlier tasks, so a length that a third of all pieces share is no hot spot.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import maybe_broadcast, written
from ._tokens import tokens

CAPACITY = 2048
END_ID = 0
#: (task, length) tables of at most so many rows are broadcast.
BROADCAST_COUNTS = 20_000


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; lengths are 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by gap
    gaps: list[int] = []

    def add(pattern: tuple[int, ...], gap: int, n: int) -> None:
        if gap not in bins or not bins[gap]:
            insort(gaps, gap)
        bins[gap][pattern] = bins[gap].get(pattern, 0) + n

    def take(gap: int, most: int) -> tuple[tuple[int, ...], int]:
        pattern, n = next(iter(bins[gap].items()))
        used = min(n, most)
        if used == n:
            del bins[gap][pattern]
            if not bins[gap]:
                gaps.remove(gap)
        else:
            bins[gap][pattern] = n - used
        return pattern, used

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            add((a,), capacity - a, left[a])
            large.pop()
            continue
        b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if not n:  # one of a kind is left; the next shorter may join it
            if at == 0:
                add((a,), capacity - a, 1)
                large.pop()
                continue
            b, n = large[at - 1], 1
        add((a, b), capacity - a - b, n)
        for x in (a, b):
            left[x] -= n
        for x in {a, b}:
            if not left[x]:
                large.remove(x)
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[size]
        while rest:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = min(rest, capacity // size)
                n = rest // each
                add((size,) * each, capacity - size * each, n)
                rest -= n * each
                continue
            gap = gaps[at]
            each = min(rest, gap // size)
            pattern, n = take(gap, rest // each)
            add(pattern + (size,) * each, gap - size * each, n)
            rest -= n * each
    return [(p, n) for gap in gaps for p, n in bins[gap].items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of runs, and the first sequence and the offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            runs[size].append((used[size], first, offset))
            used[size] += n
            offset += size
        first += n
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}


_PIECES = "own_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with their task and their number among its pieces of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(path)
        seen: dict[int, int] = defaultdict(int)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            task = b.column(2)[0].as_py() if len(b) else 0
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                n, start = len(ids) // 4, 0
                for k in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if k == 0 else capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((i, k, start, length, crc, task, seen[length]))
                    seen[length] += 1
                    start += length
            if out:
                at, *cols = zip(*out, strict=True)
                arrays = [b.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["own_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = docs.select(F.col(id_col), F.col(text_col), F.spark_partition_id().alias("own task"))
    return rows.mapInArrow(run, _PIECES.format(kind=rows.schema[0].dataType.simpleString()))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row for each piece.

    Columns: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    ``path`` is a byte-level BPE vocabulary in a ``tokenizers`` JSON file that executors can read.

    Defined cases: null and empty texts are the end id alone; repeated rows are packed each;
    ids may be null; other columns of ``docs`` are not looked at; an empty table packs to none.
    """
    # written once: the texts are tokenised a single time, and tasks and numbers are fixed
    rows = written(pieces(docs, path, id_col, text_col, capacity), "pieces")
    per = rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` lengths
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(pack_histogram(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(F.col("task").alias("b_task"), F.col("length").alias("b_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    groups = per.count()
    ranked = rows.join(maybe_broadcast(bases, groups, BROADCAST_COUNTS), (F.col("task") == F.col("b_task")) & (F.col("length") == F.col("b_length")))
    ranked = ranked.select("own_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))

    names = [*ranked.columns[:5], "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for size in np.unique(length):
                ranks, firsts, offsets = table[int(size)]
                at = np.flatnonzero(length == size)
                r = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = firsts[r] + rank[at] - ranks[r], offsets[r]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    kind = ranked.schema[0].dataType.simpleString()
    return ranked.mapInArrow(run, f"own_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("own_id", id_col)
