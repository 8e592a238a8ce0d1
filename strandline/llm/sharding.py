"""Byte-balanced sharding by histogram sort (built-in DataFrame functions only).

Rows are ordered by a 128-bit composite key: a hash of the whole text, then a row hash
that tells equal texts apart. Splitters are keys such that the bytes below the i-th are
i/n of all bytes. They are found by counting, not by sampling: every round counts the exact
bytes below a set of evenly spaced candidate boundaries in each splitter's bracket, one
aggregate over all partitions, and keeps the one sub-interval that holds the target, until
the bytes below a boundary are within the tolerance. If a bracket has shrunk to one value of
the text hash (a group of copies that is larger than the tolerance), probing goes on over
the row hash, so such a group is cut as evenly as any other.
Rows then move once, each to the partition of its shard and salt, and are sorted by key there, so
that the same files read alike give the same slots.

Equal texts are neighbours in the key order: a group of copies stays in one shard unless a
splitter has to cut it to keep the law of equal bytes.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ._shared import drop_written, fresh, maybe_broadcast, written

#: Each round places 2**_BITS candidate boundaries in each splitter's bracket.
_BITS = 8
#: Bytes that a boundary may be off its target, as a share of one shard.
TOLERANCE = 0.001
#: Rows for each partition of the exchange.
ROWS_PER_PARTITION = 200_000
#: Names of the two parts of the key in the table that splitters are found for.
K1, K2 = "k1", "k2"
_LO, _HI = -(1 << 63), (1 << 63) - 1


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


class _Splitter:
    """The bracket of one splitter: the keys that share a prefix (all bits above ``shift``).

    A boundary b of level 0 stands for all rows with k1 < b, one of level 1 for the rows with
    k1 < pin, and those with k1 = pin and k2 < b.
    """

    def __init__(self, target: float):
        self.target, self.level, self.pin = target, 0, 0
        self.shift, self.lo, self.below, self.done = 64, _LO, 0, False

    def key(self) -> Column:
        return F.col(K2) if self.level else F.col(K1)

    def inside(self) -> Column:
        out = F.col(K1) == F.lit(self.pin) if self.level else F.lit(True)
        if self.shift < 64:
            out = out & (F.shiftright(self.key(), self.shift) == F.lit(self.lo >> self.shift))
        return out

    def interval(self) -> Column:
        """Index of the last probe at or below a key inside the bracket."""
        return F.shiftright(self.key(), self.shift - _BITS) - F.lit(self.lo >> (self.shift - _BITS))

    def narrow(self, counts: dict[int, Row], tolerance: float) -> None:
        """Keep the interval between two probes that holds the target, or stop at a probe near it."""
        step, below = 1 << (self.shift - _BITS), self.below
        for i in sorted(counts):
            r, lo = counts[i], self.lo + i * step
            if below + r.b < self.target:
                below += r.b
                continue
            near, far = self.target - below, below + r.b - self.target
            # a single row can't be cut: one of its sides is the best there is
            if min(near, far) <= tolerance or r.n == 1:
                self.below = below + r.b * (far < near)
                self.lo, self.done = lo + step * (far < near), True
            elif r.lo == r.hi and not self.level:
                self.level, self.pin, self.below = 1, r.lo, below
                self.shift, self.lo = 64, _LO
            else:
                self.shift, self.lo, self.below = self.shift - _BITS, lo, below
                self.done = self.shift == 0
            return
        self.lo, self.done = self.lo + (1 << self.shift), True

    def passed(self, k1: Column, k2: Column) -> Column:
        """True for the rows at or above the splitter."""
        at = (k2 if self.level else k1) >= F.lit(self.lo) if self.lo <= _HI else F.lit(False)
        return (k1 > F.lit(self.pin)) | ((k1 == F.lit(self.pin)) & at) if self.level else at


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[_Splitter], int, int]:
    """Splitters of a table (K1 long, K2 long, size long), the bytes and the rows of all of it.

    Every round is one pass with a partial aggregate of at most ``(shards - 1) * 2**_BITS``
    sums for each task, so what reaches the driver doesn't grow with the rows.
    """
    whole = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    found = [_Splitter(whole.b * i / shards) for i in range(1, shards)]
    while open_now := [(i, s) for i, s in enumerate(found) if not s.done]:
        # brackets can coincide, so a row can count for several splitters
        slots = F.array(*[
            F.when(s.inside(), F.struct(F.lit(i).alias("s"), s.interval().alias("p"), s.key().alias("k")))
            for i, s in open_now
        ])
        rows = (
            keys.filter(reduce(or_, [s.inside() for _, s in open_now]))
            .select("size", F.explode(F.array_compact(slots)).alias("at"))
            .groupBy("at.s", "at.p")
            .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("at.k").alias("lo"), F.max("at.k").alias("hi"))
            .collect()
        )
        for i, s in open_now:
            s.narrow({r.p: r for r in rows if r.s == i}, tolerance * whole.b / shards)
    return found, whole.b, whole.n


def histogram_shard(
    df: DataFrame,
    shards: int = 8,
    text_col: str = "text",
    keep: list[str] | None = None,
    tolerance: float = TOLERANCE,
    rows_per_partition: int = ROWS_PER_PARTITION,
) -> DataFrame:
    """Put every row of ``df`` into shards 0 to ``shards - 1`` of nearly equal bytes.

    ``keep``: the columns to carry (all, if None). Added columns: ``size`` (UTF-8 bytes of the
    text plus 1), ``text_crc32`` (unsigned), ``shard``, and ``slot``, the row's place in its
    shard, gapless from 0. Columns of the same names in ``df`` are replaced.

    Defined cases: a null text counts as no bytes (size 1, CRC 0); equal texts are neighbours,
    and equal rows are told apart by a row number; nulls in other columns are carried as they
    are; an empty table gives an empty result; with fewer rows than shards some stay empty.
    """
    keep = [f"`{c}`" for c in (df.columns if keep is None else keep) if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    text = F.col(text_col)
    k1, k2, part, pid, at, first, s_first, p_first = fresh(df, "shard key", "shard row key", "part", "pid", "at", "first", "s_first", "p_first")
    named = df.select(
        *keep,
        byte_size(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias(k1),
        F.xxhash64(F.monotonically_increasing_id()).alias(k2),
    )
    # k2 depends on the place of the row, so it is fixed by writing it once
    rows = written(named, "shard-keys")
    found, _, n = splitters(rows.select(F.col(k1).alias(K1), F.col(k2).alias(K2), "size"), shards, tolerance)
    salts = max(1, math.ceil(n / shards / rows_per_partition))
    shard = F.lit(0)
    for s in found:
        shard = shard + s.passed(F.col(k1), F.col(k2)).cast("int")
    sharded = rows.select(*keep, "size", "text_crc32", k1, k2).withColumn("shard", shard.cast("int"))
    # the one exchange: each shard owns ``salts`` partitions, and k2 deals its rows over them
    moved = sharded.withColumn(part, (F.col("shard") * salts + F.pmod(F.col(k2), F.lit(salts))).cast("int"))
    moved = moved.repartitionById(shards * salts, F.col(part)).sortWithinPartitions(k1, k2).drop(k1, k2)
    placed = written(
        moved.withColumn(pid, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "shard-rows",
    )
    drop_written(rows)
    per = placed.groupBy("shard", F.col(pid).alias("pid")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition of the exchange: its number is known, so the broadcast is bounded
    offsets = per.selectExpr(
        f"shard AS {s_first}", f"pid AS {p_first}",
        f"coalesce(sum(n) OVER (PARTITION BY shard ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {first}",
    )
    offsets = maybe_broadcast(offsets, shards * salts)
    return (
        placed.join(offsets, (F.col("shard") == F.col(s_first)) & (F.col(pid) == F.col(p_first)))
        .select(*keep, "size", "text_crc32", "shard", (F.col(first) + F.col(at)).cast("long").alias("slot"))
    )
