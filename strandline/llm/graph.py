"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written

#: Least neighbours of at most so many nodes are broadcast.
BROADCAST_NODES = 100_000


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row.n, row.x


def _matched(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with the least neighbour of u. There are at most twice as many nodes as edges;
    if these are many, the least neighbours are written, so that Spark can split a node that
    has a large share of all edges."""
    few = 2 * edges <= BROADCAST_NODES
    return rows.join(F.broadcast(least) if few else written(least, "least"), F.col("u") == F.col("w"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of a node moves to the least node of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return _matched(both.filter("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    moved = _matched(down, least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node it is linked with.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest
    path. No edge set, component or label comes to the driver. Loops and repeats are ignored.
    """
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before, state = None, _checksum(now)
    while state != before and state[0]:
        following = written(_small_star(_large_star(now, state[0]), state[0]), "edges")
        drop_written(now)
        now, before, state = following, state, _checksum(following)
    # the last edges stay until the caller has read them
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))
    return now.select(ends.alias("e")).groupBy(F.col("e.node").alias("node")).agg(F.min("e.root").alias("root"))
