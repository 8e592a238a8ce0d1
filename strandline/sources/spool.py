"""Line-delimited JSON events, read with their line numbers, and their byte places in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = (
    "kind string, atof_version string, uuid string, parent_uuid string, timestamp string, name string, data variant, metadata variant, "
    "scope_category string, attributes array<string>, category string, category_profile variant, data_schema variant"
)


class LineError(ValueError):
    """A line that isn't an event; ``line`` counts from 1."""

    def __init__(self, line: int):
        super().__init__(f"line {line} is not an event")
        self.line = line


def events_of(lines: DataFrame) -> DataFrame:
    """Events of rows (value), with ``json``, the text, and ``bad`` for what can't be read."""
    rows = lines.withColumn("json", F.trim("value")).filter("json <> ''")
    parsed = rows.withColumn("e", F.from_json("json", EVENT))
    # a line is an event if it names its kind and its scope
    bad = F.col("e.uuid").isNull() | ~F.coalesce(F.col("e.kind").isin("scope", "mark"), F.lit(False))
    return parsed.select("*", bad.alias("bad"), "e.*").drop("e", "value")


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of a file with ``line`` (from 1). Strict: the first bad line is an error.

    A file's lines are numbered within its splits and offset by the lines of the splits before.
    """
    lines = spark.read.text(path).withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = lines.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    numbered = lines.join(F.broadcast(base), "task").withColumn("line", F.col("base") + F.col("at") + 1).drop("task", "at", "base")
    events = events_of(numbered)
    if strict:
        first = events.filter("bad").agg(F.min("line").alias("line")).first().line
        if first is not None:
            raise LineError(first)
    return events


def evidence(events: DataFrame, json: Column, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """byte_offset, byte_length and digest of each event in a spool that holds one a line, in
    ``order``; ``groups`` are spools of their own, such as one for each day or writer."""
    length = F.octet_length(json)
    before = Window.partitionBy(*(groups or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.select(
        "*", F.coalesce(F.sum(length + 1).over(before), F.lit(0)).cast("long").alias("byte_offset"), length.cast("long").alias("byte_length"), F.sha2(json, 256).alias("digest")
    )
