"""Mixing sources to target weights by Efraimidis-Spirakis sampling (built-in functions only).

Every source has a target in words. A source is taken whole as often as its target allows
(complete epochs), and the rest of the target is filled by weighted sampling without
replacement: a document with quality weight w draws the key -ln(u) / w, u being a hash of its
id, and documents are taken in key order until their prefix sum reaches the budget. The last
one is taken in part, so that a source meets its target.

A source is never sorted in one task: a document's bucket comes from its key, the buckets of a
source are summed first, and only rows within a bucket are put in order. The share of keys up to x
is the mean of 1 - exp(-w * x) over a source's weights; taken over a histogram of the weights, it
is a rising function of the key that makes the buckets even whatever the weights are.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh, written

WORD = r"[^\x20\x09-\x0D]+"
#: No source is repeated more often than this.
MAX_EPOCHS = 3
#: Rows of a source for each bucket of keys.
ROWS_PER_BUCKET = 2_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose down to 0.1 for texts full of marks: 4 times their share is taken off."""
    marks = F.length(text) - F.length(F.translate(text, "*%&$#|!{}<>=_~^\\", ""))
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.try_divide(4.0 * marks, F.length(text))), F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the MD5 of the id, or of the text where the id is null."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5(text), F.lit("")))))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(per: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_EPOCHS) -> DataFrame:
    """Targets of a table (source, source_size, source_rows), one row for each source.

    Sources in code-point order, null last, weigh ``weights``, repeating. Targets share all
    words by weight, stop at ``cap`` times the source's size, and the excess is shared again by
    weight. That is a water level: with sources in the order of cap over weight, the level is
    fixed by the first source that it doesn't fill.
    """
    everything = Window.partitionBy()
    ranked = per.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("own_level", level.cast("double"))
    held = F.when(F.col("own_level") * F.col("weight") <= F.col("limit"), F.col("own_level"))
    ranked = ranked.withColumn("level", F.first(held, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select(
        "source", "source_size", "source_rows",
        F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0))).alias("target"),
    )


def weight_class(weight: Column) -> Column:
    """Four classes of weights to each power of two."""
    return F.floor(4 * F.log2(weight)).cast("int")


def key_share(key: Column, classes: Column) -> Column:
    """The expected share of keys up to ``key``; ``classes``: (class, rows) of a source's weights.

    Within 0 and 1, and rising with the key, whatever the histogram is.
    """
    total = F.aggregate(classes, F.lit(0.0), lambda s, c: s + c["rows"])
    middle = lambda c: F.pow(F.lit(2.0), (c["class"] + 0.5) / 4)
    return F.aggregate(classes, F.lit(0.0), lambda s, c: s + c["rows"] * (1 - F.exp(-key * middle(c)))) / total


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    quality: Column | None = None,
    seed: str = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """How many words the mix takes of every document.

    Returns one row for each row of ``df``: ``doc_id``, ``size`` (its words), ``source_size``,
    ``target``, ``taken`` (long; ``epochs * size`` plus what the sample takes), ``epochs``,
    ``text_hash`` and ``source``.

    Defined cases: a null text has no words, takes nothing and keeps its row; null sources are
    one source, the last; rows with null ids draw by their text; equal keys are ordered by id, text
    hash and size, and rows equal in all of these are interchangeable; if no text has a word,
    targets are 0; quality weights that are null or not above 0 count as the least double.
    """
    text = F.col(text_col)
    quality = quality_weight(text) if quality is None else quality
    weight = F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(sys.float_info.min))
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        F.xxhash64(text).alias("text_hash"), uniform(F.col(id_col), text, seed).alias("u"), weight.alias("w"),
    )
    rows = rows.select("doc_id", "source", "size", "text_hash", (-F.log("u") / F.col("w")).alias("key"), weight_class(F.col("w")).alias("class"))
    rows = written(rows, "mix-keys")
    per = rows.groupBy("source", "class").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    # a source has as many entries as its weights have classes
    per = per.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("source_rows"), F.array_sort(F.collect_list(F.struct("class", "rows"))).alias("classes"))
    targets = source_targets(per, weights).join(per.select(F.col("source").alias("c_source"), "classes"), F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source")
    targets = targets.withColumnRenamed("source", "t_source")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / rows_per_bucket)).cast("long")
    bucket = F.least(F.floor(key_share(F.col("key"), F.col("classes")) * buckets), buckets - 1)
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("bucket", bucket.cast("long")).drop("t_source", "classes")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rows = rows.withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("b_size").over(earlier), F.lit(0)).alias("base"),
    )
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    sampled = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    return rows.select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + sampled).cast("long").alias("taken"), "epochs", "text_hash", "source",
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of the mix, with the columns of ``df``: every document as often as it is taken.

    Documents stay whole here: the one that is taken in part is repeated once more if more than
    half of it is taken. The rows of a text and id are alike in how much is taken of them,
    except for equal rows, of which those that sort first are taken.

    Defined cases: null and empty texts have no words and are never taken; null sources are one
    source, the last; null ids are equal to each other; repeated rows share what is taken of them;
    columns of ``df`` may have any names; an empty table gives no rows.
    """
    i, h, s, k, n, at, times = fresh(df, "i", "h", "s", "k", "n", "at", "times")
    counts = mix(df, id_col, text_col, source_col, seed=seed)
    whole = F.round(F.col("taken") / F.greatest(F.lit(1), F.col("size"))).cast("int")
    counts = counts.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("source").alias(s), whole.alias(times)).filter(F.col(times) > 0)
    # equal rows share a count: the sum is dealt over them as evenly as it goes
    shared = counts.groupBy(i, h, s).agg(F.sum(times).alias(times))
    keyed = df.withColumn(k, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s)) & (F.col(k) == F.col(h))
    rows = keyed.join(shared, same)
    window = Window.partitionBy(id_col, source_col, k)
    rows = rows.withColumn(n, F.count(F.lit(1)).over(window)).withColumn(at, F.row_number().over(window.orderBy(F.lit(1))))
    own = F.floor(F.col(times) / F.col(n)) + (F.col(at) <= F.col(times) % F.col(n)).cast("int")
    return rows.withColumn(at, F.explode(F.array_repeat(F.lit(1), own.cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])
