import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from strandline.llm.mixing import WORD, key_share, mix, mixed, uniform, weight_class

SCHEMA = "doc_id long, text string, source string"


def targets(sizes):
    """Shares by weight, stopped at three times the size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_ones, out = float(sum(sizes.values())), set(names), {}
    while open_ones:
        total = sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if left * weight[s] / total > 3 * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_ones}
        for s in full:
            out[s] = 3.0 * sizes[s]
            open_ones.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def run(spark, rows, **how):
    return mix(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()


def corpus(n=600):
    rng = random.Random(2)
    return [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(n)] + [(n, "x " * 9, "tiny")]


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_targets_are_met(spark, bucket):
    rows = corpus()
    got = run(spark, rows, rows_per_bucket=bucket)
    assert len(got) == len(rows)
    sizes = Counter()
    source = {i: s for i, _, s in rows}
    for r in got:
        sizes[source[r.doc_id]] += r.size
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(math.isclose(r.target, want[s], abs_tol=1e-6) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
        assert all(r.taken <= 3 * r.size for r in mine)
    assert sorted(map(tuple, got)) == sorted(map(tuple, run(spark, rows, rows_per_bucket=13)))


def test_epochs_come_before_the_sample(spark):
    got = [r for r in run(spark, [(i, "w " * 10, "a") for i in range(50)] + [(100, "w " * 10, "b")])]
    by = {r.doc_id: r for r in got}
    assert by[100].taken == 30
    assert all(r.taken in range(11) for r in got if r.doc_id < 100)


def test_heavier_documents_come_first(spark):
    junk = [(i, "*&%$ " * 10, "a") for i in range(100)]
    plain = [(1000 + i, "word " * 10, "a") for i in range(100)]
    other = [(5000 + i, "word " * 30, "b") for i in range(100)]
    got = {r.doc_id: r.taken for r in run(spark, junk + plain + other)}
    # source a has a third of the 5000 words as its target, so only some of its documents are taken
    assert sum(got[i] for i, *_ in plain) > 0.95 * 1000 > 700 > sum(got[i] for i, *_ in junk)


def test_white_space_is_what_the_pattern_says(spark):
    (r,) = run(spark, [(1, "a b c\td\x0be  \x85f", None)])
    import re

    assert r.size == len(re.findall(WORD, "a b c\td\x0be  \x85f"))


@pytest.mark.parametrize("weight", [1.0, 0.5, 0.1, 1e-6, "mixed"])
def test_buckets_are_even_whatever_the_weights_are(spark, weight):
    """The share of keys that decides on a bucket is spread evenly over 0 to 1."""
    n = 20_000
    w = F.when(F.col("id") % 3 == 0, 0.1).otherwise(0.9) if weight == "mixed" else F.lit(weight)
    rows = spark.range(n).select((-F.log(uniform(F.col("id"), F.lit("t"))) / w).alias("key"), weight_class(w).alias("class"))
    classes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).agg(F.collect_list(F.struct("class", "rows")).alias("classes"))
    shares = rows.join(F.broadcast(classes)).select("key", F.floor(key_share(F.col("key"), F.col("classes")) * 100).alias("bucket"))
    counts = {r.bucket: r["count"] for r in shares.groupBy("bucket").count().collect()}
    assert set(counts) <= set(range(101)) and max(counts.values()) < 0.02 * n
    assert shares.selectExpr("bucket", "lag(bucket) OVER (ORDER BY key) AS before").filter("before > bucket").isEmpty()


def test_rows_without_ids_draw_by_their_text(spark):
    rows = [(None, f"w{i} x", "a") for i in range(200)] + [(i, "w " * 10, "b") for i in range(5)]
    got = run(spark, rows)
    assert 0 < sum(r.taken == 0 for r in got if r.doc_id is None) < 200


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y", "a"), (3, "p q", "a"), (3, "p q", "a")]
    got = run(spark, rows)
    assert len(got) == 5 and sum(r.taken for r in got) in (5, 6)
    assert run(spark, []) == []
    assert [(r.taken, r.target) for r in run(spark, [(1, "", "a")])] == [(0, 0.0)]


def test_mixed_rows_are_whole_documents(spark):
    rows = corpus(300)
    df = spark.createDataFrame([(*r, 5, "n") for r in rows], SCHEMA + ", times int, i string")
    got = mixed(df)
    assert got.columns == df.columns
    counts = Counter(r.doc_id for r in got.collect())
    for r in run(spark, rows):
        assert counts[r.doc_id] == (int(r.taken / r.size + 0.5) if r.size else 0)


def test_repeated_rows_are_taken_like_others(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 3 + [(2, "c d e f", "t")] * 2, SCHEMA)
    taken = sum(r.taken for r in mix(df).collect())
    out = sum(len(r.text.split()) for r in mixed(df).collect())
    assert abs(taken - out) <= 4
