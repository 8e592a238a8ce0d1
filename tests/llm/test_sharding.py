import random
import zlib

import pytest

from strandline.llm.sharding import histogram_shard


def shard(spark, rows, shards=8, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(histogram_shard(df, shards, **how).collect(), key=lambda r: (r.shard, r.slot))


def laws(got, rows, shards=8):
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in rows)
    for r in got:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    for s in range(shards):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))


def sizes(got, shards=8):
    return [sum(r.size for r in got if r.shard == s) for s in range(shards)]


def test_bytes_are_equal_within_a_row(spark):
    rng = random.Random(1)
    rows = [(i, "wörd " * rng.randint(0, 60)) for i in range(800)]
    got = shard(spark, rows)
    laws(got, rows)
    mean = sum(sizes(got)) / 8
    assert max(abs(x - mean) for x in sizes(got)) <= 400


def test_a_hot_group_is_cut_and_others_stay_together(spark):
    rows = [(i, "same text") for i in range(600)] + [(1000 + i, f"text {i % 150} " * 3) for i in range(600)]
    got = shard(spark, rows, rows_per_partition=50)
    laws(got, rows)
    mean = sum(sizes(got)) / 8
    assert max(abs(x - mean) for x in sizes(got)) <= 0.05 * mean
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in where.items() if t != "same text") <= 7


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "x"), (None, None), (3, "é" * 5000)]
    laws(shard(spark, rows), rows)


def test_empty_table(spark):
    assert shard(spark, []) == []


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_rows_than_shards(spark, n):
    rows = [(i, "a") for i in range(n)]
    laws(shard(spark, rows), rows)


def test_clashing_columns_are_replaced_or_carried(spark):
    names = ["shard", "SIZE", "k1", "k2", "part", "at", "shard key", "shard row key", "s_first", "p_first", "first", "a.b"]
    df = spark.createDataFrame([(1, "abc", *range(12))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    (row,) = histogram_shard(df, 2).collect()
    assert [row[n] for n in names[2:]] == list(range(2, 12)) and row["size"] == 4


def test_slots_follow_the_key_and_reruns_agree(spark, tmp_path):
    rows = [(i, f"text {i % 90} " * 3) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    first, second = (sorted(map(tuple, histogram_shard(spark.read.parquet(f"{tmp_path}/in"), 4).collect())) for _ in range(2))
    assert first == second
    by = {}
    for _, text, _, _, shard, slot in sorted(first, key=lambda r: (r[4], r[5])):
        by.setdefault(shard, []).append(text)
    for texts in by.values():  # equal texts are neighbours
        assert sum(a != b for a, b in zip(texts, texts[1:], strict=False)) == len(set(texts)) - 1
