import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline import queries
from strandline.model import Log
from strandline.operators import replay, retention
from strandline.operators.replay import LogError, first_in_first_out
from strandline.operators.retention import transition
from strandline.shared import written
from tests.fixture import RECIPE, kitchen


def test_first_in_first_out_is_not_layer_order():
    # z is a root after a, so a's child comes after z's only if it became ready later
    ids, parents = ["a", "z", "b", "c", "d"], [("d", "a"), ("b", "z"), ("c", "a"), ("c", "z")]
    assert first_in_first_out(ids, parents) == ["a", "z", "d", "b", "c"]
    with pytest.raises(LogError, match="Cycle"):
        first_in_first_out(["a", "b"], [("a", "b"), ("b", "a")])
    with pytest.raises(LogError, match="MissingParent"):
        first_in_first_out(["a"], [("a", "lost")])


def test_views(spark):
    log = kitchen(spark)
    order = {r.op_id: r.topo for r in replay.topological_order(log).collect()}
    assert order == {"op-root": 0, "op-book": 1, "op-kitchen": 2, "op-agent": 3}
    assert {r.op_id: r.layer for r in replay.layers(log).collect()} == {"op-root": 0, "op-book": 1, "op-kitchen": 1, "op-agent": 2}
    assert [r.op_id for r in replay.operation_heads(log).collect()] == ["op-agent"]
    assert {r.event_id for r in replay.event_heads(log).collect()} == {"e-kitchen", "e-agent"}
    latest = {r.entity: r.attrs["status"]["text"] for r in replay.latest_entities(log).collect() if "status" in r.attrs}
    assert latest[RECIPE] == "trial"
    assert {r.primary_event for r in replay.source_map(log).collect()} == {"e-book", "e-kitchen", "e-agent"}
    heads = spark.createDataFrame([("op-book",)], "op_id string")
    assert {r.op_id for r in replay.reachable(log, heads).collect()} == {"op-book", "op-root"}


def test_order_of_large_logs_is_first_in_first_out(spark, monkeypatch):
    rng = random.Random(6)
    ids = [f"op-{i}" for i in rng.sample(range(1000), 60)]
    parents = sorted({(ids[i], ids[rng.randrange(max(0, i - 25), i)]) for i in range(12, 60) for _ in range(rng.choice([1, 2, 3]))})
    log = Log.of(spark, operations=[(i, None, {}) for i in ids], parents=parents)
    monkeypatch.setattr(replay, "DRIVER_OPERATIONS", 0)
    got = {r.op_id: r.topo for r in replay.topological_order(log).collect()}
    assert sorted(got, key=got.get) == first_in_first_out(ids, parents) and sorted(got.values()) == list(range(60))
    layer = {r.op_id: r.layer for r in replay.layers(log).collect()}
    assert sorted(ids, key=got.get) != sorted(ids, key=lambda i: (layer[i], i))


def test_depths_are_longest_paths(spark):
    """Against a loop over a log with chains and merges."""
    rng = random.Random(9)
    ids = [f"op-{i}" for i in rng.sample(range(1000), 70)]
    parents = sorted({(ids[i], ids[i - 1 if i % 9 else rng.randrange(i)]) for i in range(4, 70)} | {(ids[i], ids[rng.randrange(i)]) for i in range(20, 70, 15)})
    layer = {}
    for i in ids:
        layer[i] = max((layer[p] + 1 for c, p in parents if c == i), default=0)
    # a parent that is stated twice is one
    log = Log.of(spark, operations=[(i, None, {}) for i in ids], parents=[*parents, *parents[:9]])
    assert sorted(map(tuple, replay.depths(log).collect())) == sorted(layer.items())
    assert replay.depths(Log.of(spark, operations=[], parents=[])).collect() == []


@pytest.mark.parametrize(("parents", "kind"), [("ba cb bc", "Cycle"), ("ba cb dc bd", "Cycle"), ("ab bc ca", "Cycle"), ("dd", "Cycle"), ("ba cx", "MissingParent")])
def test_depths_of_faulty_logs(spark, parents, kind):
    log = Log.of(spark, operations=[(i, None, {}) for i in "abcd"], parents=[tuple(p) for p in parents.split()])
    with pytest.raises(LogError, match=kind):
        replay.depths(log).collect()


def test_depth_of_a_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(replay, "written", lambda df, name: tables.append(name) or written(df, name))
    log = Log.of(spark, operations=[(f"op-{i}", None, {}) for i in range(100)], parents=[(f"op-{i}", f"op-{i - 1}") for i in range(1, 100)])
    assert {r.op_id: r.layer for r in replay.depths(log).collect()} == {f"op-{i}": i for i in range(100)}
    assert len(tables) < 15


def test_depth_query_gives_the_columns_and_rows_of_its_sql(spark, tmp_path):
    turns = [(c, t, "user", "x") for c, n in ((1, 3), (2, 1), (7, 4)) for t in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["q_op_depth"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        con.execute(queries.ORACLE_SQL["q_op_depth"])
        assert got.columns == [d[0] for d in con.description]
        assert sorted(map(tuple, got.collect())) == sorted(con.fetchall())


def test_merge(spark):
    log = kitchen(spark)
    merged = replay.merge(log, log)
    assert replay.view_counts(merged) == replay.view_counts(log)
    other = Log(spark, dict(log.tables))
    other.tables["operations"] = log.operations.withColumn("source", F.lit("X\0a\0b\0c"))
    with pytest.raises(LogError, match="IdentityCollision"):
        replay.merge(log, other)


@pytest.mark.parametrize(("actual", "expected", "following", "heads"), [("ab", "ab", "c", "c"), ("abd", "ab", "c", "cd"), ("a", "a", "a", "a"), ("", "", "x", "x"), ("ab", "a", "ac", "abc")])
def test_publish_heads(spark, actual, expected, following, heads):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "op_id string")
    assert sorted(r.op_id for r in replay.publish_heads(frame(actual), frame(expected), frame(following)).collect()) == sorted(heads)


def test_transition_names(spark):
    levels = [None, 0, 1, 2]
    rows = spark.createDataFrame(list(itertools.product(levels, levels)), "before int, after int")
    got = {(r.before, r.after): r.t for r in rows.withColumn("t", transition(F.col("before"), F.col("after"))).collect()}
    assert got[None, 1] == "became-required" and got[1, None] == "became-unrequired" and got[0, 2] == "strengthened" and got[2, 0] == "weakened"
    assert all(got[x, x] is None for x in levels)


def test_claims_fold_in_order(spark):
    """Against a loop over steps: release before claim does nothing, a claim again is active again."""
    steps = [("c1", "r", None), ("c1", "r", 1), ("c2", "r", 2), ("c2", "r", None), ("c3", "q", 0), ("c1", "r", None), ("c1", "r", 0), ("c3", "q", None)]
    frame = spark.createDataFrame([((i, 0), *s) for i, s in enumerate(steps)], "at struct<topo: long, ord: int>, claim_id string, resource string, strength int")
    active, seen = {}, []
    for i, (claim, resource, strength) in enumerate(steps):
        before = max((s for r, s in active.values() if r == resource), default=None)
        active.pop(claim, None)
        if strength is not None:
            active[claim] = (resource, strength)
        after = max((s for r, s in active.values() if r == resource), default=None)
        if before != after:
            seen.append((resource, i, before, after))
    got = [(r.resource, r["at"].topo, r.before, r.after) for r in retention.transitions(frame).collect()]
    assert sorted(got, key=str) == sorted(seen, key=str)
    assert {(r.claim_id, r.strength) for r in retention.active_claims(frame).collect()} == {(c, s) for c, (_, s) in active.items()}
    assert {(r.resource, r.strength) for r in retention.effective_retention(retention.active_claims(frame)).collect()} == {("r", 0)}
