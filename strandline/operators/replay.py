"""Rebuilding the views of a log: order, latest states, heads, unions of logs.

The canonical order of facts is the topological order of their operations, then their place in
the operation.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SCHEMAS, Log, canonical
from ..shared import written

#: Above this many operations, the same order is found by layers on the cluster, not on the driver.
DRIVER_OPERATIONS = 2_000_000


class LogError(ValueError):
    """A log that can't be replayed; ``kind`` names the fault."""

    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


def first_in_first_out(ids: list[str], parents: list[tuple[str, str]]) -> list[str]:
    """Topological order: roots by id, and children, by id, as their last parent is taken."""
    known = set(ids)
    children: dict[str, list[str]] = {i: [] for i in ids}
    open_parents = dict.fromkeys(ids, 0)
    for child, parent in set(parents):
        if parent not in known:
            raise LogError("MissingParent", f"{child} has the unknown parent {parent}")
        children[parent].append(child)
        open_parents[child] += 1
    queue = deque(sorted(i for i in ids if not open_parents[i]))
    out = []
    while queue:
        out.append(now := queue.popleft())
        for child in sorted(children[now]):
            open_parents[child] -= 1
            if not open_parents[child]:
                queue.append(child)
    if len(out) < len(ids):
        raise LogError("Cycle", f"{len(ids) - len(out)} operations lie on cycles or follow them")
    return out


def _family(log: Log) -> tuple[DataFrame, DataFrame]:
    """The ids (op_id) of a log, written, and their (op_id, parent_id). A parent that is not in the
    log is a fault."""
    ids = written(log.operations.select("op_id").distinct(), "left")
    known = log.parents.select("op_id", "parent_id").distinct()
    orphan = known.join(ids.withColumnRenamed("op_id", "parent_id"), "parent_id", "left_anti").first()
    if orphan:
        raise LogError("MissingParent", f"{orphan.op_id} has the unknown parent {orphan.parent_id}")
    return ids, known


def depths(log: Log) -> DataFrame:
    """(op_id, layer): 0 for roots, else one more than the highest layer of the parents.

    Chains take rounds in the logarithm of their length: an operation with one parent points to it,
    and in each round to where that one points, until all point to a root or to a merge, which has
    several parents. Only merges are peeled, one round for each layer of them.
    """
    ids, known = _family(log)
    known = written(known, "parents")
    parents = known.groupBy("op_id").agg(F.count(F.lit(1)).alias("n"), F.min("parent_id").alias("parent_id"))
    n = F.coalesce("n", F.lit(0))
    top = F.when(n == 1, F.col("parent_id")).otherwise(F.col("op_id")).alias("top")
    first = written(ids.join(parents, "op_id", "left").select("op_id", top, (n == 1).cast("long").alias("steps"), (n != 1).alias("settled"), (n > 1).alias("merge")), "pointers")
    done, left = [first.filter("settled").drop("merge")], first.filter("NOT settled").drop("merge")
    total, reach = first.count(), 1
    while n := left.count():
        # no path is longer than there are operations
        if reach > 2 * total:
            raise LogError("Cycle", f"{n} operations with one parent lie on cycles or follow them")
        there = reduce(DataFrame.unionByName, [*done, left]).select(F.col("op_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("settled").alias("ends"))
        moved = left.join(there, "top").select("op_id", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("settled"))
        moved = written(moved, "pointers")
        done.append(moved.filter("settled"))
        left = moved.filter("NOT settled")
        reach *= 2
    pointers = reduce(DataFrame.unionByName, done).drop("settled")
    merges = first.filter("merge").select("op_id")
    if not merges.isEmpty():
        below = _merge_depths(merges, known, pointers).select(F.col("op_id").alias("top"), "layer")
        pointers = pointers.join(below, "top", "left").withColumn("steps", F.col("steps") + F.coalesce("layer", F.lit(0)))
    return pointers.select("op_id", F.col("steps").cast("int").alias("layer"))


def _merge_depths(merges: DataFrame, known: DataFrame, pointers: DataFrame) -> DataFrame:
    """(op_id, layer) of ``merges`` (op_id); ``pointers`` (op_id, top, steps) lead from each operation
    to the nearest root or merge."""
    tops = pointers.select(F.col("op_id").alias("parent_id"), "top", F.col("steps") + 1)
    edges = known.join(merges, "op_id", "left_semi").join(tops.toDF("parent_id", "top", "steps"), "parent_id")
    edges = written(edges.groupBy("op_id", "top").agg(F.max("steps").alias("steps")), "merges")
    left, done = merges, [merges.limit(0).withColumn("layer", F.lit(0).cast("long"))]
    while n := left.count():
        waiting = edges.join(left.withColumnRenamed("op_id", "top"), "top", "left_semi").select("op_id").distinct()
        ready = left.join(waiting, "op_id", "left_anti")
        below = reduce(DataFrame.unionByName, done).select(F.col("op_id").alias("top"), "layer")
        # a top without a layer is a root
        layer = F.max(F.col("steps") + F.coalesce("layer", F.lit(0))).alias("layer")
        ready = written(edges.join(ready, "op_id", "left_semi").join(below, "top", "left").groupBy("op_id").agg(layer), "layer")
        if ready.isEmpty():
            raise LogError("Cycle", f"{n} merges lie on cycles or follow them")
        done.append(ready)
        if len(done) > 16:
            done = [written(reduce(DataFrame.unionByName, done), "layers")]
        left = written(left.join(ready, "op_id", "left_anti"), "left")
    return reduce(DataFrame.unionByName, done)


def layers(log: Log) -> DataFrame:
    """(op_id, layer, topo): 0 for roots, else one more than the highest layer of the parents, and
    the place in the first-in-first-out order.

    Found by peeling operations whose parents all have layers; every round is written. An
    operation is ready once its last parent is taken, which lies in the layer before. So the
    order goes layer by layer, and within one by the place of the last parent, then by id.
    """
    left, known = _family(log)
    done: list[DataFrame] = []
    at, total, last = 0, left.count(), None
    while n := left.count():
        waiting = known.join(left.withColumnRenamed("op_id", "parent_id"), "parent_id", "left_semi").select("op_id").distinct()
        ready = left.join(waiting, "op_id", "left_anti")
        if last is None:
            ready = ready.withColumn("after", F.lit(-1).cast("long"))
        else:
            after = known.join(last.select(F.col("op_id").alias("parent_id"), "topo"), "parent_id").groupBy("op_id").agg(F.max("topo").alias("after"))
            ready = ready.join(after, "op_id")
        ready = _placed(ready, ["after", "op_id"], total - n).select("op_id", F.lit(at).alias("layer"), "topo")
        ready = last = written(ready, "layer")
        if ready.isEmpty():
            raise LogError("Cycle", f"{n} operations lie on cycles or follow them")
        done.append(ready)
        if len(done) > 16:
            done = [written(reduce(DataFrame.unionByName, done), "layers")]
        left = written(left.join(ready, "op_id", "left_anti"), "left")
        at += 1
    return reduce(DataFrame.unionByName, done) if done else log.spark.createDataFrame([], "op_id string, layer int, topo long")


def _placed(rows: DataFrame, by: list[str], base: int) -> DataFrame:
    """``rows`` with ``topo``, their places from ``base`` on when sorted; no task sees all rows."""
    mid = written(rows.orderBy(*by).withColumn("mid", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("mid", 33)
    # one row for each task of the sort
    sizes = mid.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return mid.join(F.broadcast(before), task == F.col("task")).withColumn("topo", F.lit(base) + F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("mid", "task", "before")


def topological_order(log: Log) -> DataFrame:
    """(op_id, topo): the first-in-first-out order, from ids alone on the driver; for logs of over
    DRIVER_OPERATIONS by layers on the cluster, which gives the same order."""
    n = log.operations.count()
    if n > DRIVER_OPERATIONS:
        return layers(log).select("op_id", "topo")
    ids = [r.op_id for r in log.operations.select("op_id").distinct().toLocalIterator()]
    parents = [(r.op_id, r.parent_id) for r in log.parents.select("op_id", "parent_id").toLocalIterator()]
    return log.spark.createDataFrame(list(zip(first_in_first_out(ids, parents), range(n), strict=True)), "op_id string, topo long")


def ordered(log: Log, table: DataFrame, topo: DataFrame | None = None) -> DataFrame:
    """Facts with ``at``, a struct that sorts in canonical order."""
    topo = topological_order(log) if topo is None else topo
    return table.join(topo, "op_id").withColumn("at", F.struct("topo", "ord"))


def latest_entities(log: Log, topo: DataFrame | None = None) -> DataFrame:
    """The last observation of each entity: entity, ns, version, attrs."""
    if "observations" in log.tables and "topo" in log.observations.columns:
        facts = log.observations.withColumn("at", F.struct("topo", "ord"))
    else:
        facts = ordered(log, log.observations, topo)
    last = facts.groupBy("entity").agg(F.max_by(F.struct("ns", "version", "attrs"), "at").alias("o"))
    return last.select("entity", "o.ns", "o.version", "o.attrs")


def entity_history(log: Log) -> DataFrame:
    """(entity, op_id) of all observations."""
    return log.observations.select("entity", "op_id").distinct()


def operation_heads(log: Log) -> DataFrame:
    """Operations that are nobody's parent."""
    return log.operations.select("op_id").join(log.parents.select(F.col("parent_id").alias("op_id")), "op_id", "left_anti").distinct()


def event_heads(log: Log) -> DataFrame:
    """Events that are nobody's parent."""
    return log.events.select("event_id").join(log.event_parents.select(F.col("parent_id").alias("event_id")), "event_id", "left_anti").distinct()


def source_map(log: Log) -> DataFrame:
    """(source, op_id, primary_event): the first event that the source's operation records."""
    first = log.events.groupBy("op_id").agg(F.min_by("event_id", "ord").alias("primary_event"))
    return log.operations.filter("source IS NOT NULL").select("source", "op_id").join(first, "op_id", "left").select("source", "op_id", "primary_event")


def declare(table: DataFrame, key: str, canon: Column) -> DataFrame:
    """Ledger semantics: (key, collides): true if rows of the key differ in their canonical text."""
    return table.groupBy(key).agg((F.countDistinct(canon) > 1).alias("collides"))


def reachable(log: Log, heads: DataFrame) -> DataFrame:
    """Operations that ``heads`` (op_id) descend from, and they themselves. An id that is not in
    the log is a fault."""
    from .graph import distances

    steps = log.parents.select(F.col("op_id").alias("here"), F.col("parent_id").alias("there"))
    found = distances(steps, heads.select(F.col("op_id").alias("entity"))).select(F.col("entity").alias("op_id"))
    lost = found.join(log.operations, "op_id", "left_anti").first()
    if lost:
        raise LogError("MissingOperation", lost.op_id)
    return found


#: Tables of an event, and of a schema; the others name their operation themselves.
OF_EVENT = ("event_parents", "subjects", "requires")
OF_SCHEMA = ("schema_requires", "entity_schemas", "fields", "relation_schemas")


def owned(log: Log, name: str) -> DataFrame:
    """A table of a log with the operation (op_id) that each row belongs to: an event's rows to the
    operation that records it, a schema's to those that register it."""
    table = getattr(log, name)
    if name in OF_EVENT:
        return table.join(log.events.select("event_id", "op_id").distinct(), "event_id")
    if name in OF_SCHEMA:
        return table.join(log.schemas.select("ns", "version", "op_id").distinct(), ["ns", "version"])
    return table


def _row_digest(table: DataFrame, name: str, without: tuple[str, ...]) -> Column:
    cols = [canonical(F.col(f.name)) if f.dataType.typeName() == "map" else F.col(f.name).cast("string") for f in table.schema if f.name not in without]
    # nulls and separators can't be confused
    return F.sha2(F.to_json(F.array(F.lit(name), *[F.coalesce(c, F.lit("\1")) for c in cols])), 256)


def _folded(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, digest) of rows (key, row): a sum of row hashes of two kinds, so that no group is
    gathered in one place; equal rows count once."""
    rows = reduce(DataFrame.unionByName, parts).distinct()
    total = lambda f: F.sum(f("row").cast("decimal(20,0)")).cast("string")
    crc = lambda c: F.conv(F.substring(c, 1, 15), 16, 10)
    return rows.groupBy(*key).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total(F.xxhash64), total(lambda c: crc(F.col(c)))).alias("digest"))


def operation_digest(log: Log) -> DataFrame:
    """(op_id, digest) over an operation's attributes, source, parents and all its facts, those of its
    events and schemas among them."""
    parts = []
    for name in SCHEMAS:
        if name in log.tables:
            table = owned(log, name)
            parts.append(table.select("op_id", _row_digest(table, name, ("op_id",)).alias("row")))
    return _folded(parts, ["op_id"])


def schema_digest(log: Log) -> DataFrame:
    """(ns, version, digest) over all that a schema defines."""
    parts = [getattr(log, n).select("ns", "version", _row_digest(getattr(log, n), n, ("ns", "version")).alias("row")) for n in OF_SCHEMA if n in log.tables]
    parts.append(log.schemas.select("ns", "version", F.lit("").alias("row")))
    return _folded(parts, ["ns", "version"])


def of_operations(log: Log, ops: DataFrame) -> Log:
    """The part of a log that belongs to the operations of ``ops`` (op_id)."""
    ops = ops.select("op_id").distinct()
    return Log(log.spark, {name: owned(log, name).join(ops, "op_id", "left_semi").select(*getattr(log, name).columns) for name in SCHEMAS if name in log.tables})


def collisions(left: Log, right: Log) -> DataFrame:
    """(op_id) of operations that are in both logs and aren't the same in all their facts."""
    other = operation_digest(right).withColumnRenamed("digest", "other")
    return operation_digest(left).join(other, "op_id").filter("digest <> other").select("op_id")


def merge(left: Log, right: Log) -> Log:
    """The union of two logs. An operation that is in both must be the same in both."""
    clash = collisions(left, right).first()
    if clash:
        raise LogError("IdentityCollision", clash.op_id)
    new = right.operations.select("op_id").join(left.operations.select("op_id"), "op_id", "left_anti")
    more = of_operations(right, new)
    tables = {}
    for name in {*left.tables, *right.tables}:
        both = getattr(left, name).unionByName(getattr(more, name))
        # a schema that both register is there once
        tables[name] = both.distinct() if name in OF_SCHEMA else both
    return Log(left.spark, tables)


def publish_heads(actual: DataFrame, expected: DataFrame, following: DataFrame) -> DataFrame:
    """The new heads (op_id): ``following`` if ``actual`` is as expected, else what is there and
    following, less what following replaces."""
    gone = expected.select("op_id").join(following, "op_id", "left_anti")
    return actual.select("op_id").unionByName(following.select("op_id")).distinct().join(gone, "op_id", "left_anti")


def latest_resources(log: Log, topo: DataFrame | None = None) -> DataFrame:
    """The last observation of each resource; repeats of the current one change nothing."""
    last = ordered(log, log.resources, topo).groupBy("resource").agg(F.max_by(F.struct("availability", "integrity", "retention"), "at").alias("s"))
    return last.select("resource", "s.*")


def open_sessions(log: Log) -> DataFrame:
    """Sessions that were opened and not ended."""
    return log.sessions.select("session_id").distinct().join(log.session_ends, "session_id", "left_anti")


def view_counts(log: Log) -> dict[str, int]:
    """Sizes of the rebuilt views, as a check of a replay."""
    return {
        "operations": log.operations.select("op_id").distinct().count(),
        "entities": log.observations.select("entity").distinct().count(),
        "events": log.events.select("event_id").distinct().count(),
        "edges": log.relations.distinct().count(),
        "operation_heads": operation_heads(log).count(),
        "event_heads": event_heads(log).count(),
    }


