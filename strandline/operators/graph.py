"""Lookup, history, traversal and explanation over the edges of a log.

A search is a breadth-first frontier: each level joins the last frontier with an oriented step
table (src, dst, edge), keeps what is new, and is written to the shared folder, so plans don't
grow with depth and lost executors cost one level at most. The frontier is broadcast while it is
small. Levels, not visiting order, define the result, so it is the same in parallel:

* the entities are those within ``max_depth`` steps of the roots, roots included, seen or not;
* the edges are all selected ones that leave an entity less than ``max_depth`` steps away,
  also those that lead back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Log
from ..shared import small, written

EDGE = ("op_id", "event_id", "ns", "version", "rel_ns", "name", "src", "dst", "attrs_canon")
ROLE_PRIORITY = {"causal": 0, "primary": 1, "supporting": 2, "contextual": 3, "attribution": 4, "influence": 4, "contradicting": 4, "invalidating": 4}


@dataclass
class Result:
    """What a query selects: entities (entity), edges, events (event_id), operations (op_id)."""

    entities: DataFrame
    edges: DataFrame
    events: DataFrame
    operations: DataFrame

    @classmethod
    def of(cls, entities: DataFrame, edges: DataFrame) -> Result:
        return cls(entities, edges, edges.select("event_id").distinct(), edges.select("op_id").distinct())


def described(edges: DataFrame, relation_schemas: DataFrame) -> DataFrame:
    """Edges with the role and the direction that their relation's schema gives them."""
    about = relation_schemas.select(F.col("ns").alias("s_ns"), F.col("version").alias("s_version"), F.col("rel_ns").alias("s_rel_ns"), F.col("name").alias("s_name"), "role", "direction")
    same = [F.col(c) == F.col(f"s_{c}") for c in ("ns", "version", "rel_ns", "name")]
    return edges.join(about, reduce(Column.__and__, same)).drop("s_ns", "s_version", "s_rel_ns", "s_name")


def select_relations(edges: DataFrame, relation_schemas: DataFrame, selector: str = "any", types: list[tuple[str, str]] | None = None) -> DataFrame:
    """``any`` edges, those of ``types`` (namespace, name), or ``explanatory`` ones: whose schema
    has an explanation of any kind, also one that explanation never follows."""
    if selector == "any":
        return edges
    if selector == "types":
        return edges.filter(reduce(Column.__or__, [(F.col("rel_ns") == ns) & (F.col("name") == name) for ns, name in types or []], F.lit(False)))
    if selector == "explanatory":
        return described(edges, relation_schemas).filter("direction IS NOT NULL").select(*edges.columns)
    raise ValueError(f"unknown selector {selector!r}")


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Steps (here, there) along edges: ``outgoing``, ``incoming`` or ``both``."""
    out = edges.select("*", F.col("src").alias("here"), F.col("dst").alias("there"))
    back = edges.select("*", F.col("dst").alias("here"), F.col("src").alias("there"))
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)


def explanation_steps(edges: DataFrame, relation_schemas: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Steps from an entity to what explains it. No roles: all roles."""
    known = described(edges, relation_schemas).filter("direction IS NOT NULL")
    if roles:
        known = known.filter(F.col("role").isin(*roles))
    ahead = known.filter(F.col("direction").isin("from-explained-by-to", "symmetric")).select("*", F.col("src").alias("here"), F.col("dst").alias("there"))
    back = known.filter(F.col("direction").isin("to-explained-by-from", "symmetric")).select("*", F.col("dst").alias("here"), F.col("src").alias("there"))
    return ahead.unionByName(back).select(*edges.columns, "here", "there")


def distances(steps: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(entity, depth) of all entities within ``max_depth`` steps (None: any number) of ``roots``."""
    frontier = written(roots.select("entity").distinct().withColumn("depth", F.lit(0)), "frontier")
    levels, depth, n = [frontier], 0, frontier.count()
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        seen = reduce(DataFrame.unionByName, levels).select("entity")
        following = (
            steps.select("here", "there").join(small(frontier.select(F.col("entity").alias("here")), n), "here", "left_semi")
            .select(F.col("there").alias("entity")).distinct()
            .join(seen, "entity", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = written(following, "frontier")
        n = frontier.count()
        levels.append(frontier)
        if len(levels) > 16:  # keeps the plan of a deep search short
            levels = [written(reduce(DataFrame.unionByName, levels), "levels")]
    return reduce(DataFrame.unionByName, levels)


def _reached(steps: DataFrame, roots: DataFrame, max_depth: int | None, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    if max_depth == 0:
        return roots.select("entity").distinct().withColumn("depth", F.lit(0)), steps.limit(0).select(*columns)
    # every level reads the steps, so what they are made from is computed once
    steps = written(steps, "steps")
    found = distances(steps, roots, max_depth)
    departed = found if max_depth is None else found.filter(F.col("depth") < max_depth)
    edges = steps.join(departed.select(F.col("entity").alias("here")), "here", "left_semi").select(*columns).distinct()
    return found, edges


def roots_of(log: Log, *keys: str) -> DataFrame:
    return log.spark.createDataFrame([(k,) for k in keys], "entity string")


def lookup(log: Log, entity: str) -> Result:
    """The entity itself, whether or not anything is known of it."""
    none = log.relations.limit(0)
    return Result.of(roots_of(log, entity), none)


def touching_events(log: Log, entity: str) -> DataFrame:
    """Events that have the entity as a subject or at an end of a relation."""
    ends = log.relations.filter((F.col("src") == entity) | (F.col("dst") == entity))
    return log.subjects.filter(F.col("entity") == entity).select("event_id").unionByName(ends.select("event_id")).distinct()


def history(log: Log, entity: str) -> Result:
    """Operations that observe the entity or record an event that touches it, and these events."""
    events = touching_events(log, entity)
    observing = log.observations.filter(F.col("entity") == entity).select("op_id")
    recording = log.events.join(events, "event_id", "left_semi").select("op_id")
    return Result(roots_of(log, entity), log.relations.limit(0), events, observing.unionByName(recording).distinct())


def traverse(
    log: Log,
    roots: DataFrame,
    direction: str = "outgoing",
    selector: str = "any",
    types: list[tuple[str, str]] | None = None,
    max_depth: int | None = None,
    predicate=None,
) -> Result:
    """Entities within reach of ``roots`` (entity). ``predicate`` (see ``predicates``) filters what
    is returned; the search passes through entities that it rejects."""
    edges = select_relations(log.relations, log.relation_schemas, selector, types)
    found, reached = _reached(oriented(edges, direction), roots, max_depth, edges.columns)
    entities = found.select("entity")
    if predicate is not None:
        entities = predicate.filter(log, entities)
    return Result.of(entities, reached)


def explain(log: Log, root: str, max_depth: int | None = None, roles: list[str] | None = None) -> Result:
    """Why: what explains the root, by the explanations that schemas declare."""
    steps = explanation_steps(log.relations, log.relation_schemas, roles)
    found, reached = _reached(steps, roots_of(log, root), max_depth, log.relations.columns)
    return Result.of(found.select("entity"), reached)


def role_priority(role: Column) -> Column:
    out = F.lit(5)
    for name, at in ROLE_PRIORITY.items():
        out = F.when(role == name, F.lit(at)).otherwise(out)
    return out


def causal_path(edges: DataFrame, relation_schemas: DataFrame, root: str, max_depth: int) -> list[dict]:
    """A greedy walk over the selected edges, either way along them: each step goes to the
    entity not yet visited with the least (role priority, relation, entity). One row comes to
    the driver for each step."""
    from ..functions.text import entity_uri

    known = described(edges, relation_schemas)
    ahead = known.select(F.col("src").alias("here"), F.col("dst").alias("there"), "rel_ns", "name", "role", F.lit(True).alias("forward"))
    back = known.filter("src <> dst").select(F.col("dst").alias("here"), F.col("src").alias("there"), "rel_ns", "name", "role", F.lit(False).alias("forward"))
    steps = ahead.unionByName(back)
    path, now, visited = [], root, [root]
    for _ in range(max_depth):
        best = (
            steps.filter((F.col("here") == now) & ~F.col("there").isin(*visited))
            .orderBy(role_priority(F.col("role")), F.concat_ws("/", "rel_ns", "name"), entity_uri(F.col("there")), "there")
            .limit(1).collect()
        )
        if not best:
            break
        path.append(best[0].asDict())
        now = best[0].there
        visited.append(now)
    return path
