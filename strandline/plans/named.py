"""Named queries: registered as data, instantiated with an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import why_target
from ..model import Log, external_key, matches
from ..operators import graph
from ..operators.replay import LogError


def instantiate(log: Log, ns: str, version: str, name: str, entity: str) -> graph.Result:
    """Run the named query on an entity that its input pattern admits."""
    found = log.named_queries.filter((F.col("ns") == ns) & (F.col("version") == version) & (F.col("name") == name)).orderBy("op_id", "ord").first()
    if found is None:
        raise LogError("MissingNamedQuery", f"{ns}@{version}/{name}")
    fits = log.spark.range(1).select(matches(F.lit(entity), F.lit(found.input_tag), F.lit(found.input_ns), F.lit(found.input_kind)).alias("ok")).first().ok
    if not fits:
        raise LogError("InvalidQueryInput", f"{name} does not take this entity")
    if found.template == "history":
        return graph.history(log, entity)
    if found.template == "explain":
        return graph.explain(log, entity, found.max_depth, list(found.roles or []))
    if found.template == "traverse":
        types = [tuple(t.split("/", 1)) for t in found.types or []]
        return graph.traverse(log, graph.roots_of(log, entity), found.direction, found.selector, types, found.max_depth)
    raise LogError("InvalidQueryTemplate", found.template)


def why(log: Log, uri: str) -> graph.Result:
    """The query that a ``jj://kind/id`` URI stands for: primary and supporting explanations, at any depth."""
    return graph.explain(log, external_key(*why_target(uri)), None, ["primary", "supporting"])


def named_query_table(log: Log, rows: list[tuple]) -> DataFrame:
    from ..model import SCHEMAS

    return log.spark.createDataFrame(rows, SCHEMAS["named_queries"])
