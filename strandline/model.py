"""The data model: an append-only log of operations and their facts, one table for each kind.

Entities are keys: text that sorts as the entities do, internal before external, and that can
be joined and grouped on. Attributes are maps from names to typed values; a value is a tag and
its canonical text, so 1 and "1", or 1.0 and 1.00, differ, and a null that is there differs from
a value that isn't.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRS = "map<string, struct<tag: string, text: string>>"

# Internal kinds in their order, and the ordered strengths of retention.
INTERNAL_KINDS = ("operation", "event", "session", "actor", "object", "replica")
STRENGTHS = ("referenced", "pinned", "escrowed")
ROLES = ("primary", "supporting", "contextual", "causal", "influence", "attribution", "contradicting", "invalidating")
DIRECTIONS = ("from-explained-by-to", "to-explained-by-from", "symmetric", "subject-explained-by-object", "object-explained-by-subject")

#: The tables of a log. ``ord`` is a fact's place in its operation.
SCHEMAS = {
    "operations": f"op_id string, source string, attrs {ATTRS}",
    "parents": "op_id string, parent_id string",
    "schemas": "op_id string, ord int, ns string, version string",
    "schema_requires": "ns string, version string, r_ns string, r_version string",
    "entity_schemas": "ns string, version string, kind string, allow_unknown boolean",
    "fields": "ns string, version string, kind string, field string, type string, required boolean",
    "relation_schemas": "ns string, version string, rel_ns string, name string, from_tag string, from_ns string, from_kind string, "
    "to_tag string, to_ns string, to_kind string, role string, direction string",
    "named_queries": "op_id string, ord int, ns string, version string, name string, input_tag string, input_ns string, input_kind string, "
    "template string, max_depth int, roles array<string>, direction string, selector string, types array<string>",
    "observations": f"op_id string, ord int, entity string, ns string, version string, attrs {ATTRS}",
    "events": f"op_id string, ord int, event_id string, session string, actor string, attrs {ATTRS}",
    "event_parents": "event_id string, parent_id string",
    "subjects": "event_id string, entity string",
    "relations": "op_id string, event_id string, ns string, version string, rel_ns string, name string, src string, dst string, attrs_canon string",
    "requires": "event_id string, resource string, strength int",
    "sessions": f"op_id string, ord int, session_id string, parent string, attrs {ATTRS}",
    "session_ends": "op_id string, ord int, session_id string",
    "actors": f"op_id string, ord int, actor_id string, session string, attrs {ATTRS}",
    "objects": f"op_id string, ord int, object_id string, digest string, attrs {ATTRS}",
    "replicas": f"op_id string, ord int, replica_id string, attrs {ATTRS}",
    "claims": "op_id string, ord int, claim_id string, owner_kind string, owner_id string, resource string, strength int",
    "releases": "op_id string, ord int, claim_id string",
    "resources": "op_id string, ord int, resource string, availability string, integrity string, retention int",
}


@dataclass
class Log:
    """The tables of a log, by name; a missing one is empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    @classmethod
    def of(cls, spark: SparkSession, **rows: list) -> Log:
        """A log of rows, for small inputs."""
        return cls(spark, {name: spark.createDataFrame(r, SCHEMAS[name]) for name, r in rows.items()})


def external(ns: Column | str, kind: Column | str, id: Column) -> Column:
    """The key of an external entity."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.concat(F.lit("X\0"), lit(ns), F.lit("\0"), lit(kind), F.lit("\0"), id.cast("string"))


def external_key(ns: str, kind: str, id: str) -> str:
    return f"X\0{ns}\0{kind}\0{id}"


def internal_key(kind: str, id: str) -> str:
    return f"I{INTERNAL_KINDS.index(kind)}\0{id}"


def is_external(key: Column) -> Column:
    return key.startswith("X")


def part(key: Column, at: int) -> Column:
    """Namespace (1), kind (2) or id (3) of an external key."""
    return F.get(F.split(key, "\0", 4), F.lit(at))


def value(tag: str, text: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), text.cast("string").alias("text"))


def canonical(attrs: Column) -> Column:
    """Attributes as one text, whatever order the map is in."""
    entries = F.array_sort(F.map_entries(attrs))
    return F.coalesce(F.to_json(entries, {"ignoreNullFields": "false"}), F.lit("[]"))


def matches(key: Column, tag: Column, ns: Column, kind: Column) -> Column:
    """Whether an entity fits a type pattern: any, external of a type, or internal of a kind."""
    inner = F.element_at(F.array(*[F.lit(k) for k in INTERNAL_KINDS]), F.substring(key, 2, 1).cast("int") + 1)
    return (
        F.when(tag == "any", F.lit(True))
        .when(tag == "external", is_external(key) & (part(key, 1) == ns) & (part(key, 2) == kind))
        .when(tag == "internal", ~is_external(key) & (F.when(~is_external(key), inner) == kind))
        .otherwise(F.lit(False))
    )
