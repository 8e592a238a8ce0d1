"""Schema validation: facts in, faults out.

A fault is a row (subject, code, detail). Types are written ``any``, ``null``, ``bool``, ``int``,
``decimal``, ``string``, ``bytes``, ``ref``, ``list<t>``, ``map<t>``, and ``entity:any``,
``entity:ns/kind`` or ``entity:kind`` of an internal kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Log, matches, part

SCALARS = ("null", "bool", "int", "decimal", "string", "bytes")


def type_matches(v: Column, kind: Column) -> Column:
    """Whether a value fits a type. Null fits ``null`` and ``any`` alone; a ref fits ``any`` alone."""
    name = F.substring_index(kind, ":", -1)
    entity_tag = F.when(name == "any", F.lit("any")).when(F.instr(name, "/") > 0, F.lit("external")).otherwise(F.lit("internal"))
    entity = matches(v["text"], entity_tag, F.substring_index(name, "/", 1), F.substring_index(name, "/", -1))
    inner = F.regexp_extract(kind, "^(?:list|map)<(.*)>$", 1)
    items = F.from_json(v["text"], "array<struct<tag: string, text: string>>")
    entries = F.map_values(F.from_json(v["text"], "map<string, struct<tag: string, text: string>>"))

    def fits(x: Column) -> Column:
        return (inner == "any") | (x["tag"].isin(*SCALARS) & (x["tag"] == inner)) | ((x["tag"] == "entity") & inner.startswith("entity:"))

    return F.coalesce(
        F.when(kind == "any", F.lit(True))
        .when(v["tag"] == "ref", F.lit(False))
        .when(kind.startswith("entity:"), (v["tag"] == "entity") & entity)
        # items without tags are strings
        .when(kind.startswith("list<"), (v["tag"] == "list") & F.coalesce(F.forall(items, fits), inner.isin("string", "any")))
        .when(kind.startswith("map<"), (v["tag"] == "map") & F.coalesce(F.forall(entries, fits), inner == "any"))
        .otherwise(v["tag"] == kind),
        F.lit(False),
    )


def observation_faults(observations: DataFrame, log: Log) -> DataFrame:
    """Faults of observations (op_id, ord, entity, ns, version, attrs)."""
    rows = observations.withColumn("id", F.concat_ws("#", "op_id", "ord")).withColumn("kind", part(F.col("entity"), 2)).withColumn("e_ns", part(F.col("entity"), 1))
    known = log.schemas.select("ns", "version").distinct().withColumn("there", F.lit(True))
    rows = rows.join(known, ["ns", "version"], "left")
    kinds = log.entity_schemas.select("ns", "version", "kind", "allow_unknown", F.lit(True).alias("typed"))
    rows = rows.join(kinds, ["ns", "version", "kind"], "left")
    # a schema defines entities of its own namespace
    rows = rows.withColumn("typed", F.col("typed") & (F.col("e_ns") == F.col("ns")))
    lost = rows.filter("there IS NULL").select("id", F.lit("MissingSchema").alias("code"), F.concat_ws("@", "ns", "version").alias("detail"))
    untyped = rows.filter("there IS NOT NULL AND typed IS NOT TRUE").select("id", F.lit("UnknownEntityType"), F.concat_ws("/", "e_ns", "kind"))
    typed = rows.filter("there IS NOT NULL AND typed").select("id", "ns", "version", "kind", "allow_unknown", "attrs")
    fields = log.fields
    needed = typed.join(fields.filter("required"), ["ns", "version", "kind"]).filter(~F.map_contains_key(F.col("attrs"), F.col("field")))
    missing = needed.select("id", F.lit("MissingField"), "field")
    given = typed.select("id", "ns", "version", "kind", "allow_unknown", F.explode("attrs").alias("field", "v"))
    checked = given.join(fields, ["ns", "version", "kind", "field"], "left")
    unknown = checked.filter("type IS NULL AND NOT allow_unknown").select("id", F.lit("UnknownField"), "field")
    wrong = checked.filter(F.col("type").isNotNull() & ~type_matches(F.col("v"), F.col("type"))).select("id", F.lit("InvalidFieldType"), "field")
    return lost.union(untyped).union(missing).union(unknown).union(wrong).withColumnRenamed("id", "subject")


def relation_faults(relations: DataFrame, log: Log) -> DataFrame:
    """Faults of relations (event_id, ns, version, rel_ns, name, src, dst): one each at most, the
    first of self relation, missing schema, unknown relation, endpoints that don't fit."""
    known = log.schemas.select("ns", "version").distinct().withColumn("there", F.lit(True))
    types = log.relation_schemas.withColumn("typed", F.lit(True)).drop("role", "direction")
    rows = relations.join(known, ["ns", "version"], "left").join(types, ["ns", "version", "rel_ns", "name"], "left")
    fits = matches(F.col("src"), F.col("from_tag"), F.col("from_ns"), F.col("from_kind")) & matches(F.col("dst"), F.col("to_tag"), F.col("to_ns"), F.col("to_kind"))
    code = (
        F.when(F.col("src") == F.col("dst"), F.lit("InvalidSelfRelation"))
        .when(F.col("there").isNull(), F.lit("MissingSchema"))
        .when(F.col("typed").isNull(), F.lit("UnknownRelation"))
        .when(~F.coalesce(fits, F.lit(False)), F.lit("InvalidRelationEndpoints"))
    )
    return rows.withColumn("code", code).filter("code IS NOT NULL").select(F.col("event_id").alias("subject"), "code", F.concat_ws("/", "rel_ns", "name").alias("detail"))
