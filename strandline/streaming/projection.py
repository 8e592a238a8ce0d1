"""Agent events as requests: the source, cursor and attributes that an event is recorded with.

In ``audit`` mode every event is recorded with what it is and the digests, not the texts, of its
payloads; in ``link`` mode only the source that it explains, its outcome, and the ids that lead
to its telemetry. All of it is a select over the rows of :func:`relay.projected`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import telemetry as t
from ..model import ATTRS, part
from .relay import Config

#: Attribute, column and tag of what ``spool.evidence`` tells of a line.
EVIDENCE = (("evidence-offset", "byte_offset", "int"), ("evidence-length", "byte_length", "int"), ("evidence-digest", "digest", "string"))


def _member(event: Column, *path: str) -> Column:
    return F.try_variant_get(event, "$" + "".join(f"['{p}']" for p in path), "variant")


def _names(value: Column) -> Column:
    """The strings of a list, as JSON; null for none."""
    found = F.from_json(F.to_json(value), "array<string>")
    return F.when(F.size(found) > 0, F.to_json(found))


def _other_keys(value: Column, *known: str) -> Column:
    """The names of an object's members but the known ones, as JSON; null for none."""
    keys = F.array_except(F.map_keys(F.from_json(F.to_json(value), "map<string, variant>")), F.array(*[F.lit(k) for k in known]))
    return F.when(F.size(keys) > 0, F.to_json(F.array_sort(keys)))


def _common(event: Column, config: Config) -> list[tuple[str, str, Column]]:
    string = lambda name, c: (name, "string", c)
    return [
        string("projection-mode", F.lit(config.mode)), string("event-kind", F.col("kind")), string("event-id", F.col("uuid")),
        string("atof-version", t.string_at(event, "atof_version")), string("name", F.col("name")), string("timestamp", t.string_at(event, "timestamp")),
        string("harness-id", F.lit(config.harness)), string("installation-id", F.lit(config.installation)),
        string("category", F.col("category")), string("scope-category", F.col("scope_category")),
        string("session-key", F.col("session")), string("session-id", identity.agent_id("session", F.col("session"), "session", config.domains)),
        string("actor-key", F.col("actor")), string("actor-id", identity.agent_id("actor", F.col("actor"), "actor", config.domains)),
        ("session-start", "bool", F.when(F.col("session_start"), F.lit("true"))), ("session-end", "bool", F.when(F.col("session_end"), F.lit("true"))),
        string("telemetry-provider", F.col("provider")), string("telemetry-trace-id", F.col("trace")), string("telemetry-span-id", F.col("span")),
        string("telemetry-session-id", F.col("telemetry_session")), string("telemetry-session-instance-id", F.col("instance")),
        string("telemetry-trace-ui-url", F.col("trace_url")), string("telemetry-trace-api-url", F.col("trace_api_url")),
        string("telemetry-span-ui-url", F.col("span_url")), string("telemetry-span-api-url", F.col("span_api_url")),
        string("trace-id", t.metadata_string(F.col("metadata"), t.TRACE, config.containers)), string("span-id", t.metadata_string(F.col("metadata"), t.SPAN, config.containers)),
        string("provider" if config.mode == "audit" else "trace-provider", t.metadata_string(F.col("metadata"), t.PROVIDER, config.containers)),
    ]


def _audited(event: Column) -> list[tuple[str, str, Column]]:
    """What only an audit keeps: the scope's own members, and digests and sizes of its payloads."""
    out = [
        ("parent-uuid", "string", F.col("parent_uuid")), ("scope-attributes", "list", _names(_member(event, "attributes"))),
        ("model-name", "string", t.string_at(event, "category_profile", "model_name")), ("tool-call-id", "string", t.string_at(event, "category_profile", "tool_call_id")),
        ("profile-extra-keys", "list", _other_keys(_member(event, "category_profile"), "model_name", "tool_call_id")),
        ("data-schema-name", "string", t.string_at(event, "data_schema", "name")), ("data-schema-version", "string", t.string_at(event, "data_schema", "version")),
    ]
    for name in ("data", "metadata"):
        payload = _member(event, name)
        digest, size = t.json_digest(F.to_json(payload))
        there = payload.isNotNull()
        out += [(f"{name}-digest", "string", F.when(there, digest)), (f"{name}-size", "int", F.when(there, size)), (f"{name}-present", "bool", F.when(there, F.lit("true")))]
    return out


def _linked() -> list[tuple[str, str, Column]]:
    return [("source-namespace", "string", F.col("source.ns")), ("source-kind", "string", F.col("source.kind")), ("source-id", "string", F.col("source.id")), ("outcome", "string", F.col("source.outcome"))]


def requests(rows: DataFrame, config: Config, evidence_at: str | None = None) -> DataFrame:
    """``rows`` of :func:`relay.projected` with ``source_ns``, ``source_kind``, ``source_id``, ``cursor``
    and ``attrs``, the columns that plugins observe.

    ``json`` is the event's whole text. With ``evidence_at``, the place of the lines, the columns of
    ``spool.evidence`` tell where in it an event is. What an event doesn't have has no attribute;
    a member that is null in the text is one that it doesn't have.
    """
    event = F.col("event json")
    parts = _common(event, config) + (_audited(event) if config.mode == "audit" else _linked())
    if evidence_at is not None:
        parts.append(("evidence-location" if config.mode == "audit" else "evidence-ref", "string", F.lit(evidence_at)))
        parts += [(name, tag, F.col(column)) for name, column, tag in EVIDENCE]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.struct(F.lit(tag).alias("tag"), c.cast("string").alias("text")).alias("value")) for n, tag, c in parts])
    attrs = F.map_from_entries(F.filter(entries, lambda e: e["value"]["text"].isNotNull())).cast(ATTRS)
    found = rows.withColumn("event json", F.try_parse_json("json")).withColumn("attrs", attrs).drop("event json")
    key = F.col("source_key")
    found = found.withColumn("source_ns", part(key, 1)).withColumn("source_kind", part(key, 2)).withColumn("source_id", part(key, 3))
    return found.withColumn("cursor", F.concat(F.lit(f"{config.mode}/"), F.col("source_id")))
