"""Hook payloads: one JSON text for each row, read into observation requests.

A request is source_ns, source_kind, source_id, cursor and attrs (typed attributes). Payloads
that can't be read give a row with ``fault`` instead. Input columns: payload, and optionally
event, entity_id and source_id, which a hook's arguments may have given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.telemetry import string_at
from ..functions.text import document_type
from ..model import ATTRS

# Members of a tracker's snapshot with the names of their attributes.
TRACKER_FIELDS = (
    ("id", "issue-id"), ("title", "title"), ("description", "description"), ("status", "status"), ("issue_type", "issue-type"), ("assignee", "assignee"),
    ("created_at", "created-at"), ("created_by", "created-by"), ("updated_at", "updated-at"), ("started_at", "started-at"), ("closed_at", "closed-at"),
    ("close_reason", "close-reason"), ("external_ref", "external-ref"), ("parent_id", "parent-id"),
)
DOCUMENT_RELATIONS = ("supersedes", "enables", "triggers", "depends_on", "implements", "conflicts_with", "related")
RESERVED = ("source", "cursor", "attributes", "event")


def member(v: Column, *path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "variant")


def kind_of(v: Column) -> Column:
    """null, bool, int, decimal, string, list, object; SQL null if there is no value."""
    schema = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(schema == "VOID", F.lit("null")).when(schema == "BOOLEAN", F.lit("bool")).when(schema == "BIGINT", F.lit("int"))
        .when(schema == "STRING", F.lit("string")).when(schema.startswith("ARRAY"), F.lit("list")).when(schema.startswith("OBJECT"), F.lit("object"))
        .when(schema.startswith("DECIMAL") & schema.endswith(",0)"), F.lit("int"))
        .otherwise(F.lit("decimal"))
    )


def unwrapped(v: Column) -> Column:
    """The payload itself if it looks like a snapshot, else its ``data``, or the first of it."""
    direct = F.lit(False)
    for name in ("id", "before", "after", "frontmatter"):
        direct = direct | member(v, name).isNotNull()
    data = member(v, "data")
    first = F.try_variant_get(data, "$[0]", "variant")
    return F.when(direct, v).when(kind_of(data) == "object", data).when((kind_of(data) == "list") & first.isNotNull(), first).otherwise(v)


def typed(v: Column) -> Column:
    """A value as an attribute: tag and text. An object with ``entity`` is that entity's key; of
    other objects, and in lists, JSON text is kept, nested lists and objects of a map left out."""
    kind = kind_of(v)
    address = F.coalesce(member(v, "entity"), member(v, "entity-value"))
    key = F.concat(F.lit("X\0"), string_at(address, "namespace"), F.lit("\0"), string_at(address, "kind"), F.lit("\0"), string_at(address, "id"))
    plain = F.to_json(v)
    tag = F.when((kind == "object") & key.isNotNull(), F.lit("entity")).when(kind == "object", F.lit("map")).otherwise(kind)
    text = F.when(kind == "null", F.lit(None)).when(kind == "string", F.try_variant_get(v, "$", "string")).when(tag == "entity", key).otherwise(plain)
    return F.struct(tag.alias("tag"), text.cast("string").alias("text"))


def string_list(v: Column) -> Column:
    """A string, or strings and objects with ``id``, as a list of texts; null for anything else."""
    items = F.from_json(F.to_json(v), "array<variant>")
    own = F.transform(items, lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), string_at(x, "id")))
    kind = kind_of(v)
    return (
        F.when(kind == "string", F.array(F.try_variant_get(v, "$", "string")))
        .when((kind == "list") & ~F.exists(own, lambda x: x.isNull()), own)
        .when((kind == "null") | kind.isNull(), F.array().cast("array<string>"))
    )


def _attributes(*pairs: tuple[str, Column, Column]) -> Column:
    """A map of (name, tag, text), without those that have no tag."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.struct(t.alias("tag"), x.cast("string").alias("text")).alias("value")) for n, t, x in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"]["tag"].isNotNull()))


def _string(name: str, text: Column) -> tuple[str, Column, Column]:
    return name, F.when(text.isNotNull(), F.lit("string")), text


def _strings(name: str, texts: Column) -> tuple[str, Column, Column]:
    return name, F.when(F.size(texts) > 0, F.lit("list")), F.to_json(texts)


def _prepared(payloads: DataFrame) -> DataFrame:
    df = payloads
    for name in ("event", "entity_id", "source_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    v = F.try_parse_json("payload")
    return df.withColumn("v", v).withColumn("snapshot", unwrapped(F.col("v")))


def _requests(df: DataFrame, ns: str | Column, kind: Column, id: Column, cursor: Column, attrs: Column, fault: Column) -> DataFrame:
    ok = fault.isNull()
    return df.select(
        "payload", F.when(ok, F.lit(ns) if isinstance(ns, str) else ns).alias("source_ns"), F.when(ok, kind).alias("source_kind"), F.when(ok, id).alias("source_id"),
        F.when(ok, cursor).alias("cursor"), F.when(ok, attrs).cast(ATTRS).alias("attrs"), fault.alias("fault"),
    )


def tracker_requests(payloads: DataFrame, ns: str = "beads", dependencies: DataFrame | None = None) -> DataFrame:
    """Issue snapshots. ``dependencies`` (issue_id, depends_on array) stands in for snapshots that
    name none."""
    df = _prepared(payloads)
    snap = F.col("snapshot")
    event = F.coalesce("event", string_at(F.col("v"), "event"))
    issue = F.coalesce("entity_id", string_at(snap, "id"))
    updated = F.coalesce(string_at(snap, "updated_at"), string_at(snap, "updated-at"))
    given = F.coalesce(member(snap, "depends_on"), member(snap, "depends-on"), member(snap, "dependencies"))
    df = df.withColumn("issue", issue)
    needs = string_list(given)
    if dependencies is not None:
        df = df.join(dependencies.select(F.col("issue_id").alias("d_id"), F.col("depends_on").alias("d_needs")), F.col("issue") == F.col("d_id"), "left")
        needs = F.when(given.isNull(), F.coalesce("d_needs", F.array().cast("array<string>"))).otherwise(needs)
    priority = typed(member(snap, "priority"))
    attrs = _attributes(
        *[_string(name, string_at(snap, field)) for field, name in TRACKER_FIELDS],
        ("priority", priority["tag"], priority["text"]),
        _strings("labels", string_list(member(snap, "labels"))),
        _strings("depends-on", needs),
    )
    fault = (
        F.when(F.col("v").isNull(), F.lit("InvalidJson")).when(event.isNull(), F.lit("MissingEvent")).when(~event.isin("create", "update", "close"), F.lit("InvalidEvent"))
        .when(issue.isNull(), F.lit("MissingId")).when(updated.isNull(), F.lit("MissingUpdatedAt")).when(needs.isNull(), F.lit("InvalidList"))
    )
    return _requests(df, ns, F.lit("hook"), F.coalesce("source_id", F.concat_ws("/", event, issue, updated)), event, attrs, fault)


def document_requests(payloads: DataFrame, ns: str = "dg") -> DataFrame:
    """Document changes with frontmatter; the revision is the SHA-256 of the payload."""
    df = _prepared(payloads)
    v = F.col("v")
    event = F.coalesce("event", string_at(v, "event"))
    now = F.when((event == "update") & member(v, "after").isNotNull(), member(v, "after")).otherwise(v)
    df = df.withColumn("now", now)
    now = F.col("now")
    id = F.coalesce("entity_id", string_at(now, "id"))
    front = member(now, "frontmatter")
    matter = F.when(kind_of(front) == "object", front)
    revision = F.sha2("payload", 256)
    attrs = _attributes(
        _string("document-id", id), _string("document-type", document_type(id)),
        *[_string(n, string_at(now, n)) for n in ("path", "title", "body")],
        ("frontmatter", F.when(matter.isNotNull(), F.lit("map")), F.to_json(matter)), _string("frontmatter-json", F.to_json(matter)),
        *[_string(n, string_at(matter, n)) for n in ("status", "author", "date")],
        _strings("tags", string_list(member(matter, "tags"))),
        *[_strings(n.replace("_", "-"), string_list(member(matter, n))) for n in DOCUMENT_RELATIONS],
        _string("sections-json", F.to_json(member(now, "sections"))), _string("payload-json", F.col("payload")), _string("revision", revision),
        *[_string(f"{n}-json", F.when(event == "update", F.to_json(member(v, n)))) for n in ("before", "after", "diff")],
    )
    fault = (
        F.when(v.isNull(), F.lit("InvalidJson")).when(event.isNull(), F.lit("MissingEvent"))
        .when(~event.isin("create", "update", "delete"), F.lit("InvalidEvent")).when(id.isNull(), F.lit("MissingId"))
    )
    return _requests(df, ns, F.lit("hook"), F.coalesce("source_id", F.concat_ws("/", event, id, revision)), event, attrs, fault)


def _map_of(v: Column, without: tuple[str, ...] = ()) -> Column:
    members = F.map_entries(F.from_json(F.to_json(v), "map<string, variant>"))
    kept = F.filter(members, lambda e: ~e["key"].isin(*without)) if without else members
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), typed(F.coalesce(e["value"], F.parse_json(F.lit("null")))).alias("value"))))


def generic_requests(payloads: DataFrame, ns: str, kind: str = "hook") -> DataFrame:
    """Any JSON object: every member but the reserved ones is an attribute."""
    df = _prepared(payloads)
    v = F.col("v")
    id = F.concat_ws("/", F.coalesce("event", F.lit("observe")), F.coalesce("entity_id", F.lit("payload")), F.sha2("payload", 256))
    fault = F.when(v.isNull(), F.lit("InvalidJson")).when(kind_of(v) != "object", F.lit("NotAnObject"))
    attrs = F.when(kind_of(v) == "object", _map_of(v, RESERVED))
    return _requests(df, ns, F.lit(kind), F.coalesce("source_id", id), F.col("event"), attrs, fault)


def canonical_requests(payloads: DataFrame) -> DataFrame:
    """Payloads that carry source, cursor and attributes as an object themselves."""
    df = _prepared(payloads)
    v = F.col("v")
    source = {n: F.nullif(string_at(v, "source", f), F.lit("")) for n, f in (("ns", "namespace"), ("kind", "kind"), ("id", "id"))}
    given = member(v, "attributes")
    fault = (
        F.when(v.isNull(), F.lit("InvalidJson")).when(member(v, "source").isNull(), F.lit("MissingSource"))
        .when(source["ns"].isNull() | source["kind"].isNull() | source["id"].isNull(), F.lit("InvalidSource")).when(given.isNull(), F.lit("MissingAttributes"))
    )
    attrs = F.when(kind_of(given) == "object", _map_of(given))
    return _requests(df, source["ns"], source["kind"], source["id"], F.coalesce(string_at(v, "cursor"), F.col("event")), attrs, fault)
