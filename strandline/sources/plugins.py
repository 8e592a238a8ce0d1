"""Plugins: from observation requests to batches of transactions.

A plugin is data, not code: a manifest with its schema, and which attributes of a request become
fields of the observed entity, relations to other entities, and attributes of the event. Every
request becomes one transaction with its request's source: the schema, one observation, one
event. Requests that don't fit give faults instead, one for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import text_of
from ..functions.identity import plugin_seed
from ..model import ATTRS, Log, external
from ..shared import written

ABI = "2"


class PluginError(ValueError):
    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


@dataclass(frozen=True)
class Relation:
    """attribute: of a request, a text or a list of texts, the ids of the targets; or an entity."""

    attribute: str
    name: str
    target: str
    role: str
    direction: str = "from-explained-by-to"
    target_ns: str | None = None


@dataclass(frozen=True)
class Plugin:
    """fields: (request attribute, field, type, needed); event_fields: fields that the event shows too."""

    id: str
    namespace: str
    kind: str
    id_attribute: str
    id_field: str
    seed: str
    fields: tuple[tuple[str, str, str, bool], ...]
    relations: tuple[Relation, ...] = ()
    ignored: tuple[str, ...] = ()
    event_fields: tuple[str, ...] = ()
    cursors: tuple[str, ...] = ()
    seed_has_cursor: bool = True
    version: str = "1"
    abi: str = ABI
    schemas: tuple[tuple[str, str], ...] = field(default=())


def _strings(*names: str, needed: bool = False) -> tuple:
    return tuple((n, n.replace("-", "_"), "string", needed) for n in names)


# The attributes and relations of the bundled sources.
TRACKER = Plugin(
    "beads", "beads", "issue", "issue-id", "issue_id", "beads-observation-v1",
    (*_strings("title", "status", "issue-type", "created-at", "updated-at", needed=True), ("priority", "priority", "int", True),
     *_strings("description", "created-by", "assignee", "started-at", "closed-at", "close-reason", "external-ref", "parent-id"), ("labels", "labels", "list<string>", False)),
    (Relation("depends-on", "depends-on", "issue", "supporting"), Relation("parent-id", "belongs-to", "issue", "supporting"), Relation("relates-to", "relates-to", "issue", "contextual", "symmetric")),
)
DOCUMENTS = Plugin(
    "dg", "dg", "document", "document-id", "document_id", "dg-observation-v1",
    (("document-type", "document_type", "string", True), *_strings("path", "title", "body", "status", "author", "date", "frontmatter-json", "sections-json", "payload-json", "revision"),
     ("tags", "tags", "list<string>", False), ("frontmatter", "frontmatter", "map<any>", False)),
    (*(Relation(n, n, "document", "supporting") for n in ("supersedes", "enables", "depends-on", "implements")), Relation("triggers", "triggers", "document", "causal"),
     Relation("conflicts-with", "conflicts-with", "document", "contradicting", "symmetric"), Relation("related", "related", "document", "contextual", "symmetric")),
    ignored=("before-json", "after-json", "diff-json"), event_fields=("document-id", "document-type", "path", "title", "revision"), cursors=("create", "update", "delete"),
)
TASKS = Plugin(
    "tracker", "tracker", "task", "task-id", "task_id", "hello-observation", (("title", "title", "string", False),),
    (Relation("linked-to", "linked-to", "task", "supporting"), Relation("current-commit", "implemented-by", "commit", "supporting", "to-explained-by-from", "jj")),
    seed_has_cursor=False,
)


class Registry:
    """Plugins by id, each the owner of its namespace."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        for name in ("id", "abi", "namespace"):
            if not getattr(plugin, name).strip():
                raise PluginError("EmptyManifestField", name)
        if plugin.abi != ABI:
            raise PluginError("UnsupportedAbi", plugin.abi)
        if plugin.id in self.plugins:
            raise PluginError("DuplicatePlugin", plugin.id)
        owner = next((p.id for p in self.plugins.values() if p.namespace == plugin.namespace), None)
        if owner is not None:
            raise PluginError("NamespaceConflict", f"{plugin.namespace} belongs to {owner}")
        if len(set(plugin.schemas)) < len(plugin.schemas):
            raise PluginError("DuplicateSchema", plugin.id)
        if any(ns != plugin.namespace for ns, _ in plugin.schemas):
            raise PluginError("SchemaNamespaceMismatch", plugin.id)
        self.plugins[plugin.id] = plugin

    def observe(self, id: str, requests: DataFrame) -> tuple[Log, DataFrame]:
        if id not in self.plugins:
            raise PluginError("UnknownPlugin", id)
        return observe(self.plugins[id], requests)


def schema_log(spark, plugin: Plugin) -> Log:
    """The plugin's schema as tables of a log, declared by a seed of its own."""
    ns, version, kind = plugin.namespace, plugin.version, plugin.kind
    fields = [(ns, version, kind, plugin.id_field, "string", True), *[(ns, version, kind, f, t, needed) for _, f, t, needed in plugin.fields]]
    fields += [(ns, version, kind, "event", "string", False), (ns, version, kind, "deleted", "bool", False)]
    relations = [(ns, version, ns, r.name, "external", ns, kind, "external", r.target_ns or ns, r.target, r.role, r.direction) for r in plugin.relations]
    return Log.of(spark, entity_schemas=[(ns, version, kind, False)], fields=fields, relation_schemas=relations)


def _targets(attrs: Column, r: Relation, ns: str) -> Column:
    """Keys of a relation's targets."""
    v = F.try_element_at(attrs, F.lit(r.attribute))
    ids = F.when(v["tag"] == "list", F.from_json(v["text"], "array<string>")).when(v["tag"] == "string", F.array(v["text"]))
    keys = F.transform(ids, lambda i: external(r.target_ns or ns, r.target, i))
    return F.coalesce(F.when(v["tag"] == "entity", F.array(v["text"])).otherwise(keys), F.array().cast("array<string>"))


def observe(plugin: Plugin, requests: DataFrame) -> tuple[Log, DataFrame]:
    """A batch (see ``operators.transact``) and faults (source_id, fault) of requests (source_ns,
    source_kind, source_id, cursor, attrs)."""
    spark, ns = requests.sparkSession, plugin.namespace
    attrs = F.col("attrs")
    tag = lambda n: F.try_element_at(attrs, F.lit(n))["tag"]
    known = [plugin.id_attribute, *[a for a, *_ in plugin.fields], *[r.attribute for r in plugin.relations], *plugin.ignored]
    own = external(ns, plugin.kind, text_of(attrs, plugin.id_attribute))
    lost = F.lit(False)
    for name, _, kind, needed in plugin.fields:
        right = tag(name) == kind.partition("<")[0]
        lost = lost | (F.coalesce(~right, F.lit(True)) if needed else F.coalesce(~right, F.lit(False)))
    looped = F.lit(False)
    for r in plugin.relations:
        looped = looped | F.array_contains(_targets(attrs, r, ns), own)
    fault = (
        F.when(F.col("source_ns") != ns, F.lit("SourceNamespaceMismatch"))
        .when((F.trim("source_kind") == "") | (F.trim("source_id") == ""), F.lit("InvalidSource"))
        .when(F.coalesce(text_of(attrs, plugin.id_attribute), F.lit("")) == "", F.lit("MissingAttribute"))
        .when(F.coalesce(~F.col("cursor").isin(*plugin.cursors), F.lit(True)) if plugin.cursors else F.lit(False), F.lit("InvalidEvent"))
        .when(F.size(F.array_except(F.map_keys(attrs), F.array(*[F.lit(k) for k in known]))) > 0, F.lit("UnknownAttribute"))
        .when(lost, F.lit("InvalidAttribute"))
        .when(looped, F.lit("SelfRelation"))
    )
    source = external(F.col("source_ns"), F.col("source_kind"), F.col("source_id"))
    raw = F.concat_ws("\0", F.lit(plugin.seed), "source_ns", "source_kind", "source_id", *([F.coalesce("cursor", F.lit(""))] if plugin.seed_has_cursor else []))
    rows = written(requests.withColumn("fault", fault).withColumn("source", source).withColumn("seed", plugin_seed(ns, plugin.id, raw)), "requests")
    good = rows.filter("fault IS NULL").dropDuplicates(["seed"])
    renamed = {plugin.id_attribute: plugin.id_field} | {a: f for a, f, *_ in plugin.fields}
    names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
    kept = F.map_filter(attrs, lambda k, _: k.isin(*renamed))
    seen = F.transform_keys(kept, lambda k, _: names[k])
    string = lambda c: F.struct(F.lit("string").alias("tag"), c.alias("text"))
    if plugin.cursors:
        gone = F.struct(F.lit("bool").alias("tag"), (F.col("cursor") == "delete").cast("string").alias("text"))
        seen = F.map_concat(seen, F.create_map(F.lit("event"), string(F.col("cursor")), F.lit("deleted"), gone))
    shown = F.map_filter(attrs, lambda k, _: k.isin(*plugin.event_fields) if plugin.event_fields else F.lit(False))
    shown = F.when(F.col("cursor").isNotNull(), F.map_concat(shown, F.create_map(F.lit("event"), string(F.col("cursor"))))).otherwise(shown)
    event = F.concat("seed", F.lit("#0"))
    good = good.withColumn("own", own)
    links = None
    for r in plugin.relations:
        mine = good.select(
            F.col("seed").alias("op_id"), event.alias("event_id"), F.lit(ns).alias("ns"), F.lit(plugin.version).alias("version"), F.lit(ns).alias("rel_ns"), F.lit(r.name).alias("name"),
            F.col("own").alias("src"), F.explode(F.array_distinct(_targets(attrs, r, ns))).alias("dst"), F.lit("[]").alias("attrs_canon"),
        )
        links = mine if links is None else links.unionByName(mine)
    batch = schema_log(spark, plugin)
    first = good.agg(F.min("seed").alias("op_id")).filter("op_id IS NOT NULL")
    batch.tables["operations"] = good.select(F.col("seed").alias("op_id"), "source", F.lit(None).cast(ATTRS).alias("attrs"))
    batch.tables["schemas"] = first.select("op_id", F.lit(-1).alias("ord"), F.lit(ns).alias("ns"), F.lit(plugin.version).alias("version"))
    batch.tables["observations"] = good.select(F.col("seed").alias("op_id"), F.lit(0).alias("ord"), F.col("own").alias("entity"), F.lit(ns).alias("ns"), F.lit(plugin.version).alias("version"), seen.alias("attrs"))
    batch.tables["events"] = good.select(F.col("seed").alias("op_id"), F.lit(1).alias("ord"), event.alias("event_id"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("actor"), shown.alias("attrs"))
    subjects = good.select(event.alias("event_id"), F.col("own").alias("entity"))
    if links is not None:
        batch.tables["relations"] = links
        subjects = subjects.unionByName(links.select("event_id", F.col("dst").alias("entity"))).distinct()
    batch.tables["subjects"] = subjects
    return batch, rows.filter("fault IS NOT NULL").select("source_id", "fault")
