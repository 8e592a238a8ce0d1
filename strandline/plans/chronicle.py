"""The chronicle: a bounded explanation of an entity, as dated records and folded counts.

The parts are DataFrames over the selected scope. Only the finished lines of the report, which
are as many as the explanation has records, come to the driver to be joined to one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import counter_of, first_text, format_value, quoted, saturating_sum, text_of, timestamp_of, title_of
from ..functions.text import TERMINAL, address_uri, clean_text, detail_uri, entity_uri, plain_entity, time_parts
from ..model import STRENGTHS, Log, is_external, part
from ..operators import graph
from ..operators.replay import latest_entities

ATTRIBUTE_LIMIT = 12
# Attributes in the order in which records show them.
PRIORITY = (
    "summary", "title", "status", "description", "finding", "stats", "evidence", "result", "metrics", "baseline", "constraints", "children", "in",
    "out", "decision", "change", "observations", "delta", "attribution", "caveat", "work", "sessions", "subagents", "edits", "files", "jj-range",
    "detail", "path", "config", "schema", "parent-id", "parent_id", "issue-id", "issue_id", "issue-type", "issue_type", "priority", "assignee",
    "labels", "created-at", "created_at", "updated-at", "updated_at", "commit-id", "commit_id", "change-id", "change_id", "current-commit",
    "current_commit", "author", "operation-id", "operation_id", "workspace-id", "workspace_id", "event-id", "event_id", "name", "event-kind",
    "timestamp", "occurred-at", "outcome", "harness", "harness-id", "installation-id", "conversation-ref", "evidence-ref", "evidence-digest",
    "telemetry-provider", "trace-provider", "provider", "telemetry-trace-id", "trace-id", "telemetry-span-id", "span-id", "telemetry-session-id",
    "telemetry-session-instance-id", "session-id", "actor-id", "scope-category", "category", "scope-attributes", "data-present", "data-size",
    "metadata-present", "metadata-size", "hook", "operation-kind", "projection", "source-system", "reason", "role", "phase",
)
NOT_OF_EVENTS = ("name", "event-kind", "timestamp", "occurred-at", "session-id", "actor-id")
EDITS = ("edits", "edit-count", "edit_count")
FILES = ("files", "file-count", "file_count")
SESSIONS = ("sessions", "session-count", "session_count")
SUBAGENTS = ("subagents", "subagent-count", "subagent_count")


def operation_scope(log: Log, target: str, initial: DataFrame) -> DataFrame:
    """Operations of the explanation and of the target's history, with all their ancestors."""
    start = initial.select("op_id").unionByName(log.observations.filter(F.col("entity") == target).select("op_id")).distinct()
    steps = log.parents.select(F.col("op_id").alias("here"), F.col("parent_id").alias("there"))
    found = graph.distances(steps, start.withColumnRenamed("op_id", "entity"))
    return found.select(F.col("entity").alias("op_id")).join(log.operations, "op_id", "left_semi")


def records(log: Log, operations: DataFrame) -> DataFrame:
    """One row for each event of the operations, and for those that only observe: op_id, event_id,
    ord, date, time, sort_key, in the order that ``sort_key``, ``op_id``, ``ord`` give."""
    ops = log.operations.join(operations, "op_id", "left_semi")
    events = log.events.join(operations, "op_id", "left_semi").select("op_id", "ord", "event_id", F.col("attrs").alias("e_attrs"))
    observing = log.observations.select("op_id").distinct()
    plain = ops.select("op_id").join(observing, "op_id", "left_semi").join(events, "op_id", "left_anti").select("op_id", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast(events.schema["e_attrs"].dataType).alias("e_attrs"))
    timed = None
    for table in ("observations", "sessions", "actors", "objects", "replicas"):
        own = getattr(log, table).join(operations, "op_id", "left_semi").select("op_id", "ord", timestamp_of(F.col("attrs")).alias("ts")).filter("ts IS NOT NULL")
        timed = own if timed is None else timed.unionByName(own)
    first = timed.groupBy("op_id").agg(F.min_by("ts", "ord").alias("fact_ts"))
    rows = events.unionByName(plain).join(first, "op_id", "left").join(ops.select("op_id", timestamp_of(F.col("attrs")).alias("op_ts")), "op_id")
    rows = rows.withColumn("ts", F.coalesce(timestamp_of(F.col("e_attrs")), F.col("fact_ts"), F.col("op_ts")))
    date, time = time_parts(F.col("ts"))
    date, time = F.coalesce(date, F.lit("undated")), F.coalesce(time, F.lit("--:--:--"))
    day = F.when(F.col("ts").isNull(), F.lit("~undated")).otherwise(F.concat(date, F.lit("T"), time))
    return rows.select("op_id", "event_id", "ord", date.alias("date"), time.alias("time"), F.concat(day, F.lit(":"), F.col("op_id")).alias("sort_key"))


def folded(log: Log, operations: DataFrame) -> DataFrame:
    """One row: sessions, subagents, operations, edits, files (null where nothing counts them)."""
    within = lambda t: t.join(operations, "op_id", "left_semi")
    events, ops, opened, actors = within(log.events), within(log.operations), within(log.sessions), within(log.actors)
    session_ids = opened.select(F.col("session_id").alias("id")).unionByName(events.select("session")
        .withColumnRenamed("session", "id")).unionByName(events.select(text_of(F.col("attrs"), "session-id").alias("id")))
    actor_ids = actors.select(F.col("actor_id").alias("id")).unionByName(events.select(F.col("actor").alias("id"))).unionByName(events.select(text_of(F.col("attrs"), "actor-id").alias("id")))
    count = lambda aliases: counter_of(F.col("attrs"), aliases)
    counted = opened.select(count(("edits",)).alias("edits"), count(("files",)).alias("files")).unionByName(events.select(count(EDITS).alias("edits"), count(FILES).alias("files"))).unionByName(ops.select(count(EDITS).alias("edits"), count(FILES).alias("files")))
    sums = counted.agg(saturating_sum(F.col("edits")).alias("edits"), saturating_sum(F.col("files")).alias("files"))
    explicit = ops.agg(saturating_sum(count(SESSIONS)).alias("x_sessions"), saturating_sum(count(SUBAGENTS)).alias("x_subagents"))
    meaningful = within(log.events.select("op_id").unionByName(log.observations.select("op_id"))).agg(F.countDistinct("op_id").alias("operations"))
    one = session_ids.agg(F.countDistinct("id").alias("n_sessions")).withColumn("k", F.lit(0))
    for more in (actor_ids.agg(F.countDistinct("id").alias("n_actors")), sums, explicit, meaningful):
        one = one.join(more.withColumn("k", F.lit(0)), "k")
    return one.select(
        F.coalesce("x_sessions", "n_sessions").cast("decimal(38,0)").alias("sessions"), F.coalesce("x_subagents", "n_actors").cast("decimal(38,0)").alias("subagents"),
        "operations", "edits", "files",
    )


def open_entities(latest: DataFrame, entities: DataFrame) -> DataFrame:
    """Selected entities whose latest status is not a terminal one: entity, status."""
    found = latest.join(entities, "entity", "left_semi").withColumn("status", text_of(F.col("attrs"), "status"))
    return found.filter(F.col("status").isNotNull() & ~F.lower("status").isin(*TERMINAL)).select("entity", "status")


def attribute_lines(attrs: DataFrame, keys: list[str], label: str, excluded: tuple[str, ...]) -> DataFrame:
    """(keys, lines): the first ATTRIBUTE_LIMIT attributes by priority, and how many are left out."""
    at = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(i).alias("v")) for i, n in enumerate(PRIORITY)]))
    rows = attrs.select(*keys, F.explode("attrs").alias("name", "v")).filter(~F.col("name").isin(*excluded))
    rank = F.try_element_at(at, F.col("name"))
    ranked = rows.withColumn("rank", rank).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rank").asc_nulls_last(), "name")))
    shown = F.when((F.col("n") <= ATTRIBUTE_LIMIT) & F.col("rank").isNotNull(), F.struct("n", F.concat(F.lit("  "), F.col("name"), F.lit(": "), format_value(F.col("v"))).alias("line")))
    grouped = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("considered"), F.array_sort(F.collect_list(shown)).alias("shown"))
    omitted = F.col("considered") - F.size("shown")
    last = F.when(omitted > 0, F.array(F.concat(F.lit(f"  {label}: +"), omitted.cast("string"), F.lit(" attrs omitted")))).otherwise(F.array().cast("array<string>"))
    return grouped.select(*keys, F.concat(F.transform("shown", lambda s: s["line"]), last).alias("lines"))


def record_label(source: Column, subject: Column) -> Column:
    ns, kind, s_ns = part(source, 1), part(source, 2), part(subject, 1)
    of_source = F.when((ns == "beads") & (kind == "hook"), "FEATURE").when(ns == "beads", "BEADS").when((ns == "jj") & (kind == "operation"), "OPERATION").when(ns == "jj", "JJ").when(ns == "agent", "AGENT").otherwise("RECORD")
    of_subject = F.when(s_ns == "beads", "FEATURE").when(s_ns == "jj", "JJ").when(s_ns == "agent", "AGENT").otherwise("RECORD")
    return F.when(source.isNotNull(), of_source).when(is_external(subject), of_subject).otherwise("RECORD")


def telemetry_line(attrs: Column) -> Column:
    parts = (
        ("", ("telemetry-provider", "trace-provider", "provider")), (" trace", ("telemetry-trace-id", "trace-id")), (" span", ("telemetry-span-id", "span-id")),
        (" session", ("telemetry-session-id",)), (" instance", ("telemetry-session-instance-id",)),
    )
    texts = [F.concat(F.lit(f"{label} "), clean_text(first_text(attrs, names))) for label, names in parts]
    return F.when(F.coalesce(*texts).isNotNull(), F.concat(F.lit("  telemetry"), *[F.coalesce(t, F.lit("")) for t in texts]))


@dataclass
class Chronicle:
    log: Log
    target: str
    max_depth: int

    def __post_init__(self) -> None:
        self.result = graph.explain(self.log, self.target, self.max_depth)
        self.operations = operation_scope(self.log, self.target, self.result.operations)
        self.records = records(self.log, self.operations)
        self.latest = latest_entities(self.log)

    def record_lines(self) -> DataFrame:
        """(sort_key, op_id, ord, date, lines) of every record."""
        log, target = self.log, self.target
        rows = self.records
        ops = log.operations.select("op_id", "source", F.col("attrs").alias("op_attrs"))
        parents = log.parents.groupBy("op_id").agg(F.array_sort(F.collect_set("parent_id")).alias("parents"))
        events = log.events.select("event_id", "session", "actor", F.col("attrs").alias("e_attrs"))
        subjects = log.subjects.groupBy("event_id").agg(F.array_sort(F.collect_set("entity")).alias("subjects"))
        seen = log.observations.join(self.operations, "op_id", "left_semi")
        own = seen.filter(F.col("entity") == target).groupBy("op_id").agg(F.min_by("attrs", "ord").alias("t_attrs"), F.min_by(title_of(F.col("attrs")), F.when(title_of(F.col("attrs")).isNotNull(), F.col("ord"))).alias("t_title"))
        by_source = seen.join(ops.select("op_id", "source"), "op_id").filter("entity = source").groupBy("op_id").agg(F.min_by("attrs", "ord").alias("s_attrs"), F.min_by(title_of(F.col("attrs")), F.when(title_of(F.col("attrs")).isNotNull(), F.col("ord"))).alias("s_title"))
        shown = seen.join(self.result.entities, "entity", "left_semi").groupBy("op_id").agg(F.array_sort(F.collect_set(entity_uri(F.col("entity")))).alias("entities"))
        relation = F.concat_ws("/", "rel_ns", "name")
        line = F.concat(F.lit("  relation: "), entity_uri(F.col("src")), F.lit(" -["), relation, F.lit(" "), F.concat_ws("@", "ns", "version"), F.lit("]-> "), entity_uri(F.col("dst")))
        links = self.result.edges.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct(relation.alias("r"), entity_uri(F.col("src")).alias("s"), entity_uri(F.col("dst")).alias("d"), line.alias("line")))).alias("links"))
        level = lambda c: F.element_at(F.array(*[F.lit(s) for s in STRENGTHS]), c + 1)
        owner = F.concat_ws("/", "owner_kind", "owner_id")
        kept = log.claims.select("op_id", "ord", F.concat(F.lit("  retention: "), entity_uri(F.col("resource")), F.lit(" owner="), owner, F.lit(" strength="), level(F.col("strength"))).alias("line"))
        held = F.coalesce(F.concat(F.lit(" retention="), level(F.col("retention"))), F.lit(""))
        kept = kept.unionByName(log.resources.select("op_id", "ord", F.concat(F.lit("  resource: "), entity_uri(F.col("resource")), F.lit(" availability="), F.col("availability"), F.lit(" integrity="), F.col("integrity"), held).alias("line")))
        kept = kept.groupBy("op_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("kept"))
        for table, on in ((ops, "op_id"), (parents, "op_id"), (own, "op_id"), (by_source, "op_id"), (shown, "op_id"), (kept, "op_id"), (events, "event_id"), (subjects, "event_id"), (links, "event_id")):
            rows = rows.join(table, on, "left")
        about = F.when(F.col("t_attrs").isNotNull(), F.col("t_attrs")).when(F.col("event_id").isNull(), F.col("s_attrs"))
        title_left_out = F.map_filter(about, lambda k, _: (k != "title") | F.col("t_attrs").isNull())
        keys = ["op_id", "ord"]
        for name, attrs, label, excluded in (("a_lines", title_left_out, "attributes", ()), ("e_lines", F.col("e_attrs"), "event-attributes", NOT_OF_EVENTS), ("o_lines", F.col("op_attrs"), "operation-attributes", ())):
            found = attribute_lines(rows.select(*keys, attrs.alias("attrs")), keys, label, excluded).withColumnRenamed("lines", name)
            rows = rows.join(found, keys, "left")
        title = F.coalesce("t_title", "s_title", title_of(F.col("e_attrs")))
        address = F.when(F.col("t_attrs").isNotNull(), address_uri(F.lit(target))).when(F.col("source").isNotNull(), address_uri(F.col("source"))).otherwise(F.concat(F.lit("prov://operation/"), F.col("op_id")))
        head = F.concat(F.col("time"), F.lit(" "), record_label(F.col("source"), F.get("subjects", F.lit(0))), F.lit(" "), address, F.coalesce(F.concat(F.lit(" "), quoted(clean_text(title))), F.lit("")))
        listed = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(f"  {label}: ["), F.concat_ws(", ", items), F.lit("]")))
        one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
        many = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
        lines = F.concat(
            F.array(head), F.array(F.concat(F.lit("  operation: prov://operation/"), F.col("op_id"))),
            one(listed("parents", F.transform("parents", lambda p: F.concat(F.lit("prov://operation/"), p)))),
            one(F.concat(F.lit("  source: "), address_uri(F.col("source")))),
            one(listed("entities", F.col("entities"))), many("a_lines"), many("e_lines"),
            one(F.concat(F.lit("  session: "), F.col("session"))), one(F.concat(F.lit("  actor: "), F.col("actor"))), one(telemetry_line(F.col("e_attrs"))),
            many("o_lines"), one(F.concat(F.lit("  event: "), F.col("event_id"))),
            one(listed("subjects", F.transform("subjects", entity_uri))),
            F.coalesce(F.transform("links", lambda x: x["line"]), F.array().cast("array<string>")),
            F.coalesce(F.transform("kept", lambda x: x["line"]), F.array().cast("array<string>")),
        )
        return rows.select("sort_key", "op_id", "ord", "date", lines.alias("lines"))

    def text(self) -> str:
        """The whole report."""
        spark, target = self.log.spark, self.target
        uri, detail = spark.range(1).select(entity_uri(F.lit(target)), detail_uri(F.lit(target))).first()
        known = self.latest.filter(F.col("entity") == target).select(quoted(clean_text(title_of(F.col("attrs")))).alias("title"), quoted(clean_text(text_of(F.col("attrs"), "status"))).alias("status")).first()
        title, status = (known.title, known.status) if known and target[0] == "X" else (None, None)
        n = {k: getattr(self.result, k).count() for k in ("entities", "events", "edges")}
        lines = self.record_lines().orderBy("sort_key", "op_id", "ord").collect()
        counts = folded(self.log, self.operations).first()
        fold = f"sessions={counts.sessions} subagents={counts.subagents} operations={counts.operations} entities={n['entities']} events={n['events']} edges={n['edges']}"
        fold += "".join(f" {k}={counts[k]}" for k in ("edits", "files") if counts[k] is not None)
        out = ["@chronicle 1", f"query: why {uri}", f"target: {uri}" + (f" {title}" if title else ""), "timebase: UTC", f"scope: causal depth={self.max_depth}"]
        about = (f"status={status}; " if status else "") + (f"title={title}; " if title else "")
        out.append(f"summary: {about}causal scope contains {n['entities']} entities, {n['events']} events, and {n['edges']} explanatory edges across {len(lines)} records")
        out += [f"path: {self.path()}", f"folded: {fold}", f"detail: {detail}"]
        date = None
        for r in lines:
            if r.date != date:
                date = r.date
                out += ["", date]
            out += r.lines
        out += ["@end", f"result: {uri} records={len(lines)} operations={counts.operations} entities={n['entities']} edges={n['edges']}"]
        still = open_entities(self.latest, self.result.entities).select(F.concat(entity_uri(F.col("entity")), F.lit(" status="), quoted(clean_text(F.col("status")))).alias("t")).collect()
        if still:
            out.append("open: " + ", ".join(sorted(r.t for r in still)))
        return "\n".join(out)

    def path(self) -> str:
        steps = graph.causal_path(self.result.edges, self.log.relation_schemas, self.target, self.max_depth)
        spark = self.log.spark
        keys = [self.target, *[s["there"] for s in steps]]
        named = {r.k: r.u for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", entity_uri(F.col("k")).alias("u")).collect()}
        out = named[self.target]
        for s in steps:
            relation = f"{s['rel_ns']}/{s['name']}"
            out += f" -[{relation}]-> {named[s['there']]}" if s["forward"] else f" <-[{relation}]- {named[s['there']]}"
        return out


def compact(log: Log, operations: DataFrame) -> DataFrame:
    """One line for each operation: its id, parents, source, and how many facts of each kind."""
    counts = None
    for name in ("observations", "events", "sessions", "actors", "objects", "replicas", "claims", "resources"):
        own = getattr(log, name).join(operations, "op_id", "left_semi").groupBy("op_id").agg(F.count(F.lit(1)).alias("n")).select("op_id", F.concat(F.lit(f"{name}="), F.col("n").cast("string")).alias("c"))
        counts = own if counts is None else counts.unionByName(own)
    facts = counts.groupBy("op_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("c"))).alias("facts"))
    parents = log.parents.groupBy("op_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("parent_id"))).alias("parents"))
    rows = log.operations.join(operations, "op_id", "left_semi").join(facts, "op_id", "left").join(parents, "op_id", "left")
    return rows.select("op_id", F.concat_ws(" ", "op_id", F.concat(F.lit("<- "), F.col("parents")), F.concat(F.lit("source="), plain_entity(F.col("source"))), "facts").alias("line"))
