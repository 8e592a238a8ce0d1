"""Agent events as lineage: sessions, actors, telemetry and causal parents of a stream.

Events are handled in arrival order (``seq``). What an event inherits comes from its scope: a
scope's session, telemetry ids and so on hold for events whose parent it is. A batch resolves
inheritance at any depth by doubling pointers to ancestors over the events it has and the scope
table that earlier batches left; nothing is bound to event time, so there is no watermark. A parent that
arrives late isn't linked.

``stream`` runs this in micro-batches: each commits its rows and its scopes under its batch id,
so that a batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import telemetry as t
from ..functions.text import render_url
from ..model import external
from ..shared import written

ACTORS = "session string, last_actor string"
SCOPES = "uuid string, session string, telemetry_session string, instance string, trace string, span string, category string, root boolean"


@dataclass
class Config:
    harness: str
    installation: str
    mode: str = "link"  # or "audit"
    provider: str | None = None
    project: str | None = None
    trace_url: str | None = None
    span_url: str | None = None
    trace_api_url: str | None = None
    span_api_url: str | None = None
    containers: tuple[str, ...] = t.CONTAINERS
    source_containers: tuple[str, ...] = t.SOURCE_CONTAINERS
    domains: identity.Domains = identity.DOMAINS

    def __post_init__(self) -> None:
        if self.mode not in ("link", "audit"):
            raise ValueError(f"unknown capture mode {self.mode!r}")
        for template, needed in ((self.trace_url, "trace_id"), (self.span_url, "span_id"), (self.trace_api_url, "trace_id"), (self.span_api_url, "span_id")):
            if template is not None:
                check_template(template, needed)


def check_template(template: str, needed: str) -> None:
    """A URL template: http or https, no white space, known placeholders, the needed one among them."""
    import re

    if not re.match(r"https?://", template) or re.search(r"\s", template):
        raise ValueError(f"not an http URL template: {template!r}")
    names = re.findall(r"\{([^{}]*)\}", template)
    if re.search(r"[{}]", re.sub(r"\{[^{}]*\}", "", template)) or set(names) - {"trace_id", "span_id", "provider", "project"}:
        raise ValueError(f"bad placeholder in {template!r}")
    if needed not in names:
        raise ValueError(f"{template!r} lacks {{{needed}}}")


def event_key(uuid: Column, kind: Column, scope: Column) -> Column:
    return F.concat_ws("/", uuid, F.when(kind == "scope", scope).otherwise(F.lit("mark")))


def deduplicated(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first event of each key, without those whose keys were seen before."""
    keyed = events.withColumn("key", event_key(F.col("uuid"), F.col("kind"), F.col("scope_category")))
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).filter("nth = 1").drop("nth")
    return first if seen is None else first.join(seen.select("key"), "key", "left_anti")


def _seed(config: Config, kind: str, raw: Column) -> Column:
    return identity.scoped_seed(kind, config.harness, config.installation, raw, config.domains)


def annotated(events: DataFrame, config: Config) -> DataFrame:
    """Events with what their own metadata says, and whether they bound sessions."""
    m = F.col("metadata")
    said = lambda keys: t.metadata_string(m, keys, config.containers)
    hook = said(t.HOOK_EVENT)
    mark, scope = F.col("kind") == "mark", F.col("kind") == "scope"
    raw = said(t.SESSION)
    return events.select(
        "*", raw.alias("raw_session"), _seed(config, "session", raw).alias("own_session"), said(t.SESSION_INSTANCE).alias("own_instance"),
        said(t.ACTOR).alias("raw_actor"), said(t.TELEMETRY_TRACE).alias("own_trace"), said(t.TELEMETRY_SPAN).alias("own_span"),
        (F.lit(config.provider) if config.provider else said(t.TELEMETRY_PROVIDER)).cast("string").alias("provider"),
        t.source_of(m, config.source_containers).alias("source"),
        (mark & ((F.col("name") == "session.start") | F.coalesce(hook == "SessionStart", F.lit(False)))).alias("start_mark"),
        (mark & ((F.col("name") == "session.end") | F.coalesce(hook == "SessionEnd", F.lit(False)))).alias("end_mark"),
        (scope & F.coalesce(F.col("category") == "agent", F.lit(False))).alias("agent_scope"),
    )


def own_scopes(events: DataFrame, config: Config) -> DataFrame:
    """One row for each scope that annotated events start or end, with its parent and its own values."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.filter("kind = 'scope'").groupBy("uuid").agg(
        first("parent_uuid"), first("own_session"), first("raw_session"), first("own_instance"), first("own_trace"), first("own_span"),
        F.bool_or("agent_scope").alias("agent_scope"), F.bool_or(F.col("scope_category") == "start").alias("started"), F.min("seq").alias("seq"),
    )


INHERITED = ("session", "telemetry_session", "instance", "trace", "span")


def resolved_scopes(scopes: DataFrame, known: DataFrame, config: Config) -> DataFrame:
    """Session and telemetry of every scope (SCOPES columns): its own, else its parent's, else, for
    an agent scope without a parent in a session, a session of its own.

    What a scope has is first, then its ancestor's value, then last; this is so for a scope and its
    parent taken together, too, so each round doubles how far up a scope looks.
    """
    none = F.lit(None).cast("string")
    unseen = written(scopes.join(known, "uuid", "left_anti"), "scopes")
    own = {
        "session": F.col("own_session"), "telemetry_session": F.col("raw_session"), "instance": F.col("own_instance"), "trace": F.col("own_trace"),
        "span": F.coalesce("own_span", F.when(F.col("started"), t.span_id(F.col("uuid")))),
    }
    fallback = {"session": F.when(F.col("agent_scope"), _seed(config, "session", F.concat(F.lit("relay-root:"), F.col("uuid")))), "trace": F.when(F.col("started"), t.trace_id(F.col("uuid")))}
    firsts, lasts = [f"first_{c}" for c in INHERITED], [f"last_{c}" for c in fallback]
    start = unseen.select("uuid", "parent_uuid", *[own[c].alias(f"first_{c}") for c in INHERITED], *[fallback[c].alias(f"last_{c}") for c in fallback])
    there = unseen.select("uuid").unionByName(known.select("uuid")).select(F.col("uuid").alias("p")).distinct()
    linked = start.join(there, F.col("parent_uuid") == F.col("p"), "left").withColumn("up", F.col("p")).drop("p", "parent_uuid")
    linked = written(linked, "scope-links")
    done = known.select("uuid", *[F.col(c).alias(f"first_{c}") for c in INHERITED], *[none.alias(c) for c in lasts], none.alias("up")).unionByName(linked.filter("up IS NULL"))
    left = linked.filter("up IS NOT NULL")
    n = left.count()
    while n:
        above = done.unionByName(left).select(F.col("uuid").alias("p"), F.col("up").alias("p_up"), *[F.col(c).alias(f"p_{c}") for c in firsts + lasts])
        step = left.join(above, F.col("up") == F.col("p")).select(
            "uuid", *[F.coalesce(c, f"p_{c}").alias(c) for c in firsts], *[F.coalesce(f"p_{c}", c).alias(c) for c in lasts], F.col("p_up").alias("up")
        )
        step = written(step, "scope-links")
        still = step.filter("up IS NOT NULL")
        before, n = n, still.count()
        if n == before:  # parents in a circle: they inherit nothing
            alone = start.join(still.select("uuid"), "uuid", "left_semi").withColumn("up", none).drop("parent_uuid")
            done, n = done.unionByName(alone), 0
            circles = still.select("uuid", F.lit(True).alias("circle"))
            unseen = unseen.join(circles, "uuid", "left").withColumn("parent_uuid", F.when(F.col("circle").isNull(), F.col("parent_uuid"))).drop("circle")
        else:
            done, left = done.unionByName(step.filter("up IS NULL")), still
    values = written(done.select("uuid", *[F.coalesce(f"first_{c}", *([f"last_{c}"] if c in fallback else [])).alias(c) for c in INHERITED]), "scope-values")
    up = values.select(F.col("uuid").alias("p"), F.col("session").alias("p_session"))
    rows = unseen.select("uuid", "parent_uuid", "agent_scope").join(values, "uuid").join(up, F.col("parent_uuid") == F.col("p"), "left")
    rows = rows.select("uuid", *INHERITED, F.when(F.col("agent_scope"), F.lit("agent")).alias("category"), (F.col("agent_scope") & F.col("p_session").isNull()).alias("root"))
    return known.unionByName(rows)


def resolved(events: DataFrame, config: Config, known_scopes: DataFrame | None = None, known_actors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events with session, actor, telemetry and boundaries, and all scopes known now.

    The actor of an event is the last one that its session named, here or in ``known_actors``
    (session, last_actor) of earlier batches, so results don't depend on where batches are cut.
    """
    spark = events.sparkSession
    known = spark.createDataFrame([], SCOPES) if known_scopes is None else known_scopes
    noted = annotated(events, config)
    scopes = resolved_scopes(own_scopes(noted, config), known, config)
    # an annotated event that isn't a root also tells the session of its parent, if nothing else does
    lent = noted.filter("own_session IS NOT NULL AND parent_uuid IS NOT NULL AND (kind = 'scope' AND NOT (agent_scope AND scope_category = 'start') OR start_mark)")
    lent = lent.groupBy("parent_uuid").agg(F.min_by("own_session", "seq").alias("lent"))
    mine = scopes.select(F.col("uuid").alias("m"), *[F.col(c).alias(f"m_{c}") for c in ("session", "telemetry_session", "instance", "trace", "span", "root")])
    up = scopes.select(F.col("uuid").alias("p"), *[F.col(c).alias(f"p_{c}") for c in ("session", "telemetry_session", "instance", "trace", "span")])
    rows = noted.join(mine, F.col("uuid") == F.col("m"), "left").join(up, F.col("parent_uuid") == F.col("p"), "left").join(lent.withColumnRenamed("parent_uuid", "l"), F.col("parent_uuid") == F.col("l"), "left")
    rows = rows.withColumn("session", F.coalesce("m_session", "own_session", "p_session", "lent"))
    last = F.last("raw_actor", ignorenulls=True).over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    earlier = spark.createDataFrame([], ACTORS) if known_actors is None else known_actors
    rows = rows.join(earlier.select(F.col("session").alias("a_session"), F.col("last_actor").alias("a_last")), F.col("session") == F.col("a_session"), "left")
    rows = rows.withColumn("last_actor", F.coalesce(last, F.col("a_last"))).drop("a_session", "a_last")
    actor = identity_actor(config, F.col("session"), F.coalesce("last_actor", F.lit("agent")))
    trace = F.coalesce("own_trace", "m_trace", "p_trace")
    span = F.coalesce("own_span", "m_span", "p_span")
    root = F.coalesce(F.col("m_root"), F.lit(False))
    out = rows.withColumn("actor", F.when(F.col("session").isNotNull(), actor)).withColumn("trace", trace).withColumn("span", span)
    out = out.withColumn("telemetry_session", F.coalesce("raw_session", "m_telemetry_session", "p_telemetry_session")).withColumn("instance", F.coalesce("own_instance", "m_instance", "p_instance"))
    out = out.withColumn("session_start", F.col("start_mark") | (root & (F.col("scope_category") == "start"))).withColumn("session_end", F.col("end_mark") | F.coalesce(root & (F.col("scope_category") == "end"), F.lit(False)))
    for name in ("trace_url", "span_url", "trace_api_url", "span_api_url"):
        template = getattr(config, name)
        values = {"trace_id": F.col("trace"), "span_id": F.col("span"), "provider": F.col("provider"), "project": F.lit(config.project)}
        out = out.withColumn(name, render_url(template, **values) if template else F.lit(None).cast("string"))
    extra = [c for c in out.columns if c[:2] in ("m_", "p_") and c != "p_"] + ["m", "p", "l", "lent"]
    return out.drop(*extra), scopes


def identity_actor(config: Config, session: Column, raw: Column) -> Column:
    """The seed of an actor of a session."""
    return _seed(config, "actor", F.concat_ws("\0", F.lit(config.domains.actor_seed), session, raw))


def projected(rows: DataFrame, config: Config, captured: DataFrame | None = None) -> DataFrame:
    """The events to record, with their source, outcome and ids.

    ``audit`` records all; ``link`` those that name the source they explain, and the ends of
    sessions in which one was recorded before (``captured``: sessions of earlier batches).
    """
    spark = rows.sparkSession
    past = (spark.createDataFrame([], "session string") if captured is None else captured).select("session").distinct().withColumn("past", F.lit(True))
    rows = rows.join(past, "session", "left")
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.bool_or(F.col("source").isNotNull()).over(before), F.lit(False)) | F.coalesce("past", F.lit(False))
    rows = rows.withColumn("captured", F.col("session").isNotNull() & earlier)
    if config.mode == "audit":
        return rows.withColumn("source_key", external("agent", "event", F.col("key"))).drop("past")
    ending = F.col("source").isNull() & F.col("session_end") & F.col("captured")
    link = external("agent", "link", t.link_id(F.col("source.ns"), F.col("source.kind"), F.col("source.id"), config.domains))
    end = external("agent", "session-event", t.session_end_id(F.col("session"), config.domains))
    kept = rows.filter(F.col("source").isNotNull() | ending)
    starts = F.col("source").isNotNull() & F.col("session").isNotNull() & ~F.col("captured")
    return kept.withColumn("source_key", F.when(F.col("source").isNotNull(), link).otherwise(end)).withColumn("session_start", starts).drop("past")


def with_parents(rows: DataFrame, config: Config, previous: DataFrame | None = None, anchored: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``parents``, keys of sources that come before: the last source of the session
    (``previous``: session, source_key of earlier batches), and in audit mode the scope's start
    and the parent scope's start. Only sources that are recorded already are linked."""
    spark = rows.sparkSession
    last = spark.createDataFrame([], "session string, last_key string") if previous is None else previous.select("session", F.col("source_key").alias("last_key"))
    # a source that is seen again is no new one
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source_key").orderBy("seq"))).filter("nth = 1").drop("nth")
    first = first.join(last, "session", "left")
    lag = F.lag("source_key").over(Window.partitionBy("session").orderBy("seq"))
    before = F.when(F.col("session").isNotNull(), F.coalesce(lag, F.col("last_key")))
    first = first.withColumn("before", F.when(before != F.col("source_key"), before))
    wanted = [F.col("before")]
    if config.mode == "audit":
        start = lambda uuid: external("agent", "event", F.concat(uuid, F.lit("/start")))
        wanted += [F.when(F.col("scope_category") == "end", start(F.col("uuid"))), start(F.col("parent_uuid"))]
    pairs = first.select("source_key", "seq", F.explode(F.array_distinct(F.array_compact(F.array(*wanted)))).alias("parent"))
    there = first.select(F.col("source_key").alias("k"), F.col("seq").alias("k_seq"))
    if anchored is not None:
        there = there.unionByName(anchored.select(F.col("source").alias("k"), F.lit(-1).cast("long").alias("k_seq")))
    linked = pairs.join(there, (F.col("parent") == F.col("k")) & (F.col("k_seq") < F.col("seq"))).groupBy(F.col("source_key").alias("k2")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    out = first.join(linked, F.col("source_key") == F.col("k2"), "left").drop("k2", "before", "last_key")
    return out.withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def run_batch(events: DataFrame, config: Config, folder: str, batch: int) -> None:
    """One micro-batch: what it records and the scopes it learns, as parts named by its id."""
    spark = events.sparkSession
    earlier = lambda name, schema: _parts(spark, f"{folder}/{name}", schema, batch)
    seen = earlier("keys", "key string")
    fresh = deduplicated(events, seen)
    named = earlier("actors", ACTORS + ", batch long").groupBy("session").agg(F.max_by("last_actor", "batch").alias("last_actor"))
    rows, scopes = resolved(fresh, config, earlier("scopes", SCOPES), named)
    rows = written(rows, "resolved")
    past = earlier("recorded", RECORDED)
    kept = projected(rows, config, past.filter("NOT session_end OR session_start"))
    kept = kept.join(past.select("source_key"), "source_key", "left_anti")
    latest = past.filter("session IS NOT NULL").groupBy("session").agg(F.max_by("source_key", F.struct("batch", "seq")).alias("source_key"))
    linked = with_parents(kept, config, latest, past.select(F.col("source_key").alias("source")))
    out = linked.select("source_key", "key", "seq", "session", "actor", "trace", "span", "provider", "telemetry_session", "instance", "session_start", "session_end", "parents", "json", F.lit(batch).cast("long").alias("batch"))
    out.write.mode("overwrite").parquet(f"{folder}/recorded/batch={batch}")
    known = earlier("scopes", SCOPES)
    scopes.join(known.select("uuid"), "uuid", "left_anti").write.mode("overwrite").parquet(f"{folder}/scopes/batch={batch}")
    last = rows.filter("session IS NOT NULL AND last_actor IS NOT NULL").groupBy("session").agg(F.max_by("last_actor", "seq").alias("last_actor"))
    last.write.mode("overwrite").parquet(f"{folder}/actors/batch={batch}")
    # keys last: they close the batch
    rows.select("key").write.mode("overwrite").parquet(f"{folder}/keys/batch={batch}")


RECORDED = (
    "source_key string, key string, seq long, session string, actor string, trace string, span string, provider string, telemetry_session string, "
    "instance string, session_start boolean, session_end boolean, parents array<string>, json string, batch long"
)


def _parts(spark, path: str, schema: str, before: int) -> DataFrame:
    """Rows of batches before ``before``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    own = schema if "batch long" in schema else f"{schema}, batch long"
    found = spark.read.schema(own).parquet(path).filter(F.col("batch") < before)
    return found if "batch long" in schema else found.drop("batch")


def stream(lines: DataFrame, config: Config, folder: str, checkpoint: str):
    """Start a query that ingests a stream of JSON lines (value). ``recorded`` in ``folder`` holds
    what it records, and ``rejected`` the lines that are no events (seq, json), which a caller
    that wants to stop at them reads. Run again from its checkpoint, a batch gives the same rows."""
    from ..sources.spool import events_of

    def each(df: DataFrame, batch: int) -> None:
        lines = written(events_of(df.withColumn("seq", F.monotonically_increasing_id())), "batch")
        lines.filter("bad").select("seq", "json").write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch}")
        run_batch(lines.filter("NOT bad").drop("bad"), config, folder, batch)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
