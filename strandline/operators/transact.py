"""Planning a batch of transactions: intents in, facts and outcomes out.

A batch is a :class:`~strandline.model.Log` whose ``op_id`` holds the seeds of the transactions,
and whose events are named ``<seed>#<index>`` by their place among the transaction's events.
Planning checks every transaction against the log and the batch, derives the identities, resolves
sources and parents, drops what is already there, and adds the retention claims that events
require. All transactions of a batch see the same log; one that needs another of the batch
belongs in a later batch. A transaction with a fault is left out whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..model import Log, canonical
from ..shared import written
from . import retention
from .replay import LogError, event_heads, latest_resources, operation_heads, schema_digest, source_map, topological_order
from .validate import observation_faults, relation_faults

#: Faults in the order in which they are told; of several, the first counts.
FAULTS = (
    "MissingSourceParent", "SourceConflict", "MissingSchema", "UnknownEntityType", "MissingField", "UnknownField", "InvalidFieldType", "InvalidSelfRelation",
    "UnknownRelation", "InvalidRelationEndpoints", "MissingSession", "SessionEnded", "MissingActor", "ActorSessionMismatch", "MissingEvent", "MissingClaim", "IdentityCollision",
)
#: Declared records: their table, their key, and what has to be the same if one is declared again.
DECLARED = (("named_queries", ("ns", "version", "name")), ("sessions", ("session_id",)), ("actors", ("actor_id",)), ("objects", ("object_id",)), ("replicas", ("replica_id",)))
#: Claims come after a transaction's other facts.
_CLAIMS_FROM = 1_000_000


@dataclass
class Plan:
    """outcomes: seed, op_id, source, status, where status is ``new``, ``idempotent`` or the name
    of a fault; log: the operations and facts of the new ones; prepare, finalize: the steps
    around publication (kind, subject, strength): objects to materialise, and the transitions of
    resources whose effective retention changes; faults: (seed, code, detail), all of them."""

    outcomes: DataFrame
    log: Log
    prepare: DataFrame
    finalize: DataFrame
    faults: DataFrame


def event_name(seed: Column, index: Column) -> Column:
    return F.concat(seed, F.lit("#"), index.cast("string"))


def _seed_of(name: Column) -> Column:
    return F.regexp_replace(name, r"#\d+$", "")


def _event_id(name: Column) -> Column:
    return identity.event_id(_seed_of(name), F.regexp_extract(name, r"#(\d+)$", 1))


def object_name(seed: Column, index: Column) -> Column:
    """The id of a transaction's object, by its place among the transaction's objects."""
    return identity.object_id(seed, index)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _both(log: Log, batch: Log, *names: str) -> Log:
    """The tables of both logs together."""
    return Log(log.spark, {n: getattr(log, n).unionByName(getattr(batch, n)) for n in names})


def declared_again(log: Log, batch: Log) -> DataFrame:
    """(seed, code, detail) of declarations that differ from one with the same key, in the log or in
    the batch."""
    out = []
    for name, key in DECLARED:
        if name not in batch.tables:
            continue
        fields = [f for f in getattr(batch, name).schema if f.name not in ("op_id", "ord")]
        canon = F.to_json(F.array(*[F.coalesce(canonical(F.col(f.name)) if f.dataType.typeName() == "map" else F.col(f.name).cast("string"), F.lit("\1")) for f in fields]))
        told = getattr(batch, name).select(F.col("op_id").alias("seed"), F.concat_ws("/", *key).alias("detail"), canon.alias("canon"))
        known = getattr(log, name).select(F.concat_ws("/", *key).alias("detail"), canon.alias("canon")).unionByName(told.select("detail", "canon"))
        clash = known.groupBy("detail").agg(F.countDistinct("canon").alias("n")).filter("n > 1")
        out.append(told.join(clash, "detail", "left_semi").select("seed", F.lit("IdentityCollision").alias("code"), "detail"))
    if "schemas" in batch.tables:
        mine = schema_digest(batch).join(schema_digest(log).withColumnRenamed("digest", "known"), ["ns", "version"]).filter("digest <> known")
        told = batch.schemas.join(mine, ["ns", "version"], "left_semi")
        out.append(told.select(F.col("op_id").alias("seed"), F.lit("IdentityCollision").alias("code"), F.concat_ws("@", "ns", "version").alias("detail")))
    return _all(out) if out else log.spark.createDataFrame([], "seed string, code string, detail string")


def faults(log: Log, batch: Log) -> DataFrame:
    """(seed, code, detail) of everything in a batch that the log, with the batch's own schemas and
    sessions, doesn't allow."""
    schemas = _both(log, batch, "schemas", "schema_requires", "entity_schemas", "fields", "relation_schemas")
    for name in ("schemas", "entity_schemas", "fields", "relation_schemas"):  # what both define is there once
        schemas.tables[name] = schemas.tables[name].drop("op_id", "ord").distinct() if name == "schemas" else schemas.tables[name].distinct()
    of = lambda rows: rows.select(_seed_of(F.col("subject")).alias("seed"), "code", "detail")
    out = [declared_again(log, batch)]
    if "observations" in batch.tables:
        out.append(of(observation_faults(batch.observations, schemas)))
    if "relations" in batch.tables:
        out.append(of(relation_faults(batch.relations, schemas)))
    out.append(session_faults(log, batch).select(F.col("op_id").alias("seed"), "code", F.col("subject").alias("detail")))
    if "schema_requires" in batch.tables:
        needed = batch.schema_requires.join(batch.schemas.select("ns", "version", "op_id"), ["ns", "version"])
        lost = needed.join(schemas.schemas.select(F.col("ns").alias("r_ns"), F.col("version").alias("r_version")), ["r_ns", "r_version"], "left_anti")
        out.append(lost.select(F.col("op_id").alias("seed"), F.lit("MissingSchema").alias("code"), F.concat_ws("@", "r_ns", "r_version").alias("detail")))
    known = log.events.select("event_id").unionByName(batch.events.select(_event_id(F.col("event_id")).alias("event_id"))).distinct()
    lost = batch.event_parents.join(known.withColumnRenamed("event_id", "parent_id"), "parent_id", "left_anti")
    out.append(lost.select(_seed_of(F.col("event_id")).alias("seed"), F.lit("MissingEvent").alias("code"), F.col("parent_id").alias("detail")))
    claimed = log.claims.select("claim_id").distinct()
    out.append(batch.releases.join(claimed, "claim_id", "left_anti").select(F.col("op_id").alias("seed"), F.lit("MissingClaim").alias("code"), F.col("claim_id").alias("detail")))
    return _all(out)


def retention_steps(log: Log, planned: Log) -> DataFrame:
    """(kind, subject, strength, phase): the transitions of resources whose effective retention the
    planned claims and releases change; what changes nothing gives no step."""
    steps = retention.claim_steps(log)
    about = log.claims.select("claim_id", F.col("resource").alias("own")).distinct()
    later = lambda: F.struct(F.lit((1 << 62)).cast("long").alias("topo"), F.col("ord"))
    claimed = planned.claims.select(later().alias("at"), "claim_id", "resource", "strength")
    freed = planned.releases.join(about, "claim_id").select(later().alias("at"), "claim_id", F.col("own").alias("resource"), F.lit(None).cast("int").alias("strength"))
    # only resources that the plan names can change
    named = claimed.select("resource").unionByName(freed.select("resource")).distinct()
    before = retention.effective_retention(retention.active_claims(steps.join(named, "resource", "left_semi"))).withColumnRenamed("strength", "before")
    after = retention.effective_retention(retention.active_claims(steps.join(named, "resource", "left_semi").unionByName(claimed).unionByName(freed))).withColumnRenamed("strength", "after")
    change = retention.transition(F.col("before"), F.col("after"))
    rows = named.join(before, "resource", "left").join(after, "resource", "left").withColumn("kind", change).filter("kind IS NOT NULL")
    return rows.select("kind", F.col("resource").alias("subject"), F.col("after").alias("strength"), retention.phase(F.col("kind")).alias("phase"))


def plan(log: Log, batch: Log, source_parents: DataFrame | None = None, require_source_parents: bool = True, retain_event_requirements: bool = True) -> Plan:
    """``source_parents``: (op_id, parent): for transactions with a source, the sources that they follow.

    A source whose operation is there already is idempotent, whatever else its transaction says; a
    transaction without a source follows all heads, so it never equals an operation that is there,
    which is a head or an ancestor of one: the same seed again collides.
    """
    spark = log.spark
    parents = source_parents if source_parents is not None else spark.createDataFrame([], "op_id string, parent string")
    anchored = source_map(log)
    seeds = batch.operations.select(F.col("op_id").alias("seed"), "source", "attrs").withColumn("op_id", identity.operation_id(F.col("seed")))
    known = anchored.select(F.col("source").alias("a_source"), F.col("op_id").alias("a_op"))
    seen = log.operations.select(F.col("op_id").alias("l_op")).distinct()
    of_source = anchored.select(F.col("source").alias("parent"), F.col("op_id").alias("parent_op"), "primary_event")
    resolved = parents.withColumnRenamed("op_id", "seed").join(of_source, "parent", "left")
    lost = resolved.filter("parent_op IS NULL").select(F.col("seed").alias("m_seed")).distinct() if require_source_parents else spark.createDataFrame([], "m_seed string")
    found = written(faults(log, batch), "faults")
    rank = F.array_position(F.array(*[F.lit(c) for c in FAULTS]), F.col("code"))
    worst = found.groupBy(F.col("seed").alias("f_seed")).agg(F.min_by("code", rank).alias("fault"))
    status = (
        F.when(F.col("m_seed").isNotNull(), F.lit("MissingSourceParent"))
        .when(F.col("a_op") == F.col("op_id"), F.lit("idempotent"))
        .when(F.col("a_op").isNotNull(), F.lit("SourceConflict"))
        .when(F.col("l_op").isNotNull(), F.lit("IdentityCollision"))
        .otherwise(F.coalesce("fault", F.lit("new")))
    )
    outcomes = (
        seeds.join(known, F.col("source") == F.col("a_source"), "left")
        .join(seen, F.col("op_id") == F.col("l_op"), "left")
        .join(lost, F.col("seed") == F.col("m_seed"), "left")
        .join(worst, F.col("seed") == F.col("f_seed"), "left")
        .withColumn("status", status)
        .select("seed", "op_id", "source", "attrs", "status")
    )
    outcomes = written(outcomes, "outcomes")
    new = outcomes.filter("status = 'new'")
    ids = new.select("seed", F.col("op_id").alias("new_op"))

    def renamed(table: DataFrame) -> DataFrame:
        cols = table.columns
        return table.join(ids, F.col("op_id") == F.col("seed")).withColumn("op_id", F.col("new_op")).select(*cols)

    tables: dict[str, DataFrame] = {"operations": new.select("op_id", "source", "attrs")}
    free = new.filter("source IS NULL").select("seed", "op_id")
    bound = resolved.join(ids, "seed").filter("parent_op IS NOT NULL")
    # a transaction without a source follows all heads; these are few, and publishing reads them too
    none = free.isEmpty()
    heads = _listed([] if none else [r.op_id for r in operation_heads(log).collect()])
    follows = free.select("op_id", F.explode(heads).alias("parent_id"))
    tables["parents"] = follows.unionByName(bound.select(F.col("new_op").alias("op_id"), F.col("parent_op").alias("parent_id"))).distinct()
    for name in ("sessions", "session_ends", "actors", "objects", "replicas", "observations", "schemas", "named_queries", "releases", "resources"):
        if name in batch.tables:
            tables[name] = renamed(getattr(batch, name))
    for name in ("schema_requires", "entity_schemas", "fields", "relation_schemas"):
        if name in batch.tables:
            tables[name] = getattr(batch, name)
    # what is declared already gives no fact, nor what another transaction of the batch declares
    for name, key in (("schemas", ("ns", "version")), *DECLARED, ("session_ends", ("session_id",))):
        if name in tables:
            fresh = tables[name].join(getattr(log, name).select(*key), list(key), "left_anti")
            first = Window.partitionBy(*key).orderBy("op_id", "ord")
            tables[name] = fresh.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*getattr(batch, name).columns)
    if "resources" in tables:
        tables["resources"] = _changed_resources(log, tables["resources"])
    events = renamed(batch.events).withColumn("b_name", F.col("event_id")).withColumn("event_id", _event_id(F.col("b_name")))
    named = events.select(F.col("b_name"), F.col("event_id").alias("new_event"), F.col("op_id").alias("e_op"), "ord")
    tables["events"] = events.drop("b_name")

    def of_events(table: DataFrame) -> DataFrame:
        cols = table.columns
        out = table.join(named.drop("ord"), F.col("event_id") == F.col("b_name")).withColumn("event_id", F.col("new_event"))
        return (out.withColumn("op_id", F.col("e_op")) if "op_id" in cols else out).select(*cols)

    for name in ("subjects", "relations", "requires"):
        tables[name] = of_events(getattr(batch, name))
    inherited = bound.filter("primary_event IS NOT NULL").select("new_op", F.col("primary_event").alias("parent_id"))
    heads = _listed([] if none else [r.event_id for r in event_heads(log).collect()])
    inherited = inherited.unionByName(free.select(F.col("op_id").alias("new_op"), F.explode(heads).alias("parent_id")))
    inherited = inherited.join(named, F.col("new_op") == F.col("e_op")).select(F.col("new_event").alias("event_id"), "parent_id")
    more = batch.event_parents.join(named, F.col("event_id") == F.col("b_name")).select(F.col("new_event").alias("event_id"), "parent_id")
    tables["event_parents"] = inherited.unionByName(more).distinct()
    if retain_event_requirements:
        order = Window.partitionBy("event_id").orderBy("resource", "strength")
        wanted = batch.requires.distinct().withColumn("at", F.row_number().over(order) - 1)
        wanted = wanted.join(named, F.col("event_id") == F.col("b_name")).join(ids, F.col("e_op") == F.col("new_op"))
        claim = identity.claim_id(F.col("seed"), F.regexp_extract("b_name", r"#(\d+)$", 1), F.col("at"))
        tables["claims"] = wanted.select(
            F.col("e_op").alias("op_id"), (F.col("ord") + _CLAIMS_FROM + F.col("at")).cast("int").alias("ord"), claim.alias("claim_id"),
            F.lit("event").alias("owner_kind"), F.col("new_event").alias("owner_id"), "resource", "strength",
        )
    planned = Log(spark, tables)
    steps = retention_steps(log, planned)
    objects = planned.objects.select(F.lit("materialize").alias("kind"), F.col("object_id").alias("subject"), F.lit(None).cast("int").alias("strength"))
    prepare = objects.unionByName(steps.filter("phase = 'prepare'").drop("phase"))
    return Plan(outcomes.drop("attrs"), planned, prepare, steps.filter("phase = 'finalize'").drop("phase"), found)


def _listed(ids: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(ids)), "array<string>")


def _changed_resources(log: Log, told: DataFrame) -> DataFrame:
    """Observations of resources that differ from the one before: the log's latest, or an earlier one
    of the same transaction."""
    state = lambda: F.struct("availability", "integrity", "retention")
    mine = told.withColumn("now", state()).withColumn("before", F.lag(state()).over(Window.partitionBy("op_id", "resource").orderBy("ord")))
    if "resources" in log.tables:
        latest = latest_resources(log, topological_order(log)).select(F.col("resource").alias("l_resource"), state().alias("latest"))
        mine = mine.join(latest, F.col("resource") == F.col("l_resource"), "left").withColumn("before", F.coalesce("before", "latest"))
    return mine.filter("NOT (now <=> before)").select(*told.columns)


def session_faults(log: Log, batch: Log) -> DataFrame:
    """(op_id, subject, code): uses of sessions that aren't there or have ended, and events whose actor
    isn't there or belongs to another session."""
    opened = log.sessions.select("session_id").unionByName(batch.sessions.select("session_id")).distinct().withColumn("there", F.lit(True))
    ended = log.session_ends.select("session_id").distinct().withColumn("over", F.lit(True))
    use = lambda table, subject, session, ends=False: table.filter(F.col(session).isNotNull()).select("op_id", F.col(subject).alias("subject"), F.col(session).alias("session_id"), F.lit(ends).alias("ends"))
    uses = _all([
        use(batch.events, "event_id", "session"), use(batch.actors, "actor_id", "session"),
        # an ended session may be ended again, and may be a parent
        use(batch.session_ends, "session_id", "session_id", True), use(batch.sessions, "session_id", "parent", True),
    ])
    state = uses.join(opened, "session_id", "left").join(ended, "session_id", "left")
    code = F.when(F.col("there").isNull(), F.lit("MissingSession")).when(F.col("over") & ~F.col("ends"), F.lit("SessionEnded"))
    found = state.withColumn("code", code).filter("code IS NOT NULL").select("op_id", "subject", "code")
    actors = log.actors.select("actor_id", F.col("session").alias("a_session")).unionByName(batch.actors.select("actor_id", F.col("session").alias("a_session"))).distinct()
    acted = batch.events.filter("actor IS NOT NULL").join(actors, F.col("actor") == F.col("actor_id"), "left")
    lost = acted.filter("actor_id IS NULL").select("op_id", F.col("event_id").alias("subject"), F.lit("MissingActor").alias("code"))
    other = acted.filter("a_session IS NOT NULL AND session IS NOT NULL AND a_session <> session").select("op_id", F.col("event_id").alias("subject"), F.lit("ActorSessionMismatch").alias("code"))
    return found.unionByName(lost).unionByName(other)


def commit(store, planned: Plan, prepare=None, finalize=None) -> dict[str, int]:
    """Prepare, publish, finalize. A plan with nothing new does none of them."""
    counts = {r.status: r["count"] for r in planned.outcomes.groupBy("status").count().collect()}
    if counts.get("new"):
        if prepare is not None:
            prepare(planned.prepare)
        store.publish(planned.log)
        if finalize is not None:
            finalize(planned.finalize)
    return counts


def check(faults: DataFrame) -> None:
    """Raise the first fault, if there is any."""
    first = faults.first()
    if first is not None:
        raise LogError(first.code, first.subject)
