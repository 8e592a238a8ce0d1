import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import identity, telemetry, text
from strandline.model import Log, external_key
from strandline.operators import replay, transact, validate
from strandline.operators.replay import LogError
from strandline.sources import hooks, spool
from strandline.sources.snapshot import Repository, commit_closure, current_commits, key, observations, pending
from strandline.sources.store import MemoryStore, Store, check_component
from strandline.streaming import relay
from tests.fixture import kitchen, string


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- identities and texts ---------------------------------------------------------------------


def test_identities(spark):
    assert one(spark, identity.kernel_id("event", F.lit("some:abc"), "event-id")) == hashlib.sha256(b"strandline/id/v1\0event\0some:abc\0event-id").hexdigest()
    other = identity.Domains(kernel="mine/v9")
    assert one(spark, identity.kernel_id("event", F.lit("some:abc"), "event-id", other)) == hashlib.sha256(b"mine/v9\0event\0some:abc\0event-id").hexdigest()
    h = hashlib.sha256(b"strandline/agent-id/v1\0")
    for p in ("session", "seed é", "session"):
        h.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    assert one(spark, identity.agent_id("session", F.lit("seed é"), "session")) == h.hexdigest()
    assert one(spark, identity.digest_id("d", F.lit("é"), "b")) == hashlib.sha256("d\0".encode() + "2:é\0".encode() + b"1:b\0").hexdigest()
    assert one(spark, identity.scoped_seed("k", "h", "i", F.lit("é"))) == "strandline/agent-seed/v1\x001:k\x001:h\x001:i\x002:é"


@pytest.mark.parametrize(("stamp", "parts"), [
    ("2030-05-01T12:30:00Z", ("2030-05-01", "12:30:00")), ("2030-05-01T12:30:00.5+02:00", ("2030-05-01", "12:30:00")), ("2030-05-01T12:30", ("2030-05-01", "--:--:--")),
    ("1900000000000@60", ("undated", "--:--:--")), ("2030-05-01", ("undated", "--:--:--")), ("", ("undated", "--:--:--")),
])
def test_time_parts(spark, stamp, parts):
    date, time = text.time_parts(F.lit(stamp))
    assert (one(spark, date), one(spark, time)) == parts


def test_texts(spark):
    assert one(spark, text.clean_text(F.lit("a\nb\tc\rd\x07"))) == "a↵b⇥c␍d�"
    assert one(spark, text.percent_encode(F.lit("a b*c~d/é+"))) == "a%20b%2Ac~d%2F%C3%A9%2B"
    assert one(spark, text.render_url("http://x/{trace_id}?{span_id}", trace_id=F.lit("a b"), span_id=F.lit("s"))) == "http://x/a%20b?s"
    assert one(spark, text.render_url("http://x/{trace_id}", trace_id=F.lit(None).cast("string"))) is None
    assert one(spark, text.short_id(F.lit("0123456789abcdef"))) == "0123456789a…"
    assert one(spark, text.document_type(F.lit("ADR-7"))) == "adr" and one(spark, text.document_type(F.lit("plain"))) == "document"
    assert one(spark, text.entity_uri(F.lit("I2\0s-1"))) == "prov://session/s-1"
    assert one(spark, text.entity_uri(F.lit(external_key("jj", "commit", "c")))) == "jj://c"
    assert one(spark, text.detail_uri(F.lit(external_key("beads", "issue", "b")))) == "prov://bd/b"


@pytest.mark.parametrize("template", ["ftp://{trace_id}", "http://x", "http://x/{trace_id}/{other}", "http://x/{trace_id", "http://x/}{trace_id}", "http://x {trace_id}"])
def test_bad_templates(template):
    with pytest.raises(ValueError):
        relay.check_template(template, "trace_id")


def test_metadata(spark):
    v = F.parse_json(F.lit(json.dumps({"session_id": 5, "session": {"session-key": "deep"}, "lineage": {"source": {"namespace": "n", "kind": "k", "id": "i"}, "status": "ok"}})))
    assert one(spark, telemetry.metadata_string(v, telemetry.SESSION)) == "deep"
    assert tuple(one(spark, telemetry.source_of(v))) == ("n", "k", "i", "ok")
    assert one(spark, telemetry.source_of(F.parse_json(F.lit('{"lineage": {"source": {"namespace": " ", "kind": "k", "id": "i"}}}')))) is None
    assert one(spark, telemetry.metadata_string(F.parse_json(F.lit("[1]")), telemetry.SESSION)) is None
    assert one(spark, telemetry.span_id(F.lit("00112233-4455-6677-8899-AABBCCDDEEFF"))) == "8899aabbccddeeff"


# --- hooks ------------------------------------------------------------------------------------


def payloads(spark, *objects):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objects], "payload string")


def test_tracker_hooks(spark):
    issue = {"id": "i-1", "title": "T", "priority": 2, "updated_at": "u", "labels": ["x", "y"], "depends_on": [{"id": "i-0"}, "i-2"]}
    rows = hooks.tracker_requests(payloads(spark, {"event": "update", "data": [issue]}, {"event": "close", "id": "i-3", "updated_at": "u"}, {"event": "melt", **issue}, issue, "nonsense"), dependencies=spark.createDataFrame([("i-3", ["i-9"])], "issue_id string, depends_on array<string>")).collect()
    assert [r.fault for r in rows] == [None, None, "InvalidEvent", "MissingEvent", "InvalidJson"]
    first = {n: (v.tag, v.text) for n, v in rows[0].attrs.items()}
    assert first == {"issue-id": ("string", "i-1"), "title": ("string", "T"), "updated-at": ("string", "u"), "priority": ("int", "2"), "labels": ("list", '["x","y"]'), "depends-on": ("list", '["i-0","i-2"]')}
    assert (rows[0].source_ns, rows[0].source_kind, rows[0].source_id, rows[0].cursor) == ("beads", "hook", "update/i-1/u", "update")
    assert rows[1].attrs["depends-on"].text == '["i-9"]'


def test_document_and_other_hooks(spark):
    after = {"id": "ADR-1", "body": "b", "frontmatter": {"status": "open", "tags": ["t"], "depends_on": "ADR-0"}, "sections": [1]}
    raw = json.dumps({"event": "update", "before": {}, "after": after, "diff": "d"})
    (r,) = hooks.document_requests(payloads(spark, raw)).collect()
    digest = hashlib.sha256(raw.encode()).hexdigest()
    assert r.source_id == f"update/ADR-1/{digest}" and r.attrs["document-type"].text == "adr" and r.attrs["depends-on"].text == '["ADR-0"]' and r.attrs["payload-json"].text == raw
    rows = hooks.generic_requests(payloads(spark, {"event": "e", "n": 1, "d": 1.5, "o": {"entity": {"namespace": "a", "kind": "b", "id": "c"}}, "nil": None}, "[1]"), "tracker").collect()
    assert {n: (v.tag, v.text) for n, v in rows[0].attrs.items()} == {"n": ("int", "1"), "d": ("decimal", "1.5"), "o": ("entity", external_key("a", "b", "c")), "nil": ("null", None)}
    assert rows[1].fault == "NotAnObject"
    rows = hooks.canonical_requests(payloads(spark, {"source": {"namespace": "n", "kind": "k", "id": "i"}, "cursor": "c", "attributes": {"a": True}}, {"source": {"namespace": "n", "kind": "", "id": "i"}, "attributes": {}}, {"attributes": {}})).collect()
    assert (rows[0].source_ns, rows[0].source_id, rows[0].cursor, rows[0].attrs["a"].tag) == ("n", "i", "c", "bool")
    assert [r.fault for r in rows] == [None, "InvalidSource", "MissingSource"]


# --- snapshot ---------------------------------------------------------------------------------


def test_snapshot(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    repo = Repository(
        ops=frame([("o1", 0, "init"), ("o2", 1, "amend")], "op_id string, ord int, description string"), op_parents=frame([("o2", "o1")], "op_id string, parent_id string"),
        produced=frame([("o1", "c9", None), ("o2", "c2", "c9"), ("o2", "c5", None)], "op_id string, commit_id string, predecessor_id string"),
        commits=frame([(c, ch, "d", "A", "a@x", 5, 60) for c, ch in (("c0", "root"), ("c9", "x"), ("c2", "x"), ("c5", "y"), ("c7", "y"), ("lost", "z"))], "commit_id string, change_id string, description string, author string, email string, millis long, offset int"),
        commit_parents=frame([("c9", "c0"), ("c2", "c0"), ("c7", "c2")], "commit_id string, parent_id string"), heads=frame([("c7",)], "commit_id string"),
        workspaces=frame([("default", "c7")], "workspace_id string, commit_id string"),
    )
    closure = commit_closure(repo)
    assert {r.commit_id: r.visible for r in closure.collect()} == {"c7": True, "c2": True, "c0": True, "c9": False, "c5": False}
    # x: what the last operation made; y: the visible commit is greater; root: visible
    assert {r.change_id: r.commit_id for r in current_commits(repo, closure).collect()} == {"x": "c2", "y": "c7", "root": "c0"}
    seen, links = observations(repo, "o2")
    assert seen.filter(F.col("entity") == external_key("jj", "change", "y")).first().attrs["current_commit"].text == external_key("jj", "commit", "c7")
    assert links.count() == 1 + 3 + 1 + 5 + 2
    left = pending(repo.ops, spark.range(1).select(key("operation", F.lit("o1")).alias("source")))
    assert [r.op_id for r in left.collect()] == ["o2"]


# --- writes and stores ------------------------------------------------------------------------


def batch(spark, seed, source, **more):
    observed = [(seed, 0, external_key("book", "recipe", "r-9"), "book", "1", string(title="new"))]
    more = {"entity_schemas": [("book", "1", "recipe", True)], "schemas": [], **more}
    return Log.of(spark, operations=[(seed, source, string(by="test"))], observations=observed, events=[(seed, 1, f"{seed}#0", None, None, {})],
                  subjects=[(f"{seed}#0", external_key("book", "recipe", "r-9"))], requires=[(f"{seed}#0", "res-b", 1), (f"{seed}#0", "res-a", 2)], **more)


def test_transactions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/log")
    first = kitchen(spark)
    assert store.publish(first) == "published" and store.heads() == ["op-agent"]
    source = external_key("book", "hook", "create/r-9")
    follows = spark.createDataFrame([("seed-1", external_key("book", "hook", "update/r-2"))], "op_id string, parent string")
    planned = transact.plan(store.load(), batch(spark, "seed-1", source), follows)
    (out,) = planned.outcomes.collect()
    assert out.status == "new" and out.op_id == one(spark, identity.operation_id(F.lit("seed-1")))
    assert [r.parent_id for r in planned.log.parents.collect()] == ["op-book"]
    assert [r.parent_id for r in planned.log.event_parents.collect()] == ["e-book"]
    claims = {r.resource: r.claim_id for r in planned.log.claims.collect()}
    assert claims == {"res-a": one(spark, identity.claim_id(F.lit("seed-1"), F.lit(0), F.lit(0))), "res-b": one(spark, identity.claim_id(F.lit("seed-1"), F.lit(0), F.lit(1)))}
    done = []
    assert transact.commit(store, planned, prepare=lambda p: done.append(p.count())) == {"new": 1} and done == [2]
    assert sorted(store.heads()) == sorted(["op-agent", out.op_id])
    again = transact.plan(store.load(), batch(spark, "seed-1", source), follows)
    assert [r.status for r in again.outcomes.collect()] == ["idempotent"] and again.log.events.isEmpty()
    other = transact.plan(store.load(), batch(spark, "seed-2", source))
    assert [r.status for r in other.outcomes.collect()] == ["SourceConflict"]
    lost = transact.plan(store.load(), batch(spark, "seed-3", external_key("a", "b", "c")), spark.createDataFrame([("seed-3", "X\0no\0such\0source")], "op_id string, parent string"))
    assert [r.status for r in lost.outcomes.collect()] == ["MissingSourceParent"]
    free = transact.plan(store.load(), batch(spark, "seed-4", None))
    assert {r.parent_id for r in free.log.parents.collect()} == set(store.heads())


def test_store_contract(spark, tmp_path):
    log = kitchen(spark)
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.put(log) == 4 and store.put(log) == 0 and store.load().operations.isEmpty()  # not published
    changed = Log(spark, dict(log.tables))
    changed.tables["operations"] = log.operations.withColumn("source", F.lit("X\0a\0b\0c"))
    with pytest.raises(LogError, match="IdentityCollision"):
        store.put(changed)
    with pytest.raises(LogError, match="MissingOperation"):
        store.publish_heads([], ["nowhere"])
    assert store.publish_heads([], ["op-book"]) == "published" and store.publish_heads([], ["op-book"]) == "already-present"
    assert store.publish_heads([], ["op-kitchen"]) == "merged" and store.heads() == ["op-book", "op-kitchen"]
    assert {r.op_id for r in store.load().operations.collect()} == {"op-root", "op-book", "op-kitchen"}
    for bad in ("", ".", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            check_component(bad)
    memory = MemoryStore(spark)
    assert memory.publish(log) == "published" and memory.publish(log) == "already-present" and memory.heads() == ["op-agent"]


def test_a_put_that_breaks_off_can_be_made_again(spark, tmp_path, monkeypatch):
    """Broken off after each table, and before the batch is marked, a put leaves nothing that counts."""
    log = kitchen(spark)
    count = {"n": 0, "stop": 0}
    real = Store._write

    def write(self, path, data):
        if "committed" in str(path) and count["stop"] is None:
            raise OSError("stopped")
        return real(self, path, data)

    from pyspark.sql import DataFrameWriter

    parquet = DataFrameWriter.parquet

    def one(self, path, *a, **k):
        if count["stop"] is not None and "/batches/" in path:
            if count["n"] == count["stop"]:
                raise OSError("stopped")
            count["n"] += 1
        return parquet(self, path, *a, **k)

    monkeypatch.setattr(Store, "_write", write)
    monkeypatch.setattr(DataFrameWriter, "parquet", one)
    store = Store(spark, f"file://{tmp_path}/s")
    for stop in (0, 1, 3, None):
        count.update(n=0, stop=stop)
        with pytest.raises(OSError, match="stopped"):
            store.put(log)
        assert not store.stored().tables
    count["stop"] = 1000
    assert store.put(log) == 4 and store.put(log) == 0
    assert store.publish_heads([], ["op-agent"]) == "published" and replay.view_counts(store.load()) == replay.view_counts(log)
    # a manifest that a writer broke off in doesn't hide the one before
    (tmp_path / "s" / "heads" / "000000000002.json").write_text('{"heads": [')
    assert store.heads() == ["op-agent"] and store.publish_heads(["op-agent"], ["op-book"]) == "published" and store.heads() == ["op-book"]
    # subjects, event parents and schemas are a part of an operation
    for name, changed in (("subjects", log.subjects.withColumn("entity", F.lit("X\0a\0b\0c"))), ("requires", log.requires.withColumn("strength", F.lit(0))), ("relation_schemas", log.relation_schemas.withColumn("role", F.lit("primary")))):
        with pytest.raises(LogError, match="IdentityCollision"):
            replay.merge(log, Log(spark, log.tables | {name: changed}))


def test_store_get_and_objects(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put(kitchen(spark))
    found = store.get("op-book")
    assert [r.op_id for r in found.operations.collect()] == ["op-book"] and found.subjects.count() == 1 and found.relations.count() == 1
    with pytest.raises(LogError, match="MissingOperation"):
        store.get("op-none")
    store.put_object("o-1", b"payload")
    store.put_object("o-1", b"payload")
    assert store.get_object("o-1") == b"payload"
    with pytest.raises(LogError, match="IdentityCollision"):
        store.put_object("o-1", b"other")
    with pytest.raises(LogError, match="MissingObject"):
        store.get_object("o-2")


def test_transactions_are_checked(spark):
    """One transaction for each fault, planned together, and only the sound one gets through."""
    log = kitchen(spark)
    log.tables["entity_schemas"] = spark.createDataFrame([("book", "1", "recipe", False)], "ns string, version string, kind string, allow_unknown boolean")
    log.tables["fields"] = spark.createDataFrame([("book", "1", "recipe", "title", "string", True)], "ns string, version string, kind string, field string, type string, required boolean")
    log.tables["session_ends"] = spark.createDataFrame([("op-agent", 9, "s-old")], "op_id string, ord int, session_id string")
    log.tables["sessions"] = log.sessions.unionByName(spark.createDataFrame([("op-agent", 8, "s-old", None, {})], log.sessions.schema))
    recipe = external_key("book", "recipe", "r-5")
    seen = lambda seed, version="1", entity=recipe, **attrs: (seed, 0, entity, "book", version, string(**attrs))
    happened = lambda seed, session=None, actor=None: (seed, 1, f"{seed}#0", session, actor, {})
    rows = {
        "ok": [seen("ok", title="t")], "MissingSchema": [seen("MissingSchema", "7", title="t")], "UnknownEntityType": [seen("UnknownEntityType", entity=external_key("book", "page", "1"), title="t")],
        "MissingField": [seen("MissingField")], "UnknownField": [seen("UnknownField", title="t", zest="z")], "InvalidFieldType": [("InvalidFieldType", 0, recipe, "book", "1", {"title": ("int", "1")})],
    }
    others = ["MissingSession", "SessionEnded", "MissingActor", "ActorSessionMismatch", "MissingEvent", "MissingClaim", "IdentityCollision", "InvalidSelfRelation"]
    events = [happened("MissingSession", "s-9"), happened("SessionEnded", "s-old"), happened("MissingActor", "s-1", "a-9"), happened("ActorSessionMismatch", "s-2", "a-1"), happened("MissingEvent"), happened("InvalidSelfRelation"), happened("ok", "s-2", None)]
    batch = Log.of(
        spark, operations=[(s, external_key("test", "seed", s), {}) for s in (*rows, *others)], observations=[r for rs in rows.values() for r in rs], events=events,
        event_parents=[("MissingEvent#0", "e-none"), ("ok#0", "e-book")], sessions=[("ok", 2, "s-2", "s-1", {}), ("IdentityCollision", 2, "s-1", None, string(harness_id="fork"))], releases=[("MissingClaim", 0, "c-none")],
        relations=[("InvalidSelfRelation", "InvalidSelfRelation#0", "book", "1", "book", "revises", recipe, recipe, "[]")],
    )
    planned = transact.plan(log, batch)
    assert {r.seed: r.status for r in planned.outcomes.collect()} == {"ok": "new"} | {c: c for c in (*rows, *others) if c != "ok"}
    assert planned.log.operations.count() == 1 and [r.parent_id for r in planned.log.event_parents.collect()] == ["e-book"]


def test_retention_changes_by_transition(spark):
    log = kitchen(spark)
    (held,) = {r.resource for r in log.claims.collect()}
    log.tables["claims"] = log.claims.unionByName(spark.createDataFrame([("op-kitchen", 9, "c-2", "event", "e-kitchen", "res-k", 1), ("op-kitchen", 10, "c-3", "event", "e-kitchen", "res-k", 0)], log.claims.schema))
    source = lambda s: external_key("test", "seed", s)
    batch = Log.of(
        spark, operations=[(s, source(s), {}) for s in "abc"], events=[(s, 1, f"{s}#0", None, None, {}) for s in "ab"],
        requires=[("a#0", held, 1), ("a#0", "res-n", 0), ("b#0", "res-n", 2)], releases=[("c", 0, "c-2")],
        resources=[("c", 1, held, "local", "verified", 2), ("c", 2, "res-n", "local", "verified", 1), ("c", 3, "res-n", "local", "verified", 1), ("c", 4, "res-n", "lost", "verified", None)],
    )
    planned = transact.plan(log, batch)
    assert {(r.kind, r.subject, r.strength) for r in planned.prepare.collect()} == {("became-required", "res-n", 2)}
    assert {(r.kind, r.subject, r.strength) for r in planned.finalize.collect()} == {("weakened", "res-k", 0)}
    # an observation of what is known already is no fact
    assert [(r.resource, r.availability) for r in planned.log.resources.orderBy("ord").collect()] == [("res-n", "local"), ("res-n", "lost")]


def test_session_faults(spark):
    log = Log.of(spark, sessions=[("o", 0, "s1", None, {}), ("o", 1, "s2", None, {})], session_ends=[("o", 2, "s2")], actors=[("o", 3, "a1", "s1", {})])
    new = Log.of(spark, events=[("n", 0, "e1", "s1", "a1", {}), ("n", 1, "e2", "s2", None, {}), ("n", 2, "e3", "s9", None, {}), ("n", 3, "e4", "s1", "a9", {})], session_ends=[("n", 4, "s2")])
    assert {(r.op_id, r.subject, r.code) for r in transact.session_faults(log, new).collect()} == {("n", "e2", "SessionEnded"), ("n", "e3", "MissingSession"), ("n", "e4", "MissingActor")}


@pytest.mark.parametrize(("tag", "text_", "kind", "ok"), [
    ("string", "a", "string", True), ("string", "a", "int", False), ("null", None, "string", False), ("null", None, "null", True), ("null", None, "any", True), ("ref", "x", "ref", False),
    ("ref", "x", "any", True), ("entity", external_key("a", "b", "c"), "entity:a/b", True), ("entity", external_key("a", "b", "c"), "entity:a/x", False), ("entity", "I2\0s", "entity:session", True),
    ("list", '[{"tag":"int","text":"1"},{"tag":"int","text":"2"}]', "list<int>", True), ("list", '[{"tag":"int","text":"1"},{"tag":"string","text":"2"}]', "list<int>", False),
    ("list", "[]", "list<string>", True), ("map", '{"k":{"tag":"bool","text":"true"}}', "map<bool>", True), ("map", '{"k":{"tag":"bool","text":"true"}}', "map<int>", False),
])
def test_type_rules(spark, tag, text_, kind, ok):
    v = F.struct(F.lit(tag).alias("tag"), F.lit(text_).cast("string").alias("text"))
    assert one(spark, validate.type_matches(v, F.lit(kind))) is ok


# --- streams ----------------------------------------------------------------------------------


def event(n, kind="scope", scope="start", parent=None, name="work", category=None, **metadata):
    uid = lambda k: f"00000000-0000-4000-8000-{k:012d}"
    return json.dumps({"kind": kind, "atof_version": "0.1", "uuid": uid(n), "parent_uuid": uid(parent) if parent else None, "timestamp": "2030-01-01T00:00:00Z", "name": name, "data": None,
                       "metadata": metadata, "scope_category": scope if kind == "scope" else None, "category": category})


SOURCE = {"source": {"namespace": "kitchen", "kind": "batch", "id": "b-7"}, "outcome": "done"}
OTHER = {"source": {"namespace": "kitchen", "kind": "batch", "id": "b-8"}}
EVENTS = [
    event(1, category="agent", session_id="s", actor_id="me"), event(2, parent=1, category="tool"), event(3, parent=2, category="tool", lineage=SOURCE), event(3, parent=2, category="tool", lineage=SOURCE),
    event(4, kind="mark", parent=2, name="note"), event(5, parent=1, category="tool", lineage=OTHER), event(1, scope="end", category="agent"), event(9, category="agent"),
]


def test_relay(spark):
    lines = spark.createDataFrame([(i, e) for i, e in enumerate(EVENTS)], "seq long, value string")
    config = relay.Config("h", "i", trace_url="http://t/{trace_id}")
    events = relay.deduplicated(spool.events_of(lines))
    assert events.count() == len(EVENTS) - 1
    rows, scopes = relay.resolved(events, config)
    by = {r.key[-7:]: r for r in rows.collect()}
    seed = one(spark, identity.scoped_seed("session", "h", "i", F.lit("s")))
    assert {k: r.session == seed for k, r in by.items() if not k.startswith("9")} == dict.fromkeys(["1/start", "2/start", "3/start", "04/mark", "5/start", "001/end"], True)
    assert by["9/start"].session == one(spark, identity.scoped_seed("session", "h", "i", F.lit("relay-root:00000000-0000-4000-8000-000000000009")))
    assert by["1/start"].session_start and by["001/end"].session_end and not by["2/start"].session_start
    assert len({r.actor for k, r in by.items() if not k.startswith("9")}) == 1
    assert by["3/start"].trace == by["1/start"].trace == "00000000000040008000000000000001" and by["3/start"].span == "8000000000000003" and by["04/mark"].span == by["2/start"].span
    assert by["2/start"].trace_url == f"http://t/{by['1/start'].trace}"
    linked = relay.with_parents(relay.projected(rows, config), config).orderBy("seq").collect()
    assert [r.key[-7:] for r in linked] == ["3/start", "5/start", "001/end"]
    assert linked[0].parents == [] and linked[1].parents == [linked[0].source_key] and linked[2].parents == [linked[1].source_key]
    assert linked[0].session_start and not linked[1].session_start
    audit = relay.Config("h", "i", mode="audit")
    whole = {r.key[-7:]: r for r in relay.with_parents(relay.projected(rows, audit), audit).collect()}
    assert len(whole) == 7 and set(whole["001/end"].parents) == {whole["1/start"].source_key, whole["5/start"].source_key}


def test_scopes_inherit_at_any_depth(spark):
    """A chain of 150 scopes under a session, agent scopes among them, and two in a circle with one below."""
    chain = [event(1, category="agent", session_id="s"), *[event(i, parent=i - 1, category="agent" if i % 7 == 0 else "tool") for i in range(2, 151)]]
    circle = [event(201, parent=202, category="agent"), event(202, parent=201, category="tool"), event(203, parent=202, category="tool")]
    lines = spark.createDataFrame(list(enumerate([*reversed(chain), *circle])), "seq long, value string")
    config = relay.Config("h", "i")
    _, scopes = relay.resolved(relay.deduplicated(spool.events_of(lines)), config)
    by = {int(r.uuid[-12:]): r for r in scopes.collect()}
    assert len(by) == 153 and by[150].telemetry_session == "s" and by[150].trace == by[1].trace
    assert {by[i].session for i in range(1, 151)} == {one(spark, identity.scoped_seed("session", "h", "i", F.lit("s")))}
    assert [i for i in range(1, 151) if by[i].root] == [1]
    assert by[201].root and by[201].session is not None and by[202].session is None and by[203].session is None


def test_stream_is_idempotent_and_remembers(spark, tmp_path):
    for sub in ("in", "out", "ck"):
        (tmp_path / sub).mkdir()
    config = relay.Config("h", "i")
    parts = [EVENTS[:4], EVENTS[3:6], EVENTS[2:3] + EVENTS[6:]]
    for n, part in enumerate(parts):
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join([*part, "", "not json"]) + "\n")
        relay.stream(spark.readStream.text(f"file://{tmp_path}/in"), config, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/recorded").orderBy("batch", "seq").collect()
    assert [r.key[-7:] for r in rows] == ["3/start", "5/start", "001/end"] and len({r.session for r in rows}) == 1
    assert rows[1].parents == [rows[0].source_key] and rows[2].parents == [rows[1].source_key]
    assert [r.json for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()] == ["not json"] * 3


def test_the_last_actor_outlives_a_batch(spark, tmp_path):
    events = [event(1, category="agent", session_id="s", actor_id="me"), event(2, parent=1, category="tool", lineage=SOURCE), event(3, parent=1, category="tool", lineage=OTHER)]
    lines = spark.createDataFrame(list(enumerate(events)), "seq long, value string")
    config = relay.Config("h", "i", mode="audit")
    for n, cuts in enumerate([[0, 3], [0, 1, 3], [0, 1, 2, 3]]):
        for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            relay.run_batch(spool.events_of(lines.filter(f"seq >= {a} AND seq < {b}")).drop("bad"), config, f"file://{tmp_path}/{n}", batch)
    found = [sorted((r.key, r.actor, tuple(r.parents)) for r in spark.read.parquet(f"{tmp_path}/{n}/recorded").collect()) for n in range(3)]
    assert found[0] == found[1] == found[2] and len({actor for _, actor, _ in found[0]}) == 1


def test_spool(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text("\n".join([EVENTS[0], "", EVENTS[1]]) + "\n")
    assert sorted(r.line for r in spool.read_events(spark, str(path)).collect()) == [1, 3]
    path.write_text("\n".join([EVENTS[0], "", "{}"]) + "\n")
    with pytest.raises(spool.LineError, match="line 3"):
        spool.read_events(spark, str(path))
    rows = spark.createDataFrame([(0, "é"), (1, "bcd")], "n int, json string")
    got = spool.evidence(rows, F.col("json"), ["n"]).orderBy("n").collect()
    assert [(r.byte_offset, r.byte_length) for r in got] == [(0, 2), (3, 3)] and got[0].digest == hashlib.sha256("é".encode()).hexdigest()
    assert replay.OF_OPERATION[0] == "operations"
