"""Attributes that agent events are recorded with."""

import hashlib
import json

from pyspark.sql import functions as F

from strandline.sources import spool
from strandline.streaming import projection, relay

EVENTS = [
    {"kind": "scope", "atof_version": "0.1", "uuid": "00000000-0000-4000-8000-00000000000a", "name": "run", "timestamp": "t0", "scope_category": "start", "category": "agent",
     "attributes": ["b", "a"], "category_profile": {"model_name": "m", "z": 1, "y": 2}, "data": {"b": 1, "a": "é"}, "metadata": {"session_id": "s", "trace_id": "own"}, "data_schema": {"name": "n", "version": "1"}},
    {"kind": "mark", "atof_version": "0.1", "uuid": "00000000-0000-4000-8000-00000000000b", "parent_uuid": "00000000-0000-4000-8000-00000000000a", "name": "linked", "timestamp": "t1",
     "metadata": {"lineage": {"source": {"namespace": "x", "kind": "k", "id": "1"}, "status": "done"}}},
    {"kind": "mark", "atof_version": "0.1", "uuid": "00000000-0000-4000-8000-00000000000c", "parent_uuid": "00000000-0000-4000-8000-00000000000a", "name": "bare", "attributes": [], "data": None, "metadata": None},
]


def recorded(spark, mode, events=EVENTS, evidence=None, **more):
    lines = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(events)], "seq long, value string")
    config = relay.Config("h", "i", mode=mode, **more)
    rows = relay.deduplicated(spool.events_of(lines).drop("bad"))
    if evidence:
        rows = spool.evidence(rows, F.col("json"), ["seq"])
    found = projection.requests(relay.projected(relay.resolved(rows, config)[0], config), config, evidence)
    return {r.name: (r, {k: (v.tag, v.text) for k, v in r.attrs.items()}) for r in found.collect()}


def test_audit_keeps_digests_and_no_payloads(spark):
    found = recorded(spark, "audit", trace_url="http://t/{trace_id}", span_api_url="http://s/{span_id}")
    row, attrs = found["run"]
    assert (row.source_ns, row.source_kind, row.source_id) == ("agent", "event", f"{EVENTS[0]['uuid']}/start") and row.cursor == f"audit/{row.source_id}"
    compact = '{"a":"é","b":1}'.encode()
    assert attrs["data-digest"] == ("string", hashlib.sha256(compact).hexdigest()) and attrs["data-size"] == ("int", str(len(compact))) and attrs["data-present"] == ("bool", "true")
    assert attrs["scope-attributes"] == ("list", '["b","a"]') and attrs["profile-extra-keys"] == ("list", '["y","z"]') and attrs["model-name"] == ("string", "m")
    assert attrs["data-schema-name"] == ("string", "n") and attrs["trace-id"] == ("string", "own") and attrs["timestamp"] == ("string", "t0")
    assert attrs["session-start"] == ("bool", "true") and "session-end" not in attrs and "parent-uuid" not in attrs
    assert attrs["telemetry-session-id"] == ("string", "s") and attrs["telemetry-trace-ui-url"][1] == f"http://t/{row.trace}" and attrs["telemetry-span-api-url"][1] == f"http://s/{row.span}"
    assert not any("é" in (text or "") for _, text in attrs.values())
    assert found["linked"][1]["session-id"] == attrs["session-id"] and found["linked"][1]["parent-uuid"] == ("string", EVENTS[0]["uuid"])


def test_members_that_are_not_there_have_no_attributes(spark):
    _, attrs = recorded(spark, "audit")["bare"]
    assert not {"timestamp", "scope-attributes", "model-name", "profile-extra-keys", "data-schema-name", "evidence-digest"} & set(attrs)
    assert all(text is not None for _, text in attrs.values())
    assert recorded(spark, "audit", [{"kind": "mark", "uuid": "u", "name": "least"}])["least"][1]["event-id"] == ("string", "u")


def test_links_keep_the_source_and_its_outcome(spark):
    found = recorded(spark, "link", evidence="spool.jsonl")
    assert set(found) == {"linked"}
    row, attrs = found["linked"]
    assert [attrs[f"source-{n}"][1] for n in ("namespace", "kind", "id")] == ["x", "k", "1"] and attrs["outcome"] == ("string", "done") and attrs["session-start"] == ("bool", "true")
    assert (row.source_kind, row.cursor) == ("link", f"link/{row.source_id}") and "data-digest" not in attrs and "parent-uuid" not in attrs
    line = json.dumps(EVENTS[1]).encode()
    assert attrs["evidence-ref"] == ("string", "spool.jsonl") and attrs["evidence-offset"] == ("int", str(len(json.dumps(EVENTS[0]).encode()) + 1))
    assert attrs["evidence-length"] == ("int", str(len(line))) and attrs["evidence-digest"] == ("string", hashlib.sha256(line).hexdigest())


def test_no_events(spark):
    assert recorded(spark, "audit", []) == {} and recorded(spark, "link", []) == {}
