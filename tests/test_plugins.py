import json
from dataclasses import replace

import pytest

from strandline.model import external_key
from strandline.operators import graph, transact, validate
from strandline.sources import hooks
from strandline.sources.plugins import DOCUMENTS, TASKS, TRACKER, PluginError, Registry
from strandline.sources.store import MemoryStore

ISSUE = {"id": "i-1", "title": "T", "status": "open", "priority": 2, "issue_type": "bug", "created_at": "c", "updated_at": "u", "labels": ["x"], "depends_on": ["i-0"], "parent_id": "i-9"}


def requests(spark, *payloads):
    rows = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")
    return hooks.tracker_requests(rows).drop("payload", "fault")


def test_registry():
    registry = Registry()
    registry.register(TRACKER)
    for bad, kind in (
        (TRACKER, "DuplicatePlugin"), (replace(TASKS, namespace="beads"), "NamespaceConflict"), (replace(TASKS, id=" "), "EmptyManifestField"), (replace(TASKS, abi="1"), "UnsupportedAbi"),
        (replace(TASKS, schemas=(("tracker", "1"), ("tracker", "1"))), "DuplicateSchema"), (replace(TASKS, schemas=(("beads", "1"),)), "SchemaNamespaceMismatch"),
    ):
        with pytest.raises(PluginError) as e:
            registry.register(bad)
        assert e.value.kind == kind
    registry.register(DOCUMENTS)


def test_issue_to_graph(spark):
    registry = Registry()
    registry.register(TRACKER)
    asked = requests(spark, {"event": "update", **ISSUE}, {"event": "update", **ISSUE, "id": "i-2", "depends_on": ["i-2"]}, {"event": "update", **ISSUE, "id": "i-3", "title": None})
    batch, faults = registry.observe("beads", asked)
    assert {(r.source_id, r.fault) for r in faults.collect()} == {("update/i-2/u", "SelfRelation"), ("update/i-3/u", "InvalidAttribute")}
    store = MemoryStore(spark)
    assert transact.commit(store, transact.plan(store.load(), batch)) == {"new": 1}
    log = store.load()
    assert validate.observation_faults(log.observations, log).isEmpty() and validate.relation_faults(log.relations, log).isEmpty()
    found = graph.explain(log, external_key("beads", "issue", "i-1"), 1)
    assert {r.entity.split("\0")[-1] for r in found.entities.collect()} == {"i-1", "i-0", "i-9"}
    # the same request again changes nothing
    again, _ = registry.observe("beads", requests(spark, {"event": "update", **ISSUE}))
    assert transact.commit(store, transact.plan(store.load(), again)) == {"idempotent": 1}


def test_documents(spark):
    registry = Registry()
    registry.register(DOCUMENTS)
    payload = json.dumps({"event": "delete", "id": "ADR-1", "title": "t", "frontmatter": {"related": ["ADR-2"], "status": "old"}})
    asked = hooks.document_requests(spark.createDataFrame([(payload,)], "payload string")).drop("payload", "fault")
    batch, faults = registry.observe("dg", asked)
    assert faults.isEmpty()
    (seen,) = batch.observations.collect()
    assert seen.attrs["deleted"].text == "true" and seen.attrs["document_type"].text == "adr" and seen.attrs["status"].text == "old"
    assert [(r.name, r.dst.split("\0")[-1]) for r in batch.relations.collect()] == [("related", "ADR-2")]
    with pytest.raises(PluginError, match="UnknownPlugin"):
        registry.observe("nobody", asked)
