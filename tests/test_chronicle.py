from strandline.plans.chronicle import Chronicle, compact
from tests.fixture import OVEN, RECIPE, kitchen

EXPECTED = """@chronicle 1
query: why book://recipe/r-2
target: book://recipe/r-2 "Bread \\"rustic\\""
timebase: UTC
scope: causal depth=3
summary: status="trial"; title="Bread \\"rustic\\""; causal scope contains 7 entities, 3 events, and 6 explanatory edges across 3 records
path: book://recipe/r-2 <-[agent/tasted]- agent://event/t-1/start -[agent/compares]-> kitchen://batch/b-7 -[kitchen/uses]-> kitchen://lot/flour-3
folded: sessions=1 subagents=1 operations=3 entities=7 events=3 edges=6 edits=3 files=2
detail: prov://book/recipe/r-2

2030-05-01
11:59:58 RECORD kitchen://batch/b-7 "First of the day"
  operation: prov://operation/op-kitchen
  parents: [prov://operation/op-root]
  source: kitchen://batch/b-7
  entities: [kitchen://batch/b-7, kitchen://lot/flour-3, kitchen://oven/left]
  operation-kind: "bake"
  source-system: "range"
  event: e-kitchen
  subjects: [kitchen://batch/b-7, kitchen://oven/left]
  relation: kitchen://oven/left -[kitchen/bakes kitchen@1]-> kitchen://batch/b-7
  relation: kitchen://batch/b-7 -[kitchen/follows kitchen@1]-> kitchen://batch/b-6
  relation: kitchen://batch/b-7 -[kitchen/uses kitchen@1]-> kitchen://lot/flour-3
12:00:05 RECORD book://recipe/r-2 "Bread \\"rustic\\""
  operation: prov://operation/op-book
  parents: [prov://operation/op-root]
  source: book://hook/update/r-2
  entities: [book://recipe/r-1, book://recipe/r-2]
  status: "trial"
  updated-at: "2030-05-01T12:00:05Z"
  hook: "update"
  source-system: "shelf"
  event: e-book
  subjects: [book://recipe/r-2]
  relation: book://recipe/r-2 -[book/revises book@1]-> book://recipe/r-1
12:30:00 AGENT agent://event/t-1/start "tasting"
  operation: prov://operation/op-agent
  parents: [prov://operation/op-book, prov://operation/op-kitchen]
  source: agent://event/t-1/start
  entities: [agent://event/t-1/start]
  edits: 3
  outcome: "salty"
  provider: "ovenscope"
  trace-id: "tr-1"
  span-id: "sp-1"
  event-attributes: +1 attrs omitted
  session: s-1
  actor: a-1
  telemetry ovenscope trace tr-1 span sp-1
  projection: "audit"
  event: e-agent
  subjects: [agent://event/t-1/start, book://recipe/r-2]
  relation: agent://event/t-1/start -[agent/compares agent@1]-> kitchen://batch/b-7
  relation: agent://event/t-1/start -[agent/tasted agent@1]-> book://recipe/r-2
  retention: agent://event/t-1/start owner=event/e-agent strength=escrowed
  resource: agent://event/t-1/start availability=local integrity=verified retention=escrowed
@end
result: book://recipe/r-2 records=3 operations=3 entities=7 edges=6
open: book://recipe/r-2 status="trial", kitchen://oven/left status="warm\""""


def test_report(spark):
    text = Chronicle(kitchen(spark), RECIPE, 3).text()
    for got, want in zip(text.split("\n"), EXPECTED.split("\n"), strict=False):
        assert got == want
    assert text == EXPECTED and "secret" not in text


def test_depth_zero_keeps_history(spark):
    text = Chronicle(kitchen(spark), OVEN, 0).text()
    assert "summary: status=\"warm\"; title=\"Left oven\"; causal scope contains 1 entities, 0 events, and 0 explanatory edges across 1 records" in text
    assert "path: kitchen://oven/left\n" in text and "relation:" not in text


def test_compact_lines(spark):
    log = kitchen(spark)
    lines = {r.op_id: r.line for r in compact(log, log.operations.select("op_id")).collect()}
    assert lines["op-book"] == "op-book <- op-root source=book/hook/update/r-2 events=1 observations=2"
