import pytest

from strandline.functions.text import why_target
from strandline.model import external_key
from strandline.operators import graph
from strandline.operators.predicates import And, Any, EntityType, Not, Or, PropertyEquals
from strandline.operators.replay import LogError
from strandline.plans import named
from tests.fixture import BATCH, FLOUR, INTERNAL, NEVER_SEEN, OLD_RECIPE, OVEN, RECIPE, TASTING, kitchen


@pytest.fixture(scope="module")
def log(spark):
    return kitchen(spark)


def names(df, column="entity"):
    return {r[column] for r in df.select(column).collect()}


def test_explain_follows_declared_directions_only(log):
    found = graph.explain(log, RECIPE, 3)
    # the dispute's direction is one that explanation never takes
    assert names(found.entities) == {RECIPE, OLD_RECIPE, TASTING, BATCH, NEVER_SEEN, FLOUR, OVEN}
    assert names(found.edges, "name") == {"revises", "tasted", "compares", "uses", "follows", "bakes"}
    assert names(found.events, "event_id") == {"e-book", "e-kitchen", "e-agent"}


def test_depth_bounds_entities_and_edges(log):
    none = graph.explain(log, RECIPE, 0)
    assert names(none.entities) == {RECIPE} and none.edges.isEmpty() and none.operations.isEmpty()
    one = graph.explain(log, RECIPE, 1)
    assert names(one.entities) == {RECIPE, OLD_RECIPE, TASTING} and names(one.edges, "name") == {"revises", "tasted"}


def test_edges_back_to_visited_entities_are_selected(log):
    # the symmetric comparison is left from both ends
    found = graph.explain(log, BATCH, 2, ["contextual"])
    assert names(found.entities) == {BATCH, OVEN, TASTING} and names(found.edges, "name") == {"bakes", "compares"}


def test_lookup_and_unknown_roots_exist(log):
    unknown = external_key("book", "recipe", "nowhere")
    assert names(graph.lookup(log, unknown).entities) == {unknown}
    assert names(graph.explain(log, unknown).entities) == {unknown}


def test_history_joins_subjects_and_endpoints(log):
    found = graph.history(log, RECIPE)
    assert names(found.events, "event_id") == {"e-book", "e-agent"}
    assert names(found.operations, "op_id") == {"op-book", "op-agent"} and found.edges.isEmpty()


@pytest.mark.parametrize(("direction", "expected"), [("outgoing", {TASTING, RECIPE, BATCH, FLOUR, OLD_RECIPE, NEVER_SEEN}), ("incoming", {TASTING}), ("both", {TASTING, RECIPE, BATCH, FLOUR, OLD_RECIPE, NEVER_SEEN, OVEN})])
def test_traverse_directions(log, direction, expected):
    assert names(graph.traverse(log, graph.roots_of(log, TASTING), direction).entities) == expected


def test_selectors(log):
    root = graph.roots_of(log, TASTING)
    assert names(graph.traverse(log, root, selector="types", types=[("agent", "tasted")]).entities) == {TASTING, RECIPE}
    assert names(graph.traverse(log, root, selector="types", types=[]).entities) == {TASTING}
    assert names(graph.traverse(log, root, selector="explanatory", max_depth=1).edges, "name") == {"tasted", "compares", "disputes"}
    with pytest.raises(ValueError, match="selector"):
        graph.traverse(log, root, selector="all")


def test_predicates_are_two_valued_and_do_not_prune(log):
    def found(p):
        return names(graph.traverse(log, graph.roots_of(log, TASTING, INTERNAL), "both", predicate=p).entities)

    everything = found(Any())
    trial = PropertyEquals("status", "string", "trial")
    assert found(trial) == {RECIPE}
    # entities never observed satisfy the negation
    assert found(Not(trial)) == everything - {RECIPE} and NEVER_SEEN in found(Not(trial)) and INTERNAL in found(Not(trial))
    assert found(PropertyEquals("status", "int", "trial")) == set() == found(Or([]))
    assert found(And([])) == everything
    assert found(EntityType("internal", None, "session")) == {INTERNAL}
    assert found(Or([EntityType("external", "kitchen", "lot"), And([trial, EntityType("any")])])) == {FLOUR, RECIPE}
    assert found(PropertyEquals("nothing", "null", None)) == set()


def test_circles_end(spark, log):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "here string, there string")
    roots = spark.createDataFrame([("a",)], "entity string")
    assert {(r.entity, r.depth) for r in graph.distances(steps, roots).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_named_queries(log):
    assert names(named.instantiate(log, "book", "1", "why", RECIPE).entities) == {RECIPE, TASTING}
    assert names(named.instantiate(log, "book", "1", "past", BATCH).events, "event_id") == {"e-kitchen", "e-agent"}
    assert names(named.instantiate(log, "book", "1", "onward", RECIPE).entities) == {RECIPE, OLD_RECIPE}
    with pytest.raises(LogError, match="MissingNamedQuery"):
        named.instantiate(log, "book", "2", "why", RECIPE)
    with pytest.raises(LogError, match="InvalidQueryInput"):
        named.instantiate(log, "book", "1", "why", BATCH)


@pytest.mark.parametrize("uri", ["jj:/commit/a", "http://commit/a", "jj://commit", "jj://commit/", "jj:///a", "jj://commit/a/b", ""])
def test_bad_uris(uri):
    with pytest.raises(ValueError, match="invalid URI"):
        why_target(uri)


def test_good_uri():
    assert why_target("jj://commit/abc") == ("jj", "commit", "abc")


def test_path_is_greedy_by_role(log):
    found = graph.explain(log, RECIPE, 3)
    steps = graph.causal_path(found.edges, log.relation_schemas, RECIPE, 3)
    assert [(s["name"], s["forward"]) for s in steps] == [("tasted", False), ("compares", True), ("uses", True)]
