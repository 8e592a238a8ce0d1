"""The lineage queries bound to the provided tables, and their DuckDB equivalents.

Entities are shown as ``ns/kind/id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identity
from .functions import telemetry as t
from .functions.attributes import counter_of, format_value, saturating_sum, text_of, title_of
from .functions.text import clean_text, compact_text, detail_uri, entity_uri, percent_encode, plain_entity, render_url, time_parts
from .model import Log, canonical, external, external_key
from .operators import graph, replay, retention, transact, validate
from .operators.predicates import And, EntityType, Not, Or, PropertyEquals
from .plans import chronicle
from .shared import written
from .sources import hooks, plugins, snapshot, spool, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ORDER, CUSTOMER, NATION = (external_key("tpch", k, i) for k, i in (("order", "1"), ("customer", "1"), ("nation", "1")))


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(*names: str) -> list[Column]:
    return [plain_entity(F.col(n)).alias(n) for n in names]


def _relations(df: DataFrame) -> DataFrame:
    return df.select(F.col("name").alias("relation"), *_shown("src", "dst"), "event_id")


# --- the graph in SQL -------------------------------------------------------------------------

_E = "'tpch/{}/' || CAST({} AS VARCHAR)"


def _rel(name: str, a: str, a_id: str, b: str, b_id: str, event: str, event_id: str, source: str) -> str:
    return f"SELECT '{name}' AS relation, {_E.format(a, a_id)} AS src, {_E.format(b, b_id)} AS dst, '{event}-' || CAST({event_id} AS VARCHAR) AS event_id FROM {source}"


_EDGES = " UNION ALL ".join([
    _rel("placed-by", "order", "o_orderkey", "customer", "o_custkey", "order", "o_orderkey", "orders"),
    _rel("located-in", "customer", "c_custkey", "nation", "c_nationkey", "customer", "c_custkey", "customer"),
    _rel("based-in", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier", "s_suppkey", "supplier"),
    _rel("part-of", "nation", "n_nationkey", "region", "n_regionkey", "nation", "n_nationkey", "nation"),
    _rel("contains", "order", "l_orderkey", "part", "l_partkey", "order", "l_orderkey", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"),
    _rel("supplied-by", "part", "l_partkey", "supplier", "l_suppkey", "part", "l_partkey", "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"),
    _rel("annotates", "label", "doc_id", "document", "doc_id", "label", "doc_id", "(SELECT DISTINCT doc_id FROM labels)"),
    _rel("peer-of", "nation", "a.n_nationkey", "nation", "b.n_nationkey", "nation", "a.n_nationkey", "nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
])
_ROLES = ", ".join(f"('{n}', '{role}', '{d}')" for n, _, _, role, d in tables.RELATIONS)
_BASE = f"edges AS MATERIALIZED ({_EDGES}), rel(relation, role, direction) AS (VALUES {_ROLES})"
_OUT = "SELECT relation, src, dst, event_id, src AS here, dst AS there FROM {e}"
_BACK = "SELECT relation, src, dst, event_id, dst AS here, src AS there FROM {e}"
_EXPLAINED = (
    "SELECT e.relation, src, dst, event_id, src AS here, dst AS there, role FROM edges e JOIN rel USING (relation) WHERE direction IN ('from-explained-by-to', 'symmetric') "
    "UNION ALL SELECT e.relation, src, dst, event_id, dst, src, role FROM edges e JOIN rel USING (relation) WHERE direction IN ('to-explained-by-from', 'symmetric')"
)


def _search(steps: str, root: str, depth: int, then: str, edges: str = "edges", base: str = _BASE) -> str:
    walk = f"walk(entity, depth) AS (SELECT '{root}', 0 UNION SELECT s.there, w.depth + 1 FROM walk w JOIN steps s ON s.here = w.entity WHERE w.depth < {depth})"
    return f"WITH RECURSIVE {base}, steps AS MATERIALIZED ({steps.format(e=edges)}), {walk}, found AS (SELECT entity, min(depth) AS depth FROM walk GROUP BY entity) {then}"


_NODES = "SELECT entity FROM found"


def _edges_of(depth: int) -> str:
    return f"SELECT DISTINCT relation, src, dst, event_id FROM steps JOIN found ON here = entity WHERE depth < {depth}"


# --- graph queries ----------------------------------------------------------------------------


@query("SELECT 'tpch/order/1' AS entity")
def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup(tables.graph_log(spark, sf_dir), ORDER).entities.select(*_shown("entity"))


def _history_log(spark: SparkSession, sf_dir: str) -> Log:
    """Orders as events: an order's event has its customer as subject and records its relations."""
    log = tables.graph_log(spark, sf_dir)
    orders = read(spark, sf_dir, "orders")
    name = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    log.tables["subjects"] = orders.select(name.alias("event_id"), tables.key("customer", "o_custkey").alias("entity"))
    log.tables["events"] = log.relations.select("op_id", "event_id").distinct()
    log.tables["observations"] = tables.observation_log(spark, sf_dir).observations
    return log


_TOUCHING = f"""WITH {_BASE}, touching AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS event_id FROM orders WHERE o_custkey = 1
 UNION SELECT event_id FROM edges WHERE src = 'tpch/customer/1' OR dst = 'tpch/customer/1')"""


@query(f"{_TOUCHING} SELECT event_id FROM touching")
def q_history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.history(_history_log(spark, sf_dir), CUSTOMER).events


@query(f"{_TOUCHING} SELECT event_id AS op_id FROM touching UNION SELECT 'customer-1' UNION SELECT 'order-' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey = 1")
def q_history_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.history(_history_log(spark, sf_dir), CUSTOMER).operations


def _traverse(spark: SparkSession, sf_dir: str, root: str, **how) -> graph.Result:
    log = tables.graph_log(spark, sf_dir)
    return graph.traverse(log, graph.roots_of(log, root), **how)


@query(_search(_OUT, "tpch/order/1", 3, _NODES))
def q_traverse_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traverse(spark, sf_dir, ORDER, direction="outgoing", max_depth=3).entities.select(*_shown("entity"))


@query(_search(_BACK, "tpch/nation/1", 2, _NODES))
def q_traverse_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traverse(spark, sf_dir, NATION, direction="incoming", max_depth=2).entities.select(*_shown("entity"))


@query(_search(f"{_OUT} UNION ALL {_BACK}", "tpch/order/1", 2, _edges_of(2)))
def q_traverse_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(_traverse(spark, sf_dir, ORDER, direction="both", max_depth=2).edges)


@query(_search(_OUT, "tpch/order/1", 4, _NODES, "(SELECT * FROM edges WHERE relation IN ('placed-by', 'located-in'))"))
def q_traverse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = [("tpch", "placed-by"), ("tpch", "located-in")]
    return _traverse(spark, sf_dir, ORDER, selector="types", types=types, max_depth=4).entities.select(*_shown("entity"))


@query(_search(_BACK, "tpch/nation/1", 1, _edges_of(1), "(SELECT e.* FROM edges e JOIN rel USING (relation))"))
def q_traverse_explanatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(_traverse(spark, sf_dir, NATION, direction="incoming", selector="explanatory", max_depth=1).edges)


@query(_search(_OUT, "tpch/order/1", 2, """SELECT entity FROM found WHERE (entity LIKE 'tpch/part/%' OR entity LIKE 'tpch/nation/%') OR
 (entity LIKE 'tpch/customer/%' AND entity IN (SELECT 'tpch/customer/' || CAST(o_custkey AS VARCHAR) FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey) WHERE s <> 'X'))"""))  # fmt: skip
def q_traverse_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.graph_log(spark, sf_dir)
    log.tables["observations"] = tables.observation_log(spark, sf_dir).observations
    of = lambda kind: EntityType("external", "tpch", kind)
    wanted = Or([of("part"), of("nation"), And([of("customer"), Not(PropertyEquals("status", "string", "X"))])])
    found = graph.traverse(log, graph.roots_of(log, ORDER), max_depth=2, predicate=wanted)
    return found.entities.select(*_shown("entity"))


@query(_search(_EXPLAINED, "tpch/order/1", 3, _NODES))
def q_explain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.explain(tables.graph_log(spark, sf_dir), ORDER, 3).entities.select(*_shown("entity"))


@query(_search(_EXPLAINED, "tpch/order/1", 3, _edges_of(3)))
def q_explain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(graph.explain(tables.graph_log(spark, sf_dir), ORDER, 3).edges)


@query(_search(f"SELECT * FROM ({_EXPLAINED}) WHERE role IN ('primary', 'supporting')", "tpch/order/1", 10, _NODES))
def q_explain_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.explain(tables.graph_log(spark, sf_dir), ORDER, None, ["primary", "supporting"]).entities.select(*_shown("entity"))


@query("SELECT 'tpch/order/1' AS entity, CAST(0 AS BIGINT) AS edges")
def q_explain_depth0(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.explain(tables.graph_log(spark, sf_dir), ORDER, 0)
    n = found.edges.agg(F.count(F.lit(1)).alias("edges"))
    return found.entities.select(*_shown("entity")).join(n, F.lit(True), "left").select("entity", "edges")


@query(_search(_EXPLAINED, "tpch/document/0", 2, _NODES))
def q_explain_target_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose target is explained by their origin."""
    return graph.explain(tables.graph_log(spark, sf_dir), external_key("tpch", "document", "0"), 2).entities.select(*_shown("entity"))


@query(_search(_EXPLAINED, "tpch/customer/1", 2, _NODES))
def q_named_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import named

    log = tables.graph_log(spark, sf_dir)
    log.tables["named_queries"] = named.named_query_table(log, [("schemas", 1, "tpch", "1", "why", "external", "tpch", "customer", "explain", 2, [], None, None, [])])
    return named.instantiate(log, "tpch", "1", "why", CUSTOMER).entities.select(*_shown("entity"))


_BOTH_WAYS = """both_ways AS (SELECT relation, src AS here, dst AS there, TRUE AS forward FROM chosen UNION SELECT relation, dst, src, FALSE FROM chosen),
 ranked AS (SELECT b.*, CASE r.role WHEN 'causal' THEN 0 WHEN 'primary' THEN 1 WHEN 'supporting' THEN 2 WHEN 'contextual' THEN 3 ELSE 4 END AS priority,
  'tpch://' || substr(there, 6) AS uri FROM both_ways b JOIN rel r USING (relation))"""


def _path_step(at: int) -> str:
    seen = ", ".join(["'tpch/order/1'", *[f"(SELECT there FROM p{k})" for k in range(1, at)]])
    here = "'tpch/order/1'" if at == 1 else f"(SELECT there FROM p{at - 1})"
    return f"p{at} AS (SELECT {at} AS step, there, relation, forward FROM ranked WHERE here = {here} AND there NOT IN ({seen}) ORDER BY priority, 'tpch/' || relation, uri, there LIMIT 1)"


@query(_search(_EXPLAINED, "tpch/order/1", 3, "SELECT DISTINCT relation, src, dst FROM steps JOIN found ON here = entity WHERE depth < 3").replace(
    "SELECT DISTINCT relation, src, dst FROM steps", ", chosen AS (SELECT DISTINCT relation, src, dst FROM steps") + f"), {_BOTH_WAYS}, {', '.join(map(_path_step, (1, 2, 3)))}"
    " SELECT CAST(step AS INTEGER) AS step, there AS entity, relation, forward FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)")  # fmt: skip
def q_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy causal path from an order: step, entity, relation."""
    log = tables.graph_log(spark, sf_dir)
    found = graph.explain(log, ORDER, 3)
    steps = graph.causal_path(found.edges, log.relation_schemas, ORDER, 3)
    rows = [(i + 1, s["there"], s["name"], s["forward"]) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, entity string, relation string, forward boolean").withColumn("entity", plain_entity(F.col("entity")))


# --- replay -----------------------------------------------------------------------------------


@query("""SELECT 'tpch/customer/' || CAST(c_custkey AS VARCHAR) AS entity, coalesce(s, '') AS status, coalesce(p, '') AS priority, CASE WHEN s IS NULL THEN c_name ELSE '' END AS name
 FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey
 UNION ALL SELECT 'tpch/order/' || CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, '' FROM orders""")
def q_entities_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = replay.latest_entities(tables.observation_log(spark, sf_dir))
    text = lambda n: F.coalesce(text_of(F.col("attrs"), n), F.lit("")).alias(n)
    return latest.select(*_shown("entity"), text("status"), text("priority"), text("name"))


@query("""SELECT entity, count(DISTINCT op_id) AS operations FROM (
 SELECT 'tpch/customer/' || CAST(c_custkey AS VARCHAR) AS entity, 'customer-' || CAST(c_custkey AS VARCHAR) AS op_id FROM customer
 UNION ALL SELECT 'tpch/customer/' || CAST(o_custkey AS VARCHAR), 'order-' || CAST(o_orderkey AS VARCHAR) FROM orders
 UNION ALL SELECT 'tpch/order/' || CAST(o_orderkey AS VARCHAR), 'order-' || CAST(o_orderkey AS VARCHAR) FROM orders) GROUP BY entity""")
def q_entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = replay.entity_history(tables.observation_log(spark, sf_dir))
    return seen.groupBy("entity").agg(F.count(F.lit(1)).alias("operations")).select(*_shown("entity"), "operations")


_TURN = "'turn-' || CAST(conv_id AS VARCHAR) || '-' || CAST({} AS VARCHAR)"


@query(f"SELECT {_TURN.format('max(turn)')} AS op_id FROM conversations GROUP BY conv_id")
def q_op_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.operation_heads(tables.turn_log(spark, sf_dir))


@query(f"SELECT {_TURN.format('turn')} AS event_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def q_event_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.event_heads(tables.turn_log(spark, sf_dir))


@query(f"SELECT {_TURN.format('turn')} AS op_id, CAST(turn AS INTEGER) AS layer FROM conversations")
def q_op_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.depths(tables.turn_log(spark, sf_dir))


@query(f"""SELECT op_id, CAST(row_number() OVER (ORDER BY turn, rank) - 1 AS BIGINT) AS topo FROM (
 SELECT {_TURN.format('turn')} AS op_id, turn, row_number() OVER (PARTITION BY turn ORDER BY 'turn-' || CAST(conv_id AS VARCHAR) || '-0') AS rank FROM conversations)""")
def q_topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-in-first-out order: chains of turns advance side by side, in the order of their roots."""
    return replay.topological_order(tables.turn_log(spark, sf_dir))


@query(f"SELECT 'chat/turn/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS source, {_TURN.format('turn')} AS op_id, {_TURN.format('turn')} AS primary_event FROM conversations")
def q_source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.source_map(tables.turn_log(spark, sf_dir)).withColumn("source", plain_entity(F.col("source")))


@query(f"SELECT {_TURN.format('turn')} AS op_id FROM conversations WHERE conv_id % 2 = 0")
def q_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the heads of the even conversations descend from."""
    log = tables.turn_log(spark, sf_dir)
    even = F.regexp_extract("op_id", r"^turn-(\d+)-", 1).cast("long") % 2 == 0
    return replay.reachable(log, replay.operation_heads(log).filter(even))


@query(f"SELECT DISTINCT {_TURN.format('turn')} AS op_id FROM conversations")
def q_merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log split by role, with the system's turns in both halves, merges to itself."""
    log = tables.turn_log(spark, sf_dir)
    operations = log.operations.withColumn("attrs", F.lit(None).cast("map<string, struct<tag: string, text: string>>"))
    roles = log.events.select("op_id", F.col("actor").alias("role"))
    halves = []
    for own in ("user", "assistant"):
        mine = roles.filter(F.col("role").isin(own, "system")).select("op_id")
        halves.append(Log(spark, {"operations": operations.join(mine, "op_id", "left_semi"), "parents": log.parents.join(mine, "op_id", "left_semi")}))
    return replay.merge(*halves).operations.select("op_id").distinct()


@query("""WITH actual AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), expected AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 = 0), following AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0)
 SELECT CAST(k AS VARCHAR) AS op_id FROM (SELECT k FROM actual UNION SELECT k FROM following) EXCEPT (SELECT CAST(k AS VARCHAR) FROM expected EXCEPT SELECT CAST(k AS VARCHAR) FROM following)""")
def q_publish_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    of = lambda n: orders.filter(F.col("o_orderkey") % n == 0).select(F.col("o_orderkey").cast("string").alias("op_id"))
    return replay.publish_heads(of(3), of(6), of(4))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS id, count(DISTINCT (l_partkey, l_suppkey)) > 1 AS collides FROM lineitem GROUP BY l_orderkey, l_linenumber")
def q_declare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items declared by order and line number: the same id with another part or supplier collides."""
    rows = read(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    return replay.declare(rows, "id", F.concat_ws(":", "l_partkey", "l_suppkey"))


# --- retention --------------------------------------------------------------------------------

_STEPS = """steps AS (SELECT event_id AS pos, user_id, event_type AS kind, CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS strength FROM events WHERE event_type IN ('view', 'purchase', 'error')
 UNION ALL SELECT event_id, user_id, kind, NULL FROM events, (VALUES ('view'), ('purchase'), ('error')) k(kind) WHERE event_type = 'signup'),
 active AS (SELECT user_id, kind, arg_max(coalesce(strength, -1), pos) AS strength FROM steps GROUP BY user_id, kind HAVING arg_max(coalesce(strength, -1), pos) >= 0)"""


@query(f"WITH {_STEPS} SELECT 'claim/' || CAST(user_id AS VARCHAR) || '/' || kind AS claim_id, CAST(strength AS INTEGER) AS strength FROM active")
def q_active_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.active_claims(tables.claim_steps(spark, sf_dir)).select("claim_id", "strength")


@query(f"WITH {_STEPS} SELECT 'tpch/user/' || CAST(user_id AS VARCHAR) AS resource, CAST(max(strength) AS INTEGER) AS strength FROM active GROUP BY user_id")
def q_effective_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.effective_retention(retention.active_claims(tables.claim_steps(spark, sf_dir))).select(*_shown("resource"), "strength")


@query(f"""WITH {_STEPS}, states AS (SELECT user_id, pos, CASE WHEN e.a > coalesce(s.a, -1) THEN 2 WHEN p.a > coalesce(s.a, -1) THEN 1 WHEN v.a > coalesce(s.a, -1) THEN 0 END AS after FROM (
 SELECT event_id AS pos, user_id FROM events WHERE event_type <> 'click') x
 ASOF LEFT JOIN (SELECT user_id AS u, event_id AS a FROM events WHERE event_type = 'error') e ON e.u = user_id AND e.a <= pos
 ASOF LEFT JOIN (SELECT user_id AS u, event_id AS a FROM events WHERE event_type = 'purchase') p ON p.u = user_id AND p.a <= pos
 ASOF LEFT JOIN (SELECT user_id AS u, event_id AS a FROM events WHERE event_type = 'view') v ON v.u = user_id AND v.a <= pos
 ASOF LEFT JOIN (SELECT user_id AS u, event_id AS a FROM events WHERE event_type = 'signup') s ON s.u = user_id AND s.a <= pos),
 lagged AS (SELECT *, lag(after) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM states)
 SELECT 'tpch/user/' || CAST(user_id AS VARCHAR) AS resource, pos AS event_id, coalesce(before, -1) AS before, coalesce(after, -1) AS after,
 CASE WHEN before IS NULL THEN 'became-required' WHEN after IS NULL THEN 'became-unrequired' WHEN before < after THEN 'strengthened' ELSE 'weakened' END AS transition
 FROM lagged WHERE before IS DISTINCT FROM after""")
def q_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of what must be kept for each user, event by event."""
    steps = tables.claim_steps(spark, sf_dir)
    # a signup's three releases are one step
    found = retention.transitions(steps).select("resource", F.col("at.topo").alias("event_id"), "claim_id", "before", "after")
    order = Window.partitionBy("resource", "event_id").orderBy("claim_id")
    whole = found.withColumn("n", F.row_number().over(order))
    ends = whole.groupBy("resource", "event_id").agg(F.min_by(F.struct("before"), "n").alias("b"), F.max_by(F.struct("after"), "n").alias("a"))
    before, after = F.col("b.before"), F.col("a.after")
    return ends.select(
        *_shown("resource"), "event_id", F.coalesce(before, F.lit(-1)).alias("before"), F.coalesce(after, F.lit(-1)).alias("after"),
        retention.transition(before, after).alias("transition"),
    ).filter("transition IS NOT NULL")


@query(f"""WITH {_STEPS}, needed AS (SELECT user_id, CAST(max(strength) AS INTEGER) AS required FROM active GROUP BY user_id),
 seen AS (SELECT c_custkey, CAST(CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS INTEGER) AS observed FROM customer)
 SELECT 'tpch/user/' || CAST(user_id AS VARCHAR) AS resource, required, observed, coalesce(observed >= required, FALSE) AS satisfied FROM needed LEFT JOIN seen ON c_custkey = user_id""")
def q_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = retention.effective_retention(retention.active_claims(tables.claim_steps(spark, sf_dir)))
    held = F.when(F.col("c_acctbal") > 5000, 2).when(F.col("c_acctbal") > 0, 1).otherwise(0)
    seen = read(spark, sf_dir, "customer").select(tables.key("user", "c_custkey").alias("resource"), held.cast("int").alias("retention"))
    return retention.satisfied(needed, seen).withColumn("resource", plain_entity(F.col("resource")))


@query(f"""WITH {_STEPS}, want AS (SELECT DISTINCT user_id AS u FROM active), have AS (SELECT c_custkey AS u FROM customer WHERE c_custkey % 2 = 0)
 SELECT 'tpch/user/' || CAST(coalesce(w.u, h.u) AS VARCHAR) AS resource, CASE WHEN h.u IS NULL THEN 'create' ELSE 'remove' END AS action FROM want w FULL JOIN have h ON w.u = h.u WHERE w.u IS NULL OR h.u IS NULL""")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = retention.effective_retention(retention.active_claims(tables.claim_steps(spark, sf_dir)))
    have = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(tables.key("user", "c_custkey").alias("resource"))
    return retention.reconcile(want, have).withColumn("resource", plain_entity(F.col("resource")))


# --- validation -------------------------------------------------------------------------------


@query("""SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '#0' AS subject, 'MissingField' AS code, 'clerk' AS detail FROM orders WHERE o_orderkey % 2 = 1
 UNION ALL SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '#0', 'InvalidFieldType', 'total' FROM orders WHERE o_totalprice < 50000
 UNION ALL SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '#0', 'UnknownField', 'extra' FROM orders WHERE o_orderstatus = 'P'
 UNION ALL SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '#1', 'UnknownEntityType', 'tpch/basket' FROM orders WHERE o_orderkey % 10 = 0
 UNION ALL SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '#1', 'MissingSchema', 'tpch@2' FROM orders WHERE o_orderkey % 10 = 1""")
def q_validate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a schema: status and clerk (every other order lacks it) are needed strings,
    total a decimal (a null below 50000), and nothing else is known."""
    orders = read(spark, sf_dir, "orders")
    string = lambda c: F.struct(F.lit("string").alias("tag"), c.cast("string").alias("text"))
    small = F.col("o_totalprice") < 50000
    total = F.struct(F.when(small, "null").otherwise("decimal").alias("tag"), F.when(~small, F.col("o_totalprice").cast("string")).alias("text"))
    attrs = F.create_map(F.lit("status"), string(F.col("o_orderstatus")), F.lit("total"), total)
    attrs = F.when(F.col("o_orderkey") % 2 == 0, F.map_concat(attrs, F.create_map(F.lit("clerk"), string(F.col("o_custkey"))))).otherwise(attrs)
    attrs = F.when(F.col("o_orderstatus") == "P", F.map_concat(attrs, F.create_map(F.lit("extra"), string(F.lit("?"))))).otherwise(attrs)
    op = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("op_id")
    mine = orders.select(op, F.lit(0).alias("ord"), tables.key("order", "o_orderkey").alias("entity"), F.lit("tpch").alias("ns"), F.lit("1").alias("version"), attrs.alias("attrs"))
    odd = orders.filter("o_orderkey % 10 < 2")
    kind = F.when(F.col("o_orderkey") % 10 == 0, "basket").otherwise("order")
    odd = odd.select(op, F.lit(1).alias("ord"), external("tpch", kind, F.col("o_orderkey")).alias("entity"), F.lit("tpch").alias("ns"), F.when(F.col("o_orderkey") % 10 == 0, "1").otherwise("2").alias("version"), attrs.alias("attrs"))
    log = Log.of(
        spark, schemas=[("schemas", 0, "tpch", "1")], entity_schemas=[("tpch", "1", "order", False)],
        fields=[("tpch", "1", "order", "status", "string", True), ("tpch", "1", "order", "clerk", "string", True), ("tpch", "1", "order", "total", "decimal", False)],
    )
    return validate.observation_faults(mine.unionByName(odd), log)


@query("""SELECT 'line-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS subject,
 CASE WHEN l_partkey % 5 = 0 THEN 'InvalidSelfRelation' WHEN l_partkey % 5 = 1 THEN 'MissingSchema' WHEN l_partkey % 5 = 2 THEN 'UnknownRelation' ELSE 'InvalidRelationEndpoints' END AS code,
 CASE WHEN l_partkey % 5 = 2 THEN 'tpch/lost' ELSE 'tpch/contains' END AS detail FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey % 5 < 4""")
def q_validate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and part pairs, made faulty in four ways by the part key."""
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    case = F.col("l_partkey") % 5
    order, item = tables.key("order", "l_orderkey"), tables.key("part", "l_partkey")
    rows = pairs.select(
        F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("event_id"), F.lit("tpch").alias("ns"),
        F.when(case == 1, "9").otherwise("1").alias("version"), F.lit("tpch").alias("rel_ns"), F.when(case == 2, "lost").otherwise("contains").alias("name"),
        order.alias("src"), F.when(case == 0, order).when(case == 3, tables.key("region", "l_partkey")).otherwise(item).alias("dst"),
    )
    return validate.relation_faults(rows, tables.graph_log(spark, sf_dir))


# --- identities and texts ---------------------------------------------------------------------


@query("""SELECT event_id, sha256('strandline/id/v1' || chr(0) || 'event' || chr(0) || 'user:' || CAST(user_id AS VARCHAR) || chr(0) || 'event:' || CAST(event_id % 7 AS VARCHAR)) AS id,
 sha256('strandline/link/v1' || chr(0) || CAST(strlen(event_type) AS VARCHAR) || ':' || event_type || chr(0)) AS link,
 'strandline/plugin-seed/v1' || chr(0) || '4:tpch' || chr(0) || '6:loader' || chr(0) || CAST(strlen(CAST(user_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS seed FROM events""")
def q_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select(
        "event_id", identity.event_id(user, F.col("event_id") % 7).alias("id"), identity.digest_id(identity.DOMAINS.link, F.col("event_type")).alias("link"),
        identity.plugin_seed("tpch", "loader", F.col("user_id").cast("string")).alias("seed"),
    )


@query("""SELECT conv_id, turn, length(c) AS chars, CASE WHEN length(c) > 48 THEN left(c, 47) || '…' ELSE c END AS short, md5(c) AS digest
 FROM (SELECT conv_id, turn, regexp_replace(replace(replace(replace(text, chr(10), '↵'), chr(13), '␍'), chr(9), '⇥'), '[\\x00-\\x1f\\x7f-\\x9f]', '�', 'g') AS c FROM conversations)""")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(clean_text(text)).cast("long").alias("chars"), compact_text(text).alias("short"), F.md5(clean_text(text).cast("binary")).alias("digest"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, 'undated' AS plain_date, '--:--:--' AS plain_time FROM events""")
def q_ts_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    date, time = time_parts(stamp)
    millis = F.concat(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("@0"))
    other_date, other_time = time_parts(millis)
    return read(spark, sf_dir, "events").select("event_id", date.alias("date"), time.alias("time"), other_date.alias("plain_date"), other_time.alias("plain_time"))


@query("""SELECT page_id, 'https://traces.example/' || u || '?p=' || u AS link FROM (SELECT page_id, url_encode(url) AS u FROM pages)""")
def q_url_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", render_url("https://traces.example/{trace_id}?p={provider}", trace_id=F.col("url"), provider=F.col("url")).alias("link"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 'tpch://user/' || CAST(user_id AS VARCHAR) AS uri, 'prov://tpch/user/' || CAST(user_id AS VARCHAR) AS detail FROM events""")
def q_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json("props")
    key = tables.key("user", "user_id")
    k = F.coalesce(t.string_at(v, "k"), F.try_variant_get(v, "$.k", "string"))
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), entity_uri(key).alias("uri"), detail_uri(key).alias("detail"))


@query("""SELECT event_id, event_type AS cursor, 'update/' || CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS source_id, 'event ' || event_type AS title, CAST(event_id % 5 AS VARCHAR) AS priority,
 CASE WHEN event_id % 2 = 0 THEN '["a","' || event_type || '"]' ELSE '' END AS depends_on FROM (SELECT event_id, 'update' AS event_type, user_id, ts FROM events)""")
def q_tracker_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a tracker's update hooks."""
    events = read(spark, sf_dir, "events")
    issue = F.struct(
        F.col("user_id").cast("string").alias("id"), F.concat(F.lit("event "), F.lit("update")).alias("title"), (F.col("event_id") % 5).alias("priority"),
        F.date_format("ts", "yyyy-MM-dd").alias("updated_at"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("update"))).alias("depends_on"),
    )
    payloads = events.select("event_id", F.to_json(F.struct(F.lit("update").alias("event"), issue.alias("data"), F.col("event_id").alias("n"))).alias("payload"))
    found = hooks.tracker_requests(payloads.select("payload"))
    attr = lambda n: F.col("attrs")[n]["text"]
    n = F.get_json_object("payload", "$.n").cast("long")
    return found.select(n.alias("event_id"), "cursor", "source_id", attr("title").alias("title"), attr("priority").alias("priority"), F.coalesce(F.try_element_at("attrs", F.lit("depends-on"))["text"], F.lit("")).alias("depends_on"))


# --- aggregates, top-k, streams ---------------------------------------------------------------


@query("""SELECT CAST(conv_id AS VARCHAR) AS session, CAST(sum(CASE WHEN length(text) % 3 = 0 THEN NULL WHEN length(text) % 3 = 1 THEN turn ELSE length(text) END) AS BIGINT) AS edits FROM conversations GROUP BY conv_id""")
def q_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by alias: of three turns one has a text where the count should be, one ``edits``, and
    one only ``edit-count``."""
    n = F.length("text") % 3
    value = lambda tag, c: F.struct(F.lit(tag).alias("tag"), c.cast("string").alias("text"))
    turns = read(spark, sf_dir, "conversations")
    attrs = F.when(n == 0, F.create_map(F.lit("edits"), value("string", F.lit("many")), F.lit("edit-count"), value("int", F.lit(7)))).when(n == 1, F.create_map(F.lit("edits"), value("int", F.col("turn")))).otherwise(F.create_map(F.lit("edit-count"), value("int", F.length("text"))))
    return turns.groupBy(F.col("conv_id").cast("string").alias("session")).agg(saturating_sum(counter_of(attrs, chronicle.EDITS)).cast("long").alias("edits"))


@query("""SELECT CAST(count(DISTINCT conv_id) AS VARCHAR) AS sessions, CAST(count(DISTINCT role) AS VARCHAR) AS subagents, count(*) AS operations,
 CAST(sum(turn) AS VARCHAR) AS edits, CAST(sum(CASE WHEN turn % 2 = 0 THEN length(text) END) AS VARCHAR) AS files FROM conversations""")
def q_folded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded counts of a report over all turns."""
    log = tables.turn_log(spark, sf_dir)
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("op_id"), F.col("turn").alias("n"), F.length("text").alias("chars"))
    value = lambda c: F.struct(F.lit("int").alias("tag"), c.cast("string").alias("text"))
    attrs = F.map_filter(F.create_map(F.lit("edit-count"), value(F.col("n")), F.lit("files"), F.when(F.col("n") % 2 == 0, value(F.col("chars")))), lambda _, v: v.isNotNull())
    none = F.lit(None).cast("map<string, struct<tag: string, text: string>>")
    events = log.events.join(turns, "op_id").select("op_id", F.lit(0).alias("ord"), "event_id", "session", "actor", attrs.alias("attrs"))
    found = chronicle.folded(Log(spark, {"operations": log.operations.select("op_id", "source", none.alias("attrs")), "events": events}), log.operations.select("op_id"))
    return found.select(*[F.col(c).cast("string").alias(c) if c != "operations" else F.col(c) for c in ("sessions", "subagents", "operations", "edits", "files")])


# --- writes -----------------------------------------------------------------------------------


def _order_transactions(spark: SparkSession, sf_dir: str) -> transact.Plan:
    """Orders as transactions with their own source. Of seven, one names a source that isn't there as
    parent, one uses a session that isn't there, one releases a claim that isn't there, one is in
    the log already, and one has its source in the log under another operation."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("seed"), (F.col("o_orderkey") % 7).alias("c"))
    source = external("shop", "order", F.col("k"))
    none = F.lit(None).cast("string")
    no_attrs = F.lit(None).cast("map<string, struct<tag: string, text: string>>")
    known = orders.filter("c IN (3, 4)").select(F.when(F.col("c") == 3, identity.operation_id(F.col("seed"))).otherwise(F.concat(F.lit("other-"), F.col("seed"))).alias("op_id"), source.alias("source"), no_attrs.alias("attrs"))
    batch = Log(spark, {
        "operations": orders.select(F.col("seed").alias("op_id"), source.alias("source"), no_attrs.alias("attrs")),
        "events": orders.select(F.col("seed").alias("op_id"), F.lit(0).alias("ord"), F.concat("seed", F.lit("#0")).alias("event_id"), F.when(F.col("c") == 1, F.lit("nowhere")).alias("session"), none.alias("actor"), no_attrs.alias("attrs")),
        "releases": orders.filter("c = 2").select(F.col("seed").alias("op_id"), F.lit(1).alias("ord"), F.concat(F.lit("claim-"), F.col("k").cast("string")).alias("claim_id")),
    })
    parents = orders.filter("c = 0").select(F.col("seed").alias("op_id"), external("shop", "order", -F.col("k") - 1).alias("parent"))
    return transact.plan(Log(spark, {"operations": known}), batch, parents)


@query("""SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS seed, CASE o_orderkey % 7 WHEN 0 THEN 'MissingSourceParent' WHEN 1 THEN 'MissingSession' WHEN 2 THEN 'MissingClaim' WHEN 3 THEN 'idempotent'
 WHEN 4 THEN 'SourceConflict' ELSE 'new' END AS status, sha256('strandline/id/v1' || chr(0) || 'operation' || chr(0) || 'order-' || CAST(o_orderkey AS VARCHAR) || chr(0) || 'operation') AS op_id FROM orders""")
def q_transact_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_transactions(spark, sf_dir).outcomes.select("seed", "status", "op_id")


@query("""SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS seed, CASE o_orderkey % 7 WHEN 1 THEN 'MissingSession' ELSE 'MissingClaim' END AS code,
 CASE o_orderkey % 7 WHEN 1 THEN 'order-' || CAST(o_orderkey AS VARCHAR) || '#0' ELSE 'claim-' || CAST(o_orderkey AS VARCHAR) END AS detail FROM orders WHERE o_orderkey % 7 IN (1, 2)""")
def q_transact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_transactions(spark, sf_dir).faults


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 3 AS before, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 3 END AS kept, CASE WHEN c_custkey % 5 = 0 THEN 1 END AS needed FROM customer),
 t AS (SELECT k, before, CASE WHEN kept IS NULL THEN needed WHEN needed IS NULL THEN kept ELSE greatest(kept, needed) END AS after FROM s)
 SELECT CASE WHEN after IS NULL OR after < before THEN 'finalize' ELSE 'prepare' END AS phase, CASE WHEN after IS NULL THEN 'became-unrequired' WHEN after < before THEN 'weakened' ELSE 'strengthened' END AS kind,
 'tpch/user/' || CAST(k AS VARCHAR) AS subject, CAST(coalesce(after, -1) AS INTEGER) AS strength FROM t WHERE before IS DISTINCT FROM after""")
def q_retention_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is claimed; even ones are released, and events of every fifth require it pinned."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("id"))
    no_attrs = F.lit(None).cast("map<string, struct<tag: string, text: string>>")
    resource = tables.key("user", "k")
    log = Log(spark, {
        "operations": spark.createDataFrame([("start", None, None)], "op_id string, source string, attrs map<string, struct<tag: string, text: string>>"),
        "claims": customers.select(F.lit("start").alias("op_id"), F.lit(0).alias("ord"), F.concat(F.lit("claim-"), F.col("id")).alias("claim_id"), F.lit("event").alias("owner_kind"), F.lit("e").alias("owner_id"), resource.alias("resource"), (F.col("k") % 3).cast("int").alias("strength")),
    })
    due = customers.filter("k % 2 = 0 OR k % 5 = 0")
    seed = F.concat(F.lit("due-"), F.col("id"))
    batch = Log(spark, {
        "operations": due.select(seed.alias("op_id"), external("shop", "due", F.col("id")).alias("source"), no_attrs.alias("attrs")),
        "events": due.select(seed.alias("op_id"), F.lit(0).alias("ord"), F.concat(seed, F.lit("#0")).alias("event_id"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("actor"), no_attrs.alias("attrs")),
        "requires": due.filter("k % 5 = 0").select(F.concat(seed, F.lit("#0")).alias("event_id"), resource.alias("resource"), F.lit(1).alias("strength")),
        "releases": due.filter("k % 2 = 0").select(seed.alias("op_id"), F.lit(1).alias("ord"), F.concat(F.lit("claim-"), F.col("id")).alias("claim_id")),
    })
    planned = transact.plan(log, batch)
    steps = planned.prepare.withColumn("phase", F.lit("prepare")).unionByName(planned.finalize.withColumn("phase", F.lit("finalize")))
    return steps.select("phase", "kind", plain_entity(F.col("subject")).alias("subject"), F.coalesce("strength", F.lit(-1)).alias("strength"))


@query("SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS op_id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 9 = 0")
def q_merge_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs of all orders: every fourth has another subject in one, every ninth another attribute."""
    orders = read(spark, sf_dir, "orders")
    op = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))

    def log(other: bool) -> Log:
        changed = lambda n: (F.col("o_orderkey") % n == 0) & F.lit(other)
        return Log(spark, {
            "operations": orders.select(op.alias("op_id"), F.lit(None).cast("string").alias("source"), tables.string_attrs(status=F.when(changed(9), F.lit("?")).otherwise(F.col("o_orderstatus"))).alias("attrs")),
            "events": orders.select(op.alias("op_id"), F.lit(0).alias("ord"), op.alias("event_id"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("actor"), F.lit(None).cast("map<string, struct<tag: string, text: string>>").alias("attrs")),
            "subjects": orders.select(op.alias("event_id"), tables.key("customer", F.when(changed(4), -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))).alias("entity")),
        })

    return replay.collisions(log(False), log(True))


# --- snapshots, hooks, plugins ----------------------------------------------------------------


def _repository(spark: SparkSession, sf_dir: str) -> snapshot.Repository:
    """Conversations as changes, their turns as commits, each on the one before. Every third turn was
    made by an operation, and of even conversations the last turn is a head."""
    turns = read(spark, sf_dir, "conversations")
    id = lambda turn: F.concat(F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit("-"), F.lpad(turn.cast("string"), 4, "0"))
    made = turns.filter("turn % 3 = 0")
    last = turns.filter("conv_id % 2 = 0").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    change = F.col("conv_id").cast("string").alias("change_id")
    return snapshot.Repository(
        ops=made.select(F.concat(F.lit("op-"), id(F.col("turn"))).alias("op_id"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("ord"), F.col("role").alias("description")),
        op_parents=made.filter("turn > 0").select(F.concat(F.lit("op-"), id(F.col("turn"))).alias("op_id"), F.concat(F.lit("op-"), id(F.col("turn") - 3)).alias("parent_id")),
        produced=made.select(F.concat(F.lit("op-"), id(F.col("turn"))).alias("op_id"), id(F.col("turn")).alias("commit_id"), F.when(F.col("turn") > 0, id(F.col("turn") - 3)).alias("predecessor_id")),
        commits=turns.select(id(F.col("turn")).alias("commit_id"), change, F.col("role").alias("description"), F.lit("a").alias("author"), F.lit("a@b").alias("email"), F.lit(0).cast("long").alias("millis"), F.lit(0).alias("offset")),
        commit_parents=turns.filter("turn > 0").select(id(F.col("turn")).alias("commit_id"), id(F.col("turn") - 1).alias("parent_id")),
        heads=last.select(id(F.col("turn")).alias("commit_id")),
        workspaces=last.filter("conv_id = 0").select(F.lit("default").alias("workspace_id"), id(F.col("turn")).alias("commit_id")),
    )


_COMMIT = "lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || lpad(CAST({} AS VARCHAR), 4, '0')"


@query(f"SELECT CAST(conv_id AS VARCHAR) AS change_id, max(CASE WHEN conv_id % 2 = 0 OR turn % 3 = 0 THEN {_COMMIT.format('turn')} END) AS commit_id FROM conversations GROUP BY conv_id")
def q_change_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit that each change is at."""
    repo = _repository(spark, sf_dir)
    return snapshot.current_commits(repo, snapshot.commit_closure(repo))


@query(f"""WITH c AS (SELECT *, {_COMMIT.format('turn')} AS id, {_COMMIT.format('turn - 3')} AS before, max(CASE WHEN conv_id % 2 = 0 OR turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations)
 SELECT 'produced' AS name, 'jj/operation/op-' || id AS src, 'jj/commit/' || id AS dst FROM c WHERE turn % 3 = 0
 UNION ALL SELECT 'follows', 'jj/operation/op-' || id, 'jj/operation/op-' || before FROM c WHERE turn % 3 = 0 AND turn > 0
 UNION ALL SELECT 'predecessor-of', 'jj/commit/' || id, 'jj/commit/' || before FROM c WHERE turn % 3 = 0 AND turn > 0
 UNION ALL SELECT 'belongs-to-change', 'jj/commit/' || id, 'jj/change/' || CAST(conv_id AS VARCHAR) FROM c WHERE turn <= last
 UNION ALL SELECT n, 'jj/workspace/default', 'jj/commit/' || id FROM c, (VALUES ('contains'), ('currently-at')) v(n) WHERE conv_id = 0 AND turn = last""")
def q_snapshot_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = snapshot.observations(_repository(spark, sf_dir), "now")
    return links.select("name", *_shown("src", "dst"))


@query(f"SELECT 'op-' || {_COMMIT.format('turn')} AS op_id FROM conversations WHERE turn % 3 = 0 AND conv_id % 2 = 1")
def q_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that are still to be ingested, those of even conversations being anchored."""
    ops = _repository(spark, sf_dir).ops
    return snapshot.pending(ops, ops.filter(F.floor(F.col("ord") / 10_000) % 2 == 0).select(snapshot.key("operation", F.col("op_id")).alias("source"))).select("op_id")


@query("""SELECT event_id, 'observe/payload/' || sha256(props) AS source_id, json_extract_string(props, '$.k') AS k, 'int' AS tag FROM events""")
def q_generic_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as payloads of no known kind."""
    found = hooks.generic_requests(read(spark, sf_dir, "events").select(F.col("props").alias("payload")).distinct(), "shop")
    k = F.col("attrs")["k"]
    rows = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("p")).join(found, F.col("p") == F.col("payload"))
    return rows.select("event_id", "source_id", k["text"].alias("k"), k["tag"].alias("tag"))


@query("""WITH p AS (SELECT doc_id, lang, source, '{"event":"create","id":"ADR-' || CAST(doc_id AS VARCHAR) || '","title":"' || source || '","frontmatter":{"status":"' || lang || '","tags":["a","' || lang || '"],"related":"ADR-0"}}' AS payload FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
 SELECT doc_id, 'create/ADR-' || CAST(doc_id AS VARCHAR) || '/' || sha256(payload) AS source_id, 'create' AS cursor, 'adr' AS document_type, lang AS status, source AS title, '["a","' || lang || '"]' AS tags, '["ADR-0"]' AS related FROM p""")
def q_document_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the payloads of a document's creation."""
    docs = read(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    front = F.struct(F.col("lang").alias("status"), F.array(F.lit("a"), F.col("lang")).alias("tags"), F.lit("ADR-0").alias("related"))
    payload = F.to_json(F.struct(F.lit("create").alias("event"), F.concat(F.lit("ADR-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), front.alias("frontmatter")))
    found = hooks.document_requests(docs.select(payload.alias("payload")))
    attr = lambda n: F.col("attrs")[n]["text"]
    return found.select(
        F.substring_index(attr("document-id"), "-", -1).cast("long").alias("doc_id"), "source_id", "cursor", attr("document-type").alias("document_type"), attr("status").alias("status"),
        attr("title").alias("title"), attr("tags").alias("tags"), attr("related").alias("related"),
    )


@query("""SELECT 'update/' || CAST(event_id AS VARCHAR) || '/u' AS source_id, CASE event_id % 4 WHEN 0 THEN 'SelfRelation' ELSE 'InvalidAttribute' END AS fault FROM events WHERE event_id % 4 < 2""")
def q_plugin_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a tracker's issues: of four, one depends on itself and one has no title."""
    e = F.col("event_id")
    needs = F.when(e % 4 == 0, F.array(e.cast("string"))).otherwise(F.array(F.lit("x")))
    given = F.struct(
        F.lit("update").alias("event"), e.cast("string").alias("id"), F.when(e % 4 != 1, F.col("event_type")).alias("title"), F.lit("open").alias("status"), F.lit(1).alias("priority"), F.lit("bug").alias("issue_type"),
        F.lit("c").alias("created_at"), F.lit("u").alias("updated_at"), needs.alias("depends_on"),
    )
    asked = hooks.tracker_requests(read(spark, sf_dir, "events").select(F.to_json(given).alias("payload"))).drop("payload", "fault")
    return plugins.observe(plugins.TRACKER, asked)[1]


@query("""SELECT event_id, event_id % 3 = 2 AS bad FROM events WHERE event_id % 3 <> 1""")
def q_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a stream: of three, one is an event, one is blank, and one can't be read."""
    e = F.col("event_id")
    line = F.to_json(F.struct(F.lit("mark").alias("kind"), e.cast("string").alias("uuid"), F.col("event_type").alias("name")))
    lines = read(spark, sf_dir, "events").select("event_id", F.when(e % 3 == 0, line).when(e % 3 == 1, F.lit("  ")).otherwise(F.col("props")).alias("value"))
    return spool.events_of(lines).select("event_id", "bad")


@query("""SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS op_id, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%H:%M:%S') AS time,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ':order-' || CAST(o_orderkey AS VARCHAR) AS sort_key FROM orders""")
def q_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the orders that observe themselves, with their dates and sort keys."""
    log = tables.observation_log(spark, sf_dir)
    seen = log.observations.filter(F.col("op_id").startswith("order-")).drop("topo")
    ops = seen.select("op_id").distinct().select("op_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("map<string, struct<tag: string, text: string>>").alias("attrs"))
    found = chronicle.records(Log(spark, {"observations": seen, "operations": ops}), ops.select("op_id"))
    return found.select("op_id", "date", "time", "sort_key")


@query("""SELECT 'tpch/order/' || CAST(o_orderkey AS VARCHAR) AS entity, o_orderstatus AS status FROM orders WHERE lower(o_orderstatus) NOT IN ('closed', 'done', 'f')
 UNION ALL SELECT 'tpch/customer/' || CAST(o_custkey AS VARCHAR), s FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) WHERE s <> 'F'""")
def q_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that aren't finished; a status F stands for done."""
    log = tables.observation_log(spark, sf_dir)
    latest = replay.latest_entities(log)
    done = F.transform_values("attrs", lambda _, v: F.struct(v["tag"].alias("tag"), F.when(v["text"] == "F", "Done").otherwise(v["text"]).alias("text")))
    return chronicle.open_entities(latest.withColumn("attrs", done), latest.select("entity")).select(*_shown("entity"), "status")


@query("""SELECT op_id, line FROM (SELECT 'turn-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS op_id, n, line FROM (
 SELECT conv_id, turn, unnest([1, 2, 3]) AS n, unnest(['  status: "' || role || '"', '  priority: ' || CAST(turn AS VARCHAR), '  event-attributes: +1 attrs omitted']) AS line FROM conversations))""")
def q_attr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes by priority; those without one are counted."""
    turns = read(spark, sf_dir, "conversations")
    op = F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    attrs = tables.string_attrs(priority__int=F.col("turn"), whatever=F.col("text"), status=F.col("role"), name=F.lit("left out"))
    lines = chronicle.attribute_lines(turns.select(op.alias("op_id"), attrs.alias("attrs")), ["op_id"], "event-attributes", chronicle.NOT_OF_EVENTS)
    return lines.select("op_id", F.explode("lines").alias("line"))


@query("""SELECT event_id, CAST(coalesce(sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
 strlen(props) AS byte_length, sha256(props) AS digest FROM events""")
def q_spool_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of events in a spool of each user."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "props")
    return spool.evidence(events, F.col("props"), ["event_id"], ["user_id"]).select("event_id", "byte_offset", "byte_length", "digest")


_ARRIVALS = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS actor FROM conversations"


@query(f"SELECT conv_id, role, turn FROM ({_ARRIVALS}) WHERE nth = 1")
def q_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each key, the key being conversation and role."""
    from .streaming import relay

    turns = read(spark, sf_dir, "conversations")
    events = turns.select("conv_id", "role", "turn", F.col("conv_id").cast("string").alias("uuid"), F.lit("scope").alias("kind"), F.col("role").alias("scope_category"), F.col("turn").alias("seq"))
    return relay.deduplicated(events).select("conv_id", "role", "turn")


@query(f"SELECT conv_id, turn, coalesce(before, -1) AS before FROM ({_ARRIVALS})")
def q_prev_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source before, within a session."""
    from .streaming import relay

    turns = read(spark, sf_dir, "conversations")
    rows = turns.select(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.concat_ws("/", "conv_id", "turn").alias("source_key"),
        F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.lit(None).cast("string").alias("scope_category"),
    )
    found = relay.with_parents(rows, relay.Config("h", "i"))
    return found.select("conv_id", "turn", F.coalesce(F.substring_index(F.get("parents", F.lit(0)), "/", -1).cast("long"), F.lit(-1).cast("long")).alias("before"))


def relay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as agent events: a conversation is an agent scope that starts with its first
    turn; later turns are tool scopes, each within the one before; the first says the session."""
    turns = read(spark, sf_dir, "conversations")
    uuid = lambda turn: F.concat(F.lpad(F.hex("conv_id"), 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(F.hex(turn), 12, "0"))
    first = F.col("turn") == 0
    meta = F.when(first, F.to_json(F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("role").alias("actor_id")))).otherwise(F.lit("{}"))
    return turns.select(
        "conv_id", "turn", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("seq"), F.lit("scope").alias("kind"), F.lower(uuid(F.col("turn"))).alias("uuid"),
        F.when(~first, F.lower(uuid(F.col("turn") - 1))).alias("parent_uuid"), F.lit("start").alias("scope_category"), F.when(first, "agent").otherwise("tool").alias("category"),
        F.col("role").alias("name"), F.parse_json(meta).alias("metadata"),
    )


@query("""SELECT c.conv_id, turn, FALSE AS lost, 's' || CAST(c.conv_id AS VARCHAR) AS telemetry_session,
 lower(lpad(to_hex(c.conv_id), 8, '0')) || '000040008000' || lpad('0', 12, '0') AS trace, '8000' || lower(lpad(to_hex(turn), 12, '0')) AS span, turn = 0 AS session_start FROM conversations c""")
def q_session_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and traces that scopes inherit through their parents."""
    from .streaming import relay

    rows, _ = relay.resolved(relay_events(spark, sf_dir), relay.Config("h", "i"))
    return rows.select("conv_id", "turn", F.col("session").isNull().alias("lost"), "telemetry_session", "trace", "span", "session_start")


@query(f"SELECT conv_id, turn, coalesce(actor, -1) AS actor FROM ({_ARRIVALS})")
def q_actor_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actor of each turn."""
    from .streaming import relay

    rows, _ = relay.resolved(actor_events(read(spark, sf_dir, "conversations")), relay.Config("h", "i"))
    return rows.select("conv_id", "turn", F.coalesce(F.col("last_actor").cast("long"), F.lit(-1).cast("long")).alias("actor"))


def actor_events(turns: DataFrame) -> DataFrame:
    """Turns as marks: those of the assistant name themselves as actors of the conversation's session,
    and others have the last one that was named."""
    uuid = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    own = F.when(F.col("role") == "assistant", F.col("turn").cast("string"))
    meta = F.to_json(F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), own.alias("actor_id")))
    return turns.select(
        "conv_id", "turn", F.col("turn").alias("seq"), F.lit("mark").alias("kind"), uuid(F.col("turn")).alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"),
        F.lit(None).cast("string").alias("scope_category"), F.lit(None).cast("string").alias("category"), F.col("role").alias("name"), F.parse_json(meta).alias("metadata"),
    )


@query(f"SELECT conv_id, turn, coalesce(actor, -1) AS actor FROM ({_ARRIVALS})")
def q_actor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actors of q_actor_last, the turns arriving in three batches that know the actors before."""
    from .streaming import relay

    turns, found, known = read(spark, sf_dir, "conversations"), [], None
    for batch in range(3):
        cut = turns.filter((F.col("turn") >= 2 * batch) & ((F.col("turn") < 2 * batch + 2) | F.lit(batch == 2)))
        rows, _ = relay.resolved(actor_events(cut), relay.Config("h", "i"), known_actors=known)
        rows = written(rows.select("conv_id", "turn", "seq", "session", "last_actor"), "actor-batch")
        last = rows.filter("last_actor IS NOT NULL").groupBy("session").agg(F.max_by("last_actor", "seq").alias("last_actor"))
        known = last if known is None else last.unionByName(known.join(last, "session", "left_anti"))
        found.append(rows)
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.select("conv_id", "turn", F.coalesce(F.col("last_actor").cast("long"), F.lit(-1).cast("long")).alias("actor"))


def _recorded(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Requests of the agent events of conversations, each with its text as data; every third turn
    names the source that it explains."""
    from .streaming import projection, relay

    config = relay.Config("h", "i", mode=mode)
    events = relay_events(spark, sf_dir).join(read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text")), ["conv_id", "turn"])
    source = F.struct(F.lit("shop").alias("namespace"), F.lit("turn").alias("kind"), F.concat_ws("/", "conv_id", "turn").alias("id"))
    link = F.when(F.col("turn") % 3 == 1, F.struct(source.alias("source"), F.lit("done").alias("outcome")))
    session = F.when(F.col("turn") == 0, F.concat(F.lit("s"), F.col("conv_id").cast("string")))
    said = F.to_json(F.struct(session.alias("session_id"), link.alias("lineage")))
    event = F.struct(F.lit("0.1").alias("atof_version"), F.struct(F.lower(F.md5("text")).alias("m")).alias("data"), F.array(F.lit("parallel")).alias("attributes"))
    events = events.withColumn("metadata", F.parse_json(said)).withColumn("json", F.to_json(event)).withColumn("key", relay.event_key(F.col("uuid"), F.col("kind"), F.col("scope_category")))
    rows, _ = relay.resolved(written(events, "events"), config)
    return projection.requests(relay.projected(written(rows, "resolved"), config), config)


def _attr(name: str) -> Column:
    return F.col("attrs")[name]["text"]


_UUID = "lower(lpad(to_hex(conv_id), 8, '0')) || '-0000-4000-8000-' || lower(lpad(to_hex({}), 12, '0'))"


@query(f"""WITH e AS (SELECT conv_id, turn, {_UUID.format('turn')} AS id, CASE WHEN turn > 0 THEN {_UUID.format('turn - 1')} END AS parent, '{{"m":"' || md5(text) || '"}}' AS data FROM conversations WHERE text IS NOT NULL)
 SELECT id || '/start' AS source_id, 'audit/' || id || '/start' AS cursor, id AS event_id, parent, 'scope' AS kind, CASE turn WHEN 0 THEN 'agent' ELSE 'tool' END AS category, '0.1' AS version,
 sha256(data) AS data_digest, CAST(length(data) AS BIGINT) AS data_size, 's' || CAST(conv_id AS VARCHAR) AS telemetry_session, CASE turn WHEN 0 THEN 'true' END AS session_start, '["parallel"]' AS scope_attributes, FALSE AS lost FROM e""")
def q_audit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit records of agent events."""
    found = _recorded(spark, sf_dir, "audit").filter("text IS NOT NULL")
    return found.select(
        "source_id", "cursor", _attr("event-id").alias("event_id"), _attr("parent-uuid").alias("parent"), _attr("event-kind").alias("kind"), _attr("category").alias("category"), _attr("atof-version").alias("version"),
        _attr("data-digest").alias("data_digest"), _attr("data-size").cast("long").alias("data_size"), _attr("telemetry-session-id").alias("telemetry_session"), _attr("session-start").alias("session_start"),
        _attr("scope-attributes").alias("scope_attributes"), _attr("session-id").isNull().alias("lost"),
    )


@query("""SELECT conv_id, turn, 'shop' AS source_namespace, 'turn' AS source_kind, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS source_id, 'done' AS outcome, CASE turn WHEN 1 THEN 'true' END AS session_start,
 FALSE AS digested, TRUE AS cursor_of_source FROM conversations WHERE turn % 3 = 1""")
def q_link_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links record: the sources that events explain, and the start of a session with its first."""
    found = _recorded(spark, sf_dir, "link")
    return found.select(
        "conv_id", "turn", _attr("source-namespace").alias("source_namespace"), _attr("source-kind").alias("source_kind"), _attr("source-id").alias("source_id"), _attr("outcome").alias("outcome"),
        _attr("session-start").alias("session_start"), F.map_contains_key("attrs", "data-digest").alias("digested"), (F.col("cursor") == F.concat(F.lit("link/"), F.col("source_id"))).alias("cursor_of_source"),
    )


@query("""SELECT entity, attrs FROM (SELECT 'tpch/customer/' || CAST(c_custkey AS VARCHAR) AS entity, 'name="' || c_name || '" segment="' || c_mktsegment || '" nation=' || CAST(c_nationkey AS VARCHAR) AS attrs FROM customer)""")
def q_format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.observation_log(spark, sf_dir)
    seen = log.observations.filter("topo = -1")
    shown = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), format_value(F.col("attrs")[n])) for n in ("name", "segment", "nation")])
    return seen.select(*_shown("entity"), shown.alias("attrs"))


@query("""SELECT 'tpch/customer/' || CAST(c_custkey AS VARCHAR) AS entity, c_name AS title, '[{"key":"name","value":{"tag":"string","text":"' || c_name || '"}},{"key":"nation","value":{"tag":"int","text":"' || CAST(c_nationkey AS VARCHAR) || '"}},{"key":"segment","value":{"tag":"string","text":"' || c_mktsegment || '"}}]' AS canon FROM customer""")
def q_canonical_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tables.observation_log(spark, sf_dir).observations.filter("topo = -1")
    return seen.select(*_shown("entity"), title_of(F.col("attrs")).alias("title"), canonical(F.col("attrs")).alias("canon"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def q_percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", percent_encode(F.col("url")).alias("encoded"))
