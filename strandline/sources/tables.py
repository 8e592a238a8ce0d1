"""The lineage graph of the provided tables, as a log.

Namespace ``tpch``, version 1. Orders, customers, suppliers, nations, regions, parts, documents
and labels are entities; keys between tables are relations. Every relation is recorded by the
event of the row it comes from, and every event by an operation of the same id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Log, external

NS, VERSION = "tpch", "1"
#: name, kind it comes from, kind it leads to, role, direction
RELATIONS = (
    ("placed-by", "order", "customer", "primary", "from-explained-by-to"),
    ("located-in", "customer", "nation", "supporting", "from-explained-by-to"),
    ("based-in", "supplier", "nation", "supporting", "from-explained-by-to"),
    ("part-of", "nation", "region", "contextual", "from-explained-by-to"),
    ("contains", "order", "part", "causal", "from-explained-by-to"),
    ("supplied-by", "part", "supplier", "influence", "from-explained-by-to"),
    ("annotates", "label", "document", "attribution", "to-explained-by-from"),
    ("peer-of", "nation", "nation", "contradicting", "symmetric"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, id: Column | str) -> Column:
    return external(NS, kind, F.col(id) if isinstance(id, str) else id)


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, src, dst, event_id) of all relations, once each."""
    t = lambda n: read(spark, sf_dir, n)

    def rows(df: DataFrame, name: str, src: Column, dst: Column, event: str, id: str) -> DataFrame:
        return df.select(F.lit(name).alias("name"), src.alias("src"), dst.alias("dst"), F.concat(F.lit(f"{event}-"), F.col(id).cast("string")).alias("event_id"))

    nation = t("nation")
    peers = nation.alias("a").join(nation.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    peers = peers.select(F.col("a.n_nationkey").alias("n1"), F.col("b.n_nationkey").alias("n2"))
    line = t("lineitem")
    parts = [
        rows(t("orders"), "placed-by", key("order", "o_orderkey"), key("customer", "o_custkey"), "order", "o_orderkey"),
        rows(t("customer"), "located-in", key("customer", "c_custkey"), key("nation", "c_nationkey"), "customer", "c_custkey"),
        rows(t("supplier"), "based-in", key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "supplier", "s_suppkey"),
        rows(nation, "part-of", key("nation", "n_nationkey"), key("region", "n_regionkey"), "nation", "n_nationkey"),
        rows(line.select("l_orderkey", "l_partkey").distinct(), "contains", key("order", "l_orderkey"), key("part", "l_partkey"), "order", "l_orderkey"),
        rows(line.select("l_partkey", "l_suppkey").distinct(), "supplied-by", key("part", "l_partkey"), key("supplier", "l_suppkey"), "part", "l_partkey"),
        rows(t("labels").select("doc_id").distinct(), "annotates", key("label", "doc_id"), key("document", "doc_id"), "label", "doc_id"),
        rows(peers, "peer-of", key("nation", "n1"), key("nation", "n2"), "nation", "n1"),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_log(spark: SparkSession, sf_dir: str) -> Log:
    """The graph with its schemas; enough for graph queries."""
    edges = relation_rows(spark, sf_dir).select(
        F.col("event_id").alias("op_id"), "event_id", F.lit(NS).alias("ns"), F.lit(VERSION).alias("version"), F.lit(NS).alias("rel_ns"), "name", "src", "dst",
        F.lit("[]").alias("attrs_canon"),
    )
    schemas = spark.createDataFrame(
        [(NS, VERSION, NS, name, "external", NS, a, "external", NS, b, role, direction) for name, a, b, role, direction in RELATIONS],
        "ns string, version string, rel_ns string, name string, from_tag string, from_ns string, from_kind string, to_tag string, to_ns string, to_kind string, role string, direction string",
    )
    return Log(spark, {"relations": edges, "relation_schemas": schemas, "schemas": spark.createDataFrame([("schemas", 0, NS, VERSION)], "op_id string, ord int, ns string, version string")})


def string_attrs(**columns: Column) -> Column:
    """Attributes of tag string, or of the tag that a name ends with after two underscores."""
    pairs = []
    for name, column in columns.items():
        own, _, tag = name.partition("__")
        pairs += [F.lit(own.replace("_", "-")), F.struct(F.lit(tag or "string").alias("tag"), column.cast("string").alias("text"))]
    return F.create_map(*pairs)


def observation_log(spark: SparkSession, sf_dir: str) -> Log:
    """Customers and orders as observed entities: a customer is seen at first, and again by each
    of its orders, in the order of their keys (``topo``), with the latest order's status."""
    customers = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey")).alias("op_id"), F.lit(0).alias("ord"), key("customer", "c_custkey").alias("entity"), F.lit(NS).alias("ns"), F.lit(VERSION).alias("version"),
        string_attrs(name=F.col("c_name"), segment=F.col("c_mktsegment"), nation__int=F.col("c_nationkey")).alias("attrs"), F.lit(-1).cast("long").alias("topo"),
    )
    orders = read(spark, sf_dir, "orders")
    seen = orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("op_id"), F.lit(1).alias("ord"), key("customer", "o_custkey").alias("entity"), F.lit(NS).alias("ns"), F.lit(VERSION).alias("version"),
        string_attrs(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("attrs"), F.col("o_orderkey").alias("topo"),
    )
    own = orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("op_id"), F.lit(0).alias("ord"), key("order", "o_orderkey").alias("entity"), F.lit(NS).alias("ns"), F.lit(VERSION).alias("version"),
        string_attrs(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), created_at=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("attrs"), F.col("o_orderkey").alias("topo"),
    )
    return Log(spark, {"observations": reduce(DataFrame.unionByName, [customers, seen, own])})


def claim_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from ``events``, as ``retention`` folds them: an error claims its user at escrowed, a
    purchase at pinned, a view at referenced (claim: the user and the type); a signup releases
    all three."""
    events = read(spark, sf_dir, "events")
    level = {"view": 0, "purchase": 1, "error": 2}
    at = F.struct(F.col("event_id").alias("topo"), F.lit(0).alias("ord"))
    claim = lambda kind: F.concat_ws("/", F.lit("claim"), F.col("user_id").cast("string"), kind)
    resource = key("user", "user_id").alias("resource")
    strength = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "purchase", 1).otherwise(2).alias("strength")
    claims = events.filter(F.col("event_type").isin(*level)).select(at.alias("at"), claim(F.col("event_type")).alias("claim_id"), resource, strength)
    kinds = F.explode(F.array(*[F.lit(k) for k in level])).alias("kind")
    freed = events.filter("event_type = 'signup'").select(at.alias("at"), "user_id", kinds)
    freed = freed.select("at", claim(F.col("kind")).alias("claim_id"), resource, F.lit(None).cast("int").alias("strength"))
    return claims.unionByName(freed)


def turn_log(spark: SparkSession, sf_dir: str) -> Log:
    """Conversations as a chain of operations: each turn is one, and follows the turn before."""
    turns = read(spark, sf_dir, "conversations")
    op = lambda turn: F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    ops = turns.select(op(F.col("turn")).alias("op_id"), external("chat", "turn", F.concat_ws("/", "conv_id", "turn")).alias("source"))
    follows = turns.filter("turn > 0").select(op(F.col("turn")).alias("op_id"), op(F.col("turn") - 1).alias("parent_id"))
    said = turns.select(op(F.col("turn")).alias("op_id"), F.lit(0).alias("ord"), op(F.col("turn")).alias("event_id"), F.col("conv_id").cast("string").alias("session"), F.col("role").alias("actor"))
    heads = follows.select(F.col("op_id").alias("event_id"), "parent_id")
    return Log(spark, {"operations": ops, "parents": follows, "events": said, "event_parents": heads})
