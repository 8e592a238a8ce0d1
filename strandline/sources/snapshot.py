"""A snapshot of a version-control repository as one transaction.

Tables: ops (op_id, ord: ancestry order from the root, description), op_parents (op_id,
parent_id), produced (op_id, commit_id, predecessor_id, null if it has none), commits (commit_id,
change_id, description, author, email, millis, offset), commit_parents (commit_id, parent_id),
heads (commit_id), workspaces (workspace_id, commit_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import external
from ..operators.graph import distances

NS, VERSION = "jj", "1"
# Relation, the kinds it links, role and direction.
RELATIONS = (
    ("belongs-to-change", "commit", "change", "primary", "from-explained-by-to"),
    ("predecessor-of", "commit", "commit", "primary", "from-explained-by-to"),
    ("produced", "operation", "commit", "primary", "to-explained-by-from"),
    ("follows", "operation", "operation", "supporting", "from-explained-by-to"),
    ("contains", "workspace", "commit", "contextual", "to-explained-by-from"),
    ("currently-at", "workspace", "commit", "contextual", "to-explained-by-from"),
)


@dataclass
class Repository:
    ops: DataFrame
    op_parents: DataFrame
    produced: DataFrame
    commits: DataFrame
    commit_parents: DataFrame
    heads: DataFrame
    workspaces: DataFrame


def key(kind: str, id: Column) -> Column:
    return external(NS, kind, id)


def commit_closure(repo: Repository) -> DataFrame:
    """(commit_id, visible): commits that heads, operations or workspaces lead to. A commit is
    visible if a head or a workspace leads to it."""
    steps = repo.commit_parents.select(F.col("commit_id").alias("here"), F.col("parent_id").alias("there"))
    start = repo.heads.select("commit_id").unionByName(repo.workspaces.select("commit_id"))
    seen = distances(steps, start.select(F.col("commit_id").alias("entity"))).select(F.col("entity").alias("commit_id"))
    named = repo.produced.select("commit_id").unionByName(repo.produced.filter("predecessor_id IS NOT NULL").select(F.col("predecessor_id").alias("commit_id")))
    rest = distances(steps, named.select(F.col("commit_id").alias("entity"))).select(F.col("entity").alias("commit_id"))
    visible = seen.withColumn("visible", F.lit(True))
    return visible.unionByName(rest.join(seen, "commit_id", "left_anti").withColumn("visible", F.lit(False)))


def current_commits(repo: Repository, closure: DataFrame) -> DataFrame:
    """(change_id, commit_id): the commit that the last operation made for the change; a visible
    commit takes its place if its id is greater; changes no operation names and that have no
    visible commit have their lowest id."""
    own = repo.commits.join(closure, "commit_id").select("commit_id", "change_id", "visible")
    made = repo.produced.select("op_id", "commit_id").distinct().join(own, "commit_id").join(repo.ops.select("op_id", "ord"), "op_id")
    last = made.groupBy("change_id").agg(F.max_by("commit_id", F.struct("ord", "commit_id")).alias("made"))
    rest = own.groupBy("change_id").agg(F.max(F.when(F.col("visible"), F.col("commit_id"))).alias("seen"), F.min("commit_id").alias("low"))
    return rest.join(last, "change_id", "left").select("change_id", F.coalesce(F.greatest("made", "seen"), F.col("low")).alias("commit_id"))


def observations(repo: Repository, op_id: str) -> tuple[DataFrame, DataFrame]:
    """(entity, attrs) and relations (name, src, dst) of the repository at an operation."""
    text = lambda c: F.struct(F.lit("string").alias("tag"), c.cast("string").alias("text"))
    closure = commit_closure(repo)
    current = current_commits(repo, closure)
    commits = repo.commits.join(closure.select("commit_id"), "commit_id")
    author = F.concat("author", F.lit(" <"), "email", F.lit(">"))
    stamp = F.concat_ws("@", F.col("millis").cast("string"), F.col("offset").cast("string"))
    seen = [
        repo.ops.select(key("operation", F.col("op_id")).alias("entity"), F.create_map(F.lit("operation_id"), text(F.col("op_id")), F.lit("description"), text(F.col("description"))).alias("attrs")),
        commits.select(
            key("commit", F.col("commit_id")).alias("entity"),
            F.create_map(F.lit("commit_id"), text(F.col("commit_id")), F.lit("change_id"), text(F.col("change_id")), F.lit("description"), text(F.col("description")), F.lit("author"), text(author), F.lit("timestamp"), text(stamp)).alias("attrs"),
        ),
        current.select(
            key("change", F.col("change_id")).alias("entity"),
            F.create_map(F.lit("change_id"), text(F.col("change_id")), F.lit("current_commit"), F.struct(F.lit("entity").alias("tag"), key("commit", F.col("commit_id")).alias("text"))).alias("attrs"),
        ),
        repo.workspaces.select(key("workspace", F.col("workspace_id")).alias("entity"), F.create_map(F.lit("workspace_id"), text(F.col("workspace_id"))).alias("attrs")),
    ]

    def rows(df: DataFrame, name: str, a: str, a_id: str, b: str, b_id: str) -> DataFrame:
        return df.select(F.lit(name).alias("name"), key(a, F.col(a_id)).alias("src"), key(b, F.col(b_id)).alias("dst"))

    links = [
        rows(repo.op_parents, "follows", "operation", "op_id", "operation", "parent_id"),
        rows(repo.produced, "produced", "operation", "op_id", "commit", "commit_id"),
        rows(repo.produced.filter("predecessor_id IS NOT NULL"), "predecessor-of", "commit", "commit_id", "commit", "predecessor_id"),
        rows(commits, "belongs-to-change", "commit", "commit_id", "change", "change_id"),
        rows(repo.workspaces, "contains", "workspace", "workspace_id", "commit", "commit_id"),
        rows(repo.workspaces, "currently-at", "workspace", "workspace_id", "commit", "commit_id"),
    ]
    out, relations = seen[0], links[0]
    for more in seen[1:]:
        out = out.unionByName(more)
    for more in links[1:]:
        relations = relations.unionByName(more)
    return out, relations.distinct()


def pending(ops: DataFrame, anchored: DataFrame) -> DataFrame:
    """Operations that are not yet ingested, in ancestry order: those whose source has no operation."""
    sources = anchored.select("source")
    return ops.withColumn("source", key("operation", F.col("op_id"))).join(sources, "source", "left_anti").orderBy("ord")
