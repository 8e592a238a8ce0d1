"""What has to be kept, and how it changes.

Claims are folded in canonical order: a claim is active from its claiming to its release, and
again if it is claimed again; a release before any claim does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import STRENGTHS, Log
from .replay import ordered


def claim_steps(log: Log, topo: DataFrame | None = None) -> DataFrame:
    """Claims and releases in order: at, claim_id, resource, strength (null: release)."""
    claims = ordered(log, log.claims, topo).select("at", "claim_id", "resource", "strength")
    about = log.claims.select("claim_id", F.col("resource").alias("own")).distinct()
    releases = ordered(log, log.releases, topo).join(about, "claim_id").select("at", "claim_id", F.col("own").alias("resource"), F.lit(None).cast("int").alias("strength"))
    return claims.unionByName(releases)


def active_claims(steps: DataFrame) -> DataFrame:
    """claim_id, resource and strength of the claims that are active in the end."""
    last = steps.groupBy("claim_id").agg(F.max_by(F.struct("resource", "strength"), "at").alias("s"))
    return last.select("claim_id", "s.resource", "s.strength").filter("strength IS NOT NULL")


def effective_retention(active: DataFrame) -> DataFrame:
    """The greatest strength that each resource is claimed with."""
    return active.groupBy("resource").agg(F.max("strength").alias("strength"))


def transition(before: Column, after: Column) -> Column:
    """The name of a change of strength (null: not required); null if there is none."""
    return (
        F.when(before.isNull() & after.isNotNull(), F.lit("became-required"))
        .when(before.isNotNull() & after.isNull(), F.lit("became-unrequired"))
        .when(before < after, F.lit("strengthened"))
        .when(before > after, F.lit("weakened"))
    )


def phase(name: Column) -> Column:
    """Whether a transition is carried out before (prepare) or after (finalize) publication."""
    return F.when(name.isin("became-required", "strengthened"), F.lit("prepare")).when(name.isNotNull(), F.lit("finalize"))


def transitions(steps: DataFrame) -> DataFrame:
    """Each change of a resource's effective strength: resource, at, before, after, transition, phase.

    For every strength, the claims that are active with it are counted along the resource's
    steps; the effective strength is the greatest with a count over 0.
    """
    own = Window.partitionBy("claim_id").orderBy("at")
    was = F.lag("strength").over(own)
    changed = steps.withColumn("was", was)
    order = Window.partitionBy("resource").orderBy("at", "claim_id").rowsBetween(Window.unboundedPreceding, 0)
    after = F.lit(None).cast("int")
    for level in range(len(STRENGTHS)):
        gained = (F.col("strength").eqNullSafe(F.lit(level))).cast("int") - (F.col("was").eqNullSafe(F.lit(level))).cast("int")
        after = F.when(F.sum(gained).over(order) > 0, F.lit(level)).otherwise(after)
    states = changed.select("resource", "at", "claim_id", after.alias("after"))
    states = states.withColumn("before", F.lag("after").over(Window.partitionBy("resource").orderBy("at", "claim_id")))
    named = states.withColumn("transition", transition(F.col("before"), F.col("after"))).filter("transition IS NOT NULL")
    return named.select("resource", "at", "claim_id", "before", "after", "transition", phase(F.col("transition")).alias("phase"))


def satisfied(effective: DataFrame, observed: DataFrame) -> DataFrame:
    """resource, required, observed, satisfied: whether what was observed is strong enough."""
    seen = observed.select(F.col("resource").alias("o_resource"), F.col("retention").alias("observed"))
    joined = effective.withColumnRenamed("strength", "required").join(seen, F.col("resource") == F.col("o_resource"), "left")
    return joined.select("resource", "required", "observed", F.coalesce(F.col("observed") >= F.col("required"), F.lit(False)).alias("satisfied"))


def reconcile(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """resource and action: ``create`` what is wanted and isn't there, ``remove`` the opposite."""
    create = desired.select("resource").distinct().join(actual, "resource", "left_anti").withColumn("action", F.lit("create"))
    remove = actual.select("resource").distinct().join(desired, "resource", "left_anti").withColumn("action", F.lit("remove"))
    return create.unionByName(remove)
