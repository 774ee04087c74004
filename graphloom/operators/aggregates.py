"""Roll-ups over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import states as S
from ..sources.frames import Frames
from .relational import nodes, short_resources


def state_counts(g: Frames, frame: str) -> DataFrame:
    """state, n of attached files or steps; the partial sums leave one row per state and task."""
    ids = nodes(g).select(F.col("i").alias("node"))
    return getattr(g, frame).join(ids, "node", "left_semi").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def resource_used(g: Frames) -> DataFrame:
    running = g.step.filter(F.col("state") == S.RUNNING).select("node")
    return g.step_resource.join(running, "node", "left_semi").groupBy("name").agg(F.sum("units").alias("used"))


def need_buckets(g: Frames, needs: DataFrame) -> DataFrame:
    """implied_need, succeeded, n of attached steps; needs has node and implied_need."""
    s = g.step.join(nodes(g, "step").select(F.col("i").alias("node")), "node", "left_semi").join(needs, "node")
    return s.groupBy("implied_need", (F.col("state") == S.SUCCEEDED).alias("succeeded")).agg(F.count(F.lit(1)).alias("n"))


def count_drift(g: Frames, kept: DataFrame, needs: DataFrame) -> DataFrame:
    """implied_need, succeeded, stored, n: buckets whose stored count (kept: as need_buckets gives them) isn't what a recount gives."""
    k = kept.select("implied_need", "succeeded", F.col("n").alias("stored"))
    both = need_buckets(g, needs).join(k, ["implied_need", "succeeded"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.filter(zero("n") != zero("stored")).select("implied_need", "succeeded", zero("stored").alias("stored"), zero("n").alias("n"))


def required_steps(buckets: DataFrame, threshold: int) -> DataFrame:
    n = F.when(F.col("implied_need") > threshold, F.col("n"))
    return buckets.agg(F.coalesce(F.sum(F.when(F.col("succeeded"), n)), F.lit(0)).alias("succeeded"), F.coalesce(F.sum(n), F.lit(0)).alias("required"))


def totals(g: Frames) -> DataFrame:
    names = ("node", "dependency", "file", "step", "step_resource", "env_var")
    out = None
    for n in names:
        one = getattr(g, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("frame"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def short_by_name(short: DataFrame) -> DataFrame:
    return short.groupBy("name").agg(F.max("units").alias("units_needed"), F.max("available").alias("units_available"))


def resources_free(g: Frames) -> DataFrame:
    """node, free: whether every resource that a step needs is left beside the running steps."""
    used = resource_used(g)
    left = g.available_resource.join(used, "name", "left").select("name", (F.col("units") - F.coalesce("used", F.lit(0))).alias("left"))
    short = g.step_resource.join(left, "name", "left").filter("left IS NULL OR left < units").select("node").distinct()
    return g.step.select("node").join(short.withColumn("short", F.lit(True)), "node", "left").select("node", F.col("short").isNull().alias("free"))


__all__ = ["need_buckets", "required_steps", "resource_used", "resources_free", "short_by_name", "short_resources", "state_counts", "totals"]
