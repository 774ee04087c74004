"""Constraints as violation queries: (rule, i)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import states as S
from ..sources.frames import Frames

# Who may create what, and which kinds an edge may join.
CREATORS = [("step", "file"), ("st", "file"), ("root", "file"), ("step", "step"), ("root", "step"), ("step", "st")]
EDGES = [("file", "step"), ("step", "file"), ("st", "file")]


def _bad(df: DataFrame, rule: str, i: str = "i") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(i).alias("i"))


def node_rules(g: Frames) -> DataFrame:
    root = (F.col("i") == 1) & (F.col("creator") == 1) & ~F.col("detached") & (F.col("label") == "")
    n = g.node
    twice = n.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i")).filter("n > 1")
    out = _bad(n.filter((F.col("kind") == "root") != F.coalesce(root, F.lit(False))), "root")
    return out.unionByName(_bad(n.filter("creator IS NULL AND NOT detached"), "creator")).unionByName(_bad(twice, "unique"))


def creator_kinds(g: Frames) -> DataFrame:
    pairs = F.broadcast(g.spark.createDataFrame(CREATORS, "creator_kind string, kind string"))
    c = g.node.select(F.col("i").alias("creator"), F.col("kind").alias("creator_kind"))
    return _bad(g.node.filter("kind != 'root'").join(c, "creator").join(pairs, ["creator_kind", "kind"], "left_anti"), "creator kind")


def edge_kinds(g: Frames) -> DataFrame:
    pairs = F.broadcast(g.spark.createDataFrame(EDGES, "a string, b string"))
    n = g.node
    d = g.dependency.select("i", "source", "sink").join(n.select(F.col("i").alias("source"), F.col("kind").alias("a")), "source").join(n.select(F.col("i").alias("sink"), F.col("kind").alias("b")), "sink")
    return _bad(d.join(pairs, ["a", "b"], "left_anti"), "edge kind")


def file_rules(g: Frames) -> DataFrame:
    f = g.file.join(g.node.select(F.col("i").alias("node"), "detached"), "node")
    bare = f.filter(F.col("state").isin(S.CONFIRMED, S.BUILT, S.OUTDATED) & F.col("digest").isNull())
    return _bad(bare, "hash", "node").unionByName(_bad(f.filter((F.col("state") == S.UNDECLARED) & ~F.col("detached")), "undeclared", "node"))


def step_rules(g: Frames) -> DataFrame:
    s = g.step
    out = _bad(s.filter(F.col("deferred") & (F.col("state") != S.PENDING)), "deferred", "node")
    return out.unionByName(_bad(s.filter(~F.col("state").between(S.PENDING, S.CHECKING) | ~F.col("need").isin(S.OPTIONAL, S.DEFAULT, S.PLAN)), "range", "node")).unionByName(_bad(s.filter("duration < 0 OR defer_count < 0 OR holding < 0"), "negative", "node"))


def succeeded_outputs(g: Frames) -> DataFrame:
    """Outputs of succeeded steps that are neither built nor volatile."""
    from .relational import outputs_of

    ok = g.step.filter(F.col("state") == S.SUCCEEDED).select(F.col("node").alias("step"))
    return outputs_of(g).join(ok, "step", "left_semi").filter(~F.col("state").isin(S.BUILT, S.VOLATILE) & ~F.col("detached")).select("step", "label", "state")


def affected_steps(g: Frames, files: DataFrame) -> DataFrame:
    """node, flag: what would be recomputed for changed files (i): readiness of their users, safety of the makers' products."""
    users = g.dependency.join(files, F.col("source") == files.i, "left_semi").join(g.step, F.col("sink") == F.col("node"), "left_semi").select(F.col("sink").alias("node"), F.lit("ready").alias("flag"))
    makers = g.dependency.join(files, F.col("sink") == files.i, "left_semi").join(g.step, F.col("source") == F.col("node"), "left_semi").select(F.col("source").alias("node"), F.lit("after").alias("flag"))
    return users.unionByName(makers).distinct()


def derived_rules(g: Frames, hashes: DataFrame) -> DataFrame:
    """Columns that others imply: only running steps hold, steps that ended aren't deferred, a succeeded step has deferred in a row
    no more, and has_hash tells whether hashes (node) has a row."""
    s = g.step.join(hashes.select("node").distinct().withColumn("stored", F.lit(True)), "node", "left")
    ended = F.col("state").isin(S.SUCCEEDED, S.FAILED)
    rules = {"holding": (F.col("state") != S.RUNNING) & (F.col("holding") != 0), "ended": ended & F.col("deferred"), "count": (F.col("state") == S.SUCCEEDED) & (F.col("defer_count") != 0), "has_hash": F.col("has_hash") != F.coalesce("stored", F.lit(False))}
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return s.select(F.explode(broken).alias("rule"), F.col("node").alias("i"))
