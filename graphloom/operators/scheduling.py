"""What would run next, and decisions around a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states as S
from ..functions.patterns import Pattern
from ..sources.frames import Frames
from .aggregates import resources_free
from .recursive import need_and_tail, safety
from .relational import inputs_of, nodes, ready_steps


def dispatchable(g: Frames, threshold: int = S.OPTIONAL) -> DataFrame:
    """All steps that could be dispatched, with what orders them."""
    s = g.step.join(safety(g), "node").join(need_and_tail(g), "node").join(ready_steps(g), "node").join(resources_free(g), "node")
    s = s.join(nodes(g, "step").select(F.col("i").alias("node"), "label"), "node")
    ok = S.can_dispatch(*(F.col(c) for c in ("state", "safe", "safe_ignoring_hold", "has_hash", "deferred", "implied_need", "ready")))
    s = s.filter(ok & (F.col("implied_need") > threshold) & (F.col("has_hash") | F.col("free")))
    return s.select("node", "label", "has_hash", (F.col("implied_need") == S.PLAN).alias("plan"), (F.col("tail_time") / (1 + F.col("defer_count"))).alias("weight"))


def next_steps(g: Frames, n: int = 1, threshold: int = S.OPTIONAL) -> DataFrame:
    """The first n: checkable first, then plans, then the longest tails; ties to the smaller id. A top-k, not a full sort."""
    return dispatchable(g, threshold).orderBy(F.desc("has_hash"), F.desc("plan"), F.desc("weight"), "node").limit(n).select("node", "label", "has_hash")


def job_kind(g: Frames) -> DataFrame:
    """node, job: what dispatching each ready step would start."""
    bad = inputs_of(g).groupBy(F.col("step").alias("node")).agg(F.bool_or(F.col("dynamic") & ~S.available(F.col("state"))).alias("bad"))
    kind = F.when(F.col("has_hash") & F.coalesce("bad", F.lit(False)), "ValidateDynamicJob").otherwise("RunJob")
    return g.step.filter(F.col("state") == S.PENDING).join(bad, "node", "left").select("node", kind.alias("job"))


def bad_dynamic(g: Frames) -> DataFrame:
    """Steps with an input found while running that isn't there."""
    return inputs_of(g).filter(F.col("dynamic") & ~S.available(F.col("state"))).select(F.col("step").alias("node")).distinct()


def availability(state: Column) -> Column:
    return F.when(S.available(state), "AVAILABLE").when(state == S.UNCONFIRMED, "UNCONFIRMED").otherwise("UNAVAILABLE")


def run_outcome(unexpected: Column, unavailable: Column, unfresh: Column, success: Column) -> Column:
    return F.when(unexpected, "FAIL").when(unavailable | unfresh, "DEFER").when(success, "SUCCEED").otherwise("FAIL")


def skip_decision(old: DataFrame, new: DataFrame) -> DataFrame:
    """node, skip: both digests of the stored hash equal the present ones; frames have node, inp_digest, out_digest."""
    n = new.select("node", F.col("inp_digest").alias("i2"), F.col("out_digest").alias("o2"))
    return old.join(n, "node").select("node", ((F.col("inp_digest") == F.col("i2")) & (F.col("out_digest") == F.col("o2"))).alias("skip"))


def holds(events: DataFrame) -> DataFrame:
    """node, open: hold (+1) and release (-1) events (node, delta) summed."""
    return events.groupBy("node").agg(F.sum("delta").alias("open")).select("node", "open", (F.col("open") > 0).alias("holding"))


def step_info(g: Frames) -> DataFrame:
    """node, inp, env: declared inputs and variables of each step, ordered."""
    inp = inputs_of(g).filter("NOT dynamic").groupBy(F.col("step").alias("node")).agg(F.sort_array(F.collect_set("label")).alias("inp"))
    env = g.env_var.filter("NOT dynamic").groupBy("node").agg(F.sort_array(F.collect_set("name")).alias("env"))
    none = F.array().cast("array<string>")
    return g.step.select("node").join(inp, "node", "left").join(env, "node", "left").select("node", F.array_join(F.coalesce("inp", none), ",").alias("inp"), F.array_join(F.coalesce("env", none), ",").alias("env"))


def usage_sum(usage: DataFrame) -> DataFrame:
    return usage.agg(F.sum("utime").alias("utime"), F.sum("stime").alias("stime"), F.max("wtime").alias("wtime"))


def usage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """job, utime, stime, wtime used between two snapshots; frames have job, who ('self' or 'children'), utime, stime, wtime.

    Processor times are those of the process and its children; the clock is one for both.
    """
    b = before.select("job", "who", *(F.col(c).alias(f"{c}0") for c in ("utime", "stime", "wtime")))
    used = after.join(b, ["job", "who"])
    total = lambda c: F.sum(F.col(c) - F.col(f"{c}0")).alias(c)
    return used.groupBy("job").agg(total("utime"), total("stime"), F.max(F.when(F.col("who") == "self", F.col("wtime") - F.col("wtime0"))).alias("wtime"))


def stepinfo_filter(info: DataFrame, role: str, pattern: Pattern) -> DataFrame:
    """command, path, captures of the inp, out or vol paths of step descriptions that a pattern matches."""
    paths = info.select("command", F.explode(F.array_distinct(role)).alias("path"))
    return paths.filter(pattern.matches(F.col("path"))).select("command", "path", pattern.captures(F.col("path")).alias("captures"))


def same_duration(old: Column, new: Column) -> Column:
    """Changes up to a tenth are ignored."""
    return F.abs(new - old) * 10 <= F.abs(old)
