"""Timing logs: statements, jobs, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import Frames

#: What to look for in a query plan's lines.
ISSUES = [("full_scan", "^SCAN (?!.*USING)"), ("automatic_index", "AUTOMATIC"), ("temp_btree", "TEMP B-TREE"), ("correlated_subquery", "CORRELATED")]


def with_index(g: Frames) -> DataFrame:
    return g.sqllog.join(g.sqllog_index, "query_i", "left")


def statement_times(g: Frames) -> DataFrame:
    """query, n, total, median of durations."""
    return with_index(g).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("total_ns"), F.avg("duration_ns").alias("mean_ns"), F.median("duration_ns").alias("median_ns"))


def plan_issues(g: Frames) -> DataFrame:
    """issue, n, total_ns over the statements whose plan has it."""
    lines = g.sqllog_index.select("query_i", F.explode(F.split("plan", ";")).alias("line"))
    found = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(k)) for k, p in ISSUES)))
    issues = lines.select("query_i", F.explode(found).alias("issue")).distinct()
    times = g.sqllog.groupBy("query_i").agg(F.sum("duration_ns").alias("total_ns"))
    return issues.join(times, "query_i", "left").groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.sum("total_ns").alias("total_ns"))


def ranked(df: DataFrame, value: str, key: str, top: int, min_pct: float = 0.0) -> DataFrame:
    """The top rows by value with their share and running share; stops once the rows before hold all but min_pct of the total.

    The total is one aggregate; only the top rows are ordered and windowed.
    """
    whole = df.agg(F.sum(value).alias("_total"))
    best = df.orderBy(F.desc(value), key).limit(top).crossJoin(whole)  # one row
    w = Window.orderBy(F.desc(value), key)
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    pct = lambda c: F.when(F.col("_total") == 0, 0.0).otherwise(100.0 * c / F.col("_total"))
    out = best.withColumn("running_pct", pct(run)).withColumn("pct", pct(F.col(value))).drop("_total")
    return out.filter(F.col("running_pct") - F.col("pct") < 100.0 - min_pct)


def intervals(g: Frames, buckets: int = 64) -> DataFrame:
    """start, stop, active: maximal intervals of equal concurrency, from the first event to the last.

    Events are summed per time first; the running sum goes over the bucketed time range, so no task orders all times: each
    bucket adds what the buckets before it hold.
    """
    delta = F.when(F.col("event") == "START", 1).otherwise(-1)
    times = g.joblog.filter(F.col("event").isin("START", "END")).groupBy("time_ns").agg(F.sum(delta).alias("delta"))
    ends = times.agg(F.min("time_ns").alias("_lo"), F.max("time_ns").alias("_hi"))
    t = times.crossJoin(ends)  # one row
    bucket = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col("time_ns") - F.col("_lo")) * F.lit(buckets) / (F.col("_hi") - F.col("_lo"))), F.lit(buckets - 1)))
    t = t.select("time_ns", "delta", bucket.cast("int").alias("bucket"))
    sums = t.groupBy("bucket").agg(F.sum("delta").alias("sum"), F.min("time_ns").alias("first"))
    order = Window.orderBy("bucket")  # `buckets` rows
    before = sums.select("bucket", F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(order).alias("next"))
    w = Window.partitionBy("bucket").orderBy("time_ns")
    out = t.join(F.broadcast(before), "bucket").select(F.col("time_ns").alias("start"), F.coalesce(F.lead("time_ns").over(w), F.col("next")).alias("stop"), (F.col("before") + F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("active"))
    return out.filter("stop IS NOT NULL")


def open_jobs(g: Frames) -> DataFrame:
    """job_i, description, start of jobs that have started and not ended; they count as active in the last interval and after it."""
    t = lambda e: F.max(F.when(F.col("event") == e, F.col("time_ns")))
    spans = g.joblog.groupBy("job_i", "description").agg(t("START").alias("start"), t("END").alias("stop"))
    return spans.filter("start IS NOT NULL AND stop IS NULL").select("job_i", "description", "start")


def dips(iv: DataFrame, njob: int, top: int) -> DataFrame:
    """The intervals below njob that lose most job time."""
    lost = (F.lit(njob) - F.col("active")) * (F.col("stop") - F.col("start"))
    return iv.filter(F.col("active") < njob).select("start", "stop", "active", lost.alias("lost")).orderBy(F.desc("lost"), "start").limit(top)


def dip_histogram(iv: DataFrame, njob: int) -> DataFrame:
    """active, n, total, lost: dips grouped by depth."""
    span = F.col("stop") - F.col("start")
    return iv.filter(F.col("active") < njob).groupBy("active").agg(F.count(F.lit(1)).alias("n"), F.sum(span).alias("total"), F.sum((F.lit(njob) - F.col("active")) * span).alias("lost"))


def concurrency(iv: DataFrame, njob: int) -> DataFrame:
    """mean, saturated_pct: time-weighted concurrency, and the share of time at njob or more."""
    span = F.col("stop") - F.col("start")
    whole = F.sum(span)
    return iv.agg((F.sum(F.col("active") * span) / F.nullif(whole, F.lit(0))).alias("mean"), (100.0 * F.sum(F.when(F.col("active") >= njob, span).otherwise(0)) / F.nullif(whole, F.lit(0))).alias("saturated_pct"))


def job_pivot(g: Frames) -> DataFrame:
    """job_i with the time of each event as a column; events are a fixed set, so Spark needn't look for them."""
    return g.joblog.groupBy("job_i").pivot("event", ["START", "END"]).agg(F.max("time_ns")).withColumnRenamed("START", "start").withColumnRenamed("END", "end")


def top_jobs(g: Frames, top: int) -> DataFrame:
    from .relational import job_spans

    d = job_spans(g).filter("stop IS NOT NULL").select("job_i", "description", (F.col("stop") - F.col("start")).alias("duration"))
    return d.orderBy(F.desc("duration"), "job_i").limit(top)


def findings(lines: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """line, label: lines that a pattern matches, with the label of the first that does."""
    label = F.coalesce(*(F.when(F.col("line").rlike(p), F.lit(k)) for k, p in patterns))
    return lines.select("line", label.alias("label")).filter("label IS NOT NULL")


def merged_profile(lines: DataFrame) -> DataFrame:
    """dso, symbol, time from a sectioned report (section, total, pct, dso, symbol): percentages of section totals, summed."""
    return lines.groupBy("dso", "symbol").agg(F.sum(F.col("pct") * F.col("total") / 100).alias("time"))


def attributed_frames(calls: DataFrame, wanted: DataFrame, hops: int = 10) -> DataFrame:
    """f, to: the first frame of interest (f) up the chain of heaviest callers; calls has f, caller, time."""
    heavy = calls.groupBy("f").agg(F.max_by("caller", F.struct("time", "caller")).alias("up"))
    flag = wanted.select(F.col("f").alias("at"), F.lit(True).alias("hit"))
    now = heavy.select("f", F.col("f").alias("at"))
    for _ in range(hops):
        step = now.join(flag, "at", "left").join(heavy.select(F.col("f").alias("at"), "up"), "at", "left")
        now = step.select("f", F.when(F.col("hit"), F.col("at")).otherwise(F.coalesce("up", "at")).alias("at"))
    return now.join(flag, "at", "left_semi").select("f", F.col("at").alias("to"))


def peak(samples: DataFrame, by: str, value: str) -> DataFrame:
    return samples.groupBy(by).agg(F.max(value).alias("peak"))


def first_rule(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the first rule whose prefix the path starts with keeps it; the last rule should be a catch-all."""
    return F.coalesce(*(F.when(path.startswith(p), F.lit(keep)) for p, keep in rules))


def merged_config(values: DataFrame) -> DataFrame:
    """key, value of the source with the highest priority; values has key, value, priority."""
    return values.groupBy("key").agg(F.max_by("value", "priority").alias("value"))


def ranked_profile(calls: DataFrame, by: str, top: int, min_pct: float = 0.0) -> DataFrame:
    """f, own, cumulative, running_pct: functions by own or cumulative time; calls has f, own and cumulative."""
    return ranked(calls.groupBy("f").agg(F.sum("own").alias("own"), F.sum("cumulative").alias("cumulative")), by, "f", top, min_pct)
