"""A stream of path changes reduced to what is deleted and what is updated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..sources.frames import SCHEMAS, Frames


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change records as they arrive in a folder of JSON files."""
    return spark.readStream.schema(SCHEMAS["change"]).json(folder)


def expanded(changes: DataFrame, known: DataFrame) -> DataFrame:
    """seq, path, change: the deletion of a folder becomes that of the known paths (path) below it."""
    from ..operators.relational import prefixes

    folders = changes.filter(F.col("change") == S.DELETED_PARENT).select("seq", F.col("path").alias("folder"))
    below = known.select("path", F.explode(prefixes(F.col("path"))).alias("folder")).join(folders, "folder").select("seq", "path", F.lit(S.DELETED).alias("change"))
    return changes.filter(F.col("change") != S.DELETED_PARENT).select("seq", "path", "change").unionByName(below)


def net_changes(changes: DataFrame) -> DataFrame:
    """path, change: the last event of each path; a maximum, so it is combined before the shuffle."""
    return changes.groupBy("path").agg(F.max_by("change", "seq").alias("change"))


def relevant_net(g: Frames, patterns: DataFrame) -> DataFrame:
    """path, change: the last event of each path that matters, of the frames' changes. Those seen while building are replayed before
    the others and judged more strictly; patterns as for `relevant_changes`."""
    from ..operators.relational import relevant_changes

    matter = relevant_changes(g, patterns).filter("relevant").select("path", "during_build")
    kept = g.change.join(matter, ["path", "during_build"], "left_semi")
    return kept.groupBy("path").agg(F.max_by("change", F.struct(~F.col("during_build"), F.col("seq"))).alias("change"))


def unchanged_dropped(net: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """net without updates of paths whose digest is the same; old and new have path, digest."""
    same = old.join(new.select("path", F.col("digest").alias("d")), "path").filter(F.col("digest") == F.col("d")).select("path")
    kept = net.filter(F.col("change") == S.UPDATED).join(same, "path", "left_anti")
    return kept.unionByName(net.filter(F.col("change") != S.UPDATED))


def first_jobs(jobs: DataFrame) -> DataFrame:
    """path, seq: of the jobs in flight for a path, the first submitted."""
    return jobs.groupBy("path").agg(F.min("seq").alias("seq"))


def glob_effect(deleted: DataFrame, added: DataFrame, matched: DataFrame) -> DataFrame:
    """path, effect on a pattern's matches (path); a path in both deleted and added ends up deleted."""
    gone = matched.join(deleted, "path", "left_semi").select("path", F.lit("deleted").alias("effect"))
    new = added.join(deleted, "path", "left_anti").join(matched, "path", "left_anti").select("path", F.lit("added").alias("effect"))
    return gone.unionByName(new).distinct()


def watch(changes: DataFrame, g: Frames, sink: Callable[[DataFrame, int], None], checkpoint: str, patterns: DataFrame | None = None, wait: str | None = None):
    """Start a query that hands each batch's net changes to sink; a later batch's event for a path replaces an earlier one's.

    With patterns only what matters is handed on. `wait` ('500 milliseconds') gathers events for that long and goes on until it is
    stopped; without it the query ends with what is there.
    """
    known = g.node.filter("kind = 'file' AND NOT detached").select(F.col("label").alias("path"))

    def batch(df: DataFrame, n: int) -> None:
        if patterns is None:
            sink(net_changes(expanded(df, known)), n)
            return
        one = expanded(df, known).join(df.select("seq", "during_build"), "seq").select("seq", "path", "change", "during_build")
        sink(relevant_net(g.with_(change=one), patterns), n)

    trigger = {"processingTime": wait} if wait else {"availableNow": True}
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
