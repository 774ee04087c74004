"""Shared plumbing: inputs, the shared folder, materialised stages, Arrow batches, joins on keys that may be hot."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import on_workers_path
from ..plans.stored import shared_dir

#: Rows and bytes of an Arrow batch sent to Python; they bound a worker's memory when texts are very long.
BATCH_ROWS = 1000
BATCH_BYTES = 16_000_000
#: Rows up to which a key table counted beforehand may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Rows of one key up to which they may meet in one task.
HOT_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder once and read it again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete what `written` gave, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/graphloom/" in f}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def in_batches(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the workers' path where they share the driver's disk. A session that asks for
    smaller batches keeps them; the settings last, as they are read when a query starts."""
    on_workers_path(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not 0 < int(now or 0) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def keyed(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most `bound` rows, as counted; beyond that it is shuffled."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def join_known(rows: DataFrame, known: DataFrame, on: list[str], count: str, spread: Column, bound: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the columns of known, null where it lacks the key; known has one row a key and, in `count`, how many rows have it.

    A known of at most `bound` rows, as counted, is broadcast. Otherwise its hot keys are, of which there is at most one for
    `hot_rows` rows; rows that found theirs are spread by `spread`, so that no key gathers more than hot_rows rows in a task.
    """
    cols = [c for c in known.columns if c not in on and c != count]
    if known.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(known.drop(count)), on, "left").select(*rows.columns, *cols)
    hot = keyed(known.filter(F.col(count) > hot_rows).select(*on, F.struct(*cols).alias("_gl_hot")), bound)
    cold = known.filter(F.col(count) <= hot_rows).select(*on, F.lit(0).cast("long").alias("_gl_spread"), F.struct(*cols).alias("_gl_cold"))
    df = rows.join(hot, on, "left").withColumn("_gl_spread", F.when(F.col("_gl_hot").isNull(), F.lit(0)).otherwise(F.xxhash64(spread)))
    found = F.coalesce("_gl_hot", "_gl_cold")
    return df.join(cold, [*on, "_gl_spread"], "left").select(*rows.columns, *(found[c].alias(c) for c in cols))
