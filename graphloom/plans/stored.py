"""Materialised intermediate frames in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        found = _OWN[app]
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read again: the lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """`stored`, in as many buckets of key as a shuffle has partitions: joins on key don't shuffle these rows again.

    Buckets need a table while they are written and read first; it is dropped at once, and its files stay.
    """
    spark = df.sparkSession
    name = f"graphloom_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.option("path", f"{shared_dir(spark)}/graphloom/{name}").bucketBy(parts, key).sortBy(key).saveAsTable(name, format="parquet")
    out = spark.table(name).select(df.columns)
    spark.sql(f"DROP TABLE {name}")
    return out


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder; for when no result is read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom")
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
