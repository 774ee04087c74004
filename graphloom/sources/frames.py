"""The frames that operators work on, and readers and writers for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Frame schemas. The columns of the log frames are those of the log files.
SCHEMAS = {
    "node": "i BIGINT, kind STRING, label STRING, creator BIGINT, detached BOOLEAN",
    "dependency": "i BIGINT, source BIGINT, sink BIGINT, dynamic BOOLEAN",
    "file": "node BIGINT, state INT, digest STRING",
    "step": "node BIGINT, state INT, need INT, duration BIGINT, deferred BOOLEAN, defer_count INT, holding INT, has_hash BOOLEAN",
    "step_resource": "node BIGINT, name STRING, units INT",
    "available_resource": "name STRING, units INT",
    "env_var": "node BIGINT, name STRING, value STRING, dynamic BOOLEAN",
    "target_path": "path STRING",
    "target_dir": "path STRING, upper STRING",
    "path": "path STRING, digest STRING",
    "nglob": "i BIGINT, node BIGINT, pattern STRING",
    "nglob_match": "nglob BIGINT, path STRING",
    "joblog": "time_ns BIGINT, job_i BIGINT, event STRING, description STRING",
    "sqllog": "transaction_i BIGINT, execute_i BIGINT, query_i BIGINT, start_ns BIGINT, duration_ns BIGINT, nrecords BIGINT",
    "sqllog_index": "query STRING, module_name STRING, line INT, plan STRING, query_i BIGINT",
    "change": "seq BIGINT, path STRING, change INT, during_build BOOLEAN",
}
STEPINFO = "command STRING, inp ARRAY<STRING>, env ARRAY<STRING>, out ARRAY<STRING>, vol ARRAY<STRING>, workdir STRING"


@dataclass
class Frames:
    """The graph and what hangs on it; attributes are named as in SCHEMAS."""

    node: DataFrame
    dependency: DataFrame
    file: DataFrame
    step: DataFrame
    step_resource: DataFrame
    available_resource: DataFrame
    env_var: DataFrame
    target_path: DataFrame
    target_dir: DataFrame
    path: DataFrame
    nglob: DataFrame
    nglob_match: DataFrame
    joblog: DataFrame
    sqllog: DataFrame
    sqllog_index: DataFrame
    change: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.node.sparkSession

    def with_(self, **frames: DataFrame) -> Frames:
        return Frames(**{**self.__dict__, **frames})


def read_joblog(spark: SparkSession, path: str) -> DataFrame:
    """Job lifecycle events from CSV without a header."""
    return spark.read.schema(SCHEMAS["joblog"]).csv(path)


def write_joblog(df: DataFrame, path: str) -> None:
    df.select("time_ns", "job_i", "event", "description").write.csv(path)


def write_sqllog(df: DataFrame, path: str) -> None:
    df.select("transaction_i", "execute_i", "query_i", "start_ns", "duration_ns", "nrecords").write.csv(path)


def write_sqllog_index(df: DataFrame, path: str) -> None:
    df.select("query", "module_name", "line", "plan", "query_i").write.json(path)


def read_sqllog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["sqllog"]).csv(path)


def read_sqllog_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["sqllog_index"]).json(path)


def read_stepinfo(spark: SparkSession, path: str) -> DataFrame:
    """Step descriptions from JSON files that hold one object or an array of them."""
    return spark.read.schema(STEPINFO).json(path, multiLine=True)


def write_stepinfo(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_variables(df: DataFrame, path: str) -> None:
    """name, value (JSON text) as one JSON object; variables are few, so they meet in one task."""
    from pyspark.sql import functions as F

    one = df.select("name", F.coalesce("value", F.lit("null")).alias("value")).groupBy().agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("all"))
    pair = lambda x: F.concat(F.regexp_extract(F.to_json(F.struct(x["name"].alias("n"))), r"^\{\"n\":(.*)\}$", 1), F.lit(": "), x["value"])
    one.select(F.concat(F.lit("{"), F.array_join(F.transform("all", pair), ", "), F.lit("}")).alias("value")).coalesce(1).write.text(path)


def read_variables(spark: SparkSession, *paths: str) -> DataFrame:
    """name, value (JSON text) of JSON objects; of equal names, the later path wins."""
    from pyspark.sql import functions as F

    df = None
    for k, p in enumerate(paths):
        one = spark.read.text(p, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("name", "value"), F.lit(k).alias("k"))
        df = one if df is None else df.unionByName(one)
    return df.groupBy("name").agg(F.max_by("value", "k").alias("value"))


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Frames stored as Parquet folders, by name."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}


def write_graph(g: Frames, path: str) -> None:
    for name in SCHEMAS:
        getattr(g, name).write.parquet(f"{path}/{name}")


def list_paths(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, modified of all files below a folder, hidden ones included, without reading them, and of the folders that hold
    them, whose paths end in '/' and whose size and time are null."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).selectExpr("path", "length AS size", "modificationTime AS modified")
    parts = F.split("path", "/")
    depth = len(folder.rstrip("/").split("://")[-1].lstrip("/").split("/"))
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    dirs = files.select(F.explode(above).alias("path"), F.size(parts).alias("n")).select("path").distinct()
    inside = F.size(F.array_remove(F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/"), "")) > depth
    dirs = dirs.filter(inside).join(files.select("path").withColumn("path", F.concat("path", F.lit("/"))), "path", "left_anti")
    return files.unionByName(dirs.select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified")))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, digest (SHA-256 in hexadecimal), size of all files below a folder; a task reads a file at a time."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))
