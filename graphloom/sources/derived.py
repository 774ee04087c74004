"""A dependency graph derived from the star-schema tables, in SQL that both Spark and DuckDB read.

Node ids are key * 10 + tag: 1 root, 2 region, 3 nation, 4 customer, 5 order (all steps), 6 supplier (a static tree), 7 part,
8 and 9 an order's output and log (files). Braces name the tables and the frames made before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import SCHEMAS, Frames

#: Parts of the matches of patterns that start with one folder.
MATCH_PARTS = 64
_PLANNED: dict[tuple[str, str], tuple[tuple, Frames]] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: Frames in the order in which they build on each other.
FRAMES = {
    "node": """
        SELECT CAST(1 AS BIGINT) AS i, 'root' AS kind, '' AS label, CAST(1 AS BIGINT) AS creator, false AS detached
        UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 10 + 2, 'step', 'region ' || r_name, CAST(1 AS BIGINT), false FROM {region}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 3, 'step', 'nation ' || n_name, CAST(n_regionkey AS BIGINT) * 10 + 2, false FROM {nation}
        UNION ALL SELECT c_custkey * 10 + 4, 'step', 'customer ' || CAST(c_custkey AS STRING),
            CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) * 10 + 3 END, c_custkey % 29 = 0 FROM {customer}
        UNION ALL SELECT o_orderkey * 10 + 5, 'step', 'order ' || CAST(o_orderkey AS STRING), o_custkey * 10 + 4, o_custkey % 29 = 0 FROM {orders}
        UNION ALL SELECT s_suppkey * 10 + 6, 'st', 'supplier/' || CAST(s_suppkey AS STRING) || '/', CAST(s_nationkey AS BIGINT) * 10 + 3, false FROM {supplier}
        UNION ALL SELECT p_partkey * 10 + 7, 'file', 'supplier/' || CAST(p_partkey % n AS STRING) || '/' || CAST(p_partkey AS STRING) || '.dat',
            CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE (p_partkey % n) * 10 + 6 END, p_partkey % 43 = 0
            FROM {part}, (SELECT count(*) AS n FROM {supplier}) AS s
        UNION ALL SELECT o_orderkey * 10 + 8, 'file', 'out/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.txt',
            o_orderkey * 10 + 5, o_custkey % 29 = 0 FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 9, 'file', 'vol/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.log',
            o_orderkey * 10 + 5, o_custkey % 29 = 0 FROM {orders} WHERE o_orderkey % 5 = 0""",
    "dependency": """
        SELECT source * 1000000000 + sink AS i, source, sink, sink % 10 = 5 AND (source + sink) % 6 = 0 AS dynamic FROM (
            SELECT DISTINCT l_partkey * 10 + 7 AS source, l_orderkey * 10 + 5 AS sink FROM {lineitem}
            UNION ALL SELECT before * 10 + 8, o_orderkey * 10 + 5 FROM (
                SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM {orders}) AS c
                WHERE before IS NOT NULL
            UNION ALL SELECT o_orderkey * 10 + 5, o_orderkey * 10 + 8 FROM {orders}
            UNION ALL SELECT o_orderkey * 10 + 5, o_orderkey * 10 + 9 FROM {orders} WHERE o_orderkey % 5 = 0
            UNION ALL SELECT (p_partkey % n) * 10 + 6, p_partkey * 10 + 7
                FROM {part}, (SELECT count(*) AS n FROM {supplier}) AS s WHERE p_partkey % 43 <> 0) AS e""",
    "step": """
        SELECT CAST(r_regionkey AS BIGINT) * 10 + 2 AS node, 23 AS state, 34 AS need, CAST(0 AS BIGINT) AS duration, false AS deferred, 0 AS defer_count, 0 AS holding, false AS has_hash FROM {region}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 3, 23, 34, CAST(0 AS BIGINT), false, 0, 0, false FROM {nation}
        UNION ALL SELECT c_custkey * 10 + 4, CASE WHEN c_custkey % 31 = 0 THEN 24 WHEN c_custkey % 37 = 0 THEN 21 WHEN c_custkey % 41 = 0 THEN 22 ELSE 23 END,
            34, CAST(0 AS BIGINT), false, 0, CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 37 <> 0 AND c_custkey % 41 = 0 THEN 1 ELSE 0 END, false FROM {customer}
        UNION ALL SELECT o_orderkey * 10 + 5, state, CASE WHEN o_orderpriority LIKE '1%' THEN 34 WHEN o_orderpriority LIKE '5%' THEN 31 ELSE 32 END,
            CAST(floor(o_totalprice) AS BIGINT), state = 21 AND o_orderkey % 97 = 0, CAST(o_orderkey % 4 AS INT), 0, state = 23 OR o_orderkey % 3 = 0 FROM (
            SELECT *, CASE WHEN o_orderstatus = 'F' THEN 23 WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 24
                WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 1 THEN 22 ELSE 21 END AS state FROM {orders}) AS o""",
    "file": """
        SELECT i AS node, CASE WHEN tag = 7 THEN CASE WHEN detached THEN 11 WHEN own % 40 = 0 THEN 13 WHEN own % 41 = 0 THEN 12 ELSE 14 END
            WHEN tag = 9 THEN 18 WHEN state = 23 THEN 16 WHEN state = 24 THEN 17 ELSE 15 END AS state,
            CASE WHEN tag = 7 AND (detached OR own % 40 = 0 OR own % 41 = 0) THEN NULL WHEN tag = 8 AND state NOT IN (23, 24) THEN NULL ELSE md5(label) END AS digest
        FROM (SELECT n.i, n.label, n.detached, n.i % 10 AS tag, (n.i - n.i % 10) / 10 AS own, s.state
            FROM {node} AS n LEFT JOIN {step} AS s ON s.node = n.creator WHERE n.kind = 'file') AS f""",
    "step_resource": """
        SELECT o_orderkey * 10 + 5 AS node, CASE o_orderkey % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu' ELSE 'lic' END AS name,
            CAST(1 + o_orderkey % 5 AS INT) AS units FROM {orders} WHERE o_orderkey % 4 = 0""",
    "available_resource": "SELECT 'cpu' AS name, 8 AS units UNION ALL SELECT 'gpu', 3",
    "env_var": """
        SELECT o_orderkey * 10 + 5 AS node, 'VAR' || CAST(o_orderkey % 11 AS STRING) AS name,
            CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS STRING) END AS value, o_orderkey % 2 = 0 AS dynamic
        FROM {orders} WHERE o_orderkey % 3 = 0""",
    "target_path": "SELECT label AS path FROM {node} WHERE kind = 'file' AND i % 500 = 8",
    "target_dir": """
        SELECT 'out/' || CAST(c_custkey AS STRING) || '/' AS path, 'out/' || CAST(c_custkey AS STRING) || '0' AS upper
        FROM {customer} WHERE c_custkey % 50 = 7""",
    "path": "SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, md5(text) AS digest FROM {documents}",
    "nglob": """
        SELECT c_custkey * 10 + 1 AS i, c_custkey * 10 + 4 AS node, 'out/' || CAST(c_custkey AS STRING) || '/**' AS pattern FROM {customer} WHERE c_custkey % 7 = 3
        UNION ALL SELECT c_custkey * 10 + 2, c_custkey * 10 + 4, 'supplier/' || CAST(c_custkey % n AS STRING) || '/*' FROM {customer}, (SELECT count(*) AS n FROM {supplier}) AS s WHERE c_custkey % 11 = 5
        UNION ALL SELECT c_custkey * 10 + 3, c_custkey * 10 + 4, 'src' || CAST(c_custkey % 5 AS STRING) || '/**/*.txt' FROM {customer} WHERE c_custkey % 50 = 1""",
    "nglob_match": """
        SELECT o_custkey * 10 + 1 AS nglob, 'out/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.txt' AS path FROM {orders} WHERE o_custkey % 7 = 3
        UNION ALL SELECT c_custkey * 10 + 1, 'out/' || CAST(c_custkey AS STRING) || '/' FROM {customer} WHERE c_custkey % 7 = 3
        UNION ALL SELECT g.i, n.label FROM {nglob} AS g JOIN (
            SELECT label, substr(label, 1, length(label) - length(regexp_extract(label, '[^/]*$', 0))) || '*' AS pattern FROM {node} WHERE kind = 'file') AS n ON n.pattern = g.pattern
        UNION ALL SELECT i, substr(pattern, 1, length(pattern) - 1) FROM {nglob} WHERE pattern LIKE 'supplier/%'
        UNION ALL SELECT i, 'supplier/' FROM {nglob} WHERE pattern LIKE 'supplier/%' AND i % 4 = 2
        UNION ALL SELECT g.i, p.path FROM {nglob} AS g JOIN {path} AS p ON g.pattern = substr(p.path, 1, length(regexp_extract(p.path, '^[^/]*', 0))) || '/**/*.txt'""",
    "joblog": """
        SELECT time_ns, job_i, event, description FROM (
            SELECT event_id * 1000000 AS time_ns, event_id AS job_i, 'START' AS event, event_type AS description FROM {events}
            UNION ALL SELECT after * 1000000, event_id, 'END', event_type FROM (
                SELECT event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM {events}) AS l
                WHERE after IS NOT NULL) AS j""",
    "sqllog": """
        SELECT user_id AS transaction_i, event_id AS execute_i, event_id % 23 AS query_i, event_id * 1000 AS start_ns,
            CAST(floor(value * 1000) AS BIGINT) AS duration_ns, event_id % 5 AS nrecords FROM {events}""",
    "sqllog_index": """
        SELECT 'query ' || CAST(q AS STRING) AS query, 'module' || CAST(q % 4 AS STRING) AS module_name, CAST(q * 10 AS INT) AS line,
            CASE q % 5 WHEN 0 THEN 'SCAN node' WHEN 1 THEN 'SEARCH node USING INDEX x' WHEN 2 THEN 'SCAN step;USE TEMP B-TREE FOR ORDER BY'
                WHEN 3 THEN 'SEARCH a USING AUTOMATIC COVERING INDEX (i=?);CORRELATED SCALAR SUBQUERY 1' ELSE 'SCAN node USING COVERING INDEX y' END AS plan,
            q AS query_i FROM (SELECT DISTINCT event_id % 23 AS q FROM {events}) AS e""",
    "change": """
        SELECT e.event_id AS seq, n.label AS path, CASE WHEN e.event_type = 'error' THEN 42 ELSE 41 END AS change, e.event_id % 3 = 0 AS during_build
        FROM {events} AS e JOIN {node} AS n ON n.i = (e.event_id % 200) * 10 + 7""",
}


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    """The frames over a folder of Parquet tables; none is read before an action. The latest plans of a session and folder are
    kept as long as the tables' files stay as they are."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in TABLES]).select("path", "length", "modificationTime")
    state = tuple(sorted((r.path, r.length, r.modificationTime) for r in files.collect()))  # a row per file of ten tables
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANNED or _PLANNED[key][0] != state:
        _PLANNED[key] = state, _planned(spark, sf_dir)
    return _PLANNED[key][1]


def _planned(spark: SparkSession, sf_dir: str) -> Frames:
    known: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, sql in FRAMES.items():
        used = {k: v for k, v in known.items() if f"{{{k}}}" in sql}
        if name == "nglob_match":
            known[name] = _matches(spark, sql, used)
        else:
            known[name] = spark.sql(sql, **used)
    return Frames(**{name: known[name] for name in SCHEMAS})


def _matches(spark: SparkSession, sql: str, used: dict[str, DataFrame]) -> DataFrame:
    """nglob_match; its last part joins on the few folders that the patterns start with, so a folder's paths are dealt out over
    MATCH_PARTS tasks, each of which meets all of its patterns."""
    rest, last = sql.rsplit("UNION ALL", 1)
    g = used["nglob"].filter("pattern LIKE '%/**/*.txt'").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(MATCH_PARTS - 1)))).repartition(MATCH_PARTS, "part")
    p = used["path"].select("path", F.pmod(F.xxhash64("path"), F.lit(MATCH_PARTS)).cast("int").alias("part")).repartition(MATCH_PARTS, "part")
    return spark.sql(rest, **used).unionAll(spark.sql(f"{last} AND g.part = p.part", nglob=g, path=p))


def prelude() -> str:
    """The same frames as common table expressions."""
    names = {n: n for n in (*TABLES, *FRAMES)}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql.format(**names)})" for name, sql in FRAMES.items())
