"""Queries over the derived graph, each with the SQL that DuckDB answers it with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import states as S
from .functions import text as T
from .functions.patterns import Pattern
from .functions.registry import Calls, Kinds, over_cases
from .operators import aggregates as A
from .operators import changes as C
from .operators import checks as K
from .operators import logs as L
from .operators import pending as P
from .operators import recursive as G
from .operators import relational as R
from .operators import scheduling as D
from .plans.stored import shared_dir
from .sources.derived import frames, prelude
from .sources.frames import Frames, read_graph, read_joblog, read_sqllog, read_sqllog_index, write_graph, write_joblog, write_sqllog, write_sqllog_index

QUERIES: dict[str, Callable[[Frames], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[Frames], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(frames(spark, sf_dir))) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Each query's SQL after the frames; what starts with WITH adds common table expressions."""
    return {name: f"{prelude()}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"{prelude()} {sql}" for name, sql in ORACLES.items()}


def seeds(g: Frames, condition: str) -> DataFrame:
    return g.node.filter(condition).select("i")


def changed(g: Frames) -> DataFrame:
    """i of the files that the change stream names."""
    return R.nodes(g, "file", include_detached=True).join(g.change.select("path"), F.col("label") == F.col("path"), "left_semi").select("i")


CHANGED = "SELECT i FROM node WHERE kind = 'file' AND label IN (SELECT path FROM change)"


# Scans

add("src_nodes", lambda g: R.nodes(g, "file"), "SELECT * FROM node WHERE kind = 'file' AND NOT detached")
add("src_find", lambda g: R.find(g, "step", "order 7"), "SELECT * FROM node WHERE kind = 'step' AND label = 'order 7'")
add("src_batch", lambda g: R.file_hashes(g, g.target_path), "SELECT label, state, digest FROM node JOIN file ON i = node WHERE kind = 'file' AND NOT detached AND label IN (SELECT path FROM target_path)")
add("src_idlist", lambda g: R.hashes_to_check(g, changed(g)), f"SELECT f.node, n.label, f.digest FROM file f JOIN node n ON n.i = f.node WHERE f.node IN ({CHANGED})")


def _through_files(g: Frames, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], df: DataFrame) -> DataFrame:
    """df, written in its file format and read again."""
    path = f"{shared_dir(g.spark)}/graphloom/{uuid.uuid4().hex}"
    write(df, path)
    return read(g.spark, path)


def _sqllog(g: Frames) -> DataFrame:
    log = _through_files(g, write_sqllog, read_sqllog, g.sqllog)
    return L.with_index(g.with_(sqllog=log, sqllog_index=_through_files(g, write_sqllog_index, read_sqllog_index, g.sqllog_index)))


def _database(g: Frames) -> DataFrame:
    path = f"{shared_dir(g.spark)}/graphloom/{uuid.uuid4().hex}"
    write_graph(g, path)
    return A.totals(g.with_(**read_graph(g.spark, path)))


add("src_joblog", lambda g: _through_files(g, write_joblog, read_joblog, g.joblog), "SELECT * FROM joblog")
add("src_sqllog", _sqllog, "SELECT s.*, x.query, x.module_name, x.line, x.plan FROM sqllog s LEFT JOIN sqllog_index x ON x.query_i = s.query_i")
TOTALS = "SELECT 'node' AS frame, count(*) AS n FROM node UNION ALL SELECT 'dependency', count(*) FROM dependency UNION ALL SELECT 'file', count(*) FROM file UNION ALL SELECT 'step', count(*) FROM step UNION ALL SELECT 'step_resource', count(*) FROM step_resource UNION ALL SELECT 'env_var', count(*) FROM env_var"
add("src_db", _database, TOTALS)
KEY = "CASE WHEN {0}.detached THEN '(' || {0}.kind || ':' || {0}.label || ')' ELSE {0}.kind || ':' || {0}.label END"
add(
    "snk_text",
    R.graph_text,
    f"""WITH k AS (SELECT n.i, {KEY.format("n")} AS key FROM node n),
    ins AS (SELECT sink AS i, string_agg(key, ' ' ORDER BY key) AS t FROM dependency JOIN k ON k.i = source GROUP BY sink),
    outs AS (SELECT source AS i, string_agg(key, ' ' ORDER BY key) AS t FROM dependency JOIN k ON k.i = sink GROUP BY source)
    SELECT k.key || ' <- ' || coalesce(ins.t, '') || ' -> ' || coalesce(outs.t, '') AS line FROM k LEFT JOIN ins ON ins.i = k.i LEFT JOIN outs ON outs.i = k.i""",
)
add(
    "snk_dot_prov",
    R.dot_provenance,
    """SELECT i || ' [label="' || label || '" shape=' || CASE kind WHEN 'file' THEN 'ellipse' WHEN 'step' THEN 'box' ELSE 'octagon' END || ']' AS line FROM node
    UNION ALL SELECT creator || ' -> ' || i FROM node WHERE creator <> i""",
)
add(
    "snk_dot_dep",
    R.dot_dependency,
    """SELECT source || ' -> ' || sink AS line FROM dependency d JOIN node a ON a.i = source JOIN node b ON b.i = sink
    WHERE NOT (a.kind = 'file' AND a.label LIKE '%/') AND NOT (b.kind = 'file' AND b.label LIKE '%/')""",
)

# Projections and filters

add("flt_state", lambda g: R.steps_in(g, S.PENDING, S.RUNNING), "SELECT i, label, s.state FROM node JOIN step s ON s.node = i WHERE NOT detached AND s.state IN (21, 22)")
OUT = "(SELECT d.source AS step, d.sink AS file, n.label, f.state, n.detached FROM dependency d JOIN step s ON s.node = d.source JOIN file f ON f.node = d.sink JOIN node n ON n.i = d.sink)"
INP = "(SELECT d.sink AS step, d.source AS file, n.label, f.state, f.digest, n.detached, d.dynamic FROM dependency d JOIN step s ON s.node = d.sink JOIN file f ON f.node = d.source JOIN node n ON n.i = d.source)"
BLOCKS = "(state = 18 OR (dynamic AND NOT detached AND state IN (15, 17)) OR (NOT dynamic AND (detached OR state NOT IN (14, 16))))"
add("flt_regular_output", R.regular_outputs, f"SELECT * FROM {OUT} o WHERE NOT detached AND state <> 18")
add("flt_unavailable_input", R.unavailable_inputs, f"SELECT * FROM {INP} x WHERE {BLOCKS}")
add("flt_prefix_like", lambda g: g.node.filter(S.like_prefix(F.col("label"), "OUT/1")).select("i", "label"), "SELECT i, label FROM node WHERE starts_with(translate(label, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'out/1')")
add("flt_prefix_range", lambda g: g.node.filter(S.in_range(F.col("label"), F.lit("supplier/1/"), F.lit(S.upper_bound("supplier/1/")))).select("i", "label"), "SELECT i, label FROM node WHERE label >= 'supplier/1/' AND label < 'supplier/10'")
STATE = "SELECT n.i, n.kind, n.label, CASE n.kind WHEN 'file' THEN f.state WHEN 'step' THEN s.state END AS state FROM node n LEFT JOIN file f ON f.node = n.i LEFT JOIN step s ON s.node = n.i"
add("flt_glob", lambda g: R.search(g, "7[0-3]?.t"), f"{STATE} WHERE n.label GLOB '*7[0-3]?.t*'")
add("prj_case_state", R.with_state, STATE)
add(
    "prj_key",
    R.dependency_keys,
    f"SELECT d.i, {KEY.format('a')} || ' -> ' || {KEY.format('b')} || CASE WHEN d.dynamic THEN ' [dynamic]' ELSE '' END AS edge FROM dependency d JOIN node a ON a.i = d.source JOIN node b ON b.i = d.sink",
)


def _commands(g: Frames) -> DataFrame:
    label = F.when(F.col("i") % 3 == 0, F.concat("label", F.lit("  # wd=sub/"), (F.col("i") % 7).cast("string"))).otherwise(F.col("label"))
    command, folder = R.command_of(F.col("label"))
    return g.node.filter("kind = 'step'").select("i", label.alias("label")).select("i", command.alias("command"), folder.alias("workdir"))


add("prj_command", _commands, "SELECT i, label AS command, CASE WHEN i % 3 = 0 THEN 'sub/' || (i % 7) ELSE './' END AS workdir FROM node WHERE kind = 'step'")
CURRENT = "SELECT 'VAR' || CAST(id AS STRING) AS name, CASE WHEN id % 4 = 3 THEN NULL ELSE CAST(id % 5 AS STRING) END AS value FROM range(0, 9)"
add(
    "flt_env_changed",
    lambda g: R.env_changed(g, g.spark.sql(CURRENT)),
    f"WITH cur AS ({CURRENT.replace('FROM range(0, 9)', 'FROM range(0, 9) AS r(id)')}) SELECT e.node, e.name, e.value, c.value AS now FROM env_var e LEFT JOIN cur c ON c.name = e.name WHERE e.value IS DISTINCT FROM c.value",
)
add("flt_rescan", R.files_to_rescan, "SELECT i, label, state, CASE WHEN state = 12 THEN 'CONFIRMED' ELSE 'EXTERNAL' END AS cause FROM node JOIN file ON node = i WHERE NOT detached AND state NOT IN (15, 18)")
PATTERNS = [("supplier/1*/*.dat",), ("supplier/2?/${*part}.dat",), ("**/9*.dat",)]


def _patterns(g: Frames, patterns: list[tuple[str]]) -> DataFrame:
    return g.spark.createDataFrame([(Pattern(p).regex(), Pattern(p).base()) for (p,) in patterns], "regex string, base string")


add(
    "flt_relevant",
    lambda g: R.relevant_changes(g, _patterns(g, PATTERNS)),
    """WITH p AS (SELECT DISTINCT path, during_build FROM change), f AS (SELECT label AS path, state FROM node JOIN file ON node = i WHERE NOT detached)
    SELECT p.path, p.during_build, CASE WHEN state IS NULL THEN regexp_full_match(p.path, 'supplier/1[^/]*/[^/]*\\.dat|supplier/2[^/]/[^/]+\\.dat|(.*/|)9[^/]*\\.dat')
        WHEN during_build THEN state IN (13, 14) ELSE state NOT IN (15, 18) END AS relevant FROM p LEFT JOIN f ON f.path = p.path""",
)
FOLDERS = ("supplier/3/", "out/10", "src1/", "OUT/")


def _below(g: Frames) -> DataFrame:
    matched = R.matched_paths(g)
    parts = [R.paths_below(g, f, building, matched).select(F.lit(f).alias("folder"), F.lit(building).alias("building"), "path") for f in FOLDERS for building in (False, True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


add(
    "flt_relevant_under",
    _below,
    f"""WITH d AS (SELECT folder, building, CASE WHEN folder LIKE '%/' THEN folder ELSE folder || '/' END AS dir FROM (VALUES {", ".join(f"('{f}')" for f in FOLDERS)}) a(folder), (VALUES (false), (true)) b(building))
    SELECT folder, building, n.label AS path FROM d JOIN node n ON starts_with(lower(n.label), lower(dir)) AND n.kind = 'file' AND NOT n.detached JOIN file f ON f.node = n.i AND CASE WHEN building THEN f.state IN (13, 14) ELSE f.state NOT IN (15, 18) END
    UNION SELECT folder, building, m.path FROM d JOIN nglob_match m ON starts_with(m.path, dir) JOIN nglob g ON g.i = m.nglob JOIN node s ON s.i = g.node AND NOT s.detached""",
)
add(
    "flt_watch_dirs",
    R.watch_dirs,
    """SELECT DISTINCT CASE WHEN regexp_extract(label, '^(.*/)', 1) = '' THEN './' ELSE regexp_extract(label, '^(.*/)', 1) END AS dir
    FROM node JOIN file ON node = i WHERE NOT detached AND state <> 18 UNION SELECT label FROM node WHERE kind = 'st' AND NOT detached""",
)

# Joins

add("jn_sources", lambda g: R.neighbours(g, "source", "file"), "SELECT d.sink AS of, n.i, n.kind, n.label FROM dependency d JOIN node n ON n.i = d.source WHERE n.kind = 'file' AND NOT n.detached")
add("jn_sinks", lambda g: R.neighbours(g, "sink", include_detached=True), "SELECT d.source AS of, n.i, n.kind, n.label FROM dependency d JOIN node n ON n.i = d.sink")
add("jn_products", R.products, "SELECT creator AS of, i, kind, label FROM node WHERE creator <> i")
add("jn_creator", R.with_creator, "SELECT n.i, n.label, c.kind AS creator_kind, c.label AS creator_label FROM node n LEFT JOIN node c ON c.i = n.creator")
add("jn_step_inputs", R.inputs_of, f"SELECT * FROM {INP} x")
add("jn_step_paths", lambda g: R.step_paths(g, "inp", dynamic=True, states=(S.CONFIRMED, S.BUILT)), f"SELECT step, label, state FROM {INP} x WHERE dynamic AND state IN (14, 16) AND NOT detached")
add("jn_unconfirmed", R.unconfirmed_inputs, f"SELECT x.step, x.file, x.label FROM {INP} x JOIN node n ON n.i = x.file JOIN node c ON c.i = n.creator WHERE x.state = 12 AND c.kind = 'st'")
TWO = "SELECT DISTINCT a.source AS before, b.sink AS step FROM dependency a JOIN dependency b ON b.source = a.sink WHERE a.source IN (SELECT node FROM step) AND b.sink IN (SELECT node FROM step)"
add("jn_two_hop", R.source_steps, TWO)
add("jn_semi_ready", R.ready_steps, f"SELECT node, node NOT IN (SELECT step FROM {INP} x WHERE {BLOCKS}) AS ready FROM step")
add("jn_target_range", R.targets_in_dirs, f"SELECT t.path AS dir, o.file, o.label FROM {OUT} o JOIN target_dir t ON o.label >= t.path AND o.label < t.upper WHERE NOT o.detached AND o.state <> 18")
add("jn_owner_prefix", lambda g: R.owning_trees(g, g.node.filter("kind = 'file'").select(F.col("label").alias("path"))), "SELECT f.label AS path, t.i AS tree FROM node f JOIN node t ON t.kind = 'st' AND NOT t.detached AND starts_with(f.label, t.label) WHERE f.kind = 'file'")
add("jn_glob_x_path", lambda g: g.path.filter(Pattern("src${*n}/${*lang}/*[05].txt").matches(F.col("path"))).select("path"), "SELECT path FROM path WHERE regexp_full_match(path, 'src[^/]*/[^/]+/[^/]*[05]\\.txt')")
add("jn_claim", R.claims, "SELECT label, creator, CASE WHEN state IN (15, 16, 17) THEN 'OUTPUT' WHEN state = 18 THEN 'VOLATILE' ELSE 'STATIC' END AS role FROM node JOIN file ON node = i WHERE NOT detached")
SHORT = "SELECT r.name, r.node, r.units, a.units AS available FROM step_resource r LEFT JOIN available_resource a ON a.name = r.name WHERE a.units IS NULL OR a.units < r.units"
add("jn_resource_left", R.short_resources, SHORT)
add("jn_log_index", lambda g: L.with_index(g).groupBy("module_name").agg(F.sum("nrecords").alias("n")), "SELECT module_name, CAST(sum(nrecords) AS BIGINT) AS n FROM sqllog s LEFT JOIN sqllog_index x ON x.query_i = s.query_i GROUP BY 1")
add("jn_semi_batch", lambda g: g.path.join(g.path.filter("digest < '8'").select("path"), "path", "left_semi").select("path"), "SELECT path FROM path WHERE digest < '8'")
SPANS = "(SELECT job_i, description, max(CASE WHEN event = 'START' THEN time_ns END) AS start, max(CASE WHEN event = 'END' THEN time_ns END) AS stop FROM joblog GROUP BY 1, 2)"


def _pairs(g: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each job as the producer of the first, tenth and thousandth one after it, and the jobs' times."""
    t = R.job_spans(g).withColumnRenamed("job_i", "job")
    pairs = t.select(F.col("job").alias("producer"), F.explode(F.array(F.col("job") + 1, F.col("job") + 10, F.col("job") + 1000)).alias("consumer"))
    return pairs, t.select("job", "start"), t.select("job", "stop")


add(
    "jn_concurrent",
    lambda g: R.concurrent(*_pairs(g)),
    f"""WITH s AS {SPANS}, p AS (SELECT job_i AS producer, job_i + unnest([1, 10, 1000]) AS consumer FROM s)
    SELECT producer, consumer, coalesce(c.start <= a.stop, false) AS overlapped FROM p LEFT JOIN s a ON a.job_i = producer LEFT JOIN s c ON c.job_i = consumer""",
)

# Aggregates

add("agg_step_state", lambda g: A.state_counts(g, "step"), "SELECT s.state, count(*) AS n FROM step s JOIN node ON i = s.node WHERE NOT detached GROUP BY 1")
add("agg_file_state", lambda g: A.state_counts(g, "file"), "SELECT f.state, count(*) AS n FROM file f JOIN node ON i = f.node WHERE NOT detached GROUP BY 1")
USED = "SELECT name, CAST(sum(units) AS BIGINT) AS used FROM step_resource WHERE node IN (SELECT node FROM step WHERE state = 22) GROUP BY 1"
add("agg_resource_used", A.resource_used, USED)
DECLARED = "SELECT node, need AS implied_need FROM step"
add("agg_need_bucket", lambda g: A.need_buckets(g, g.step.select("node", F.col("need").alias("implied_need"))), "SELECT need AS implied_need, s.state = 23 AS succeeded, count(*) AS n FROM step s JOIN node ON i = s.node WHERE NOT detached GROUP BY 1, 2")
add("agg_required", lambda g: A.required_steps(A.need_buckets(g, g.step.select("node", F.col("need").alias("implied_need"))), S.OPTIONAL), "SELECT count(*) FILTER (s.state = 23) AS succeeded, count(*) AS required FROM step s JOIN node ON i = s.node WHERE NOT detached AND need > 31")
add("agg_totals", A.totals, TOTALS)
add("agg_pend_resource", lambda g: A.short_by_name(R.short_resources(g)), f"SELECT name, max(units) AS units_needed, max(available) AS units_available FROM ({SHORT}) s GROUP BY 1")
FREE = f"SELECT s.node, NOT EXISTS (SELECT 1 FROM step_resource r LEFT JOIN available_resource a ON a.name = r.name LEFT JOIN ({USED}) u ON u.name = r.name WHERE r.node = s.node AND (a.units IS NULL OR a.units - coalesce(u.used, 0) < r.units)) AS free FROM step s"
add("agg_resource_free", A.resources_free, FREE)
add("agg_sqllog", L.statement_times, "SELECT x.query, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total_ns, avg(duration_ns) AS mean_ns, CAST(median(duration_ns) AS DOUBLE) AS median_ns FROM sqllog s LEFT JOIN sqllog_index x ON x.query_i = s.query_i GROUP BY 1")
ISSUE = """SELECT DISTINCT query_i, issue FROM (SELECT query_i, unnest(string_split(plan, ';')) AS line FROM sqllog_index) l,
    LATERAL (SELECT unnest([CASE WHEN line LIKE 'SCAN %' AND line NOT LIKE '%USING%' THEN 'full_scan' END, CASE WHEN line LIKE '%AUTOMATIC%' THEN 'automatic_index' END,
    CASE WHEN line LIKE '%TEMP B-TREE%' THEN 'temp_btree' END, CASE WHEN line LIKE '%CORRELATED%' THEN 'correlated_subquery' END]) AS issue) i WHERE issue IS NOT NULL"""
add("agg_plan_issue", L.plan_issues, f"SELECT issue, count(*) AS n, CAST(sum(t) AS BIGINT) AS total_ns FROM ({ISSUE}) i LEFT JOIN (SELECT query_i, sum(duration_ns) AS t FROM sqllog GROUP BY 1) s ON s.query_i = i.query_i GROUP BY 1")
INTERVALS = """SELECT start, stop, CAST(active AS BIGINT) AS active FROM (SELECT time_ns AS start, lead(time_ns) OVER (ORDER BY time_ns) AS stop, sum(delta) OVER (ORDER BY time_ns) AS active
    FROM (SELECT time_ns, sum(CASE event WHEN 'START' THEN 1 ELSE -1 END) AS delta FROM joblog GROUP BY 1) t) i WHERE stop IS NOT NULL"""
NJOB = 40
add("win_interval_sweep", L.intervals, INTERVALS)
add("win_open_jobs", L.open_jobs, f"SELECT job_i, description, start FROM {SPANS} q WHERE stop IS NULL AND start IS NOT NULL")
add("agg_dip_hist", lambda g: L.dip_histogram(L.intervals(g), NJOB), f"SELECT active, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS total, CAST(sum(({NJOB} - active) * (stop - start)) AS BIGINT) AS lost FROM ({INTERVALS}) i WHERE active < {NJOB} GROUP BY 1")
add("top_dips", lambda g: L.dips(L.intervals(g), NJOB, 10), f"SELECT start, stop, active, ({NJOB} - active) * (stop - start) AS lost FROM ({INTERVALS}) i WHERE active < {NJOB} ORDER BY lost DESC, start LIMIT 10")
add("agg_concurrency", lambda g: L.concurrency(L.intervals(g), NJOB), f"SELECT sum(active * (stop - start)) / sum(stop - start) AS mean, 100.0 * sum(CASE WHEN active >= {NJOB} THEN stop - start ELSE 0 END) / sum(stop - start) AS saturated_pct FROM ({INTERVALS}) i")
add("agg_job_pivot", L.job_pivot, "SELECT job_i, max(CASE WHEN event = 'START' THEN time_ns END) AS start, max(CASE WHEN event = 'END' THEN time_ns END) AS \"end\" FROM joblog GROUP BY 1")
_GLOB = Pattern("${*src}/${*lang}/*[05].txt")
add("agg_glob_group", lambda g: R.group_matches(g.path, _GLOB.regex(), 2).select(F.array_join("captures", "|").alias("captures"), F.array_join("paths", ",").alias("paths")), "SELECT regexp_extract(path, '^([^/]+)/([^/]+)/[^/]*[05]\\.txt$', 1) || '|' || regexp_extract(path, '^([^/]+)/([^/]+)/[^/]*[05]\\.txt$', 2) AS captures, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM path WHERE regexp_matches(path, '^([^/]+)/([^/]+)/[^/]*[05]\\.txt$') GROUP BY 1")
add("win_running_pct", lambda g: L.ranked(g.sqllog.groupBy("query_i").agg(F.sum("duration_ns").alias("t")), "t", "query_i", 10).select("query_i", "t", F.round("running_pct", 6).alias("running_pct")), "WITH q AS (SELECT query_i, CAST(sum(duration_ns) AS BIGINT) AS t FROM sqllog GROUP BY 1), r AS (SELECT *, sum(t) OVER (ORDER BY t DESC, query_i) AS run, sum(t) OVER () AS whole, row_number() OVER (ORDER BY t DESC, query_i) AS k FROM q) SELECT query_i, t, round(100.0 * run / whole, 6) AS running_pct FROM r WHERE k <= 10")
add("top_queries", lambda g: g.sqllog.groupBy("query_i").agg(F.sum("duration_ns").alias("t")).orderBy(F.desc("t"), "query_i").limit(5), "SELECT query_i, CAST(sum(duration_ns) AS BIGINT) AS t FROM sqllog GROUP BY 1 ORDER BY t DESC, query_i LIMIT 5")
add("top_jobs", lambda g: L.top_jobs(g, 10), f"SELECT job_i, description, stop - start AS duration FROM {SPANS} q WHERE stop IS NOT NULL ORDER BY duration DESC, job_i LIMIT 10")
add("lim_first_product", lambda g: R.first_product(g, Pattern("out/${*c}/*7.txt").regex()), f"SELECT file, label FROM {OUT} o WHERE NOT detached AND state <> 18 AND regexp_full_match(label, 'out/[^/]+/[^/]*7\\.txt') ORDER BY label LIMIT 1")
add("srt_keys", lambda g: g.node.orderBy("kind", "label").select("kind", "label"), "SELECT kind, label FROM node ORDER BY kind, label")

# Sets

_OLD, _NEW = "doc % 3 <> 0", "doc % 5 <> 0"
DOC = "CAST(regexp_extract(path, '([0-9]+)\\.txt$', 1) AS BIGINT) AS doc"


def _halves(g: Frames) -> tuple[DataFrame, DataFrame]:
    p = g.path.withColumn("doc", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long"))
    new = p.filter(_NEW).withColumn("digest", F.when(F.col("doc") % 7 == 0, "changed").otherwise(F.col("digest")))
    return p.filter(_OLD), new


HALVES = f"WITH p AS (SELECT *, {DOC} FROM path), old AS (SELECT * FROM p WHERE {_OLD}), new AS (SELECT path, doc, CASE WHEN doc % 7 = 0 THEN 'changed' ELSE digest END AS digest FROM p WHERE {_NEW})"
add("set_symdiff", lambda g: R.glob_delta(*_halves(g)), HALVES + " SELECT path, 'deleted' AS change FROM old WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, 'added' FROM new WHERE path NOT IN (SELECT path FROM old)")
add("set_hash_diff", lambda g: R.digest_diff(*_halves(g)), HALVES + " SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'Added' WHEN n.path IS NULL THEN 'Deleted' WHEN o.digest IS NOT DISTINCT FROM n.digest THEN 'Same' ELSE 'Modified' END AS change FROM old o FULL JOIN new n ON n.path = o.path")
#: Batches of edges: whether no sink of the first ones is a source of the second ones.
DISJOINT = [("all", "true", "true"), ("dynamic", "dynamic", "dynamic"), ("declared parts", "source % 10 = 7", "source % 10 = 7"), ("logs", "sink % 10 = 9", "true")]
add(
    "set_disjoint",
    lambda g: R.overlaps({name: (g.dependency.filter(a).select(F.col("sink").alias("i")), g.dependency.filter(b).select(F.col("source").alias("i"))) for name, a, b in DISJOINT}),
    " UNION ALL ".join(f"SELECT '{name}' AS name, NOT EXISTS (SELECT 1 FROM dependency WHERE ({a}) AND sink IN (SELECT source FROM dependency WHERE {b})) AS disjoint" for name, a, b in DISJOINT),
)
add("set_overlap", lambda g: g.env_var.filter("dynamic").select("name").intersect(g.env_var.filter("NOT dynamic").select("name")), "SELECT name FROM env_var WHERE dynamic INTERSECT SELECT name FROM env_var WHERE NOT dynamic")

# Recursion

DOWN = f"reach AS ({CHANGED} UNION SELECT d.sink FROM reach JOIN dependency d ON d.source = reach.i)"
add("gr_reach_sinks", lambda g: G.reach_sinks(g, changed(g)), f"WITH {DOWN} SELECT i FROM reach")
add("gr_reach_multi", lambda g: G.outputs_to_clean(g, changed(g)), f"WITH {DOWN} SELECT n.i, n.label, f.state FROM reach JOIN file f ON f.node = reach.i JOIN node n ON n.i = reach.i WHERE f.state IN (16, 17, 18)")
add("gr_match_paths", lambda g: G.match_paths(g, "supplier/3"), "SELECT i, label FROM node WHERE kind = 'file' AND (label = 'supplier/3' OR starts_with(lower(label), 'supplier/3/'))")


def _edges(g: Frames) -> DataFrame:
    """Every dynamic edge once more as a candidate, and turned round."""
    d = g.dependency.filter("dynamic").select("source", "sink")
    return d.unionByName(d.select(F.col("sink").alias("source"), F.col("source").alias("sink")))


CYCLIC = """WITH d AS (SELECT source, sink FROM dependency WHERE dynamic), c AS (SELECT source, sink FROM d UNION ALL SELECT sink, source FROM d),
    reach AS (SELECT sink AS root, sink AS i FROM c UNION SELECT reach.root, d.sink FROM reach JOIN dependency d ON d.source = reach.i),
    v AS (SELECT source, sink, EXISTS (SELECT 1 FROM reach r WHERE r.root = c.sink AND r.i = c.source) AS cyclic FROM c)"""
add("gr_would_cycle", lambda g: G.would_cycle(g, _edges(g)), CYCLIC + " SELECT source, sink, cyclic FROM v")
add("gr_check_acyclic", lambda g: G.would_cycle(g, _edges(g)).groupBy("cyclic").agg(F.count(F.lit(1)).alias("n")), CYCLIC + " SELECT cyclic, count(*) AS n FROM v GROUP BY 1")
TREE = "below AS (SELECT i FROM node WHERE creator = {0} AND i <> creator UNION SELECT n.i FROM below JOIN node n ON n.creator = below.i)"
add("gr_all_products", lambda g: G.all_products(g, seeds(g, "i = 12")), f"WITH {TREE.format(12)} SELECT i FROM below")
add(
    "gr_reattach",
    lambda g: G.reattach(g, g.node.filter("kind = 'step' AND label LIKE 'customer %' AND detached AND i % 20 = 4").select("i", F.lit(13).cast("long").alias("creator"))),
    """WITH m AS (SELECT i FROM node WHERE kind = 'step' AND label LIKE 'customer %' AND detached AND i % 20 = 4), below AS (SELECT i FROM m UNION SELECT n.i FROM below JOIN node n ON n.creator = below.i)
    SELECT n.i, n.kind, n.label, CASE WHEN n.i IN (SELECT i FROM m) THEN 13 ELSE n.creator END AS creator, CASE WHEN n.i IN (SELECT i FROM below) THEN false ELSE n.detached END AS detached FROM node n""",
)
_BROKEN = lambda g: g.with_(node=g.node.withColumn("detached", F.when(F.col("i") % 1000 == 4, ~F.col("detached")).otherwise(F.col("detached"))))
BROKEN = "WITH b AS (SELECT i, kind, label, creator, CASE WHEN i % 1000 = 4 THEN NOT detached ELSE detached END AS detached FROM node)"
add("gr_consistency", lambda g: G.inconsistent(_BROKEN(g)), BROKEN + ", live AS (SELECT i FROM b WHERE kind = 'root' UNION SELECT b.i FROM live JOIN b ON b.creator = live.i) SELECT i, label, detached FROM b WHERE (i IN (SELECT i FROM live)) = detached")
add("gr_local_consistency", lambda g: G.locally_inconsistent(_BROKEN(g)), BROKEN + " SELECT b.i, b.label, b.detached FROM b LEFT JOIN b c ON c.i = b.creator WHERE b.kind <> 'root' AND coalesce(c.detached, true) <> b.detached")
STEPS = "below AS (SELECT i FROM node WHERE i = 12 UNION SELECT n.i FROM below JOIN node n ON n.creator = below.i JOIN step s ON s.node = n.i)"
add("gr_products_steps", lambda g: G.product_steps(g, seeds(g, "i = 12")), f"WITH {STEPS} SELECT i FROM below")
add("gr_subtree_sources", lambda g: G.subtree_sources(g, seeds(g, "i = 12")), f"WITH {STEPS} SELECT DISTINCT before AS i FROM ({TWO}) t WHERE step IN (SELECT i FROM below)")
add(
    "gr_delete_detached",
    lambda g: G.deletable(g).select("i"),
    """WITH up AS (SELECT source AS i, sink AS by FROM dependency UNION ALL SELECT creator, i FROM node WHERE creator <> i),
    held AS (SELECT i FROM node WHERE NOT detached UNION SELECT up.i FROM held JOIN up ON up.by = held.i) SELECT i FROM node WHERE detached AND i NOT IN (SELECT i FROM held)""",
)
# some parts are used by no order any more
add("gr_static_prune", lambda g: G.unused_tree_files(g.with_(dependency=g.dependency.filter("source % 300 <> 47"))), "SELECT f.i, f.label FROM node f JOIN node t ON t.i = f.creator AND t.kind = 'st' WHERE f.kind = 'file' AND NOT f.detached AND f.i NOT IN (SELECT d.source FROM dependency d JOIN node n ON n.i = d.sink WHERE NOT n.detached AND d.source % 300 <> 47)")
ANC = "up AS (SELECT i, creator AS anc, 1 AS depth FROM node WHERE creator <> i UNION SELECT up.i, n.creator, up.depth + 1 FROM up JOIN node n ON n.i = up.anc WHERE n.creator <> n.i), anc AS (SELECT up.i, up.anc, up.depth, s.state, s.holding FROM up JOIN step s ON s.node = up.anc WHERE up.i IN (SELECT node FROM step))"
SAFE = "SELECT s.node, coalesce(bool_and(a.state IN (22, 23) AND a.holding = 0), true) AS safe, coalesce(bool_and(a.state IN (22, 23)), true) AS safe_ignoring_hold FROM step s LEFT JOIN anc a ON a.i = s.node GROUP BY 1"
add("gr_safe", G.safety, f"WITH {ANC} {SAFE}")
UNSAFE = "SELECT i AS node, arg_min(anc, depth) AS anc FROM anc WHERE NOT (state IN (22, 23) AND holding = 0) GROUP BY 1"
add("gr_unsafe_anc", G.unsafe_ancestor, f"WITH {ANC} {UNSAFE}")
add("gr_creator_pending", G.creator_pending, f"WITH {ANC} SELECT DISTINCT i AS node FROM anc WHERE state = 21")
add("gr_propagate", lambda g: G.to_revisit(g, changed(g)), f"WITH hit AS (SELECT DISTINCT d.sink AS i FROM dependency d JOIN step s ON s.node = d.sink WHERE d.source IN ({CHANGED})), front AS (SELECT i AS node FROM hit UNION SELECT before FROM front JOIN ({TWO}) t ON t.step = front.node JOIN node n ON n.i = t.step AND NOT n.detached) SELECT node FROM front")
NEED = f"""se AS (SELECT before AS src, step AS dst FROM ({TWO}) t JOIN node n ON n.i = t.step WHERE NOT n.detached),
    own AS (SELECT s.node, greatest(s.need, CASE WHEN EXISTS (SELECT 1 FROM {OUT} o WHERE o.step = s.node AND NOT o.detached AND o.state <> 18 AND o.label IN (SELECT path FROM target_path)) THEN 33
        WHEN s.need = 32 AND EXISTS (SELECT 1 FROM {OUT} o JOIN target_dir t ON o.label >= t.path AND o.label < t.upper WHERE o.step = s.node AND NOT o.detached AND o.state <> 18) THEN 33 ELSE 31 END) AS own, s.duration FROM step s),
    chain AS (SELECT node AS i, node AS at, duration AS t, own AS n FROM own UNION SELECT se.src, chain.at, o.duration + chain.t, greatest(o.own, chain.n) FROM chain JOIN se ON se.dst = chain.i JOIN own o ON o.node = se.src),
    need AS (SELECT i AS node, CAST(max(n) AS INT) AS implied_need, max(t) AS tail_time FROM chain GROUP BY 1)"""
add("gr_need_tail", G.need_and_tail, f"WITH {NEED} SELECT node, implied_need, tail_time FROM need")
MARK = """use AS (SELECT d.source AS src, d.sink AS dst FROM dependency d JOIN step s ON s.node = d.sink WHERE s.state NOT IN (22, 25)
    UNION ALL SELECT d.source, d.sink FROM dependency d JOIN step s ON s.node = d.source AND s.state IN (23, 24) JOIN file f ON f.node = d.sink AND f.state = 16),
    hit AS (SELECT use.dst AS i FROM use WHERE use.src IN (CHANGED) UNION SELECT use.dst FROM hit JOIN use ON use.src = hit.i)""".replace("CHANGED", CHANGED)
add("gr_mark_pending", lambda g: G.mark_pending(g, changed(g)), f"WITH {MARK} SELECT s.node, s.state AS old, 21 AS new FROM hit JOIN step s ON s.node = hit.i WHERE s.state <> 21 UNION ALL SELECT f.node, 16, 17 FROM hit JOIN file f ON f.node = hit.i WHERE f.state = 16 AND f.node NOT IN ({CHANGED})")


add("gr_leaf_layers", lambda g: G.leaf_layers(G.step_edges(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"))), f"WITH e AS (SELECT step AS src, before AS dst FROM ({TWO}) t JOIN node n ON n.i = t.step WHERE NOT n.detached), v AS (SELECT src AS i FROM e UNION SELECT dst FROM e), walk AS (SELECT i, 0 AS layer FROM v UNION SELECT e.src, walk.layer + 1 FROM walk JOIN e ON e.dst = walk.i) SELECT i, CAST(max(layer) AS INT) AS layer, false AS cyclic FROM walk GROUP BY 1")

# Constraints


def _spoiled(g: Frames) -> Frames:
    node = g.node.withColumn("label", F.when(F.col("i") % 1000 == 28, F.lit("twice")).otherwise(F.col("label"))).withColumn("creator", F.when(F.col("i") % 1000 == 48, None).when(F.col("i") % 1000 == 68, 17).otherwise(F.col("creator")))
    dep = g.dependency.withColumn("sink", F.when(F.col("source") % 1000 == 15, F.col("source")).otherwise(F.col("sink")))
    file = g.file.withColumn("digest", F.when(F.col("node") % 1000 == 77, None).otherwise(F.col("digest"))).withColumn("state", F.when(F.col("node") % 1000 == 97, 11).otherwise(F.col("state")))
    step = g.step.withColumn("deferred", (F.col("node") % 1000 == 15) | F.col("deferred")).withColumn("duration", F.when(F.col("node") % 1000 == 25, -1).otherwise(F.col("duration")))
    return g.with_(node=node, dependency=dep, file=file, step=step)


SPOILED = """WITH n2 AS (SELECT i, kind, CASE WHEN i % 1000 = 28 THEN 'twice' ELSE label END AS label, CASE WHEN i % 1000 = 48 THEN NULL WHEN i % 1000 = 68 THEN 17 ELSE creator END AS creator, detached FROM node),
    d2 AS (SELECT i, source, CASE WHEN source % 1000 = 15 THEN source ELSE sink END AS sink FROM dependency),
    f2 AS (SELECT node, CASE WHEN node % 1000 = 97 THEN 11 ELSE state END AS state, CASE WHEN node % 1000 = 77 THEN NULL ELSE digest END AS digest FROM file),
    s2 AS (SELECT node, state, need, CASE WHEN node % 1000 = 25 THEN -1 ELSE duration END AS duration, node % 1000 = 15 OR deferred AS deferred, defer_count, holding FROM step)"""
add("chk_node", lambda g: K.node_rules(_spoiled(g)), SPOILED + " SELECT 'root' AS rule, i FROM n2 WHERE (kind = 'root') <> coalesce(i = 1 AND creator = 1 AND NOT detached AND label = '', false) UNION ALL SELECT 'creator', i FROM n2 WHERE creator IS NULL AND NOT detached UNION ALL SELECT 'unique', min(i) FROM n2 GROUP BY kind, label HAVING count(*) > 1")
add("chk_creator_kind", lambda g: K.creator_kinds(_spoiled(g)), SPOILED + " SELECT 'creator kind' AS rule, n.i FROM n2 n JOIN n2 c ON c.i = n.creator WHERE n.kind <> 'root' AND (c.kind, n.kind) NOT IN (('step','file'),('st','file'),('root','file'),('step','step'),('root','step'),('step','st'))")
add("chk_edge_kind", lambda g: K.edge_kinds(_spoiled(g)), SPOILED + " SELECT 'edge kind' AS rule, d.i FROM d2 d JOIN n2 a ON a.i = d.source JOIN n2 b ON b.i = d.sink WHERE (a.kind, b.kind) NOT IN (('file','step'),('step','file'),('st','file'))")
add("chk_file_hash", lambda g: K.file_rules(_spoiled(g)), SPOILED + " SELECT 'hash' AS rule, node AS i FROM f2 WHERE state IN (14, 16, 17) AND digest IS NULL UNION ALL SELECT 'undeclared', node FROM f2 JOIN n2 ON n2.i = node WHERE state = 11 AND NOT detached")
add("chk_step", lambda g: K.step_rules(_spoiled(g)), SPOILED + " SELECT 'deferred' AS rule, node AS i FROM s2 WHERE deferred AND state <> 21 UNION ALL SELECT 'range', node FROM s2 WHERE state NOT BETWEEN 21 AND 25 OR need NOT IN (31, 32, 34) UNION ALL SELECT 'negative', node FROM s2 WHERE duration < 0 OR defer_count < 0 OR holding < 0")
add("chk_succeeded_outputs", lambda g: K.succeeded_outputs(g.with_(file=g.file.withColumn("state", F.when(F.col("node") % 1000 == 8, 17).otherwise(F.col("state"))))), f"SELECT o.step, o.label, CASE WHEN o.file % 1000 = 8 THEN 17 ELSE o.state END AS state FROM {OUT} o JOIN step s ON s.node = o.step WHERE s.state = 23 AND NOT o.detached AND CASE WHEN o.file % 1000 = 8 THEN 17 ELSE o.state END NOT IN (16, 18)")
add("chk_flags", lambda g: K.affected_steps(g, changed(g)), f"SELECT DISTINCT d.sink AS node, 'ready' AS flag FROM dependency d JOIN step s ON s.node = d.sink WHERE d.source IN ({CHANGED}) UNION SELECT DISTINCT d.source, 'after' FROM dependency d JOIN step s ON s.node = d.source WHERE d.sink IN ({CHANGED})")
add("chk_counts", lambda g: A.count_drift(g, A.need_buckets(g, g.step.select("node", F.col("need").alias("implied_need"))).withColumn("n", F.when(F.col("implied_need") == S.PLAN, F.col("n") + 1).otherwise(F.col("n"))), g.step.select("node", F.col("need").alias("implied_need"))), "SELECT need AS implied_need, s.state = 23 AS succeeded, count(*) + 1 AS stored, count(*) AS n FROM step s JOIN node ON i = s.node WHERE NOT detached AND need = 34 GROUP BY 1, 2")
add("chk_derived", lambda g: K.derived_rules(g, g.step.filter("state = 23 OR node % 7 = 0").select("node")), "SELECT 'holding' AS rule, node AS i FROM step WHERE state <> 22 AND holding <> 0 UNION ALL SELECT 'ended', node FROM step WHERE state IN (23, 24) AND deferred UNION ALL SELECT 'count', node FROM step WHERE state = 23 AND defer_count <> 0 UNION ALL SELECT 'has_hash', node FROM step WHERE has_hash <> (state = 23 OR node % 7 = 0)")

# State machine

RULES = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) for x in r) + ")" for r in S.TRANSITIONS) + ") AS r(cause, old_state, known, new_state, action)"


def _updates(g: Frames) -> DataFrame:
    cause = F.element_at(F.array(*(F.lit(c) for c in ("EXTERNAL", "SUCCEEDED", "FAILED", "CONFIRMED"))), (F.col("node") % 4 + 1).cast("int"))
    return g.file.select("node", cause.alias("cause"), F.when(F.col("node") % 3 != 0, F.md5(F.col("node").cast("string").cast("binary"))).alias("digest"))


UPDATES = "WITH u AS (SELECT node, state AS old_state, CASE node % 4 WHEN 0 THEN 'EXTERNAL' WHEN 1 THEN 'SUCCEEDED' WHEN 2 THEN 'FAILED' ELSE 'CONFIRMED' END AS cause, CASE WHEN node % 3 <> 0 THEN md5(CAST(node AS STRING)) END AS digest FROM file)"
add("dml_transition", lambda g: C.transitions(g, _updates(g)), UPDATES + f" SELECT u.node, u.old_state, r.new_state, r.action, r.new_state IS NOT NULL AS ok FROM u LEFT JOIN {RULES} ON r.cause = u.cause AND r.old_state = u.old_state AND r.known = (u.digest IS NOT NULL)")
add("dml_upsert", lambda g: C.apply_transitions(g, _updates(g)), UPDATES + f" SELECT u.node, coalesce(r.new_state, u.old_state) AS state, CASE WHEN r.new_state IS NULL THEN f.digest WHEN r.new_state IN (14, 16, 17) THEN u.digest END AS digest FROM u JOIN file f ON f.node = u.node LEFT JOIN {RULES} ON r.cause = u.cause AND r.old_state = u.old_state AND r.known = (u.digest IS NOT NULL)")
add("dml_interrupted", lambda g: C.interrupted(g).select("node", "state"), "SELECT node, CASE WHEN state IN (22, 24, 25) THEN 21 ELSE state END AS state FROM step")
add(
    "dml_create",
    lambda g: C.created(g, g.node.filter("kind <> 'root'").select((F.col("i") + 1000000000).alias("i"), "kind", F.when(F.col("i") % 1000 < 500, F.col("label")).otherwise(F.concat("label", F.lit(" new"))).alias("label"), F.lit(13).cast("long").alias("creator"))),
    """WITH w AS (SELECT i + 1000000000 AS i, kind, CASE WHEN i % 1000 < 500 THEN label ELSE label || ' new' END AS label FROM node WHERE kind <> 'root')
    SELECT n.i, n.kind, n.label, CASE WHEN w.i IS NOT NULL AND n.detached THEN 13 ELSE n.creator END AS creator, n.detached AND w.i IS NULL AS detached FROM node n LEFT JOIN w ON w.kind = n.kind AND w.label = n.label
    UNION ALL SELECT w.i, w.kind, w.label, 13, false FROM w WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.kind = w.kind AND n.label = w.label)""",
)
SUPPLY = "SELECT t.path, f.i AS file, CASE WHEN f.state IN (14, 16) THEN 'ok' WHEN f.state = 12 THEN 'to_check' ELSE 'unavailable' END AS verdict FROM ({0}) t LEFT JOIN (SELECT i, label, state FROM node JOIN file ON node = i WHERE NOT detached) f ON f.label = t.path"


def _supplied(g: Frames) -> DataFrame:
    return C.supply(g, g.target_path.unionByName(g.nglob_match.select("path").distinct()))


add("dml_supply", _supplied, SUPPLY.format("SELECT path FROM target_path UNION ALL SELECT DISTINCT path FROM nglob_match"))


def _wanted(g: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every step's dynamic inputs asked for again; a step starts at its node id and stops after its duration."""
    w = R.inputs_of(g).filter("dynamic").select("step", F.col("label").alias("path"))
    t = g.step.select(F.col("node").alias("job"), F.col("node").alias("start"), (F.col("node") + F.col("duration") % 500).alias("stop"))
    return w, t.select("job", "start"), t.filter("job % 3 <> 0").select("job", "stop")


add(
    "dml_amend",
    lambda g: C.amend(g, *_wanted(g)),
    f"""WITH w AS (SELECT DISTINCT step, label AS path FROM {INP} x WHERE dynamic), s AS ({SUPPLY.format("SELECT DISTINCT path FROM w")})
    SELECT w.step, w.path, CASE WHEN s.verdict = 'ok' AND f.state = 16 AND p.node % 3 <> 0 AND w.step <= p.node + p.duration % 500 THEN 'unfresh' ELSE s.verdict END AS verdict
    FROM w JOIN s ON s.path = w.path LEFT JOIN file f ON f.node = s.file LEFT JOIN node n ON n.i = s.file LEFT JOIN step p ON p.node = n.creator""",
)


def _outputs(g: Frames) -> DataFrame:
    """Every output declared again, by its step or by the next one, some also as volatile."""
    o = R.outputs_of(g).select("step", F.col("label").alias("path"), "state", "file")
    role = F.when(F.col("state") == S.VOLATILE, "VOLATILE").otherwise("OUTPUT")
    a = o.select((F.col("step") + F.when(F.col("file") % 7 == 0, 10).otherwise(0)).alias("step"), "path", role.alias("role"))
    fresh = o.select("step", F.concat("path", F.lit(".new")).alias("path"), role.alias("role"))
    return a.unionByName(fresh).unionByName(o.filter("file % 11 = 0").select("step", F.concat("path", F.lit(".new")).alias("path"), F.lit("VOLATILE").alias("role")))


add(
    "dml_outputs",
    lambda g: C.output_conflicts(g, _outputs(g), _patterns(g, [("out/1*/*.new",), ("vol/${*c}/5*",)])),
    f"""WITH o AS (SELECT step, label AS path, state, file, CASE WHEN state = 18 THEN 'VOLATILE' ELSE 'OUTPUT' END AS role FROM {OUT} x),
    d AS (SELECT DISTINCT * FROM (SELECT step + CASE WHEN file % 7 = 0 THEN 10 ELSE 0 END AS step, path, role FROM o UNION ALL SELECT step, path || '.new', role FROM o UNION ALL SELECT step, path || '.new', 'VOLATILE' FROM o WHERE file % 11 = 0) y),
    c AS (SELECT label AS path, creator, CASE WHEN state IN (15, 16, 17) THEN 'OUTPUT' WHEN state = 18 THEN 'VOLATILE' ELSE 'STATIC' END AS r FROM node JOIN file ON node = i WHERE NOT detached)
    SELECT step, path, 'output and volatile' AS rule FROM d GROUP BY 1, 2 HAVING count(DISTINCT role) > 1 UNION ALL SELECT d.step, d.path, 'already claimed' FROM d JOIN c ON c.path = d.path WHERE c.creator <> d.step OR c.r <> d.role
    UNION ALL (SELECT DISTINCT d.step, d.path, 'matches a pattern' FROM d WHERE regexp_full_match(d.path, 'out/1[^/]*/[^/]*\\.new|vol/[^/]+/5[^/]*') AND NOT EXISTS (SELECT 1 FROM c WHERE c.path = d.path AND c.creator = d.step AND c.r = d.role))""",
)
add("dml_static", lambda g: C.declared_static(g, g.path.select("path").unionByName(g.change.select("path"))), "SELECT path FROM path UNION SELECT path FROM change EXCEPT SELECT label FROM node WHERE kind = 'file' AND NOT detached")
add("dml_tree", lambda g: C.tree_conflicts(g, g.spark.createDataFrame([("supplier/3/sub/",), ("supplier/",), ("other/",)], "path string")), "SELECT t.path, n.label AS other FROM (VALUES ('supplier/3/sub/'), ('supplier/'), ('other/')) t(path) JOIN node n ON n.kind = 'st' AND NOT n.detached AND (starts_with(t.path, n.label) OR starts_with(n.label, t.path))")
add("dml_reset", lambda g: C.reset_for_rerun(g, g.step.filter("state IN (23, 24)").select(F.col("node").alias("i")))[2], "SELECT f.node, CASE WHEN f.state = 16 AND f.node IN (SELECT sink FROM dependency JOIN step s ON s.node = source AND s.state IN (23, 24)) THEN 17 ELSE f.state END AS state, f.digest FROM file f")
add("dml_reset_edges", lambda g: C.reset_for_rerun(g, g.step.filter("state IN (23, 24)").select(F.col("node").alias("i")))[0], "SELECT d.i, d.source, d.sink, d.dynamic FROM dependency d WHERE NOT (d.dynamic AND d.sink IN (SELECT node FROM step WHERE state IN (23, 24)))")
add(
    "dml_complete",
    lambda g: C.completed(g, g.step.select("node", F.element_at(F.array(F.lit("SUCCEED"), F.lit("FAIL"), F.lit("DEFER")), (F.col("node") % 3 + 1).cast("int")).alias("outcome")), cap=3),
    f"""SELECT node, CASE WHEN node % 3 = 0 THEN 23 WHEN node % 3 = 2 AND defer_count + 1 <= 3 THEN 21 ELSE 24 END AS state,
        node % 3 = 2 AND defer_count + 1 <= 3 AND node IN (SELECT step FROM {INP} x WHERE dynamic AND state NOT IN (14, 16)) AS deferred,
        CASE node % 3 WHEN 0 THEN 0 WHEN 1 THEN defer_count ELSE defer_count + 1 END AS defer_count, node % 3 = 0 AS has_hash, 0 AS holding FROM step""",
)
add("dml_optional", lambda g: C.optional_reverted(g, g.step.select("node", F.col("need").alias("implied_need"))), f"SELECT o.step AS node, o.file, o.label FROM {OUT} o JOIN step s ON s.node = o.step WHERE s.need = 31 AND s.state IN (23, 24) AND o.state IN (16, 17, 18)")
add("dml_targets", lambda g: C.missing_targets(g, g.target_path.unionByName(g.path.select("path"))), f"SELECT path FROM (SELECT path FROM target_path UNION ALL SELECT path FROM path) t WHERE path NOT IN (SELECT label FROM {OUT} o WHERE NOT detached AND state <> 18)")
add("dml_duration", lambda g: C.new_durations(g, g.step.select("node", (F.col("duration") + F.col("node") % 40000).alias("new"))), "SELECT node, duration + node % 40000 AS duration FROM step WHERE (node % 40000) * 10 > duration")
add("dml_recycle", lambda g: C.recyclable(*(g.env_var.groupBy(F.col("node").cast("string").alias("label")).agg(F.collect_list("name").alias("env")).select("label", "env", F.when((F.col("label").cast("long") % 4 == 1) & F.lit(k == 0), F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("inp")) for k in (0, 1))), "SELECT DISTINCT CAST(node AS STRING) AS label FROM env_var WHERE node % 4 <> 1")


def _declared(g: Frames) -> DataFrame:
    return g.node.filter("kind = 'file'").select("label", F.when(F.col("i") % 20 == 8, F.col("creator")).otherwise(F.lit(1)).alias("creator"), F.lit("OUTPUT").alias("role"))


add("claim_check", lambda g: C.claim_check(g, _declared(g)), "WITH c AS (SELECT label, creator, CASE WHEN state IN (15, 16, 17) THEN 'OUTPUT' WHEN state = 18 THEN 'VOLATILE' ELSE 'STATIC' END AS role FROM node JOIN file ON node = i WHERE NOT detached), d AS (SELECT label, CASE WHEN i % 20 = 8 THEN creator ELSE 1 END AS creator FROM node WHERE kind = 'file') SELECT d.label, 'OUTPUT' AS role, CASE WHEN c.role IS NULL THEN 'new' WHEN c.creator = d.creator AND c.role = 'OUTPUT' THEN 'repeated' ELSE 'collides' END AS verdict FROM d LEFT JOIN c ON c.label = d.label")
add("dup_step", lambda g: C.duplicate_steps(g, g.node.select("label")), "SELECT label, creator FROM node WHERE kind = 'step' AND NOT detached")
add("dml_define", lambda g: C.define_errors(g, g.node.filter("kind = 'step'").select("label"), g.node.filter("i % 10 = 8").select("label"), g.node.filter("i % 30 = 8").select("label"), g.env_var.filter("dynamic").select("name"), g.env_var.filter("NOT dynamic AND node % 3 = 0").select("name")), "SELECT 'step exists' AS rule, label FROM node WHERE kind = 'step' AND NOT detached UNION ALL SELECT DISTINCT 'output and volatile', label FROM node WHERE i % 30 = 8 UNION ALL (SELECT DISTINCT 'used and overridden', name FROM env_var WHERE dynamic AND name IN (SELECT name FROM env_var WHERE NOT dynamic AND node % 3 = 0)) UNION ALL SELECT 'already claimed', a.label FROM (SELECT label FROM node WHERE i % 10 = 8 UNION ALL SELECT label FROM node WHERE i % 30 = 8) a WHERE a.label IN (SELECT label FROM node JOIN file ON node = i WHERE NOT detached)")

# Pending analysis: the last stages share one analysis

PEND = f"""{ANC}, {NEED}, st AS (SELECT node, CASE state WHEN 22 THEN 24 WHEN 25 THEN 21 ELSE state END AS state, deferred, has_hash, holding FROM step),
    anc2 AS (SELECT a.i, a.anc, a.depth, t.state, t.holding FROM anc a JOIN st t ON t.node = a.anc),
    safe AS (SELECT s.node, coalesce(bool_and(a.state IN (22, 23) AND a.holding = 0), true) AS safe, coalesce(bool_and(a.state IN (22, 23)), true) AS nh FROM step s LEFT JOIN anc2 a ON a.i = s.node GROUP BY 1),
    u AS (SELECT n.i, n.label, NOT (sf.safe OR (st.has_hash AND sf.nh)) AS unsafe, st.deferred FROM st JOIN node n ON n.i = st.node JOIN need ON need.node = st.node JOIN safe sf ON sf.node = st.node WHERE st.state = 21 AND NOT n.detached AND need.implied_need > 31),
    fb AS (SELECT DISTINCT x.file, x.step FROM {INP} x JOIN u ON u.i = x.step WHERE {BLOCKS} OR (u.deferred AND x.dynamic AND x.state NOT IN (14, 16))),
    prod AS (SELECT d.source AS producer, d.sink AS file, st.state FROM dependency d JOIN st ON st.node = d.source),
    dead AS (SELECT DISTINCT f.node AS i, n.label, f.state, n.detached FROM fb JOIN file f ON f.node = fb.file JOIN node n ON n.i = fb.file WHERE fb.file NOT IN (SELECT file FROM prod WHERE state = 24 OR producer IN (SELECT i FROM u))),
    ua AS (SELECT i AS node, arg_min(anc, depth) AS anc FROM anc2 WHERE NOT (state IN (22, 23) AND holding = 0) AND i IN (SELECT i FROM u WHERE unsafe) GROUP BY 1),
    sh AS (SELECT * FROM ({SHORT}) s WHERE node IN (SELECT i FROM u)),
    sb AS (SELECT p.producer AS src, fb.step AS dst FROM prod p JOIN fb ON fb.file = p.file WHERE p.producer IN (SELECT i FROM u) UNION SELECT anc, node FROM ua WHERE anc IN (SELECT i FROM u)),
    seed AS (SELECT DISTINCT 0 AS root_kind, CAST(fb.file AS STRING) AS root, fb.step FROM fb WHERE fb.file IN (SELECT i FROM dead) UNION SELECT 1, name, node FROM sh),
    cand AS (SELECT fb.step, 0 AS kind, CAST(fb.file AS STRING) AS src, dead.label AS l FROM fb JOIN dead ON dead.i = fb.file
        UNION ALL SELECT node, 1, name, name FROM sh
        UNION ALL SELECT fb.step, 2, CAST(p.producer AS STRING), n.label FROM fb JOIN prod p ON p.file = fb.file AND p.state = 24 JOIN node n ON n.i = p.producer
        UNION ALL SELECT ua.node, 2, CAST(ua.anc AS STRING), n.label FROM ua JOIN st ON st.node = ua.anc AND st.state = 24 JOIN node n ON n.i = ua.anc
        UNION ALL SELECT i, 3, CAST(i AS STRING), '' FROM u WHERE deferred AND i NOT IN (SELECT step FROM fb)
        UNION ALL SELECT ua.node, 4, CAST(ua.anc AS STRING), '' FROM ua JOIN st ON st.node = ua.anc AND st.state <> 24 WHERE ua.anc NOT IN (SELECT i FROM u)
        UNION ALL SELECT sb.dst, 6, CAST(sb.src AS STRING), n.label FROM sb JOIN node n ON n.i = sb.src),
    blk AS (SELECT step, kind, src FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY kind, l, lpad(src, 20, '0')) AS k FROM cand) c WHERE k = 1
        UNION ALL SELECT i, 5, CAST(i AS STRING) FROM u WHERE i NOT IN (SELECT step FROM cand)),
    att AS (SELECT step, kind AS root_kind, src AS root FROM blk WHERE kind <> 6 UNION ALL SELECT b.step, att.root_kind, att.root FROM att JOIN blk b ON b.kind = 6 AND b.src = CAST(att.step AS STRING)),
    roots AS (SELECT 0 AS root_kind, CAST(i AS STRING) AS root FROM dead UNION SELECT 1, name FROM sh),
    rk AS (SELECT r.root_kind, r.root, count(a.step) AS n FROM roots r LEFT JOIN att a ON a.root_kind = r.root_kind AND a.root = r.root GROUP BY 1, 2),
    pool AS (SELECT root_kind, root FROM (SELECT *, row_number() OVER (PARTITION BY root_kind ORDER BY n DESC, CASE WHEN root_kind = 0 THEN lpad(root, 20, '0') ELSE root END) AS k FROM rk) p WHERE k <= 20),
    far AS (SELECT s.root_kind, s.root, s.step AS i FROM seed s JOIN pool p ON p.root_kind = s.root_kind AND p.root = s.root UNION SELECT far.root_kind, far.root, sb.dst FROM far JOIN sb ON sb.src = far.i),
    exact AS (SELECT p.root_kind, p.root, count(far.i) AS nblocked FROM pool p LEFT JOIN far ON far.root_kind = p.root_kind AND far.root = p.root GROUP BY 1, 2)"""


#: The latest analysis, as its stages are stored and many queries read them.
_ANALYSED: list[tuple[Frames, P.Pending]] = []


def analysed(g: Frames) -> P.Pending:
    if not _ANALYSED or _ANALYSED[0][0] is not g:
        _ANALYSED[:] = [(g, P.analyse(g))]
    return _ANALYSED[0][1]


def forget() -> None:
    """Let the next query analyse anew."""
    _ANALYSED.clear()


def pend(name: str, run: Callable[[P.Pending], DataFrame], sql: str) -> None:
    add(name, lambda g: run(analysed(g)), f"WITH {PEND} {sql}")


pend("pend_total", lambda p: p.universe.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM u")
pend("pend_universe", lambda p: p.universe, "SELECT i, label, unsafe, deferred FROM u")
pend("pend_file_block", lambda p: p.file_block, "SELECT file, step FROM fb")
pend("pend_dead_file", lambda p: p.dead, "SELECT i, label, state, detached FROM dead")
pend("jn_exists_producer", lambda p: p.dead.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "SELECT state, count(*) AS n FROM dead GROUP BY 1")
pend("pend_seed_file", lambda p: P.seeds(p).filter(F.col("root_kind") == P.FILE), "SELECT root_kind, root, step FROM seed WHERE root_kind = 0")
pend("pend_seed_resource", lambda p: P.seeds(p).filter(F.col("root_kind") == P.RESOURCE), "SELECT root_kind, root, step FROM seed WHERE root_kind = 1")
pend("set_step_block", lambda p: p.step_block, "SELECT src, dst FROM sb")
pend("set_union_all", lambda p: P.candidates(p).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM cand GROUP BY 1")
pend("win_primary_blocker", P.primary_blocker, "SELECT step, kind, src FROM blk")
pend("jn_anti_blocker", lambda p: P.primary_blocker(p).filter(F.col("kind") == P.RUNNABLE).select("step"), "SELECT step FROM blk WHERE kind = 5")
pend("gr_attribute", P.attribute, "SELECT step, root_kind, root FROM att")
pend("agg_pend_kind", lambda p: P.attribute(p).groupBy("root_kind").agg(F.count(F.lit(1)).alias("n")), "SELECT root_kind, count(*) AS n FROM att GROUP BY 1")
pend("agg_bucket", lambda p: P.buckets(p, P.attribute(p)), "SELECT a.root_kind, count(*) AS nblocked, min(u.label) AS example FROM u LEFT JOIN att a ON a.step = u.i GROUP BY 1")
pend("pend_cyclic", lambda p: p.universe.join(P.attribute(p), F.col("i") == F.col("step"), "left_anti").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("example")), "SELECT count(*) AS n, min(label) AS example FROM u WHERE i NOT IN (SELECT step FROM att)")
pend("top_rank_roots", lambda p: P.ranked_roots(p, P.attribute(p)), "SELECT root_kind, root, n FROM rk")
pend("gr_exact_counts", lambda p: P.exact_counts(p, P.ranked_roots(p, P.attribute(p)).filter(F.col("root_kind") == P.RESOURCE)), "SELECT root_kind, root, nblocked FROM exact WHERE root_kind = 1")
pend("top_display", lambda p: P.top_roots(p, P.FILE, P.attribute(p)), "SELECT root, nblocked FROM exact WHERE root_kind = 0 ORDER BY nblocked DESC, CAST(root AS BIGINT) LIMIT 10")
pend("top_inputs", P.blocking_inputs, "SELECT d.state, d.label AS path, d.detached, e.nblocked FROM (SELECT * FROM exact WHERE root_kind = 0 ORDER BY nblocked DESC, CAST(root AS BIGINT) LIMIT 10) e JOIN dead d ON CAST(d.i AS STRING) = e.root")
pend("top_resources", P.blocking_resources, "SELECT e.root AS name, max(s.units) AS units_needed, max(s.available) AS units_available, max(e.nblocked) AS nblocked FROM exact e JOIN sh s ON s.name = e.root WHERE e.root_kind = 1 GROUP BY 1")
pend("top_hidden", lambda p: P.hidden_counts(p), "SELECT r.root_kind, count(*) AS n_hidden, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS n_blocked FROM rk r LEFT JOIN (SELECT root_kind, root, row_number() OVER (PARTITION BY root_kind ORDER BY nblocked DESC, CASE WHEN root_kind = 0 THEN lpad(root, 20, '0') ELSE root END) AS k FROM exact) e ON e.root_kind = r.root_kind AND e.root = r.root AND e.k <= 10 WHERE e.root IS NULL GROUP BY 1")
pend("snk_pending", lambda p: P.report(p).select("section", "key", "detail", "count"), """,
    shown AS (SELECT * FROM (SELECT root_kind, root, nblocked, row_number() OVER (PARTITION BY root_kind ORDER BY nblocked DESC, CASE WHEN root_kind = 0 THEN lpad(root, 20, '0') ELSE root END) AS k FROM exact) e WHERE k <= 10),
    hid AS (SELECT r.root_kind, count(*) AS n, sum(r.n) AS b FROM rk r WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.root_kind = r.root_kind AND s.root = r.root) GROUP BY 1)
    SELECT 'inputs' AS section, CASE d.state WHEN 11 THEN 'UNDECLARED' WHEN 12 THEN 'UNCONFIRMED' WHEN 13 THEN 'MISSING' WHEN 14 THEN 'CONFIRMED' WHEN 15 THEN 'PLANNED' WHEN 16 THEN 'BUILT' WHEN 17 THEN 'OUTDATED' ELSE 'VOLATILE' END AS key,
        CASE WHEN d.detached THEN '(' || d.label || ')' ELSE d.label END AS detail, CAST(s.nblocked AS STRING) AS count FROM shown s JOIN dead d ON s.root_kind = 0 AND CAST(d.i AS STRING) = s.root
    UNION ALL SELECT 'resources', s.root, max(x.units) || ' needed, ' || coalesce(max(x.available) || ' available', 'none available'), CAST(max(s.nblocked) AS STRING) FROM shown s JOIN sh x ON s.root_kind = 1 AND x.name = s.root GROUP BY s.root
    UNION ALL SELECT CASE root_kind WHEN 0 THEN 'inputs' ELSE 'resources' END, '', '... and ' || n || CASE root_kind WHEN 0 THEN ' more input(s)' ELSE ' more resource(s)' END, CASE WHEN b > 0 THEN '≥ ' || b ELSE '' END FROM hid
    UNION ALL SELECT 'kinds', CASE root_kind WHEN 2 THEN 'failed' WHEN 3 THEN 'deferred' WHEN 4 THEN 'other' WHEN 5 THEN 'runnable' ELSE 'cyclic' END, min(u.label), CAST(count(*) AS STRING) FROM u LEFT JOIN att a ON a.step = u.i WHERE root_kind IS NULL OR root_kind IN (2, 3, 4, 5) GROUP BY root_kind""")
pend("pend_summary", P.summary, "SELECT (SELECT count(*) FROM u) AS n_pending, (SELECT count(*) FROM dead) AS n_inputs, (SELECT count(DISTINCT name) FROM sh) AS n_resources, (SELECT count(*) FROM att) AS n_attributed, (SELECT count(*) FROM u WHERE i NOT IN (SELECT step FROM att)) AS n_cyclic")

# Scheduling

DISPATCH = f"""WITH {ANC}, {NEED}, sf AS ({SAFE}), rd AS (SELECT node, node NOT IN (SELECT step FROM {INP} x WHERE {BLOCKS}) AS ready FROM step), fr AS ({FREE}),
    ds AS (SELECT s.node, n.label, s.has_hash, need.implied_need = 34 AS plan, need.tail_time / (1 + s.defer_count) AS weight FROM step s JOIN node n ON n.i = s.node JOIN need ON need.node = s.node JOIN sf ON sf.node = s.node JOIN rd ON rd.node = s.node JOIN fr ON fr.node = s.node
        WHERE s.state = 21 AND (sf.safe OR (s.has_hash AND sf.safe_ignoring_hold)) AND NOT s.deferred AND need.implied_need > 31 AND rd.ready AND NOT n.detached AND (s.has_hash OR fr.free))"""
add("flt_dispatch", lambda g: D.dispatchable(g).select("node", "label", "has_hash", "plan"), DISPATCH + " SELECT node, label, has_hash, plan FROM ds")
add("top_next_step", lambda g: D.next_steps(g), DISPATCH + " SELECT node, label, has_hash FROM ds ORDER BY has_hash DESC, plan DESC, weight DESC, node LIMIT 1")
add("agg_safe_min", lambda g: G.safety(g).groupBy("safe", "safe_ignoring_hold").agg(F.count(F.lit(1)).alias("n")), f"WITH {ANC}, sf AS ({SAFE}) SELECT safe, safe_ignoring_hold, count(*) AS n FROM sf GROUP BY 1, 2")
add("agg_need_max", lambda g: G.need_and_tail(g).groupBy("implied_need").agg(F.count(F.lit(1)).alias("n"), F.max("tail_time").alias("tail_time")), f"WITH {NEED} SELECT implied_need, count(*) AS n, max(tail_time) AS tail_time FROM need GROUP BY 1")
add("job_kind", D.job_kind, f"SELECT s.node, CASE WHEN s.has_hash AND s.node IN (SELECT step FROM {INP} x WHERE dynamic AND state NOT IN (14, 16)) THEN 'ValidateDynamicJob' ELSE 'RunJob' END AS job FROM step s WHERE s.state = 21")
add("has_bad_dynamic", D.bad_dynamic, f"SELECT DISTINCT step AS node FROM {INP} x WHERE dynamic AND state NOT IN (14, 16)")
add("availability", lambda g: g.file.select("node", D.availability(F.col("state")).alias("availability")), "SELECT node, CASE WHEN state IN (14, 16) THEN 'AVAILABLE' WHEN state = 12 THEN 'UNCONFIRMED' ELSE 'UNAVAILABLE' END AS availability FROM file")
add("exec_class", lambda g: g.step.select("node", D.run_outcome(F.col("node") % 11 == 0, F.col("node") % 7 == 0, F.col("node") % 5 == 0, F.col("node") % 2 == 1).alias("outcome")), "SELECT node, CASE WHEN node % 11 = 0 THEN 'FAIL' WHEN node % 7 = 0 OR node % 5 = 0 THEN 'DEFER' WHEN node % 2 = 1 THEN 'SUCCEED' ELSE 'FAIL' END AS outcome FROM step")
add("skip_decision", lambda g: D.skip_decision(g.step.select("node", (F.col("node") % 3).alias("inp_digest"), (F.col("node") % 5).alias("out_digest")), g.step.select("node", F.lit(0).alias("inp_digest"), F.lit(0).alias("out_digest"))), "SELECT node, node % 15 = 0 AS skip FROM step")
add("hold_release", lambda g: D.holds(g.sqllog.select(F.col("transaction_i").alias("node"), F.when(F.col("execute_i") % 2 == 0, 1).otherwise(-1).alias("delta"))), "SELECT transaction_i AS node, CAST(sum(CASE WHEN execute_i % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS open, sum(CASE WHEN execute_i % 2 = 0 THEN 1 ELSE -1 END) > 0 AS holding FROM sqllog GROUP BY 1")
add("step_info", D.step_info, f"SELECT s.node, coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM {INP} x WHERE x.step = s.node AND NOT dynamic), '') AS inp, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM env_var e WHERE e.node = s.node AND NOT dynamic), '') AS env FROM step s")
add("missing_targets", lambda g: C.missing_target_dirs(g, g.target_dir.select("path").unionByName(R.watch_dirs(g).select(F.col("dir").alias("path")))), f"SELECT DISTINCT d.path FROM (SELECT path FROM target_dir UNION ALL SELECT label FROM node WHERE kind = 'st' AND NOT detached UNION ALL SELECT CASE WHEN regexp_extract(label, '^(.*/)', 1) = '' THEN './' ELSE regexp_extract(label, '^(.*/)', 1) END FROM node JOIN file ON node = i WHERE NOT detached AND state <> 18) d WHERE d.path NOT IN (SELECT regexp_extract(label, '^(.*/)', 1) FROM {OUT} o WHERE NOT detached AND state <> 18) AND d.path NOT IN (SELECT regexp_extract(label, '^([^/]*/)', 1) FROM {OUT} o WHERE NOT detached AND state <> 18)")
add("usage_sum", lambda g: D.usage_sum(g.sqllog.select(F.col("duration_ns").alias("utime"), F.col("nrecords").alias("stime"), F.col("start_ns").alias("wtime"))), "SELECT CAST(sum(duration_ns) AS BIGINT) AS utime, CAST(sum(nrecords) AS BIGINT) AS stime, max(start_ns) AS wtime FROM sqllog")
add("peak_mem", lambda g: L.peak(g.sqllog, "transaction_i", "duration_ns"), "SELECT transaction_i, max(duration_ns) AS peak FROM sqllog GROUP BY 1")
_RULES = [("src1/en", True), ("src1", False), ("src2/", True), ("", False)]
add("path_filter", lambda g: g.path.select("path", L.first_rule(F.col("path"), _RULES).alias("keep")), "SELECT path, CASE WHEN starts_with(path, 'src1/en') THEN true WHEN starts_with(path, 'src1') THEN false WHEN starts_with(path, 'src2/') THEN true ELSE false END AS keep FROM path")
add("config_merge", lambda g: L.merged_config(g.sqllog.select((F.col("query_i") % 9).alias("key"), F.col("duration_ns").alias("value"), F.col("execute_i").alias("priority"))), "SELECT query_i % 9 AS key, arg_max(duration_ns, execute_i) AS value FROM sqllog GROUP BY 1")
add("log_findings", lambda g: L.findings(g.sqllog_index.select(F.col("plan").alias("line")).distinct(), [("sort", "B-TREE"), ("scan", "^SCAN")]), "SELECT DISTINCT plan AS line, CASE WHEN plan LIKE '%B-TREE%' THEN 'sort' WHEN plan LIKE 'SCAN%' THEN 'scan' END AS label FROM sqllog_index WHERE plan LIKE '%B-TREE%' OR plan LIKE 'SCAN%'")
add("perf_merge", lambda g: L.merged_profile(g.sqllog.select((F.col("query_i") % 3).alias("dso"), F.col("query_i").alias("symbol"), F.col("nrecords").alias("pct"), F.lit(200).alias("total"))).select("dso", "symbol", F.col("time").cast("long").alias("time")), "SELECT query_i % 3 AS dso, query_i AS symbol, CAST(sum(nrecords) * 2 AS BIGINT) AS time FROM sqllog GROUP BY 1, 2")
add(
    "prof_rank",
    lambda g: L.ranked_profile(g.sqllog.select((F.col("query_i") % 12).alias("f"), F.col("duration_ns").alias("own"), (F.col("duration_ns") + F.col("nrecords")).alias("cumulative")), "own", 8).select("f", "own", "cumulative", F.round("running_pct", 6).alias("running_pct")),
    "WITH q AS (SELECT query_i % 12 AS f, CAST(sum(duration_ns) AS BIGINT) AS own, CAST(sum(duration_ns + nrecords) AS BIGINT) AS cumulative FROM sqllog GROUP BY 1), r AS (SELECT *, sum(own) OVER (ORDER BY own DESC, f) AS run, sum(own) OVER () AS whole, row_number() OVER (ORDER BY own DESC, f) AS k FROM q) SELECT f, own, cumulative, round(100.0 * run / whole, 6) AS running_pct FROM r WHERE k <= 8",
)


def _calls(g: Frames) -> DataFrame:
    q = g.sqllog_index.select(F.col("query_i").alias("f"))
    return L.attributed_frames(q.select("f", (F.floor(F.col("f") / 2)).alias("caller"), F.lit(2).alias("time")).unionByName(q.select("f", F.lit(22).cast("long").alias("caller"), F.lit(1).alias("time"))), q.filter("f IN (1, 3, 5)").select("f"))


add("prof_attribute", _calls, "WITH w AS (SELECT query_i AS f, query_i AS a, 0 AS k FROM sqllog_index UNION ALL SELECT f, a // 2, k + 1 FROM w WHERE a NOT IN (1, 3, 5) AND k < 10) SELECT f, a AS \"to\" FROM w WHERE a IN (1, 3, 5)")
add(
    "browse_node",
    lambda g: R.browse(g, 15),
    """SELECT 'node' AS part, n.i, n.kind, n.label, s.state FROM node n LEFT JOIN step s ON s.node = n.i WHERE n.i = 15
    UNION ALL SELECT 'creator', c.i, c.kind, c.label, s.state FROM node n JOIN node c ON c.i = n.creator LEFT JOIN step s ON s.node = c.i WHERE n.i = 15
    UNION ALL SELECT 'product', n.i, n.kind, n.label, CASE n.kind WHEN 'file' THEN f.state ELSE s.state END FROM node n LEFT JOIN file f ON f.node = n.i LEFT JOIN step s ON s.node = n.i WHERE n.creator = 15 AND n.i <> 15
    UNION ALL SELECT 'source', n.i, n.kind, n.label, CASE n.kind WHEN 'file' THEN f.state ELSE s.state END FROM dependency d JOIN node n ON n.i = d.source LEFT JOIN file f ON f.node = n.i LEFT JOIN step s ON s.node = n.i WHERE d.sink = 15
    UNION ALL SELECT 'sink', n.i, n.kind, n.label, CASE n.kind WHEN 'file' THEN f.state ELSE s.state END FROM dependency d JOIN node n ON n.i = d.sink LEFT JOIN file f ON f.node = n.i LEFT JOIN step s ON s.node = n.i WHERE d.source = 15""",
)

# Streams, as batches


def _changes(g: Frames) -> DataFrame:
    from .streaming.changes import net_changes

    return net_changes(g.change)




def _phases(g: Frames) -> DataFrame:
    from .streaming.changes import relevant_net

    return relevant_net(g, _patterns(g, PATTERNS))


add(
    "str_phase",
    _phases,
    """WITH f AS (SELECT label AS path, state FROM node JOIN file ON node = i WHERE NOT detached), m AS (SELECT c.*, CASE WHEN state IS NULL THEN regexp_full_match(c.path, 'supplier/1[^/]*/[^/]*\\.dat|supplier/2[^/]/[^/]+\\.dat|(.*/|)9[^/]*\\.dat')
        WHEN during_build THEN state IN (13, 14) ELSE state NOT IN (15, 18) END AS relevant FROM change c LEFT JOIN f ON f.path = c.path)
    SELECT path, arg_max(change, seq + CASE WHEN during_build THEN 0 ELSE 1000000000000 END) AS change FROM m WHERE relevant GROUP BY 1""",
)
add("str_changes", _changes, "SELECT path, arg_max(change, seq) AS change FROM change GROUP BY 1")


def _first_jobs(g: Frames) -> DataFrame:
    from .streaming.changes import first_jobs

    return first_jobs(g.change)


add("str_dedupe", _first_jobs, "SELECT path, min(seq) AS seq FROM change GROUP BY 1")


def _effect(g: Frames) -> DataFrame:
    from .streaming.changes import glob_effect

    p = _halves(g)[0]
    return glob_effect(p.filter("doc % 4 = 0").select("path"), _halves(g)[1].select("path"), p.select("path"))


add("str_glob_delta", _effect, HALVES + " SELECT path, 'deleted' AS effect FROM old WHERE doc % 4 = 0 UNION ALL SELECT path, 'added' FROM new WHERE path NOT IN (SELECT path FROM old) AND path NOT IN (SELECT path FROM old WHERE doc % 4 = 0)")


def _unchanged(g: Frames) -> DataFrame:
    from .streaming.changes import unchanged_dropped

    old, new = _halves(g)
    net = old.select("path", F.when(F.col("doc") % 4 == 0, S.DELETED).otherwise(S.UPDATED).alias("change"))
    return unchanged_dropped(net, old, new)


add("str_unchanged", _unchanged, HALVES + " SELECT o.path, CASE WHEN o.doc % 4 = 0 THEN 42 ELSE 41 END AS change FROM old o LEFT JOIN new n ON n.path = o.path WHERE o.doc % 4 = 0 OR n.digest IS DISTINCT FROM o.digest")

# Scalar functions

add("fn_digest", lambda g: g.node.select("i", T.step_digest(F.array("kind", "label")).alias("digest")), "SELECT i, sha256(length(kind) || ':' || kind || length(label) || ':' || label) AS digest FROM node")
add("fn_resources", lambda g: g.step_resource.select("node", T.resources(F.concat("name", F.lit(":"), F.col("units").cast("string"), F.lit(",x")))[F.col("name")].alias("units")), "SELECT node, units FROM step_resource")
add("fn_parent", lambda g: g.node.select("i", R.parent_dir(F.col("label")).alias("dir")), "SELECT i, CASE WHEN regexp_extract(regexp_replace(label, '/$', ''), '^(.*/)', 1) = '' THEN './' ELSE regexp_extract(regexp_replace(label, '/$', ''), '^(.*/)', 1) END AS dir FROM node")

# Patterns that steps have registered

REGISTERED = "reg AS (SELECT g.i AS nglob, g.pattern, n.label AS step FROM nglob g JOIN node n ON n.i = g.node WHERE NOT n.detached)"


VIOLATIONS = f"""{REGISTERED}, f AS (SELECT label AS path, state FROM node JOIN file ON node = i WHERE NOT detached AND kind = 'file'),
    m AS (SELECT reg.step, reg.pattern, x.path, f.state FROM reg JOIN nglob_match x ON x.nglob = reg.nglob LEFT JOIN f ON f.path = x.path),
    st AS (SELECT label FROM node WHERE kind = 'st' AND NOT detached),
    vi AS (SELECT step, pattern, path, state, state IS NOT NULL AS is_error FROM m WHERE state NOT IN (12, 13, 14) OR (state IS NULL AND (path LIKE '%/' OR path IN (SELECT path FROM path WHERE regexp_matches(path, '[1245780]\\.txt$')))
        AND NOT EXISTS (SELECT 1 FROM st WHERE starts_with(CASE WHEN m.path LIKE '%/' THEN m.path ELSE m.path || '/' END, st.label))
        AND NOT (path LIKE '%/' AND (EXISTS (SELECT 1 FROM st WHERE starts_with(st.label, m.path)) OR EXISTS (SELECT 1 FROM f WHERE f.state IN (12, 13, 14) AND starts_with(f.path, m.path))))))"""


def _present(g: Frames) -> DataFrame:
    files = g.path.filter(F.col("path").rlike(r"[1245780]\.txt$")).select("path")
    return files.unionByName(g.nglob_match.filter("endswith(path, '/')").select("path").distinct())


add("glob_registrations", R.registrations, f"WITH {REGISTERED} SELECT nglob, pattern, step FROM reg")
add("glob_violations", lambda g: R.glob_violations(g, _present(g)), f"WITH {VIOLATIONS} SELECT step, pattern, path, state, is_error FROM vi")
add("glob_severity", lambda g: R.violation_counts(g, _present(g)).groupBy("is_error", "state").agg(F.sum("n").alias("n")), f"WITH {VIOLATIONS} SELECT is_error, state, count(*) AS n FROM vi GROUP BY 1, 2")
add("agg_violation_group", lambda g: R.grouped_violations(R.violation_counts(g, _present(g))), f"WITH {VIOLATIONS} SELECT step, pattern, count(*) AS n, CAST(sum(is_error::INT) AS BIGINT) AS n_errors, min(path) AS first FROM vi GROUP BY 1, 2")

# Hashes


def _hashes(g: Frames) -> tuple[DataFrame, DataFrame]:
    """Stored hashes of all files, and what the disk shows: some gone, new, touched, or changed in content or mode."""
    f = g.file.select("node", "digest").join(g.node.select(F.col("i").alias("node"), F.col("label").alias("path")), "node")
    old = f.select("path", "digest", F.lit(33188).alias("mode"), (F.col("node") % 1000).alias("size"), F.lit(5.5).alias("mtime"), F.col("node").alias("inode"))
    n = F.col("node")
    seen = f.filter("node % 17 <> 0 AND (digest IS NOT NULL OR node % 3 = 0)").select(
        "path", F.when(n % 5 == 0, F.md5(F.lit("new").cast("binary"))).when(n % 13 == 0, F.lit("unread")).otherwise(F.coalesce("digest", F.lit("d"))).alias("digest"), F.when(n % 7 == 0, 33261).otherwise(33188).alias("mode"),
        (n % 1000).alias("size"), F.when((n % 5 == 0) | (n % 11 == 0), 6.5).otherwise(5.5).alias("mtime"), n.alias("inode"),
    )
    return old, seen


REFRESH = """f AS (SELECT f.node, f.digest AS d, n.label AS path, f.node % 17 <> 0 AND (f.digest IS NOT NULL OR f.node % 3 = 0) AS there,
        CASE WHEN f.node % 5 = 0 THEN md5('new') WHEN f.node % 13 = 0 THEN 'unread' ELSE coalesce(f.digest, 'd') END AS s, CASE WHEN f.node % 7 = 0 THEN 33261 ELSE 33188 END AS m, f.node % 5 = 0 OR f.node % 11 = 0 OR f.node % 7 = 0 AS looked FROM file f JOIN node n ON n.i = f.node),
    h AS (SELECT *, CASE WHEN d IS NOT NULL AND NOT looked THEN d ELSE s END AS now FROM f),
    r AS (SELECT path, d, CASE WHEN NOT there THEN CASE WHEN d IS NULL THEN 'missing' ELSE 'vanished' END WHEN d IS NULL THEN 'appeared' WHEN d = now AND m = 33188 THEN 'same' ELSE 'changed' END AS change,
        CASE WHEN there THEN now END AS digest, CASE WHEN there THEN m END AS mode, CASE WHEN there THEN node % 1000 END AS size FROM h)"""
add("hash_refresh", lambda g: C.hash_refresh(*_hashes(g)), f"WITH {REFRESH} SELECT path, change, digest, mode, size FROM r")
add(
    "hash_messages",
    lambda g: C.hash_messages(_hashes(g)[0], C.hash_refresh(*_hashes(g))),
    f"WITH {REFRESH} SELECT path, CASE change WHEN 'vanished' THEN 'vanished' ELSE 'changed (' || concat_ws(', ', CASE WHEN d[1:8] <> digest[1:8] THEN 'digest ' || d[1:8] || ' -> ' || digest[1:8] END, CASE WHEN mode <> 33188 THEN 'mode 33188 -> ' || mode END) || ')' END AS message FROM r WHERE change IN ('changed', 'vanished')",
)


def _usage(g: Frames) -> DataFrame:
    one = g.sqllog.groupBy(F.col("query_i").alias("job")).agg(F.sum("duration_ns").alias("utime"), F.sum("nrecords").alias("stime"), F.max("start_ns").alias("wtime"), F.min("start_ns").alias("w0"))
    who = F.explode(F.array(F.lit("self"), F.lit("children"))).alias("who")
    after = one.select("job", who, "utime", "stime", "wtime")
    before = one.select("job", who, (F.col("job") * 10).alias("utime"), F.lit(1).alias("stime"), F.col("w0").alias("wtime"))
    return D.usage_diff(before, after)


add("usage_diff", _usage, "SELECT query_i AS job, CAST(2 * (sum(duration_ns) - 10 * query_i) AS BIGINT) AS utime, CAST(2 * (sum(nrecords) - 1) AS BIGINT) AS stime, max(start_ns) - min(start_ns) AS wtime FROM sqllog GROUP BY query_i")
add(
    "stepinfo_filter",
    lambda g: D.stepinfo_filter(R.inputs_of(g).groupBy(F.col("step").cast("string").alias("command")).agg(F.collect_list("label").alias("inp")), "inp", Pattern("supplier/${*s}/${*p}[05].dat")).select("command", "path", F.array_join("captures", "|").alias("captures")),
    f"SELECT DISTINCT CAST(step AS STRING) AS command, label AS path, regexp_extract(label, '^supplier/([^/]+)/', 1) || '|' || regexp_extract(label, '/([^/]*)[05]\\.dat$', 1) AS captures FROM {INP} x WHERE regexp_full_match(label, 'supplier/[^/]+/[^/]*[05]\\.dat')",
)
add(
    "static_classify",
    lambda g: C.static_classified(R.pattern_matches(g).unionByName(g.path.select(F.col("path").alias("argument"), F.lit(None).cast("string").alias("match"))), g.path.filter("digest < '8'").select("path").unionByName(g.node.filter("kind IN ('file', 'st')").select(F.col("label").alias("path")))),
    """WITH a AS (SELECT rtrim(path, '/') AS path FROM nglob_match WHERE nglob IN (SELECT i FROM nglob) UNION SELECT path FROM path),
    p AS (SELECT rtrim(path, '/') AS path, bool_or(path LIKE '%/') AS folder FROM (SELECT path FROM path WHERE digest < '8' UNION ALL SELECT label FROM node WHERE kind IN ('file', 'st')) x GROUP BY 1)
    SELECT DISTINCT 'pattern' AS kind, pattern AS path FROM nglob UNION ALL SELECT CASE WHEN folder THEN 'tree' WHEN folder IS NULL THEN 'absent' ELSE 'file' END, CASE WHEN folder THEN a.path || '/' ELSE a.path END FROM a LEFT JOIN p ON p.path = a.path""",
)

# Functions by name, cases, kinds of nodes

CALLS = Calls()


@CALLS.register
def shout(argument: pd.Series) -> pd.Series:
    return argument.str.upper()


@CALLS.register
def measure(argument: pd.Series) -> pd.Series:
    return argument.str.len().astype(str)


def _called(g: Frames) -> DataFrame:
    steps = g.node.filter("kind = 'step'")
    return CALLS.run(steps.select(F.col("i").alias("node"), F.when(F.col("i") % 2 == 0, "shout").otherwise("measure").alias("function"), F.col("label").alias("argument")))


def _cases(g: Frames) -> DataFrame:
    scripts = g.node.filter("kind = 'step'").select(F.col("i").alias("node"), F.split("label", " ")[0].alias("script"), F.concat(F.lit("run {} of "), F.col("label")).alias("template"))
    cases = g.joblog.select("description").distinct().select(F.explode(F.array(F.lit("order"), F.lit("nation"))).alias("script"), F.col("description").alias("case"))
    return over_cases(scripts, cases)


def _kinds(g: Frames) -> DataFrame:
    kinds = Kinds()
    node = g.node.withColumn("kind", F.when(F.col("label").startswith("nation "), "place").otherwise(F.col("kind")))
    kinds.add("place", g.node.filter("i % 10 IN (2, 3) AND i <> 13").select(F.col("i").alias("node"), F.col("label").alias("name")), "node BIGINT, name STRING")
    return kinds.violations(g.with_(node=node))


add("udf_call", _called, "SELECT i AS node, CASE WHEN i % 2 = 0 THEN upper(label) ELSE CAST(length(label) AS STRING) END AS result FROM node WHERE kind = 'step'")
add("udf_script", _cases, "WITH c AS (SELECT s.script, d.description AS case_ FROM (SELECT DISTINCT description FROM joblog) d, (VALUES ('order'), ('nation')) s(script)) SELECT i AS node, case_ AS \"case\", 'run ' || case_ || ' of ' || label AS argument FROM node JOIN c ON kind = 'step' AND string_split(label, ' ')[1] = c.script")
add("udf_node", _kinds, "SELECT 'place' AS kind, 'no node' AS rule, i FROM node WHERE i % 10 = 2 UNION ALL SELECT 'place', 'no row', i FROM node WHERE i = 13")
