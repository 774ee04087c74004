"""Queries against DuckDB on the smallest tables, sources and streams."""

import json

import duckdb
import pytest

import __spark_entry__
from graphloom import queries as Q
from graphloom.functions import states as S
from graphloom.sources import frames as R
from graphloom.sources.derived import TABLES
from graphloom.streaming.changes import read_changes, watch

from .graphs import Builder

SF = "/root/testdata/sf0.001"
SLOW = ("gr_", "top_", "agg_need_max", "flt_dispatch")
KEPT = ("gr_safe", "gr_mark_pending", "gr_consistency", "gr_leaf_layers", "gr_would_cycle", "snk_pending", "top_hidden", "top_dips", "top_jobs")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if not n.startswith(SLOW) or n in KEPT])
def test_query_equals_sql(spark, duck, name):
    df, r = Q.queries()[name](spark, SF), duck.sql(Q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    got = sorted(tuple(map(normal, x)) for x in df.select(*(f"`{c}`" for c in cols)).collect())
    assert got == sorted(tuple(normal(x[k]) for k in at) for x in r.fetchall())


def test_nothing_is_left(spark, tmp_path, monkeypatch):
    from graphloom.plans import stored

    monkeypatch.setattr(stored, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert stored.stored(spark.range(3)).count() == 3
    assert list((tmp_path / "shared" / "graphloom").iterdir())
    stored.clean(spark)
    assert not (tmp_path / "shared" / "graphloom").exists()


def test_every_query_has_sql():
    assert Q.QUERIES.keys() == Q.ORACLES.keys()
    assert Q.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_sources_round_trip(spark, tmp_path):
    b = Builder()
    b.file("a")
    b.step("s", inp=["a"])
    b.rows["joblog"] += [(5, 1, "START", "a, b"), (9, 1, "END", "a, b")]
    g = b.frames(spark)
    R.write_graph(g, f"{tmp_path}/g")
    assert sorted(R.read_graph(spark, f"{tmp_path}/g")["node"].collect()) == sorted(g.node.collect())
    R.write_joblog(g.joblog, f"{tmp_path}/jobs")
    assert sorted(R.read_joblog(spark, f"{tmp_path}/jobs").collect()) == sorted(g.joblog.collect())
    (tmp_path / "one.json").write_text(json.dumps([{"command": "cp a b", "inp": ["a"], "out": ["b"]}]))
    assert [r.inp for r in R.read_stepinfo(spark, f"{tmp_path}/one.json").collect()] == [["a"]]
    (tmp_path / "v1.json").write_text('{"x": 1, "y": "a"}')
    (tmp_path / "v2.json").write_text('{"x": 2}')
    assert {r.name: r.value for r in R.read_variables(spark, f"{tmp_path}/v1.json", f"{tmp_path}/v2.json").collect()} == {"x": "2", "y": "a"}
    assert {r.path.removeprefix(f"file:{tmp_path}/") for r in R.list_paths(spark, str(tmp_path)).select("path").collect()} >= {"one.json", "v1.json", "g/", "g/node/"}
    assert not [r for r in R.list_paths(spark, str(tmp_path)).collect() if r.path.removeprefix("file:").rstrip("/") in (str(tmp_path), str(tmp_path.parent))]
    R.write_variables(spark.createDataFrame([("b", "2"), ("a", '"x"'), ("n", None)], "name string, value string"), f"{tmp_path}/v3")
    part = next(x for x in (tmp_path / "v3").iterdir() if x.name.startswith("part-") and x.stat().st_size)
    assert json.loads(part.read_text()) == {"a": "x", "b": 2, "n": None}
    import hashlib

    assert {r.path.rsplit("/", 1)[1]: r.digest for r in R.digests(spark, str(tmp_path)).collect()}["v2.json"] == hashlib.sha256((tmp_path / "v2.json").read_bytes()).hexdigest()


def test_change_stream(spark, tmp_path):
    b = Builder()
    for n in ("d/x", "d/y", "e"):
        b.file(n)
    g = b.frames(spark)
    (tmp_path / "in").mkdir()
    events = [(1, "d/x", S.UPDATED), (2, "d/", S.DELETED_PARENT), (3, "d/y", S.UPDATED), (4, "e", S.DELETED), (5, "e", S.UPDATED)]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"seq": s, "path": p, "change": c, "during_build": False}) for s, p, c in events))
    seen = {}
    query = watch(read_changes(spark, f"{tmp_path}/in"), g, lambda df, n: seen.update({r.path: r.change for r in df.collect()}), f"{tmp_path}/cp")
    query.awaitTermination(60)
    assert seen == {"d/x": S.DELETED, "d/y": S.UPDATED, "e": S.UPDATED}


def test_stream_judges_by_phase(spark, tmp_path):
    """What was seen while building is replayed first and must be a static file; the rest follows."""
    from graphloom.functions.patterns import Pattern

    b = Builder()
    b.file("made", S.BUILT)
    b.file("static", S.CONFIRMED)
    g = b.frames(spark)
    (tmp_path / "in").mkdir()
    events = [(9, "made", S.UPDATED, True), (8, "static", S.DELETED, True), (1, "static", S.UPDATED, False), (2, "made", S.DELETED, False), (3, "x.dat", S.UPDATED, True), (4, "other", S.UPDATED, False)]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"seq": s, "path": p, "change": c, "during_build": d}) for s, p, c, d in events))
    patterns = spark.createDataFrame([(Pattern("*.dat").regex(), Pattern("*.dat").base())], "regex string, base string")
    seen = {}
    query = watch(read_changes(spark, f"{tmp_path}/in"), g, lambda df, n: seen.update({r.path: r.change for r in df.collect()}), f"{tmp_path}/cp", patterns, "200 milliseconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == {"made": S.DELETED, "static": S.UPDATED, "x.dat": S.UPDATED}


def test_registries(spark):
    import pandas as pd

    from graphloom.functions.registry import Calls, Kinds

    calls = Calls()

    @calls.register
    def twice(argument: pd.Series) -> pd.Series:
        return argument + argument

    with pytest.raises(ValueError):
        calls.register(twice)
    steps = spark.createDataFrame([(1, "twice", "a"), (2, "twice", None)], "node long, function string, argument string")
    assert {r.node: r.result for r in calls.run(steps).collect()} == {1: "aa", 2: None}
    assert calls.run(steps.limit(0)).count() == 0
    with pytest.raises(Exception, match="no function"):
        calls.run(steps.selectExpr("node", "'nope' AS function", "argument")).collect()
    kinds, frame = Kinds(), spark.createDataFrame([(1, "x")], "node long, name string")
    for kind, schema in (("file", "node BIGINT, name STRING"), ("own", "node BIGINT, other STRING")):
        with pytest.raises(ValueError):
            kinds.add(kind, frame, schema)
    kinds.add("own", frame, "node BIGINT, name STRING")
    assert [(r.rule, r.i) for r in kinds.violations(Builder().frames(spark)).collect()] == [("no node", 1)]
