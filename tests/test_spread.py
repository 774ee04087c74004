"""Matches of which one pattern or path has very many."""

import random

from graphloom.functions import states as S
from graphloom.operators import pending, recursive, relational
from graphloom.plans import fixpoint, spread
from graphloom.plans.stored import stored, stored_by
from graphloom.sources.derived import frames

from .graphs import Builder

SF = "/root/testdata/sf0.001"


def test_hot_keys_keep_their_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 1), ("c", 2), ("x", 3)], "k string, v long")
    known = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("d", 4)], "k string, w long")
    want = sorted([("a", k, 1) for k in range(9)] + [("b", 1, 2), ("b", 1, 3)])
    for hot, most in ((4, 9), (1, 9), (99, 9), (1, 2)):
        monkeypatch.setattr(spread, "HOT_ROWS", hot)
        monkeypatch.setattr(spread, "BROADCAST_ROWS", most)
        assert sorted(tuple(r) for r in spread.join_hot(rows, known, spread.counted(rows, "k"), "k").collect()) == want
    monkeypatch.setattr(spread, "HOT_ROWS", 4)
    _, (rest, _) = spread.split_hot(rows, known, spread.counted(rows, "k"), "k")
    assert {r.k for r in rest.collect()} == {"b", "c", "x"}


def test_folders_of_many_matches_are_dealt_out(spark):
    g = frames(spark, SF)
    parts = [len(p) for p in g.nglob_match.join(g.nglob.filter("pattern LIKE '%/**/*.txt'").hint("broadcast").select("i"), g.nglob_match.nglob == g.nglob.i).rdd.glom().collect()]
    assert max(parts) <= sum(parts) / 2


def test_violations_are_counted_without_their_rows(spark, monkeypatch):
    b = Builder()
    for k in range(5):
        b.step(f"s{k}", S.SUCCEEDED, detached=k == 4)
    for k in range(4):
        b.file(f"f{k}", (S.BUILT, S.PLANNED, S.CONFIRMED, S.BUILT)[k])
    b.rows["nglob"] = [(k, b.ids[f"s{k}"], f"p{k}") for k in range(5)] + [(9, b.ids["s0"], "p0")]
    b.rows["nglob_match"] = [(k, f) for k in range(5) for f in ("f0", "f1", "f2", "bare")] + [(9, "f3"), (9, "f0"), (1, "alone")]
    g = b.frames(spark)
    present = spark.createDataFrame([("bare",), ("alone",)], "path string")
    for hot in (1, 3, 99):
        monkeypatch.setattr(spread, "HOT_ROWS", hot)
        rows = relational.glob_violations(g, present)
        counts = relational.violation_counts(g, present)
        assert sorted(map(tuple, relational.grouped_violations(counts).collect())) == sorted(map(tuple, relational.violation_groups(rows).collect()))
        assert {r.step: (r.n, r.n_errors, r.first) for r in relational.grouped_violations(counts).collect()} == {"s0": (5, 4, "bare"), "s1": (4, 2, "alone"), "s2": (3, 2, "bare"), "s3": (3, 2, "bare")}
        assert {r.path for r in relational.matched_paths(g).collect()} == {"f0", "f1", "f2", "f3", "bare", "alone"}


def test_the_analysis_reads_what_it_made_once(spark):
    b = Builder()
    b.file("in", S.MISSING)
    b.step("a", inp=["in"])
    p = pending.analyse(b.frames(spark))
    for df in (p.g.dependency, p.g.file, p.g.step):
        assert df.inputFiles() and all("/graphloom/" in f for f in df.inputFiles())
    assert [(r.label, r.state) for r in p.dead.collect()] == [("in", S.MISSING)]


def test_chains_leave_files_out(spark):
    b = Builder()
    b.step("top", S.FAILED)
    b.file("odd", creator="top")
    b.step("below", creator="odd")
    b.file("out", S.PLANNED, creator="below")
    g = b.frames(spark)
    # a file that is above a step stays, others go
    assert {r.i for r in recursive._above_steps(g).collect()} == {b.ids[x] for x in ("top", "odd", "below")}
    assert {r.node: r.unsafe for r in recursive.chains(g).collect()} == {b.ids["top"]: None, b.ids["below"]: b.ids["top"]}


def test_buckets_are_not_shuffled_again(spark):
    rows = [(k % 7, k) for k in range(50)]
    df = stored_by(spark.createDataFrame(rows, "k long, v long"), "k")
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("graphloom_")]
    other = stored_by(spark.createDataFrame([(3, "x")], "k long, w string"), "k")
    both = df.hint("merge").join(other, "k")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, both.collect())) == sorted((k, v, "x") for k, v in rows if k == 3)


def test_the_analysis_shuffles_its_edges_once(spark):
    b = Builder()
    b.file("in", S.MISSING)
    b.step("a", inp=["in"])
    p = pending.analyse(b.frames(spark))
    assert p.g.dependency.columns == ["source", "sink", "dynamic"]
    makers = p.g.step.select("node").hint("merge").join(p.g.dependency, p.g.step.node == p.g.dependency.source)
    assert "Exchange" not in makers._jdf.queryExecution().executedPlan().toString()


def test_needs_are_swept_among_what_is_left(spark, monkeypatch):
    rng = random.Random(3)
    b = Builder()
    steps = [f"s{k}" for k in range(60)]
    need = {s: rng.choice([S.OPTIONAL, S.OPTIONAL, S.OPTIONAL, S.DEFAULT]) for s in steps}
    gone = {s for s in steps if rng.random() < 0.1}
    uses = {s: sorted({rng.randrange(k) for _ in range(rng.choice([0, 1, 2]))}) if k else [] for k, s in enumerate(steps)}
    for k, s in enumerate(steps):
        b.file(f"o{k}", S.PLANNED)
    for k, s in enumerate(steps):
        b.step(s, inp=[f"o{x}" for x in uses[s]], out=[f"o{k}"], need=need[s], detached=s in gone)
    b.rows["target_path"].append(("o5",))
    want = {s for k, s in enumerate(steps) if need[s] > S.OPTIONAL or k == 5}
    while True:
        more = {steps[x] for s in want - gone for x in uses[s]} - want
        if not more:
            break
        want |= more
    swept = []
    relax = fixpoint.relax
    monkeypatch.setattr(fixpoint, "relax", lambda values, *rest: (swept.extend(r.i for r in values.collect()), relax(values, *rest))[1])
    label = {v: k for k, v in b.ids.items()}
    got = [label[r.node] for r in recursive.needed(b.frames(spark), S.OPTIONAL).collect()]
    assert sorted(got) == sorted(want)
    assert {need[label[i]] for i in swept} <= {S.OPTIONAL}


def shuffled_again(df):
    """Whether the edges, which lie in buckets of their source, are shuffled before a join has left some out."""
    left = iter(df._jdf.queryExecution().executedPlan().toString().splitlines())
    for line in left:
        if "Exchange hashpartitioning" in line:
            below = next((x for x in left if any(w in x for w in ("Join", "FileScan", "LocalTableScan", "Scan ExistingRDD"))), "")
            if "FileScan" in below and "graphloom_" in below and "sink#" in below:
                return True
    return False


def test_needs_leave_most_edges_where_they_are(spark, monkeypatch):
    b = Builder()
    b.file("x", S.PLANNED)
    b.step("a", out=["x"], need=S.OPTIONAL)
    b.step("b", inp=["x"])
    b.step("gone", inp=["x"], detached=True)
    g = b.frames(spark)
    g = g.with_(dependency=stored_by(g.dependency.select("source", "sink", "dynamic"), "source"))
    plans = []
    monkeypatch.setattr(recursive, "stored", lambda df: (plans.append(shuffled_again(df)), stored(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.node for r in recursive.needed(g, S.OPTIONAL).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {b.ids[x] for x in ("a", "b", "gone")}
    assert plans and not any(plans)


def test_files_and_steps_meet_only_their_nodes(spark):
    plan = relational.outputs_of(frames(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    # the labels of customers' steps
    assert "concat(customer " not in plan and "concat(out/" in plan
    plan = pending.universe(frames(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(customer " in plan and "concat(out/" not in plan


def test_candidates_are_made_once(spark):
    b = Builder()
    b.file("in", S.MISSING)
    b.step("a", inp=["in"])
    b.step("free")
    p = pending.analyse(b.frames(spark))
    blockers = pending.primary_blocker(p)
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert leaves(blockers) == leaves(pending.candidates(p)) + 1
    assert sorted((r.step, r.kind, r.src) for r in blockers.collect()) == sorted([(b.ids["a"], pending.FILE, str(b.ids["in"])), (b.ids["free"], pending.RUNNABLE, str(b.ids["free"]))])
