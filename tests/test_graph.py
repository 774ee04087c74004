import pytest

from graphloom.functions import states as S
from graphloom.operators import changes, pending, recursive, relational, scheduling

from .graphs import Builder


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_missing_file_blocks_a_chain(spark):
    b = Builder()
    b.file("in", S.MISSING)
    for k in range(3):
        b.file(f"out{k}", S.PLANNED)
        b.step(f"step{k}", inp=["in" if k == 0 else f"out{k - 1}"], out=[f"out{k}"])
    p = pending.analyse(b.frames(spark))
    assert rows(pending.blocking_inputs(p)) == [(S.MISSING, "in", False, 3)]
    (s,) = pending.summary(p).collect()
    assert (s.n_pending, s.n_inputs, s.n_attributed, s.n_cyclic) == (3, 1, 3, 0)


def test_diamond_counts_are_exact(spark):
    b = Builder()
    b.file("A", S.MISSING)
    b.file("B", S.MISSING)
    for k in range(16):
        b.step(f"s{k}", inp=["A"] if k < 3 else ["B"] if k < 8 else ["A", "B"])
    p = pending.analyse(b.frames(spark))
    assert {(r.path, r.nblocked) for r in pending.blocking_inputs(p).collect()} == {("A", 11), ("B", 13)}
    assert pending.attribute(p).count() == 16


def test_a_cycle_is_left_over(spark):
    b = Builder()
    for k in range(2):
        b.file(f"f{k}", S.PLANNED)
    b.step("work0", inp=["f1"], out=["f0"])
    b.step("work1", inp=["f0"], out=["f1"])
    b.step("after", inp=["f0"])
    p = pending.Pending(*_without_needs(spark, b))
    assert {r.root_kind: r.nblocked for r in pending.buckets(p, pending.attribute(p)).collect()} == {None: 3}


def _without_needs(spark, b):
    """The analysis of a cyclic graph, whose tails would never settle."""
    g = b.frames(spark)
    u = spark.createDataFrame([(b.ids[n], n, False, False) for n in ("work0", "work1", "after")], "i long, label string, unsafe boolean, deferred boolean")
    block = pending.file_block(g, u)
    dead = pending.dead_files(g, u, block)
    unsafe = recursive.unsafe_ancestor(g)
    short = relational.short_resources(g)
    made = pending.producers(g).join(u.withColumnRenamed("i", "producer"), "producer", "left_semi").join(block, "file").selectExpr("producer AS src", "step AS dst")
    return g, u, block, dead, unsafe, short, made


def test_resources(spark):
    b = Builder()
    b.file("o", S.PLANNED)
    b.step("a", resources=[("ghost", 1)])
    b.step("b", resources=[("small", 2)], out=["o"])
    b.step("c", inp=["o"])
    b.rows["available_resource"].append(("small", 1))
    p = pending.analyse(b.frames(spark))
    assert rows(pending.blocking_resources(p)) == [("ghost", 1, None, 1), ("small", 2, 1, 2)]


def test_detached_input_and_failed_producer(spark):
    b = Builder()
    b.file("gone", S.PLANNED, creator=None, detached=True)
    b.file("o", S.PLANNED)
    b.step("bad", S.FAILED, out=["o"])
    b.step("x", inp=["gone"])
    b.step("y", inp=["o"])
    p = pending.analyse(b.frames(spark))
    assert rows(pending.blocking_inputs(p)) == [(S.PLANNED, "gone", True, 1)]
    assert {r.root_kind for r in pending.attribute(p).collect()} == {pending.FILE, pending.FAILED}


def test_nothing_pending(spark):
    p = pending.analyse(Builder().frames(spark))
    assert tuple(pending.summary(p).first()) == (0, 0, 0, 0, 0)
    assert pending.blocking_inputs(p).count() == 0


def test_holding_creators(spark):
    b = Builder()
    b.step("plan", S.SUCCEEDED, holding=1)
    b.step("child", creator="plan", has_hash=True)
    b.step("grandchild", creator="child")
    g = b.frames(spark)
    assert rows(recursive.safety(g)) == [(2, True, True), (3, False, True), (4, False, False)]
    assert rows(recursive.unsafe_ancestor(g)) == [(3, 2), (4, 3)]
    assert [r.label for r in scheduling.next_steps(g, 5).collect()] == ["child"]


def test_tails_and_needs(spark):
    b = Builder()
    b.file("a")
    b.file("b", S.PLANNED)
    b.step("first", need=S.OPTIONAL, duration=5, inp=["a"], out=["b"])
    b.step("second", need=S.PLAN, duration=7, inp=["b"])
    assert rows(recursive.need_and_tail(b.frames(spark))) == [(4, S.PLAN, 12), (5, S.PLAN, 7)]


def test_marking_stops_at_running_steps(spark):
    b = Builder()
    for n in ("a", "b", "c", "d"):
        b.file(n, S.BUILT)
    b.step("s1", S.SUCCEEDED, inp=["a"], out=["b"])
    b.step("s2", S.FAILED, inp=["b"], out=["c"])
    b.step("s3", S.RUNNING, inp=["c"], out=["d"])
    g = b.frames(spark)
    hit = recursive.mark_pending(g, spark.createDataFrame([(b.ids["a"],)], "i long"))
    assert {(b_, r.old, r.new) for r in hit.collect() for b_ in [next(n for n, i in b.ids.items() if i == r.node)]} == {("s1", S.SUCCEEDED, S.PENDING), ("b", S.BUILT, S.OUTDATED), ("s2", S.FAILED, S.PENDING), ("c", S.BUILT, S.OUTDATED)}


def test_cycles_are_found_before_edges_are_added(spark):
    b = Builder()
    b.file("a")
    b.file("b", S.PLANNED)
    b.step("s", inp=["a"], out=["b"])
    c = spark.createDataFrame([(b.ids["b"], b.ids["s"]), (b.ids["a"], b.ids["s"])], "source long, sink long")
    assert {(r.source, r.cyclic) for r in recursive.would_cycle(b.frames(spark), c).collect()} == {(b.ids["b"], True), (b.ids["a"], False)}


def test_detached_cycles_survive(spark):
    b = Builder()
    b.file("x", S.UNDECLARED, creator=None, detached=True)
    b.file("y", S.UNDECLARED, creator=None, detached=True)
    b.step("s", inp=["x"], out=["y"], creator=None, detached=True)
    b.step("loop", inp=["y"], out=["x"], creator=None, detached=True)
    b.file("lone", S.UNDECLARED, creator=None, detached=True)
    assert [r.i for r in recursive.deletable(b.frames(spark)).collect()] == [b.ids["lone"]]


def test_deletable_walks_detached_nodes_only(spark, monkeypatch):
    b = Builder()
    for k in range(20):
        b.file(f"f{k}")
        b.step(f"s{k}", inp=[f"f{k}"])
    b.file("used", detached=True, creator=None)
    b.file("far", detached=True, creator=None)
    b.step("old", inp=["far"], out=["used"], detached=True, creator=None)
    b.edge("used", "s3")
    b.file("lone", detached=True, creator=None)
    walked, reach = [], recursive.fixpoint.reach

    def watched(edges, seeds, *args):
        walked.extend((edges.count(), seeds.count()))
        return reach(edges, seeds, *args)

    monkeypatch.setattr(recursive.fixpoint, "reach", watched)
    assert [r.i for r in recursive.deletable(b.frames(spark)).collect()] == [b.ids["lone"]]
    assert walked == [2, 1]


@pytest.mark.parametrize(("cause", "state", "known", "new", "action"), S.TRANSITIONS)
def test_transitions_follow_their_rules(cause, state, known, new, action):
    expected = {("EXTERNAL", True): "updated", ("FAILED", True): "updated", ("SUCCEEDED", True): "completed", ("CONFIRMED", True): "completed"}
    assert action in (None, "deleted" if not known else expected[cause, known])


def test_unknown_transition_is_an_error(spark):
    b = Builder()
    b.file("a", S.VOLATILE)
    b.file("b", S.CONFIRMED)
    u = spark.createDataFrame([(2, "EXTERNAL", "d"), (3, "EXTERNAL", None)], "node long, cause string, digest string")
    assert {(r.node, r.new_state, r.ok) for r in changes.transitions(b.frames(spark), u).collect()} == {(2, None, False), (3, S.MISSING, True)}


def test_literal_prefixes(spark):
    df = spark.createDataFrame([("p_q%r\\s/x",), ("P_Q%R\\S/x",), ("pXq%r\\s/x",)], "label string")
    from pyspark.sql import functions as F

    assert [r.label for r in df.filter(S.like_prefix(F.col("label"), "p_q%r\\s/")).collect()] == ["p_q%r\\s/x", "P_Q%R\\S/x"]


def test_completion_counts_defers_in_a_row(spark):
    b = Builder()
    b.file("late", S.PLANNED)
    b.file("there", S.BUILT)
    for name, dynamic in (("ok", ()), ("bad", ()), ("waits", ("late",)), ("again", ("there",)), ("much", ("late",))):
        b.step(name, S.RUNNING, dynamic=dynamic, holding=1, has_hash=True)
    b.rows["step"] = [(*r[:5], {"ok": 3, "bad": 3, "waits": 1, "again": 1, "much": 2}[next(n for n, i in b.ids.items() if i == r[0])], *r[6:]) for r in b.rows["step"]]
    names = {i: n for n, i in b.ids.items()}
    results = [(b.ids[n], o) for n, o in (("ok", "SUCCEED"), ("bad", "FAIL"), ("waits", "DEFER"), ("again", "DEFER"), ("much", "DEFER"))]
    got = {names[r.node]: (r.state, r.deferred, r.defer_count, r.has_hash, r.holding) for r in changes.completed(b.frames(spark), spark.createDataFrame(results, "node long, outcome string"), cap=2).collect()}
    assert got == {
        "ok": (S.SUCCEEDED, False, 0, True, 0), "bad": (S.FAILED, False, 3, False, 0),  # failure keeps the count
        "waits": (S.PENDING, True, 2, False, 0), "again": (S.PENDING, False, 2, False, 0),  # deferred only while an input is missing
        "much": (S.FAILED, False, 3, False, 0),  # beyond the cap
    }
    assert changes.DEFER_CAP == 100


def test_which_changes_matter(spark):
    from graphloom.functions.patterns import Pattern

    b = Builder()
    for name in ("UNCONFIRMED", "MISSING", "CONFIRMED", "PLANNED", "BUILT", "OUTDATED", "VOLATILE"):
        b.file(f"f/{name}", getattr(S, name))
    b.file("f/gone", S.CONFIRMED, detached=True)
    paths = [*(n for n in b.ids if n), "new/x.dat", "new/sub/x.dat", "other"]
    b.rows["change"] = [(k, p, S.UPDATED, building) for building in (False, True) for k, p in enumerate(paths)]
    patterns = spark.createDataFrame([(Pattern(p).regex(), Pattern(p).base()) for p in ("new/*.dat", "f/${*x}n*")], "regex string, base string")
    got = {(r.path, r.during_build) for r in relational.relevant_changes(b.frames(spark), patterns).collect() if r.relevant}
    idle = {f"f/{n}" for n in ("UNCONFIRMED", "MISSING", "CONFIRMED", "BUILT", "OUTDATED")}
    free = {"new/x.dat", "f/gone"}  # no attached node: judged by the patterns
    assert got == {(p, False) for p in idle | free} | {(p, True) for p in {"f/MISSING", "f/CONFIRMED"} | free}


def test_what_matters_below_a_folder(spark):
    b = Builder()
    b.step("plan", S.SUCCEEDED)
    b.step("old", S.SUCCEEDED, detached=True)
    for name, state in (("d/in", S.CONFIRMED), ("d/out", S.BUILT), ("d/plan", S.PLANNED), ("d/vol", S.VOLATILE), ("D/upper", S.MISSING), ("dx/no", S.CONFIRMED)):
        b.file(name, state)
    b.rows["nglob"] = [(1, b.ids["plan"], "d/*"), (2, b.ids["old"], "d/*")]
    b.rows["nglob_match"] = [(1, "d/free"), (1, "d/in"), (1, "dx/free"), (2, "d/never")]
    g = b.frames(spark)
    assert {r.path for r in relational.paths_below(g, "d").collect()} == {"d/in", "d/out", "D/upper", "d/free"}
    assert {r.path for r in relational.paths_below(g, "d/", during_build=True).collect()} == {"d/in", "D/upper", "d/free"}


def test_overlap_of_a_producer_and_a_consumer(spark):
    times = lambda rows, c: spark.createDataFrame(rows, f"job long, {c} long")
    starts, stops = times([(2, 10), (3, 11), (4, 5)], "start"), times([(1, 10), (4, 1)], "stop")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (1, 9), (4, 4)], "producer long, consumer long")
    got = {(r.producer, r.consumer) for r in relational.concurrent(pairs, starts, stops).collect() if r.overlapped}
    assert got == {(1, 2), (1, 4)}  # a tie counts, a missing time doesn't, and an earlier start is enough


def test_inputs_found_while_running(spark):
    b = Builder()
    for name, state in (("static", S.CONFIRMED), ("check", S.UNCONFIRMED), ("no", S.MISSING)):
        b.file(name, state)
    b.step("maker", S.SUCCEEDED)
    b.file("made", S.BUILT, creator="maker")
    b.step("user", S.RUNNING)
    g = b.frames(spark)
    wanted = spark.createDataFrame([(b.ids["user"], p) for p in ("static", "check", "no", "made", "unknown", "made")], "step long, path string")
    starts = spark.createDataFrame([(b.ids["user"], 5)], "job long, start long")
    verdicts = lambda stop: {r.path: r.verdict for r in changes.amend(g, wanted, starts, spark.createDataFrame([(b.ids["maker"], stop)], "job long, stop long")).collect()}
    always = {"static": "ok", "check": "to_check", "no": "unavailable", "unknown": "unavailable"}
    assert verdicts(4) == always | {"made": "ok"} and verdicts(5) == always | {"made": "unfresh"}


def test_outputs_that_cannot_be_declared(spark):
    from graphloom.functions.patterns import Pattern

    b = Builder()
    b.step("a", S.RUNNING)
    b.step("b", S.RUNNING)
    b.file("mine", S.PLANNED, creator="a")
    b.file("theirs", S.BUILT, creator="b")
    rows = [("mine", "OUTPUT"), ("theirs", "OUTPUT"), ("twice", "OUTPUT"), ("twice", "VOLATILE"), ("g/x", "OUTPUT"), ("fine", "VOLATILE")]
    declared = spark.createDataFrame([(b.ids["a"], p, r) for p, r in rows], "step long, path string, role string")
    patterns = spark.createDataFrame([(Pattern(p).regex(), Pattern(p).base()) for p in ("g/*", "mine")], "regex string, base string")
    got = {(r.path, r.rule) for r in changes.output_conflicts(b.frames(spark), declared, patterns).collect()}
    assert got == {("theirs", "already claimed"), ("twice", "output and volatile"), ("g/x", "matches a pattern")}  # what a step has already isn't new


VIOLATION_CASES = {
    # match: (what is there, state of the violation or "fine")
    "static.txt": ("file", S.CONFIRMED, "fine"), "missing.txt": ("file", S.MISSING, "fine"), "unsure.txt": ("file", S.UNCONFIRMED, "fine"),
    "built.txt": ("file", S.BUILT, S.BUILT), "planned.txt": ("file", S.PLANNED, S.PLANNED), "old.txt": ("file", S.OUTDATED, S.OUTDATED), "scratch.txt": ("file", S.VOLATILE, S.VOLATILE),
    "loose.txt": ("path", None, None), "deleted.txt": ("absent", None, "fine"), "tree/in.txt": ("path", None, "fine"), "tree/": ("path", None, "fine"), "tree": ("path", None, "fine"), "trees/x.txt": ("path", None, None),
    "over/": ("path", None, "fine"), "holds/": ("path", None, "fine"), "holds/deep/": ("path", None, "fine"), "products/": ("path", None, None), "empty/": ("path", None, None), "./": ("path", None, "fine"),
}


def test_matches_that_nothing_static_justifies(spark):
    b = Builder()
    b.step("globber", S.SUCCEEDED)
    b.step("gone", S.SUCCEEDED, detached=True)
    for name in ("tree/", "over/tree/"):
        b._node("st", name)
    b.file("holds/deep/a.txt", S.CONFIRMED)
    b.file("products/b.txt", S.BUILT)
    b.file("detached.txt", S.BUILT, detached=True)
    for path, (there, state, _) in VIOLATION_CASES.items():
        if there == "file":
            b.file(path, state)
    b.rows["nglob"] = [(1, b.ids["globber"], "**"), (2, b.ids["globber"], "*.txt"), (3, b.ids["gone"], "*")]
    b.rows["nglob_match"] = [(1, p) for p in VIOLATION_CASES] + [(2, "built.txt"), (2, "detached.txt"), (3, "planned.txt")]
    g = b.frames(spark)
    present = spark.createDataFrame([(p,) for p, (there, _, _) in VIOLATION_CASES.items() if there != "absent"] + [("detached.txt",)], "path string")
    found = relational.glob_violations(g, present)
    got = {(r.step, r.pattern, r.path): (r.state, r.is_error) for r in found.collect()}
    want = {("globber", "**", p): (v, v is not None) for p, (_, _, v) in VIOLATION_CASES.items() if v != "fine"}
    # a detached node says nothing; the other pattern reports for itself; a detached step's pattern isn't registered
    assert got == want | {("globber", "*.txt", "built.txt"): (S.BUILT, True), ("globber", "*.txt", "detached.txt"): (None, False)}
    groups = {r.pattern: (r.n, r.n_errors, r.first) for r in relational.violation_groups(found).collect()}
    assert groups == {"**": (len(want), 4, "built.txt"), "*.txt": (2, 1, "built.txt")}
    assert {(r.nglob, r.step) for r in relational.registrations(g).collect()} == {(1, "globber"), (2, "globber")}
    assert relational.glob_violations(Builder().frames(spark), present).count() == 0


def test_hashes_are_looked_at_again(spark):
    schema = "path string, digest string, mode int, size long, mtime double, inode long"
    old = [("same", "d", 1, 2, 1.0, 1), ("touched", "d", 1, 2, 1.0, 1), ("edited", "d", 1, 2, 1.0, 1), ("mode", "d", 1, 2, 1.0, 1), ("trusted", "d", 1, 2, 1.0, 1), ("vanished", "d", 1, 2, 1.0, 1), ("missing", None, 0, 0, 0.0, 0), ("appeared", None, 0, 0, 0.0, 0), ("moved", "d", 1, 2, 1.0, 1)]
    seen = [("same", "d", 1, 2, 1.0, 1), ("touched", "d", 1, 2, 9.0, 1), ("edited", "e" * 12, 1, 3, 9.0, 1), ("mode", "d", 7, 2, 1.0, 1), ("trusted", "other", 1, 2, 1.0, 1), ("appeared", "n", 1, 5, 1.0, 1), ("moved", "d", 1, 2, 1.0, 8)]
    old, seen = spark.createDataFrame(old, schema), spark.createDataFrame(seen, schema)
    fresh = changes.hash_refresh(old, seen)
    got = {r.path: (r.change, r.digest) for r in fresh.collect()}
    assert got == {"same": ("same", "d"), "touched": ("same", "d"), "moved": ("same", "d"), "edited": ("changed", "e" * 12), "mode": ("changed", "d"), "trusted": ("same", "d"), "vanished": ("vanished", None), "missing": ("missing", None), "appeared": ("appeared", "n")}
    assert [tuple(r) for r in changes.hash_messages(old, fresh).collect()] == [("edited", "changed (digest d -> eeeeeeee, size 2 -> 3)"), ("mode", "changed (mode 1 -> 7)"), ("vanished", "vanished")]


def test_target_folders_without_outputs(spark):
    b = Builder()
    b.step("s", S.SUCCEEDED)
    for name, state in (("a/b/out", S.BUILT), ("v/log", S.VOLATILE)):
        b.file(name, state, creator="s")
        b.edge("s", name)
    dirs = spark.createDataFrame([(p,) for p in ("a/", "a/b/", "a/b/out/", "v/", "c/")], "path string")
    assert {r.path for r in changes.missing_target_dirs(b.frames(spark), dirs).collect()} == {"a/b/out/", "v/", "c/"}


def test_derived_columns(spark):
    from graphloom.operators import checks

    b = Builder()
    b.step("fine", S.RUNNING, holding=1)
    b.step("holds", S.PENDING, holding=1)
    b.step("ended", S.FAILED, deferred=True, has_hash=True)
    b.step("done", S.SUCCEEDED)
    hashes = spark.createDataFrame([(b.ids["done"],)], "node long")
    names = {i: n for n, i in b.ids.items()}
    assert {(names[r.i], r.rule) for r in checks.derived_rules(b.frames(spark), hashes).collect()} == {("holds", "holding"), ("ended", "ended"), ("ended", "has_hash"), ("done", "has_hash")}


def test_cycles_among_modules_are_reported(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 4), (6, 3)], "src long, dst long")
    assert {(r.i, r.layer, r.cyclic) for r in recursive.leaf_layers(e).collect()} == {(3, 0, False), (2, 1, False), (1, 2, False), (4, None, True), (5, None, True), (6, None, True)}


def test_creators_of_what_is_deleted(spark):
    b = Builder()
    b.step("keeps")
    b.file("a", S.UNDECLARED, creator="keeps", detached=True)
    b.step("goes", creator=None, detached=True)
    b.file("b", S.UNDECLARED, creator="goes", detached=True)
    gone = spark.createDataFrame([(b.ids[n],) for n in ("a", "b", "goes")], "i long")
    assert [r.i for r in recursive.shrunk_creators(b.frames(spark), gone).collect()] == [b.ids["keeps"]]


def test_report_names_what_is_hidden(spark):
    b = Builder()
    for k in range(13):
        b.file(f"in{k:02}", S.MISSING)
        b.step(f"s{k:02}", inp=[f"in{k:02}"])
    b.file("gone", S.CONFIRMED, creator=None, detached=True)
    b.step("needs", resources=[("gpu", 2)])
    p = pending.analyse(b.frames(spark))
    got = [(r.section, r.key, r.detail, r["count"]) for r in pending.report(p).orderBy("section", "position").collect()]
    assert [x for x in got if x[0] == "inputs"] == [("inputs", "MISSING", f"in{k:02}", "1") for k in range(10)] + [("inputs", "", "... and 3 more input(s)", "≥ 3")]
    assert [x for x in got if x[0] == "resources"] == [("resources", "gpu", "2 needed, none available", "1")]


def test_static_arguments(spark):
    args = spark.createDataFrame([("d", None), ("d/", None), ("f.txt", None), ("no", None), ("*.c", "x.c"), ("*.c", "sub/"), ("?.h", None)], "argument string, match string")
    present = spark.createDataFrame([("d/",), ("f.txt",), ("x.c",), ("sub/",)], "path string")
    assert [tuple(r) for r in changes.static_classified(args, present).collect()] == [("absent", "no"), ("file", "f.txt"), ("file", "x.c"), ("pattern", "*.c"), ("pattern", "?.h"), ("tree", "d/"), ("tree", "sub/")]


def test_browsing_a_node(spark):
    b = Builder()
    b.file("in")
    b.file("out", S.PLANNED)
    b.step("s", inp=["in"], out=["out"])
    b.step("child", S.RUNNING, creator="s")
    got = {(r.part, r.label, r.state) for r in relational.browse(b.frames(spark), b.ids["s"]).collect()}
    assert got == {("node", "s", S.PENDING), ("creator", "", None), ("product", "child", S.RUNNING), ("source", "in", S.CONFIRMED), ("sink", "out", S.PLANNED)}
