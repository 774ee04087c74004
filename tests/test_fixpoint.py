import pytest

from graphloom.plans import fixpoint


def pairs(df):
    return {tuple(r) for r in df.collect()}


def edges(spark, *e):
    return spark.createDataFrame(list(e), "src long, dst long")


def test_reach_ends_on_cycles(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (5, 6))
    seed = spark.createDataFrame([(1, 1), (5, 5)], "root long, i long")
    assert pairs(fixpoint.reach(e, seed)) == {(1, 1), (1, 2), (1, 3), (1, 4), (5, 5), (5, 6)}
    # a seed on a cycle reaches itself even where seeds aren't counted
    assert pairs(fixpoint.reach(e, seed, include_seeds=False, hops=1)) == {(1, 1), (1, 2), (1, 3), (1, 4), (5, 6)}
    assert fixpoint.reach(e, seed.limit(0)).count() == 0


def test_reach_is_idempotent(spark):
    e = edges(spark, *((k, k + 1) for k in range(20)), (3, 15))
    once = fixpoint.reach_from(e, spark.createDataFrame([(2,)], "i long"))
    assert pairs(fixpoint.reach_from(e, once)) == pairs(once) == {(k,) for k in range(2, 21)}


def test_uplift(spark):
    # 1 <- 2 <- 3 <- 4 <- ... <- 9, 10 beside, 11 alone, 12 and 13 on a cycle with 14 below it
    p = spark.createDataFrame([(1, 1), *((k + 1, k) for k in range(1, 9)), (10, 2), (11, None), (12, 13), (13, 12), (14, 12)], "i long, parent long")
    facts = spark.createDataFrame([(k, k != 3, k == 4, k if k in (2, 4) else None) for k in range(1, 15) if k != 5], "i long, a boolean, o boolean, f long")
    got = {r.i: (r.a, r.o, r.f) for r in fixpoint.uplift(p, facts, {"a": "and", "o": "or", "f": "first"}).collect()}
    want = {2: (True, False, None), 3: (True, False, 2), 10: (True, False, 2), 4: (False, False, 2), 12: (True, False, None), 13: (True, False, None), 14: (True, False, None)}
    want |= {k: (False, True, 4) for k in range(5, 10)}
    assert got == want


def test_forest_roots_leave_cycles_out(spark):
    p = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 7), (7, 6), (8, 7)], "i long, parent long")
    roots = spark.createDataFrame([(1,), (9,)], "i long")
    assert pairs(fixpoint.forest_roots(p, roots)) == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)}


def test_relax(spark):
    v = spark.createDataFrame([(k, k, k) for k in range(1, 8)], "i long, a long, b long")
    e = edges(spark, *((k, k + 1) for k in range(1, 7)))
    assert pairs(fixpoint.relax(v, e, {"a": "max", "b": "sum"}, layers=2)) == {(k, 7, sum(range(k, 8))) for k in range(1, 8)}


def test_peel(spark):
    n = spark.createDataFrame([(k,) for k in range(1, 7)], "i long")
    holds = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 4)], "i long, by long")
    assert pairs(fixpoint.peel(n, holds)) == {(3, 0), (2, 1), (1, 2)}


def test_sweep_leaves_cycles_out(spark):
    v = spark.createDataFrame([(k, k) for k in range(1, 7)], "i long, a long")
    # 1 -> 2 -> 3; 4 and 5 use each other; 6 is used by 4; an edge to what isn't there
    e = edges(spark, (1, 2), (2, 3), (4, 5), (5, 4), (6, 4), (3, 99))
    for layers in (1, 9):
        assert pairs(fixpoint.sweep(v, e, {"a": "sum"}, layers)) == {(3, 3), (2, 5), (1, 6)}
    with pytest.raises(ValueError):
        fixpoint.relax(v, e, {"a": "sum"})


def test_long_chains(spark):
    n = 40
    e = edges(spark, *((k, k + 1) for k in range(n)))
    v = spark.createDataFrame([(k, 1) for k in range(n + 1)], "i long, a long")
    assert pairs(fixpoint.relax(v, e, {"a": "sum"}, layers=7)) == {(k, n + 1 - k) for k in range(n + 1)}
    p = spark.createDataFrame([(k + 1, k) for k in range(n)], "i long, parent long")
    assert pairs(fixpoint.forest_roots(p, spark.createDataFrame([(0,)], "i long"))) == {(k, 0) for k in range(n + 1)}


def counted(monkeypatch):
    """The rows of every table that a fixpoint stores."""
    rows, stored = [], fixpoint.stored

    def count(df):
        out = stored(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "stored", count)
    return rows


def test_reaches(spark):
    # 1 -> ... -> 6; 7 and 8 on a cycle below 9 and above 10; 11 on a loop
    e = edges(spark, *((k, k + 1) for k in range(1, 6)), (9, 7), (7, 8), (8, 7), (8, 10), (11, 11), (2, 5))
    yes = {(1, 6), (2, 2), (1, 5), (7, 8), (8, 8), (9, 10), (7, 10), (9, 8), (11, 11), (3, 6), (2, 5), (50, 50)}
    no = {(6, 1), (3, 2), (10, 7), (8, 9), (1, 7), (7, 6), (11, 1), (50, 1), (1, 50), (10, 9)}
    asked = spark.createDataFrame(sorted(yes | no | {(1, 6)}), "root long, target long")
    assert pairs(fixpoint.reaches(e, asked)) == yes


def test_reaches_searches_for_few_pairs(spark, monkeypatch):
    n = 60
    e = edges(spark, *((k, k + 1) for k in range(n)))
    asked = spark.createDataFrame([p for k in range(n) for p in ((k, k + 1), (k + 1, k))], "root long, target long")
    rows = counted(monkeypatch)
    assert pairs(fixpoint.reaches(e, asked)) == {(k, k + 1) for k in range(n)}
    # a closure from every root has n * n / 2 rows
    assert max(rows) <= 2 * n


def test_sweep_settles_chains_at_once(spark, monkeypatch):
    n = 60
    # two chains that end in 0, what branches above them, a cycle, and what leads to it
    e = edges(spark, *((k + 1, k) for k in range(n)), (101, 0), *((k + 1, k) for k in range(101, 130)), (200, n), (200, 130), (201, 200), (300, 301), (301, 300), (302, 301))
    v = spark.createDataFrame([(k, k % 7, k % 5) for k in (*range(n + 1), *range(101, 131), 200, 201, 300, 301, 302)], "i long, a int, b long")
    users = {k + 1: [k] for k in (*range(n), *range(101, 130))} | {101: [0], 200: [n, 130], 201: [200], 0: []}
    want = {}
    for k in sorted(users):
        most = [want[u] for u in users[k]]
        want[k] = (max([k % 7, *(m[0] for m in most)]), k % 5 + max((m[1] for m in most), default=0))
    rows = counted(monkeypatch)
    got = fixpoint.sweep(v, e, {"a": "max", "b": "sum"}, 1)
    assert {r.i: (r.a, r.b) for r in got.collect()} == want
    assert got.schema["a"].dataType.simpleString() == "int"
    assert len(rows) < n
