"""Fixpoints over edge frames (src, dst): closures, folds over ancestors, forests, sweeps along a DAG, peeling.

Each loop is driven from the driver by small counts only; what grows stays in frames. Several hops are planned per job, since
a job's fixed cost outweighs a hop on narrow frontiers; a hop's frame is read once by the next, so plans grow linearly. What is
settled leaves the loop. All loops end on cyclic graphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, LongType

from .stored import stored

HOPS = 6
#: Layers that a job of a sweep settles.
LAYERS = 10
#: Rounds in which nodes without incoming edges are trimmed before a search.
TRIMS = 2
#: Height of what leads to a cycle.
ENDLESS = 2**62


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reach(edges: DataFrame, seeds: DataFrame, include_seeds: bool = True, hops: int = HOPS) -> DataFrame:
    """(root, i): what each root's seeds (root, i) reach. Semi-naive: a job goes on from what the job before met in its last hop."""
    edges = stored(edges.select("src", "dst").distinct())
    if not include_seeds:
        seeds = seeds.join(edges, seeds.i == edges.src).select("root", F.col("dst").alias("i"))
    frontier = stored(seeds.select("root", "i").distinct())
    parts = [frontier]
    while True:
        layer = frontier.select("root", "i", F.lit(0).alias("hop"))
        for _ in range(hops):
            # a pair and the next ones come from one join
            step = F.array(F.struct("i", "hop"), F.struct(F.col("dst").alias("i"), (F.col("hop") + 1).alias("hop")))
            both = layer.join(edges, layer.i == edges.src, "left").select("root", F.explode(step).alias("x")).select("root", "x.i", "x.hop")
            layer = both.filter("i IS NOT NULL").groupBy("root", "i").agg(F.min("hop").alias("hop"))
        grown = stored(layer.filter("hop > 0").join(_union(parts), ["root", "i"], "left_anti"))
        if grown.isEmpty():
            return _union(parts)
        parts.append(grown.select("root", "i"))
        frontier = grown.filter(F.col("hop") == hops).select("root", "i")


def reach_from(edges: DataFrame, seeds: DataFrame, include_seeds: bool = True) -> DataFrame:
    """i: what any of the seeds (i) reaches."""
    one = seeds.select(F.lit(0).cast("long").alias("root"), "i")
    return reach(edges, one, include_seeds).select("i")


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root, target): those of the pairs whose root reaches its target; every node reaches itself.

    Edges between the two answer first. No path goes through nodes without incoming edges, so those that aren't roots are trimmed,
    and what then is one, too. A node's height, the longest way down from it, falls along every edge, so only pairs
    whose root is the higher one are searched for, and no search goes below its lowest target; what leads to a cycle has no
    height and counts as higher than all that have one. A root leaves once its targets are met.
    """
    edges = stored(edges.select("src", "dst"))
    pairs = pairs.select("root", "target").distinct()
    direct = edges.select(F.col("src").alias("root"), F.col("dst").alias("target"), F.lit(True).alias("met")).distinct()
    asked = stored(pairs.join(direct, ["root", "target"], "left").select("root", "target", (F.col("met").isNotNull() | (F.col("root") == F.col("target"))).alias("met")))
    parts = [asked.filter("met").select("root", "target")]
    left = asked.filter("NOT met").select("root", "target")
    if left.isEmpty():
        return parts[0]
    roots = left.select(F.col("root").alias("src")).distinct()
    kept = edges
    for _ in range(TRIMS):
        kept = edges.join(roots.unionByName(kept.select(F.col("dst").alias("src"))).distinct(), "src", "left_semi")
    edges = stored(kept.select("src", "dst").distinct())
    ends = edges.select(F.col("src").alias("i")).unionByName(edges.select(F.col("dst").alias("i"))).distinct()
    height = sweep(ends.select("i", F.lit(1).cast("long").alias("h")), edges, {"h": "sum"})
    h = stored(ends.join(height, "i", "left").select("i", F.coalesce("h", F.lit(ENDLESS)).alias("h")))
    of = lambda name, c: h.select(F.col("i").alias(name), F.col("h").alias(c))
    left = left.join(of("target", "to"), "target").join(of("root", "from"), "root").filter((F.col("from") > F.col("to")) | (F.col("from") == F.lit(ENDLESS)))
    left = stored(left.select("root", "target", "to"))
    frontier = left.select("root", F.col("root").alias("i")).distinct()
    seen = [frontier]
    while not left.isEmpty():
        low = left.groupBy("root").agg(F.min("to").alias("low"))
        step = frontier.join(edges, F.col("i") == F.col("src")).select("root", F.col("dst").alias("i")).distinct()
        step = step.join(h, "i").join(low, "root").filter("h >= low").select("root", "i")
        frontier = stored(step.join(_union(seen), ["root", "i"], "left_anti"))
        if frontier.isEmpty():
            break
        seen.append(frontier)
        met = frontier.withColumnRenamed("i", "target")
        parts.append(stored(left.join(met, ["root", "target"], "left_semi").select("root", "target")))
        left = stored(left.join(met, ["root", "target"], "left_anti"))
    return _union(parts)


def uplift(parents: DataFrame, facts: DataFrame, how: dict[str, str]) -> DataFrame:
    """i and the columns of how, folded over the proper ancestors of every i in a forest (i, parent), nearest first: 'and', 'or',
    or 'first' (that isn't null). facts has i and the columns; null adds nothing, and what has no ancestor is absent.

    Pointers of the nodes that have children are doubled, so log2(depth) joins of a row per such node; all other nodes join once.
    """

    def fold(c: str, near: Column, far: Column) -> Column:
        both = {"and": near & far, "or": near | far, "first": near}[how[c]]
        return F.coalesce(both, near, far)

    cols = list(how)
    up = parents.filter("parent IS NOT NULL AND parent != i").select("i", F.col("parent").alias("to"))
    up = stored(up.join(facts.select(F.col("i").alias("to"), *cols), "to", "left").select("i", "to", *cols))
    inner = stored(up.join(up.select(F.col("to").alias("i")).distinct(), "i", "left_semi"))
    moved_before = -1
    while True:
        hop = inner.select(F.col("i").alias("to"), F.col("to").alias("next"), *(F.col(c).alias(f"far_{c}") for c in cols))
        further = inner.join(hop, "to", "left")
        inner = stored(further.select("i", F.coalesce("next", "to").alias("to"), *(fold(c, F.col(c), F.col(f"far_{c}")).alias(c) for c in cols), F.col("next").isNotNull().alias("moved")))
        moved = inner.filter("moved").count()
        inner = inner.drop("moved")
        if moved in (0, moved_before):  # the same number moves on cycles only
            break
        moved_before = moved
    top = inner.select(F.col("i").alias("to"), *(F.col(c).alias(f"far_{c}") for c in cols))
    return up.join(top, "to", "left").select("i", *(fold(c, F.col(c), F.col(f"far_{c}")).alias(c) for c in cols))


def forest_roots(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(i, root): the root that each i of an out-degree-1 graph (i, parent) ends at; roots has i. What runs into a cycle is absent.

    Pointers are doubled until none that isn't at a root moves on, log2(n) rounds at most. Those at a root leave the loop, so
    they don't meet on its key.
    """
    at_root = roots.select(F.col("i").alias("to")).withColumn("done", F.lit(True))
    ptr = stored(parents.select("i", F.col("parent").alias("to")).join(at_root, "to", "left").select("i", "to", F.coalesce("done", F.lit(False)).alias("done")))
    parts = [roots.select("i", F.col("i").alias("root")), ptr.filter("done").select("i", F.col("to").alias("root"))]
    left_before = -1
    while True:
        open_ = ptr.filter("NOT done")
        left = open_.count()
        if left in (0, left_before):
            return _union(parts)
        left_before = left
        hop = open_.select(F.col("i").alias("to"), F.col("to").alias("next"), F.lit(False).alias("ends"))
        ends = _union(parts[1:]).select(F.col("i").alias("to"), F.col("root").alias("next"), F.lit(True).alias("ends"))
        ptr = stored(open_.select("i", "to").join(hop.unionByName(ends), "to", "left").select("i", F.coalesce("next", "to").alias("to"), F.coalesce("ends", F.lit(False)).alias("done")))
        parts.append(ptr.filter("done").select("i", F.col("to").alias("root")))


def sweep(values: DataFrame, edges: DataFrame, how: dict[str, str], layers: int = LAYERS) -> DataFrame:
    """i and the columns of how, raised along edges: the own value max the users' (how 'max'), or the own value plus the users'
    largest ('sum'). What lies on a cycle or leads to one is absent.

    values has i and the columns; edges (src, dst) point from what is used to what uses it. A node is settled once, as soon as
    all its users are; it and the edges to it then leave the loop, so work follows what is left. A round settles layers (one at
    first, twice as many in each next one), then chains: nodes with one user left, whose pointers are doubled.
    """
    cols = list(how)

    def raised(c: str, most: Column) -> Column:
        return F.col(c) + F.coalesce(most, F.lit(0)) if how[c] == "sum" else F.greatest(F.col(c), most)

    nodes = stored(values.select("i", *cols))
    ids = nodes.select("i")
    edges = stored(edges.select("src", "dst").distinct().join(ids, F.col("src") == F.col("i"), "left_semi").join(ids, F.col("dst") == F.col("i"), "left_semi"))
    most = {c: F.greatest(f"most_{c}", f"now_{c}") for c in cols}
    left = nodes.select("i", *cols, *(F.lit(None).cast(nodes.schema[c].dataType).alias(f"most_{c}") for c in cols))
    parts = [nodes.limit(0)]
    deep = 1
    while True:
        base = _with_users(left, edges)
        if base.isEmpty():
            break
        now = base.filter("n IS NULL").select("i", *(raised(c, F.col(f"most_{c}")).alias(c) for c in cols))
        for _ in range(deep - 1):
            met = _met(edges, now, cols, count=True)
            now = base.join(met, "i", "left").filter("n IS NULL OR n = met").select("i", *(raised(c, most[c]).alias(c) for c in cols))
        now = stored(now)
        if now.isEmpty():
            break
        parts.append(now)
        left, edges = _without(base, edges, now, cols, most)
        base = _with_users(left, edges)
        linked = _chains(base, how, {c: raised(c, F.col(f"most_{c}")).alias(c) for c in cols})
        if linked is None:
            left = base.select(left.columns)
        else:
            parts.append(linked)
            left, edges = _without(base, edges, linked, cols, most)
        deep = min(2 * deep, layers)
    return _union(parts)


def _with_users(left: DataFrame, edges: DataFrame) -> DataFrame:
    """What is left, with the number of users and one of them."""
    return stored(left.join(edges.groupBy(F.col("src").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")), "i", "left"))


def _without(base: DataFrame, edges: DataFrame, now: DataFrame, cols: list[str], most: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """What is left, and its edges, once the nodes of now are settled."""
    left = base.drop("n", "to").join(now.select("i"), "i", "left_anti").join(_met(edges, now, cols), "i", "left")
    return left.select("i", *cols, *(most[c].alias(f"most_{c}") for c in cols)), stored(edges.join(now.select(F.col("i").alias("dst")), "dst", "left_anti"))


def _chains(base: DataFrame, how: dict[str, str], ends: dict[str, Column]) -> DataFrame | None:
    """i and the columns of the nodes from which a chain of nodes with one user each leads to one without users, these included.

    A node's value is the larger of a constant and a distance plus the value at its pointer's end; two such rules in a row are
    one again, so log2(length) joins settle a chain. None if no node has one user.
    """
    cols = list(how)
    links = base.filter("n = 1")
    if links.isEmpty():
        return None
    types = {c: base.schema[c].dataType for c in cols}
    least = {c: F.col(c) + F.col(f"most_{c}") if how[c] == "sum" else F.greatest(c, f"most_{c}") for c in cols}
    top = stored(base.filter("n IS NULL").select("i", *(ends[c] for c in cols)))
    sums = [c for c in cols if how[c] == "sum"]
    # only what is summed has a distance
    further_on = lambda c, x: F.col(f"b_{c}") + F.col(f"{x}_{c}") if c in sums else F.col(f"{x}_{c}")
    ptr = stored(links.select("i", "to", *(least[c].cast(_wide(types[c])).alias(f"a_{c}") for c in cols), *(F.col(c).cast(_wide(types[c])).alias(f"b_{c}") for c in sums)))
    moved_before = -1
    while True:
        hop = ptr.select(F.col("i").alias("to"), F.col("to").alias("next"), *(F.col(f"a_{c}").alias(f"c_{c}") for c in cols), *(F.col(f"b_{c}").alias(f"d_{c}") for c in sums))
        further = ptr.join(hop, "to", "left")
        ptr = stored(further.select("i", F.coalesce("next", "to").alias("to"), *(F.greatest(f"a_{c}", further_on(c, "c")).alias(f"a_{c}") for c in cols), *((F.col(f"b_{c}") + F.coalesce(f"d_{c}", F.lit(0))).alias(f"b_{c}") for c in sums), F.col("next").isNotNull().alias("moved")))
        moved = ptr.filter("moved").count()
        ptr = ptr.drop("moved")
        if moved in (0, moved_before):  # the same number moves on cycles only
            break
        moved_before = moved
    at_end = ptr.join(top.select(F.col("i").alias("to"), *(F.col(c).alias(f"x_{c}") for c in cols)), "to")
    return stored(at_end.select("i", *(F.greatest(f"a_{c}", further_on(c, "x")).cast(types[c]).alias(c) for c in cols)).unionByName(top))


def _wide(t: DataType) -> DataType:
    return LongType() if isinstance(t, IntegralType) else t


def _met(edges: DataFrame, now: DataFrame, cols: list[str], count: bool = False) -> DataFrame:
    """Per used node, the largest of the settled users' values, and how many are settled."""
    users = edges.join(now.select(F.col("i").alias("dst"), *cols), "dst").groupBy(F.col("src").alias("i"))
    return users.agg(*(F.max(c).alias(f"now_{c}") for c in cols), *([F.count(F.lit(1)).alias("met")] if count else []))


def relax(values: DataFrame, edges: DataFrame, how: dict[str, str], layers: int = LAYERS) -> DataFrame:
    """`sweep` over a graph without cycles; raises where there is one."""
    values = stored(values)
    out = stored(sweep(values, edges, how, layers))
    if out.count() < values.count():
        raise ValueError("the values don't settle: the graph has a cycle")
    return out


def peel(nodes: DataFrame, holds: DataFrame) -> DataFrame:
    """(i, layer): nodes (i) removed round by round once nothing left holds them; holds (i, by). What cycles hold up stays."""
    depth = sweep(nodes.select("i", F.lit(1).alias("layer")), holds.select(F.col("i").alias("src"), F.col("by").alias("dst")), {"layer": "sum"})
    return depth.select("i", (F.col("layer") - 1).alias("layer"))
