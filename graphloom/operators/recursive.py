"""Recursive operators over the dependency graph and the provenance tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import states as S
from ..plans import fixpoint
from ..plans.spread import few
from ..plans.stored import stored
from ..sources.frames import Frames
from .relational import nodes


def dependency_edges(g: Frames) -> DataFrame:
    return g.dependency.select(F.col("source").alias("src"), F.col("sink").alias("dst"))


def creator_edges(g: Frames) -> DataFrame:
    """creator -> product, without the root's loop."""
    return g.node.filter("creator IS NOT NULL AND creator != i").select(F.col("creator").alias("src"), F.col("i").alias("dst"))


def reach_sinks(g: Frames, seeds: DataFrame) -> DataFrame:
    """The seeds (i) and all that depends on them."""
    return fixpoint.reach_from(dependency_edges(g), seeds)


def outputs_to_clean(g: Frames, seeds: DataFrame, detached_only: bool = False) -> DataFrame:
    """Outputs that the seeds lead to: built, outdated or volatile."""
    f = g.file.filter(F.col("state").isin(S.BUILT, S.OUTDATED, S.VOLATILE)).select(F.col("node").alias("i"), "state")
    df = reach_sinks(g, seeds).join(f, "i").join(g.node.select("i", "label", "detached"), "i")
    return (df.filter("detached") if detached_only else df).select("i", "label", "state")


def match_paths(g: Frames, path: str) -> DataFrame:
    """Nodes of a path, or below it; all files for '.'."""
    files = nodes(g, "file", include_detached=True)
    if path == ".":
        return files.select("i", "label")
    return files.filter((F.col("label") == path) | S.like_prefix(F.col("label"), path.rstrip("/") + "/")).select("i", "label")


def would_cycle(g: Frames, candidates: DataFrame) -> DataFrame:
    """source, sink, cyclic: whether the candidate's sink reaches its source."""
    back = candidates.select(F.col("sink").alias("root"), F.col("source").alias("target"))
    met = fixpoint.reaches(dependency_edges(g), back).select(F.col("root").alias("sink"), F.col("target").alias("source")).withColumn("met", F.lit(True))
    return candidates.join(met, ["source", "sink"], "left").select("source", "sink", F.coalesce("met", F.lit(False)).alias("cyclic"))


def all_products(g: Frames, seeds: DataFrame) -> DataFrame:
    """Recursive products, the seeds themselves excepted."""
    return fixpoint.reach_from(creator_edges(g), seeds, include_seeds=False)


def reattach(g: Frames, moves: DataFrame) -> DataFrame:
    """The node frame after moves (i, creator): the moved nodes and their products inherit the new creator's detached flag."""
    to = moves.select("i", F.col("creator").alias("new"))
    flags = g.node.select(F.col("i").alias("new"), F.col("detached").alias("flag"))
    roots = to.join(flags, "new")
    below = fixpoint.reach(creator_edges(g), roots.select(F.col("i").alias("root"), "i")).join(roots.select(F.col("i").alias("root"), "flag"), "root")
    flag = below.groupBy("i").agg(F.bool_or("flag").alias("flag"))
    df = g.node.join(to, "i", "left").join(flag, "i", "left")
    return df.select("i", "kind", "label", F.coalesce("new", "creator").alias("creator"), F.coalesce("flag", "detached").alias("detached"))


def inconsistent(g: Frames) -> DataFrame:
    """Nodes whose detached flag disagrees with whether the root reaches them through creators."""
    root = g.node.filter("kind = 'root'").select("i")
    live = fixpoint.reach_from(creator_edges(g), root).withColumn("live", F.lit(True))
    return g.node.join(live, "i", "left").filter(F.coalesce("live", F.lit(False)) == F.col("detached")).select("i", "label", "detached")


def locally_inconsistent(g: Frames) -> DataFrame:
    c = g.node.select(F.col("i").alias("c"), F.col("detached").alias("above"))
    return g.node.filter("kind != 'root'").join(c, F.col("creator") == F.col("c"), "left").filter(F.coalesce("above", F.lit(True)) != F.col("detached")).select("i", "label", "detached")


def product_steps(g: Frames, seeds: DataFrame) -> DataFrame:
    """The seeds and their recursive products, through steps only."""
    steps = g.step.select(F.col("node").alias("dst"))
    return fixpoint.reach_from(creator_edges(g).join(steps, "dst", "left_semi"), seeds)


def subtree_sources(g: Frames, seeds: DataFrame) -> DataFrame:
    """Steps two hops before any step in the seeds' subtrees."""
    from .relational import source_steps

    below = product_steps(g, seeds).select(F.col("i").alias("step"))
    return source_steps(g).join(below, "step", "left_semi").select(F.col("before").alias("i")).distinct()


def shrunk_creators(g: Frames, gone: DataFrame) -> DataFrame:
    """i: creators that lose a product when nodes (i) go, and stay themselves."""
    lost = g.node.join(gone, "i", "left_semi").filter("creator IS NOT NULL").select(F.col("creator").alias("i")).distinct()
    return lost.join(gone, "i", "left_anti")


def deletable(g: Frames) -> DataFrame:
    """(i, layer): detached nodes removed round by round, once they have no products and no sinks left."""
    detached = stored(g.node.filter("detached").select("i"))
    # only what holds a detached node matters: an attached node is never asked for
    holds = dependency_edges(g).unionByName(creator_edges(g)).select(F.col("src").alias("i"), F.col("dst").alias("by")).join(detached, "i", "left_semi")
    also = detached.select(F.col("i").alias("by"), F.lit(True).alias("both"))
    holds = stored(holds.join(also, "by", "left").select("i", "by", F.coalesce("both", F.lit(False)).alias("both")))
    inner = holds.filter("both")
    # what an attached node holds never goes
    attached = g.node.filter("NOT detached").select(F.col("i").alias("by"))
    first = holds.filter("NOT both").join(attached, "by", "left_semi").select("i").distinct()
    held = fixpoint.reach_from(inner.select(F.col("by").alias("src"), F.col("i").alias("dst")), first)
    free = detached.join(held, "i", "left_anti")
    return fixpoint.peel(free, inner.select("i", "by"))


def unused_tree_files(g: Frames) -> DataFrame:
    """Files of static trees that no attached node depends on."""
    trees = g.node.filter("kind = 'st'").select(F.col("i").alias("creator"))
    used = dependency_edges(g).join(nodes(g).select(F.col("i").alias("dst")), "dst", "left_semi").select(F.col("src").alias("i"))
    return nodes(g, "file").join(trees, "creator", "left_semi").join(used, "i", "left_anti").select("i", "label")


def chains(g: Frames) -> DataFrame:
    """node, safe, safe_ignoring_hold, unsafe (the nearest ancestor that breaks the chain), pending (whether an ancestor is), of
    every step, from one walk up the creators; only ancestors that are steps count."""
    ok = S.chain_ok(F.col("state"))
    whole = ok & (F.col("holding") == 0)
    facts = g.step.select(F.col("node").alias("i"), whole.alias("safe"), ok.alias("safe_ignoring_hold"), F.when(~whole, F.col("node")).alias("unsafe"), (F.col("state") == S.PENDING).alias("pending"))
    above = fixpoint.uplift(_above_steps(g), facts, {"safe": "and", "safe_ignoring_hold": "and", "unsafe": "first", "pending": "or"})
    df = g.step.select("node").join(above, F.col("node") == F.col("i"), "left")
    none = {"safe": True, "safe_ignoring_hold": True, "pending": False}
    return df.select("node", "unsafe", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()))


def _above_steps(g: Frames) -> DataFrame:
    """i, parent of all that isn't a file, and of the files above it, of which a consistent graph has none."""
    up = g.node.filter("creator IS NOT NULL AND creator != i").select("i", F.col("creator").alias("parent"), "kind")
    files = up.filter("kind = 'file'").drop("kind")
    out = stored(up.filter("kind != 'file'").drop("kind"))
    while True:
        asked = few(out.select(F.col("parent").alias("i")).distinct().join(out.select("i"), "i", "left_anti"))
        more = stored(files.join(asked, "i", "left_semi"))
        if more.isEmpty():
            return out
        out = stored(out.unionByName(more))


def safety(g: Frames) -> DataFrame:
    """node, safe, safe_ignoring_hold: all step ancestors run or have succeeded, and none holds its products back."""
    return chains(g).select("node", "safe", "safe_ignoring_hold")


def unsafe_ancestor(g: Frames) -> DataFrame:
    """node, anc: the nearest ancestor that breaks the chain."""
    return chains(g).filter("unsafe IS NOT NULL").select("node", F.col("unsafe").alias("anc"))


def creator_pending(g: Frames) -> DataFrame:
    """Steps with a pending ancestor."""
    return chains(g).filter("pending").select("node")


def step_edges(g: Frames) -> DataFrame:
    """src depends on dst's coming first, reversed: a step -> attached steps that use its outputs."""
    from .relational import source_steps

    live = nodes(g, "step").select(F.col("i").alias("step"))
    return source_steps(g).join(live, "step", "left_semi").select(F.col("before").alias("src"), F.col("step").alias("dst"))


def need_and_tail(g: Frames) -> DataFrame:
    """node, implied_need, tail_time: the largest need among a step and what uses it, targets included, and the longest
    duration of a chain of steps from it on."""
    return fixpoint.relax(_own_need(g), step_edges(g), {"implied_need": "max", "tail_time": "sum"}).withColumnRenamed("i", "node")


def needed(g: Frames, threshold: int) -> DataFrame:
    """node: steps whose implied need is above the threshold, without tails.

    Most are by their own need. Only the outputs of the others are looked at: for targets, then for users; those that a step
    above the threshold uses are settled, and only edges among what is left are swept.
    """
    above = F.coalesce(F.col("need") > threshold, F.lit(False))
    high, low = g.step.filter(above).select("node"), g.step.filter(~above).select("node", "need")
    made = stored(g.dependency.join(low.select(F.col("node").alias("source")), "source", "left_semi").select("source", "sink", "dynamic"))
    own = stored(_own_need(g.with_(step=low.withColumn("duration", F.lit(None).cast("long")), dependency=made)).select("i", (F.coalesce("implied_need", F.lit(threshold)) > threshold).alias("above")))
    left = own.filter("NOT above").select("i")
    use = g.dependency.select(F.col("source").alias("file"), F.col("sink").alias("dst"))
    edges = made.join(left, F.col("source") == F.col("i"), "left_semi").select(F.col("source").alias("src"), F.col("sink").alias("file")).join(use, "file").select("src", "dst")
    # as in step_edges, users are attached steps
    need = high.withColumn("above", F.lit(True)).unionByName(own.withColumnRenamed("i", "node")).withColumnRenamed("node", "dst")
    # ids are unique; a semi join would be moved down to all edges, which then are shuffled by their sinks
    edges = edges.join(need, "dst").join(nodes(g, "step").select(F.col("i").alias("dst")), "dst")
    edges = stored(edges.select("src", "dst", "above").distinct())
    met = stored(edges.filter("above").select(F.col("src").alias("i")).distinct())
    inner = stored(edges.filter("NOT above").select("src", "dst").join(met.select(F.col("i").alias("src")), "src", "left_anti"))
    ends = inner.select(F.col("src").alias("i")).unionByName(inner.select(F.col("dst").alias("i"))).distinct()
    values = ends.join(met.withColumn("met", F.lit(1)), "i", "left").select("i", F.coalesce("met", F.lit(0)).alias("met"))
    swept = fixpoint.relax(values, inner, {"met": "max"}).filter("met = 1").select("i")
    out = own.filter("above").select("i").unionByName(met.unionByName(swept).distinct())
    return high.unionByName(out.withColumnRenamed("i", "node"))


def _own_need(g: Frames) -> DataFrame:
    """i, implied_need, tail_time: a step's own need, raised by targets, and its duration."""
    from .relational import regular_outputs, targets_in_dirs

    out = stored(regular_outputs(g))
    exact = out.join(g.target_path, F.col("label") == F.col("path"), "left_semi").select(F.col("step").alias("node")).distinct().withColumn("exact", F.lit(True))
    files = targets_in_dirs(g, out).select("file").distinct()
    below = out.join(files, "file", "left_semi").select(F.col("step").alias("node")).distinct().withColumn("below", F.lit(True))
    raised = F.when(F.col("exact") | (F.col("below") & (F.col("need") == S.DEFAULT)), F.greatest("need", F.lit(S.TARGET))).otherwise(F.col("need"))
    return g.step.join(exact, "node", "left").join(below, "node", "left").select(F.col("node").alias("i"), raised.cast("int").alias("implied_need"), F.col("duration").alias("tail_time"))


def mark_pending(g: Frames, changed: DataFrame) -> DataFrame:
    """node, old, new: steps and files that change state when files (i) have changed.

    Steps that use them become pending unless they run or are being checked; those that had succeeded or failed outdate their
    built outputs, whose users follow.
    """
    s = g.step.select(F.col("node").alias("step"), "state").filter(~F.col("state").isin(S.RUNNING, S.CHECKING))
    use = g.dependency.join(s.select("step"), F.col("sink") == F.col("step"), "left_semi").select(F.col("source").alias("src"), F.col("sink").alias("dst"))
    done = s.filter(F.col("state").isin(S.SUCCEEDED, S.FAILED)).select("step")
    built = g.file.filter(F.col("state") == S.BUILT).select("node")
    make = g.dependency.join(done, F.col("source") == F.col("step"), "left_semi").join(built, F.col("sink") == F.col("node"), "left_semi").select(F.col("source").alias("src"), F.col("sink").alias("dst"))
    hit = fixpoint.reach_from(use.unionByName(make), changed, include_seeds=False)
    steps = hit.join(s, F.col("i") == F.col("step")).select(F.col("i").alias("node"), F.col("state").alias("old"), F.lit(S.PENDING).alias("new"))
    files = hit.join(built, F.col("i") == F.col("node"), "left_semi").join(changed, "i", "left_anti").select(F.col("i").alias("node"), F.lit(S.BUILT).alias("old"), F.lit(S.OUTDATED).alias("new"))
    return steps.filter("old != new").unionByName(files)


def to_revisit(g: Frames, files: DataFrame) -> DataFrame:
    """node: steps whose need or tail a change of files (i) may touch: the steps that use them, and all that these depend on."""
    users = g.dependency.join(files, F.col("source") == files.i, "left_semi").select(F.col("sink").alias("i")).join(g.step, F.col("i") == F.col("node"), "left_semi").distinct()
    back = step_edges(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.reach_from(back, users).select(F.col("i").alias("node"))


def leaf_layers(edges: DataFrame) -> DataFrame:
    """i, layer, cyclic of a module graph (src imports dst): leaves import nothing that is left; what is on a cycle or above one
    has no layer and is reported as cyclic."""
    every = stored(edges.select(F.col("src").alias("i")).unionByName(edges.select(F.col("dst").alias("i"))).distinct())
    layers = fixpoint.peel(every, edges.select(F.col("src").alias("i"), F.col("dst").alias("by")))
    return every.join(layers, "i", "left").select("i", "layer", F.col("layer").isNull().alias("cyclic"))
