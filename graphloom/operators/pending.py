"""Root causes of pending steps, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as S
from ..plans import fixpoint
from ..plans.spread import few
from ..plans.stored import stored, stored_by
from ..sources.frames import Frames
from .recursive import chains, needed
from .relational import nodes, short_resources

# Kinds of blockers in their order of precedence.
FILE, RESOURCE, FAILED, DEFERRED, OTHER, RUNNABLE, STEP = 0, 1, 2, 3, 4, 5, 6
#: Stands behind all of these while the first blocker is searched for.
NONE = 9
POOL, SHOWN = 20, 10
# Names of file states in reports.
STATE_NAMES = {S.UNDECLARED: "UNDECLARED", S.UNCONFIRMED: "UNCONFIRMED", S.MISSING: "MISSING", S.CONFIRMED: "CONFIRMED", S.PLANNED: "PLANNED", S.BUILT: "BUILT", S.OUTDATED: "OUTDATED", S.VOLATILE: "VOLATILE"}


def settled(g: Frames) -> Frames:
    """The graph once nothing runs: running steps have failed, checked ones are pending."""
    state = F.when(F.col("state") == S.RUNNING, S.FAILED).when(F.col("state") == S.CHECKING, S.PENDING).otherwise(F.col("state"))
    return g.with_(step=g.step.withColumn("state", state))


@dataclass
class Pending:
    """Stages of the analysis, each materialised as it is used more than once. made: what `producers` gives, at least of pending
    and failed steps; failed: step, producer of blocking files that a failed step makes; names: i, label of such producers and of
    unsafe ancestors."""

    g: Frames
    universe: DataFrame
    file_block: DataFrame
    dead: DataFrame
    unsafe: DataFrame
    short: DataFrame
    step_block: DataFrame
    made: DataFrame | None = None

    def __post_init__(self) -> None:
        made = producers(self.g) if self.made is None else self.made
        self.failed = stored(self.file_block.join(made.filter(F.col("producer_state") == S.FAILED), "file").select("step", "producer"))
        ids = self.failed.select(F.col("producer").alias("i")).unionByName(self.unsafe.select(F.col("anc").alias("i")))
        self.names = stored(self.g.node.select("i", "label").join(few(ids.distinct()), "i", "left_semi"))


def universe(g: Frames, threshold: int = S.OPTIONAL, above: DataFrame | None = None) -> DataFrame:
    """i, label, unsafe, deferred of attached pending steps that are needed; above: what `chains` gave, if at hand."""
    s = g.step.filter(F.col("state") == S.PENDING).join(nodes(g, "step").select(F.col("i").alias("node"), "label"), "node")
    s = s.join(needed(g, threshold), "node", "left_semi").join(chains(g) if above is None else above, "node")
    unsafe = ~(F.col("safe") | (F.col("has_hash") & F.col("safe_ignoring_hold")))
    return s.select(F.col("node").alias("i"), "label", unsafe.alias("unsafe"), "deferred")


def file_block(g: Frames, u: DataFrame) -> DataFrame:
    """file, step: inputs that block, also those that made a step defer."""
    ids = u.select(F.col("i").alias("step"), "deferred")
    # whatever the edge and the step are, only such files can block
    bad = _file_states(g).filter("detached OR NOT available").drop("available").withColumnRenamed("node", "file")
    x = g.dependency.select(F.col("source").alias("file"), F.col("sink").alias("step"), "dynamic").join(bad, "file").join(ids, "step")
    late = F.col("deferred") & F.col("dynamic") & ~S.available(F.col("state"))
    return x.filter(S.unavailable_input(F.col("state"), F.col("detached"), F.col("dynamic")) | late).select("file", "step").distinct()


def _file_states(g: Frames) -> DataFrame:
    """node, state, detached, available of files; `analyse` brings the flag along."""
    f = g.file if "detached" in g.file.columns else g.file.join(g.node.select(F.col("i").alias("node"), "detached"), "node")
    return f.select("node", "state", "detached", S.available(F.col("state")).alias("available"))


def producers(g: Frames) -> DataFrame:
    steps = g.step.select(F.col("node").alias("producer"), F.col("state").alias("producer_state"))
    return g.dependency.select(F.col("source").alias("producer"), F.col("sink").alias("file")).join(steps, "producer")


def dead_files(g: Frames, u: DataFrame, block: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """i, label, state, detached of blocking files that no pending or failed step would make; made: see `Pending`."""
    live = (producers(g) if made is None else made).join(u.select(F.col("i").alias("producer")).withColumn("in_u", F.lit(True)), "producer", "left").filter((F.col("producer_state") == S.FAILED) | F.col("in_u"))
    dead = few(block.select("file").distinct().join(live.select("file"), "file", "left_anti"))
    f = g.file.select(F.col("node").alias("file"), "state").join(dead, "file")
    n = g.node.select(F.col("i").alias("file"), "label", "detached").join(dead, "file")
    return f.join(n, "file").select(F.col("file").alias("i"), "label", "state", "detached")


def analyse(g: Frames, threshold: int = S.OPTIONAL) -> Pending:
    # edges and states are read by most stages, so they are made once, without what none of these reads, and dealt by the
    # keys that they are joined on
    edges = stored_by(g.dependency.select("source", "sink", "dynamic"), "source")
    g = g.with_(step=stored_by(g.step.drop("duration", "defer_count"), "node"))
    files = g.file.select("node", "state").join(nodes(g, "file", include_detached=True).select(F.col("i").alias("node"), "detached"), "node")
    g = settled(g.with_(dependency=edges, file=stored_by(files, "node")))
    above = stored(chains(g))
    u = stored(universe(g, threshold, above))
    ids = u.select("i")
    block = stored(file_block(g, u))
    made = stored(producers(g).filter(F.col("producer_state").isin(S.PENDING, S.FAILED)))
    dead = stored(dead_files(g, u, block, made))
    unsafe = stored(above.filter("unsafe IS NOT NULL").select("node", F.col("unsafe").alias("anc")).join(u.filter("unsafe").select(F.col("i").alias("node")), "node", "left_semi"))
    short = stored(short_resources(g).join(ids, F.col("node") == F.col("i"), "left_semi"))
    makes = made.join(ids, F.col("producer") == F.col("i"), "left_semi").join(block, "file").select(F.col("producer").alias("src"), F.col("step").alias("dst"))
    held = unsafe.join(ids, F.col("anc") == F.col("i"), "left_semi").select(F.col("anc").alias("src"), F.col("node").alias("dst"))
    return Pending(g, u, block, dead, unsafe, short, stored(makes.unionByName(held).distinct()), made)


def seeds(p: Pending) -> DataFrame:
    """root_kind, root, step: what dead files and short resources block directly; a root is a file's id or a resource's name."""
    f = p.file_block.join(p.dead.select(F.col("i").alias("file")), "file", "left_semi").select(F.lit(FILE).alias("root_kind"), F.col("file").cast("string").alias("root"), "step")
    r = p.short.select(F.lit(RESOURCE).alias("root_kind"), F.col("name").alias("root"), F.col("node").alias("step"))
    return f.unionByName(r).distinct()


def candidates(p: Pending) -> DataFrame:
    """step, kind, src, src_label: all that may count as a step's blocker."""
    g, u = p.g, p.universe
    name, mine = (x.select(F.col("i").alias("src_i"), F.col("label").alias("src_label")) for x in (p.names, u))
    state = g.step.select(F.col("node").alias("src_i"), F.col("state").alias("src_state"))
    row = lambda df, step, kind, src, label: df.select(F.col(step).alias("step"), F.lit(kind).alias("kind"), src.alias("src"), label.alias("src_label"))
    none = F.lit("")
    parts = [
        row(p.file_block.join(p.dead, F.col("file") == F.col("i")), "step", FILE, F.col("file").cast("string"), F.col("label")),
        row(p.short, "node", RESOURCE, F.col("name"), F.col("name")),
    ]
    failed = p.failed.join(name, F.col("producer") == F.col("src_i"))
    parts.append(row(failed, "step", FAILED, F.col("producer").cast("string"), F.col("src_label")))
    above = p.unsafe.join(state, F.col("anc") == F.col("src_i")).join(name, "src_i")
    parts.append(row(above.filter(F.col("src_state") == S.FAILED), "node", FAILED, F.col("anc").cast("string"), F.col("src_label")))
    stale = u.filter("deferred").join(p.file_block, F.col("i") == F.col("step"), "left_anti")
    parts.append(row(stale, "i", DEFERRED, F.col("i").cast("string"), none))
    outside = above.filter(F.col("src_state") != S.FAILED).join(u.select("i"), F.col("anc") == F.col("i"), "left_anti")
    parts.append(row(outside, "node", OTHER, F.col("anc").cast("string"), none))
    parts.append(row(p.step_block.join(mine, F.col("src") == F.col("src_i")), "dst", STEP, F.col("src").cast("string"), F.col("src_label")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def primary_blocker(p: Pending) -> DataFrame:
    """step, kind, src: the first blocker by kind, label and source; runnable where there is none.

    A minimum of the ordered triple rather than a ranked window: it is combined before the shuffle. Every step is a candidate
    behind all others, so the candidates are made once.
    """
    order = F.struct("kind", "src_label", F.lpad("src", 20, "0").alias("pad"), "src")
    last = p.universe.select(F.col("i").alias("step"), F.lit(NONE).alias("kind"), F.col("i").cast("string").alias("src"), F.lit("").alias("src_label"))
    best = candidates(p).unionByName(last).groupBy("step").agg(F.min(order).alias("b"))
    return best.select("step", F.when(F.col("b.kind") == NONE, RUNNABLE).otherwise(F.col("b.kind")).alias("kind"), "b.src")


def attribute(p: Pending) -> DataFrame:
    """step, root_kind, root: the root at the end of each step's chain of primary blockers; what hangs on a cycle is absent."""
    b = stored(primary_blocker(p))
    tops = b.filter(F.col("kind") != STEP)
    links = b.filter(F.col("kind") == STEP).select(F.col("step").alias("i"), F.col("src").cast("long").alias("parent"))
    ends = fixpoint.forest_roots(links, tops.select(F.col("step").alias("i")))
    return ends.join(tops, F.col("root") == F.col("step")).select(F.col("i").alias("step"), F.col("kind").alias("root_kind"), F.col("src").alias("root"))


def ranked_roots(p: Pending, attributed: DataFrame) -> DataFrame:
    """root_kind, root, n: dead files and short resources with the steps attributed to them, none included."""
    roots = p.dead.select(F.lit(FILE).alias("root_kind"), F.col("i").cast("string").alias("root")).unionByName(p.short.select(F.lit(RESOURCE).alias("root_kind"), F.col("name").alias("root")).distinct())
    counts = attributed.groupBy("root_kind", "root").agg(F.count(F.lit(1)).alias("n"))
    return roots.join(counts, ["root_kind", "root"], "left").select("root_kind", "root", F.coalesce("n", F.lit(0)).alias("n"))


def _order(kind: int) -> list:
    return [F.desc("n"), F.col("root").cast("long") if kind == FILE else F.col("root")]


def exact_counts(p: Pending, roots: DataFrame) -> DataFrame:
    """root_kind, root, nblocked: all steps that each root blocks, however far; roots are few (a pool), so are the closures."""
    s = seeds(p).join(roots.select("root_kind", "root"), ["root_kind", "root"], "left_semi")
    key = F.concat_ws("/", F.col("root_kind").cast("string"), F.col("root"))
    met = fixpoint.reach(p.step_block, s.select(key.alias("root"), F.col("step").alias("i")))
    n = met.groupBy("root").agg(F.count(F.lit(1)).alias("nblocked"))
    return n.select(F.split("root", "/", 2)[0].cast("int").alias("root_kind"), F.split("root", "/", 2)[1].alias("root"), "nblocked")


def top_roots(p: Pending, kind: int, attributed: DataFrame) -> DataFrame:
    """root, nblocked: the SHOWN roots with the largest exact counts, out of the POOL with the largest attributed ones."""
    ranked = ranked_roots(p, attributed).filter(F.col("root_kind") == kind)
    pool = stored(ranked.orderBy(*_order(kind)).limit(POOL))
    exact = pool.join(exact_counts(p, pool), ["root_kind", "root"], "left").select("root", F.coalesce("nblocked", F.lit(0)).alias("nblocked"))
    return exact.orderBy(F.desc("nblocked"), _order(kind)[1]).limit(SHOWN)


def hidden(p: Pending, kind: int, attributed: DataFrame, shown: DataFrame) -> DataFrame:
    """n_hidden, n_blocked: how many roots of a kind aren't shown (root), and the steps attributed to them, a lower bound."""
    rest = ranked_roots(p, attributed).filter(F.col("root_kind") == kind).join(shown.select("root"), "root", "left_anti")
    return rest.agg(F.count(F.lit(1)).alias("n_hidden"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_blocked"))


def hidden_counts(p: Pending) -> DataFrame:
    """root_kind, n_hidden, n_blocked of the kinds with hidden roots."""
    a = stored(attribute(p))
    parts = [hidden(p, kind, a, top_roots(p, kind, a)).select(F.lit(kind).alias("root_kind"), "n_hidden", "n_blocked") for kind in (FILE, RESOURCE)]
    return parts[0].unionByName(parts[1]).filter("n_hidden > 0")


def blocking_inputs(p: Pending) -> DataFrame:
    """The flagship: state, path, detached, nblocked of the files that block most steps."""
    return _shown_inputs(p, top_roots(p, FILE, attribute(p))).orderBy(F.desc("nblocked"), "path")


def _shown_inputs(p: Pending, top: DataFrame) -> DataFrame:
    return top.join(p.dead, F.col("root").cast("long") == F.col("i")).select("state", F.col("label").alias("path"), "detached", "nblocked")


def blocking_resources(p: Pending) -> DataFrame:
    """name, units_needed, units_available, nblocked."""
    return _shown_resources(p, top_roots(p, RESOURCE, attribute(p))).orderBy(F.desc("nblocked"), "name")


def _shown_resources(p: Pending, top: DataFrame) -> DataFrame:
    short = p.short.groupBy("name").agg(F.max("units").alias("units_needed"), F.max("available").alias("units_available"))
    return top.join(short, F.col("root") == F.col("name")).select("name", "units_needed", "units_available", "nblocked")


def report(p: Pending) -> DataFrame:
    """section, position, key, detail, count (text): the rows of a report on what is pending: inputs, resources, each with a
    remainder row where roots stay hidden, and what remains by kind. Formatting only; at most a few dozen rows."""
    a = stored(attribute(p))
    row = lambda df, section, key, detail, count, order: df.select(F.lit(section).alias("section"), order.alias("position"), key.alias("key"), detail.alias("detail"), count.alias("count"))
    out = []
    names = F.create_map(*(F.lit(x) for k, v in STATE_NAMES.items() for x in (k, v)))
    for kind, section, noun in ((FILE, "inputs", "input(s)"), (RESOURCE, "resources", "resource(s)")):
        top = stored(top_roots(p, kind, a))
        order = lambda key: F.row_number().over(Window.orderBy(F.desc("nblocked"), key))
        if kind == FILE:
            path = F.when(F.col("detached"), F.concat(F.lit("("), F.col("path"), F.lit(")"))).otherwise(F.col("path"))
            out.append(row(_shown_inputs(p, top), section, names[F.col("state")], path, F.col("nblocked").cast("string"), order("path")))
        else:
            have = F.coalesce(F.concat(F.col("units_available").cast("string"), F.lit(" available")), F.lit("none available"))
            out.append(row(_shown_resources(p, top), section, F.col("name"), F.concat(F.col("units_needed").cast("string"), F.lit(" needed, "), have), F.col("nblocked").cast("string"), order("name")))
        rest = hidden(p, kind, a, top).filter("n_hidden > 0")
        least = F.when(F.col("n_blocked") > 0, F.concat(F.lit("≥ "), F.col("n_blocked").cast("string"))).otherwise("")
        out.append(row(rest, section, F.lit(""), F.format_string(f"... and %d more {noun}", "n_hidden"), least, F.lit(SHOWN + 1)))
    kinds = {FAILED: "failed", DEFERRED: "deferred", OTHER: "other", RUNNABLE: "runnable"}
    label = F.create_map(*(F.lit(x) for k, v in kinds.items() for x in (k, v)))
    more = buckets(p, a).filter(F.col("root_kind").isNull() | F.col("root_kind").isin(*kinds))
    out.append(row(more, "kinds", F.coalesce(label[F.col("root_kind")], F.lit("cyclic")), F.col("example"), F.col("nblocked").cast("string"), F.coalesce(F.col("root_kind"), F.lit(STEP))))
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


def buckets(p: Pending, attributed: DataFrame) -> DataFrame:
    """root_kind, nblocked, example: attributed steps by kind; kind null: on a cycle."""
    u = p.universe.join(attributed.select(F.col("step").alias("i"), "root_kind"), "i", "left")
    return u.groupBy("root_kind").agg(F.count(F.lit(1)).alias("nblocked"), F.min("label").alias("example"))


def summary(p: Pending) -> DataFrame:
    """One row: all pending steps, dead files, short resources, attributed and cyclic steps."""
    a = stored(attribute(p))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(p.universe, "n_pending")
    for df, name in ((p.dead, "n_inputs"), (p.short.select("name").distinct(), "n_resources"), (a, "n_attributed"), (p.universe.join(a, F.col("i") == F.col("step"), "left_anti"), "n_cyclic")):
        out = out.crossJoin(one(df, name))  # one row each
    return out


def ranked_window(p: Pending) -> DataFrame:
    """step, kind, src, rank of all candidates, as a window: for reports that show more than the first blocker."""
    order = Window.partitionBy("step").orderBy("kind", "src_label", "src")
    return candidates(p).withColumn("rank", F.row_number().over(order))
