"""Scans, projections, joins, set operations and top-k over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as S
from ..plans.spread import counted, join_hot, split_hot
from ..plans.stored import stored
from ..sources.frames import Frames


# Scans


def nodes(g: Frames, kind: str | None = None, include_detached: bool = False) -> DataFrame:
    df = g.node
    if kind is not None:
        df = df.filter(F.col("kind") == kind)
    return df if include_detached else df.filter(~F.col("detached"))


def find(g: Frames, kind: str, label: str, attached_only: bool = False) -> DataFrame:
    df = g.node.filter((F.col("kind") == kind) & (F.col("label") == label))
    return df.filter(~F.col("detached")) if attached_only else df


def file_hashes(g: Frames, paths: DataFrame) -> DataFrame:
    """label, state, digest of the attached files among paths (path), by label. paths is a batch of keys, so Spark may broadcast it."""
    files = nodes(g, "file").join(paths, F.col("label") == F.col("path"), "left_semi")
    return files.join(g.file, F.col("i") == F.col("node")).select("label", "state", "digest").orderBy("label")


def hashes_to_check(g: Frames, ids: DataFrame) -> DataFrame:
    return g.file.join(ids, g.file.node == ids.i).join(g.node.select(F.col("i").alias("n"), "label"), F.col("node") == F.col("n")).select("node", "label", "digest")


def graph_text(g: Frames) -> DataFrame:
    """One line per node: its key, then its sources' and sinks' keys, ordered."""
    n = g.node.select("i", S.key_text(F.col("kind"), F.col("label"), F.col("detached")).alias("key"))
    d = g.dependency
    names = n.select(F.col("i").alias("j"), F.col("key").alias("other"))
    ins = d.join(names, d.source == F.col("j")).groupBy(F.col("sink").alias("i")).agg(F.sort_array(F.collect_list("other")).alias("sources"))
    outs = d.join(names, d.sink == F.col("j")).groupBy(F.col("source").alias("i")).agg(F.sort_array(F.collect_list("other")).alias("sinks"))
    df = n.join(ins, "i", "left").join(outs, "i", "left")
    part = lambda c: F.concat_ws(" ", F.coalesce(F.col(c), F.array().cast("array<string>")))
    return df.select(F.concat("key", F.lit(" <- "), part("sources"), F.lit(" -> "), part("sinks")).alias("line"))


def dot_provenance(g: Frames) -> DataFrame:
    shape = F.when(F.col("kind") == "file", "ellipse").when(F.col("kind") == "step", "box").otherwise("octagon")
    lines = g.node.select(F.format_string("%d [label=%s shape=%s]", "i", F.concat(F.lit('"'), F.col("label"), F.lit('"')), shape).alias("line"))
    edges = g.node.filter("creator IS NOT NULL AND creator != i").select(F.format_string("%d -> %d", "creator", "i").alias("line"))
    return lines.unionByName(edges)


def dot_dependency(g: Frames) -> DataFrame:
    """Edges whose ends aren't files with labels ending in '/'."""
    n = g.node.filter("kind != 'root'").select("i", (F.col("kind").eqNullSafe("file") & F.col("label").endswith("/")).alias("folder")).filter("NOT folder")
    d = g.dependency.join(n.select(F.col("i").alias("source")), "source").join(n.select(F.col("i").alias("sink")), "sink")
    return d.select(F.format_string("%d -> %d", "source", "sink").alias("line"))


# Projections and filters


def steps_in(g: Frames, *states: int) -> DataFrame:
    return g.step.filter(F.col("state").isin(*states)).join(nodes(g, "step").select("i", "label"), F.col("node") == F.col("i")).select("i", "label", "state")


def inputs_of(g: Frames) -> DataFrame:
    """Every step's inputs: step, file, label, state, digest, detached, dynamic."""
    n = g.node.select(F.col("i").alias("file"), "label", "detached")
    f = g.file.select(F.col("node").alias("file"), "state", "digest")
    s = g.step.select(F.col("node").alias("step"))
    d = g.dependency.select(F.col("source").alias("file"), F.col("sink").alias("step"), "dynamic")
    return d.join(s, "step", "left_semi").join(f, "file").join(n, "file").select("step", "file", "label", "state", "digest", "detached", "dynamic")


def outputs_of(g: Frames) -> DataFrame:
    """Every step's outputs: step, file, label, state, detached."""
    n = nodes(g, "file", include_detached=True).select(F.col("i").alias("file"), "label", "detached")
    f = g.file.select(F.col("node").alias("file"), "state")
    d = g.dependency.select(F.col("source").alias("step"), F.col("sink").alias("file"))
    return d.join(g.step.select(F.col("node").alias("step")), "step", "left_semi").join(f, "file").join(n, "file").select("step", "file", "label", "state", "detached")


def regular_outputs(g: Frames) -> DataFrame:
    return outputs_of(g).filter(S.regular_output(F.col("detached"), F.col("state")))


def unavailable_inputs(g: Frames) -> DataFrame:
    return inputs_of(g).filter(S.unavailable_input(F.col("state"), F.col("detached"), F.col("dynamic")))


def with_state(g: Frames) -> DataFrame:
    """Nodes with the state of their file or step."""
    f = g.file.select(F.col("node").alias("i"), F.col("state").alias("fs"))
    s = g.step.select(F.col("node").alias("i"), F.col("state").alias("ss"))
    state = F.when(F.col("kind") == "file", F.col("fs")).when(F.col("kind") == "step", F.col("ss"))
    return g.node.join(f, "i", "left").join(s, "i", "left").select("i", "kind", "label", state.alias("state"))


def search(g: Frames, glob: str) -> DataFrame:
    """Nodes whose label holds the glob, by kind and label."""
    return with_state(g).filter(F.col("label").rlike(glob_regex(f"*{glob}*"))).orderBy("kind", "label")


def glob_regex(glob: str) -> str:
    """A regular expression for a GLOB: `*`, `?` and `[...]`, `[^...]`; any character may be matched, '/' too."""
    out, i = ["(?s)\\A"], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + (3 if glob[i + 1 : i + 2] == "^" else 2)) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = glob[i + 1 : end]
            out.append("[" + ("^" if inner[0] == "^" else "") + "".join(x if x == "-" else "\\" + x if not x.isalnum() else x for x in inner.removeprefix("^")) + "]")
            i = end
        else:
            out.append(c if c.isalnum() else "\\" + c)
        i += 1
    return "".join(out) + "\\z"


def keys(g: Frames) -> DataFrame:
    return g.node.select("i", S.key_text(F.col("kind"), F.col("label"), F.col("detached")).alias("key"))


def dependency_keys(g: Frames) -> DataFrame:
    """Edges as text, with a mark for those found while running."""
    k = keys(g)
    d = g.dependency.join(k.select(F.col("i").alias("source"), F.col("key").alias("a")), "source").join(k.select(F.col("i").alias("sink"), F.col("key").alias("b")), "sink")
    return d.select("i", F.concat("a", F.lit(" -> "), "b", F.when(F.col("dynamic"), " [dynamic]").otherwise("")).alias("edge"))


def command_of(label: Column) -> tuple[Column, Column]:
    """Command and working directory of a step's label."""
    mark = "  # wd="
    at = F.instr(label, mark)
    return F.when(at > 0, F.substring(label, F.lit(1), at - 1)).otherwise(label), F.when(at > 0, F.substring(label, at + len(mark), F.length(label))).otherwise("./")


def env_changed(g: Frames, current: DataFrame) -> DataFrame:
    """Variables whose current value differs, null for unset; current has name and value."""
    now = current.select("name", F.col("value").alias("now"))
    return g.env_var.join(now, "name", "left").filter(~F.col("value").eqNullSafe(F.col("now"))).select("node", "name", "value", "now")


def files_to_rescan(g: Frames) -> DataFrame:
    f = nodes(g, "file").join(g.file, F.col("i") == F.col("node")).filter(~F.col("state").isin(S.PLANNED, S.VOLATILE))
    return f.select("i", "label", "state", F.when(F.col("state") == S.UNCONFIRMED, "CONFIRMED").otherwise("EXTERNAL").alias("cause"))


def parent_dir(path: Column) -> Column:
    """The folder of a path, ending in '/'; './' at the top."""
    found = F.regexp_extract(F.regexp_replace(path, "/$", ""), "^(.*/)", 1)
    return F.when(found == "", "./").otherwise(found)


def watch_dirs(g: Frames) -> DataFrame:
    f = nodes(g, "file").join(g.file.filter(F.col("state") != S.VOLATILE).select(F.col("node").alias("i")), "i", "left_semi")
    trees = nodes(g, "st").select(F.col("label").alias("dir"))
    return f.select(parent_dir(F.col("label")).alias("dir")).unionByName(trees).distinct()


def relevant(state: Column, during_build: Column) -> Column:
    """Whether a change of a file in that state matters: while building only what a user may have edited, else all but what the
    build itself writes."""
    return F.when(during_build, state.isin(S.CONFIRMED, S.MISSING)).otherwise(~state.isin(S.PLANNED, S.VOLATILE))


def relevant_changes(g: Frames, patterns: DataFrame) -> DataFrame:
    """Changed paths with whether they matter: files by their state, paths without a node if a registered pattern matches.

    patterns has regex and base, the folder below which all matches lie; so paths meet only the patterns of their own folders.
    """
    f = nodes(g, "file").join(g.file.select(F.col("node").alias("i"), "state"), "i").select(F.col("label").alias("path"), "state")
    paths = g.change.select("path", "during_build").distinct().join(f, "path", "left")
    above = paths.filter("state IS NULL").select("path", F.explode(F.concat(prefixes(F.col("path")), F.array(F.lit("./")))).alias("base"))
    globbed = above.join(patterns.select("regex", "base"), "base").filter(F.rlike(F.col("path"), F.col("regex"))).select("path").distinct().withColumn("hit", F.lit(True))
    known = relevant(F.col("state"), F.col("during_build"))
    return paths.join(globbed, "path", "left").select("path", "during_build", F.coalesce(known, F.col("hit"), F.lit(False)).alias("relevant"))


def matched_paths(g: Frames) -> DataFrame:
    """path: what the patterns of attached steps have matched, once each."""
    m = g.nglob_match
    return stored(join_hot(m, registrations(g).select("nglob"), counted(m, "nglob"), "nglob").select("path").distinct())


def pattern_matches(g: Frames) -> DataFrame:
    """argument, match: every registered pattern with null and with what it has matched, once each."""
    patterns = g.nglob.select(F.col("i").alias("nglob"), F.col("pattern").alias("argument"))
    m = join_hot(g.nglob_match, patterns, counted(g.nglob_match, "nglob"), "nglob").select("argument", F.col("path").alias("match")).distinct()
    return m.unionByName(patterns.select("argument", F.lit(None).cast("string").alias("match")).distinct())


def paths_below(g: Frames, folder: str, during_build: bool = False, matched: DataFrame | None = None) -> DataFrame:
    """Paths below a folder whose disappearance matters: files in a relevant state (letters A-Z in either case), and what attached
    steps' patterns have matched, in any case; matched: what `matched_paths` gave, if at hand."""
    folder = folder if folder.endswith("/") else folder + "/"
    states = g.file.filter(relevant(F.col("state"), F.lit(during_build))).select(F.col("node").alias("i"))
    f = nodes(g, "file").filter(S.like_prefix(F.col("label"), folder)).join(states, "i", "left_semi").select(F.col("label").alias("path"))
    m = (matched_paths(g) if matched is None else matched).filter(F.col("path").startswith(folder))
    return f.unionByName(m).distinct()


# Patterns that steps have registered


def registrations(g: Frames) -> DataFrame:
    """nglob, pattern, step (its label) of the patterns of attached steps."""
    steps = nodes(g).select(F.col("i").alias("node"), F.col("label").alias("step"))
    return g.nglob.select(F.col("i").alias("nglob"), "node", "pattern").join(steps, "node").select("nglob", "pattern", "step")


def unjustified(g: Frames, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, state, is_error of the recorded matches' paths that nothing static justifies, and how many matches each matched path
    has; present: the paths that exist.

    A path with a node must be a static file; any other state is an error. One without a node is justified in a static tree, as
    a folder that holds a static tree or file, or if it is gone; else it is a warning, and its state is null. Paths are few where
    matches are many, so each is judged once.
    """
    paths = counted(g.nglob_match, "path")
    f = nodes(g, "file").join(g.file.select(F.col("node").alias("i"), "state"), "i").select(F.col("label").alias("path"), "state")
    static = F.col("state").isin(S.UNCONFIRMED, S.MISSING, S.CONFIRMED)
    m = stored(paths.select("path").join(f, "path", "left"))
    errors = m.filter(F.col("state").isNotNull() & ~static)
    bare = m.filter("state IS NULL")
    open_ = bare.select("path").join(present.select("path").distinct(), "path", "left_semi")
    trees = nodes(g, "st").select("label")
    probe = F.when(F.col("path").endswith("/"), F.col("path")).otherwise(F.concat("path", F.lit("/")))
    inside = open_.select("path", F.explode(prefixes(probe)).alias("label")).join(trees, "label", "left_semi").select("path").distinct()
    holders = trees.unionByName(f.filter(static).select(F.col("path").alias("label"))).select(F.explode(F.concat(prefixes(F.col("label")), F.array(F.lit("./"), F.lit("/")))).alias("path")).distinct()
    over = open_.filter("endswith(path, '/')").join(holders, "path", "left_semi")
    loose = open_.join(inside, "path", "left_anti").join(over, "path", "left_anti")
    warnings = bare.join(loose, "path", "left_semi")
    return stored(errors.unionByName(warnings).select("path", "state", F.col("state").isNotNull().alias("is_error"))), paths


def glob_violations(g: Frames, present: DataFrame) -> DataFrame:
    """step, pattern, path, state, is_error of recorded matches that nothing static justifies, as `unjustified` has it. A row per
    match, which may be many times what the tables hold: `violation_counts` gives their numbers without them."""
    bad, paths = unjustified(g, present)
    m = join_hot(g.nglob_match, bad, paths, "path")
    return join_hot(m, registrations(g), counted(g.nglob_match, "nglob"), "nglob").select("step", "pattern", "path", "state", "is_error")


def violation_counts(g: Frames, present: DataFrame) -> DataFrame:
    """step, pattern, state, is_error, n, first: `glob_violations` per registration and state, counted where the matches are: no
    match of a hot path is shuffled, and its least path is found by its place among the hot ones."""
    bad, paths = unjustified(g, present)
    (many, hot), (rest, known) = split_hot(g.nglob_match, bad, paths, "path")
    hot = stored(hot.withColumn("place", F.row_number().over(Window.orderBy("path"))))  # counted before, few enough to broadcast
    by = ["nglob", "state", "is_error"]
    n = F.count(F.lit(1)).alias("n")
    first = F.broadcast(hot.select("place", F.col("path").alias("first")))
    counts = many.join(F.broadcast(hot), "path").groupBy(*by).agg(n, F.min("place").alias("place")).join(first, "place").select(*by, "n", "first")
    counts = counts.unionByName(rest.join(known, "path").groupBy(*by).agg(n, F.min("path").alias("first")))
    return counts.join(registrations(g), "nglob").groupBy("step", "pattern", "state", "is_error").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def grouped_violations(counts: DataFrame) -> DataFrame:
    """`violation_groups` from `violation_counts`."""
    return counts.groupBy("step", "pattern").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_error"), F.col("n")).otherwise(0)).alias("n_errors"), F.min("first").alias("first"))


def violation_groups(violations: DataFrame) -> DataFrame:
    """step, pattern, n, n_errors, first: violations per registration; a group's rows stay where they are."""
    return violations.groupBy("step", "pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_error").cast("int")).alias("n_errors"), F.min("path").alias("first"))


# Joins


def neighbours(g: Frames, towards: str, kind: str | None = None, include_detached: bool = False) -> DataFrame:
    """One hop: for each node, its sources or sinks (towards 'source' or 'sink')."""
    own = "sink" if towards == "source" else "source"
    d = g.dependency.select(F.col(own).alias("of"), F.col(towards).alias("i"))
    return d.join(nodes(g, kind, include_detached).select("i", "kind", "label"), "i").select("of", "i", "kind", "label")


def products(g: Frames) -> DataFrame:
    return nodes(g, include_detached=True).filter("creator IS NOT NULL AND i != creator").select(F.col("creator").alias("of"), "i", "kind", "label")


def with_creator(g: Frames) -> DataFrame:
    c = g.node.select(F.col("i").alias("c"), F.col("kind").alias("creator_kind"), F.col("label").alias("creator_label"))
    return g.node.join(c, F.col("creator") == F.col("c"), "left").select("i", "label", "creator_kind", "creator_label")


def step_paths(g: Frames, role: str, dynamic: bool | None = None, states: tuple[int, ...] = ()) -> DataFrame:
    """step, label of inputs ('inp'), outputs ('out') or volatile outputs ('vol')."""
    df = inputs_of(g) if role == "inp" else outputs_of(g)
    if role != "inp":
        df = df.filter(F.col("state") == S.VOLATILE if role == "vol" else F.col("state") != S.VOLATILE)
    if dynamic is not None:
        df = df.filter(F.col("dynamic") == dynamic)
    if states:
        df = df.filter(F.col("state").isin(*states))
    return df.filter(~F.col("detached")).select("step", "label", "state")


def unconfirmed_inputs(g: Frames) -> DataFrame:
    """Unconfirmed inputs whose creator is a static tree."""
    trees = g.node.filter("kind = 'st'").select(F.col("i").alias("creator"))
    owned = g.node.select(F.col("i").alias("file"), "creator").join(trees, "creator", "left_semi").select("file")
    return inputs_of(g).filter(F.col("state") == S.UNCONFIRMED).join(owned, "file", "left_semi").select("step", "file", "label")


def source_steps(g: Frames) -> DataFrame:
    """Steps two hops back: what makes the inputs of each step."""
    a = g.dependency.select(F.col("source").alias("before"), F.col("sink").alias("file"))
    b = g.dependency.select(F.col("source").alias("file"), F.col("sink").alias("step"))
    s = g.step.select("node")
    # what steps make, first: most edges are inputs
    made = a.join(s, F.col("before") == s.node, "left_semi")
    return made.join(b, "file").join(s, F.col("step") == s.node, "left_semi").select("before", "step").distinct()


def ready_steps(g: Frames) -> DataFrame:
    """node, ready: no input is unavailable."""
    blocked = unavailable_inputs(g).select(F.col("step").alias("node")).distinct()
    ready = g.step.join(blocked, "node", "left_anti").select("node", F.lit(True).alias("ready"))
    return ready.unionByName(g.step.join(blocked, "node", "left_semi").select("node", F.lit(False).alias("ready")))


def targets_in_dirs(g: Frames, outputs: DataFrame | None = None) -> DataFrame:
    """Regular outputs (made here unless at hand) within the target directories. Ranges start with their folder, so the first component is an equality key."""
    first = lambda c: F.concat_ws("/", F.slice(F.split(c, "/"), 1, 2))
    dirs = g.target_dir.withColumn("head", first(F.col("path"))).select("head", F.col("path").alias("dir"), "upper")
    out = (regular_outputs(g) if outputs is None else outputs).withColumn("head", first(F.col("label")))
    return out.join(dirs, "head").filter(S.in_range(F.col("label"), F.col("dir"), F.col("upper"))).select("dir", "file", "label")


def prefixes(path: Column) -> Column:
    """All folders above a path, each ending in '/'."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.concat_ws("/", F.slice(parts, F.lit(1), k)), F.lit("/")))


def owning_trees(g: Frames, paths: DataFrame) -> DataFrame:
    """path, tree: the static trees whose folder holds the path; an equality join on the path's own folders."""
    trees = nodes(g, "st").select(F.col("i").alias("tree"), F.col("label").alias("folder"))
    return paths.select("path", F.explode(prefixes(F.col("path"))).alias("folder")).join(trees, "folder").select("path", "tree")


def claims(g: Frames) -> DataFrame:
    """label, creator, role of every attached file."""
    f = nodes(g, "file").join(g.file.select(F.col("node").alias("i"), "state"), "i")
    role = F.when(F.col("state").isin(S.PLANNED, S.BUILT, S.OUTDATED), "OUTPUT").when(F.col("state") == S.VOLATILE, "VOLATILE").otherwise("STATIC")
    return f.select("label", "creator", role.alias("role"))


def short_resources(g: Frames) -> DataFrame:
    """Requirements that the available resources can't meet."""
    a = g.available_resource.select("name", F.col("units").alias("available"))
    return g.step_resource.join(a, "name", "left").filter("available IS NULL OR available < units")


def concurrent(pairs: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """producer, consumer, overlapped of pairs: whether the consumer started before the producer stopped, ties included; false
    where either time is missing. starts has job and start, stops has job and stop."""
    df = pairs.join(stops.select(F.col("job").alias("producer"), "stop"), "producer", "left").join(starts.select(F.col("job").alias("consumer"), "start"), "consumer", "left")
    return df.select("producer", "consumer", F.coalesce(F.col("start") <= F.col("stop"), F.lit(False)).alias("overlapped"))


def job_spans(g: Frames) -> DataFrame:
    """job_i, description, start, stop (null while open)."""
    t = lambda e: F.max(F.when(F.col("event") == e, F.col("time_ns")))
    return g.joblog.groupBy("job_i", "description").agg(t("START").alias("start"), t("END").alias("stop"))


# Set operations


def glob_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: matches that went and that came."""
    gone = old.select("path").distinct().join(new, "path", "left_anti").select("path", F.lit("deleted").alias("change"))
    return gone.unionByName(new.select("path").distinct().join(old, "path", "left_anti").select("path", F.lit("added").alias("change")))


def digest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of two frames (path, digest): Added, Deleted, Modified or Same."""
    a = old.select("path", F.col("digest").alias("a"), F.lit(True).alias("in_a"))
    b = new.select("path", F.col("digest").alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "Added").when(F.col("in_b").isNull(), "Deleted").when(F.col("a").eqNullSafe(F.col("b")), "Same").otherwise("Modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def overlaps(batches: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, disjoint: whether the two frames (i) of each named pair have no i in common."""
    out = None
    for name, (a, b) in batches.items():
        one = a.join(b, "i", "left_semi").limit(1).agg((F.count(F.lit(1)) == 0).alias("disjoint")).select(F.lit(name).alias("name"), "disjoint")
        out = one if out is None else out.unionByName(one)
    return out


def first_product(g: Frames, regex: str) -> DataFrame:
    """The first output, by label, that the pattern matches."""
    return regular_outputs(g).filter(F.col("label").rlike(regex)).select("file", "label").orderBy("label").limit(1)


def group_matches(paths: DataFrame, regex: str, groups: int) -> DataFrame:
    """captures, paths: matching paths grouped by what the groups captured. Captures are unlikely to repeat without bound: one group is one set of paths by design."""
    cap = F.array(*(F.regexp_extract("path", regex, k) for k in range(1, groups + 1)))
    return paths.filter(F.col("path").rlike(regex)).groupBy(cap.alias("captures")).agg(F.sort_array(F.collect_set("path")).alias("paths"))


def browse(g: Frames, i: int) -> DataFrame:
    """part, i, kind, label, state: a node, its creator, products, sources and sinks."""
    n = with_state(g)
    d = g.dependency
    parts = {
        "node": g.node.filter(F.col("i") == i).select("i"),
        "creator": g.node.filter(F.col("i") == i).select(F.col("creator").alias("i")),
        "product": g.node.filter((F.col("creator") == i) & (F.col("i") != i)).select("i"),
        "source": d.filter(F.col("sink") == i).select(F.col("source").alias("i")),
        "sink": d.filter(F.col("source") == i).select(F.col("sink").alias("i")),
    }
    ids = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), "i")
        ids = one if ids is None else ids.unionByName(one)
    return ids.join(n, "i").select("part", "i", "kind", "label", "state")
