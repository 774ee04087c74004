"""The state machine as functions from frames to new frames, and validation of what would change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import states as S
from ..functions.patterns import has_wildcard
from ..sources.frames import Frames
from .relational import claims, concurrent, nodes, outputs_of, owning_trees, prefixes, regular_outputs
from .scheduling import bad_dynamic, same_duration


#: How often a step may defer in a row, if nothing else is said.
DEFER_CAP = 100


def transition_table(g: Frames) -> DataFrame:
    return g.spark.createDataFrame(S.TRANSITIONS, "cause string, old_state int, known boolean, new_state int, action string")


def transitions(g: Frames, updates: DataFrame) -> DataFrame:
    """node, old_state, new_state, action, ok for updates (node, cause, digest); ok is false where no rule fits.

    The rules are a fixed table of a few rows, so they are broadcast.
    """
    u = updates.join(g.file.select("node", F.col("state").alias("old_state")), "node").withColumn("known", F.col("digest").isNotNull())
    rules = F.broadcast(transition_table(g).withColumn("ok", F.lit(True)))
    return u.join(rules, ["cause", "old_state", "known"], "left").select("node", "old_state", "new_state", "action", F.coalesce("ok", F.lit(False)).alias("ok"))


def apply_transitions(g: Frames, updates: DataFrame) -> DataFrame:
    """The file frame after valid updates."""
    t = transitions(g, updates).filter("ok").select("node", "new_state").join(updates.select("node", F.col("digest").alias("new_digest")), "node")
    df = g.file.join(t, "node", "left")
    keep = F.col("new_state").isin(S.CONFIRMED, S.BUILT, S.OUTDATED)
    return df.select("node", F.coalesce("new_state", "state").alias("state"), F.when(F.col("new_state").isNull(), F.col("digest")).when(keep, F.col("new_digest")).alias("digest"))


def interrupted(g: Frames) -> DataFrame:
    """The step frame on restart: what ran or had failed is pending again, and no longer deferred."""
    again = F.col("state").isin(S.RUNNING, S.CHECKING, S.FAILED)
    return g.step.withColumn("state", F.when(again, S.PENDING).otherwise(F.col("state")))


def created(g: Frames, new: DataFrame) -> DataFrame:
    """The node frame with new nodes (i, kind, label, creator): a detached node of the same kind and label is taken over, with
    its id; others are appended; an attached one stays as it is."""
    n = new.select("kind", "label", F.col("creator").alias("new_creator"), F.col("i").alias("new_i"))
    old = g.node.join(n, ["kind", "label"], "left")
    taken = F.col("new_i").isNotNull() & F.col("detached")
    kept = old.select("i", "kind", "label", F.when(taken, F.col("new_creator")).otherwise(F.col("creator")).alias("creator"), F.when(taken, False).otherwise(F.col("detached")).alias("detached"))
    fresh = new.join(g.node, ["kind", "label"], "left_anti").select("i", "kind", "label", "creator", F.lit(False).alias("detached"))
    return kept.unionByName(fresh)


def recyclable(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """label: declared steps that equal a stored detached one in their ordered inputs and variables; frames have label, inp, env."""
    norm = lambda df: df.select("label", F.array_sort(F.array_distinct("inp")).alias("inp"), F.array_sort(F.array_distinct("env")).alias("env"))
    return norm(declared).join(norm(stored), ["label", "inp", "env"], "left_semi").select("label")


def claim_check(g: Frames, declared: DataFrame) -> DataFrame:
    """label, verdict of declarations (label, creator, role): new, repeated or collides."""
    old = claims(g).select("label", F.col("creator").alias("c"), F.col("role").alias("r"))
    verdict = F.when(F.col("r").isNull(), "new").when((F.col("c") == F.col("creator")) & (F.col("r") == F.col("role")), "repeated").otherwise("collides")
    return declared.join(old, "label", "left").select("label", "role", verdict.alias("verdict"))


def duplicate_steps(g: Frames, declared: DataFrame) -> DataFrame:
    """label, creator of attached steps that are declared again."""
    return nodes(g, "step").join(declared, "label", "left_semi").select("label", "creator")


def define_errors(g: Frames, step: DataFrame, out: DataFrame, vol: DataFrame, env: DataFrame, overrides: DataFrame) -> DataFrame:
    """rule, label of what forbids defining a step: label, out, vol (label), env, overrides (name)."""
    err = lambda df, rule, c="label": df.select(F.lit(rule).alias("rule"), F.col(c).alias("label"))
    taken = out.unionByName(vol).join(claims(g), "label", "left_semi")
    return (
        err(step.join(nodes(g, "step"), "label", "left_semi"), "step exists")
        .unionByName(err(out.intersect(vol), "output and volatile"))
        .unionByName(err(env.intersect(overrides), "used and overridden", "name"))
        .unionByName(err(taken, "already claimed"))
    )


def supply(g: Frames, paths: DataFrame) -> DataFrame:
    """path, file (null: to be created), verdict of input paths: ok, to_check or unavailable."""
    f = nodes(g, "file").join(g.file.select(F.col("node").alias("i"), "state"), "i").select(F.col("label").alias("path"), F.col("i").alias("file"), "state")
    verdict = F.when(S.available(F.col("state")), "ok").when(F.col("state") == S.UNCONFIRMED, "to_check").otherwise("unavailable")
    return paths.join(f, "path", "left").select("path", "file", verdict.alias("verdict"))


def amend(g: Frames, wanted: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """step, path, verdict of inputs found while running (step, path): unavailable, to_check, ok, or unfresh where the step that
    built the file stopped only after this one had started; starts and stops as in `concurrent`."""
    one = supply(g, wanted.select("path").distinct())
    built = g.file.filter(F.col("state") == S.BUILT).select(F.col("node").alias("i"))
    makers = g.node.join(built, "i", "left_semi").join(g.step.select(F.col("node").alias("creator")), "creator", "left_semi").select(F.col("i").alias("file"), F.col("creator").alias("producer"))
    df = wanted.select("step", "path").distinct().join(one, "path").join(makers, "file", "left")
    late = concurrent(df.filter("producer IS NOT NULL").select("producer", F.col("step").alias("consumer")).distinct(), starts, stops).filter("overlapped")
    df = df.join(late.select("producer", F.col("consumer").alias("step"), "overlapped"), ["producer", "step"], "left")
    return df.select("step", "path", F.when((F.col("verdict") == "ok") & F.col("overlapped"), "unfresh").otherwise(F.col("verdict")).alias("verdict"))


def output_conflicts(g: Frames, declared: DataFrame, patterns: DataFrame) -> DataFrame:
    """step, path, rule of outputs that a step can't declare (step, path, role OUTPUT or VOLATILE): both roles at once, claimed
    otherwise, or matched by a registered pattern (regex, base)."""
    both = declared.groupBy("step", "path").agg(F.count_distinct("role").alias("n")).filter("n > 1").select("step", "path", F.lit("output and volatile").alias("rule"))
    ids = declared.select("step", "path", "role").distinct()
    old = claims(g).select(F.col("label").alias("path"), F.col("creator").alias("c"), F.col("role").alias("r"))
    other = ids.join(old, "path").filter((F.col("c") != F.col("step")) | (F.col("r") != F.col("role"))).select("step", "path", F.lit("already claimed").alias("rule"))
    own = old.select("path", F.col("c").alias("step"), F.col("r").alias("role"))
    new = ids.join(own, ["step", "path", "role"], "left_anti")
    above = new.select("step", "path", F.explode(F.concat(prefixes(F.col("path")), F.array(F.lit("./")))).alias("base")).join(patterns.select("regex", "base"), "base")
    globbed = above.filter(F.rlike(F.col("path"), F.col("regex"))).select("step", "path", F.lit("matches a pattern").alias("rule")).distinct()
    return both.unionByName(other).unionByName(globbed)


def declared_static(g: Frames, paths: DataFrame) -> DataFrame:
    """Paths that would be new static files, ordered and without repeats."""
    return paths.select("path").distinct().join(nodes(g, "file").select(F.col("label").alias("path")), "path", "left_anti").orderBy("path")


def tree_conflicts(g: Frames, trees: DataFrame) -> DataFrame:
    """path, other: new trees (path) nested in registered ones or holding them; both ways are equality joins on folders."""
    up = owning_trees(g, trees).join(nodes(g, "st").select(F.col("i").alias("tree"), F.col("label").alias("other")), "tree").select("path", "other")
    old = nodes(g, "st").select(F.col("label").alias("other"), F.explode(prefixes(F.col("label"))).alias("path"))
    return up.unionByName(trees.join(old, "path").select("path", "other")).distinct()


def reset_for_rerun(g: Frames, steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dependency, env_var, file) frames before steps (i) run again: what earlier runs found is dropped, built outputs are outdated."""
    redo = steps.select(F.col("i").alias("node"))
    found = g.dependency.filter("dynamic").join(redo, F.col("sink") == F.col("node"), "left_semi").select("source", "sink")
    dep = g.dependency.join(found, ["source", "sink"], "left_anti").select("i", "source", "sink", "dynamic")
    late = g.env_var.filter("dynamic").join(redo, "node", "left_semi").select("node", "name")
    env = g.env_var.join(late, ["node", "name"], "left_anti")
    out = g.dependency.join(redo, F.col("source") == F.col("node"), "left_semi").select(F.col("sink").alias("node")).distinct().withColumn("redo", F.lit(True))
    file = g.file.join(out, "node", "left").select("node", F.when(F.col("redo") & (F.col("state") == S.BUILT), S.OUTDATED).otherwise(F.col("state")).alias("state"), "digest")
    return dep, env, file


def completed(g: Frames, results: DataFrame, cap: int = DEFER_CAP) -> DataFrame:
    """node, state, deferred, defer_count, has_hash, holding of the steps that have results (node, outcome: SUCCEED, FAIL, DEFER).

    Only success starts the count of defers anew; a step that defers more than `cap` times in a row fails. A deferred step stays
    so only while an input found while running isn't there. Only success leaves a hash, and no completed step holds.
    """
    late = bad_dynamic(g).withColumn("late", F.lit(True))
    r = g.step.join(results.select("node", "outcome"), "node").join(late, "node", "left")
    outcome, count = F.col("outcome"), F.col("defer_count") + (F.col("outcome") == "DEFER").cast("int")
    again = (outcome == "DEFER") & (count <= cap)
    state = F.when(outcome == "SUCCEED", S.SUCCEEDED).when(again, S.PENDING).otherwise(S.FAILED)
    return r.select(
        "node", state.alias("state"), (again & F.coalesce("late", F.lit(False))).alias("deferred"),
        F.when(outcome == "SUCCEED", 0).otherwise(count).cast("int").alias("defer_count"), (outcome == "SUCCEED").alias("has_hash"), F.lit(0).alias("holding"),
    )


def optional_reverted(g: Frames, needs: DataFrame) -> DataFrame:
    """node, file, label: outputs of steps that turned out optional and had been made: steps go back to pending, files go."""
    s = g.step.join(needs.filter(F.col("implied_need") == S.OPTIONAL), "node", "left_semi").filter(F.col("state").isin(S.SUCCEEDED, S.FAILED)).select("node")
    made = outputs_of(g).filter(F.col("state").isin(S.BUILT, S.OUTDATED, S.VOLATILE))
    return made.join(s, F.col("step") == F.col("node"), "left_semi").select(F.col("step").alias("node"), "file", "label")


def missing_targets(g: Frames, targets: DataFrame) -> DataFrame:
    """Target paths that no attached, regular output has."""
    return targets.join(regular_outputs(g).select(F.col("label").alias("path")), "path", "left_anti")


def missing_target_dirs(g: Frames, dirs: DataFrame) -> DataFrame:
    """Target directories (path) with no regular output below; an equality join on the outputs' own folders."""
    held = regular_outputs(g).select(F.explode(prefixes(F.col("label"))).alias("path")).distinct()
    return dirs.select("path").distinct().join(held, "path", "left_anti")


def new_durations(g: Frames, measured: DataFrame) -> DataFrame:
    """node, duration to be stored: changes above a tenth; measured has node and new."""
    return g.step.join(measured, "node").filter(~same_duration(F.col("duration"), F.col("new"))).select("node", F.col("new").alias("duration"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with rows of new replacing those of the same key, and added."""
    return old.join(new, key, "left_anti").unionByName(new)


def hash_refresh(old: DataFrame, seen: DataFrame) -> DataFrame:
    """path, change, digest, mode, size of every file with a stored hash: what a look at the disk changes.

    old and seen have path, digest, mode, size, mtime and inode; in old a null digest is that of a file that wasn't there, and what
    isn't there now is absent in seen. A file whose mode, size, mtime and inode are as before isn't hashed again, so its old digest
    stands. change: same, changed, vanished, missing (still) or appeared; times and inodes alone are no change.
    """
    now = seen.select("path", *(F.col(c).alias(f"_{c}") for c in ("digest", "mode", "size", "mtime", "inode")), F.lit(True).alias("_there"))
    df = old.join(now, "path", "left")
    kept = F.col("_there") & F.col("digest").isNotNull()
    for c in ("mode", "size", "mtime", "inode"):
        kept = kept & (F.col(c) == F.col(f"_{c}"))
    digest = F.when(kept, F.col("digest")).otherwise(F.col("_digest"))
    same = (F.col("digest") == digest) & (F.col("mode") == F.col("_mode")) & (F.col("size") == F.col("_size"))
    there = F.col("_there").isNotNull()
    change = F.when(~there, F.when(F.col("digest").isNull(), "missing").otherwise("vanished")).when(F.col("digest").isNull(), "appeared").when(same, "same").otherwise("changed")
    return df.select("path", change.alias("change"), F.when(there, digest).alias("digest"), F.col("_mode").alias("mode"), F.col("_size").alias("size"))


def hash_messages(old: DataFrame, refreshed: DataFrame) -> DataFrame:
    """path, message, by path: inputs that changed or vanished unexpectedly, with what differs."""
    n = refreshed.filter("change IN ('changed', 'vanished')").select("path", "change", F.col("digest").alias("d"), F.col("mode").alias("m"), F.col("size").alias("s"))
    part = lambda name, a, b: F.when(~F.col(a).eqNullSafe(F.col(b)), F.concat(F.lit(f"{name} "), F.col(a).cast("string"), F.lit(" -> "), F.col(b).cast("string")))
    df = old.join(n, "path").withColumn("da", F.substring("digest", 1, 8)).withColumn("db", F.substring("d", 1, 8))
    parts = F.concat_ws(", ", part("digest", "da", "db"), part("size", "size", "s"), part("mode", "mode", "m"))
    text = F.when(F.col("change") == "vanished", "vanished").otherwise(F.concat(F.lit("changed ("), parts, F.lit(")")))
    return df.select("path", text.alias("message")).orderBy("path")


def static_classified(arguments: DataFrame, present: DataFrame) -> DataFrame:
    """kind ('tree', 'file', 'pattern' or 'absent'), path, without repeats and by kind and path, of arguments (argument, match):
    a pattern comes with each of its matches, if any; present has path, where folders end in '/'."""
    wild = has_wildcard(F.col("argument"))
    patterns = arguments.filter(wild).select(F.lit("pattern").alias("kind"), F.col("argument").alias("path"))
    named = arguments.select(F.when(wild, F.col("match")).otherwise(F.col("argument")).alias("path")).filter("path IS NOT NULL")
    named = named.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    there = present.select(F.regexp_replace("path", "/+$", "").alias("path"), F.col("path").endswith("/").alias("folder")).groupBy("path").agg(F.bool_or("folder").alias("folder"))
    df = named.join(there, "path", "left")
    kind = F.when(F.col("folder"), "tree").when(F.col("folder").isNull(), "absent").otherwise("file")
    found = df.select(kind.alias("kind"), F.when(F.col("folder"), F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("path"))
    return patterns.distinct().unionByName(found).orderBy("kind", "path")
