"""Fixed values of the data model, and reusable predicates over its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File states, step states, needs, changes.
UNDECLARED, UNCONFIRMED, MISSING, CONFIRMED, PLANNED, BUILT, OUTDATED, VOLATILE = 11, 12, 13, 14, 15, 16, 17, 18
PENDING, RUNNING, SUCCEEDED, FAILED, CHECKING = 21, 22, 23, 24, 25
OPTIONAL, DEFAULT, TARGET, PLAN = 31, 32, 33, 34
UPDATED, DELETED, DELETED_PARENT = 41, 42, 43

#: What a reported hash does to a file: cause, old state, whether the file is there; new state, action.
TRANSITIONS = [
    ("EXTERNAL", UNCONFIRMED, True, CONFIRMED, "updated"),
    ("EXTERNAL", UNCONFIRMED, False, MISSING, "deleted"),
    ("EXTERNAL", MISSING, True, CONFIRMED, "updated"),
    ("EXTERNAL", CONFIRMED, True, CONFIRMED, "updated"),
    ("EXTERNAL", CONFIRMED, False, MISSING, "deleted"),
    ("EXTERNAL", BUILT, True, PLANNED, "updated"),
    ("EXTERNAL", BUILT, False, PLANNED, "deleted"),
    ("EXTERNAL", OUTDATED, True, PLANNED, "updated"),
    ("EXTERNAL", OUTDATED, False, PLANNED, "deleted"),
    ("SUCCEEDED", PLANNED, True, BUILT, "completed"),
    ("SUCCEEDED", OUTDATED, True, BUILT, "completed"),
    ("FAILED", CONFIRMED, True, CONFIRMED, "updated"),
    ("FAILED", CONFIRMED, False, MISSING, "deleted"),
    ("FAILED", PLANNED, True, OUTDATED, None),
    ("FAILED", PLANNED, False, PLANNED, None),
    ("FAILED", BUILT, True, OUTDATED, "updated"),
    ("FAILED", BUILT, False, PLANNED, "deleted"),
    ("FAILED", OUTDATED, True, OUTDATED, None),
    ("FAILED", OUTDATED, False, PLANNED, None),
    ("CONFIRMED", UNCONFIRMED, True, CONFIRMED, "completed"),
    ("CONFIRMED", UNCONFIRMED, False, MISSING, "deleted"),
    ("CONFIRMED", MISSING, True, CONFIRMED, "completed"),
    ("CONFIRMED", MISSING, False, MISSING, None),
    ("CONFIRMED", CONFIRMED, True, CONFIRMED, None),
    ("CONFIRMED", CONFIRMED, False, MISSING, "deleted"),
]


def available(state: Column) -> Column:
    return state.isin(CONFIRMED, BUILT)


def regular_output(detached: Column, state: Column) -> Column:
    """Attached and not volatile."""
    return ~detached & (state != VOLATILE)


def unavailable_input(state: Column, detached: Column, dynamic: Column) -> Column:
    """Whether an input blocks its step: volatile; found while running, attached and not made; declared and detached or not there."""
    dyn = F.coalesce(dynamic, F.lit(False))
    return (state == VOLATILE) | (dyn & ~detached & state.isin(PLANNED, OUTDATED)) | (~dyn & (detached | ~available(state)))


def can_dispatch(state: Column, safe: Column, safe_ignoring_hold: Column, has_hash: Column, deferred: Column, need: Column, ready: Column) -> Column:
    return (state == PENDING) & (safe | (has_hash & safe_ignoring_hold)) & ~deferred & (need > OPTIONAL) & ready


def chain_ok(state: Column) -> Column:
    return state.isin(RUNNING, SUCCEEDED)


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the reference's LIKE compares."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_prefix(text: Column, prefix: str) -> Column:
    """Starts with the literal prefix, letters A-Z in either case."""
    return ascii_lower(text).startswith("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in prefix))


def in_range(label: Column, low: Column, upper: Column) -> Column:
    """Case-sensitive half-open range; such comparisons reach the Parquet scan."""
    return (label >= low) & (label < upper)


def upper_bound(folder: str) -> str:
    """The upper end of the range of labels below a folder that ends in '/'."""
    return folder[:-1] + chr(ord(folder[-1]) + 1)


def key_text(kind: Column, label: Column, detached: Column) -> Column:
    key = F.concat(kind, F.lit(":"), label)
    return F.when(detached, F.concat(F.lit("("), key, F.lit(")"))).otherwise(key)
