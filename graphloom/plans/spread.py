"""Inner joins of many rows with a table of keys, some of which have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Rows of a key from which on it is hot: its rows stay where they are. All others are shuffled.
HOT_ROWS = 1_000
#: Hot keys that may be broadcast, as counted.
BROADCAST_ROWS = 2_000_000


def counted(rows: DataFrame, key: str) -> DataFrame:
    """key, rows_of_key; counts are combined before the shuffle."""
    return stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key")))


def few(keys: DataFrame) -> DataFrame:
    """keys, stored and marked for broadcast if there are at most BROADCAST_ROWS, as counted."""
    keys = stored(keys)
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def split_hot(rows: DataFrame, known: DataFrame, counts: DataFrame, key: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """(rows, known) of the hot keys, known marked for broadcast, and of the others. counts is what `counted` gave for rows, or for
    more than these. Others have at most HOT_ROWS rows a key; if there are too many hot keys to broadcast, all are others."""
    hot = counts.filter(F.col("rows_of_key") >= HOT_ROWS).select(key)
    if hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return (rows.limit(0), known.limit(0)), (rows, known)
    few = F.broadcast(hot)
    return (rows, F.broadcast(known.join(few, key, "left_semi"))), (rows.join(few, key, "left_anti"), known.join(few, key, "left_anti"))


def join_hot(rows: DataFrame, known: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """rows joined with known on key; no task gathers the rows of a hot key, and these aren't shuffled."""
    hot, rest = split_hot(rows, known, counts, key)
    return hot[0].join(hot[1], key).unionByName(rest[0].join(rest[1], key))
