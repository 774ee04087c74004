"""Temperature mixing of sources, in DataFrame functions only.

A source's share p of the tokens gets the weight p**a / sum(p**a). The exponent a in [0, 1] is bisected, many points a round,
to the largest that reaches a target entropy, or to the smallest whose quotas repeat no source more than a limit. Quotas
(weight times budget) are realised as block permutations: in each epoch a source's documents fall, by a hash of id, text
length and epoch, into blocks; full epochs hold all blocks, and the last one is filled block by block, then document by
document within the block that meets the quota, to the last document that still begins below it. So only one block per source
needs an order across its rows, and a block is split again by the hash's next digits: no source gathers in one task.

Without a budget, the smallest one that covers every source once is taken, so mixing repeats documents but drops none.

Tokens are words `[^\\x20\\x09-\\x0D]+`, at least 1 a document. Null texts have no words; null sources are one source; null ids and
repeated rows are kept; rows with equal hashes go together. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, written

POINTS = 31
ROUNDS = 7
#: Hexadecimal digits of the hash that number a block, and those that split the block that meets the quota.
DIGITS = 2
WORD = "[^\\x20\\x09-\\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """source, n_docs, tokens; docs has source and tokens."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens"))


def exponent(totals: DataFrame, total: int, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """Bisect the exponent, POINTS + 1 intervals a round; the driver sees only sums over the sources.

    entropy: share of the largest entropy, ln(number of sources). max_repeats: most epochs of any source, against `budget` or,
    without one, against the least-repeated source. With both, the larger exponent, which keeps either's limit on repeats.
    """
    p = F.col("tokens") / F.lit(float(total))

    def measures(points: list[float]) -> list[tuple[float, float, float, float, int]]:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, a in enumerate(points):
            w = F.pow(p, F.lit(a))
            aggs += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"h{i}"), F.max(w / p).alias(f"most{i}"), F.min(w / p).alias(f"least{i}")]
        r = totals.agg(*aggs).first()
        return [(r[f"z{i}"], r[f"h{i}"], r[f"most{i}"], r[f"least{i}"], r["n"]) for i in range(len(points))]

    def bisect(holds, larger: bool) -> float:
        low, high = 0.0, 1.0
        ends = measures([0.0, 1.0])
        if holds(*ends[larger]):
            return float(larger)
        for _ in range(ROUNDS):
            points = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
            good = [holds(*m) for m in measures(points)]
            edges = [low, *points, high]
            # entropy falls and so do repeats as the exponent grows
            k = sum(good) if larger else len(good) - sum(good)
            low, high = edges[k], edges[k + 1]
        return low if larger else high

    # sum(w * ln w) / z - ln z is minus the entropy of w / z
    out = []
    if entropy is not None:
        out.append(bisect(lambda z, h, most, least, n: math.log(z) - h / z >= entropy * math.log(n) - 1e-12, True))
    if max_repeats is not None:
        worst = (lambda z, h, most, least, n: most / z * budget / total) if budget is not None else (lambda z, h, most, least, n: most / least)
        out.append(bisect(lambda *m: worst(*m) <= max_repeats * (1 + 1e-12), False))
    return max(out, default=1.0)


def weights(totals: DataFrame, a: float, total: int, budget: int | None) -> DataFrame:
    """totals with weight, quota (whole tokens), epochs (full ones) and part (tokens of the last)."""
    p = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    sums = totals.agg(F.sum(p).alias("z"), F.min(p / F.col("tokens")).alias("least")).first()
    z = sums["z"] or 1.0
    if budget is None:
        # every source fully once: the least-repeated source has exactly one epoch
        quota = F.greatest(F.col("tokens"), F.round(p / F.lit(sums["least"] or 1.0), 0).cast("long"))
    else:
        quota = F.floor(p / F.lit(z) * F.lit(float(budget)) + F.lit(1e-6))
    df = totals.withColumn("weight", p / F.lit(z)).withColumn("quota", quota)
    return df.withColumn("epochs", F.floor(F.col("quota") / F.col("tokens"))).withColumn("part", F.col("quota") - F.col("epochs") * F.col("tokens"))


def permuted(key: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def cuts(last: DataFrame) -> DataFrame:
    """source, cut: the largest hash of the last epoch; last has source, left (tokens to fill), hash and tokens.

    The block that meets the quota is found by its sums, twice; only the rows of that part of a block are put in order.
    """
    for level in range(2):
        block = F.substring("hash", 1 + DIGITS * level, DIGITS)
        sums = last.groupBy("source", "left", block.alias("block")).agg(F.sum("tokens").alias("sum"))
        before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** DIGITS rows a source at most
        sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).filter("before < left and before + sum >= left")
        sums = sums.select(F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("left") - F.col("before")).alias("rest"))
        last = last.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (block == F.col("_b"))).select("source", "hash", "tokens", F.col("rest").alias("left"))
    before = Window.partitionBy("source").orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = last.withColumn("upto", F.sum("tokens").over(before)).groupBy("source", "left", "hash").agg(F.max("upto").alias("upto"), F.sum("tokens").alias("own"))
    return upto.filter("upto - own < left").groupBy("source").agg(F.max("hash").alias("cut"))


def document_key() -> Column:
    """What the permutation hashes: id and text length, so that rows that repeat an id are told apart."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.length("text"), F.lit(0)).cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens and key of every document, written once: the texts aren't read again."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("tokens"), document_key().alias("key"))
    return written(df, "mix")


def quotas(rows: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget_share: float | None = None, seed: int = 1) -> DataFrame:
    """Per source: weight, quota, epochs, and the cut of the epoch after them (null: none); rows as `sized` gives them.

    budget_share: tokens to emit, as a share of the tokens there are.
    """
    totals = written(source_totals(rows), "sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = None if budget_share is None else int(total * budget_share)
    a = exponent(totals, total, entropy, max_repeats, budget) if total else 1.0
    w = weights(totals, a, max(total, 1), budget)
    need = w.filter("part > 0").select(F.col("source").alias("_s"), "epochs", F.col("part").alias("left"))
    last = rows.join(need, F.col("source").eqNullSafe(F.col("_s"))).select("source", "tokens", "left", permuted(F.col("key"), F.col("epochs"), seed).alias("hash"))
    c = cuts(last).withColumnRenamed("source", "_s")
    w = w.join(c, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_gl_s"), F.col("weight").alias("_gl_weight"), F.col("quota").alias("_gl_quota"), F.col("epochs").alias("_gl_epochs"), F.col("cut").alias("_gl_cut"))
    return written(w, "quotas")


def used(rows: DataFrame, q: DataFrame, key: Column, seed: int = 1) -> DataFrame:
    """rows, once for each epoch that uses them, with `_gl_epoch` and the permutation's `_gl_hash`; rows has a column source."""
    df = rows.withColumn("_gl_key", key).join(keyed(q), F.col("source").cast("string").eqNullSafe(F.col("_gl_s")))
    in_last = permuted(F.col("_gl_key"), F.col("_gl_epochs"), seed) <= F.col("_gl_cut")
    n = F.col("_gl_epochs") + F.coalesce(in_last.cast("long"), F.lit(0))
    df = df.withColumn("_gl_epoch", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))))
    return df.withColumn("_gl_hash", permuted(F.col("_gl_key"), F.col("_gl_epoch"), seed)).drop("_gl_key", "_gl_s", "_gl_weight", "_gl_quota", "_gl_epochs", "_gl_cut")


def mix_plan(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget_share: float | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, place: each use of a document; an epoch's order is by block, then place."""
    rows = sized(docs)
    df = used(rows, quotas(rows, entropy, max_repeats, budget_share, seed), F.col("key"), seed)
    return df.select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.col("_gl_epoch").alias("epoch"), F.substring("_gl_hash", 1, DIGITS).alias("block"), F.col("_gl_hash").alias("place"))


def mixed_documents(docs: DataFrame, max_repeats: float, seed: int = 1) -> DataFrame:
    """docs, with those of small sources repeated so that the temperature's weights hold and no document is dropped."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return used(docs, quotas(sized(docs), max_repeats=max_repeats, seed=seed), document_key(), seed).select(*cols)
