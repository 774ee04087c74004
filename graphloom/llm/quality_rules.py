"""Rule bitmask ledger.

`ledger` measures each whole text once and evaluates each rule once; it stores the failed rules as bits of `fail_bits`.
`apply_policy` reads the bits only: a policy is a version name and the rules it enforces. `ablations` counts, by bitwise
aggregation in one pass, what each rule of a policy drops alone and together with others; `report` sets them beside the
documents that they concern.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words, so the base rule `few_words` fails; null ids stay null;
repeated rows are measured separately; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines")
#: Rule, and when it fails; the position is its bit.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_word_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("many_words", "n_words > 1000000"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that each enforces.
POLICIES = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols", "dup_lines"),
    "v2": tuple(BIT),
}


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0  # positions before it are counted
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def mask(rules: tuple[str, ...]) -> int:
    return sum(BIT[x] for x in rules)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * len(MEASURES)
    for b in batches:
        rows = [measure(t) for t in b.column(1).to_pylist()]
        cols = list(itertools.zip_longest(*rows)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits."""
    in_batches(docs.sparkSession)
    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return df.withColumn("fail_bits", total)


def passes(rules: tuple[str, ...]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) == 0


def apply_policy(led: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept, as the policy of that version decides."""
    return led.withColumn("base_failed", ~passes(POLICIES["base"])).withColumn("kept", passes(POLICIES["base"]) & passes(POLICIES[version]))


def ablations(led: DataFrame, version: str = "v2") -> DataFrame:
    """One row per rule of the policy: documents it fails, those that it alone fails, and those kept if it were left out; also the bits seen at all and in every document."""
    rules = POLICIES[version]
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    aggs = [F.coalesce(F.bit_or(bits), F.lit(0)).alias("any_bits"), F.coalesce(F.bit_and(bits), F.lit(0)).alias("all_bits"), count(bits == 0).alias("n_kept")]
    for r in rules:
        one = F.lit(BIT[r]).cast("long")
        aggs += [count(bits.bitwiseAND(one) != 0).alias(f"f_{r}"), count(bits == one).alias(f"u_{r}")]
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.col(f"f_{r}").alias("n_failed"), F.col(f"u_{r}").alias("n_only"), (F.col("n_kept") + F.col(f"u_{r}")).alias("n_kept_without"), "any_bits", "all_bits") for r in rules]
    return led.agg(*aggs).select(F.inline(F.array(*cells)))


def report(docs: DataFrame, version: str = "v2", earlier: str = "v1") -> DataFrame:
    """The ledger of docs, written once, under a policy (base_failed, kept) and an earlier one (kept_earlier), and from the policy's
    ablations: sole_rule, the rule without which a document would be kept, and n_sole, how many documents hang on it alone."""
    led = written(ledger(docs), "ledger")
    # a row per rule
    alone = ablations(led, version).select(F.col("bit").alias("_bit"), F.col("rule").alias("sole_rule"), F.col("n_only").alias("n_sole"))
    df = apply_policy(led, version).withColumn("kept_earlier", passes(POLICIES["base"]) & passes(POLICIES[earlier]))
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    return df.join(F.broadcast(alone), failed == F.col("_bit"), "left").drop("_bit")
