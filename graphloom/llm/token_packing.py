"""Tokens and best-two-fit packing.

Documents become token ids and a closing id; those above the capacity are cut into pieces of full capacity, of which the first
may be shorter. Best-two-fit depends on the pieces' lengths only, so it runs on their histogram (at most `capacity` numbers,
whatever the corpus): a bin is filled greedily with the longest piece that fits, then its shortest piece is replaced by two
unpacked pieces that fit the widened gap more tightly, as long as that helps. Bins with equal contents are made together, as
many as the counts allow, so there are a few thousand kinds of bins at most. The n-th piece of a length then takes the n-th
place for that length; ranks are counted per input partition and summed over partitions, so no length gathers in one task.

Null and empty texts hold the closing id only. Repeated rows and null ids are packed row by row. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_batches, written

CAPACITY = 1024
END_ID = 2
#: White spaces in a row from which the slower library takes over.
LONG_RUN = 10_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class ByteBpe:
    """Ids of whole texts under a byte-level BPE file, as packed unsigned 32-bit numbers.

    The file's vocabulary serves as ranks for the faster of two libraries. Texts with the strings of special tokens go through
    the other one, which knows them, and so do texts with a run of LONG_RUN white spaces, as the faster one's pattern steps back
    through such a run and fails on a million.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special) or (len(text) >= LONG_RUN and _LONG_RUN.search(text)):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.plain(text)).tobytes()


_LOADED: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece; `nth` counts the pieces of its length before it in input partition `part`."""
    in_batches(docs.sparkSession)
    assert sys.byteorder == "little"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, seen, part = encoder(path), array("I", [end_id]).tobytes(), Counter(), TaskContext.get().partitionId()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = (bpe.ids(text) if text else b"") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def tightest_two(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to room; of equal sums, that with the longest."""
    best, found, j = 0, None, 0
    for a in reversed(lengths):
        if a >= room:
            continue
        if 2 * a <= best:
            break
        while j < len(lengths) and lengths[j] <= room - a:
            j += 1
        k = min(j, bisect_right(lengths, a)) - 1
        if k >= 0 and lengths[k] == a and counts[a] < 2:
            k -= 1
        if k >= 0 and a + lengths[k] > best:
            best, found = a + lengths[k], (a, lengths[k])
            if best == room:
                break
    return found


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many bins, the lengths in each), from the histogram of lengths."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts)
    bins: list[tuple[int, list[int]]] = []

    def take(n: int, by: int) -> None:
        if n not in counts:
            lengths.insert(bisect_right(lengths, n), n)
        counts[n] = counts.get(n, 0) - by
        if not counts[n]:
            del counts[n]
            lengths.remove(n)

    while lengths:
        held: list[int] = []
        gap = capacity
        while lengths and (k := bisect_right(lengths, gap)):
            held.append(lengths[k - 1])
            gap -= held[-1]
            take(held[-1], 1)
        while gap and len(held) > 1:
            least = held[-1]
            two = tightest_two(lengths, counts, gap + least)
            if not two or sum(two) <= least:
                break
            held.pop()
            take(least, -1)
            for n in two:
                held.append(n)
                take(n, 1)
            gap -= sum(two) - least
            held.sort(reverse=True)
        uses = Counter(held)
        more = min(counts.get(n, 0) // u for n, u in uses.items())
        for n, u in uses.items():
            if more:
                take(n, more * u)
        bins.append((1 + more, held))
    return bins


def places(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, sequence of the first, offset)."""
    used: Counter[int] = Counter()
    out, base = [], 0
    for many, held in bins:
        offset = 0
        for n in held:
            out.append((n, used[n], used[n] + many, base, offset))
            used[n] += many
            offset += n
        base += many
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cuts = written(pieces(docs, path, capacity, end_id), "pieces")
    per_part = written(cuts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    slots = places(best_two_fit(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cuts.join(per_part, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    cols = [np.array(c, dtype=np.int64) for c in (zip(*slots) if slots else [()] * 5)]
    names = ["_length", "_from", "_to", "_base", "_offset"]
    spots = spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in cols], names))
    # a row per kind of bin and length in it, from a histogram of at most `capacity` numbers, whatever the corpus
    hit = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    out = ranked.join(F.broadcast(spots) if len(slots) <= BROADCAST_ROWS else spots, hit)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))
