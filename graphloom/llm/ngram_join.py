"""N-gram Jaccard join with a prefix tree.

A document's set: its distinct word n-grams as 64-bit hashes. Two documents link when 100 * intersection >= percent * union.
Every link is found, or its ends are already joined by other links.

1. Frequencies. A task cuts its documents into chunks of about CHUNK_GRAMS n-grams, combines equal sets and equal n-grams of a
   chunk, and deals the n-grams by ranges of their hashes. Each range sums how many sets hold an n-gram and answers the chunks
   with those that more than one set holds; an n-gram is a row a chunk there at most, however common it is.
2. Global order: by the logarithm of that frequency, rarest first, then by hash. N-grams that one set alone holds come first
   and can't be shared, so a set needs only its shared ones, ordered, and its size. A linked set shares at least
   ceil(percent * size / 100) n-grams, so most sets end here.
3. Candidates: two linked sets of the order have an n-gram in common among their first size - ceil(percent * size / 100) + 1
   ones. Sets that share such a one are in one cluster.
4. Clusters: a task puts the sets of a cluster in a radix tree of the ordered n-grams and looks each up before inserting it: a
   lookup walks the tree once, carrying the overlap of the shared beginning, and leaves a subtree when the lengths that remain
   rule out the threshold, or when all sets below are already connected with it. Clusters above BLOCK sets are first compared
   with one of their sets, which connects near copies of it; by the triangle inequality sets close to that one can't link to
   any that isn't connected, so only the others remain, and are dealt as pairs of blocks.
5. Links become components by contraction, in Spark.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Fewer words than n are one n-gram. Null texts and texts without words have an
empty set and link with nothing. Rows are nodes: rows that repeat an id are separate but report the same id; null ids are kept,
and a component's id is the smallest id that isn't null. An empty table gives an empty result; other columns are ignored.

Identities: n-grams are 64 bits in a text and the upper 56 of them between texts, sets are 128 bits. A task that is
repeated must meet its rows in the same order, as scans of files do; write other inputs to a table first.
"""

from __future__ import annotations

import pickle
import re
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, in_batches, join_known, keyed, remove, written

N = 3
PERCENT = 90
#: Sets of a cluster that one task compares; larger clusters are split.
BLOCK = 512
#: Texts are hashed in runs of about so many bytes.
RUN_BYTES = 1 << 20
#: N-grams and sets of a chunk, whichever is reached first; a longer document is a chunk of its own.
CHUNK_GRAMS = 1 << 19
CHUNK_SETS = 60_000
#: Bytes of text whose n-grams one range of hashes holds, about.
RANGE_BYTES = 1 << 23
#: Edges up to which one task finds the components, as counted; a round in Spark is several jobs.
TASK_EDGES = 500_000
#: Postings that a task combines before the shuffle.
COMBINED_ROWS = 1 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULT)
_ODD = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_ODD))]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(pow(_ODD, -1, 1 << 64)))]), dtype=np.uint64)
    return up, down


_POW: list[tuple[np.ndarray, np.ndarray]] = [_powers(1 << 12)]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a run of bytes, and where each starts; equal words hash alike wherever they stand."""
    word = ~_SPACES[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(data) >= len(_POW[0][0]):
        _POW[0] = _powers(2 * len(data))
    up, down = _POW[0]
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)])
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MULT), start


def _long_word(x: bytes) -> np.ndarray:
    """The hash of a word of any length, in runs."""
    if len(_POW[0][0]) <= RUN_BYTES:
        _POW[0] = _powers(2 * RUN_BYTES)
    up, total = _POW[0][0], 0
    for at in range(0, len(x), RUN_BYTES):
        data = np.frombuffer(x, np.uint8, min(RUN_BYTES, len(x) - at), at)
        with np.errstate(over="ignore"):
            total += int(np.sum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)) * pow(_ODD, at, 1 << 64)
    return mixed(np.array([(total + len(x) * int(_MULT)) % (1 << 64)], np.uint64))


def text_words(x: bytes) -> np.ndarray:
    """Hashes of the words of a long text, cut at white space into runs, so that only the hashes grow with the text."""
    out, at = [], 0
    while at < len(x):
        end = min(at + RUN_BYTES, len(x))
        if end < len(x):
            cut = max(x.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if cut < 0:
                space = re.compile(rb"[\x20\x09-\x0D]").search(x, end)
                end = space.start() if space else len(x)
                out.append(_long_word(x[at:end]))
                at = end
                continue
            end = cut + 1
        out.append(word_hashes(np.frombuffer(x, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(out)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            grams = mixed(grams * _U(3) + words[i : i + len(grams)] + _U(i + 1))
    return grams


def _few(words: np.ndarray) -> np.ndarray:
    """The one n-gram of fewer words than n; none of none."""
    one = np.zeros(min(1, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(len(words)):
            one = mixed(one * _U(5) + words[i : i + 1] + _U(i + 101))
    return one


def ngram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The ordered distinct n-gram hashes of each text."""
    out: list[np.ndarray] = []
    run: list[bytes] = []

    def flush() -> None:
        words, start = word_hashes(np.frombuffer(b"\n".join(run), np.uint8))
        cuts = [0, *np.searchsorted(start, np.cumsum([len(x) + 1 for x in run])).tolist()]
        grams = _grams(words, n)
        for a, b in zip(cuts, cuts[1:]):
            out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else _few(words[a:b]))
        run.clear()

    size = 0
    for t in texts:
        x = (t or "").encode("utf-8", "surrogatepass")
        if len(x) > RUN_BYTES:
            if run:
                flush()
                size = 0
            words = text_words(x)
            out.append(np.unique(_grams(words, n)) if len(words) >= n else _few(words))
            continue
        run.append(x)
        size += len(x)
        if size > RUN_BYTES:
            flush()
            size = 0
    if run:
        flush()
    return out


def least_common(size: int, percent: int) -> int:
    """Fewest n-grams that a set of that size shares with a set that it links to."""
    return -(-size * percent // 100)


def linkable(size: int, percent: int) -> bool:
    """Whether a set of that size can link to another than itself: one n-gram more, or one exchanged."""
    return size > 0 and 100 * size >= percent * (size + 1)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class PrefixTree:
    """A radix tree of ordered sets that finds what a set links to among those not yet connected with it.

    A set is given by its size and its ordered shared n-grams; the others can't be in common.
    """

    __slots__ = ("percent", "parent", "root")

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.parent: dict[int, int] = {}
        self.root = _Node(np.zeros(0, np.uint64))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def look(self, key: int, n: int, s: np.ndarray) -> list[int]:
        """Keys of sets that link to s, one at least for each component met; they are connected with key."""
        self.parent.setdefault(key, key)
        found: list[int] = []
        shared, pct = len(s), self.percent
        least, most = (n * pct + 99) // 100, n * 100 // pct
        # node, overlap so far, place in s, depth
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, common, at, depth = stack.pop()
            low, high = max(node.least, least), min(node.most, most)
            if low > high or self._connected(node, key):
                continue
            edge = node.edge
            if len(edge):
                end = at + int(np.searchsorted(s[at:], edge[-1], "right"))
                mine = s[at:end]
                if len(mine):
                    i = np.searchsorted(mine, edge)
                    i[i == len(mine)] = 0
                    common += int(np.count_nonzero(mine[i] == edge))
                at, depth = end, depth + len(edge)
            # the size that could reach most, if all that remains on the shorter side were common
            size = min(max(depth + shared - at, low), high)
            if not linked(common + min(shared - at, min(size, node.longest) - depth), n, size, pct):
                continue
            for other, size in node.here:
                if self.find(other) != self.find(key) and linked(common, n, size, pct):
                    self.parent[self.find(other)] = self.find(key)
                    found.append(other)
            stack += [(c, common, at, depth) for c in node.children.values()]
        return found

    def _connected(self, node: _Node, key: int) -> bool:
        """Whether all sets below are known to be connected with key."""
        if node.some is None:
            return False
        mine = self.find(key)
        node.some = list({self.find(k) for k in node.some})
        return node.some == [mine]

    def insert(self, key: int, n: int, s: np.ndarray) -> None:
        self.parent.setdefault(key, key)
        node, at = self.root, 0
        while True:
            node.least, node.most, node.longest = min(node.least, n), max(node.most, n), max(node.longest, len(s))
            node.add(key)
            if at == len(s):
                node.here.append((key, n))
                return
            child = node.children.get(int(s[at]))
            if child is None:
                leaf = _Node(s[at:])
                leaf.here.append((key, n))
                leaf.least = leaf.most = n
                leaf.longest = len(s)
                leaf.add(key)
                node.children[int(s[at])] = leaf
                return
            edge = child.edge
            k = min(len(edge), len(s) - at)
            differ = np.flatnonzero(edge[:k] != s[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(edge):  # split the edge
                upper = _Node(edge[:same])
                upper.least, upper.most, upper.longest = child.least, child.most, child.longest
                upper.some = None if child.some is None else list(child.some)
                child.edge = edge[same:]
                upper.children[int(edge[same])] = child
                node.children[int(s[at])] = child = upper
            node, at = child, at + same


class _Node:
    __slots__ = ("edge", "children", "here", "least", "most", "longest", "some")

    def __init__(self, edge: np.ndarray) -> None:
        self.edge = edge
        self.children: dict[int, _Node] = {}
        self.here: list[tuple[int, int]] = []
        #: Least and largest size, and most shared n-grams, of the sets below.
        self.least, self.most, self.longest = 1 << 60, 0, 0
        #: One key of each component below, or None for too many.
        self.some: list[int] | None = []

    def add(self, key: int) -> None:
        if self.some is not None and key not in self.some:
            self.some = [*self.some, key] if len(self.some) < 64 else None


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, comp of the edges (a, b) of all batches: roots point to their smallest neighbouring root, then all to their roots."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    to = np.arange(len(ids))
    while len(a):
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        apart = a != b
        a, b = a[apart], b[apart]
    for at in range(0, len(ids), BATCH_ROWS):
        part = slice(at, at + BATCH_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[to[part]])], ["id", "comp"])


def components(edges: DataFrame, tag: str) -> DataFrame:
    """id, comp (the smallest id of its component) of all ids in edges (a, b), by contraction: each round every node points to
    its smallest neighbour, pointers are doubled, and edges are rewritten between what they point to. At most TASK_EDGES edges go to one task."""
    edges = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges")
    if edges.limit(TASK_EDGES + 1).count() <= TASK_EDGES:
        out = written(edges.coalesce(1).mapInArrow(_contracted, "id long, comp long"), f"{tag}-label")
        remove(edges)
        return out
    label = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("p"))
        past = [edges]
        for _ in range(2):
            hop = to.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
            to = written(to.join(hop, F.col("p") == F.col("_i")).select("id", F.col("_p").alias("p")), f"{tag}-to")
            past.append(to)
        one = to.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        two = to.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(one, "a").join(two, "b").filter("pa != pb")
        edges = written(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{tag}-edges")
        if label is None:
            label = past.pop()
        else:
            hop = to.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
            past.append(label)
            label = written(label.join(hop, F.col("p") == F.col("_i"), "left").select("id", F.coalesce("_p", "p").alias("p")), f"{tag}-label")
        remove(*past)
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("comp"))
    return label.withColumnRenamed("p", "comp")


MEASURED = "doc_id long, n_shingles long, h1 long, h2 long, s binary"
DEALT = "bucket int, kind int, chunk long, data binary"
ANSWER = "chunk long, kind int, data binary"
#: Kinds of rows on their way: what a chunk must know of itself, and n-grams.
META, GRAMS = 0, 1
#: In place of a set's number: several sets of the chunk hold the n-gram.
MANY = 0xFFFF


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        h = mixed(np.array([np.sum(mixed(s ^ _MULT)), np.sum(mixed(s + _U(_ODD)))], np.uint64) + _U(len(s)))
    a, b = h.view(np.int64).tolist()
    return a, b


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in an ordered array."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def _packed(grams: np.ndarray, *more: np.ndarray) -> bytes:
    """Ordered hashes by their differences, in as many bytes as suit most, those beyond apart, and arrays that go with them."""
    step = np.diff(grams)
    need = np.minimum(-(-np.frexp(step.astype(np.float64))[1] // 8), 8)
    beyond = len(step) - np.cumsum(np.bincount(need, minlength=9))
    width = int(np.argmin(np.arange(9) * len(step) + 12 * beyond))
    far = np.flatnonzero(need > width).astype(np.uint32)
    body = step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return b"".join([struct.pack("<IIBQ", len(grams), len(far), width, int(grams[0])), far.tobytes(), step[far].tobytes(), body, *(m.tobytes() for m in more)])


def _unpacked(data: bytes) -> tuple[np.ndarray, int]:
    """The hashes, and where the arrays that go with them begin."""
    n, beyond, width, first = struct.unpack_from("<IIBQ", data)
    step, at = np.zeros((n - 1, 8), np.uint8), 17 + 12 * beyond
    step[:, :width] = np.frombuffer(data, np.uint8, (n - 1) * width, at).reshape(n - 1, width)
    step = step.view(np.uint64).ravel()
    step[np.frombuffer(data, np.uint32, beyond, 17)] = np.frombuffer(data, np.uint64, beyond, 17 + 4 * beyond)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), step]), dtype=np.uint64), at + (n - 1) * width


class Chunk:
    """Sets of some documents, equal ones once."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.of: list[int] = []
        self.ids: dict[tuple[int, int], int] = {}
        self.sizes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, s: np.ndarray, percent: int) -> None:
        k = self.ids.setdefault(_identity(s), len(self.ids))
        if k == len(self.sizes):
            self.sizes.append(len(s))
            short = s >> _U(8) if linkable(len(s), percent) else s[:0]
            self.sets.append(short[_starts(short)])
            self.held += len(self.sets[-1])
        self.docs.append(doc)
        self.of.append(k)

    def full(self) -> bool:
        return self.held >= CHUNK_GRAMS or len(self.docs) >= CHUNK_SETS

    def rows(self, name: int, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
        """DEALT: the chunk's own row, and a row for each range of hashes with the n-grams in it."""
        grams = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.sets), dtype=np.uint16), [len(s) for s in self.sets])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        start = _starts(grams)
        counts = np.diff(np.concatenate([start, [len(grams)]]))
        many, entry = counts > 1, grams[start]
        place = np.where(many, MANY, owner[start]).astype(np.uint16)
        yield name % buckets, META, name, pickle.dumps((self.docs, np.array(self.of, np.uint16), np.array(self.sizes), list(self.ids), counts[many].astype(np.uint16), owner[np.repeat(many, counts)]))
        bucket = ((entry >> _U(24)) * _U(buckets) >> _U(32)).astype(np.int64)
        cuts = [*_starts(bucket).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(bucket[a]), GRAMS, name, _packed(entry[a:b], place[a:b], counts[a:b][many[a:b]].astype(np.uint32))


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], [f for f, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))


def _answers(chunks: list[int], data: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """ANSWER rows of one range of hashes: to each chunk its n-grams that more than one set holds, and the logarithm of how many."""
    grams, places, counts, ends = [], [], [], [0]
    for d in data:
        g, at = _unpacked(d)
        p = np.frombuffer(d, np.uint16, len(g), at)
        c = np.ones(len(g), np.uint32)
        c[p == MANY] = np.frombuffer(d, np.uint32, int(np.count_nonzero(p == MANY)), at + 2 * len(g))
        grams.append(g)
        places.append(p)
        counts.append(c)
        ends.append(ends[-1] + len(g))
    g, p, c = np.concatenate(grams), np.concatenate(places), np.concatenate(counts)
    del grams, places, counts
    order = np.argsort(g, kind="stable")
    start = _starts(g[order])
    df = np.add.reduceat(c[order], start, dtype=np.int64)
    level = np.zeros(len(g), np.uint8)
    level[order] = np.repeat((np.frexp(df)[1] - 1).astype(np.uint8), np.diff(np.concatenate([start, [len(g)]])))
    for k, chunk in enumerate(chunks):
        x = slice(ends[k], ends[k + 1])
        keep = level[x] > 0
        if keep.any():
            yield chunk, GRAMS, _packed(g[x][keep], p[x][keep], level[x][keep])


def _ordered(meta: tuple, data: list[bytes], percent: int) -> list[tuple]:
    """MEASURED rows of a chunk; s: the ordered n-grams that a set shares with any other, if they may suffice for a link."""
    docs, of, sizes, ids, many, owner = meta
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    many_grams, many_keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for d in data:
        g, at = _unpacked(d)
        p, level = np.frombuffer(d, np.uint16, len(g), at), np.frombuffer(d, np.uint8, len(g), at + 2 * len(g))
        key = level.astype(np.uint64) << _U(58) | g << _U(2)
        keys.append(key[p != MANY])
        owners.append(p[p != MANY])
        many_grams.append(g[p == MANY])
        many_keys.append(key[p == MANY])
    # n-grams of several sets of the chunk all come back; in order they are those that the chunk has counted
    order = np.argsort(np.concatenate(many_grams))
    keys.append(np.repeat(np.concatenate(many_keys)[order], many))
    owners.append(owner)
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    cuts = np.searchsorted(own, np.arange(len(sizes) + 1))
    s: list[bytes | None] = []
    for n, a, b in zip(sizes.tolist(), cuts.tolist(), cuts[1:].tolist()):
        s.append(key[a:b].tobytes() if n and linkable(n, percent) and b - a >= least_common(n, percent) else None)
    out = []
    for doc, k in zip(docs, of.tolist()):
        out.append((doc, int(sizes[k]), *ids[k], s[k]))
        s[k] = None  # rows of equal sets bring it once a chunk
    return out


def measured(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """MEASURED per row."""
    spark = docs.sparkSession
    in_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number, part = Chunk(), 0, TaskContext.get().partitionId()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, s in zip(ids, ngram_sets(texts, n)):
                chunk.add(doc, s, percent)
                if chunk.full():
                    yield _batch(list(chunk.rows(part << 32 | number, buckets)), DEALT)
                    chunk, number = Chunk(), number + 1
        if chunk.docs:
            yield _batch(list(chunk.rows(part << 32 | number, buckets)), DEALT)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            chunks, data = [], []
            for _, kind, chunk, d in group:
                if kind == META:
                    yield _batch([(chunk, kind, d)], ANSWER)
                else:
                    chunks.append(chunk)
                    data.append(d)
            if chunks:
                yield _batch(list(_answers(chunks, data)), ANSWER)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            (_, _, meta), *rest = group
            yield _batch(_ordered(pickle.loads(meta), [d for *_, d in rest], percent), MEASURED)

    dealt = docs.mapInArrow(deal, DEALT).repartition("bucket").sortWithinPartitions("bucket", "kind", "chunk")
    return dealt.mapInArrow(answer, ANSWER).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(order, MEASURED)


def _stars(d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each n-gram starts in rows ordered by n-gram and id, and the first id of each row's n-gram."""
    start = _starts(d)
    return start, np.repeat(i[start], np.diff(np.concatenate([start, [len(d)]])))


def _gathered(nodes: DataFrame, percent: int, combined: int) -> DataFrame:
    """d, id, first: each n-gram of the sets' beginnings once per run of about `combined` rows of an input partition, with the
    smallest id that has it there (first null); every other id of the run is paired with that one (d is only where the pair is
    sent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            d, i = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((i, d))
            d, i = d[order], i[order]
            start, first = _stars(d, i)
            other = i != first
            a, b = i[other], first[other]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b = a[new], b[new]
            cols = [np.concatenate(x) for x in ((d[start], a), (i[start], a), (np.zeros(len(start), np.int64), b))]
            absent = np.arange(len(cols[0])) < len(start)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], mask=absent)], ["d", "id", "first"])

        for i, n, s in _rows(batches):
            # sets without a shared n-gram among those that must meet give none
            d = np.frombuffer(s, np.int64)[: max(0, len(s) // 8 - least_common(n, percent) + 1)]
            held.append((d, np.full(len(d), i)))
            size += len(d)
            if size > combined:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return nodes.select("id", "n", "s").mapInArrow(run, "d long, id long, first long")


def candidate_pairs(nodes: DataFrame, percent: int, combined: int = COMBINED_ROWS) -> DataFrame:
    """(a, b) that connect all sets that share an n-gram of their beginnings; nodes has id, n and s.

    Ids of one n-gram are combined into stars before the shuffle, so one that a third of all sets share is a row per run there;
    the runs' first ids then form a star of their own. A task keeps the current n-gram only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            paired = batch.column(2).is_valid()
            done, rest = batch.filter(paired), batch.filter(pa.compute.invert(paired))
            pairs = set(zip(done.column(1).to_pylist(), done.column(2).to_pylist()))
            if rest.num_rows:
                d, i = rest.column(0).to_numpy(), rest.column(1).to_numpy()
                _, leader = _stars(d, i)
                if d[0] == last:
                    leader = np.where(d == last, first, leader)
                last, first = d[-1], leader[-1]
                pairs |= set(zip(i[i != leader].tolist(), leader[i != leader].tolist()))
            pairs -= seen
            if len(seen) > 200_000:
                seen.clear()
            seen |= pairs
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _gathered(nodes, percent, combined).repartition("d").sortWithinPartitions("d", "id").mapInArrow(run, "a long, b long").distinct()


def against_first(big: DataFrame, percent: int) -> DataFrame:
    """id, cluster, n, s, dist, near: the Jaccard distance of each set to its cluster's first one, and whether they link."""
    first = big.filter("id = cluster").select(F.col("cluster").alias("_c"), F.col("n").alias("_n"), F.col("s").alias("_s"))
    both = big.join(keyed(first, 1000), F.col("cluster") == F.col("_c")).select("id", "cluster", "n", "s", "_n", "_s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dist, near = [], []
            for n, x, m, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                dist.append(1 - common / (n + m - common))
                near.append(linked(common, n, m, percent))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(dist, pa.float64()), pa.array(near, pa.bool_())], ["id", "cluster", "n", "s", "dist", "near"])

    return both.mapInArrow(run, "id long, cluster long, n long, s binary, dist double, near boolean")


def tree_links(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b) links within each task; tasks has cluster, i, j (blocks), block, id, root (what id is connected with already), n, s.

    In a task of two blocks the first is put in the tree and the second looked up. Rows come ordered, so a task holds two
    blocks at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for (_, i, j), group in groupby(_rows(batches), key=lambda r: r[:3]):
            tree = PrefixTree(percent)
            for _, _, _, block, key, root, n, s in group:
                hashes = np.frombuffer(s, np.uint64)
                tree.parent.setdefault(root, root)
                tree.parent.setdefault(key, root)
                if i == j or block == j:
                    out += [(key, other) for other in tree.look(key, n, hashes)]
                if i == j or block == i:
                    tree.insert(key, n, hashes)
            if len(out) > 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    names = ["cluster", "i", "j", "block", "id", "root", "n", "s"]
    return tasks.select(names).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "id").mapInArrow(run, "a long, b long")


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def cluster_links(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all linked sets of each cluster; sets has id, cluster, n, s."""
    sizes = written(sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "sizes")
    large = sizes.filter(F.col("size") > block).select("cluster")
    small = sizes.filter((F.col("size") <= block) & (F.col("size") > 1)).select("cluster")
    zero = F.lit(0).cast("long")
    tasks = sets.join(small, "cluster", "left_semi").select("cluster", zero.alias("i"), zero.alias("j"), zero.alias("block"), "id", F.col("id").alias("root"), "n", "s")
    if large.isEmpty():
        return tree_links(tasks, percent)
    compared = written(against_first(sets.join(large, "cluster", "left_semi"), percent), "compared")
    # what is closer to the first set than any unconnected set less the threshold's distance can link to none of those
    least = compared.filter("not near").groupBy("cluster").agg(F.min("dist").alias("least"))
    rest = compared.join(least, "cluster").filter(F.col("dist") >= F.col("least") - (100 - percent) / 100 - 1e-9)
    counts = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("blocks"))
    dealt = rest.join(counts, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", F.when(F.col("near"), F.col("cluster")).otherwise(F.col("id")).alias("root"), "n", "s")
    stars = compared.filter("near and id != cluster").select(F.col("id").alias("a"), F.col("cluster").alias("b"))
    return tree_links(tasks.unionByName(dealt), percent).unionByName(stars)


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = written(measured(docs, n, percent), "sets")
    nodes = rows.filter("s IS NOT NULL").groupBy("h1", "h2").agg(F.first("n_shingles").alias("n"), F.first("s").alias("s"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    clusters = components(candidate_pairs(nodes, percent), "clusters").withColumnRenamed("comp", "cluster")
    sets = written(nodes.join(clusters, "id").select("id", "cluster", "n", "s"), "candidates")
    joined = components(cluster_links(sets, percent, block), "links")
    named = nodes.select("id", "h1", "h2").join(joined, "id").select("h1", "h2", "comp")
    every = rows.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    known = written(every.join(named, ["h1", "h2"], "left").filter("copies > 1 OR comp IS NOT NULL"), "known")
    smallest = known.groupBy("comp").agg(F.min("doc").alias("least")).filter("comp IS NOT NULL")
    known = written(known.join(smallest, "comp", "left").select("h1", "h2", "copies", F.coalesce("least", "doc").alias("component_id")), "named")
    remove(nodes, sets, joined)
    lite = rows.select("doc_id", "n_shingles", "h1", "h2")
    out = join_known(lite, known, ["h1", "h2"], "copies", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: that with the smallest id; rows that repeat its id and text are one."""
    rows = written(near_duplicates(docs, n, percent), "components")
    kept = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gl_id"))
    ids = written(kept.groupBy("_gl_id").agg(F.count(F.lit(1)).alias("_gl_n")), "kept")
    out = docs.join(keyed(ids.select("_gl_id")), F.col("doc_id").eqNullSafe(F.col("_gl_id")), "left_semi")
    if not ids.filter("_gl_n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out
