"""Approximate nearest neighbours by a forest of random-projection trees.

TREES trees are fitted on a bounded sample of SAMPLE vectors (those with the smallest hashes of their ids): a node splits its
sample by the hyperplane between two of its vectors, until LEAF sample vectors or fewer are left. Every vector then falls into
one leaf a tree. A query goes through all trees with one priority queue, ordered by the margins on the way: the nearest leaves
over all trees come first, until they hold CHECKED times as many vectors as there are, those in several leaves counted for each;
the rule is the same at every size. The vectors of a leaf are compared with the queries that chose it, block by block, and each
candidate that might be among the best is reranked by its exact cosine in double precision.

Equal vectors are one entry that keeps its k + 1 smallest ids, which is all that k neighbours can need, so copies neither fill a
leaf nor multiply pairs. Leaves are dealt in chunks of CHUNK vectors. Vectors that are null, empty, zero or hold a null or
non-finite component take no part, neither do vectors of another dimension than most of the sample. Repeated rows count once
per id. Null ids take no part. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, join_known, written

TREES = 12
SAMPLE = 16_384
LEAF = 192
#: Vectors that a query's leaves hold, as a share of all; those in several leaves count once for each.
CHECKED = 1.5
#: Queries compared at once.
QUERIES = 256
CHUNK = 4096
K = 5


class Forest:
    """Trees as arrays: normals, the children of inner nodes (left is the positive side), leaves as negative numbers."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.roots: list[int] = []
        self.tree_of: list[int] = []  # of leaves
        for t in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng, t))
        self.normals_array = np.array(self.normals, np.float64).reshape(len(self.normals), sample.shape[1])
        self.normals = []

    def _grow(self, x: np.ndarray, every: np.ndarray, leaf: int, rng: np.random.Generator, tree: int) -> int:
        root = [0]
        stack = [(every, root, 0)]
        while stack:
            rows, holder, place = stack.pop()
            split = None
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = rng.choice(rows, 2, replace=False)
                    normal = x[a] - x[b]
                    size = np.linalg.norm(normal)
                    if size:
                        side = x[rows] @ (normal / size) > 0
                        if 0.05 < side.mean() < 0.95:
                            split = normal / size, side
                            break
            if split is None:
                self.tree_of.append(tree)
                holder[place] = -len(self.tree_of)
                continue
            holder[place] = len(self.normals)
            self.normals.append(split[0])
            pair = [0, 0]
            self.children.append(pair)
            stack += [(rows[split[1]], pair, 0), (rows[~split[1]], pair, 1)]
        return root[0]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        sides = x @ self.normals_array.T > 0 if len(self.normals_array) else np.zeros((len(x), 0), bool)
        children = np.array(self.children).reshape(-1, 2)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := at >= 0).any():
                rows = np.flatnonzero(inner)
                at[rows] = children[at[rows], 1 - sides[rows, at[rows]].astype(int)]
            out[:, t] = -at - 1
        return out

    def search(self, q: np.ndarray, sizes: dict[int, int], enough: int) -> list[int]:
        """Leaves by one queue over all trees, until they hold `enough` vectors, counted per leaf."""
        margins = (self.normals_array @ q).tolist() if len(self.normals_array) else []
        queue = [(-np.inf, r) for r in self.roots]
        out, held = [], 0
        while queue and held < enough:
            far, at = heapq.heappop(queue)
            while at >= 0:
                m = margins[at]
                left, right = self.children[at]
                near, other = (left, right) if m > 0 else (right, left)
                heapq.heappush(queue, (max(far, abs(m)), other))
                at = near
            out.append(-at - 1)
            held += sizes.get(-at - 1, 0)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, e (doubles) and two hashes of e, of the vectors that take part."""
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null and size(e) > 0")
    df = df.filter("forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x != 0)")
    return df.withColumn("h1", F.xxhash64("e")).withColumn("h2", F.xxhash64(F.lit(1), "e"))


def entries_of(df: DataFrame, k: int) -> DataFrame:
    """h1, h2, e, ids: distinct vectors with their k + 1 smallest ids; more than those leave no task."""
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = df.withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.first("e").alias("e"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of(q: np.ndarray, v: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """Per query the k best (score, id) among vectors v, whose ids are listed; scores are exact cosines of the given vectors."""
    rough = unit(q) @ unit(v).T
    n = min(k, len(v))
    floor = np.partition(rough, len(v) - n, axis=1)[:, len(v) - n] - 1e-9
    norms, out = np.sqrt((v * v).sum(axis=1)), []
    for i, x in enumerate(q):
        near = np.flatnonzero(rough[i] >= floor[i])
        exact = (v[near] * x).sum(axis=1) / (norms[near] * np.sqrt((x * x).sum()))
        found = [(s, d) for s, j in zip(exact.tolist(), near.tolist()) for d in ids[j]]
        found.sort(key=lambda f: (-f[0], f[1]))
        out.append(found[:k])
    return out


FOUND = "h1 long, h2 long, score double, vec_id long"


def searched(rows: DataFrame, k: int) -> DataFrame:
    """FOUND; rows has leaf, chunk, query (false first), h1, h2, e, ids. A task holds the vectors of one chunk and streams the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list[list[int]] = []
        at, v = None, None
        for b in batches:
            if not b.num_rows:
                continue
            leaf, chunk = b.column(0).to_numpy(), b.column(1).to_numpy()
            query = b.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (chunk[1:] != chunk[:-1]) | (query[1:] != query[:-1])) + 1
            out: list[tuple] = []
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if at != (leaf[x], chunk[x]):
                    at, held, ids, v = (leaf[x], chunk[x]), [], [], None
                part = b.slice(x, y - x)
                e = _vectors(part.column(5))
                if not query[x]:
                    held.append(e)
                    ids += part.column(6).to_pylist()
                    continue
                if not held:
                    continue
                v = np.concatenate(held) if v is None else v
                keys = list(zip(part.column(3).to_pylist(), part.column(4).to_pylist()))
                for c in range(0, len(e), QUERIES):
                    for key, found in zip(keys[c : c + QUERIES], best_of(e[c : c + QUERIES], v, ids, k)):
                        out += [(*key, *f) for f in found]
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["h1", "h2", "score", "vec_id"])

    rows = rows.select("leaf", "chunk", "query", "h1", "h2", "e", "ids")
    return rows.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "query", "h1").mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, every: int = 50, k: int = K, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, checked: float = CHECKED, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`, itself excepted."""
    spark = vectors.sparkSession
    in_batches(spark)
    valid = usable(vectors)
    entries = written(entries_of(valid, k), "entries")
    rows = entries.orderBy("h1", "h2").limit(sample).select("e").collect()
    dim = Counter(len(r.e) for r in rows).most_common(1)[0][0] if rows else 1
    x = np.array([r.e for r in rows if len(r.e) == dim], np.float64).reshape(-1, dim)
    forest = Forest(unit(x) if len(x) else x, trees, leaf, seed)
    shared = spark.sparkContext.broadcast(forest)  # bounded by trees * sample / leaf normals

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = shared.value.leaves(unit(_vectors(b.column(2)))) if b.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["h1", "h2", "e", "ids", "leaves"])

    indexed = written(entries.filter(F.size("e") == dim).select("h1", "h2", "e", "ids").mapInArrow(fall, "h1 long, h2 long, e array<double>, ids array<long>, leaves array<int>"), "index")
    # one number per leaf: bounded by the forest
    sizes = {r.leaf: r["count"] for r in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    chunks = {n: -(-c // CHUNK) for n, c in sizes.items()}
    total = sum(sizes.values()) // trees

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked = [shared.value.search(q, sizes, int(checked * total) + 1) for q in unit(_vectors(b.column(2)))] if b.num_rows else []
            picked = [[n * (1 << 20) + c for n in p for c in range(chunks.get(n, 0))] for p in picked]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(picked, pa.list_(pa.int64()))], ["h1", "h2", "e", "picked"])

    asked = valid.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    q = indexed.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "e").mapInArrow(choose, "h1 long, h2 long, e array<double>, picked array<long>")
    q = q.select(F.explode("picked").alias("p"), "h1", "h2", "e").select(F.expr("int(p div 1048576)").alias("leaf"), F.expr("int(p % 1048576)").alias("chunk"), F.lit(True).alias("query"), "h1", "h2", "e", F.expr("cast(null as array<bigint>)").alias("ids"))
    table = F.create_map(*(F.lit(z) for n, c in sorted(chunks.items()) if c > 1 for z in (n, c))) if any(c > 1 for c in chunks.values()) else F.expr("cast(map() as map<int, int>)")
    v = indexed.select(F.explode("leaves").alias("leaf"), "h1", "h2", "e", "ids")
    v = v.select("leaf", F.pmod("h1", F.coalesce(table[F.col("leaf")], F.lit(1))).cast("int").alias("chunk"), F.lit(False).alias("query"), "h1", "h2", "e", "ids")
    found = searched(v.unionByName(q), k + 1)
    # a vector found in several trees has one rank
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    top = found.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)
    top = top.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), F.col("vec_id").alias("id")))).alias("top"))
    asked = asked.distinct()
    top = written(top.join(asked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), ["h1", "h2"]), "top")
    # the query's own id goes; copies of its vector stay
    out = join_known(asked, top, ["h1", "h2"], "n", F.col("query_id")).select("query_id", F.posexplode(F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, k)).alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.far")).alias("score"))
