"""Compression classifier for quality.

One zstandard dictionary is trained on good and one on bad labelled text. A text is compressed whole with either, and in
segments; the normalised size difference (bad - good) / (bad + good), the good size per byte, their least values over the
segments and the log length go through a logistic calibration fitted on labelled texts that are in neither dictionary.

Fitting uses a bounded sample, chosen by a hash of the id among rows that are not held out: at most DICT_TEXTS texts per
class and CALIBRATION_TEXTS others, none longer than FIT_CHARS characters. Scoring covers every whole text. Rows without a
usable label (null, or both 0 and 1 for one id) are not fitted on; if a class has no text, every score is the share of label 1
seen (0.5 with none). Null and empty texts are scored like any other, of length 0. The remainder of a null id is that of ''.
Repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches

DICT_TEXTS = 1000
CALIBRATION_TEXTS = 4000
FIT_CHARS = 20_000
DICT_BYTES = 112_000
LEVEL = 3
SEGMENT_BYTES = 600
THRESHOLD = 0.7


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def compressor(data: bytes, trained: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(data, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def dictionary(texts: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or the texts themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes(), True
    except zstandard.ZstdError:
        return (b"\n".join(texts)[:DICT_BYTES] or b"\n") + b" " * 8, False


def features(data: bytes, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor) -> list[float]:
    n = len(data)
    b, g = len(bad.compress(data)), len(good.compress(data))
    m = max(1, round(n / SEGMENT_BYTES))
    d, r = [], []
    for i in range(m):
        s = data[n * i // m : n * (i + 1) // m]
        x, y = len(bad.compress(s)), len(good.compress(s))
        d.append((x - y) / (x + y))
        r.append(y / (len(s) + 20))
    return [(b - g) / (b + g), g / (n + 20), min(d), min(r), sum(d) / m, float(np.log1p(n))]


def terms(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    k = z.shape[1]
    return np.column_stack([np.ones(len(z)), z, *(z[:, i] * z[:, j] for i in range(k) for j in range(i, k))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method, each step halved until the penalised loss falls."""
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        s = x @ v
        return float(np.sum(np.logaddexp(0, s) - y * s) + ridge / 2 * v @ v)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    bad: tuple[bytes, bool]
    good: tuple[bytes, bool]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        bad, good = compressor(*self.bad), compressor(*self.good)
        x = np.array([features((t or "").encode("utf-8", "surrogatepass"), bad, good) for t in texts])
        return 1 / (1 + np.exp(-np.clip(terms(x, self.mean, self.scale) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Only the sample's ids, bounded by the parameters above, are broadcast; only its texts reach the driver."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("most")).filter("q = most")
    # the id's hash only picks the sample and never enters a score
    usable = usable.select("doc_id", "q", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(2)))
    picks = [usable.filter(f"part = 0 and q = {q}").orderBy("h", "doc_id").limit(DICT_TEXTS) for q in (0, 1)]
    picks.append(usable.filter("part = 1").orderBy("h", "doc_id").limit(CALIBRATION_TEXTS))
    ids = picks[0].unionByName(picks[1]).unionByName(picks[2])
    texts = docs.select(F.col("doc_id"), F.col("text")).filter((F.length("text") <= FIT_CHARS) & (F.length("text") > 0))
    rows = texts.join(F.broadcast(ids), "doc_id").select("q", "part", "h", "text").collect()
    rows.sort(key=lambda r: (r.h, r.text))
    rows = rows[: 2 * DICT_TEXTS + CALIBRATION_TEXTS]  # repeated rows don't raise the bound
    sets = {q: [r.text.encode("utf-8", "surrogatepass") for r in rows if r.part == 0 and r.q == q] for q in (0, 1)}
    rest = [r for r in rows if r.part == 1]
    seen = [r.q for r in rows]
    prior = (sum(seen) + 1) / (len(seen) + 2)
    if not (sets[0] and sets[1] and len({r.q for r in rest}) == 2):
        return Model((b"", False), (b"", False), np.zeros(6), np.ones(6), None, prior)
    d = {q: dictionary(sets[q]) for q in (0, 1)}
    bad, good = compressor(*d[0]), compressor(*d[1])
    x = np.array([features(r.text.encode("utf-8", "surrogatepass"), bad, good) for r in rest])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    w = logistic(terms(x, mean, scale), np.array([r.q for r in rest], float))
    return Model(d[0], d[1], mean, scale, w, prior)


def with_scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and the score of its column text."""
    in_batches(docs.sparkSession)
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_gl_text"))
    schema = src.select(*(f"`{c}`" for c in keep), F.lit(0.0).alias("_gl_score")).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*keep, "_gl_score"])

    return src.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    df = with_scores(docs.select("doc_id", "text"), model, ["doc_id"])
    return df.select("doc_id", held_out().alias("held_out"), F.col("_gl_score").alias("score"), (F.col("_gl_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below the threshold."""
    model = fit(docs, labels)
    return with_scores(docs, model, docs.columns).filter(F.col("_gl_score") >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
