"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class is a normal density over transformed statistics of the text, its covariance
shrunk towards the pooled one and a multiple of the identity. A score is the logistic of
the difference of log densities plus log priors; densities come from Mahalanobis distances
by cached Cholesky factors. Shrinkage is chosen on a part of the fitting rows.

One scan computes the statistics and writes them (18 numbers a row); labels meet those.
Fitting takes at most `rows` labelled rows (the documented bound), of smallest hash.

Defined cases: null and empty texts have statistics like any others; without labels of both
classes every score is the share of label 1, or one half; several labels of one id count once,
the worst one; rows of one doc_id are scored each and learned from each, within the bound; very
long texts are read whole; ties of hashes go by doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

GROUPS = {
    "upper": np.arange(65, 91),
    "lower": np.arange(97, 123),
    "digit": np.arange(48, 58),
    "symbol": np.frombuffer(b"#*$%&|<>", np.uint8),
    "bang": np.frombuffer(b"!", np.uint8),
    "stop": np.frombuffer(b".,;:?", np.uint8),
    "bar": np.frombuffer(b"|", np.uint8),
    "high": np.arange(128, 256),
    "bracket": np.frombuffer(b"()[]{}/\\=_@", np.uint8),
}


def text_statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text: logarithms of counts, square roots of shares."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), max(len(text), 1)
    lines = [l for l in text.split(b"\n") if l.strip()]
    counts = Counter(words)
    p = hist[hist > 0] / size
    out = [np.sqrt(hist[g].sum() / size) for g in GROUPS.values()]
    w = max(n, 1)
    out += [
        np.log1p(n),
        np.log1p((size - hist[[9, 10, 11, 12, 13, 32]].sum()) / w),
        np.log1p(max(map(len, words), default=0)),
        len(counts) / w**0.9,
        np.sqrt(max(counts.values(), default=0) / w),
        np.log1p(len(lines)),
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)),
        np.log1p(n / max(int(hist[46]), 1)),
        float(-(p * np.log(p)).sum()) if len(p) else 0.0,
    ]
    return [float(x) for x in out]


WIDTH = len(text_statistics(b""))


def statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "x": pa.array([text_statistics(t) for t in C.texts_of(batch.column(1))], pa.list_(pa.float64()))})

    return docs.mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Two normal densities with shrunk covariances."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pool: float, ridge: float):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        parts = [z[y == k] for k in (0, 1)]
        centred = [p - p.mean(0) for p in parts]
        pooled = sum(c.T @ c for c in centred) / len(z)
        self.centres = [p.mean(0) for p in parts]
        self.factors = []
        for c in centred:
            s = (1 - pool) * (c.T @ c) / len(c) + pool * pooled
            s = (1 - ridge) * s + ridge * (np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
            self.factors.append(np.linalg.cholesky(s))
        self.inverse = [np.linalg.inv(f) for f in self.factors]
        self.offset = [np.log(len(p) / len(z)) - np.log(np.diag(f)).sum() for p, f in zip(parts, self.factors)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        d = [o - 0.5 * (((z - c) @ i.T) ** 2).sum(1) for o, c, i in zip(self.offset, self.centres, self.inverse)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -40, 40)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fitted(x: np.ndarray, y: np.ndarray):
    """The discriminant whose shrinkage loses least on every fourth row, fitted to all rows."""
    few = min((y == 0).sum(), (y == 1).sum()) if len(y) else 0
    if few < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    held = np.arange(len(y)) % 4 == 0
    best = (np.inf, 0.5, 0.1)
    if all(((y == k) & m).sum() >= 2 for k in (0, 1) for m in (held, ~held)):
        for pool in (0.0, 0.1, 0.3, 0.6, 0.9):
            for ridge in (0.01, 0.05, 0.2):
                s = np.clip(Discriminant(x[~held], y[~held], pool, ridge).score(x[held]), 1e-6, 1 - 1e-6)
                loss = -np.mean(np.where(y[held] == 1, np.log(s), np.log(1 - s)))
                best = min(best, (loss, pool, ridge))
    return Discriminant(x, y, *best[1:])


def quality(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = 20_000) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) for each row."""
    stats = C.staged(statistics(C.id_text(docs)), "qstatistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(allowed)
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = stats.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows)  # rows of one id may be many
    got = picked.orderBy("doc_id", "quality", "x").select("x", "quality").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, WIDTH)
    model = stats.sparkSession.sparkContext.broadcast(fitted(x, np.array(got.column("quality").to_pylist(), int)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(model.value.score(x), pa.float64())})

    return stats.mapInArrow(run, "doc_id long, score double")
