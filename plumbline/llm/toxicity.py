"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts that may be learned from, toxic or not, are
unlabelled. A linear classifier minimises the class-prior-corrected risk
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)), where a negative bracket is
climbed instead of followed (numpy, full batches, Adam). p is the share of toxic rows among
the labels that may be learned from.

Features are the presence of words and of the beginnings of words (3 to 7 characters), hashed to
2**20 slots, and the length of the text by powers of two, so that long texts need more evidence. Columns are the slots that enough positives have and whose share of positives
differs from that of all unlabelled texts by `least_z` standard errors; the most telling
`columns` of them, and those of lengths.

Positives are at most `positives` labelled texts (the documented bound), of smallest hash.
Nothing else is sampled: one scan counts what positives have in all texts, another writes the
columns of every text, whose risk and gradient are added up over partitions, by column, in each of
`passes` steps. The steps
start from a fit to `first` unlabelled rows. At last the bias is set so that the mean score of
the unlabelled rows is the prior. Scores come from the written columns.

Defined cases: null, empty and wordless texts score by the bias alone; without positives all score
the class prior, 0; labels of null or unknown ids play no part; several labels of one id count
once, the worst one; rows of one doc_id are scored each and learned from each; very long texts
are read whole; ties of hashes go by doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import words_of

SLOTS = 1 << 20
LENGTHS = SLOTS  # the slots of lengths follow those of words


class Slots(dict):
    """Slots of a word and of its beginnings, remembered within bounds."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        found = {xxhash.xxh3_64_intdigest(word) & (SLOTS - 1)}
        for n in range(3, min(len(text), 8)):
            found.add(xxhash.xxh3_64_intdigest(text[:n].encode(), 1) & (SLOTS - 1))
        s = self[word] = list(found)
        return s


def slots_of(text: bytes, memo: Slots) -> np.ndarray:
    """Distinct slots of the words of a text, and that of its length: LENGTHS plus the binary digits of the number of its distinct words."""
    words = set(words_of(text.lower()))
    return np.append(np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, words)), np.int32)), np.int32(LENGTHS + min(len(words).bit_length(), 31)))


def presence(docs: DataFrame, column: np.ndarray | None = None) -> DataFrame:
    """doc_id and the packed slots of each text; with column (its number for each slot, or -1), the packed numbers."""
    told = None if column is None else docs.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, place = Slots(), None if told is None else told.value
        for batch in batches:
            found = (slots_of(t, memo) for t in C.texts_of(batch.column(1)))
            if place is not None:
                found = (p[p >= 0] for p in (place[s] for s in found))
            yield pa.record_batch({"doc_id": batch.column(0), "slots": pa.array([f.tobytes() for f in found], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, slots binary")


def packed_rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32) for b in batch.column("slots").to_pylist()]


def added_up(rows: DataFrame, size: int, f: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all rows of f(packed rows), a vector of `size`; partitions add up before the exchange, which deals by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += f(packed_rows(batch))
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "v": pa.array(total[at], pa.float64())})

    got = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """0/1 rows over columns, for products with vectors."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.size)
        self.shape = len(rows), columns

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.shape[0])

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, v[self.row], self.shape[1])


class Risk:
    """The non-negative PU risk of weights and bias (last), and its gradient, from sums over the unlabelled rows."""

    def __init__(self, positive: Sparse, prior: float, ridge: float = 1e-3):
        self.positive, self.prior, self.ridge = positive, prior, ridge
        self.n, self.k = positive.shape

    def unlabelled(self, rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
        """Over some unlabelled rows: the gradient's sum, the loss's sum, the number of rows."""
        x = Sparse(rows, self.k)
        s = sigmoid(x.times(w[:-1]) + w[-1])
        return np.concatenate((x.transposed_times(s), [s.sum(), -np.log(np.maximum(1 - s, 1e-12)).sum(), len(rows)]))

    def of(self, w: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        s = sigmoid(self.positive.times(w[:-1]) + w[-1])
        n = max(sums[-1], 1)
        with_bias = lambda d: np.append(self.positive.transposed_times(d), d.sum())
        bracket = sums[-2] / n + self.prior * np.mean(np.log(np.maximum(1 - s, 1e-12)))
        low = sums[:-2] / n - self.prior * with_bias(s / self.n)
        gradient = with_bias(-(1 - s) * self.prior / self.n) + (low if bracket >= 0 else -low)
        gradient[:-1] += self.ridge * w[:-1] / self.n**0.5
        loss = -self.prior * np.mean(np.log(np.maximum(s, 1e-12))) + max(bracket, 0.0) + self.ridge * (w[:-1] ** 2).sum() / 2 / self.n**0.5
        return loss, gradient


def descended(risk: Risk, w: np.ndarray, sums: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Of `steps` Adam steps from w, the weights of least risk."""
    m, v, best = np.zeros_like(w), np.zeros_like(w), (np.inf, w)
    for t in range(1, steps + 1):
        loss, g = risk.of(w, sums(w))
        if loss < best[0]:
            best = loss, w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return best[1]


def learned(docs: DataFrame, labels: DataFrame, allowed: Column, positives: int = 4000, first: int = 8000, seen: int = 4, columns: int = 4096, least_z: float = 4.0, passes: int = 8) -> tuple[DataFrame | None, np.ndarray]:
    """The columns of every text (doc_id, slots), and a weight for each column and the bias; None without positives.

    allowed: which rows may be learned from.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(allowed)
    shares = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not shares.n or not shares.p:
        return None, np.array([-40.0])
    prior = min(max(shares.p / shares.n, 1e-4), 0.9)
    chosen = marks.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id")  # at most `positives` ids
    picked = presence(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))
    confirmed = packed_rows_of(picked.orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(positives))  # rows of one id may be many
    if not confirmed:
        return None, np.array([-40.0])
    count = np.bincount(np.concatenate(confirmed), minlength=SLOTS + 32)
    able = np.flatnonzero(count >= max(seen, len(confirmed) // 500))
    place = np.full(SLOTS + 32, -1, np.int32)
    place[able] = np.arange(len(able))
    size = len(able)
    may = docs.filter("doc_id is not null").filter(allowed)
    counts = added_up(presence(may, place), size + 1, lambda rows: np.append(np.bincount(np.concatenate(rows), minlength=size) if rows else np.zeros(size), len(rows)))
    base = (counts[:-1] + 1) / (counts[-1] + 2)
    z = (count[able] / len(confirmed) - base) / np.sqrt(base * (1 - base) / len(confirmed))
    order = np.argsort(-np.abs(z), kind="stable")[:columns]
    order = np.union1d(order[np.abs(z[order]) >= least_z], np.flatnonzero(able >= LENGTHS))
    place = np.full(SLOTS + 32, -1, np.int32)
    place[able[order]] = np.arange(len(order))
    every = C.staged(presence(docs, place), "columns")
    free = every.filter("doc_id is not null").filter(allowed)
    risk = Risk(Sparse([p[p >= 0] for p in (place[r] for r in confirmed)], len(order)), prior)
    some = packed_rows_of(free.orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(first))
    start = np.append(np.zeros(len(order)), np.log(prior / (1 - prior)))
    w = descended(risk, start, lambda w: risk.unlabelled(some, w), 300, 0.05)
    w = descended(risk, w, lambda w: added_up(free, len(w) + 2, lambda rows: risk.unlabelled(rows, w)), passes, 0.02)
    margins = added_up(free, len(EDGES) + 1, lambda rows: np.bincount(np.searchsorted(EDGES, Sparse(rows, len(w) - 1).times(w[:-1]) + w[-1]), minlength=len(EDGES) + 1))
    w[-1] += prior_shift(margins, prior)
    return every, w


#: Where the histogram of margins is cut.
EDGES = np.linspace(-40, 40, 8001)


def prior_shift(histogram: np.ndarray, prior: float) -> float:
    """What to add to all margins so that the mean score over the unlabelled rows is the prior."""
    middle = np.append(EDGES, EDGES[-1]) - (EDGES[1] - EDGES[0]) / 2
    low, high = -40.0, 40.0
    for _ in range(60):
        at = (low + high) / 2
        low, high = (low, at) if (sigmoid(middle + at) * histogram).sum() > prior * histogram.sum() else (at, high)
    return low


def packed_rows_of(rows: DataFrame) -> list[np.ndarray]:
    """The packed rows of a bounded table, on the driver."""
    return [np.frombuffer(b, np.int32) for b in rows.select("slots").toArrow().column("slots").to_pylist()]


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, **options) -> DataFrame:
    """doc_id and score (0 to 1) for each row."""
    docs = C.id_text(docs)
    rows, w = learned(docs, labels, allowed, **options)
    if rows is None:
        return docs.select("doc_id", F.lit(float(sigmoid(w)[0])).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = Sparse(packed_rows(batch), len(w) - 1).times(w[:-1]) + w[-1]
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(sigmoid(margins), pa.float64())})

    return rows.mapInArrow(run, "doc_id long, score double")


def fold(by: int) -> Column:
    """crc32 of doc_id as text, modulo by."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def scored(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
