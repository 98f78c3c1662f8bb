"""Shared parts of the corpus operators: sizing, text access, rolling hashes."""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged as staged

#: Text that one group of documents holds in a Python worker, about.
GROUP_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max

def text_bytes(docs: DataFrame) -> int:
    """About how many bytes of text docs holds: from the file sizes, or by a sum where the plan has no figure."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return 2 * size
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


CARRIED = "_carried_"


def carried(docs: DataFrame) -> list[Column]:
    """All columns of docs under names that clash with none of ours."""
    return [F.col(f"`{c}`").alias(CARRIED + c) for c in docs.columns]


def given_back(columns: list[str], text: Column | None = None) -> list[Column]:
    """The carried columns under their own names; with text, that as text, and n_chars to match."""
    out = []
    for c in columns:
        if text is not None and c == "text":
            out.append(text.alias(c))
        elif text is not None and c == "n_chars":
            out.append(F.when(text.isNull(), None).otherwise(F.length(text)).cast("long").alias(c))
        else:
            out.append(F.col(f"`{CARRIED}{c}`").alias(c))
    return out


def group_count(docs: DataFrame) -> int:
    return max(1, -(-text_bytes(docs) // GROUP_BYTES))


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (string): other columns, whatever their names, play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text and g, the group of a row: by id and text, so that rows of one id, or of none, spread."""
    return id_text(docs).withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))


def rows_of(table: pa.Table) -> list[tuple[int | None, bytes]]:
    """(doc_id, text as UTF-8) of each row, nulls as empty texts, in an order that the rows alone determine."""
    ids = table.column("doc_id").to_pylist()
    texts = table.column("text").cast(pa.large_binary()).to_pylist()
    return sorted(((i, t or b"") for i, t in zip(ids, texts)), key=lambda r: (NO_ID if r[0] is None else r[0], r[1]))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


# Random words for the gear hash, drawn by a fixed rule so that all workers agree.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)


def gear_hash(data: np.ndarray, width: int) -> np.ndarray:
    """The gear hash of each string of `width` (at most 64) bytes of data, by its start.

    h(s) = sum of GEAR[data[s+j]] << (width-1-j) modulo 2**64; built by doubling,
    h_{a+c}(s) = (h_a(s) << c) + h_c(s+a), so a pass costs log2(width) array steps.
    """
    if len(data) < width:
        return np.empty(0, np.uint64)
    part, size, out, done = GEAR[data], 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:
                joined = (part[: len(part) - done] << np.uint64(done)) + out[size : size + len(part) - done]
                out, done = joined, done + size
        if done == width:
            return out[: len(data) - width + 1]
        part = (part[:-size] << np.uint64(size)) + part[size:]
        size *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """h scrambled so that any of its bits depends on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices) for every bucket that has keys; a bucket is key modulo buckets."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [(int(of[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def pack48(keys: np.ndarray) -> bytes:
    """Keys under 2**48, six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def ask_keys(g: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """Rows (bucket, g, payload): group g asks the keys' buckets which of its keys other groups have."""
    keys = np.unique(keys)
    out = [(b, pack48(keys[i])) for b, i in by_bucket(keys, buckets)] if len(keys) else []
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "g": pa.array([g] * len(out), pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})


def shared_keys(table: pa.Table) -> pa.Table:
    """A bucket's answer to ask_keys: rows (g, payload) with those keys that two groups or more asked for."""
    gs = table.column("g").to_pylist()
    parts = [unpack48(p) for p in table.column("payload").to_pylist()]
    keys, count = np.unique(np.concatenate(parts), return_counts=True)
    keys = keys[count > 1]
    out = []
    for g, part in zip(gs, parts):
        told = part[np.isin(part, keys, assume_unique=True)]
        if len(told):
            out.append((g, pack48(told)))
    return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})


_given_back_at = [0.0]


def give_back(pause: float = 0.2) -> None:
    """Returns freed memory to the system, at most once a `pause`: idle Python workers outlive their stage by a minute, beside the next one's."""
    if time.monotonic() - _given_back_at[0] < pause:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass
    _given_back_at[0] = time.monotonic()


def lean(f: Callable) -> Callable:
    """f of a table, or of two, that gives back freed memory at its end."""
    if f.__code__.co_argcount == 1:

        @functools.wraps(f)
        def one(table):
            out = f(table)
            give_back()
            return out

        return one

    @functools.wraps(f)
    def two(left, right):
        out = f(left, right)
        give_back()
        return out

    return two


def lean_map(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f of batches that gives back freed memory at the end of its partition."""

    @functools.wraps(f)
    def batches_of(batches):
        yield from f(batches)
        give_back(0)

    return batches_of
