"""Benchmark decontamination: a hash set of normalised test n-grams against document windows.

Normalised words are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters.
An item's windows are its runs of `size` words, or all its words if it has fewer. A
document word inside an occurrence of a window is hit. Window hashes find candidates; a
hit counts only after its words agree.

The windows are shipped to the executors in blocks of at most `block_bytes` of benchmark
text, one scan a block, so what is broadcast stays bounded at any size of the benchmark: a
block's words and flat arrays of its windows. With one block (the usual case) there is no
shuffle at all; with more, rows are numbered, those with hits meet by number, and texts stay
where they are.

Defined cases: null texts have no words; items without words have no windows; repeated
items count by their item_id; null item_ids hit words but are not listed; an empty table on
either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
#: Non-word bytes become blanks, A-Z small; bytes of non-ASCII characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    # split() knows ASCII blanks only, and no other blank is left among the bytes
    return text.translate(NORMAL).split()


def spaced(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of text with one blank between them, and their starts and ends in that."""
    flat = b" ".join(words_of(text))
    if not flat:
        return flat, np.empty(0, np.int64), np.empty(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    return flat, np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(flat)]))


class Windows:
    """Windows of a block of items, by their number of words, sorted by hash.

    All is held in flat arrays: the words of the block, and 28 bytes a window and owner with
    8 to 16 flags, so that the size is a small multiple of the block's text.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        owners: dict[str | None, int] = {}
        texts, at, parts = [], 0, {}
        for item, text in items:
            flat, starts, ends = spaced(text)
            n = min(size, len(starts))
            if not n:
                continue
            starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
            owner = np.full(len(starts), owners.setdefault(item, len(owners)), np.int32)
            parts.setdefault(n, []).append((substring_hashes(flat, starts, ends), starts + at, ends + at, owner))
            texts.append(flat)
            at += len(flat)
        self.text, self.owners = b"".join(texts), list(owners)
        self.by_length = {n: self._sorted(*map(np.concatenate, zip(*parts.pop(n)))) for n in sorted(parts)}

    def _sorted(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray):
        """The windows by hash and owner, those that an item repeats once, and flags of the hashes' first bits."""
        order = np.lexsort((owner, hashes))
        hashes, start, end, owner = hashes[order], start[order], end[order], owner[order]
        keep = np.ones(len(hashes), bool)
        for i in np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])).tolist():
            keep[i + 1] = self.text[start[i] : end[i]] != self.text[start[i + 1] : end[i + 1]]
        bits = max(8, int(keep.sum()).bit_length() + 3)
        flags = np.zeros(1 << bits, bool)
        flags[hashes >> np.uint64(64 - bits)] = True
        return hashes[keep], start[keep], end[keep], owner[keep], flags, np.uint64(64 - bits)

    def hits(self, text: bytes) -> tuple[np.ndarray, set[str | None]]:
        """Which words of text are hit, and the items whose windows occur."""
        flat, starts, ends = spaced(text)
        hit, found = np.zeros(len(starts), bool), set()
        if not self.by_length or not len(starts):
            return hit, found
        for n, (hashes, start, end, owner, flags, shift) in self.by_length.items():
            if len(starts) < n:
                break
            h = substring_hashes(flat, starts[: len(starts) - n + 1], ends[n - 1 :])
            places = np.flatnonzero(flags[h >> shift])
            first, after = np.searchsorted(hashes, h[places], "left"), np.searchsorted(hashes, h[places], "right")
            known: dict[int, bytes] = {}
            for p, i, j in zip(places.tolist(), first.tolist(), after.tolist()):
                words = flat[starts[p] : ends[p + n - 1]]
                if i < j and known.get(i) != words:
                    agree = [k for k in range(i, j) if self.text[start[k] : end[k]] == words]
                    if not agree:
                        continue
                    found.update(self.owners[owner[k]] for k in agree)
                    known[i] = words
                if i < j:
                    hit[p : p + n] = True
        return hit, found


MULTIPLY = 0x9E3779B97F4A7C15
#: Windows hashed at a time, so that a very long text needs no arrays of its length for it.
AT_ONCE = 1 << 14
#: Powers of MULTIPLY and of its inverse modulo 2**64, kept for texts of usual length.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers or more."""
    if len(_powers[0]) >= n:
        return _powers
    out = []
    for base in (MULTIPLY, pow(MULTIPLY, -1, 1 << 64)):
        by = np.full(1 << n.bit_length(), base, np.uint64)
        by[0] = 1
        out.append(np.cumprod(by))
    if n <= 1 << 18:
        _powers[:] = out
    return out


def substring_hashes(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each flat[start:end] that depends on its bytes alone; starts and ends ascend."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        base = starts[i]
        text = np.frombuffer(flat[base : ends[part][-1]], np.uint8)
        up, down = powers(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)  # of GEAR[byte] * MULTIPLY**place over the first bytes
        np.cumsum(C.GEAR[text] * up[: len(text)], out=sums[1:])
        out[part] = C.mixed((sums[ends[part] - base] - sums[starts[part] - base]) * down[starts[part] - base])
    return out


def _table(ids, texts, hits, batch_type=pa.record_batch):
    cols: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")}
    for hit, found in hits:
        items = sorted(i for i in found if i is not None)
        start, end = C.spans_of(hit)
        for k, v in zip(cols, (len(hit), int(hit.sum()), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit.any()), items, [{"start": int(s), "end": int(e)} for s, e in zip(start, end)])):
            cols[k].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return batch_type({"doc_id": ids} | {k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds)} | ({"text": texts} if texts is not None else {}))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    return max(1, -(-(_items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))


def _scans(docs: DataFrame, benchmark: DataFrame, size: int, blocks: int, keep_text: bool = False) -> list[DataFrame]:
    """One row a document for each block of the benchmark; docs has doc_id and text."""
    items = _items(benchmark)

    def scan(block: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        windows = docs.sparkSession.sparkContext.broadcast(Windows([(r.item_id, r.text.encode()) for r in part.toLocalIterator()], size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = windows.value
            for batch in batches:
                yield _table(batch.column(0), batch.column(1) if keep_text else None, [w.hits(t) for t in C.texts_of(batch.column(1))])

        return docs.mapInArrow(C.lean_map(run), RESULT + (", text string" if keep_text else ""))

    return [scan(b) for b in range(blocks)]


def _merged(scans: list[DataFrame], keep_text: bool) -> DataFrame:
    """The rows with hits, once a doc_id, which is unique: a group has at most one row a block."""
    hits = [s.filter("n_hit > 0") for s in scans]
    if len(hits) == 1:
        return hits[0]

    def merge(table: pa.Table) -> pa.Table:
        hit, found = np.zeros(table.column("n_words")[0].as_py(), bool), set()
        for spans, got in zip(table.column("spans").to_pylist(), table.column("items").to_pylist()):
            found |= set(got)
            for s in spans:
                hit[s["start"] : s["end"]] = True
        return _table(table.column("doc_id")[:1], table.column("text")[:1] if keep_text else None, [(hit, found)], pa.table)

    return reduce(DataFrame.unionByName, hits).groupBy("doc_id").applyInArrow(C.lean(merge), RESULT + (", text string" if keep_text else ""))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """One row a document: its words, hit words, items, and spans of hit words (word offsets)."""
    docs = C.id_text(docs)
    blocks = block_count(benchmark, block_bytes)
    if blocks == 1:
        return _scans(docs, benchmark, size, 1)[0]
    rows = C.staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col("_row").alias("doc_id"), "text")
    names = [c.split()[0] for c in RESULT.split(", ")][1:]
    hits = C.staged(_merged(_scans(numbered, benchmark, size, blocks), False).withColumnRenamed("doc_id", "_row"), "hits")
    # what a row without hits has: a scan for no windows at all
    blank = _scans(numbered, benchmark.limit(0), size, 1)[0].withColumnRenamed("doc_id", "_row")
    both = blank.alias("b").join(hits.alias("h"), "_row", "left").join(rows.select("_row", "doc_id"), "_row")
    return both.select("doc_id", *[F.when(F.col("h.n_hit").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in names])


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, size: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """docs, hit words and what stands between them cut out of the texts, n_chars to match.

    Documents with more than `share` of their words hit go. Rows find their spans by a row
    number; only rows with hits are on the other side of the join.
    """
    rows = C.staged(docs.select(*C.carried(docs), F.monotonically_increasing_id().alias("_row")), "rows")
    text = F.col(f"`{C.CARRIED}text`")
    numbered = rows.select(F.col("_row").alias("doc_id"), text.cast("string").alias("text"))
    found = _merged(_scans(numbered, benchmark, size, block_count(benchmark, block_bytes), True), True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch({"_row": batch.column(0), "_text": pa.array(texts, pa.string()), "_gone": batch.column(3)})

    hits = found.select("doc_id", "text", "spans", (F.col("n_hit") > share * F.col("n_words")).alias("gone")).mapInArrow(C.lean_map(cut), "_row long, _text string, _gone boolean")
    return rows.join(C.staged(hits, "hits").hint("shuffle_hash"), "_row", "left").filter("_gone is null or not _gone").select(*C.given_back(docs.columns, F.coalesce("_text", text)))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words start..end-1 of each span and what stands between them."""
    data = text.encode()
    normal = np.frombuffer(data.translate(NORMAL), np.uint8)
    starts, ends = C.spans_of(normal != 32)
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : starts[s]])
        at = ends[e - 1]
    out.append(data[at:])
    return b"".join(out).decode()
