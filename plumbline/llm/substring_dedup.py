"""Substring dedup by content-defined chunking with a gear rolling hash.

Cut points depend on the last 24 bytes only, so an insertion shifts no cut but those
around it. A chunk whose 128-bit digest also occurs in a document with a smaller id is a
duplicate, and every duplicate chunk is removed. Chunks have 20 bytes or more, but for texts
that are shorter as a whole: what is left at a text's end joins the chunk before it.

Plan: documents are dealt into groups of about 4 MB by a hash of doc_id. Each group asks,
once for each distinct digest, who owns it; the askers of a digest meet in the digest's
bucket, which answers with the smallest document. A digest that thousands of documents
share costs its bucket one row a group. A group sends no row to a bucket it has no digest
for, so rows never exceed digests and the exchange grows linearly with the text.

Defined cases: a null text counts as empty and loses nothing; a null doc_id counts as the
largest id; rows of equal doc_id never remove each other's text; very long texts are chunked
whole, in one task each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common as C

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_chunks long, n_duplicate_chunks long"


def cut_points(text: bytes, shortest: int = 20, bits: int = 4, longest: int = 128, window: int = 24) -> list[int]:
    """Ends of the chunks of text, its length last."""
    n = len(text)
    if n <= max(shortest, window):
        return [n] if n else []
    h = C.gear_hash(np.frombuffer(text, np.uint8), window)
    # a chunk may end after the byte that completes a window with `bits` leading zero bits
    ends = (np.flatnonzero((C.mixed(h) >> np.uint64(64 - bits)) == 0) + window).tolist()
    cuts, last = [], 0
    for e in ends:
        if e - last < shortest:
            continue
        while e - last > longest:
            last += longest
            cuts.append(last)
        if e - last >= shortest:
            cuts.append(e)
            last = e
    while n - last > longest:
        last += longest
        cuts.append(last)
    if last < n:
        if cuts and n - last < shortest:
            cuts.pop()
        cuts.append(n)
    return cuts


def chunk_digests(rows, params: dict):
    """For all rows of a group: digests (two uint64 columns), row number, start, end of each chunk."""
    digests, row, start, end = [], [], [], []
    digest = xxhash.xxh3_128_digest
    for r, (_, text) in enumerate(rows):
        cuts, last = cut_points(text, **params), 0
        for e in cuts:
            digests.append(digest(text[last:e]))
            start.append(last)
            end.append(e)
            last = e
        row.extend([r] * len(cuts))
    d = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return d[:, 0].copy(), d[:, 1].copy(), np.array(row, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def owners(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray):
    """Distinct (hi, lo), sorted, with the smallest doc of each, and for each input its place among them."""
    order = np.lexsort((doc, lo, hi))
    h, l = hi[order], lo[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return h[new], l[new], doc[order][new], place


def _ids(rows) -> np.ndarray:
    return np.array([C.NO_ID if i is None else i for i, _ in rows], np.int64)


def remove_duplicate_chunks(docs: DataFrame, within: bool = False, keep_text: bool = False, **params) -> DataFrame:
    """One row a document: what is left of it after its duplicate chunks are gone.

    within: a chunk's later copies in the same document are duplicates, too.
    keep_text: adds the column kept_text (bytes).
    """
    groups = C.group_count(docs)
    buckets = max(1, groups // 2)
    dealt = C.grouped(docs, groups)

    def ask(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        rows = C.rows_of(table)
        hi, lo, row, _, _ = chunk_digests(rows, params)
        h, l, doc, _ = owners(hi, lo, _ids(rows)[row])
        out = [(b, g, np.stack([h[i], l[i], doc[i].view(np.uint64)]).tobytes()) for b, i in C.by_bucket(h, buckets)] if len(h) else []
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "g": pa.array([x[1] for x in out], pa.int32()), "payload": pa.array([x[2] for x in out], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        gs = table.column("g").to_pylist()
        parts = [np.frombuffer(p, np.uint64).reshape(3, -1) for p in table.column("payload").to_pylist()]
        hi, lo, doc = np.concatenate(parts, axis=1)
        doc = doc.view(np.int64)
        _, _, first, place = owners(hi, lo, doc)
        out, at = [], 0
        for g, p in zip(gs, parts):
            n = p.shape[1]
            mine, best = doc[at : at + n], first[place[at : at + n]]
            told = best < mine
            if told.any():
                out.append((g, np.stack([p[0][told], p[1][told], best[told].view(np.uint64)]).tobytes()))
            at += n
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = C.rows_of(table)
        hi, lo, row, start, end = chunk_digests(rows, params)
        ids = _ids(rows)
        h, l, first, place = owners(hi, lo, ids[row])
        if told.num_rows:
            answers = np.concatenate([np.frombuffer(p, np.uint64).reshape(3, -1) for p in told.column("payload").to_pylist()], axis=1)
            _, _, best, where = owners(np.concatenate([h, answers[0]]), np.concatenate([l, answers[1]]), np.concatenate([first, answers[2].view(np.int64)]))
            first = best[where[: len(h)]]
        duplicate = first[place] < ids[row]
        if within:  # the first of equal chunks in a row stays, unless another document owns it
            order = np.lexsort((start, row, place))
            again = np.zeros(len(row), bool)
            again[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
            duplicate |= again
        bounds = np.searchsorted(row, np.arange(len(rows) + 1))
        out: dict[str, list] = {k.split()[0]: [] for k in RESULT.split(", ")}
        texts = []
        for r, (doc_id, text) in enumerate(rows):
            a, b = bounds[r], bounds[r + 1]
            mask = np.zeros(len(text), bool)
            from_, to = C.spans_of(duplicate[a:b])
            for x, y in zip(from_, to):
                mask[start[a + x] : end[a + y - 1]] = True
            spans, removed = C.spans_of(mask), int(mask.sum())
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if removed else text
            texts.append(kept)
            for k, v in zip(out, (doc_id, len(text), removed, len(spans[0]), hashlib.sha256(kept).hexdigest(), int(b - a), int(duplicate[a:b].sum()))):
                out[k].append(v)
        arrays = {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
        return pa.table(arrays | ({"kept_text": pa.array(texts, pa.binary())} if keep_text else {}))

    told = dealt.groupBy("g").applyInArrow(ask, "bucket int, g int, payload binary").groupBy("bucket").applyInArrow(answer, "g int, payload binary")
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(remove, RESULT + (", kept_text binary" if keep_text else ""))
