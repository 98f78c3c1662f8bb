"""Suffix-array dedup: 50-byte strings that earlier documents hold, by deep-shallow sorting.

Only suffixes that can match are sorted. Every 50-byte string has a key, the least hash of
its 31 strings of 20 bytes; equal strings have equal keys, and neighbouring strings mostly
share theirs. (1) Groups of documents ask which keys other documents have as well. (2) The
stretches of text under shared keys ("contexts") meet in the key's bucket, where the
suffixes of differing contexts are sorted deep-shallow: multikey quicksort to a shallow
depth, then blind tries for the groups whose common prefix is longer. Suffixes that agree
for 50 bytes take their smallest document. (3) Each group removes what an earlier document
has. A group sends a key, and equal contexts, once, so a text with thousands of copies
costs its bucket a row a group. No step holds more than a group or a bucket.

Defined cases: a null text counts as empty; texts under 50 bytes lose nothing; a null
doc_id counts as the largest id; rows of equal doc_id never remove each other's text; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common as C

WIDTH, GRAM = 50, 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class BlindTrie:
    """A compacted trie that stores only where its keys branch; keys are strings of equal length."""

    def __init__(self, first: bytes, value: int):
        self.root = (first, [value])  # leaf: (key, values); node: [depth, {byte: child}]

    def insert(self, key: bytes, value: int) -> None:
        node = self.root
        while isinstance(node, list):  # blind descent: only branching bytes are looked at
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == key:
            node[1].append(value)
            return
        depth = common_prefix(key, other)
        parent, node, byte = None, self.root, 0
        while isinstance(node, list) and node[0] < depth:
            parent, byte = node, key[node[0]]
            node = node[1][byte]
        leaf = (key, [value])
        if isinstance(node, list) and node[0] == depth:
            node[1][key[depth]] = leaf
            return
        branch = [depth, {other[depth]: node, key[depth]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][byte] = branch

    def groups(self):
        """Values of equal keys, in order of the keys."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node[1]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def deep_shallow_sort(text: bytes, starts: np.ndarray, width: int = WIDTH, shallow: int = 16, small: int = 128) -> list[list[int]]:
    """The suffixes text[s:s+width] in order, as groups of indices into starts whose suffixes are equal.

    Multikey quicksort on words of 8 bytes, three-way about a median, down to `shallow`
    bytes; segments of at most `small` suffixes are sorted by their remaining shallow bytes.
    Groups that agree beyond go into a blind trie.
    """
    if not len(starts):
        return []
    assert shallow % 8 == 0 and shallow <= width
    # the word of 8 bytes at every place, without a copy
    word = np.ndarray(len(text) + 1, ">u8", text + bytes(8), strides=(1,))
    out: list[list[int]] = []

    def deep(members: list[int], at: list[int]) -> None:
        first = text[at[0] + shallow : at[0] + width]
        if len(at) == 1 or all(text[s + shallow : s + width] == first for s in at):  # nothing branches
            out.append(members)
            return
        trie = BlindTrie(first, members[0])
        for m, s in zip(members[1:], at[1:]):
            trie.insert(text[s + shallow : s + width], m)
        out.extend(trie.groups())

    stack = [(np.arange(len(starts)), 0)]
    while stack:
        segment, depth = stack.pop()
        if not len(segment):
            continue
        if depth >= shallow:
            deep(segment.tolist(), starts[segment].tolist())
        elif len(segment) <= small:
            equal: dict[bytes, tuple[list[int], list[int]]] = {}
            for i, s in zip(segment.tolist(), starts[segment].tolist()):
                members, at = equal.setdefault(text[s + depth : s + shallow], ([], []))
                members.append(i)
                at.append(s)
            for key in sorted(equal):
                deep(*equal[key])
        else:
            w = word[starts[segment] + depth].astype(np.uint64)
            pivot = np.partition(w, len(w) // 2)[len(w) // 2]
            less, more = w < pivot, w > pivot
            stack += [(segment[more], depth), (segment[~(less | more)], depth + 8), (segment[less], depth)]
    return out


def string_keys(data: np.ndarray) -> np.ndarray:
    """The key of each string of WIDTH bytes, by its start."""
    h = C.mixed(C.gear_hash(data, GRAM))
    span = WIDTH - GRAM + 1  # 31
    for step in (1, 2, 4, 8):
        h = np.minimum(h[:-step], h[step:])
    return np.minimum(h[: len(h) - (span - 16)], h[span - 16 :])


def key_runs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of neighbouring strings with one key, and the keys (48 bits)."""
    if len(text) < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = string_keys(np.frombuffer(text, np.uint8))
    starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
    return starts, k[starts] & np.uint64((1 << 48) - 1)


def _runs(rows):
    parts = [key_runs(t) for _, t in rows]
    sizes = [len(s) for s, _ in parts]
    row = np.repeat(np.arange(len(rows)), sizes)
    if not len(row):
        return row, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    start = np.concatenate([s for s, _ in parts])
    last = np.array([max(0, len(t) - WIDTH + 1) for _, t in rows], np.int64)
    end = np.append(start[1:], 0)  # strings start..end-1 have the key
    ends = np.cumsum(sizes)[np.array(sizes) > 0] - 1
    end[ends] = last[row[ends]]
    return row, start, end, np.concatenate([k for _, k in parts])


def _ids(rows) -> np.ndarray:
    return np.array([C.NO_ID if i is None else i for i, _ in rows], np.int64)


def first_holders(keys: np.ndarray, contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document that has each WIDTH-byte string of the contexts, one after another, and where each context's begin.

    Contexts of one key that differ are sorted by their suffixes; equal contexts were merged before.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    counts = sizes - WIDTH + 1
    begins = np.concatenate(([0], np.cumsum(counts)))
    best = np.repeat(docs, counts)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    alone = np.ones(len(k) + 1, bool)
    alone[1:-1] = k[1:] != k[:-1]
    mixed = np.sort(order[~(alone[:-1] & alone[1:])])
    if len(mixed):
        text = b"".join([contexts[c] for c in mixed.tolist()])
        n = counts[mixed]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begins[:-1][mixed], n) + offset
        held = best[at]
        starts = np.repeat(np.cumsum(sizes[mixed]) - sizes[mixed], n) + offset
        equal = [members for members in deep_shallow_sort(text, starts) if len(members) > 1]
        if equal:
            many = np.fromiter(map(len, equal), np.int64, len(equal))
            flat = np.fromiter(itertools.chain.from_iterable(equal), np.int64, many.sum())
            best[at[flat]] = np.repeat(np.minimum.reduceat(held[flat], np.cumsum(many) - many), many)
    return best, begins


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] numbers), then start[1], ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def remove_repeated_strings(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row a document, without the bytes of strings of 50 bytes that a smaller doc_id also has.

    keep_text: adds the column kept_text (bytes).
    """
    groups = C.group_count(docs)
    buckets = max(1, groups // 2)
    dealt = C.grouped(docs, groups)

    def ask(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        _, _, _, keys = _runs(C.rows_of(table))
        return C.ask_keys(g, keys, buckets)

    def show(table: pa.Table, told: pa.Table) -> pa.Table:
        """Contexts under keys that other documents, here or elsewhere, have too, and where they stand."""
        names = ("bucket", "g", "keys", "lens", "docs", "data", "rows", "ctx", "starts")
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
        if not table.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        g = table.column("g")[0].as_py()
        rows = C.rows_of(table)
        ids = _ids(rows)
        row, start, end, keys = _runs(rows)
        order = np.lexsort((ids[row], keys))
        k, d = keys[order], ids[row][order]
        here = k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])]
        known = np.unique(np.concatenate([here, *map(C.unpack48, told.column("payload").to_pylist())]))
        wanted = np.flatnonzero(np.isin(keys, known)) if len(known) else []
        out = []
        if len(wanted):
            for b, at in C.by_bucket(keys[wanted], buckets):
                seen: dict = {}
                ctx = []
                for w in wanted[at].tolist():
                    r = int(row[w])
                    one = seen.setdefault((int(keys[w]), rows[r][1][start[w] : end[w] + WIDTH - 1]), [len(seen), C.NO_ID])
                    one[1] = min(one[1], int(ids[r]))
                    ctx.append(one[0])
                texts = [c for _, c in seen]
                out.append((b, g, C.pack48(np.array([x for x, _ in seen], np.uint64)), np.array([len(c) for c in texts], np.int32).tobytes(), np.array([x[1] for x in seen.values()], np.int64).tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), row[wanted[at]].astype(np.int32).tobytes(), np.array(ctx, np.int32).tobytes(), start[wanted[at]].astype(np.int32).tobytes()))
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(names, kinds))})

    def sort(table: pa.Table) -> pa.Table:
        asks, place = [], {}
        keys, docs_, texts = [], [], []
        for x in table.to_pylist():
            k, lens, d = C.unpack48(x["keys"]), np.frombuffer(x["lens"], np.int32).tolist(), np.frombuffer(x["docs"], np.int64)
            data, at, to = zstandard.ZstdDecompressor().decompress(x["data"]), 0, []
            for key, n, doc in zip(k.tolist(), lens, d.tolist()):
                text = data[at : at + n]
                at += n
                p = place.setdefault((key, text), len(place))
                if p == len(keys):
                    keys.append(key)
                    docs_.append(doc)
                    texts.append(text)
                elif doc < docs_[p]:
                    docs_[p] = doc
                to.append(p)
            asks.append((x["g"], np.array(to), np.frombuffer(x["rows"], np.int32), np.frombuffer(x["ctx"], np.int32), np.frombuffer(x["starts"], np.int32).astype(np.int64)))
        del place
        best, begins = first_holders(np.array(keys, np.uint64), texts, np.array(docs_, np.int64))
        # runs of strings with one first holder, within contexts
        new = np.ones(len(best), bool)
        new[1:] = best[1:] != best[:-1]
        new[begins[:-1]] = True
        run = np.flatnonzero(new)
        end = np.append(run[1:], len(best))
        first_run = np.searchsorted(run, begins[:-1])
        n_runs = np.diff(np.append(first_run, len(run)))
        out = []
        for g, to, r, ctx, s in asks:
            of = to[ctx]
            n = n_runs[of]
            i = ranges(first_run[of], n)
            shift = np.repeat(s - begins[:-1][of], n)
            out.append((g, np.stack([np.repeat(r.astype(np.int64), n), best[run[i]], run[i] + shift, end[i] + shift]).tobytes()))
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = C.rows_of(table)
        ids = _ids(rows)
        cover = [None] * len(rows)
        for p in told.column("payload").to_pylist():
            r, holder, a, b = np.frombuffer(p, np.int64).reshape(4, -1)
            hit = holder < ids[r]
            for i, x, y in zip(r[hit].tolist(), a[hit].tolist(), b[hit].tolist()):
                if cover[i] is None:
                    cover[i] = np.zeros(len(rows[i][1]), bool)
                cover[i][x : y + WIDTH - 1] = True
        out: dict[str, list] = {k.split()[0]: [] for k in RESULT.split(", ")}
        texts = []
        for (doc_id, text), mask in zip(rows, cover):
            spans, removed = (0, 0) if mask is None else (len(C.spans_of(mask)[0]), int(mask.sum()))
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if removed else text
            texts.append(kept)
            for k, v in zip(out, (doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest())):
                out[k].append(v)
        arrays = {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
        return pa.table(arrays | ({"kept_text": pa.array(texts, pa.binary())} if keep_text else {}))

    by = dealt.groupBy("g")
    told = by.applyInArrow(ask, "bucket int, g int, payload binary").groupBy("bucket").applyInArrow(C.shared_keys, "g int, payload binary")
    shown = by.cogroup(told.groupBy("g")).applyInArrow(show, "bucket int, g int, keys binary, lens binary, docs binary, data binary, rows binary, ctx binary, starts binary")
    held = shown.groupBy("bucket").applyInArrow(sort, "g int, payload binary")
    return by.cogroup(held.groupBy("g")).applyInArrow(remove, RESULT + (", kept_text binary" if keep_text else ""))
