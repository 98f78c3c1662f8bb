"""N-gram Jaccard join: documents whose word-shingle sets reach a similarity, by T-occurrence search.

1. Texts that are equal form a class, of which one row of the smallest doc_id goes on. Classes
   are numbered; the numbers are the nodes of all that follows.
2. By the prefix theorem two sets that reach the threshold t share at least l of the first
   n - ceil(t n) + l shingles of any order; here l is a tenth of the set, the order that of
   the hashes. Groups of documents ask which of these other documents have, and send a
   shingle once a group. A document with too few shared ones has no partner and goes.
3. What is left asks how many of these documents have each of its shingles. Shingles that
   no other has count as missed; a document that misses more than n - ceil(t n) goes. The
   n - ceil(t n) + 1 rarest shingles of each document name its inverted lists; documents
   that lists connect form a cluster.
4. Each cluster is searched by DivideSkip: of a document's lists the needed - 1 longest
   stay aside, the short ones are heap-merged, and members that occur in them are counted
   on by bisection in the long ones until they reach the overlap or cannot any more.
   Members that are known to be connected are not probed again.
5. A cluster of more than `block` documents is split into blocks. First each block is searched
   by the cluster's `leaders`; the members that this connects in the largest number are
   settled. Then blocks of the others ask all blocks. Near copies of one text are settled by
   its leaders, so that a cluster of them costs one reading a member, however large it is.
6. Components of the links, by hooking and jumping over DataFrames.

No list is expanded into pairs, and what a group or cell holds is bounded. Keys that many rows
may share are split: lists of a shingle, by member; equal texts, by a broadcast of the classes
that hold more than one row in `SHARE` (fewer than `SHARE`, therefore).

Defined cases: null and blank texts have empty sets and link with nothing; a null doc_id
counts as the largest id; rows of one doc_id and different texts are nodes of their own; equal
rows are told alike; ties of leaders go by number; very long texts are read whole, in one task
each; an empty table gives no rows. Shingles are hashed to 48 bits: the overlap of two sets is
wrong with a chance of about |x| |y| / 2**48.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
BASE = 0x9DDFEA08EB382D69
MASK = np.uint64((1 << 48) - 1)
WORD_BYTE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(BASE, m, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(BASE, -m, 1 << 64))))


POWERS = Powers()


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 48-bit hashes of the distinct k-word shingles of a text: A-Z lowered, words between blanks 0x20 and 0x09-0x0D.

    A word's hash is a polynomial of its bytes' random words, from prefix sums over the text.
    """
    data = np.frombuffer(text.lower(), np.uint8)
    start, end = C.spans_of(WORD_BYTE[data])
    n = len(start)
    if not n:
        return np.empty(0, np.uint64)
    POWERS.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(C.GEAR[data] * POWERS.up[: len(data)], out=sums[1:])
    w = C.mixed((sums[end] - sums[start]) * POWERS.down[start])
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = (h + w[j : n - size + 1 + j]) * ODD[j % len(ODD)]
        h ^= h >> np.uint64(29)
    return np.unique(C.mixed(h) & MASK)


def least_overlap(n: int, percent: int) -> int:
    """A set of n reaches percent/100 only by sharing this many: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def lists_needed(n: int) -> int:
    return 1 + n // 10


def first_shingles(h: np.ndarray, percent: int) -> np.ndarray:
    n = len(h)
    return h[: n - least_overlap(n, percent) + lists_needed(n)]


def t_occurrence(own: list[np.ndarray], needed: int, skip) -> np.ndarray:
    """Members that occur in at least `needed` of the sorted lists `own` (T-occurrence by DivideSkip).

    The needed - 1 longest lists are set aside; the others are heap-merged, and what occurs
    there is counted on by bisection in the long ones. skip(members): which of them need no answer.
    """
    if len(own) < needed:
        return np.empty(0, np.int64)
    own = sorted(own, key=len)
    short, long = own[: len(own) - needed + 1], own[len(own) - needed + 1 :]
    merged = np.fromiter(heapq.merge(*[l.tolist() for l in short]), np.int64)
    new = np.ones(len(merged), bool)
    new[1:] = merged[1:] != merged[:-1]
    at = np.flatnonzero(new)
    members, count = merged[at], np.diff(np.append(at, len(merged)))
    keep = ~skip(members)
    members, count = members[keep], count[keep]
    for i, l in enumerate(long):
        keep = count + (len(long) - i) >= needed
        if not keep.all():
            members, count = members[keep], count[keep]
        if not len(members):
            break
        p = np.searchsorted(l, members)
        p[p == len(l)] = 0
        count = count + (l[p] == members)
    return members[count >= needed]


class Forest:
    """Roots of members, kept flat enough for arrays of lookups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, members: np.ndarray) -> np.ndarray:
        r = self.parent[members]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: int, b: int) -> None:
        a, b = int(self.roots(np.array([a]))[0]), int(self.roots(np.array([b]))[0])
        self.parent[max(a, b)] = min(a, b)


def connect(sets: list[np.ndarray], sizes: np.ndarray, asks: np.ndarray, answers: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links (member, member) that connect whatever similar members of asks and answers connect; not all links.

    sets: the shared shingles of each member, sizes: how many it has in all.
    """
    every = np.concatenate([sets[m] for m in answers])
    of = np.repeat(answers, [len(sets[m]) for m in answers])
    order = np.lexsort((of, every))
    every, of = every[order], of[order]
    cut = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    keys, bounds = every[cut], np.append(cut, len(every))
    forest = Forest(len(sets))
    for q in asks.tolist():
        p = np.searchsorted(keys, sets[q])
        p[p == len(keys)] = 0
        p = p[keys[p] == sets[q]]
        own = [of[bounds[i] : bounds[i + 1]] for i in p.tolist()]
        mine = forest.roots(np.array([q]))[0]
        found = t_occurrence(own, least_overlap(int(sizes[q]), percent), lambda m: forest.roots(m) == mine)
        for m in found.tolist():
            if forest.roots(np.array([m]))[0] == forest.roots(np.array([q]))[0]:
                continue
            both = len(np.intersect1d(sets[q], sets[m], assume_unique=True))
            if 100 * both >= percent * (int(sizes[q]) + int(sizes[m]) - both):
                forest.join(q, m)
                yield q, m


def _texts(table: pa.Table) -> list[tuple[int, bytes, bytes]]:
    """(doc, digest of the text, text), a row for each distinct pair of the first two."""
    out = {}
    for i, t in zip(table.column("doc_id").to_pylist(), C.texts_of(table.column("text"))):
        out[C.NO_ID if i is None else i, hashlib.md5(t).digest()] = t
    return [(i, d, t) for (i, d), t in sorted(out.items())]


def candidate_sets(docs: DataFrame, classes: DataFrame, groups: int, k: int, percent: int) -> DataFrame:
    """node and n for each class, and keys: all its shingles if it may have a partner, else null."""
    buckets = max(1, groups // 2)
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    dealt = lambda doc, digest: F.pmod(F.xxhash64(doc, digest), F.lit(groups)).cast("int").alias("g")
    by = docs.select("*", dealt(F.coalesce("doc_id", F.lit(C.NO_ID)), digest)).groupBy("g")
    long = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    named = classes.select(dealt(F.col("doc"), F.col("digest")), F.lit(True).alias("named"), F.concat(long("doc"), "digest", long("node")).alias("payload"))

    def own(table: pa.Table, side: pa.Table) -> list[tuple[int, np.ndarray]]:
        names = {p[:24]: int.from_bytes(p[24:], "big") for p, is_name in zip(side.column("payload").to_pylist(), side.column("named").to_pylist()) if is_name}
        found = ((names.get(i.to_bytes(8, "big") + d), t) for i, d, t in _texts(table))
        return [(node, shingle_set(t, k)) for node, t in found if node is not None]

    def ask(table: pa.Table, side: pa.Table) -> pa.Table:
        parts = [first_shingles(h, percent) for _, h in own(table, side)] if table.num_rows else []
        return C.ask_keys(table.column("g")[0].as_py() if parts else 0, np.concatenate([np.empty(0, np.uint64), *parts]), buckets)

    def keep(table: pa.Table, side: pa.Table) -> pa.Table:
        rows = own(table, side) if table.num_rows else []
        first = [first_shingles(h, percent) for _, h in rows]
        every, count = np.unique(np.concatenate([np.empty(0, np.uint64), *first]), return_counts=True)
        told = [C.unpack48(p) for p, is_name in zip(side.column("payload").to_pylist(), side.column("named").to_pylist()) if not is_name]
        known = np.unique(np.concatenate([every[count > 1], *told]))
        keys = []
        for (_, h), f in zip(rows, first):
            p = np.searchsorted(known, f)
            p[p == len(known)] = 0
            shared = int((known[p] == f).sum()) if len(known) else 0
            # a partner has least_overlap(n) elements or more, and shares as many lists as that size asks for
            keys.append(C.pack48(h) if len(h) and shared >= lists_needed(least_overlap(len(h), percent)) else None)
        return pa.table({"node": pa.array([i for i, _ in rows], pa.int64()), "n": pa.array([len(h) for _, h in rows], pa.int64()), "keys": pa.array(keys, pa.binary())})

    asked = by.cogroup(named.groupBy("g")).applyInArrow(C.lean(ask), "bucket int, g int, payload binary")
    told = asked.groupBy("bucket").applyInArrow(C.lean(C.shared_keys), "g int, payload binary").select("g", F.lit(False).alias("named"), "payload")
    return by.cogroup(told.unionByName(named).groupBy("g")).applyInArrow(C.lean(keep), "node long, n long, keys binary")


def counted_sets(sets: DataFrame, groups: int, percent: int) -> DataFrame:
    """node, n, keys that other documents of sets have too, and lists (longs): the rarest, that any partner shares one of."""
    buckets = max(1, groups // 2)
    by = sets.select("node", "n", "keys", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int").alias("g")).groupBy("g")

    def counts_of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        keys = [C.unpack48(p) for p in table.column("keys").to_pylist()]
        return keys, *np.unique(np.concatenate(keys), return_counts=True)

    def ask(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        _, keys, count = counts_of(table)
        out = [(b, C.pack48(keys[i]) + count[i].astype("<u4").tobytes()) for b, i in C.by_bucket(keys, buckets)]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "g": pa.array([g] * len(out), pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})

    def split(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(payload) // 10
        return C.unpack48(payload[: 6 * n]), np.frombuffer(payload[6 * n :], "<u4").astype(np.int64)

    def answer(table: pa.Table) -> pa.Table:
        gs, parts = table.column("g").to_pylist(), [split(p) for p in table.column("payload").to_pylist()]
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)
        out, at = [], 0
        for g, (k, _) in zip(gs, parts):
            t = total[place[at : at + len(k)]]
            at += len(k)
            if (t > 1).any():
                out.append((g, C.pack48(k[t > 1]) + np.minimum(t[t > 1], (1 << 32) - 1).astype("<u4").tobytes()))
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})

    def keep(table: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"node": [], "n": [], "keys": [], "lists": []}
        parts = [split(p) for p in told.column("payload").to_pylist()]
        if parts and table.num_rows:
            keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            for node, n, packed in zip(table.column("node").to_pylist(), table.column("n").to_pylist(), table.column("keys").to_pylist()):
                own = C.unpack48(packed)
                p = np.searchsorted(keys, own)
                p[p == len(keys)] = 0
                shared = keys[p] == own
                own, c = own[shared], counts[p[shared]]
                more = len(own) - least_overlap(n, percent) + 1  # as many of the rarest; the unshared are rarer
                if more > 0:
                    for k, v in zip(out, (node, n, C.pack48(own), own[np.lexsort((own, c))[:more]].view(np.int64))):
                        out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    told = by.applyInArrow(C.lean(ask), "bucket int, g int, payload binary").groupBy("bucket").applyInArrow(C.lean(answer), "g int, payload binary")
    return by.cogroup(told.groupBy("g")).applyInArrow(C.lean(keep), "node long, n long, keys binary, lists array<long>")


#: A key with more than one row in SHARE is hot: it is dealt apart from the others.
SHARE = 1000


def connected(lists: DataFrame, salts: int = 32) -> DataFrame:
    """(node, label) of nodes that lists (node, h) connect. A list is joined in parts, by its members; its parts meet in their smallest nodes."""
    parts = lists.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(salts)))
    least = C.staged(parts.groupBy("h", "part").agg(F.min("node").alias("v")), "least")
    of_list = least.groupBy("h").agg(F.min("v").alias("u"))
    links = parts.join(least, ["h", "part"]).select(F.col("node").alias("u"), "v").unionByName(least.join(of_list, "h").select("u", "v"))
    return components(links)  # which leaves out nodes that only meet themselves


def searched(cells: DataFrame, sets: DataFrame, percent: int, groups: int) -> DataFrame:
    """Links (u, v) of cells (label, i, j, node, asks, answers): in each, what asks is searched for in what answers."""

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending")])
        ids, sizes = table.column("node").to_pylist(), table.column("n").to_numpy()
        asks, answers = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("asks", "answers"))
        keys = [C.unpack48(p) for p in table.column("keys").to_pylist()]
        pairs = [(ids[a], ids[b]) for a, b in connect(keys, sizes, asks, answers, percent)] if len(asks) and len(answers) else []
        return pa.table({"u": pa.array([min(p) for p in pairs], pa.int64()), "v": pa.array([max(p) for p in pairs], pa.int64())})

    # as many tasks as the text has groups: the search takes time, not bytes, and must not be coalesced by size
    once = cells.groupBy("label", "i", "j", "node").agg(F.max("asks").alias("asks"), F.max("answers").alias("answers"))
    return once.join(sets.select("node", "n", "keys"), "node").repartition(groups, "label", "i", "j").groupBy("label", "i", "j").applyInArrow(C.lean(linked), "u long, v long")


def cluster_links(clusters: DataFrame, sets: DataFrame, percent: int, groups: int, block: int, leaders: int) -> DataFrame:
    """Links (u, v) that connect what links connect in clusters (node, label)."""
    yes, no, number = F.lit(True), F.lit(False), lambda c, n: F.pmod(F.xxhash64(c), n)
    large = C.staged(clusters.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") > block).withColumn("blocks", F.ceil(F.col("size") / block)), "large")
    small = clusters.join(large, "label", "left_anti").select("label", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node", yes.alias("asks"), yes.alias("answers"))
    links = C.staged(searched(small, sets, percent, groups), "links")
    if large.isEmpty():
        return links
    members = C.staged(clusters.join(large, "label").withColumn("own", number("node", F.col("blocks"))), "members")
    # a block's own candidates first, so that no task sorts a whole cluster
    first = lambda rows, key: rows.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list("c")), 1, leaders).alias("c"))
    chosen = first(members.groupBy("label", "own", number("node", F.lit(leaders)).alias("k")).agg(F.min("node").alias("c")).groupBy("label", "k").agg(F.min("c").alias("c")), ["label"])
    everywhere = large.join(chosen, "label").select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "c").select("label", "j", F.explode("c").alias("node"))
    led = members.select("label", F.col("own").alias("j"), "node", no.alias("asks"), yes.alias("answers")).unionByName(everywhere.select("label", "j", "node", yes.alias("asks"), yes.alias("answers")))
    links = links.unionByName(C.staged(searched(led.withColumn("i", F.lit(-1).cast("long")), sets, percent, groups), "led"))
    found = components(links.join(members.select(F.col("node").alias("u")), "u", "left_semi")).withColumnRenamed("label", "part")
    parted = C.staged(members.join(found, "node", "left").withColumn("part", F.coalesce("part", "node")), "parted")
    largest = parted.groupBy("label", "part").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("part", F.struct("c", "part")).alias("settled"))
    parted = C.staged(parted.join(largest, "label").withColumn("open", F.col("part") != F.col("settled")), "open")
    rest = C.staged(parted.groupBy("label").agg(F.ceil(F.count_if("open") / block).alias("askers")).filter("askers > 0"), "askers")
    parted = parted.join(rest, "label")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asks = parted.filter("open").select("label", number("node", F.col("askers")).alias("i"), upto(F.col("blocks")).alias("j"), "node", yes.alias("asks"), no.alias("answers"))
    answers = parted.select("label", upto(F.col("askers")).alias("i"), F.col("own").alias("j"), "node", no.alias("asks"), yes.alias("answers"))
    return links.unionByName(C.staged(searched(asks.unionByName(answers), sets, percent, groups), "rest"))


def joined(docs: DataFrame, k: int, percent: int, block: int, leaders: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc, digest) of each row, and (digest, doc, rows, n_shingles, component_id, chosen) of each class; chosen: the one of its component that stands for it."""
    docs = C.id_text(docs)
    groups = C.group_count(docs)
    marks = C.staged(docs.select("doc_id", F.coalesce("doc_id", F.lit(C.NO_ID)).alias("doc"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest")), "marks")
    classes = C.staged(marks.groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = C.staged(candidate_sets(docs, classes, groups, k, percent), "classsets")
    sets = C.staged(counted_sets(found.filter("keys is not null"), max(1, groups // 4), percent), "sets")
    clusters = connected(C.staged(sets.select("node", F.explode("lists").alias("h")), "lists"))
    labels = components(cluster_links(clusters, sets, percent, groups, block, leaders))
    of_class = classes.join(found.select("node", F.col("n").alias("n_shingles")), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_class = C.staged(of_class, "ofclass")
    least = of_class.groupBy("label").agg(F.min(F.struct("doc", "node")).alias("least"))
    return marks, C.staged(of_class.join(least, "label").select("digest", "doc", "rows", "n_shingles", F.col("least.doc").alias("component_id"), (F.col("node") == F.col("least.node")).alias("chosen")), "components")


def with_class(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows (digest, ...) with the columns of their classes; classes of more than total / SHARE rows, fewer than SHARE of them, are broadcast."""
    hot = F.col("rows") * SHARE > total
    hot_classes = F.broadcast(classes.filter(hot))
    return rows.join(hot_classes, "digest").unionByName(rows.join(hot_classes.select("digest"), "digest", "left_anti").join(classes.filter(~hot), "digest"))


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 256, leaders: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row.

    Two documents link when 100 * |intersection| >= percent * |union| of their k-word shingle sets.
    """
    marks, classes = joined(docs, k, percent, block, leaders)
    rows = with_class(marks.select("doc_id", F.col("doc").alias("own"), "digest"), classes, marks.count())
    component = F.when(F.col("n_shingles") == 0, F.col("own")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", F.when(component != C.NO_ID, component).alias("component_id"))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 256, leaders: int = 8) -> DataFrame:
    """docs with one row of each component, of the smallest doc_id; rows without words all stay.

    Rows are told apart by doc_id and text, so that rows of one id, or of none, go each by its own text;
    of rows equal in both any one stays.
    """
    marks, classes = joined(docs, k, percent, block, leaders)
    rows = with_class(marks.select(F.col("doc").alias("own"), "digest"), classes, marks.count()).filter("n_shingles > 0")
    stands = F.col("chosen") & (F.col("own") == F.col("doc"))
    counted = C.staged(rows.groupBy("own", "digest").agg(F.first(stands).alias("stands"), F.count("*").alias("c")).filter("not stands or c > 1"), "counted")
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    keyed = docs.select(*C.carried(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)).alias("own"), digest.alias("digest"))
    gone = counted.select("own", "digest")
    left = keyed.join(gone.hint("shuffle_hash"), ["own", "digest"], "left_anti")
    again = counted.filter("stands").select("own", "digest")
    if not again.isEmpty():  # of equal rows that stand for their component, one
        left = left.unionByName(keyed.join(again, ["own", "digest"], "left_semi").dropDuplicates(["own", "digest"]))
    return left.select(*C.given_back(docs.columns))
