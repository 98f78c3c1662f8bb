"""The citation graph: edges, reverse closures, degrees and cycles.

edges: (source, key, kind, ordinal), source citing key. Closures are fixpoints of joins; a
round joins the new frontier only, drops what is known and is written once, so the plan
stays as deep as one round. Nothing but the exact-order walk of one start is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged


def cut(df: DataFrame) -> DataFrame:
    return staged(df, "graph")


def edges_of(claims: DataFrame) -> DataFrame:
    """One row a declared reference, depends before because, each in its order; duplicates stay."""
    def kind(name: str) -> DataFrame:
        return claims.select(F.col("id").alias("source"), "file", F.lit(name).alias("kind"), F.posexplode(name).alias("ordinal", "key"))

    return kind("depends").unionByName(kind("because"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, member): all that cite start, or cite what does; start itself excluded.

    Semi-naive: each round joins the last round's members with the edges that cite them.
    """
    pairs = cut(edges.select(F.col("source").alias("member"), "key").distinct())
    rounds = [cut(starts.select("start", F.col("start").alias("member")).distinct())]
    while True:
        if len(rounds) > 16:  # a round's rows are written again once in 16 rounds, which keeps plans short
            rounds = [cut(reduce(DataFrame.unionByName, rounds[:-1])), rounds[-1]]
        known = reduce(DataFrame.unionByName, rounds)
        reached = rounds[-1].select("start", F.col("member").alias("key")).join(pairs, "key").select("start", "member").distinct()
        frontier = cut(reached.join(known, ["start", "member"], "left_anti"))
        if frontier.isEmpty():
            return known.filter("member <> start")
        rounds.append(frontier)


def degrees(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree (edges, not citers), review_surface (size of the closure)."""
    surface = closure(edges, claims.select(F.col("id").alias("start"))).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("review_surface"))
    cited = edges.groupBy(F.col("key").alias("id")).agg(F.count("*").alias("in_degree"))
    citing = claims.select("*", (F.size("depends") + F.size("because")).cast("long").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return citing.join(cited, "id", "left").join(surface, "id", "left").select("id", "file", F.col("block_line").alias("line"), "out_degree", zero("in_degree"), zero("review_surface"))


def zero_inbound(signals: DataFrame) -> DataFrame:
    return signals.filter("in_degree = 0")


def walk(edges: list[tuple[str, str]], start: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Members in order of discovery, depth first, and (claim, ancestor) for each edge into the current path.

    edges: (source, key) in corpus order; for one start of a graph that fits the driver.
    """
    citers: dict[str, list[str]] = {}
    for source, key in edges:
        citers.setdefault(key, []).append(source)
    found, cycles, seen, path, on_path = [], [], {start}, [start], {start}
    stack = [iter(citers.get(start, ()))]
    while stack:
        for source in stack[-1]:
            if source in on_path:
                cycles.append((source, path[-1]))
            elif source not in seen:
                seen.add(source)
                found.append(source)
                path.append(source)
                on_path.add(source)
                stack.append(iter(citers.get(source, ())))
                break
        else:
            stack.pop()
            on_path.discard(path.pop())
    return found, cycles
