"""Places of regular-expression matches as Column expressions (no Python on the executors).

Spark lists matches but not where they stand. The pieces between matches do the rest: a
match starts after all pieces and matches before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def match_spans(text: Column, pattern: str, group: int = 0, before: int = 0) -> Column:
    """array<struct<start, end, value, before>>: leftmost non-overlapping matches, in code points, end exclusive.

    pattern is a Java regular expression that never matches the empty string and has a group
    for each number asked for; value is the given group, before the characters ahead of the
    match, back to the previous match at most. Empty for texts without a match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(whole)).alias("p"), whole.alias("m"), values.alias("v"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        ahead = F.right(x["p"], F.lit(before)) if before else F.lit("")
        span = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), ahead.alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # appending copies what is there: blocks keep a text of many matches from costing their square
    def block(acc: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    walk = F.aggregate(blocks(zipped), F.struct(F.lit(0).alias("at"), F.array(none).alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), walk).otherwise(none)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once; a lambda would compute what it captures once an element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blocks(items: Column) -> Column:
    """items in arrays of at most BLOCK, in order; [[]] for none."""
    last = lambda x: F.greatest(F.floor((F.size(x) - 1) / BLOCK), F.lit(0)).cast("int")
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))


def clear_of(spans: Column, others: Column) -> Column:
    """Those of spans that share no character with one of others.

    Blocks of others know their first start and last end; a block that lies apart is not searched.
    """
    ends = lambda b, f, name: f(F.transform(b, lambda o: o[name])).alias(name)
    covers = F.transform(blocks(others), lambda b: F.struct(ends(b, F.array_min, "start"), ends(b, F.array_max, "end"), b.alias("spans")))

    def clear(s: Column, c: Column) -> Column:
        met = lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])
        return ~F.exists(c, lambda b: F.coalesce(met(b), F.lit(False)) & F.exists(b["spans"], met))

    return let(covers, lambda c: F.filter(spans, lambda s: clear(s, c)))


def span_texts(kind: str, spans: Column) -> Column:
    """Each span as kind:start:end."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0))).otherwise(F.expr("0"))), F.lit(0), lambda a, d: a + d
    ) + F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 1, (2 * F.coalesce(d.try_cast("int"), F.lit(0))) % 10 + F.floor(2 * F.coalesce(d.try_cast("int"), F.lit(0)) / 10).cast("int")).otherwise(F.expr("0"))), F.lit(0), lambda a, d: a + d
    )
    return total % 10 == 0
