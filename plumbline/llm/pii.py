"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find, in DataFrame operations alone.

Seeds are the addresses, IPs, cards and phone numbers that patterns find. Candidates are
identifier-like tokens (4 digits or more in 6 to 40 characters) clear of seeds, but for those
that have the form of a seed and failed its check. A lexical pattern is the word ahead of an
instance, the two words ahead of it, or the words on both sides of it; seeds and candidates
induce patterns. The graph of patterns and instances is scored in rounds:

- An instance known so far scores 1 if it is a seed, else what the last round inferred.
- A pattern that introduces `support` known instances or more has as its confidence the sum of
  its instances' scores, by occurrence, over all its occurrences in the texts, whatever follows
  there, but that a candidate which is not known yet speaks against it with the weight `unknown`
  only: function words, which mostly introduce words, stay near 0.
- Confident patterns (`least` or more) infer: an instance scores 1 - product(1 - confidence)
  over its confident patterns, and is known from then on, so that it can carry further patterns.

Candidates that a confident pattern introduces are personal data.

One scan writes seeds and tokens, another adds up occurrences of the patterns that could ever be
confident; rounds run on the graph's distinct edges, which are grouped with partial sums, so a
common word costs no more than its distinct instances. Confident patterns meet tokens by a join.

Defined cases: null texts are empty; rows of equal doc_id are scanned each; without seeds
there are no patterns; copies of a text count as occurrences, not as further instances; patterns
of equal confidence are all taken; very long texts are scanned whole; an empty table gives no
rows. Spans are code points, end exclusive. Patterns are known by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .spans import blocks, clear_of, digits, let, luhn, match_spans, span_texts

KINDS = ("email", "ip", "card", "phone", "context")
#: The patterns asked for. Possessive, and begun only where a run begins, they find
#: the same matches in time linear in the text.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
#: A whole run of 6 characters or more with 4 digits or more; the look-ahead runs once a run.
TOKEN = "(?<![^\\s,;])(?=(?:[A-Za-z@._+()/:#-]*+[0-9]){4})[A-Za-z0-9@._+()/:#-]{6,}+"
BEFORE = 64
#: Forms of seeds: a token of such a form that is no seed has failed the seed's check.
FAILED = "[0-9](?:[ -]?[0-9]){15,}[.,;:]*|[0-9]+(?:\\.[0-9]+){3}[.,;:]*"


def scanned(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, and the spans of each kind and of identifier-like tokens, with the characters ahead of them.

    With carry, all columns of docs as well (see common.carried).
    """
    t = F.col("_t")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(C.carried(docs) if carry else []), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    more = [f"`{C.CARRIED}{c}`" for c in docs.columns] if carry else []
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    number = lambda s: digits(s["value"])
    n_digits = lambda s: F.length(number(s))
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3  # noqa: E731  then it is a small number
    parts_ok = lambda s: F.forall(F.split(s["value"], "\\."), lambda p: part(p) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    spans = lambda pattern: match_spans(t, pattern, before=BEFORE)
    numeric = t.rlike("[0-9]")
    df = df.select(
        "doc_id",
        *more,
        "_t",
        F.when(t.contains("@"), spans(EMAIL)).otherwise(none).alias("email"),
        F.when(numeric, F.filter(spans(IP), parts_ok)).otherwise(none).alias("ip"),
        F.when(numeric, F.filter(F.filter(spans(CARD), lambda s: n_digits(s).between(16, 19)), lambda s: luhn(number(s)))).otherwise(none).alias("card"),
        F.when(t.contains("+"), F.filter(spans(PHONE), lambda s: n_digits(s).between(8, 15))).otherwise(none).alias("phone"),
        F.when(numeric, F.filter(spans(TOKEN), lambda s: (F.length(s["value"]) <= 40) & (n_digits(s) >= 4) & ~s["value"].rlike("\\A(?:%s)\\z" % FAILED))).otherwise(none).alias("tokens"),
    )
    free = clear_of(F.col("tokens"), F.concat("email", "ip", "card", "phone"))
    placed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), introduced_by(F.col("_t"), s).alias("patterns")))
    return df.select("doc_id", *more, *[placed(F.col(k)).alias(k) for k in KINDS[:4]], placed(free).alias("free"))


def words_of(text: Column) -> Column:
    """The words of a text as patterns have them: in small letters, runs of digits as 0."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "\\s+"), "")


def patterns_of(first: Column, second: Column, after: Column) -> Column:
    """Hashes of the patterns of a place: the word ahead (second), both words ahead, the words on both sides. Null where a word is missing."""
    return F.array(
        F.when(second.isNotNull(), F.xxhash64(F.lit(1), second)),
        F.when(first.isNotNull() & second.isNotNull(), F.xxhash64(F.lit(2), first, second)),
        F.when(second.isNotNull() & after.isNotNull(), F.xxhash64(F.lit(3), second, after)),
    )


def introduced_by(text: Column, span: Column) -> Column:
    """Hashes of the patterns of a span."""
    ahead = words_of(span["before"])
    behind = words_of(text.substr(span["end"] + 1, F.lit(BEFORE)))
    return F.array_compact(let(ahead, lambda w: patterns_of(F.get(w, F.size(w) - 2), F.get(w, F.size(w) - 1), F.get(behind, 0))))


def _edges(found: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n): how often each pattern introduces each instance."""
    base = F.concat("email", "ip", "card", "phone")
    told = lambda spans, seed: F.transform(spans, lambda s: F.struct(s["patterns"].alias("patterns"), s["value"].alias("instance"), F.lit(seed).alias("seed")))
    every = found.select(F.explode(F.concat(told(base, True), told(F.col("free"), False))).alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.instance", "x.seed")
    return every.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of patterns occurs in the texts, whatever follows the words ahead.

    A pattern of words ahead occurs wherever they stand ahead of another word.
    """
    words = docs.select(words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).filter("size(w) > 1")
    none = F.array(F.lit(None).cast("string"))
    rest = F.size("w") - 1
    places = words.select(F.explode(F.arrays_zip(F.concat(none, F.slice("w", 1, rest - 1)).alias("first"), F.slice("w", 1, rest).alias("second"), F.concat(F.slice("w", 3, rest), none).alias("after"))).alias("x"))
    hashes = places.select(F.explode(patterns_of(F.col("x.first"), F.col("x.second"), F.col("x.after"))).alias("pattern"))
    return hashes.join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def confident_patterns(found: DataFrame, docs: DataFrame, rounds: int = 3, least: float = 0.5, support: int = 3, smooth: float = 1.0, unknown: float = 0.25) -> DataFrame:
    """(pattern, confidence): patterns that introduce personal data, by `rounds` of scoring the graph of patterns and instances."""
    edges = C.staged(_edges(found), "edges")
    # what never introduces `support` instances can't become confident
    able = C.staged(edges.groupBy("pattern").agg(F.count("*").alias("c")).filter(F.col("c") >= support).select("pattern"), "able")
    totals = occurrences(docs, able)
    edges = C.staged(edges.join(totals, "pattern"), "totals")
    scores = C.staged(edges.filter("seed").select("instance").distinct().withColumn("score", F.lit(1.0)), "scores")
    for _ in range(rounds):
        held = edges.join(scores, "instance", "left")
        doubt = F.max("total") - (1 - unknown) * F.sum(F.when(F.col("score").isNull(), F.col("n")).otherwise(0)) + smooth
        sure = held.groupBy("pattern").agg((F.sum(F.coalesce(F.col("score") * F.col("n"), F.lit(0.0))) / doubt).alias("confidence"), F.count("score").alias("known"))
        sure = C.staged(sure.filter((F.col("known") >= support) & (F.col("confidence") >= least)).select("pattern", F.least("confidence", F.lit(0.999999)).alias("confidence")), "sure")
        inferred = edges.join(sure, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("inferred"), F.max(F.col("seed").cast("double")).alias("seed"))
        seeds = edges.filter("seed").select("instance").distinct().withColumn("score", F.lit(1.0))
        scores = C.staged(inferred.select("instance", F.greatest("inferred", "seed").alias("score")).unionByName(seeds).groupBy("instance").agg(F.max("score").alias("score")), "scores")
    return sure


def with_context(docs: DataFrame, carry: bool = False, **options) -> DataFrame:
    """scanned(docs, carry) with context, the candidates that confident patterns introduce."""
    found = C.staged(scanned(docs, carry).withColumn("_row", F.monotonically_increasing_id()), "personal")
    patterns = confident_patterns(found, docs, **options)
    tokens = found.select("_row", F.explode("free").alias("s")).withColumn("pattern", F.explode("s.patterns"))
    hits = tokens.join(patterns, "pattern", "left_semi").groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("s.start", "s.end", "s.value"))).alias("context"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return found.join(C.staged(hits, "context"), "_row", "left").drop("_row", "free").withColumn("context", F.coalesce("context", none))


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, and email, ip, card, phone, context: the spans of each kind in each text."""
    return with_context(docs, **options).select("doc_id", *KINDS)


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start."""
    return F.array_join(F.concat(*[span_texts(k, F.col(k)) for k in kinds]), ",")


def personal_data_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of each pattern, the digest of pattern spans, and all spans."""
    found = find_personal_data(docs, **options)
    count = lambda k: F.size(k).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(joined(KINDS[:4]), 256).alias("base_sha256"), joined(KINDS).alias("spans"), count("context").alias("n_context"), sum(map(count, KINDS)).alias("n_spans"))


def apart(spans: Column) -> Column:
    """Of sorted spans, in blocks, those that start at or behind the end of the last one taken."""
    none = F.array().cast("array<struct<start:int,end:int,mask:string>>")

    def step(acc: Column, s: Column) -> Column:
        taken = F.struct((-s["end"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["mask"].alias("mask")))).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(taken)

    def block(acc: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    return F.aggregate(blocks(spans), F.struct(F.lit(0).alias("at"), F.array(none).alias("out")), block, lambda acc: F.filter(acc["out"], lambda b: F.size(b) > 0))


def masked(text: Column, spans: dict[str, Column]) -> Column:
    """text with each span replaced by [KIND]; of overlapping spans the one that starts first, then the longer.

    A block of spans cuts its own stretch out of the text once and walks that; texts are joined from
    pieces once. The time is that of the text by its blocks of spans, not by its spans.
    """
    def placed(k: str, s: Column) -> Column:
        return F.transform(s, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), F.lit(f"[{k.upper()}]").alias("mask")))

    def stretch(b: Column, chunk: Column) -> Column:
        begin = F.get(b, 0)["start"]
        piece = lambda s, i: F.concat(s["mask"], F.coalesce(chunk.substr(s["end"] - begin + 1, F.get(b, i + 1)["start"] - s["end"]), F.lit("")))
        return F.array_join(F.transform(b, piece), "")

    def walk(every: Column) -> Column:
        last = lambda b: F.get(b, F.size(b) - 1)["end"]

        def part(b: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(last(F.get(every, i - 1)))
            begin = F.get(b, 0)["start"]
            return F.concat(text.substr(before + 1, begin - before), let(F.struct(b.alias("b"), text.substr(begin + 1, last(b) - begin).alias("chunk")), lambda x: stretch(x["b"], x["chunk"])))

        return F.concat(F.array_join(F.transform(every, part), ""), text.substr(last(F.get(every, F.size(every) - 1)) + 1, F.length(text)))

    every = F.concat(*[placed(k, s) for k, s in spans.items()])
    return F.when(F.size(every) > 0, let(apart(F.sort_array(every)), walk)).otherwise(text)


def mask_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each piece of personal data replaced by its kind in brackets, and n_chars to match."""
    found = with_context(docs, carry=True, **options)
    text = F.col(f"`{C.CARRIED}text`")
    hidden = found.withColumn("_masked", masked(text, {k: F.col(k) for k in KINDS}))
    return hidden.select(*C.given_back(docs.columns, F.col("_masked")))
