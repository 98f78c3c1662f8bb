"""Secret scans: fixed patterns, and character Markov models compared by likelihood, in DataFrame operations alone.

Patterns find assignments, access keys and long hex strings. Beyond them, tokens of `SHORTEST`
characters or more are scored under two first-order Markov models, one of random strings,
one of ordinary identifiers; the mean log-likelihood ratio a character decides. Both models are
trained from labelled samples (text, random): a table given, or the one that `labelled_samples`
makes by rule. Four of five samples train; the others, held out, set the ratio a token must
exceed: the highest that misses at most 1 % of the random ones, or a higher one where more than
one ordinary identifier in a thousand would exceed it.

One scan of the texts writes the matches and tokens, which are few. What the driver holds is
the two tables of character pairs, of a fixed size.

Spans are code points, end exclusive; a model span never overlaps a pattern's.
Defined cases: null texts are empty and have no spans; without samples of both kinds the models
find nothing; rows of equal doc_id are scanned each; a token as good as the threshold stays out;
samples of null text or label play no part; very long texts and tokens are scored whole, in time
linear in their length; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .spans import clear_of, let, match_spans

#: The patterns asked for. Of hex and access keys only matches of full length can be, as the runs are maximal.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
SHORTEST = 16
TOKEN = "[A-Za-z0-9+/_=-]{%d,}" % SHORTEST
KINDS = ("assign", "access", "hex", "markov")
#: The models' alphabet; other characters count as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET) + 1


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each kind, and tokens to score."""
    t = F.col("text")
    df = C.id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return df.select(
        "doc_id",
        F.filter(match_spans(t, ASSIGN, 1), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        match_spans(t, ACCESS).alias("access"),
        match_spans(t, HEX).alias("hex"),
        match_spans(t, TOKEN).alias("tokens"),
    )


def codes(text: Column) -> Column:
    """The number of each character in the alphabet, from 1; 0 for others. Linear in the text."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(pair, c): how often each pair of neighbouring characters occurs in samples (text).

    The keys are SIZE**2 at most, so that tasks add up before anything is shuffled.
    """
    pairs = let(codes(F.col("text")), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: F.get(x, i) * SIZE + F.get(x, i + 1)))
    return samples.filter("length(text) > 1").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("c"))


def transition_logs(counts: dict[int, int], weight: float = 8.0, prior: float = 0.5) -> list[float]:
    """log P(next | character) for every pair: counts, backed off with `weight` to how often a character comes next at all."""
    rows, nexts = Counter(), Counter()
    for pair, c in counts.items():
        rows[pair // SIZE] += c
        nexts[pair % SIZE] += c
    total = sum(nexts.values()) + prior * SIZE
    alone = [(nexts[y] + prior) / total for y in range(SIZE)]
    return [math.log((counts.get(x * SIZE + y, 0) + weight * alone[y]) / (rows[x] + weight)) for x in range(SIZE) for y in range(SIZE)]


def trained(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """The log-likelihood ratio, random against ordinary, of every pair of characters: SIZE**2 numbers."""
    counts = pair_counts(random).withColumn("kind", F.lit(1)).unionByName(pair_counts(ordinary).withColumn("kind", F.lit(0))).collect()
    of = [{r.pair: r.c for r in counts if r.kind == k} for k in (0, 1)]
    if not of[0] or not of[1]:
        return [0.0] * SIZE**2
    return [a - b for a, b in zip(transition_logs(of[1]), transition_logs(of[0]))]


def mean_ratio(value: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio a character pair of a string."""
    table = F.from_json(F.lit(json.dumps([round(r, 6) for r in ratios])), "array<double>")
    total = let(codes(value), lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 2), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(x, i) * SIZE + F.get(x, i + 1))))
    return total / (F.length(value) - 1)


#: Parts of ordinary identifiers, paths and file names.
PARTS = """account action address admin alpha amount app archive asset async backend backup base batch block body buffer build bytes cache card cart
center channel check child client clone code color commit common config connection content context cookie copy create cursor data date
default delete deploy detail dialog docs domain download edit email entity entry event example factory feature file filter first flag footer
format function gateway graph group hash header helper history host html icon image index info install instance item job kernel key language
layer length level license link loader local logger login manager map media member menu message metric migration mode model monitor name
node notes object offset option order package page parser password payment player point policy port post preview private product profile
provider proxy query queue range readme region release render report resource response return role router sample schema scope search section
server service setting shared simple size stage start static status stream string system table task template text theme time title tool
topic trace transaction tree type update upload util value version video volume web window worker""".split()
#: What random strings are drawn from: letters and digits, base64, hex of either case, lower and upper letters with digits.
ALPHABETS = (ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", "0123456789ABCDEF", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62])


def labelled_samples(spark: SparkSession, count: int = 6000) -> DataFrame:
    """(text, random): `count` random strings and as many ordinary identifiers, made by rule from hashes of their numbers."""
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    size = SHORTEST + draw("size", 29)
    letters = F.element_at(F.array(*map(F.lit, ALPHABETS)), draw("alphabet", len(ALPHABETS)) + 1)
    random = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: letters.substr(F.pmod(F.xxhash64(F.col("id"), i), F.length(letters)).cast("int") + 1, F.lit(1))), "")
    parts = F.from_json(F.lit(json.dumps(PARTS)), "array<string>")
    words = F.transform(F.sequence(F.lit(1), 2 + draw("words", 5)), lambda i: F.get(parts, F.pmod(F.xxhash64(F.lit("part"), F.col("id"), i), F.lit(len(PARTS))).cast("int")))
    title = F.transform(words, F.initcap)
    styles = [F.array_join(words, "_"), F.array_join(words, "-"), F.array_join(words, "/"), F.upper(F.array_join(words, "_")), F.array_join(title, ""), F.concat(F.get(words, 0), F.array_join(F.slice(title, 2, 9), "")), F.array_join(words, "")]
    number = draw("number", 10000)
    tails = [number % 10, number % 100, F.concat(F.lit("_v"), number % 10), F.concat(F.lit("-20"), F.format_string("%02d-%02d-%02d", number % 30, number % 12 + 1, number % 28 + 1)), F.concat(F.lit("_"), number), F.lit(""), F.concat(F.lit("/"), number % 10, F.lit("/"), F.get(words, 1))]
    pick = lambda salt, of: F.element_at(F.array(*[c.cast("string") for c in of]), draw(salt, len(of)) + 1)
    ordinary = F.concat(pick("style", styles), pick("tail", tails))
    ids = spark.range(0, count, 1, 4)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(ordinary.alias("text"), F.lit(False).alias("random")))


def threshold(samples: DataFrame, ratios: list[float], false_positives: float = 0.001, missed: float = 0.01) -> float:
    """The highest mean ratio that misses at most the share `missed` of the random samples, but never one that more than `false_positives` of the ordinary ones exceed."""
    ratio = F.when(F.length("text") >= SHORTEST, mean_ratio(F.col("text"), ratios))
    row = samples.agg(F.percentile(F.when(~F.col("random"), ratio), 1 - false_positives), F.percentile(F.when(F.col("random"), ratio), missed)).first()
    return max(row[0] or 0.0, row[1] or 0.0, 0.0)


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, least_ratio: float | None = None) -> DataFrame:
    """doc_id, assign, access, hex, markov: the spans of each kind in each text.

    samples: (text, random), labelled strings; least_ratio: what a token must exceed instead of the threshold that they set.
    """
    samples = labelled_samples(docs.sparkSession) if samples is None else samples
    samples = C.staged(samples.select(F.col("text").cast("string").alias("text"), F.col("random").cast("boolean").alias("random")).filter("text is not null and random is not null"), "samples")
    held = F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(5)) == 0
    training = samples.filter(~held)
    ratios = trained(training.filter("random"), training.filter("not random"))
    least = threshold(samples.filter(held), ratios) if least_ratio is None else least_ratio
    found = C.staged(scanned(docs), "secrets")
    free = clear_of(F.col("tokens"), F.concat("assign", "access", "hex"))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    model = F.filter(free, lambda s: mixed(s) & (mean_ratio(s["value"], ratios) > least))
    return found.select("doc_id", "assign", "access", "hex", model.alias("markov"))


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start, then kind as listed."""
    def placed(n: int, k: str) -> Column:  # a lambda's second argument would be the index
        return F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("k"), s["end"].alias("end")))

    every = F.concat(*[placed(n, k) for n, k in enumerate(kinds)])
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.sort_array(every), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of each pattern, the digest of pattern spans, and all spans."""
    found = find_secrets(docs, **options)
    count = lambda k: F.size(k).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"), count("markov").alias("n_markov"))
