"""Quality rules with risk-controlled cutoffs, in DataFrame operations alone.

Rules reject texts whose statistic exceeds a cutoff. Cutoffs are not chosen by hand. In each
stratum (band of text length) the labelled texts that pass the base are dealt by a hash of
doc_id into a planning and a holdout part:

1. Planning orders the steps, a step being a rule with a cutoff of a fixed grid. Steps that
   reject no text of bad quality beyond the rule's looser cutoff are left out, as are those
   that reject more than alpha / 5 of the good ones; the others go by the good texts they
   reject, loose cutoffs first, then by the bad texts they reject.
2. The holdout tests the steps in that order: step j asks whether rules 1 to j together
   reject too much. k of the n good holdouts are rejected; the step is certified when the
   exact binomial (Clopper-Pearson) upper bound of the false rejection rate is at most alpha,
   i.e. when P(Bin(n, alpha) <= k) <= delta / strata. Testing ends at the first step that
   is not certified, so that a stratum spends its level once, however many steps it has
   (fixed-sequence testing; the strata share delta by Bonferroni).

With probability 1 - delta, no stratum loses more than alpha of its good texts to the rules
taken together. A stratum whose holdout is too small to certify anything keeps the base alone.

Words are runs of characters other than 0x20 and 0x09-0x0D. One scan computes the
statistics, which are written (ten numbers a row); labels meet those, not the texts.

Defined cases: null texts have no words and fail the base; labels of null or unknown ids
play no part; several labels of one id count once, the worst one; rows of one doc_id are
judged each, and count each where labelled; ties between steps go to the rule listed first;
very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Upper ends of the bands of n_words; what lies above is the last band.
BANDS = (50, 200, 1000)
#: rule: (statistic, cutoffs from strict to loose)
RULES = {
    "symbols": ("try_divide(n_symbols, word_chars)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("try_divide(n_repeat_words, n_words)", (0.02, 0.05, 0.08, 0.12, 0.16, 0.19)),
    "upper": ("try_divide(n_upper, word_chars)", (0.1, 0.15, 0.2, 0.3, 0.4, 0.6)),
    "long_words": ("try_divide(word_chars, n_words)", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
    "bangs": ("try_divide(n_bangs, n_words)", (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
}


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and the statistics of each text; with carry, all columns of docs as well (see common.carried)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [f"`{C.CARRIED}{c}`" for c in docs.columns] if carry else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(C.carried(docs) if carry else []), t.alias("_t"))
    long = lambda c: c.cast("long")
    df = df.select(
        "doc_id",
        *more,
        F.array_remove(F.split("_t", BLANKS), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda l: l.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"),
        long(_without(F.col("_t"), " \t\n\x0b\x0c\r")).alias("word_chars"),
        long(F.length("_t") - _without(F.col("_t"), "#*$%&|<>")).alias("n_symbols"),
        long(F.length("_t") - _without(F.col("_t"), "!")).alias("n_bangs"),
        long(F.length("_t") - F.length(F.regexp_replace("_t", "\\p{Lu}+", ""))).alias("n_upper"),
    )
    # a window's hash by the number of its first word
    grams = F.when(F.size("_w") >= 5, F.transform(F.sequence(F.lit(1), F.size("_w") - 4), lambda i: F.xxhash64(*[F.element_at("_w", i + j) for j in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({"n_words": long(F.size("_w")), "n_lines": long(F.size("_l")), "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))), "_g": grams}).drop("_w", "_l")
    # most texts have no window twice; the others sort theirs
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    at = lambda j: F.get("_s", j)["h"]
    found = F.filter(F.transform("_s", lambda x, j: F.when((at(j - 1) == x["h"]) | (at(j + 1) == x["h"]), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_f", F.sort_array(found)).drop("_s")
    covered = F.aggregate(F.transform("_f", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_f", j + 1) - p, F.lit(5))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_f")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(len(BANDS))
    for i, end in reversed(list(enumerate(BANDS))):
        out = F.when(F.col("n_words") < end, i).otherwise(out)
    return out


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), exactly up to rounding: terms are carried as logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), k), lambda j: j > 0), F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"])


STEPS = [(r, level, c) for r, (_, cuts) in RULES.items() for level, c in enumerate(reversed(cuts))]  # loose first


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows that pass the base: good (boolean), stratum, holdout (two of three, by a hash), and the statistics."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = stats.filter(~base_failed()).join(marks, "doc_id")
    return held.withColumns({"stratum": stratum(), "holdout": F.pmod(F.xxhash64(F.lit("holdout"), F.col("doc_id")), F.lit(3)) != 0})


def planned_steps(held: DataFrame, alpha: float) -> DataFrame:
    """(stratum, step, place): the steps worth testing in each stratum, numbered from 1 in order of testing."""
    over = [F.coalesce(F.expr(RULES[r][0]) > c, F.lit(False)) for r, _, c in STEPS]
    count = lambda hit: F.sum(hit.cast("long"))
    counts = held.filter("not holdout").groupBy("stratum").agg(count(F.col("good")).alias("n"), *[count(F.col("good") & o).alias(f"g{i}") for i, o in enumerate(over)], *[count(~F.col("good") & o).alias(f"b{i}") for i, o in enumerate(over)])
    # what a step adds to the looser one of its rule
    rows = [F.struct(F.lit(i).alias("step"), F.lit(level).alias("level"), F.col(f"g{i}").alias("g"), (F.col(f"b{i}") - (F.col(f"b{i - 1}") if level else F.lit(0))).alias("gain")) for i, (_, level, _) in enumerate(STEPS)]
    steps = counts.select("stratum", "n", F.explode(F.array(*rows)).alias("x")).select("stratum", "n", "x.*").filter((F.col("gain") > 0) & (F.col("g") <= alpha / 5 * F.col("n")))
    return steps.select("stratum", "step", F.row_number().over(Window.partitionBy("stratum").orderBy("g", "level", F.desc("gain"), "step")).alias("place"))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict[tuple[int, str], float]:
    """(stratum, rule): the strictest cutoff certified on the labelled texts of good quality."""
    held = labelled(stats, labels)
    planned = C.staged(planned_steps(held, alpha), "steps")  # at most strata x steps rows
    chains = F.broadcast(planned.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("step", "place"))).alias("places")))
    hits = [F.when(F.expr(RULES[r][0]) > c, F.col("places")[i]) for i, (r, _, c) in enumerate(STEPS)]
    # a text counts where the first step of the chain rejects it; place null: none does
    first = held.filter("holdout and good").join(chains, "stratum").groupBy("stratum", F.array_min(F.array(*hits)).alias("place")).agg(F.count("*").alias("k"))
    sizes = first.groupBy("stratum").agg(F.sum("k").alias("n"))
    chain = planned.join(sizes, "stratum").join(first, ["stratum", "place"], "left")
    upto = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    chain = chain.withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(upto))
    sure = F.when(F.col("k") < alpha * F.col("n"), log_binomial_cdf(F.col("k"), F.col("n"), alpha) <= F.log(F.lit(delta / (len(BANDS) + 1)))).otherwise(False)
    chain = chain.withColumn("sure", F.min(sure).over(upto)).filter("sure")
    out: dict[tuple[int, str], float] = {}
    for row in chain.collect():  # at most strata x steps rows
        rule, _, cutoff = STEPS[row.step]
        out[row.stratum, rule] = min(cutoff, out.get((row.stratum, rule), cutoff))
    return out


def judged(stats: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """stats with base_failed, failed_rules (names) and kept."""
    failed = [F.when((stratum() == s) & (F.expr(RULES[r][0]) > c), r) for (s, r), c in sorted(cutoffs.items())]
    df = stats.withColumns({"base_failed": base_failed(), "failed_rules": F.array_compact(F.array(*failed)).cast("array<string>") if failed else F.array().cast("array<string>")})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row a document: statistics, base_failed, failed_rules, kept."""
    stats = C.staged(statistics(docs), "statistics")
    return judged(stats, certified_cutoffs(stats, labels, alpha, delta))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    stats = C.staged(statistics(docs, carry=True), "statistics")
    return judged(stats, certified_cutoffs(stats, labels, alpha, delta)).filter("kept").select(*C.given_back(docs.columns))
