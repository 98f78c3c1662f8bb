"""The register: thirteen checks over a corpus, and its index. Every check is a DataFrame of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs
from .extract import Corpus
from .graph import cut

FIELDS = ("kind", "evaluator", "verification", "depends", "because")
KINDS = ("requirement", "invariant", "constraint")
EVALUATORS = ("proof", "model-check", "type", "property-test", "test", "example", "absent", "review", "none")
AXES = ("design", "implementation")
#: The axis that an evaluator alone stands for.
DESIGN = ("model-check",)
IMPLEMENTATION = ("type", "property-test", "test", "example", "none", "absent")


def quoted(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def findings(rows: DataFrame, check: str, severity: str, line: str, message: Column, claim_id: str | None = None, position: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        "file",
        F.col(line).cast("int").alias("line"),
        (F.col(claim_id) if claim_id else F.lit(None).cast("string")).alias("claim_id"),
        message.alias("message"),
        F.col("ordinal").alias("ordinal"),
        (position if position is not None else F.lit(0)).alias("position"),
    )


def orphan_claim(c: Corpus, **_) -> DataFrame:
    return findings(c.orphans, "orphan-claim", "fail", "line", F.lit("claim block has no preceding bracket-kebab id heading"))


def _has(name: str) -> Column:
    return F.map_contains_key(F.coalesce("types", F.create_map().cast("map<string,string>")), F.lit(name))


def _listed(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ", ")


def schema_problem() -> Column:
    """The first thing wrong with a claim block, or null."""
    unknown = F.filter(F.map_keys("types"), lambda k: ~k.isin(*FIELDS))
    stray = F.filter(F.map_keys("axis_types"), lambda k: ~k.isin(*AXES))
    bad = lambda name: F.lit(f"field `{name}` has an invalid value")
    array = lambda name: F.when(_has(name) & ~(F.coalesce(F.col("strings")[name], F.lit(False)) & F.forall(name, refs.is_reference)), F.lit(f"field `{name}` must be an array of claim ids or doc#anchor refs"))
    axis = lambda name: F.when(F.map_contains_key("axis_types", F.lit(name)) & ~F.coalesce(F.col("axes")[name].isin(*EVALUATORS), F.lit(False)), bad(f"verification.{name}"))
    verification = F.when(
        _has("verification"),
        F.coalesce(
            F.when(F.col("types")["verification"] != "map", F.lit("field `verification` must be a mapping")),
            F.when(F.size(F.map_keys("axis_types")) == 0, F.lit("field `verification` is empty")),
            F.when(F.size(stray) > 0, quoted("verification field(s) not permitted: ", _listed(stray), " (only `design`/`implementation`)")),
            *[axis(a) for a in AXES],
        ),
    )
    return F.coalesce(
        F.when(F.col("yaml_error").isNotNull(), quoted("invalid YAML: ", F.col("yaml_error"))),
        F.when(F.col("types").isNull(), F.lit("claim block is not a YAML mapping")),
        F.when(F.size(unknown) > 0, quoted("unknown field(s): ", _listed(unknown))),
        F.when(~_has("kind"), F.lit("missing required field(s): kind")),
        F.when(_has("evaluator") & _has("verification"), F.lit("fields `evaluator` and `verification` are mutually exclusive — one statement, one place")),
        F.when(~_has("evaluator") & ~_has("verification"), F.lit("missing required field(s): evaluator or verification")),
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), bad("kind")),
        F.when(_has("evaluator") & ~F.coalesce(F.col("evaluator").isin(*EVALUATORS), F.lit(False)), bad("evaluator")),
        verification,
        array("depends"),
        array("because"),
    )


def c1(c: Corpus, **_) -> DataFrame:
    return findings(c.claims.withColumn("problem", schema_problem()).filter("problem is not null"), "C1", "fail", "block_line", F.col("problem"), "id")


def c2(c: Corpus, **_) -> DataFrame:
    """Ids that are declared elsewhere as well: all other places, in order."""
    places = c.claims.groupBy("id").agg(F.collect_set(F.struct(F.split("file", "/").alias("parts"), "ordinal", "file", F.col("heading_line").alias("line"))).alias("places"))
    own = c.claims.join(places, "id").withColumn("others", F.array_distinct(F.transform(F.filter(F.array_sort("places"), lambda p: (p["file"] != F.col("file")) | (p["line"] != F.col("heading_line"))), lambda p: F.concat_ws(":", p["file"], p["line"]))))
    return findings(own.filter(F.size("others") > 0), "C2", "fail", "heading_line", quoted('id "', F.col("id"), '" is also declared at ', F.array_join("others", ", ")), "id")


def c3(c: Corpus, **_) -> DataFrame:
    rows = c.claims.filter(F.col("kind").isin(*KINDS)).join(c.documents.select("file", "genre_path", "kinds"), "file").filter(~F.array_contains("kinds", F.col("kind")))
    return findings(rows, "C3", "fail", "block_line", quoted('kind "', F.col("kind"), '" is not permitted by genre "', F.col("genre_path"), '" (permits [', F.array_join("kinds", ", "), "])"), "id")


def _declared(c: Corpus, name: str) -> DataFrame:
    return c.claims.select("id", "file", "ordinal", "heading_line", "block_line", F.posexplode(name).alias("position", "target"))


def unresolved(c: Corpus, declared: DataFrame, slugs: bool = False) -> DataFrame:
    """declared without the rows whose target is a claim, or an anchor that a heading has.

    The heading join is on the document; the prefix test is its residue.
    """
    rest = declared.join(c.claims.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
    rest = rest.withColumns({"doc_path": F.substring_index("target", "#", 1), "anchor": F.when(F.instr("target", "#") > 0, F.col("target").substr(F.instr("target", "#") + 1, F.length("target")))})
    h = c.headings.select(F.col("doc_path").alias("h_doc"), F.col("text").alias("h_text"), F.col("slug").alias("h_slug"))
    hit = refs.heading_has_anchor(F.col("h_text"), F.col("anchor"))
    if slugs:
        hit = hit | (F.col("h_slug") == F.col("anchor"))
    return rest.join(h, (F.col("doc_path") == F.col("h_doc")) & F.col("anchor").isNotNull() & hit, "left_anti")


def c4(c: Corpus, **_) -> DataFrame:
    return findings(unresolved(c, _declared(c, "depends")), "C4", "fail", "block_line", quoted("depends target ", F.col("target"), " does not resolve — this claim is broken: rewire or remove the dependency"), "id", F.col("position"))


def orphaned_because(c: Corpus, **_) -> DataFrame:
    return findings(unresolved(c, _declared(c, "because")), "orphaned-because", "warn", "block_line", quoted("because target ", F.col("target"), " does not resolve — the claim's stated reason is orphaned, not the claim itself: restate the reason, or confirm the claim was vestigial"), "id", F.col("position"))


def _line_of(c: Corpus, keys: DataFrame) -> DataFrame:
    """keys (key: path#anchor) with numeric_line, of the first heading that has the anchor, and slug_line, of the first of that slug."""
    at = keys.select("key", F.substring_index("key", "#", 1).alias("doc_path"), F.expr("substring(key, instr(key, '#') + 1)").alias("anchor")).filter("instr(key, '#') > 0").distinct()
    h = c.headings.select("doc_path", "text", "slug", F.col("line").alias("h_line"))
    both = at.join(h, "doc_path")
    return both.groupBy("key").agg(F.min(F.when(refs.heading_has_anchor(F.col("text"), F.col("anchor")), F.col("h_line"))).alias("numeric_line"), F.min(F.when(F.col("slug") == F.col("anchor"), F.col("h_line"))).alias("slug_line"))


def c5(c: Corpus, **_) -> DataFrame:
    """Claims that declare what their prose does not link: by the same reference, an anchor named like the id, or the same heading."""
    declared = _declared(c, "depends").withColumn("which", F.lit(0)).unionByName(_declared(c, "because").withColumn("which", F.lit(1)))
    links = c.claims.select("file", "ordinal", F.explode("prose_links").alias("href")).withColumn("link", refs.link_target(F.col("file"), F.col("href"))).filter(F.col("link").isNotNull() & refs.is_ref_shaped(F.col("link"))).select("file", "ordinal", "link").distinct()
    lines = cut(_line_of(c, declared.select(F.col("target").alias("key")).unionByName(links.select(F.col("link").alias("key")))))
    side = lambda rows, key, mark: rows.join(lines.select(F.col("key").alias(key), F.col("numeric_line").alias(f"{mark}_n"), F.col("slug_line").alias(f"{mark}_s")), key, "left")
    d, l = side(declared, "target", "d"), side(links, "link", "l")
    path = lambda c: F.substring_index(c, "#", 1)
    anchored = (F.instr("target", "#") > 0) & (F.instr("link", "#") > 0) & (path("target") == path("link")) & ((F.col("d_n") == F.col("l_s")) | (F.col("d_s") == F.col("l_n")) | (F.col("d_n") == F.col("l_n")) | (F.col("d_s") == F.col("l_s")))
    named = (F.instr("target", "#") == 0) & (F.instr("link", "#") > 0) & (F.expr("substring(link, instr(link, '#') + 1)") == F.col("target"))
    links_of = l.withColumnsRenamed({"file": "l_file", "ordinal": "l_ordinal"})
    rest = d.join(links_of, (F.col("file") == F.col("l_file")) & (F.col("ordinal") == F.col("l_ordinal")) & ((F.col("target") == F.col("link")) | named | anchored), "left_anti")
    entry = F.struct("which", "position", F.concat(F.when(F.col("which") == 0, "depends:").otherwise("because:"), F.col("target")).alias("text"))
    grouped = rest.groupBy("id", "file", "ordinal", "heading_line").agg(F.array_sort(F.collect_list(entry)).alias("missing"))
    names = F.array_join(F.transform("missing", lambda m: quoted('"', m["text"], '"')), ", ")
    return findings(grouped, "C5", "fail", "heading_line", quoted('"', F.col("id"), '" declares a dependence or reason with no matching prose link: [', names, "]"), "id")


def normative_prose(c: Corpus, **_) -> DataFrame:
    rows = c.normative.join(c.documents.filter(F.size("kinds") == 0).select("file", "genre_path"), "file")
    return findings(rows, "normative-prose", "fail", "line", quoted('normative keyword "', F.col("keyword"), '" in own-voice prose, but genre "', F.col("genre_path"), '" permits no claim kinds'))


def unregistered_definition(c: Corpus, **_) -> DataFrame:
    return findings(c.unregistered, "unregistered-definition", "warn", "line", quoted('definition "', F.col("id"), '" has no claim block — unregistered'))


def malformed_id(c: Corpus, **_) -> DataFrame:
    return findings(c.malformed, "malformed-id", "warn", "line", quoted('id "', F.col("id"), '" is in definition position but is not valid kebab-case — rename it (a malformed id is neither claimed nor counted as unregistered)'))


def unreachable_reference(c: Corpus, **_) -> DataFrame:
    return findings(c.unreachable, "unreachable-reference", "fail", "line", quoted('link "', F.col("dest"), '" resolves to "', F.col("resolved"), '", which is gitignored — unreachable for any reader who is not the author'))


def dangling_reference(c: Corpus, **_) -> DataFrame:
    """Links that mean a reference which nothing has, unless they are unreachable anyway or declared by a claim."""
    rows = c.links.join(c.unreachable.select("file", "line", "dest"), ["file", "line", "dest"], "left_anti").withColumn("target", refs.link_target(F.col("file"), F.col("dest"))).filter(F.col("target").isNotNull() & refs.is_ref_shaped(F.col("target")))
    every = c.claims.select(F.explode(F.concat("depends", "because")).alias("target")).distinct()
    rest = unresolved(c, rows.join(every, "target", "left_anti"), slugs=True)
    # path#id, where the id is a claim's
    ids = c.claims.select(F.col("id").alias("anchor")).distinct()
    rest = rest.join(ids, "anchor", "left_anti")
    return findings(rest, "dangling-reference", "warn", "line", quoted('link "', F.col("dest"), '" does not resolve to anything in the corpus — a bare reference, not a broken claim'))


def absent_marker_stale(c: Corpus, markers: DataFrame | None = None, **_) -> DataFrame:
    """Markers whose literal is no code span any more of the absent-graded claim of that id in their file."""
    if markers is None:
        markers = c.files.sparkSession.createDataFrame([], "id string, command string, file string, line int, exempt boolean")
    absent = c.claims.filter("evaluator = 'absent'").select("id", "file", "prose_code", "ordinal")
    rows = markers.filter("command is not null").join(absent, ["id", "file"]).filter(~F.array_contains("prose_code", F.col("command")))
    return findings(rows, "absent-marker-stale", "warn", "line", quoted('absence marker for "', F.col("id"), '" names "', F.col("command"), '", which no longer appears as a code span in that claim\'s own prose — stale marker, or the prose drifted'), "id")


#: The checks in the order in which findings are told.
CHECKS: dict[str, Callable[..., DataFrame]] = {
    "orphan-claim": orphan_claim,
    "C1": c1,
    "C2": c2,
    "C3": c3,
    "C4": c4,
    "orphaned-because": orphaned_because,
    "C5": c5,
    "normative-prose": normative_prose,
    "unregistered-definition": unregistered_definition,
    "malformed-id": malformed_id,
    "unreachable-reference": unreachable_reference,
    "dangling-reference": dangling_reference,
    "absent-marker-stale": absent_marker_stale,
}


def diagnostics(corpus: Corpus, markers: DataFrame | None = None, checks: dict[str, Callable[..., DataFrame]] = CHECKS) -> DataFrame:
    """check, severity, file, line, claim_id, message of every finding; sort_key orders them."""
    out = None
    for n, check in enumerate(checks.values()):
        rows = check(corpus, markers=markers).withColumn("sort_key", F.struct(F.lit(n).alias("check"), F.split("file", "/").alias("parts"), "ordinal", "line", "position"))
        out = rows if out is None else out.unionByName(rows)
    return out.drop("ordinal", "position")


def told(found: DataFrame) -> DataFrame:
    """Findings in order, without the key."""
    return found.orderBy("sort_key", "message").drop("sort_key")


def passed(found: DataFrame) -> bool:
    return found.filter("severity = 'fail'").isEmpty()


def axes() -> dict[str, Column]:
    """design and implementation: what verification says, or what the evaluator alone stands for."""
    mapped = F.col("types")["verification"] == "map"
    given = lambda a: F.col("axes")[a]
    legacy = lambda names: F.when(F.col("evaluator").isin(*names), F.col("evaluator"))
    return {"design": F.when(mapped, given("design")).otherwise(legacy(DESIGN)), "implementation": F.when(mapped, given("implementation")).otherwise(legacy(IMPLEMENTATION))}


def index_claims(c: Corpus) -> DataFrame:
    """One row an id; of several blocks the last one."""
    rows = c.claims.withColumns(axes()).select("id", "file", F.col("block_line").alias("line"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("evaluator", F.lit("")).alias("evaluator"), "design", "implementation", "depends", "because", F.struct(F.split("file", "/").alias("parts"), "ordinal").alias("at"))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[x for x in rows.columns if x not in ("id", "at")]), "at").alias("x"))
    return last.select("id", "x.*")


def index_documents(c: Corpus) -> DataFrame:
    return c.documents.select("doc_path", "file", F.col("genre_path").alias("genre"))


def legacy_ambiguous(c: Corpus) -> DataFrame:
    return c.claims.filter(F.col("evaluator").isin("review", "proof")).select("id", "file", F.col("block_line").alias("line"), "evaluator")
