"""Queries through the whole engine: rows become Markdown files, are read, extracted and checked; SQL computes the same from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import checks, evidence, extract, graph, rename
from ..sources.corpus import World

CONFIG = {"genres": [{"path": "docs/customers/**", "kinds": ["requirement"], "quadrant": "reference"}, {"path": "docs/nations/**", "kinds": ["invariant"], "quadrant": "reference"}, {"path": "src/**", "kinds": [], "quadrant": "reference"}]}
SQL: dict[str, str] = {}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a customer, whose claim depends on its nation, or, machinery, on one that nothing declares; every third one does not link it, builders have a kind that is not permitted. A source a customer, with a marker whose form goes by its key."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, n = F.col("c_custkey"), F.concat(F.when(F.col("c_mktsegment") == "MACHINERY", "lost-").otherwise(""), F.col("c_nationkey").cast("string"))
    prose = F.when(k % 3 == 0, "Nothing.").otherwise(text("See [its nation](nation-", n, ")."))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "constraint").otherwise("requirement")
    customers = read("customer").select(text("docs/customers/", k, ".md").alias("path"), text("# Customer\n\n### [cust-", k, "] — a customer\n\n", prose, "\n\n```claim\nkind: ", kind, "\nevaluator: test\ndepends: [nation-", n, "]\n```\n").alias("text"))
    n = F.col("n_nationkey")
    nations = read("nation").select(text("docs/nations/", n, ".md").alias("path"), text("**[nation-", n, "]**: a nation\n\n```claim\nkind: invariant\nevaluator: review\n```\n").alias("text"))
    form = F.when(k % 4 == 0, "").when(k % 4 == 1, text("! :: cargo test c", k)).when(k % 4 == 2, text(" :: cargo test c", k)).otherwise(" two words")
    sources = read("customer").select(text("src/", k, ".rs").alias("path"), text("// @evidence: cust-", k, form, "\n", F.when(k % 2 == 0, "fn c() {}").otherwise("// fn c()"), "\n").alias("text"))
    return customers.unionByName(nations).unionByName(sources).select("path", F.encode("text", "UTF-8").alias("content"))


#: What a customer's claim depends on, in SQL.
TARGET = "'nation-' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'lost-' ELSE '' END || c_nationkey"

SQL["corpus_findings"] = f"""
SELECT 'C3' AS check, 'fail' AS severity, 'docs/customers/' || c_custkey || '.md' AS file, 7 AS line, 'cust-' || c_custkey AS claim_id, 'kind "constraint" is not permitted by genre "docs/customers/**" (permits [requirement])' AS message FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'C4', 'fail', 'docs/customers/' || c_custkey || '.md', 7, 'cust-' || c_custkey, 'depends target ' || {TARGET} || ' does not resolve — this claim is broken: rewire or remove the dependency' FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'C5', 'fail', 'docs/customers/' || c_custkey || '.md', 3, 'cust-' || c_custkey, '"cust-' || c_custkey || '" declares a dependence or reason with no matching prose link: ["depends:' || {TARGET} || '"]' FROM customer WHERE c_custkey % 3 = 0"""


def corpus_findings(spark, sf_dir):
    """All thirteen checks over the corpus."""
    f = files(spark, sf_dir)
    return checks.diagnostics(extract.load(f, CONFIG), evidence.markers_of(f)).select("check", "severity", "file", "line", "claim_id", "message")


SQL["corpus_index"] = f"""
SELECT 'cust-' || c_custkey AS id, 'docs/customers/' || c_custkey || '.md' AS file, 7 AS line, CASE WHEN c_mktsegment = 'BUILDING' THEN 'constraint' ELSE 'requirement' END AS kind, NULL::VARCHAR AS design, 'test' AS implementation, {TARGET} AS depends FROM customer
UNION ALL SELECT 'nation-' || n_nationkey, 'docs/nations/' || n_nationkey || '.md', 3, 'invariant', NULL, NULL, '' FROM nation"""


def corpus_index(spark, sf_dir):
    return checks.index_claims(extract.load(files(spark, sf_dir), CONFIG)).select("id", "file", "line", "kind", "design", "implementation", F.array_join("depends", ",").alias("depends"))


SQL["corpus_signals"] = """
SELECT 'cust-' || c_custkey AS id, 1 AS out_degree, 0 AS in_degree, 0 AS review_surface FROM customer
UNION ALL SELECT 'nation-' || n_nationkey, 0, count(c_custkey), count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment <> 'MACHINERY' GROUP BY n_nationkey"""


def corpus_signals(spark, sf_dir):
    """Degrees and closure sizes of every claim."""
    c = extract.load(files(spark, sf_dir), CONFIG)
    return graph.degrees(c.claims, c.edges()).select("id", "out_degree", "in_degree", "review_surface")


SQL["corpus_markers"] = "SELECT 'cust-' || c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN 'cargo test c' || c_custkey END AS command, 'src/' || c_custkey || '.rs' AS file, 1 AS line, c_custkey % 4 = 1 AS exempt FROM customer WHERE c_custkey % 4 <> 3"


def corpus_markers(spark, sf_dir):
    return evidence.markers_of(files(spark, sf_dir))


SQL["corpus_links"] = "SELECT 'docs/customers/' || c_custkey || '.md' AS file, 5 AS line, " + TARGET + " AS dest FROM customer WHERE c_custkey % 3 <> 0"


def corpus_links(spark, sf_dir):
    return extract.load(files(spark, sf_dir), CONFIG).links.select("file", "line", "dest")


SQL["corpus_literal"] = "SELECT 'src/' || c_custkey || '.rs' AS file, 2 AS line FROM customer WHERE c_custkey % 2 = 0"


def corpus_literal(spark, sf_dir):
    """Lines that hold a literal outside comments and tests."""
    return evidence.find_literal(files(spark, sf_dir), "fn c()")[0]


SQL["corpus_outcomes"] = "SELECT 'cust-' || c_custkey AS claim_id, CASE WHEN c_acctbal < 0 THEN 'fail' WHEN c_custkey % 7 = 0 THEN 'vacuous' ELSE 'pass' END AS outcome FROM customer"


def corpus_outcomes(spark, sf_dir):
    """Outcomes of claims from those of their markers, of which each has two."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    out = F.when(F.col("c_custkey") % 7 == 0, "test result: ok. 0 passed; 0 failed").otherwise("test result: ok. 3 passed; 0 failed")
    one = lambda ok: c.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("claim_id"), ok.alias("success"), out.alias("stdout"), F.lit(False).alias("exempt"))
    return evidence.fold(one(F.col("c_acctbal") >= 0).unionByName(one(F.lit(True))))


#: What a part's file holds, by p_partkey modulo 16: (path, text); {k} is the key. Each but the first makes one check tell something.
BLOCK = "```claim\nkind: requirement\nevaluator: test\n```\n"
PART = "# Part\n\n### [part-{k}] — a part\n\n"
PARTS = {
    0: ("parts", PART + "Fits [its use](part-{k}).\n\n```claim\nkind: invariant\nverification: {{design: proof, implementation: test}}\nbecause: [part-{k}]\n```\n"),
    1: ("parts", "# Part\n\n" + BLOCK),
    2: ("parts", PART + "Red.\n\n```claim\nkind: requirement\nevaluator: test\ncolour: red\n```\n"),
    3: ("parts", PART + "Plain.\n\n```claim\nkind: wish\nevaluator: test\n```\n"),
    4: ("parts", PART + "Plain.\n\n```claim\nkind: requirement\n```\n"),
    5: ("parts", PART + "First.\n\n" + BLOCK + "\n### [part-{k}] again\n\n```claim\nkind: invariant\nevaluator: model-check\n```\n"),
    6: ("parts", PART + "See [it](gone-{k}).\n\n```claim\nkind: requirement\nevaluator: test\ndepends: [gone-{k}]\n```\n"),
    7: ("parts", PART + "See [why](lost-{k}).\n\n```claim\nkind: requirement\nevaluator: test\nbecause: [lost-{k}]\n```\n"),
    8: ("parts", PART + "No link.\n\n```claim\nkind: requirement\nevaluator: test\ndepends: [part-{k}]\n```\n"),
    9: ("notes", "# Note\n\nParts MUST NOT rust, as `MUST` says.\n\n> They SHALL fit.\n"),
    10: ("parts", "# Part\n\n### [free-{k}] has no block\n\nText.\n"),
    11: ("parts", "# Part\n\n### [Part_{k}] is no id\n\nText.\n"),
    12: ("parts", "# Part\n\nSee [the output](../../build/out-{k}.md) and `/build/note-{k}.md`.\n"),
    13: ("parts", "# Part\n\n## 3.2 use my_part_{k}\n\nSee [that](nothing-{k}), [here](#use-my_part_{k}), [there](#32-use-my_part_{k}), [this](#3.2).\n"),
    14: ("parts", PART + "Uses `live_{k}`.\n\n```claim\nkind: requirement\nevaluator: absent\n```\n\n@evidence: part-{k} :: old_{k}\n@evidence: part-{k} :: live_{k}\n"),
    15: ("parts", PART + "Plain.\n\n```claim\nkind: constraint\nevaluator: review\n```\n"),
}
REGISTER = {"genres": [{"path": "docs/parts/**", "kinds": ["requirement", "invariant"], "quadrant": "reference"}, {"path": "docs/notes/**", "kinds": [], "quadrant": "explanation"}]}


def _by_key(column: str, forms: dict, at: int, key):
    """forms[key % 16][at] with {k} replaced by the key."""
    out = F.lit(None).cast("string")
    for n, form in forms.items():
        out = F.when(key % 16 == n, F.replace(F.lit(form[at].replace("{{", "{").replace("}}", "}")), F.lit("{k}"), key.cast("string"))).otherwise(out)
    return out.alias(column)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(_by_key("folder", PARTS, 0, k), _by_key("text", PARTS, 1, k), k.cast("string").alias("k"))
    return parts.select(F.concat(F.lit("docs/"), "folder", F.lit("/"), "k", F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def part_world() -> World:
    return World(ignored=lambda paths: {p for p in paths if p.startswith("build/")}, exists=lambda paths: set(paths))


def _register_sql() -> str:
    told = (
        (1, "orphan-claim", "fail", 3, False, "claim block has no preceding bracket-kebab id heading"),
        (2, "C1", "fail", 7, True, "unknown field(s): colour"),
        (3, "C1", "fail", 7, True, "field `kind` has an invalid value"),
        (4, "C1", "fail", 7, True, "missing required field(s): evaluator or verification"),
        (5, "C2", "fail", 3, True, 'id "part-{k}" is also declared at docs/parts/{k}.md:12'),
        (5, "C2", "fail", 12, True, 'id "part-{k}" is also declared at docs/parts/{k}.md:3'),
        (6, "C4", "fail", 7, True, "depends target gone-{k} does not resolve — this claim is broken: rewire or remove the dependency"),
        (7, "orphaned-because", "warn", 7, True, "because target lost-{k} does not resolve — the claim's stated reason is orphaned, not the claim itself: restate the reason, or confirm the claim was vestigial"),
        (8, "C5", "fail", 3, True, '"part-{k}" declares a dependence or reason with no matching prose link: ["depends:part-{k}"]'),
        (9, "normative-prose", "fail", 3, False, 'normative keyword "MUST NOT" in own-voice prose, but genre "docs/notes/**" permits no claim kinds'),
        (10, "unregistered-definition", "warn", 3, False, 'definition "free-{k}" has no claim block — unregistered'),
        (11, "malformed-id", "warn", 3, False, 'id "Part_{k}" is in definition position but is not valid kebab-case — rename it (a malformed id is neither claimed nor counted as unregistered)'),
        (12, "unreachable-reference", "fail", 3, False, 'link "../../build/out-{k}.md" resolves to "build/out-{k}.md", which is gitignored — unreachable for any reader who is not the author'),
        (12, "unreachable-reference", "fail", 3, False, 'link "/build/note-{k}.md" resolves to "build/note-{k}.md", which is gitignored — unreachable for any reader who is not the author'),
        (13, "dangling-reference", "warn", 5, False, 'link "nothing-{k}" does not resolve to anything in the corpus — a bare reference, not a broken claim'),
        (13, "dangling-reference", "warn", 5, False, 'link "#use-my_part_{k}" does not resolve to anything in the corpus — a bare reference, not a broken claim'),
        (14, "absent-marker-stale", "warn", 12, True, 'absence marker for "part-{k}" names "old_{k}", which no longer appears as a code span in that claim\'s own prose — stale marker, or the prose drifted'),
        (15, "C3", "fail", 7, True, 'kind "constraint" is not permitted by genre "docs/parts/**" (permits [requirement, invariant])'),
    )
    one = "SELECT '{c}' AS check, '{s}' AS severity, 'docs/{f}/' || p_partkey || '.md' AS file, {l} AS line, {i} AS claim_id, replace('{m}', '{{k}}', p_partkey::VARCHAR) AS message FROM part WHERE p_partkey % 16 = {v}"
    return " UNION ALL ".join(one.format(c=c, s=s, f=PARTS[v][0], l=l, i="'part-' || p_partkey" if has_id else "NULL::VARCHAR", m=m.replace("'", "''"), v=v) for v, c, s, l, has_id, m in told)


SQL["register_findings"] = _register_sql()


def register_findings(spark, sf_dir):
    """Each of the thirteen checks over files that break it, with its messages."""
    f = part_files(spark, sf_dir)
    return checks.diagnostics(extract.load(f, REGISTER, part_world()), evidence.markers_of(f)).select("check", "severity", "file", "line", "claim_id", "message")


SQL["register_order"] = f"""
WITH c(name, n) AS (VALUES ('orphan-claim', 0), ('C1', 1), ('C2', 2), ('C3', 3), ('C4', 4), ('orphaned-because', 5), ('C5', 6), ('normative-prose', 7), ('unregistered-definition', 8), ('malformed-id', 9), ('unreachable-reference', 10), ('dangling-reference', 11), ('absent-marker-stale', 12))
SELECT row_number() OVER (ORDER BY n, string_split(file, '/'), CASE WHEN message LIKE 'link "/%' THEN 1 ELSE 0 END, line, strpos(message, 'use-my')) AS place, c.name AS check, file, line, message FROM ({_register_sql()}) f JOIN c ON c.name = f.check"""


def register_order(spark, sf_dir):
    """The findings in the order in which they are told."""
    f = part_files(spark, sf_dir)
    found = checks.diagnostics(extract.load(f, REGISTER, part_world()), evidence.markers_of(f))
    return found.select(F.row_number().over(Window.orderBy("sort_key", "message")).alias("place"), "check", "file", "line", "message")


SQL["register_index"] = """
SELECT 'part-' || p_partkey AS id, 'docs/parts/' || p_partkey || '.md' AS file, CASE WHEN v = 5 THEN 14 ELSE 7 END AS line,
CASE WHEN v IN (0, 5) THEN 'invariant' WHEN v = 3 THEN 'wish' WHEN v = 15 THEN 'constraint' ELSE 'requirement' END AS kind,
CASE WHEN v IN (0, 4) THEN '' WHEN v = 5 THEN 'model-check' WHEN v = 14 THEN 'absent' WHEN v = 15 THEN 'review' ELSE 'test' END AS evaluator,
CASE WHEN v = 0 THEN 'proof' WHEN v = 5 THEN 'model-check' END AS design, CASE WHEN v IN (0, 2, 3, 6, 7, 8) THEN 'test' WHEN v = 14 THEN 'absent' END AS implementation
FROM (SELECT p_partkey, p_partkey % 16 AS v FROM part) WHERE v NOT IN (1, 9, 10, 11, 12, 13)"""


def register_index(spark, sf_dir):
    """The index: the last block of an id, and what its verification or evaluator stands for."""
    return checks.index_claims(extract.load(part_files(spark, sf_dir), REGISTER, part_world())).select("id", "file", "line", "kind", "evaluator", "design", "implementation")


SQL["register_documents"] = "SELECT 'docs/' || CASE WHEN p_partkey % 16 = 9 THEN 'notes' ELSE 'parts' END || '/' || p_partkey AS doc_path, 'docs/' || CASE WHEN p_partkey % 16 = 9 THEN 'notes' ELSE 'parts' END || '/' || p_partkey || '.md' AS file, 'docs/' || CASE WHEN p_partkey % 16 = 9 THEN 'notes' ELSE 'parts' END || '/**' AS genre FROM part"


def register_documents(spark, sf_dir):
    return checks.index_documents(extract.load(part_files(spark, sf_dir), REGISTER, part_world()))


#: A file with one of each construct; {k} is a supplier's key. Facts: (row, line, text or id).
FACTS_TEXT = """# use my_func_{k} *now* &amp; `then`
<!-- note -->
### [sup-{k}] heading claim

Plain **bold** MUST [one](a{k}.md) ![no](img{k}.png) <https://x.org/{k}>.
**[bold-{k}] **: not whole
**[mark-{k}]** (an aside): bold claim SHOULD NOT

```claim
kind: requirement
```
<pre>

# not a heading {k}
</pre>

<a id="html-{k}"></a>
-\t#### item `code {k}` MAY
> ## quoted {k}
> MUST stay silent

[ref{k}]:
  /target{k}
  'title'

[ref{k}] and [Ref{k}][] and [no](mailto:a@b.c) `x [y](z)` OPTIONAL

<a id="near-{k}"></a>

use my_func_{k} *now* &amp; `then`
===
"""
FACTS = (
    ("heading", 1, "use my_func_{k} now & then", "use-my_func_{k}-now--then"),
    ("heading", 3, "[sup-{k}] heading claim", "sup-{k}-heading-claim"),
    ("heading", 18, "item code {k} MAY", "item-code-{k}-may"),
    ("heading", 19, "quoted {k}", "quoted-{k}"),
    ("heading", 30, "use my_func_{k} now & then", "use-my_func_{k}-now--then-1"),
    ("normative", 5, "MUST", None),
    ("normative", 7, "SHOULD NOT", None),
    ("normative", 18, "MAY", None),
    ("normative", 26, "OPTIONAL", None),
    ("link", 5, "a{k}.md", None),
    ("link", 5, "https://x.org/{k}", None),
    ("link", 26, "/target{k}", None),
    ("link", 26, "/target{k}", None),
    ("link", 26, "mailto:a@b.c", None),
    ("code", 1, "then", None),
    ("code", 18, "code {k}", None),
    ("code", 26, "x [y](z)", None),
    ("code", 30, "then", None),
    ("claim", 7, "mark-{k}", None),
    ("unregistered", 3, "sup-{k}", None),
    ("unregistered", 17, "html-{k}", None),
    ("unregistered", 30, "near-{k}", None),
)
SQL["markdown_facts"] = " UNION ALL ".join("SELECT 'docs/' || s_suppkey || '.md' AS file, '{}' AS row, {} AS line, replace('{}', '{{k}}', s_suppkey::VARCHAR) AS text, {} AS slug FROM supplier".format(r, l, t, f"replace('{g}', '{{k}}', s_suppkey::VARCHAR)" if g else "NULL::VARCHAR") for r, l, t, g in FACTS)


def markdown_facts(spark, sf_dir):
    """What the Markdown reader and the extraction find in a file of many constructs."""
    k = F.col("s_suppkey").cast("string")
    f = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("docs/"), k, F.lit(".md")).alias("path"), F.encode(F.replace(F.lit(FACTS_TEXT), F.lit("{k}"), k), "UTF-8").alias("content"))
    rows = extract.extracted(f)
    return rows.select("file", "row", "line", F.coalesce("id", "text").alias("text"), "slug")


SQL["run_outcomes"] = """
SELECT 'part-' || p_partkey AS claim_id, CASE WHEN v = 15 THEN 'review' WHEN v = 14 THEN CASE WHEN p_size % 2 = 0 THEN 'fail' ELSE 'pass' END WHEN p_size % 5 = 0 THEN 'absent' WHEN p_size % 5 = 1 THEN 'fail' WHEN p_size % 5 = 2 THEN 'vacuous' ELSE 'pass' END AS outcome
FROM (SELECT *, p_partkey % 16 AS v FROM part) WHERE v NOT IN (1, 9, 10, 11, 12, 13)"""


def run_outcomes(spark, sf_dir):
    """Outcomes of all claims, given what their markers' commands came to: sizes divisible by 5 have no marker, the others two."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") % 16).alias("v"), F.col("p_size").alias("s"))
    claims = extract.load(part_files(spark, sf_dir), REGISTER, part_world()).claims
    size = F.col("s") % 5
    both = part.filter(~((F.col("v") != 14) & (size == 0))).withColumn("line", F.explode(F.array(F.lit(1), F.lit(2))))
    markers = both.select("id", F.lit("cargo test").alias("command"), F.concat(F.lit("src/"), "id").alias("file"), "line", ((size == 3) | (F.col("v") == 14)).alias("exempt"))
    ok = F.when(F.col("v") == 14, (F.col("s") % 2 == 1) | (F.col("line") == 2)).otherwise((size != 1) | (F.col("line") == 2))
    out = F.when(F.col("line") == 2, "3 passed; 0 failed").when(size.isin(2, 3), "test result: ok. 0 passed; 0 failed").otherwise("test result: ok. 3 passed; 0 failed")
    results = both.select(F.concat(F.lit("src/"), "id").alias("file"), "line", ok.alias("success"), out.alias("stdout"))
    return evidence.outcomes(claims, markers, results)


SQL["rename_sites"] = f"""
WITH t AS (SELECT c_custkey, {TARGET} AS old, '# Customer' || chr(10) || chr(10) || '### [cust-' || c_custkey || '] — a customer' || chr(10) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'Nothing.' ELSE 'See [its nation](' || {TARGET} || ').' END || chr(10) || chr(10) || '```claim' || chr(10) || 'kind: ' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'constraint' ELSE 'requirement' END || chr(10) || 'evaluator: test' || chr(10) || 'depends: [' || {TARGET} || ']' AS text FROM customer)
SELECT 'docs/customers/' || c_custkey || '.md' AS file, 'link' AS kind, (strpos(text, '](') + 1)::INTEGER AS start, (strpos(text, '](') + 1 + len(old))::INTEGER AS "end" FROM t WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'docs/customers/' || c_custkey || '.md', 'depends', (strpos(text, 'depends: [') + 9)::INTEGER, (strpos(text, 'depends: [') + 9 + len(old))::INTEGER FROM t
UNION ALL SELECT 'docs/nations/' || n_nationkey || '.md', 'definition', 3, 3 + len('nation-' || n_nationkey) FROM nation"""


def rename_sites(spark, sf_dir):
    """Where each file names its nation."""
    f = files(spark, sf_dir).filter(F.col("path").startswith("docs/"))
    old = F.regexp_extract(F.col("content").cast("string"), "(?:depends: \\[|\\A\\*\\*\\[)(nation-[a-z0-9-]+)", 1)
    return rename.sites_of(f.withColumn("old", old)).select("file", "kind", "start", "end")


SQL["rename_totals"] = """
SELECT count(*) AS files, sum(edits)::BIGINT AS edits FROM (SELECT 1 + CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS edits FROM customer WHERE c_nationkey = 3 AND c_mktsegment <> 'MACHINERY' UNION ALL SELECT 1)"""


def rename_totals(spark, sf_dir):
    """A rename of one nation, proved by reading the result again: files and edits."""
    # evidence names customers, not nations, so no marker refuses
    changes = rename.plan_rename(files(spark, sf_dir), CONFIG, "nation-3", "nation-three")
    return spark.createDataFrame([rename.totals(changes)], "files long, edits long")


SQL["blast_order"] = """
WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation WHERE n_regionkey = 1),
m AS (SELECT 'nation-' || n_nationkey AS member, n_nationkey AS a, -1 AS b FROM n UNION ALL SELECT 'cust-' || c_custkey, c_nationkey, c_custkey FROM customer JOIN n ON n_nationkey = c_nationkey)
SELECT row_number() OVER (ORDER BY a, b) - 1 AS place, member, false AS cycle FROM m
UNION ALL SELECT -1, 'region-1', true"""


def blast_order(spark, sf_dir):
    """What cites a region, in order of discovery, depth first; the region cites its first nation, which closes a cycle."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    nations = read("nation").select(F.lit(0).alias("o"), F.col("n_nationkey").alias("k"), name("nation", "n_nationkey").alias("source"), name("region", "n_regionkey").alias("key"))
    customers = read("customer").select(F.lit(1).alias("o"), F.col("c_custkey").alias("k"), name("cust", "c_custkey").alias("source"), name("nation", "c_nationkey").alias("key"))
    first = read("nation").filter("n_regionkey = 1").agg(F.min("n_nationkey").alias("n")).select(F.lit(2).alias("o"), F.lit(0).cast("long").alias("k"), F.lit("region-1").alias("source"), name("nation", "n").alias("key"))
    rows = nations.unionByName(customers).unionByName(first).orderBy("o", "k").collect()
    members, cycles = graph.walk([(r.source, r.key) for r in rows], "region-1")
    return spark.createDataFrame([(n, m, False) for n, m in enumerate(members)] + [(-1, c, True) for c, _ in cycles], "place long, member string, cycle boolean")


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
