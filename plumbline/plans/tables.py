"""The engine's operator shapes over the supplied tables, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import refs
from ..operators import graph

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL["dup_ids"] = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def dup_ids(spark, sf_dir):
    """Ids declared more than once."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


SQL["dup_texts"] = "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1"


def dup_texts(spark, sf_dir):
    """Texts of several documents; the digest, not the text, is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "n")


SQL["genre_forbids"] = """
WITH rules(r_name, permits) AS (VALUES ('AFRICA', ['BUILDING', 'MACHINERY']), ('ASIA', ['AUTOMOBILE']), ('EUROPE', []::VARCHAR[]))
SELECT c_custkey, r.r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey
JOIN rules u ON r.r_name = u.r_name WHERE NOT list_contains(permits, c_mktsegment)"""


def genre_forbids(spark, sf_dir):
    """Rows of a kind that their genre does not permit: two lookups and an array membership."""
    rules = spark.createDataFrame([("AFRICA", ["BUILDING", "MACHINERY"]), ("ASIA", ["AUTOMOBILE"]), ("EUROPE", [])], "r_name string, permits array<string>")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").join(F.broadcast(rules), "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.filter(~F.array_contains("permits", F.col("c_mktsegment"))).select("c_custkey", "r_name", "c_mktsegment")


SQL["dangling_depends"] = "SELECT o_orderkey, 'depends target cust-' || o_custkey || ' does not resolve' AS message FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)"


def dangling_depends(spark, sf_dir):
    """References whose target is gone."""
    there = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    gone = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(there, "o_custkey", "left_anti")
    return gone.select("o_orderkey", F.concat(F.lit("depends target cust-"), F.col("o_custkey").cast("string"), F.lit(" does not resolve")).alias("message"))


SQL["orphaned_because"] = "SELECT l_orderkey, l_linenumber, l_partkey, 'warn' AS severity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)"


def orphaned_because(spark, sf_dir):
    there = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    gone = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(there, "l_partkey", "left_anti")
    return gone.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("warn").alias("severity"))


SQL["declared_subset"] = """
WITH d AS (SELECT l_orderkey AS o_orderkey, l_partkey, bool_or(l_quantity > 10) AS linked FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS undeclared FROM d WHERE NOT linked GROUP BY 1"""


def declared_subset(spark, sf_dir):
    """Declared entries that no link covers, one row a claim."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("d"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_partkey"))).alias("l"))
    missing = F.array_sort(F.array_except("d", "l"))
    return rows.select("o_orderkey", F.array_join(missing, ",").alias("undeclared")).filter("undeclared <> ''")


SQL["owner_asof"] = """
SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner, event_type
FROM events QUALIFY event_type = 'purchase'"""


def owner_asof(spark, sf_dir):
    """Each block's owner: the last definition before it (an as-of join as one window)."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    owner = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return rows.withColumn("owner", owner).filter("event_type = 'purchase'").select("user_id", "event_id", "owner", "event_type")


SQL["unowned"] = f"SELECT user_id, event_id FROM ({SQL['owner_asof']}) WHERE owner IS NULL"


def unowned(spark, sf_dir):
    return owner_asof(spark, sf_dir).filter("owner is null").select("user_id", "event_id")


SQL["scope_members"] = """
WITH s AS (SELECT user_id, event_id AS scope, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM events WHERE event_type = 'signup')
SELECT s.user_id, scope, count(e.event_id) AS members FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_id > scope AND (stop IS NULL OR e.event_id < stop) AND e.event_type <> 'signup' GROUP BY 1, 2"""


def scope_members(spark, sf_dir):
    """Members of each scope, from its start to the next start: the interval join as a running scope number."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    starts = F.col("event_type") == "signup"
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    scoped = rows.withColumn("scope", F.last(F.when(starts, F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return scoped.filter("scope is not null").groupBy("user_id", "scope").agg(F.sum((~starts).cast("long")).alias("members"))


def _citations(spark, sf_dir) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(kind + "-"), F.col(c).cast("string"))
    pair = lambda name, a, x, b, y: table(spark, sf_dir, name).select(key(a, x).alias("source"), key(b, y).alias("key"))
    return pair("nation", "nation", "n_nationkey", "region", "n_regionkey").unionByName(pair("customer", "customer", "c_custkey", "nation", "c_nationkey")).unionByName(pair("supplier", "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(pair("orders", "order", "o_orderkey", "customer", "o_custkey"))


EDGES = """edges AS (SELECT 'nation-' || n_nationkey AS source, 'region-' || n_regionkey AS key FROM nation UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer
UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier UNION ALL SELECT 'order-' || o_orderkey, 'customer-' || o_custkey FROM orders)"""
SQL["blast_radius"] = f"WITH RECURSIVE {EDGES}, c(member) AS (SELECT 'region-0' UNION SELECT e.source FROM edges e JOIN c ON e.key = c.member) SELECT 'region-0' AS start, member FROM c WHERE member <> 'region-0'"


def blast_radius(spark, sf_dir):
    """All that cites region-0, directly or not."""
    return graph.closure(_citations(spark, sf_dir), spark.createDataFrame([("region-0",)], "start string"))


SQL["degrees"] = f"WITH {EDGES}, i AS (SELECT key AS id, count(*) AS in_degree FROM edges GROUP BY 1), o AS (SELECT source AS id, count(*) AS out_degree FROM edges GROUP BY 1) SELECT o.id, o.out_degree, coalesce(in_degree, 0) AS in_degree FROM o LEFT JOIN i ON i.id = o.id"


def degrees(spark, sf_dir):
    """References out of and into each claim; edges count, not citers."""
    e = _citations(spark, sf_dir)
    both = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("key").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree")).filter("out_degree > 0")


SQL["zero_inbound"] = f"SELECT count(*) AS n FROM ({SQL['degrees']}) WHERE in_degree = 0"


def zero_inbound(spark, sf_dir):
    return graph.zero_inbound(degrees(spark, sf_dir)).agg(F.count("*").alias("n"))


SQL["review_surface"] = f"WITH RECURSIVE {EDGES}, c(start, member) AS (SELECT DISTINCT key, source FROM edges WHERE key LIKE 'region-%' OR key LIKE 'nation-%' UNION SELECT c.start, e.source FROM edges e JOIN c ON e.key = c.member) SELECT start, count(*) AS review_surface FROM c GROUP BY 1"


def review_surface(spark, sf_dir):
    """Sizes of the closures of many starts at once."""
    e = _citations(spark, sf_dir)
    starts = e.filter("key like 'region-%' or key like 'nation-%'").select(F.col("key").alias("start")).distinct()
    return graph.closure(e, starts).groupBy("start").agg(F.count("*").alias("review_surface"))


SQL["rename_diff"] = """
WITH a AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 103 ELSE c_nationkey END AS nation FROM customer), b AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_acctbal > 0 THEN 103 ELSE c_nationkey END AS nation FROM customer)
SELECT 'expected' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'found' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""


def rename_diff(spark, sf_dir):
    """What differs between the substituted snapshot and the one read again."""
    c = table(spark, sf_dir, "customer")
    expected = c.select("c_custkey", F.when(F.col("c_nationkey") == 3, 103).otherwise(F.col("c_nationkey")).alias("nation"))
    found = c.select("c_custkey", F.when((F.col("c_nationkey") == 3) & (F.col("c_acctbal") > 0), 103).otherwise(F.col("c_nationkey")).alias("nation"))
    return expected.exceptAll(found).select(F.lit("expected").alias("side"), "*").unionByName(found.exceptAll(expected).select(F.lit("found").alias("side"), "*"))


SQL["outcome_fold"] = "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'fail' WHEN bool_or(value < 1) THEN 'vacuous' ELSE 'pass' END AS outcome, count(*) AS markers FROM events GROUP BY 1"


def outcome_fold(spark, sf_dir):
    """Any failure fails; else anything vacuous is vacuous; else it passes."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("f"), F.bool_or(F.col("value") < 1).alias("v"), F.count("*").alias("markers"))
    return rows.select("user_id", F.when(F.col("f"), "fail").when(F.col("v"), "vacuous").otherwise("pass").alias("outcome"), "markers")


SQL["index_last_wins"] = "SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY 1, 2"


def index_last_wins(spark, sf_dir):
    """The last row of each id, by an aggregate instead of a sort."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_suppkey", "l_partkey")).alias("l_partkey"))


SQL["all_findings"] = f"""SELECT 'C2' AS check, 'fail' AS severity, count(*) AS n FROM ({SQL['dup_ids']}) UNION ALL SELECT 'C3', 'fail', count(*) FROM ({SQL['genre_forbids']})
UNION ALL SELECT 'C4', 'fail', count(*) FROM ({SQL['dangling_depends']}) UNION ALL SELECT 'orphaned-because', 'warn', count(*) FROM ({SQL['orphaned_because']})"""


def all_findings(spark, sf_dir):
    """Findings of several checks in one ordered union."""
    parts = [("C2", "fail", dup_ids), ("C3", "fail", genre_forbids), ("C4", "fail", dangling_depends), ("orphaned-because", "warn", orphaned_because)]
    out = None
    for check, severity, f in parts:
        rows = f(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


SQL["normative_words"] = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\b(the|and|not|was)\\b')) AS word FROM documents) GROUP BY 1"


def normative_words(spark, sf_dir):
    """Occurrences of keywords as whole words."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("\\b(the|and|not|was)\\b"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


SQL["slugify"] = "SELECT p_partkey, replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}\\p{M} _-]', '', 'g'), ' ', '-') AS slug FROM part"


def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", refs.slug(F.col("p_name")).alias("slug"))


SQL["page_links"] = "SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages"


def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


SQL["link_shapes"] = f"SELECT count(*) FILTER (contains(href, '://') OR starts_with(href, 'mailto:') OR starts_with(href, 'tel:')) AS external, count(*) FILTER (split_part(href, '#', 1) <> '' AND (contains(href, '#') OR contains(split_part(href, '#', 1), '/') OR contains(split_part(href, '#', 1), '.'))) AS path_shaped, count(*) AS links FROM ({SQL['page_links']})"


def link_shapes(spark, sf_dir):
    h = F.col("href")
    return page_links(spark, sf_dir).agg(F.count_if(refs.is_external(h)).alias("external"), F.count_if(refs.path_part(h).isNotNull()).alias("path_shaped"), F.count("*").alias("links"))


SQL["dangling_links"] = f"SELECT page_id, href FROM ({SQL['page_links']}) l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = l.href)"


def dangling_links(spark, sf_dir):
    """Links to no page of the corpus."""
    there = table(spark, sf_dir, "pages").select(F.col("url").alias("href"))
    return page_links(spark, sf_dir).join(there, "href", "left_anti").select("page_id", "href")


SQL["path_resolve"] = "SELECT o_orderkey, 'docs/' || (o_orderkey % 7) || '/x.md' AS path FROM orders"


def path_resolve(spark, sf_dir):
    """Relative paths walked segment by segment."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("./a/../../"), (F.col("o_orderkey") % 7).cast("string"), F.lit("//x.md")).alias("href"))
    return rows.select("o_orderkey", refs.resolved(F.lit("docs/specs"), F.col("href")).alias("path"))


SQL["literal_absent"] = "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE contains(content, 'that the')"


def literal_absent(spark, sf_dir):
    """Lines that hold a literal, each once."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return lines.filter(F.col("content").contains("that the")).select("doc_id", (F.col("at") + 1).cast("long").alias("line"))


SQL["bold_lines"] = "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents) WHERE contains(content, '***') GROUP BY 1"


def bold_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").filter(F.col("text").contains("***")).select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return lines.filter(F.col("content").contains("***")).groupBy("doc_id").agg(F.count("*").alias("n"))


SQL["vacuity"] = "SELECT conv_id, bool_and(NOT contains(text, 'the')) AS vacuous, count(*) AS turns FROM conversations GROUP BY 1"


def vacuity(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_and(~F.col("text").contains("the")).alias("vacuous"), F.count("*").alias("turns"))


SQL["ref_parse"] = "SELECT o_orderkey, 'anchor' AS tag, NULL::VARCHAR AS id, 'docs/o-' || o_custkey AS path, 'a#' || (o_orderkey % 10) AS anchor FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'claim', 'o-' || o_custkey, NULL, NULL FROM orders WHERE o_orderkey % 2 <> 0"


def ref_parse(spark, sf_dir):
    """References split at their first #."""
    o = F.concat(F.lit("o-"), F.col("o_custkey").cast("string"))
    ref = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("docs/"), o, F.lit("#a#"), (F.col("o_orderkey") % 10).cast("string"))).otherwise(o)
    return table(spark, sf_dir, "orders").select("o_orderkey", refs.parsed(ref).alias("r")).select("o_orderkey", "r.tag", "r.id", "r.path", "r.anchor")


SQL["id_grammar"] = "SELECT p_partkey, regexp_full_match(p_name, '[a-z0-9]+(-[a-z0-9]+)*') AS valid, NOT regexp_full_match(p_name, '[a-z0-9]+(-[a-z0-9]+)*') AND NOT regexp_matches(p_name, '\\s') AS malformed FROM part"


def id_grammar(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", refs.is_id(name).alias("valid"), refs.is_malformed_token(name).alias("malformed"))


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
