"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, ngram_join, pii, quality_classifier, quality_rules, secrets, substring_dedup, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_duplicate_chunks(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scans(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    held_out = toxicity.fold(4) == 2
    return toxicity.scored(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out)


def op6_quality_classifier(spark, sf_dir):
    held_out = toxicity.fold(5) == 0
    return toxicity.scored(quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out)


def op7_pii(spark, sf_dir):
    return pii.personal_data_report(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup,
            op2_suffix_array_dedup,
            op3_quality_rules,
            op4_secret_scans,
            op5_toxicity,
            op6_quality_classifier,
            op7_pii,
            op8_ngram_jaccard_join,
            op9_benchmark_decontamination,
            op10_bpe,
            pipeline,
        )
    }


#: An oracle without Python: windows of benchmark words found in the documents' word lists.
DECONTAMINATION_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bp AS (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS k FROM bp),
sizes AS (SELECT DISTINCT size FROM win),
dp AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM dw, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, p, dp.size, item FROM (SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS k FROM dp) dp JOIN win ON win.size = dp.size AND win.k = dp.k),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)"""


#: All shared shingles joined, links by overlap, components by reachability.
JOIN_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY 1) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it expresses on whole tables; the others are tested against plain versions in tests/llm."""
    return {"op8_ngram_jaccard_join": JOIN_SQL, "op9_benchmark_decontamination": DECONTAMINATION_SQL}
