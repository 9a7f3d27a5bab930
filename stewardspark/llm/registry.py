"""The queries of the operators and, where SQL can say the same, their SQL."""

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stewardspark.llm import (
    decontamination,
    lexical_search,
    line_dedup,
    mixing,
    near_dup,
    periodic_runs,
    personal_data,
    repeats,
    token_counts,
    token_files,
    tokens,
    top_k,
    toxicity,
    url_rules,
)
from stewardspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    passages = F.transform("passages", lambda p: F.struct(p["first"], p["last"]))
    return rows.select("doc_id", "held_out", "score", "predicted", "evidence", passages.alias("passages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    sha = F.sha2(listed(base), 256).alias("base_sha256")
    counts = [number(kind) for kind in ("email", "ip", "card", "phone")]
    return rows.select("doc_id", *counts, sha, listed(F.col("spans")).alias("spans"))


def periodic_words(doc_id, n: int) -> np.ndarray | None:
    """For about a tenth of the ids, numbers that repeat the words from some place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    order = np.arange(n)
    order[first:] = first + (order[first:] - first) % period
    return order


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plan=periodic_words)
    return rows.drop("collapsed")


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_token_counts": op2_token_counts,
    "op3_url_filters": op3_url_filters,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_ranked_search": op11_ranked_search,
    "op12_pii": op12_pii,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}


ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": r"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (SELECT DISTINCT host, path FROM cut),
best AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM urls JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, cut.host, cut.path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM cut LEFT JOIN best USING (host, path)""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.row <> q.row),
r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_ranked_search": r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
items AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark),
asked AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM items),
totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
counted AS (
  SELECT doc, doc_id, term, len_terms, count(*) AS tf
  FROM (SELECT doc, doc_id, len(terms) AS len_terms, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked)
  GROUP BY doc, doc_id, term, len_terms),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counted, totals GROUP BY term, n_docs),
scored AS (
  SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len_terms * n_docs) // n_terms))))
              AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term), totals
  GROUP BY item, doc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 50""",
}
