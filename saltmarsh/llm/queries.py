"""Queries of the corpus operators over the driver's tables, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import bpe, exactdedup, fingerprints, mixing, neardup, quality, secrets, substrings, toxicity, urlfilter
from saltmarsh.llm.common import count_words, id_crc, table, written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0, order=2)
    scored = toxicity.score(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", id_crc() % 4 != 2)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.decisions(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")
    rows = mixing.assigned(sized, size="size")
    rows = rows.select("doc_id", *[F.col(f"mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")], F.col("mix.copies")[0]["position"].alias("at"))
    return rows.orderBy("at", "doc_id").withColumn("position", F.round("at", 6)).drop("at")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
weighed AS (
  SELECT *, (r - 1) % 3 + 1 AS w, [-0.5::DOUBLE, 0, 0.5][((r - 1) % 3 + 1)::INT] AS slope, 3 * source_size AS cap FROM totals),
filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         (sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS shared
  FROM weighed),
level AS (
  SELECT max(rest) AS rest, max(shared) AS shared FROM filled WHERE cap * shared > w * rest),
goals AS (
  SELECT source, source_size, slope, CASE WHEN cap * f.shared <= w * f.rest THEN cap::DOUBLE ELSE (w * l.rest)::DOUBLE / l.shared END AS target
  FROM filled f, level l),
placed AS (
  SELECT doc_id, size, source_size, target, slope, floor(target + 0.5)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, goal - begins)) + greatest(0, least(size, goal - begins - source_size)) + greatest(0, least(size, goal - begins - 2 * source_size)))::BIGINT AS taken,
  round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 6) AS position
FROM (SELECT *, CASE WHEN target > 0 THEN least(1.0, begins / target) ELSE 0.0 END AS u FROM placed)
"""


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


#: Longest fit wins: what is blocked, and what is allowed all the same.
URL_RULES = [urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of the pages whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, pages.where("page_id % 50 = 0"), URL_RULES).drop("url")


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&+', '') AS query
  FROM cut),
named AS (
  SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canon,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canon <> '' AND canon IN (SELECT canon FROM named WHERE page_id % 50 = 0) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scanned(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    return rows.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secrets": op6_secrets,
    "op7_bpe": op7_bpe,
    "op8_simhash_neardup": op8_simhash_neardup,
    "op9_url_filter": op9_url_filter,
    "op10_fingerprints": op10_fingerprints,
}
ORACLES = {"op3_mixing": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op9_url_filter": OP9_SQL}
