"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import exact_clusters
from .decontaminate import leaked_documents
from .embedding_dedup import near_vectors
from .hmm import score_texts
from .html_extract import extract_main_text
from .line_dedup import dedup_lines
from .packing import pack_documents
from .posting_lists import nearest_vectors
from .runs import periodic_runs
from .simhash import as_hex, near_duplicates
from .storage import crc_bucket
from .token_files import token_files
from .tokens import default_tokenizer
from .toxicity import score_documents
from .url_filter import judge_urls

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.size("removed_lines").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), F.char_length(kept).cast("long").alias("kept_chars"), F.md5(kept.cast("binary")).alias("kept_md5"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 9))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(found["fp"]).alias("fingerprint"), "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), default_tokenizer())


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, table(spark, sf_dir, "labels"))
    held_out = crc_bucket("doc_id", 5) == 0
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of the ids whose crc32 is divisible by ten repeat a stretch up to their end, from a
    word on and with a period that the crc32 sets; other texts are as they were."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    n = F.size("words")
    start = F.when(n > 0, (F.col("g") % n).cast("int"))
    period = F.when(n > 0, (1 + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int"))
    cut = split.select("doc_id", "text", "words", start.alias("a"), period.alias("p"), (n - start).alias("rest"))
    cycles = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycles, F.lit(1), F.col("rest"))), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("best.length * 1000 div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_hmm_scoring": op2_hmm_scoring,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_token_files": op6_token_files,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_html_extraction": op10_html_extraction,
    "op11_nearest_vectors": op11_nearest_vectors,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_clusters": op13_exact_clusters,
}

OP8_SQL = r"""
WITH RECURSIVE judged AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM judged, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
link AS (
  SELECT DISTINCT url AS a, regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical[^>]*href\s*=\s*["'']?([^"''\s>]+)', 1) AS b
  FROM pages WHERE contains(lower(html), 'canonical')),
alias AS (SELECT a, b FROM link WHERE b <> '' UNION SELECT b, a FROM link WHERE b <> ''),
reach(a, b) AS (SELECT a, b FROM alias UNION SELECT reach.a, alias.b FROM reach JOIN alias ON reach.b = alias.a),
bad AS (SELECT DISTINCT reach.a AS url FROM reach JOIN judged ON judged.url = reach.b JOIN best USING (page_id) WHERE best.verdict = 'block')
SELECT judged.page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN bad.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM judged LEFT JOIN best ON best.page_id = judged.page_id LEFT JOIN bad ON bad.url = judged.url
"""

ORACLES: dict[str, str] = {"op8_url_filter": OP8_SQL}
