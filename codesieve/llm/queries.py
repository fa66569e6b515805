"""The registered queries of this subpackage: one for each operator, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.common import table
from codesieve.llm.decontamination import find_leaks
from codesieve.llm.filter_audit import audit_filters
from codesieve.llm.html_text import extract_text
from codesieve.llm.importance_resample import resample
from codesieve.llm import bpe, toxicity
from codesieve.llm.license_scan import scan_licenses
from codesieve.llm.media import media_digests, text_to_media
from codesieve.llm.near_dup import duplicate_classes
from codesieve.llm.oracles import audit_sql, license_sql, resample_sql, secret_sql
from codesieve.llm.secret_scan import scan_secrets
from codesieve.llm.substring_dedup import dedup_windows, digest_kept
from codesieve.llm.url_filter import judge_urls
from codesieve.llm.vector_search import QUERY_STEP, search

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: The method's own list, for URLs that no rule fits.
URL_LIST = [("spam-farm.example.org", "", "block"), ("cheap-pills.example.com", "", "block"), ("casino-win.example.com", "", "block")]


def tokenizer_path() -> str:
    """The tokenizer of the query; its file is never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_LIST)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(text_to_media(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "n_sentences", F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("offending"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_kept(dedup_windows(table(spark, sf_dir, "documents")))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_STEP == 0)


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_html_text": op1_html_text, "op2_url_filter": op2_url_filter, "op3_secret_scan": op3_secret_scan, "op4_decontamination": op4_decontamination, "op5_media_columns": op5_media_columns, "op6_substring_dedup": op6_substring_dedup, "op7_near_dup": op7_near_dup, "op8_license_scan": op8_license_scan, "op9_toxicity": op9_toxicity, "op10_bpe": op10_bpe, "op11_filter_audit": op11_filter_audit, "op12_vector_search": op12_vector_search, "op13_importance_resample": op13_importance_resample}

SQL: dict[str, str] = {
    "op3_secret_scan": secret_sql(),
    "op8_license_scan": license_sql(),
    "op11_filter_audit": audit_sql(),
    "op13_importance_resample": resample_sql(),
    "op2_url_filter": """
WITH parts AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
listed(host) AS (VALUES ('spam-farm.example.org'), ('cheap-pills.example.com'), ('casino-win.example.com'))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM (
    SELECT p.page_id, p.host, p.path,
        (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
        (SELECT max_by(r.verdict, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS verdict,
        EXISTS (SELECT 1 FROM listed l WHERE p.host = l.host OR ends_with(p.host, '.' || l.host)) AS listed
    FROM parts p)
""",
}
