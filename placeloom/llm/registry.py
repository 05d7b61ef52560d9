"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_wrapper, langid, licenses, secret_scan, shards, simhash, tiff, tokenfile
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(tiff.text_to_tiff(table(spark, sf_dir, "documents", "doc_id", "text")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.identify(documents, langid.fit(documents)).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_joins")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, ranks = tokenfile.write_token_file(table(spark, sf_dir, "documents", "doc_id", "text"))
    return tokenfile.read_token_file(blocks, ranks)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.pack_into(table(spark, sf_dir, "documents", "doc_id", "text"), 24)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_html_wrapper, op3_tiff_media, op4_license_scan, op5_language_id, op6_bpe_roundtrip, op7_simhash, op8_shards, op9_token_file, op10_decontamination)}
#: Only containment is a set computation that SQL states plainly; the other operators are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op10_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
size AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY item_id),
widths AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d, widths),
hit AS (SELECT doc_id, item_id, count(*) AS n_found FROM dg JOIN ig ON dg.g = ig.g AND dg.n = ig.n GROUP BY ALL)
SELECT doc_id, hit.item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment FROM hit JOIN size ON hit.item_id = size.item_id WHERE n_found >= 0.8 * n_shingles""",
}
