"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret scans, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet in the shared folder and
rereads as the next stage's docs. All but the last return the columns of docs.

language_id       fits its models on the labelled, not held-out rows of its input; rejected documents go
near_dedup        one document of each group stays; a link is a similarity of 0.8 or more of five-word shingle sets
decontamination   documents that contain a benchmark item (0.8 of its 5-word shingles or more) go
secret_scan       secrets in texts are replaced by `<secret>`; n_chars follows
bpe               token ids, with a check that they decode to the text

In every stage extra columns, whatever their names, pass through (bpe keeps what it names), repeated rows are rows like others, and an
empty table gives an empty one. SQL can't express these stages, so ORACLE_SQL is None and the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import bpe, decontam, langid, secret_scan, simhash
from placeloom.llm.common import table
from placeloom.storage import remove, stored, temporary_tables

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the learned languages.

    Null and empty texts and texts without a letter have no language and go. Null ids count as held out and are judged like any row; a null
    lang teaches nothing. Without a labelled row every text with a letter stays. Copies of a text stay or go together.
    """
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that which stands first in the written table.

    A null text counts as an empty one; of all texts without a word one row stays. Texts of fewer than five words are near copies only if their
    words are equal. Rows are told apart by position, so null and repeated ids don't matter.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item; null, empty and wordless texts contain none and stay, and items without a word are in no text."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span of a secret replaced by one mark (overlapping spans by one); null and empty texts as they are."""
    return secret_scan.redact(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, exact of every row; a null text is an empty one: no ids, exact."""
    coded = bpe.encode_decode(docs.withColumn("source_text", F.coalesce("text", F.lit(""))), keep=("lang", "source", "source_text"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.col("source_text")).alias("exact"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe", byte_pairs),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables are removed when its result is stored, a result when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            remove(spark, last)
        last = path
    return docs
