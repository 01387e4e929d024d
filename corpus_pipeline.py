"""The training-data pipeline: each stage's result is written as Parquet and read again by the next.

In every stage an empty table gives an empty one, extra columns are carried along under any name, texts of any length are
read whole, and rows with a null id are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import bpe, decontaminate, langid, lines, simhash
from bindery.llm.common import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; machines and limits are learned from the documents' own language column.

    Null and empty texts and texts without a letter go; repeated rows are judged alike.
    """
    model = langid.fit(docs)
    return langid.accepted(docs, model, habits=langid.calibrate(docs, model))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs in an earlier document; n_chars follows the text.

    Null and empty texts stay; documents of which nothing is left go; repeated rows count as one document and stay.
    """
    out = lines.drop_recurring(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, null ids last; repeated rows are one.

    Null and empty texts are a group of their own.
    """
    return simhash.drop_near_duplicates(docs, keep_null_ids=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items; null and empty texts stay, repeated rows too."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and the hash of the bytes that the ids decode to; null texts count as empty."""
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: Learned models and SimHash have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
