"""Queries of the trained document scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import quality, toxicity
from orbitframe.llm.common import crc_mod, table


def _tables(spark: SparkSession, sf_dir: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents, the same by key, and the labels that may teach: of ids whose crc32 does not leave 0 (mod 5)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select(F.col("doc_id").alias("key"), F.col(target).alias("target"))
    return docs, docs.withColumnRenamed("doc_id", "key"), labels


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; predicted 1 from a score of 0.5."""
    docs, keyed, labels = _tables(spark, sf_dir, "toxic")
    scored = toxicity.score(docs, toxicity.fit(keyed, labels))
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        F.when(F.col("toxicity_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; predicted 1 from a score of 0.3."""
    docs, keyed, labels = _tables(spark, sf_dir, "quality")
    scored = quality.score(docs, quality.fit(keyed, labels))
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op3_toxicity": op3_toxicity, "op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
