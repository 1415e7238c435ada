"""Queries of the operators on document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import langid
from orbitframe.llm.common import crc_mod, table
from orbitframe.llm.packing import pack_documents
from orbitframe.llm.pii import pseudonymize
from orbitframe.llm.simhash import simhash_components


#: The key of the registered queries; a deployment passes its own.
PII_KEY = b"orbitframe pseudonym key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by format-preserving pseudonyms."""
    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", F.col("pii_found.text").alias("text"), F.col("pii_found.n_found").alias("n_found"), F.to_json("pii_found.kinds").alias("kinds"))


def op2_pack(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(f"{vocabulary}.json"),
        public_tokenizers.path(f"{vocabulary}.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; documents whose id's crc32 leaves 2 (mod 4) teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    taught = docs.where(crc_mod("doc_id", 4) != 2).select(F.col("doc_id").alias("key"), "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(taught))
    return found.select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        F.col("lang_found.lang").alias("lang_pred"),
        F.col("lang_found.score").alias("score"),
        F.col("lang_found.rejected").alias("rejected"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, 64 bits, radius 4."""
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=4, words=1, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_pii": op1_pii, "op2_pack": op2_pack, "op5_langid": op5_langid, "op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
