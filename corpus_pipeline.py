"""A corpus pipeline over ``documents``: five stages, each of one operator.

Every stage works on all that its predecessor kept and returns the columns of
``documents``, except the last, which returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import langid
from orbitframe.llm.common import fresh, materialize, table
from orbitframe.llm.mixing import mixed_rows
from orbitframe.llm.packing import pack_documents
from orbitframe.llm.pii import pseudonymize
from orbitframe.llm.simhash import without_near_copies

#: A deployment passes its own.
PII_KEY = b"orbitframe pipeline key"
VOCABULARY = "byte_bpe_50k"

#: Near copies: sets of 5-word shingles of Jaccard similarity 0.8, counted exactly. 256 bits choose the candidates:
#: texts of similarity 0.8 differ in 39 bits on average (deviation 5.7); 63 keys of 12 bits, 3 draws of 21, find
#: 99.99 of 100 such pairs by calculation.
NEAR = {"shingle": 5, "words": 4, "radius": 60, "bands": 21, "draws": 3, "jaccard": 0.8}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows of known language, fills in unknown ones, drops rejected documents."""
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = fresh(docs, "lang_found")
    rows = langid.identify(docs, model, into=found).where(~F.col(f"{found}.rejected"))
    return rows.withColumn("lang", F.coalesce("lang", F.col(f"{found}.lang"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every group of near copies."""
    return without_near_copies(docs, **NEAR)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms of the same length in place of personal data."""
    found = fresh(docs, "pii_found")
    return pseudonymize(docs, PII_KEY, into=found).withColumn("text", F.col(f"{found}.text")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained, keyed and iterative stages have no SQL form; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
