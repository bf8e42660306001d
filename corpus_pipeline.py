"""From raw documents to packed training sequences, in stages that each call one operator of ``driftspark.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import decontaminate, packing, pii, quality, simhash
from driftspark.llm.common import table
from driftspark.llm.queries import TOKENIZER
from driftspark.runtime import col, materialize


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the ordinal classifier, fitted on ``labels``, rejects as poor or toxic."""
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model)
    return scored.where(col(scored.columns[-1])).select(*[col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; keeps every document and brings ``n_chars`` up to date."""
    clean = pii.redact(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[length.alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, TOKENIZER))


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

# Hashes, learned weights and a tokenizer have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
