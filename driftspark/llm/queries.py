"""Queries of this package over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import (
    audit,
    centroids,
    class_lm,
    decontaminate,
    embeddings,
    oracle,
    packing,
    pages,
    pii,
    quality,
    shards,
    simhash,
    suffixes,
    toxicity,
)
from driftspark.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


SHARDS = 24


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, and their shards if there were one more."""
    return shards.assign(table(spark, sf_dir, "documents"), SHARDS)


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity").groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity")
    )


def op3_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents by class bigrams learned from six sevenths of them."""
    return class_lm.score(table(spark, sf_dir, "documents"))


def op4_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that also start elsewhere."""
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, "found")
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("found")).alias("spans"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER)
    return packing.pack(cut).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_cover_tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels, from cosine 0.98."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        F.col("quality_grade").alias("expected_grade"),
        F.get("quality_tail", F.lit(0)).alias("p_not_toxic"),
        F.get("quality_tail", F.lit(1)).alias("p_good"),
        F.col("quality_keep").alias("keep"),
    )


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, at most 4 differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components by the nearest of eight centroids, after ten rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_nb_char_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in all 120 orders."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ALL = [
    op1_hash_tree_shards,
    op2_simhash_decontamination,
    op3_brown_class_lm,
    op4_deep_shallow_dedup,
    op5_pii_crf,
    op6_best_fit_packing,
    op7_host_suffix_text,
    op8_cover_tree_pairs,
    op9_ordinal_quality,
    op10_simhash_pigeonring,
    op11_incremental_centroids,
    op12_nb_char_toxicity,
    op13_filter_audit,
]


# All windows of item size that hold a shingle of the item, by exact similarity; every item has five words at least.
CONTAMINATED = r"""WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
),
item_shingles AS (
  SELECT item_id, shingle, n, count(*) AS c FROM (
    SELECT item_id, len(w) - 4 AS n, unnest([array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)]) AS shingle FROM items
  ) GROUP BY ALL
),
doc_shingles AS (
  SELECT doc_id, len(w) - 4 AS total, unnest(range(0, len(w) - 4)) AS pos,
    unnest([array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)]) AS shingle
  FROM docs WHERE len(w) >= 5
),
hits AS (SELECT doc_id, item_id, total, pos, shingle, n, c FROM doc_shingles JOIN item_shingles USING (shingle)),
windows AS (
  SELECT DISTINCT doc_id, item_id, n, least(n, total) AS size,
    unnest(range(greatest(0, pos - n + 1), greatest(0, least(pos, total - least(n, total))) + 1)) AS start
  FROM hits
),
shared AS (
  SELECT doc_id, item_id, n, size, start, shingle, least(count(*), c) AS common
  FROM windows JOIN hits USING (doc_id, item_id, n) WHERE pos BETWEEN start AND start + size - 1
  GROUP BY doc_id, item_id, n, size, start, shingle, c
),
scored AS (
  SELECT doc_id, item_id, CAST(sum(common) AS DOUBLE) / (size + n - sum(common)) AS similarity
  FROM shared GROUP BY doc_id, item_id, n, size, start
)
SELECT doc_id, item_id, max(similarity) AS similarity FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""


def sql() -> dict[str, str]:
    return {
        "op2_simhash_decontamination": CONTAMINATED,
        "op11_incremental_centroids": oracle.centroid_sql(),
        "op13_filter_audit": oracle.FILTER_AUDIT,
    }
