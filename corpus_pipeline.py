"""Training-corpus pipeline: quality, near copies, benchmark passages, secrets, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import contamination, pieces, quality, secrets, simhash
from stationflow.llm.common import bounded_batches, table
from stationflow.session import settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones of this input, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("_quality", quality.score(F.col("text"), model))
    return scored.where(F.col("_quality") >= quality.ACCEPTED).drop("_quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints of three-word shingles within two bits, found by multi-index hashing."""
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than the allowed share of benchmark passages."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and n_chars counted anew where it changed."""
    masked = docs.withColumn("_masked", secrets.redact(F.col("text")))
    changed = ~F.col("_masked").eqNullSafe(F.col("text"))
    counted = F.when(changed, F.length("_masked").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", counted).withColumn("text", F.col("_masked")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, parity, round_trip) of all documents."""
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL states neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
