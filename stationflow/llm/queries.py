"""Queries over the driver's tables that apply the operators of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import (
    chat, contamination, fim, lexical, licenses, pieces, quality, secrets, simhash, sketches, sql, token_store, toxicity, urls,
)
from stationflow.llm.common import bounded_batches, table


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.judged(pages, urls.train(urls.labelled_table(spark)))


def op2_token_output(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return token_store.document_index(token_store.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.recognised(table(spark, folder, "documents"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.compared(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.judged(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", secrets.scan(F.col("text")).alias("_s"))
    counts = [F.col(f"_s.n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2("_s.base", 256).alias("base_sha256"), "_s.spans")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, folder, "labels")))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.transformed(table(spark, folder, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], given.schema)
    return chat.read_back(chat.formatted(given.unionByName(planted), chat.text_parts(F.col("text"))))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_url_filter, op2_token_output, op3_simhash, op4_licenses, op5_sentencepiece, op6_decontamination, op7_fingerprints,
        op8_toxicity, op9_secrets, op10_quality, op11_fill_in_middle, op12_chat_format, op13_ranked_search,
    )

    def bounded(query):
        @wraps(query)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            bounded_batches(spark)
            return query(spark, folder)

        return run

    return {f.__name__: bounded(f) for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(sql.STATEMENTS)
