"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk longer than this is encoded but not remembered.
REMEMBERED_CHARS = 64
#: Chunks one Python worker remembers; beyond, it starts anew.
REMEMBERED_CHUNKS = 300_000


#: Size of an Arrow batch, in bytes and rows.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark) -> None:
    """Arrow batches of a few MB, so that a Python worker's memory does not depend on how long texts are. What the cluster's own
    configuration says about them stays."""
    for name, value in BATCH.items():
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, value)


def release() -> None:
    """Give memory that a task no longer needs back to the machine; workers live on, and the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone.

    ``lower`` does just that unless the text has other upper-case letters; only then each character is mapped.
    """
    plain = (F.length(text) == F.octet_length(text)) | ~text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, between: str) -> Column:
    """Array of the non-empty parts between matches of ``between``; empty for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def run_hash(array: Column, at: Column, n: int) -> Column:
    """xxhash64 of the ``n`` entries from 0-based place ``at``, the same as of a slice of them. Taken one by one, since a slice
    inside a lambda copies the whole array each time."""
    return F.xxhash64(*[array[at + j] for j in range(n)])


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int) -> DataFrame:
    """(doc_id, label, text) of about ``per_class`` labelled rows per class at most, none of them held out.

    Rows are picked by a hash of the id, so the sample is the same on every run. Its ids are bounded by
    ``per_class`` and so may be broadcast: documents are scanned, not shuffled. An id with several
    labels counts with its largest one.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isin(0, 1) & ~held_out)
    known = known.where(F.col("doc_id").isNotNull())
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col("label") == value, min(1.0, per_class / count)).otherwise(share)
    ids = known.where(spot < share).groupBy("doc_id").agg(F.max("label").alias("label")).limit(3 * per_class)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def on_texts(function: Callable[[str], object], kind: pa.DataType, returns: str):
    """Arrow UDF of one text at a time; NULL is read as the empty text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([function(t or "") for t in texts.to_pylist()], type=kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def on_batches(start: Callable[[], Callable[[Sequence[str]], list]], kind: pa.DataType, returns: str):
    """Arrow UDF of a batch of texts; ``start`` is called once per task and gives what handles the batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        handle = start()
        try:
            for texts in batches:
                yield pa.array(handle([t or "" for t in texts.to_pylist()]), type=kind)
        finally:
            del handle
            release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


class Remembered(dict):
    """Encoded chunks by text. Text is full of repeated words, so each is encoded once and looked up afterwards."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        got = self.encode(chunk)
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED_CHUNKS:
                self.clear()
            self[chunk] = got
        return got

    def joined(self, chunks: Iterable[str]) -> bytes:
        return b"".join(map(self.__getitem__, chunks))
