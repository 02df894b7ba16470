"""Snapshot documents as a stream: landing folder to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from stationflow.sources.lake import ingest
from stationflow.sources.snapshots import normalize_free_bikes, normalize_status, read_documents, read_raw

#: Files a trigger takes unless told otherwise, so that what a trigger brings does not depend on how much has landed.
MAX_FILES = 1000


def _reader(spark: SparkSession, max_files: int) -> DataStreamReader:
    return spark.readStream.option("maxFilesPerTrigger", max_files)


def raw_stream(spark: SparkSession, landing: str, max_files: int = MAX_FILES) -> DataFrame:
    return read_raw(_reader(spark, max_files), landing)


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    max_files: int = MAX_FILES,
    drain: bool = True,
    multi_line: bool = False,
) -> StreamingQuery:
    """File new documents in the tables below ``root``, each micro-batch as one commit.

    A micro-batch is known by stream and number, so one that is tried again after its commit is left out, and one that failed
    before has left nothing to be seen. Documents that are read again by another stream add no row twice.
    ``drain`` stops after what has landed so far.
    """
    docs = read_documents(_reader(spark, max_files), landing, multi_line)
    stream = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def file(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            ingest(kept, root, f"{stream}-{number}")
        finally:
            kept.unpersist()

    writer = docs.writeStream.foreachBatch(file).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def status_stream(raw: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Station rows with event time; a snapshot landed twice within the delay counts once."""
    rows = normalize_status(raw).withWatermark("collected_at", delay)
    return rows.dropDuplicatesWithinWatermark(["station_id", "collected_at"])


def free_bike_stream(raw: DataFrame, delay: str = "10 minutes") -> DataFrame:
    rows = normalize_free_bikes(raw).withWatermark("collected_at", delay)
    return rows.dropDuplicatesWithinWatermark(["bike_id", "collected_at"])
