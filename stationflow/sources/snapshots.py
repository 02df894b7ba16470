"""Raw snapshot documents: landing, reading, normalising, appending."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StringType, StructField, StructType

from stationflow.functions.clock import epoch_us, utc_wall
from stationflow.sources.schemas import FEEDS, RAW

CORRUPT = "_corrupt_record"


def snapshot_id(df: DataFrame, name: str = "collected_at"):
    return F.date_format(utc_wall(epoch_us(df, name)), "yyyyMMdd'T'HHmmss'Z'")


def snapshot_date(df: DataFrame, name: str = "collected_at"):
    return F.to_date(utc_wall(epoch_us(df, name)))


def land_snapshots(raw: DataFrame, path: str) -> None:
    """Append raw documents as JSON under UTC date folders."""
    dated = raw.withColumns({"snapshot_id": snapshot_id(raw), "date": snapshot_date(raw)})
    dated.write.mode("append").partitionBy("date").json(path)


def read_documents(source: SparkSession | DataStreamReader, path: str, multi_line: bool = False) -> DataFrame:
    """All documents with their file path, also what is no JSON (its text in ``CORRUPT``) or has no time.

    Works for ``spark`` and for ``spark.readStream`` (with its options set by the caller). Our own landing writes one
    document per line; ``multi_line`` reads files of one indented document each.
    """
    reader = source.read if isinstance(source, SparkSession) else source
    schema = StructType([*RAW.fields, StructField(CORRUPT, StringType())])
    reader = reader.schema(schema).option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", CORRUPT)
    docs = reader.option("multiLine", str(multi_line).lower()).json(path)
    return docs.select("*", F.col("_metadata.file_path").alias("raw_path"))


def read_raw(source: SparkSession | DataStreamReader, path: str, multi_line: bool = False) -> DataFrame:
    """Raw documents with their file path; ``read_rejected`` has those that are none."""
    return read_documents(source, path, multi_line).where("collected_at is not null").drop(CORRUPT)


def read_rejected(source: SparkSession | DataStreamReader, path: str, multi_line: bool = False) -> DataFrame:
    """(raw_path, document) of what can't be read as a snapshot: no JSON, or without a readable ``collected_at``."""
    docs = read_documents(source, path, multi_line).where("collected_at is null")
    return docs.select("raw_path", F.coalesce(CORRUPT, F.to_json("feeds")).alias("document"))


def keep_feeds(raw: DataFrame, names: list[str]) -> DataFrame:
    """Only the named feeds; columns of the others are never read."""
    have = raw.schema["feeds"].dataType.names
    return raw.withColumn("feeds", F.struct(*[F.col(f"feeds.{n}").alias(n) for n in names if n in have]))


#: Feed: its list of rows and their id.
FEED_ROWS = {
    "station_status": ("stations", "station_id"),
    "station_information": ("stations", "station_id"),
    "free_bike_status": ("bikes", "bike_id"),
}


def feed_rows(
    raw: DataFrame, feed: str, items: str, stamp: str, keep: Sequence[str] = (), only: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per entry of a feed's list, with the document's time as ``stamp`` and its columns ``keep``. With ``only`` the other
    entries are left out inside the document, so that no rows are made of them."""
    if feed not in raw.schema["feeds"].dataType.names:
        raw = raw.withColumn("feeds", F.struct(F.lit(None).cast(FEEDS[feed].dataType).alias(feed)))
    entries = F.col(f"feeds.{feed}.data.{items}")
    exploded = raw.select(
        F.col("collected_at").alias(stamp),
        *keep,
        F.col(f"feeds.{feed}.last_updated").alias("feed_last_updated"),
        F.explode(entries if only is None else F.filter(entries, only)).alias("row"),
    )
    return exploded.select(stamp, *keep, "feed_last_updated", "row.*")


def normalize_status(raw: DataFrame) -> DataFrame:
    rows = feed_rows(raw, "station_status", "stations", "collected_at")
    return rows.withColumn("vehicle_types_available", F.coalesce("vehicle_types_available", F.lit("[]")))


def normalize_info(raw: DataFrame) -> DataFrame:
    return feed_rows(raw, "station_information", "stations", "observed_at")


def normalize_free_bikes(raw: DataFrame) -> DataFrame:
    rows = feed_rows(raw, "free_bike_status", "bikes", "collected_at")
    return rows.withColumn("rental_uris", F.coalesce("rental_uris", F.lit("{}")))


def run_rows(raw: DataFrame) -> DataFrame:
    """One run row per document, counted inside the document, so nothing is shuffled."""
    feeds = raw.schema["feeds"].dataType.names
    stations = F.col("feeds.station_status.data.stations")
    bikes = F.aggregate(
        F.coalesce(F.transform(stations, lambda s: F.coalesce(s["num_bikes_available"], F.lit(0))), F.array()),
        F.lit(0).cast("int"),
        lambda total, n: total + n,
    )
    free = F.lit(0)
    if "free_bike_status" in feeds:
        free = F.coalesce(F.size(F.coalesce("feeds.free_bike_status.data.bikes", F.array())), F.lit(0))
    return raw.select(
        "collected_at",
        F.col("raw_path") if "raw_path" in raw.columns else F.lit("").alias("raw_path"),
        F.size(F.coalesce(stations, F.array())).alias("station_count"),
        bikes.alias("bikes_available"),
        free.alias("free_bike_count"),
    )


def add_parts(runs: DataFrame) -> DataFrame:
    """One run row per time from ``run_rows`` of documents that hold different parts of a snapshot; copies of a part would
    count again, so rows with a key are counted instead where there may be any (``lake.ingest``)."""
    counts = ["station_count", "bikes_available", "free_bike_count"]
    sums = [F.sum(c).cast("int").alias(c) for c in counts]
    return runs.groupBy("collected_at").agg(F.min("raw_path").alias("raw_path"), *sums)
