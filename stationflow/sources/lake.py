"""Snapshot tables under one root, filled batch by batch, each batch as one commit.

Every table is a folder of Parquet files in ``date=.../attempt=...`` partitions. A batch writes its rows to all tables under an
attempt of its own and is then entered in ``commits``; readers take the rows of entered attempts only. So a batch is there
with all its tables or not at all, a batch that failed half-way is run again under a new attempt, and one that is entered is not
run again.

Station and vehicle rows have a key (time and id). Of a key the first committed row stays; rows of equal key within a batch
count once. Run rows are reduced from the rows held, so a snapshot that comes in parts, late or repeated, corrects them: each
batch writes the run rows of the times it touches anew, and of a time's run rows the newest is read. Only date folders that a batch
touches are looked at. Batches of one root must follow each other; two at once could both take themselves for the first.

What can't be filed goes to ``rejected``: documents that are no JSON or have no time, and rows without an id; of equal ones in
one file one stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.sources.schemas import FREE_BIKES, INFO, RUNS, STATUS
from stationflow.sources.snapshots import CORRUPT, FEED_ROWS, feed_rows, normalize_free_bikes, normalize_info, normalize_status, snapshot_date

#: Table: what makes its rows, its schema, its time and its id.
KEYED = {
    "station_status": (normalize_status, STATUS, "collected_at", "station_id"),
    "station_information": (normalize_info, INFO, "observed_at", "station_id"),
    "free_bikes": (normalize_free_bikes, FREE_BIKES, "collected_at", "bike_id"),
}
REJECTED = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("feed", "reason")],
        T.StructField("collected_at", T.TimestampType()),
        *[T.StructField(n, T.StringType()) for n in ("raw_path", "document")],
    ]
)
_COMMITS = "batch string, attempt string"
_PARTS = [T.StructField("date", T.DateType()), T.StructField("attempt", T.StringType())]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(batch, attempt) of what has been committed, one row a batch."""
    path = f"{root}/commits"
    if not _exists(spark, path):
        return spark.createDataFrame([], _COMMITS)
    return spark.read.schema(_COMMITS).json(path)


def _files(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    path, full = f"{root}/{name}", T.StructType([*schema.fields, *_PARTS])
    return spark.read.schema(full).parquet(path) if _exists(spark, path) else spark.createDataFrame([], full)


def _held(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """Committed rows with their partition columns. Commits are one row a batch, so Spark broadcasts them by their size and
    prunes the folders of other attempts."""
    return _files(spark, root, name, schema).join(commits(spark, root).select("attempt"), "attempt", "left_semi")


def read_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of ``KEYED``, or 'rejected'."""
    schema = REJECTED if name == "rejected" else KEYED[name][1]
    return _held(spark, root, name, schema).select(*schema.names)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The newest run row of each time. Tables only grow, so that is the one that counts most."""
    counts = ["station_count", "free_bike_count", "bikes_available"]
    held = _held(spark, root, "runs", RUNS)
    newest = held.groupBy("collected_at").agg(F.min("raw_path").alias("raw_path"), F.max(F.struct(*counts)).alias("n"))
    return newest.select("collected_at", "raw_path", *[F.col(f"n.{c}") for c in counts]).select(*RUNS.names)


def _between(column: str, days) -> Column:
    return F.col(column).between(*days) if days[0] is not None else F.lit(False)


def _one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of equal key the one whose content has the smallest hash, whatever their order."""
    content = F.xxhash64(*[F.to_json(F.struct(c)) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(content))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def _write(rows: DataFrame, root: str, name: str, attempt: str, stamp: str | None) -> None:
    day = snapshot_date(rows, stamp) if stamp else F.lit(None).cast("date")
    rows.withColumns({"date": day, "attempt": F.lit(attempt)}).write.mode("append").partitionBy("date", "attempt").parquet(f"{root}/{name}")


def _without(entity: str) -> Callable[[Column], Column]:
    return lambda row: row[entity].isNull()


def _rejected_rows(docs: DataFrame) -> DataFrame:
    """Documents that are none, and rows without an id, as JSON."""
    unread = docs.where("collected_at is null").select(
        F.lit("document").alias("feed"),
        F.when(F.col(CORRUPT).isNotNull(), "unreadable").otherwise("no time").alias("reason"),
        F.lit(None).cast("timestamp").alias("collected_at"),
        "raw_path",
        F.coalesce(CORRUPT, F.to_json(F.struct("collected_at", "feeds"))).alias("document"),
    )
    out = unread
    for feed, (items, entity) in FEED_ROWS.items():
        dated = docs.where("collected_at is not null")
        nameless = feed_rows(dated, feed, items, "collected_at", keep=["raw_path"], only=_without(entity))
        row = F.to_json(F.struct(*[c for c in nameless.columns if c not in ("collected_at", "raw_path")]))
        out = out.unionByName(
            nameless.select(F.lit(feed).alias("feed"), F.lit("no id").alias("reason"), "collected_at", "raw_path", row.alias("document"))
        )
    return out


def ingest(docs: DataFrame, root: str, batch: str) -> bool:
    """File documents (``snapshots.read_documents``) as one batch; False if that batch is already committed.

    Documents whose rows are all held already change nothing but the commit entry.
    """
    spark = docs.sparkSession
    if not commits(spark, root).where(F.col("batch") == batch).isEmpty():
        return False
    attempt = f"{batch}-{uuid.uuid4().hex}"
    raw = docs.where("collected_at is not null")
    times = raw.select("collected_at").distinct()
    days = raw.select(snapshot_date(raw).alias("d")).agg(F.min("d"), F.max("d")).first()
    for name, (normalize, schema, stamp, entity) in KEYED.items():
        rows = _one_per_key(normalize(raw).where(F.col(entity).isNotNull()), [stamp, entity])
        held = _held(spark, root, name, schema).where(_between("date", days)).select(stamp, entity)
        _write(rows.join(held, [stamp, entity], "left_anti").select(*schema.names), root, name, attempt, stamp)

    rejected = _rejected_rows(docs)
    marks = ["feed", "reason", "raw_path", "document"]
    new = _one_per_key(rejected, marks).join(read_rows(spark, root, "rejected").select(*marks), marks, "left_anti")
    _write(new.select(*REJECTED.names), root, "rejected", attempt, None)

    _write(_run_rows(spark, root, attempt, raw, times, days), root, "runs", attempt, "collected_at")
    spark.createDataFrame([(batch, attempt)], _COMMITS).coalesce(1).write.mode("append").json(f"{root}/commits")
    return True


def _run_rows(spark: SparkSession, root: str, attempt: str, raw: DataFrame, times: DataFrame, days) -> DataFrame:
    """Run rows of the touched times, counted over committed rows and those of this attempt."""

    def touched(name: str) -> DataFrame:
        schema = KEYED[name][1]
        own = _files(spark, root, name, schema).where(F.col("attempt") == attempt)
        both = _held(spark, root, name, schema).select(*own.columns).unionByName(own)
        return both.where(_between("date", days)).join(times, "collected_at", "left_semi")

    stations = touched("station_status").groupBy("collected_at").agg(
        F.count(F.lit(1)).cast("int").alias("station_count"),
        F.sum(F.coalesce("num_bikes_available", F.lit(0))).cast("int").alias("bikes_available"),
    )
    free = touched("free_bikes").groupBy("collected_at").agg(F.count(F.lit(1)).cast("int").alias("free_bike_count"))
    runs = raw.groupBy("collected_at").agg(F.min("raw_path").alias("raw_path"))
    joined = runs.join(stations, "collected_at", "left").join(free, "collected_at", "left")
    return joined.fillna(0, ["station_count", "bikes_available", "free_bike_count"]).select(*RUNS.names)
