"""Sources and sinks as queries: files are landed, picked up and changed, and a named table is kept in parts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.tables import Tables
from stationflow.functions.clock import DAY_US, epoch_us, floor_div
from stationflow.operators.stations import collection_runs
from stationflow.session import shared_folder
from stationflow.sources import history, tables

#: Days of change events in one file.
FILE_DAYS = 5
NETWORK = "city"


def _file_number(changes: DataFrame):
    return (floor_div(epoch_us(changes, "timestamp"), FILE_DAYS * DAY_US) % 100 + 202300).cast("string")


def _offer(changes: DataFrame, folder: str, network: str) -> None:
    """One file per number, ``<number>-<network>-stats.parquet``; files of that name are replaced."""
    spark = changes.sparkSession
    staged = f"{folder}-staged-{uuid.uuid4().hex}"
    numbered = changes.drop("file_name").withColumn("number", _file_number(changes)).repartition("number")
    numbered.write.partitionBy("number").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for part in files.globStatus(path(f"{staged}/number=*/part-*.parquet")):
        number = part.getPath().getParent().getName().split("=")[1]
        target = path(f"{folder}/{number}-{network}-stats.parquet")
        files.delete(target, False)
        files.rename(part.getPath(), target)


def picked_up(t: Tables) -> DataFrame:
    """Rows and version of each file after three takings: of files that lack stations (every second file) or later days, of the whole
    files beside another network's, and of the same again."""
    base = f"{shared_folder(t.spark)}/stationflow/history-{uuid.uuid4().hex}"
    offered, root, changes = f"{base}/offered", f"{base}/held", t.changes
    number = _file_number(changes).cast("int") % 4
    short = (number % 2 == 0) & (F.col("nuid").cast("long") % 3 == 0)
    _offer(changes.where((number != 3) & ~short), offered, NETWORK)
    history.pick_up(t.spark, offered, root, NETWORK)
    _offer(changes, offered, NETWORK)
    _offer(changes, offered, "other")
    taken = [history.pick_up(t.spark, offered, root, NETWORK) for _ in range(2)]
    if taken[1]:
        raise AssertionError("a file was taken again that had not changed")
    rows = history.read_held(t.spark, root)
    return rows.groupBy(history.month_key("file_name").alias("number"), "version").agg(
        F.count("*").alias("rows"), F.countDistinct("nuid").alias("stations"), F.sum("bikes").alias("bikes")
    )


def kept_table(t: Tables) -> DataFrame:
    """Run rows kept as a table by day, first without the stations that only later days have right, then with those days replaced."""
    name = f"runs_{uuid.uuid4().hex}"
    day = F.to_date("collected_at")
    early = t.status.where((F.dayofmonth("collected_at") <= 10) | (F.col("station_id").cast("long") % 2 == 0))
    tables.save_table(
        collection_runs(early, t.free_hourly).withColumn("day", day), name, ["day"], f"{shared_folder(t.spark)}/stationflow/{name}"
    )
    late = t.status.where(F.dayofmonth("collected_at") > 10)
    tables.replace_partitions(collection_runs(late, t.free_hourly).withColumn("day", day), name)
    return tables.load_table(t.spark, name, ["collected_at", "bikes_available"], ["collected_at"])


ON_FILES: dict[str, Callable[[Tables], DataFrame]] = {"history_pickup": picked_up, "kept_table": kept_table}
