"""Stations and snapshots: latest state, rankings, single-station views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.rules import require, round_to, share, stock_risk, tally

DIMENSION = ["name", "short_name", "region_id", "lat", "lon", "capacity"]


def latest_station_info(info: DataFrame) -> DataFrame:
    """Newest row per station. The information table repeats on every snapshot with the same values, so it
    is first reduced to distinct descriptions, combined before the shuffle.

    A table without ``observed_at`` is taken as already reduced: a job that needs the dimension often
    keeps it as a settled table, whose known size lets the planner broadcast it.
    """
    if "observed_at" not in info.columns:
        return info.select("station_id", *DIMENSION)
    described = info.groupBy("station_id", *DIMENSION).agg(F.max("observed_at").alias("observed_at"))
    newest = described.groupBy("station_id").agg(F.max(F.struct("observed_at", *DIMENSION)).alias("row"))
    return newest.select("station_id", *[F.col(f"row.{name}").alias(name) for name in DIMENSION])


def station_label() -> Column:
    return F.coalesce("name", "station_id")


def latest_time(rows: DataFrame) -> Column:
    """Newest ``collected_at`` as a scalar; as a filter value it reaches the scan."""
    return rows.agg(F.max("collected_at").alias("latest")).scalar()


def latest_rows(status: DataFrame, runs: DataFrame) -> DataFrame:
    """Status rows of the newest run, which may be none."""
    return status.where(F.col("collected_at") == latest_time(runs))


def collection_runs(status: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """Run rows from the normalised tables."""
    stations = status.groupBy("collected_at").agg(
        F.count(F.lit(1)).alias("station_count"),
        F.sum(F.coalesce("num_bikes_available", F.lit(0))).alias("bikes_available"),
    )
    if free is None:
        return stations.withColumn("free_bike_count", F.lit(0).cast("long"))
    bikes = free.groupBy("collected_at").agg(F.count(F.lit(1)).alias("free_bike_count"))
    return stations.join(bikes, "collected_at", "left").fillna(0, ["free_bike_count"])


def db_stats(runs: DataFrame, status: DataFrame) -> DataFrame:
    newest = ["station_count", "bikes_available", "free_bike_count", *[c for c in ["raw_path"] if c in runs.columns]]
    totals = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.min("collected_at").alias("first_collected_at"),
        F.max("collected_at").alias("latest_collected_at"),
        F.sum("station_count").alias("station_status_rows"),
        F.max("station_count").alias("max_station_count"),
        F.max("bikes_available").alias("max_bikes_available"),
        F.max(F.struct("collected_at", *newest)).alias("newest"),
    )
    return totals.select(
        *totals.columns[:-1],
        status.agg(F.countDistinct("station_id").alias("n")).scalar().alias("distinct_stations"),
        *[F.col(f"newest.{name}").alias(f"latest_{name}") for name in newest],
    )


def db_summary(runs: DataFrame, status: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("collection_runs"),
        F.min("collected_at").alias("first_collected_at"),
        F.max("collected_at").alias("latest_collected_at"),
        F.sum("station_count").alias("station_rows"),
        F.sum("free_bike_count").alias("free_bike_rows"),
        F.min("bikes_available").alias("min_bikes_available"),
        round_to(F.avg("bikes_available"), 2).alias("avg_bikes_available"),
        F.max("bikes_available").alias("max_bikes_available"),
    ).withColumn("distinct_stations", status.agg(F.countDistinct("station_id").alias("n")).scalar())


def _state_aggregates() -> list[Column]:
    bikes = F.col("num_bikes_available")
    return [
        tally(bikes == 0).alias("empty_stations"),
        tally(bikes > 0).alias("stations_with_bikes"),
        round_to(F.avg(bikes), 2).alias("avg_bikes_per_station"),
        F.max(bikes).alias("max_bikes_at_station"),
    ]


def latest_snapshot(runs: DataFrame, status: DataFrame) -> DataFrame:
    """The newest run with its station figures; no row if it has no status rows."""
    state = latest_rows(status, runs).groupBy("collected_at").agg(*_state_aggregates())
    return runs.where(F.col("collected_at") == latest_time(runs)).join(state, "collected_at")


def system_trend(runs: DataFrame, status: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs that have status rows; status is reduced per run before it meets the runs."""
    state = status.groupBy("collected_at").agg(*_state_aggregates()).drop("stations_with_bikes")
    trend = runs.select("collected_at", "bikes_available", "free_bike_count").join(state, "collected_at")
    return trend.orderBy(F.col("collected_at").desc()).limit(limit)


def _named_latest(status: DataFrame, runs: DataFrame, info: DataFrame) -> DataFrame:
    named = latest_rows(status, runs).join(latest_station_info(info), "station_id", "left")
    return named.withColumn("name", station_label())


def top_stations_latest(status: DataFrame, runs: DataFrame, info: DataFrame, limit: int = 15) -> DataFrame:
    columns = _named_latest(status, runs, info).select(
        "station_id",
        "name",
        "region_id",
        "num_bikes_available",
        "num_docks_available",
        F.timestamp_seconds("last_reported").alias("last_reported"),
    )
    return columns.orderBy(F.col("num_bikes_available").desc(), "name", "station_id").limit(limit)


def _per_station(status: DataFrame, info: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregate by station first; the dimension only meets one row per station."""
    grouped = status.groupBy("station_id").agg(*aggregates)
    named = grouped.join(latest_station_info(info), "station_id", "left").withColumn("name", station_label())
    return named.select("station_id", "name", "region_id", *grouped.columns[1:])


def top_stations_avg(status: DataFrame, info: DataFrame, limit: int = 15) -> DataFrame:
    bikes = F.col("num_bikes_available")
    table = _per_station(
        status,
        info,
        round_to(F.avg(bikes), 2).alias("avg_bikes_available"),
        F.max(bikes).alias("max_bikes_available"),
        F.count(F.lit(1)).alias("samples"),
    )
    return table.orderBy(F.col("avg_bikes_available").desc(), "name", "station_id").limit(limit)


def empty_stations_latest(status: DataFrame, runs: DataFrame, info: DataFrame, limit: int = 30) -> DataFrame:
    empty = _named_latest(status.where(F.col("num_bikes_available") == 0), runs, info)
    columns = empty.select(
        "station_id", "name", "region_id", F.timestamp_seconds("last_reported").alias("last_reported")
    )
    return columns.orderBy("name", "station_id").limit(limit)


def empty_stations_rate(status: DataFrame, info: DataFrame, limit: int = 30) -> DataFrame:
    bikes = F.col("num_bikes_available")
    table = _per_station(
        status,
        info,
        round_to(share(bikes == 0), 3).alias("empty_rate"),
        F.count(F.lit(1)).alias("samples"),
        round_to(F.avg(bikes), 2).alias("avg_bikes_available"),
    )
    return table.orderBy(F.col("empty_rate").desc(), F.col("samples").desc(), "name", "station_id").limit(limit)


def station_search(info: DataFrame, station_ref: str, limit: int = 25) -> DataFrame:
    """Stations whose id equals, or whose name or short name contains, the text."""
    needle = F.lower(F.lit(station_ref))
    exact = F.col("station_id") == station_ref
    stations = latest_station_info(info).drop("capacity")
    found = stations.where(
        exact
        | F.coalesce(F.contains(F.lower("name"), needle), F.lit(False))
        | F.contains(F.lower(F.coalesce("short_name", F.lit(""))), needle)
    )
    return found.orderBy(F.when(exact, 0).otherwise(1), F.col("name").asc_nulls_last(), "station_id").limit(limit)


def _one(status: DataFrame, station_id: str | None) -> DataFrame:
    return status if station_id is None else status.where(F.col("station_id") == station_id)


def station_latest(status: DataFrame, station_id: str | None = None) -> DataFrame:
    """Newest status per station, or of one station."""
    columns = ["num_bikes_available", "num_docks_available", "is_renting", "is_returning", "last_reported"]
    newest = (
        _one(status, station_id).groupBy("station_id").agg(F.max(F.struct("collected_at", *columns)).alias("row"))
    )
    latest = newest.select("station_id", "row.*")
    return latest.withColumns(
        {"last_reported": F.timestamp_seconds("last_reported"), "risk": stock_risk(F.col("num_bikes_available"))}
    )


def station_profile(status: DataFrame, station_id: str | None = None) -> DataFrame:
    bikes = F.col("num_bikes_available")
    return (
        _one(status, station_id)
        .groupBy("station_id")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            round_to(F.avg(bikes), 2).alias("avg_bikes"),
            F.min(bikes).alias("min_bikes"),
            F.max(bikes).alias("max_bikes"),
            round_to(share(bikes == 0), 3).alias("empty_rate"),
        )
    )


def station_recent(status: DataFrame, samples: int = 20, station_id: str | None = None) -> DataFrame:
    """Last samples per station. Each task keeps only its own newest rows of a station before the
    shuffle, so a station with many rows costs no more than ``samples`` per task."""
    require(samples > 0, "samples: above 0")
    newest = Window.partitionBy("station_id").orderBy(F.col("collected_at").desc())
    recent = _one(status, station_id).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= samples)
    return recent.select(
        "station_id",
        "collected_at",
        "num_bikes_available",
        stock_risk(F.col("num_bikes_available")).alias("risk"),
        "num_docks_available",
        "is_renting",
        "is_returning",
    )


def station_map_summary(status: DataFrame, runs: DataFrame) -> DataFrame:
    bikes = F.coalesce("num_bikes_available", F.lit(0))
    return (
        latest_rows(status, runs)
        .groupBy("collected_at")
        .agg(
            F.count(F.lit(1)).alias("station_count"),
            F.sum(bikes).alias("bikes_available"),
            F.count_if(bikes == 0).alias("empty_stations"),
        )
    )


def station_map_points(status: DataFrame, runs: DataFrame, info: DataFrame, include_empty: bool = True) -> DataFrame:
    named = _named_latest(status, runs, info).where("lat is not null and lon is not null")
    if not include_empty:
        named = named.where("num_bikes_available > 0")
    return named.select(
        "station_id",
        "name",
        "region_id",
        "lat",
        "lon",
        F.coalesce("num_bikes_available", F.lit(0)).alias("bikes"),
        F.col("num_docks_available").alias("docks"),
    )
