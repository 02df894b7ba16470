"""Is the collection complete: counts, coverage, gaps between runs, freshness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import HOUR_US, SECOND_US, epoch_us, floor_div, seconds_between, time_like
from stationflow.functions.rules import require, round_to
from stationflow.plans.twolevel import with_previous


def _as_of_us(as_of: datetime | str):
    """The moment of asking, in UTC, in place of the clock of whichever machine runs the query."""
    wall = F.lit(str(as_of)).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), wall)


def recent(rows: DataFrame, since_hours: float | None, as_of: datetime | str | None) -> DataFrame:
    if since_hours is None:
        return rows
    require(as_of is not None, "as_of is needed with since_hours")
    # the bare column against a constant of its own type reaches the scan
    return rows.where(F.col("collected_at") >= time_like(rows, "collected_at", _as_of_us(as_of) - int(since_hours * HOUR_US)))


def run_gaps(runs: DataFrame) -> DataFrame:
    """(previous_collected_at, collected_at, gap_seconds) for every run but the first."""
    timed = runs.select("collected_at", epoch_us(runs, "collected_at").alias("us"))
    paired = with_previous(timed, [], "us", ["us", "collected_at"], "previous")
    return paired.where("previous is not null").select(
        F.col("previous.collected_at").alias("previous_collected_at"),
        "collected_at",
        seconds_between(F.col("previous.us"), F.col("us")).alias("gap_seconds"),
    )


def gap_summary(runs: DataFrame, gap_threshold_seconds: int = 120) -> DataFrame:
    gap = F.col("gap_seconds")
    return run_gaps(runs).agg(
        F.count_if(gap > gap_threshold_seconds).alias("gap_count"),
        F.max(gap).alias("max_gap_seconds"),
        round_to(F.avg(gap), 2).alias("avg_interval_seconds"),
        F.min(gap).alias("min_interval_seconds"),
    )


def data_gaps(runs: DataFrame, gap_threshold_seconds: int = 120, max_gaps: int = 10) -> DataFrame:
    gaps = run_gaps(runs).where(F.col("gap_seconds") > gap_threshold_seconds)
    return gaps.orderBy(F.col("gap_seconds").desc(), F.col("collected_at").desc()).limit(max_gaps)


def data_health(
    runs: DataFrame,
    status: DataFrame,
    free: DataFrame | None = None,
    expected_interval_seconds: int = 60,
    gap_threshold_seconds: int = 120,
    since_hours: float | None = None,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """One row of run counts, coverage, row counts and gap figures. ``free=None``: no such table."""
    require(expected_interval_seconds > 0, "expected_interval_seconds: above 0")
    runs, status = recent(runs, since_hours, as_of), recent(status, since_hours, as_of)
    summary = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.min("collected_at").alias("first_collected_at"),
        F.max("collected_at").alias("latest_collected_at"),
        F.min("station_count").alias("min_station_count"),
        round_to(F.avg("station_count"), 2).alias("avg_station_count"),
        F.max("station_count").alias("max_station_count"),
        F.min("bikes_available").alias("min_bikes_available"),
        round_to(F.avg("bikes_available"), 2).alias("avg_bikes_available"),
        F.max("bikes_available").alias("max_bikes_available"),
        (F.count(F.lit(1)) - F.countDistinct("collected_at")).alias("duplicate_collected_at"),
    )
    elapsed = epoch_us(summary, "latest_collected_at") - epoch_us(summary, "first_collected_at")
    expected = floor_div(elapsed, expected_interval_seconds * SECOND_US) + 1
    stations = status.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.countDistinct("station_id").alias("stations"))
    ).scalar()
    free_rows = F.lit(None).cast("long")
    if free is not None:
        free_rows = recent(free, since_hours, as_of).agg(F.count(F.lit(1)).alias("n")).scalar()
    gaps = gap_summary(runs, gap_threshold_seconds).select(F.struct("*")).scalar()
    return summary.select(
        "*",
        expected.alias("expected_samples"),
        round_to(F.col("runs") / expected * 100, 2).alias("coverage_pct"),
        stations.getField("rows").alias("station_rows"),
        stations.getField("stations").alias("distinct_stations"),
        free_rows.alias("free_bike_rows"),
        *[
            gaps.getField(name).alias(name)
            for name in ["gap_count", "max_gap_seconds", "avg_interval_seconds", "min_interval_seconds"]
        ],
    )


def freshness(runs: DataFrame, free: DataFrame | None, as_of: datetime | str) -> DataFrame:
    """The newest run, its age, and its vehicle rows in the table."""
    newest = runs.agg(F.max(F.struct("collected_at", "station_count", "bikes_available", "free_bike_count")).alias("r"))
    row = newest.select("r.*").where("collected_at is not null")
    age = floor_div(_as_of_us(as_of) - epoch_us(row, "collected_at"), SECOND_US)
    found = F.lit(None).cast("long")
    if free is not None:
        latest = runs.agg(F.max("collected_at").alias("latest")).scalar()
        found = free.where(F.col("collected_at") == latest).agg(F.count(F.lit(1)).alias("n")).scalar()
    return row.select("*", age.alias("seconds_since_latest"), found.alias("latest_free_bike_rows"))
