"""Availability around a point, from the snapshot panel."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import epoch_us, hour_label
from stationflow.functions.geo import distance_m, whole_metres
from stationflow.functions.rules import require, require_point, round_to, share, tally
from stationflow.operators.stations import latest_station_info, latest_time, station_label
from stationflow.plans.restrict import restrict
from stationflow.plans.twolevel import with_previous
from stationflow.session import settle

MORNING_SIGNALS = ("05:00", "12:00")  # fixed value: hours scanned for signals, both ends included
LOW_AVERAGE = 1.0  # fixed value: area average that counts as nearly no bikes


def area_stations_table(info: DataFrame, lat: float, lon: float) -> DataFrame:
    """Latest stations with whole metres to the point; NULL without a position."""
    metres = whole_metres(distance_m(lat, lon, F.col("lat"), F.col("lon")))
    stations = latest_station_info(info).withColumn("name", station_label()).withColumn("distance_m", metres)
    return stations.select("station_id", "name", "region_id", "lat", "lon", "distance_m")


@dataclass
class Area:
    """Stations within a radius and their snapshot rows.

    The stations in the radius are settled once; their ids cut the panel at the scan.
    """

    status: DataFrame
    info: DataFrame
    lat: float
    lon: float
    radius_m: int = 600
    tz: str = "Europe/Prague"

    def __post_init__(self) -> None:
        require_point(self.lat, self.lon)
        require(self.radius_m > 0, "radius_m: above 0")

    @cached_property
    def stations(self) -> DataFrame:
        near = area_stations_table(self.info, self.lat, self.lon).where(F.col("distance_m") <= self.radius_m)
        return settle(near, "area")

    @cached_property
    def rows(self) -> DataFrame:
        return restrict(self.status, "station_id", self.stations)

    def coverage(self) -> DataFrame:
        return self.rows.agg(
            F.min("collected_at").alias("first_collected"),
            F.max("collected_at").alias("latest_collected"),
            F.countDistinct("collected_at").alias("snapshots"),
            F.count(F.lit(1)).alias("station_rows"),
            F.countDistinct("station_id").alias("stations"),
        )

    def _at_latest(self) -> DataFrame:
        """Rows at the newest time of the whole panel, not of the area."""
        return self.rows.where(F.col("collected_at") == latest_time(self.status))

    def latest(self) -> DataFrame:
        bikes = F.col("num_bikes_available")
        return self._at_latest().agg(
            F.sum(bikes).alias("total_bikes"),
            tally(bikes > 0).alias("stations_with_bikes"),
            tally(bikes == 0).alias("empty_stations"),
        )

    def station_table(self, limit: int = 12) -> DataFrame:
        require(limit > 0, "limit: above 0")
        bikes = F.col("num_bikes_available")
        history = self.rows.groupBy("station_id").agg(
            F.count(F.lit(1)).alias("samples"),
            round_to(F.avg(bikes), 2).alias("avg_bikes"),
            round_to(share(bikes == 0), 3).alias("empty_rate"),
            round_to(share(bikes <= 1), 3).alias("low_rate"),
        )
        latest = self._at_latest().select("station_id", bikes.alias("latest_bikes"))
        joined = self.stations.join(latest, "station_id", "left").join(history, "station_id", "left")
        filled = joined.fillna(0, ["latest_bikes", "avg_bikes", "empty_rate", "low_rate", "samples"])
        table = filled.select(
            "station_id", "name", "latest_bikes", "distance_m", "avg_bikes", "empty_rate", "low_rate", "samples"
        )
        return table.orderBy("distance_m", "name", "station_id").limit(limit)

    def hourly(self) -> DataFrame:
        bikes = F.col("num_bikes_available")
        per_time = self.rows.groupBy("collected_at").agg(
            F.sum(bikes).alias("total"), tally(bikes > 0).alias("stocked"), tally(bikes == 0).alias("empty")
        )
        hour = hour_label(epoch_us(per_time, "collected_at"), self.tz).alias("local_hour")
        return per_time.groupBy(hour).agg(
            F.count(F.lit(1)).alias("samples"),
            round_to(F.avg("total"), 2).alias("avg_total_bikes"),
            round_to(F.avg("stocked"), 2).alias("avg_stations_with_bikes"),
            round_to(F.avg("empty"), 2).alias("avg_empty_stations"),
            round_to(share(F.col("stocked") == 0), 3).alias("all_empty_rate"),
        )

    def depletions(self) -> DataFrame:
        """Rows where a station runs out: bikes in its row before, none now."""
        timed = self.rows.select(
            "station_id", "collected_at", "num_bikes_available", epoch_us(self.rows, "collected_at").alias("us")
        )
        paired = with_previous(timed, ["station_id"], "us", ["num_bikes_available"], "previous")
        return paired.where((F.col("previous.num_bikes_available") > 0) & (F.col("num_bikes_available") == 0))

    def depletion_by_hour(self) -> DataFrame:
        return (
            self.depletions()
            .groupBy(hour_label(F.col("us"), self.tz).alias("local_hour"))
            .agg(F.count(F.lit(1)).alias("depletion_events"))
            .orderBy(F.col("depletion_events").desc(), "local_hour")
        )

    def morning_signals(self) -> DataFrame:
        return morning_signals(self.hourly())


def morning_signals(hourly: DataFrame) -> DataFrame:
    """First morning hours with hardly any bikes, with any all-empty sample, always empty."""
    first = {
        "first_low_hour": F.col("avg_total_bikes") <= LOW_AVERAGE,
        "first_all_empty_hour": F.col("all_empty_rate") > 0,
        "first_fully_empty_hour": F.col("all_empty_rate") >= 1,
    }
    morning = hourly.where(F.col("local_hour").between(*MORNING_SIGNALS))
    return morning.agg(
        *[
            F.coalesce(F.min(F.when(condition, F.col("local_hour"))), F.lit("not observed")).alias(name)
            for name, condition in first.items()
        ]
    )
