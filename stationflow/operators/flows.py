"""Vehicle flows from the id lists in the station change log."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import epoch_us, hour_label, minutes_between, month_label, time_like
from stationflow.functions.geo import distance_m, whole_metres
from stationflow.functions.rules import require, require_point, round_to
from stationflow.operators.history import station_catalog, with_distance
from stationflow.plans.bins import ROWS_PER_BIN, day_cuts, in_bins
from stationflow.plans.restrict import restrict
from stationflow.plans.twolevel import previous_and_last
from stationflow.session import settle

FLOW_MORNING = ("05:00", "10:00")  # fixed value: hours of the morning totals, both ends included


def bike_uid_events(changes: DataFrame) -> DataFrame:
    """One row per vehicle listed in a change event."""
    uids = F.from_json("extra", "bike_uids array<string>")["bike_uids"]
    listed = changes.where("extra is not null and nuid is not null")
    return listed.select("timestamp", "nuid", F.explode(uids).alias("bike_uid"))


@dataclass
class Flows:
    """Station changes of vehicles within a time window, and their direction across a radius.

    Sightings are windowed in bins of even size along each vehicle's time, so one that is seen in a large part of all rows
    is spread over many tasks. Station names and distances join only the moves that remain.
    """

    changes: DataFrame
    lat: float
    lon: float
    radius_m: int = 600
    max_window_minutes: int = 720
    tz: str = "Europe/Prague"
    catalog: DataFrame | None = None
    rows_per_bin: int = ROWS_PER_BIN

    def __post_init__(self) -> None:
        require_point(self.lat, self.lon)
        require(self.max_window_minutes > 0, "max_window_minutes: above 0")
        if self.catalog is None:
            self.catalog = settle(station_catalog(self.changes), "catalog")

    @cached_property
    def moves(self) -> DataFrame:
        stations = with_distance(self.catalog, self.lat, self.lon)
        unplaced = self.catalog.where("latitude is null or longitude is null")
        seen = bike_uid_events(restrict(self.changes, "nuid", unplaced, keep=False))
        seen = seen.select("bike_uid", "nuid", epoch_us(seen, "timestamp").alias("us"))
        cuts = day_cuts(seen, ["bike_uid"], "us", self.rows_per_bin)
        binned = in_bins(seen, ["bike_uid"], "us", cuts)
        tracks, _ = previous_and_last(binned, ["bike_uid"], "us", ["us", "nuid"], "prev", ties=["nuid"])
        paired = tracks.withColumn("window_minutes", minutes_between(F.col("prev.us"), F.col("us")))
        moved = paired.where((F.col("nuid") != F.col("prev.nuid")) & (F.col("window_minutes") <= self.max_window_minutes))
        here = stations.select("nuid", "station_name", "latitude", "longitude", "distance_m")
        there = here.select(*[F.col(c).alias(f"prev_{c}") for c in here.columns])
        joined = moved.withColumn("prev_nuid", F.col("prev.nuid")).join(here, "nuid").join(there, "prev_nuid")
        metres = distance_m(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
        return joined.select(
            "bike_uid",
            time_like(self.changes, "timestamp", F.col("prev.us")).alias("prev_timestamp"),
            time_like(self.changes, "timestamp", F.col("us")).alias("timestamp"),
            "prev_nuid",
            F.col("prev_station_name").alias("prev_name"),
            "prev_distance_m",
            "nuid",
            "station_name",
            "distance_m",
            "window_minutes",
            whole_metres(metres).alias("move_m"),
            hour_label(F.col("prev.us"), self.tz).alias("local_hour"),
            month_label(F.col("prev.us"), self.tz).alias("local_month"),
        )

    def hold(self) -> Flows:
        """Settle the moves, for a report that derives many tables from them."""
        self.moves = settle(self.moves, "moves")
        return self

    def _directions(self) -> dict[str, Column]:
        was_in = F.col("prev_distance_m") <= self.radius_m
        is_in = F.col("distance_m") <= self.radius_m
        return {"outbound": was_in & ~is_in, "inbound": ~was_in & is_in, "internal": was_in & is_in}

    def _counts(self) -> list[Column]:
        return [F.count_if(condition).alias(name) for name, condition in self._directions().items()]

    def _by(self, label: str) -> DataFrame:
        counts = self.moves.groupBy(label).agg(*self._counts())
        return counts.withColumn("net_outbound", F.col("outbound") - F.col("inbound"))

    def hourly(self) -> DataFrame:
        return self._by("local_hour")

    def monthly(self) -> DataFrame:
        return self._by("local_month")

    def _outbound(self) -> DataFrame:
        return self.moves.where(self._directions()["outbound"])

    def destinations(self, limit: int = 20) -> DataFrame:
        reached = self._outbound().groupBy("nuid", "station_name").agg(
            F.max("distance_m").alias("distance_m"),
            F.count(F.lit(1)).alias("moves"),
            round_to(F.avg("window_minutes"), 1).alias("avg_window_minutes"),
            round_to(F.avg("move_m"), 0).alias("avg_move_m"),
        )
        return reached.orderBy(F.col("moves").desc(), F.col("station_name").asc_nulls_last(), "nuid").limit(limit)

    def origins(self) -> DataFrame:
        left = self._outbound().groupBy(F.col("prev_nuid").alias("nuid"), F.col("prev_name").alias("station_name"))
        counted = left.agg(F.max("prev_distance_m").alias("distance_m"), F.count(F.lit(1)).alias("outbound"))
        return counted.orderBy(F.col("outbound").desc(), F.col("station_name").asc_nulls_last(), "nuid")

    def summary(self) -> DataFrame:
        """Counted per vehicle first, so the distinct count needs no second pass over the moves."""
        names = list(self._directions())
        per_bike = self.moves.groupBy("bike_uid").agg(F.count(F.lit(1)).alias("n"), *self._counts())
        totals = [F.coalesce(F.sum(c), F.lit(0)).alias(o) for c, o in [("n", "all_city_moves"), *zip(names, names)]]
        return per_bike.agg(*totals, F.count("bike_uid").alias("bikes"))

    def morning_totals(self) -> DataFrame:
        morning = self.hourly().where(F.col("local_hour").between(*FLOW_MORNING))
        return morning.agg(
            F.coalesce(F.sum("outbound"), F.lit(0)).alias("morning_out"),
            F.coalesce(F.sum("inbound"), F.lit(0)).alias("morning_in"),
        )
