"""Vehicle moves and departures inferred from sightings in the vehicle feed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import epoch_us, hour_label, minute_label, minutes_between
from stationflow.functions.geo import distance_m, whole_metres
from stationflow.functions.rules import require, require_point, round_to
from stationflow.operators.area import area_stations_table
from stationflow.plans.bins import ROWS_PER_BIN, day_cuts, in_bins
from stationflow.plans.twolevel import previous_and_last
from stationflow.session import settle

SEEN = ["collected_at", "us", "station_id", "lat", "lon"]
EVENT = [
    "status",
    "departed_after",
    "next_seen_at",
    "local_departed_after",
    "bike_id",
    "from_name",
    "to_name",
    "from_station_id",
    "to_station_id",
    "from_origin_distance_m",
    "to_origin_distance_m",
    "window_minutes",
    "move_distance_m",
]


def _differs(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))


def _move_metres(prev: str) -> Column:
    return whole_metres(distance_m(F.col(f"{prev}.lat"), F.col(f"{prev}.lon"), F.col("lat"), F.col("lon")))


@dataclass
class Movements:
    """Sightings of vehicles, and what happened between two of them.

    ``stations`` (id, name, metres to the point) is settled once; it is joined to moves that passed
    all other filters, never to the sightings.
    """

    free: DataFrame
    info: DataFrame
    lat: float
    lon: float
    radius_m: int = 600
    max_window_minutes: int = 240
    open_after_minutes: int = 3
    min_move_m: int = 100
    tz: str = "Europe/Prague"
    rows_per_bin: int = ROWS_PER_BIN

    def __post_init__(self) -> None:
        require_point(self.lat, self.lon)
        require(self.radius_m > 0, "radius_m: above 0")
        require(self.max_window_minutes > 0, "max_window_minutes: above 0")
        require(self.open_after_minutes > 0, "open_after_minutes: above 0")
        require(self.min_move_m >= 0, "min_move_m: 0 or more")

    @cached_property
    def stations(self) -> DataFrame:
        table = area_stations_table(self.info, self.lat, self.lon).select("station_id", "name", "distance_m")
        return settle(table, "stations")

    @cached_property
    def sightings(self) -> DataFrame:
        return self.free.select("bike_id", "collected_at", epoch_us(self.free, "collected_at").alias("us"), *SEEN[2:])

    @cached_property
    def _tracks(self) -> tuple[DataFrame, DataFrame]:
        """Sightings with the one before, and each vehicle's last sighting, from one pass over the sightings in bins of even size."""
        cuts = day_cuts(self.sightings, ["bike_id"], "us", self.rows_per_bin)
        binned = in_bins(self.sightings, ["bike_id"], "us", cuts)
        return previous_and_last(binned, ["bike_id"], "us", SEEN, "prev", ties=["station_id"])

    def _place(self, rows: DataFrame, id_column: str, prefix: str) -> DataFrame:
        """Add name and distance of a station id; ids unknown to the table keep their id as name."""
        places = self.stations.select(
            F.col("station_id").alias(id_column),
            F.col("name").alias(f"{prefix}name"),
            F.col("distance_m").alias(f"{prefix}origin_distance_m"),
        )
        named = F.coalesce(f"{prefix}name", id_column, F.lit("free-floating"))
        return rows.join(places, id_column, "left").withColumn(f"{prefix}name", named)

    def observations(self) -> DataFrame:
        """Every sighting with the one before it, however long ago."""
        paired, _ = self._tracks
        flat = paired.withColumns({f"previous_{c}": F.col(f"prev.{c}") for c in SEEN}).withColumns(
            {
                "window_minutes": minutes_between(F.col("previous_us"), F.col("us")),
                "move_distance_m": _move_metres("prev"),
            }
        )
        placed = self._place(self._place(flat, "station_id", "cur_"), "previous_station_id", "was_")
        had = F.col("previous_collected_at").isNotNull()
        return placed.select(
            "bike_id",
            "collected_at",
            "station_id",
            F.col("cur_name").alias("station_name"),
            "lat",
            "lon",
            F.col("cur_origin_distance_m").alias("origin_distance_m"),
            "previous_collected_at",
            "previous_station_id",
            F.when(had, F.col("was_name")).alias("previous_station_name"),
            "previous_lat",
            "previous_lon",
            F.col("was_origin_distance_m").alias("previous_origin_distance_m"),
            "window_minutes",
            "move_distance_m",
        )

    def bike_moves(self) -> DataFrame:
        return self.observations().where("previous_collected_at is not null")

    @cached_property
    def _recent_pairs(self) -> DataFrame:
        """Sightings with the one before, where that lies within the window."""
        paired, _ = self._tracks
        timed = paired.withColumn("window_minutes", minutes_between(F.col("prev.us"), F.col("us")))
        return timed.where(F.col("prev").isNotNull() & (F.col("window_minutes") <= self.max_window_minutes))

    def _seen_again(self, pairs: DataFrame) -> DataFrame:
        rows = pairs.select(
            F.lit("seen-again").alias("status"),
            F.col("prev.collected_at").alias("departed_after"),
            F.col("collected_at").alias("next_seen_at"),
            minute_label(F.col("prev.us"), self.tz).alias("local_departed_after"),
            F.col("prev.us").alias("departed_us"),
            "bike_id",
            F.col("prev.station_id").alias("from_station_id"),
            F.col("station_id").alias("to_station_id"),
            "window_minutes",
            _move_metres("prev").alias("move_distance_m"),
        )
        return self._place(self._place(rows, "from_station_id", "from_"), "to_station_id", "to_")

    def _not_seen(self) -> DataFrame:
        """Last sightings at a station in the radius that are old enough to count as departed."""
        _, last = self._tracks
        now_us = last.agg(F.max("us").alias("us")).scalar()
        age = minutes_between(F.col("us"), now_us)
        old = last.where("station_id is not null").where(age >= self.open_after_minutes)
        null = F.lit(None)
        rows = old.select(
            F.lit("not-seen").alias("status"),
            F.col("collected_at").alias("departed_after"),
            null.cast(dict(self.free.dtypes)["collected_at"]).alias("next_seen_at"),
            minute_label(F.col("us"), self.tz).alias("local_departed_after"),
            F.col("us").alias("departed_us"),
            "bike_id",
            F.col("station_id").alias("from_station_id"),
            null.cast("string").alias("to_station_id"),
            F.lit("not seen again").alias("to_name"),
            null.cast("int").alias("to_origin_distance_m"),
            age.alias("window_minutes"),
            null.cast("int").alias("move_distance_m"),
        )
        return self._place(rows, "from_station_id", "from_").where(self._inside("from_"))

    def _inside(self, prefix: str) -> Column:
        return F.coalesce(F.col(f"{prefix}origin_distance_m") <= self.radius_m, F.lit(False))

    @cached_property
    def _moves(self) -> DataFrame:
        """A changed station or a long enough hop, touching the radius at either end; and open ends."""
        changed = _differs(F.col("prev.station_id"), F.col("station_id"))
        far = F.coalesce(_move_metres("prev"), F.lit(0)) >= self.min_move_m
        again = self._seen_again(self._recent_pairs.where(changed | far))
        touching = again.where(self._inside("from_") | self._inside("to_"))
        return touching.unionByName(self._not_seen())

    def hold(self) -> Movements:
        """Settle the departures, for a report that derives many tables from them."""
        self._known_departures = settle(self._known_departures, "departures")
        self._departures = settle(self._departures, "departures")
        return self

    @cached_property
    def _known_departures(self) -> DataFrame:
        """Left a known station in the radius and was seen elsewhere."""
        previous = F.col("prev.station_id")
        left = self._recent_pairs.where(previous.isNotNull() & _differs(previous, F.col("station_id")))
        return self._seen_again(left).where(self._inside("from_"))

    @cached_property
    def _departures(self) -> DataFrame:
        return self._known_departures.unionByName(self._not_seen())

    @staticmethod
    def _newest(events: DataFrame, limit: int | None) -> DataFrame:
        shown = events.select(*EVENT)
        if limit is None:
            return shown
        require(limit > 0, "limit: above 0")
        return shown.orderBy(F.col("departed_after").desc(), "bike_id", "status").limit(limit)

    def move_events(self, limit: int | None = 30) -> DataFrame:
        return self._newest(self._moves, limit)

    def departures(self, limit: int | None = 30) -> DataFrame:
        return self._newest(self._departures, limit)

    @staticmethod
    def _counts() -> list[Column]:
        return [
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "seen-again").alias("known"),
            F.count_if(F.col("status") == "not-seen").alias("open"),
            F.sum("window_minutes").alias("minutes"),
            F.min("departed_after").alias("first"),
            F.max("departed_after").alias("latest"),
        ]

    def move_summary(self) -> DataFrame:
        per_bike = self._moves.groupBy("bike_id").agg(*self._counts())
        return per_bike.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("moves"),
            F.count("bike_id").alias("bikes"),
            F.coalesce(F.sum("known"), F.lit(0)).alias("known_destination_moves"),
            F.coalesce(F.sum("open"), F.lit(0)).alias("open_departures"),
            F.min("first").alias("first_move"),
            F.max("latest").alias("latest_move"),
        )

    def departures_hourly(self) -> DataFrame:
        """Counted per (hour, vehicle) first, which also gives the distinct vehicles."""
        hour = hour_label(F.col("departed_us"), self.tz).alias("local_hour")
        per_bike = self._departures.groupBy(hour, "bike_id").agg(*self._counts())
        return per_bike.groupBy("local_hour").agg(
            F.sum("n").alias("departures"),
            F.count("bike_id").alias("bikes"),
            F.sum("known").alias("known_destinations"),
            F.sum("open").alias("open_departures"),
            round_to(F.sum("minutes") / F.sum("n"), 1).alias("avg_window_minutes"),
        )

    def departure_destinations(self, limit: int = 30) -> DataFrame:
        pairs = self._known_departures.groupBy("from_name", "to_name").agg(
            F.count(F.lit(1)).alias("departures"),
            round_to(F.avg("window_minutes"), 1).alias("avg_window_minutes"),
            round_to(F.avg("move_distance_m"), 0).alias("avg_move_distance_m"),
        )
        return pairs.orderBy(F.col("departures").desc(), "from_name", "to_name").limit(limit)

    def departure_summary(self) -> DataFrame:
        """Counted per vehicle and station first; both distinct counts run over those pairs."""
        pairs = self._departures.groupBy("bike_id", "from_station_id").agg(*self._counts())
        return pairs.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("departures"),
            F.countDistinct("bike_id").alias("bikes"),
            F.countDistinct("from_station_id").alias("origin_stations"),
            F.coalesce(F.sum("known"), F.lit(0)).alias("known_destinations"),
            F.coalesce(F.sum("open"), F.lit(0)).alias("open_departures"),
            F.min("first").alias("first_departure"),
            F.max("latest").alias("latest_departure"),
        )
