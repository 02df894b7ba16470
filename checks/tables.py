"""Station tables derived from the given ``events`` and ``customer`` tables.

A user is a station, the number in ``props`` is a vehicle. All tables are built by Spark from the whole
inputs, so every query grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.functions.clock import HOUR_US, SECOND_US, epoch_us, floor_div, utc_wall
from stationflow.operators.stations import collection_runs
from stationflow.session import settle

ORIGIN = (49.199088, 16.607361)
RADIUS_M = 1600
TZ = "Europe/Prague"
#: Stations, or vehicles, that one snapshot document holds, about.
DOCUMENT_ROWS = 20


_KNOWN: dict[tuple[str, str], Tables] = {}


def stored(build):
    """A table that is written once, as the library's users keep theirs, and read from then on."""

    def write(self):
        return settle(build(self), build.__name__)

    return cached_property(write)


@dataclass
class Tables:
    spark: SparkSession
    folder: str

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Tables:
        """The tables of a folder; those stored once stay stored for the session."""
        key = (spark.sparkContext.applicationId, folder)
        return _KNOWN.setdefault(key, cls(spark, folder))

    def kept(self, name: str, build: Callable):
        """What ``build`` gives, made once and kept with these tables."""
        have = self.__dict__.setdefault("_kept", {})
        if name not in have:
            have[name] = build()
        return have[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        raw = self.read("events")
        us = epoch_us(raw, "ts")
        unknown = (F.col("event_type") == "error") & (F.col("value") > 100)
        return raw.select(
            "ts",
            us.alias("us"),
            utc_wall(floor_div(us, HOUR_US) * HOUR_US).alias("hour_ts"),
            "user_id",
            F.col("user_id").cast("string").alias("station_id"),
            "event_type",
            F.get_json_object("props", "$.k").alias("bike_id"),
            F.when(~unknown, (F.floor("value") % 4).cast("int")).alias("bikes"),
        )

    @stored
    def stations(self) -> DataFrame:
        key = F.col("c_custkey")
        placed = key % 29 != 0
        used = self.read("events").select(F.col("user_id").alias("c_custkey")).distinct()
        return self.read("customer").join(used, "c_custkey", "left_semi").select(
            key.cast("string").alias("station_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("S-"), (key % 50).cast("string")).alias("short_name"),
            F.when(placed, 49.15 + (key * 37 % 101) * 0.001).alias("lat"),
            F.when(placed, 16.55 + (key * 53 % 97) * 0.001).alias("lon"),
            F.col("c_nationkey").cast("string").alias("region_id"),
            F.when(key % 17 != 0, 4 + key % 8).cast("int").alias("capacity"),
        )

    @stored
    def info(self) -> DataFrame:
        """Two versions of each station, the older one with a name in lower case."""
        versions = F.inline(
            F.array(
                F.struct(F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("observed_at"), F.lit(True).alias("old")),
                F.struct(F.expr("timestamp_ntz'2024-01-15 00:00:00'").alias("observed_at"), F.lit(False).alias("old")),
            )
        )
        rows = self.stations.select("*", versions)
        return rows.withColumn("name", F.when(F.col("old"), F.lower("name")).otherwise(F.col("name"))).drop("old")

    @stored
    def status(self) -> DataFrame:
        """Hourly panel: last known stock in the hour."""
        known = F.max(F.when(F.col("bikes").isNotNull(), F.struct("us", "bikes")))["bikes"]
        rows = self.events.groupBy(F.col("hour_ts").alias("collected_at"), "station_id").agg(
            known.alias("num_bikes_available"),
            floor_div(F.max("us"), SECOND_US).alias("last_reported"),
            F.bool_and(F.col("event_type") != "error").alias("is_renting"),
            F.bool_or(F.col("event_type") == "click").alias("is_returning"),
        )
        docks = F.when(F.col("station_id").cast("long") % 11 != 0, 8 - F.coalesce("num_bikes_available", F.lit(0)))
        return rows.withColumn("num_docks_available", docks)

    @stored
    def free(self) -> DataFrame:
        """Vehicle sightings; one on an 'error' row is at no station."""
        places = self.stations.select("station_id", "lat", "lon")
        seen = self.events.join(places, "station_id")
        return seen.select(
            F.col("ts").alias("collected_at"),
            "bike_id",
            F.when(F.col("event_type") != "error", F.col("station_id")).alias("station_id"),
            "lat",
            "lon",
        )

    @stored
    def free_hourly(self) -> DataFrame:
        """Vehicle feed at the panel's times: last sighting in the hour."""
        last = self.events.groupBy(F.col("hour_ts").alias("collected_at"), "bike_id").agg(
            F.max(F.struct("us", "station_id", (F.col("event_type") == "error").alias("loose"))).alias("s")
        )
        return last.select(
            "collected_at", "bike_id", F.when(~F.col("s.loose"), F.col("s.station_id")).alias("station_id")
        )

    @stored
    def runs(self) -> DataFrame:
        return collection_runs(self.status, self.free_hourly)

    @stored
    def minute_runs(self) -> DataFrame:
        """Irregular run times: minutes in which anything happened."""
        us = F.col("us")
        minute = utc_wall(floor_div(us, 60 * SECOND_US) * (60 * SECOND_US))
        per_minute = self.events.groupBy(minute.alias("collected_at"))
        return per_minute.agg(
            F.count(F.lit(1)).alias("station_count"), F.sum(F.coalesce("bikes", F.lit(0))).alias("bikes_available")
        )

    @stored
    def changes(self) -> DataFrame:
        """Change log with a vehicle list in JSON; an 'error' event lists none."""
        seen = self.events.join(self.stations.select("station_id", "name", "lat", "lon"), "station_id")
        listed = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat(F.lit('"'), "bike_id", F.lit('"')))
        return seen.select(
            F.col("ts").alias("timestamp"),
            F.col("station_id").alias("nuid"),
            "name",
            F.col("lat").alias("latitude"),
            F.col("lon").alias("longitude"),
            "bikes",
            F.concat(F.lit('{"bike_uids":['), listed, F.lit("]}")).alias("extra"),
            F.concat(F.date_format("ts", "yyyyMM"), F.lit("-city-stats.parquet")).alias("file_name"),
        )

    @cached_property
    def parts(self) -> int:
        """Documents a snapshot is cut into, so that none holds many more rows than ``DOCUMENT_ROWS`` at any scale."""
        rows = [d.groupBy("collected_at").count() for d in (self.status, self.free_hourly)]
        most = rows[0].union(rows[1]).agg(F.max("count")).first()[0] or 0
        return max(1, -(-most // DOCUMENT_ROWS))

    def _in_parts(self, df: DataFrame, key: str, entry, name: str) -> DataFrame:
        cut = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int"))
        return cut.groupBy("collected_at", "part").agg(F.collect_list(entry).alias(name))

    @stored
    def raw(self) -> DataFrame:
        """Snapshot documents made from the hourly tables, as JSON text parsed back: parts of a snapshot, dealt by id, with all
        fields of every feed."""
        from stationflow.sources.schemas import FEEDS

        number = F.col("station_id").cast("long")
        kinds = F.array(F.struct(F.lit("bike").alias("vehicle_type_id"), F.col("num_bikes_available").alias("count")))
        station = F.struct(
            "station_id", "num_bikes_available", "num_docks_available", (number % 13 != 0).alias("is_installed"), "is_renting", "is_returning",
            "last_reported", F.when(number % 3 == 0, kinds).alias("vehicle_types_available"),
        )
        place = F.struct(
            "station_id", "name", "short_name", "lat", "lon", "region_id", F.when(number % 7 != 0, number % 19 == 0).alias("is_virtual_station"),
            "capacity",
        )
        vehicle = F.col("bike_id").cast("long")
        bike = F.struct(
            "bike_id", (vehicle % 5 == 0).alias("is_reserved"), F.when(vehicle % 11 != 0, vehicle % 7 == 0).alias("is_disabled"),
            (49 + (vehicle % 100) * 0.001).alias("lat"), (16 + (vehicle % 90) * 0.001).alias("lon"),
            F.concat(F.lit("type-"), (vehicle % 3).cast("string")).alias("vehicle_type_id"), "station_id",
            F.when(vehicle % 2 == 0, F.concat(F.lit("plan-"), (vehicle % 4).cast("string"))).alias("pricing_plan_id"),
            F.when(vehicle % 4 == 0, F.struct(F.concat(F.lit("app://"), "bike_id").alias("ios"))).alias("rental_uris"),
        )
        named = self.status.join(self.stations, "station_id")
        stations = self._in_parts(named, "station_id", F.struct(station.alias("s"), place.alias("i")), "rows")
        bikes = self._in_parts(self.free_hourly, "bike_id", bike, "b")
        joined = stations.join(bikes, ["collected_at", "part"], "full")
        updated = floor_div(epoch_us(joined, "collected_at"), SECOND_US).alias("last_updated")

        def feed(items: str, entries):
            return F.struct(updated, F.struct(entries.alias(items)).alias("data"))

        docs = joined.select(
            "collected_at",
            "part",
            F.to_json(
                F.struct(
                    feed("stations", F.col("rows.s")).alias("station_status"),
                    feed("stations", F.col("rows.i")).alias("station_information"),
                    feed("bikes", F.col("b")).alias("free_bike_status"),
                )
            ).alias("text"),
        )
        path = F.date_format("collected_at", "'raw/'yyyy/MM/dd/yyyyMMdd'T'HHmmss'Z.json'")
        return docs.select("collected_at", "part", path.alias("raw_path"), F.from_json("text", FEEDS).alias("feeds"))
