"""Analyses of the station change log: coverage, areas around a point, the whole city."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.clock import epoch_us, hour_label, month_label
from stationflow.functions.geo import distance_m, whole_metres
from stationflow.functions.rules import require, require_point, round_to, share, tally
from stationflow.plans.carry import Grid, on_ticks, states, ticks_before, totals_per_tick
from stationflow.plans.restrict import restrict
from stationflow.session import settle
from stationflow.sources.history import month_key

# The local hours the morning reports look at, both ends included.
MORNING = ("04:00", "12:00")
RUSH = ("06:00", "10:00")


def history_summary(changes: DataFrame) -> DataFrame:
    month = month_key()
    return changes.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("latest_timestamp"),
        F.countDistinct("nuid").alias("station_ids"),
        F.countDistinct("name").alias("station_names"),
        F.min(month).alias("first_month"),
        F.max(month).alias("latest_month"),
    )


def history_monthly(changes: DataFrame) -> DataFrame:
    """Per month file. Rows are first reduced to (month, station), so neither a large month nor the
    distinct count puts a month's rows in one task."""
    per_station = changes.groupBy(month_key().alias("month_key"), "nuid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bikes").alias("bikes"),
        F.count("bikes").alias("known"),
        tally(F.col("bikes") == 0).alias("empty"),
    )
    return per_station.groupBy("month_key").agg(
        F.sum("n").alias("change_rows"),
        F.count("nuid").alias("station_ids"),
        round_to(F.sum("bikes") / F.sum("known"), 2).alias("avg_bikes_on_change"),
        F.sum("empty").alias("empty_change_rows"),
    )


def station_catalog(changes: DataFrame) -> DataFrame:
    """One row per station: latest known name and position, first and last change.

    A station hardly ever changes its name or place, so the log is first reduced to distinct
    descriptions with their times: a hash aggregate over plain numbers, combined before the shuffle.
    """
    us = epoch_us(changes, "timestamp")
    latest = {"name": "station_name", "latitude": "latitude", "longitude": "longitude"}
    described = changes.groupBy("nuid", *latest).agg(F.min(us).alias("from_us"), F.max(us).alias("us"))
    picks = [F.max(F.when(F.col(c).isNotNull(), F.struct("us", F.col(c).alias("v")))).alias(c) for c in latest]
    grouped = described.groupBy("nuid").agg(*picks, F.min("from_us").alias("first_us"), F.max("us").alias("last_us"))
    return grouped.select("nuid", *[F.col(f"{c}.v").alias(n) for c, n in latest.items()], "first_us", "last_us")


def station_latest_position(changes: DataFrame) -> DataFrame:
    return station_catalog(changes).drop("first_us", "last_us")


def with_distance(catalog: DataFrame, lat: float, lon: float) -> DataFrame:
    """Positioned stations with whole metres to the point."""
    metres = whole_metres(distance_m(lat, lon, F.col("latitude"), F.col("longitude")))
    placed = catalog.where("nuid is not null and latitude is not null and longitude is not null")
    return placed.withColumn("distance_m", metres)


def stations_in_radius(changes: DataFrame, lat: float, lon: float, radius_m: int = 600) -> DataFrame:
    """Nearest first."""
    near = with_distance(station_catalog(changes), lat, lon).where(F.col("distance_m") <= radius_m)
    return near.select("nuid", "station_name", "distance_m").orderBy("distance_m", "nuid")


def _series(totals: DataFrame, label: str) -> DataFrame:
    return totals.groupBy(label).agg(
        F.count(F.lit(1)).alias("samples"),
        round_to(F.avg("total_bikes"), 2).alias("avg_bikes"),
        round_to(F.avg("with_bikes"), 2).alias("avg_stations_with_bikes"),
        round_to(share(F.col("with_bikes") == 0), 3).alias("all_empty_rate"),
    )


@dataclass
class AreaHistory:
    """Stations within a radius, sampled on a grid. Stations count as empty before their first change.

    The station catalog is settled once: it gives the radius set, the grid bounds and the names. The
    change log is then read once more, cut to the stations in the radius.
    """

    changes: DataFrame
    lat: float
    lon: float
    radius_m: int = 600
    sample_minutes: int = 15
    tz: str = "Europe/Prague"
    catalog: DataFrame | None = None

    def __post_init__(self) -> None:
        require_point(self.lat, self.lon)
        require(self.radius_m > 0, "radius_m: above 0")
        if self.catalog is None:
            self.catalog = settle(station_catalog(self.changes), "catalog")

    @cached_property
    def grid(self) -> Grid:
        return Grid(self.changes, self.sample_minutes, self.catalog)

    @cached_property
    def stations(self) -> DataFrame:
        near = with_distance(self.catalog, self.lat, self.lon).where(F.col("distance_m") <= self.radius_m)
        return near.select("nuid", "station_name", "distance_m")

    @cached_property
    def state(self) -> DataFrame:
        return states(self.grid, restrict(self.changes, "nuid", self.stations), self.stations)

    def hold(self) -> AreaHistory:
        """Settle the station states, for a report that derives many tables from them."""
        self.state = settle(self.state, "states")
        return self

    @cached_property
    def labelled_totals(self) -> DataFrame:
        chosen = self.stations.count()
        totals = totals_per_tick(self.grid, self.state).where(F.lit(chosen > 0))
        us = self.grid.tick_us(F.col("tick"))
        return totals.select(
            self.grid.tick_time(F.col("tick")).alias("sample_ts"),
            hour_label(us, self.tz).alias("local_hour"),
            month_label(us, self.tz).alias("local_month"),
            F.coalesce("total_bikes", F.lit(0)).alias("total_bikes"),
            F.coalesce("with_bikes", F.lit(0)).alias("with_bikes"),
            (F.lit(chosen) - F.coalesce("with_bikes", F.lit(0))).alias("empty_stations"),
        )

    def samples(self) -> DataFrame:
        """Station x tick, bikes NULL before a station's first change."""
        ticks = on_ticks(self.state.join(self.stations, "nuid"))
        us = self.grid.tick_us(F.col("tick"))
        return ticks.select(
            self.grid.tick_time(F.col("tick")).alias("sample_ts"),
            month_label(us, self.tz).alias("local_month"),
            hour_label(us, self.tz).alias("local_hour"),
            "nuid",
            "station_name",
            "distance_m",
            "bikes",
        )

    def summary(self) -> DataFrame:
        return self.labelled_totals.agg(
            F.count(F.lit(1)).alias("samples"),
            F.min("sample_ts").alias("first_sample"),
            F.max("sample_ts").alias("latest_sample"),
            round_to(F.avg("total_bikes"), 2).alias("avg_bikes"),
            round_to(F.avg("with_bikes"), 2).alias("avg_stations_with_bikes"),
            round_to(share(F.col("with_bikes") == 0), 3).alias("all_empty_rate"),
        )

    def hourly(self, hours: tuple[str, str] | None = None) -> DataFrame:
        totals = self.labelled_totals
        if hours is not None:
            totals = totals.where(F.col("local_hour").between(*hours))
        return _series(totals, "local_hour")

    def morning_by_month(self) -> DataFrame:
        return _series(self.labelled_totals.where(F.col("local_hour").between(*RUSH)), "local_month")

    def station_rates(self) -> DataFrame:
        """Per station, each state weighted by the ticks it lasts."""
        rates = state_rates(self.state, missing_is_zero=True, digits=2)
        return rates.join(self.stations, "nuid").select(
            "nuid", "station_name", "distance_m", "samples", "avg_bikes", "empty_rate", "low_rate"
        )

    def station_hours(self) -> DataFrame:
        """Empty rate per station name and local hour."""
        named = self.state.join(self.stations.select("nuid", "station_name"), "nuid")
        ticks = on_ticks(named).withColumn("local_hour", hour_label(self.grid.tick_us(F.col("tick")), self.tz))
        empty = F.coalesce("bikes", F.lit(0)) == 0
        return ticks.groupBy("station_name", "local_hour").agg(round_to(share(empty), 3).alias("empty_rate"))

    def station_hour_matrix(self) -> DataFrame:
        return hour_matrix(self.station_hours(), "station_name")


def state_rates(state: DataFrame, missing_is_zero: bool, digits: int) -> DataFrame:
    ticks = F.col("hi") - F.col("lo") + 1
    bikes = F.coalesce("bikes", F.lit(0)) if missing_is_zero else F.col("bikes")

    def weighted(condition: Column) -> Column:
        return F.sum(F.when(condition, ticks).otherwise(0)) / F.sum(ticks)

    return state.groupBy("nuid").agg(
        F.sum(ticks).alias("samples"),
        round_to(F.sum(bikes * ticks) / F.sum(F.when(bikes.isNotNull(), ticks)), digits).alias("avg_bikes"),
        round_to(weighted(bikes == 0), 3).alias("empty_rate"),
        round_to(weighted(bikes <= 1), 3).alias("low_rate"),
    )


def hour_matrix(rates: DataFrame, row: str, value: str | None = None) -> DataFrame:
    """Rows x 24 local hours, 0 where there is no sample."""
    value = value or "empty_rate"
    hours = [f"{h:02d}:00" for h in range(24)]
    return rates.groupBy(row).pivot("local_hour", hours).agg(F.max(value)).fillna(0.0)


def station_history_rates(
    changes: DataFrame,
    lat: float,
    lon: float,
    max_walk_m: int = 1600,
    hour: str = "08:00",
    sample_minutes: int = 60,
    tz: str = "Europe/Prague",
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Per station in walking range: overall rates, and the empty rate of one local hour.

    States are weighted by their ticks; those within the hour are a difference of two rows of a table with one row per tick.
    """
    area = AreaHistory(changes, lat, lon, max_walk_m, sample_minutes, tz, catalog)
    grid = area.grid
    in_hour = ticks_before(grid, lambda tick: hour_label(grid.tick_us(tick), tz) == hour)
    in_hour = settle(in_hour, "ticks-before")
    until = in_hour.select((F.col("tick") - 1).alias("hi"), F.col("before").alias("until"))
    since = in_hour.select(F.col("tick").alias("lo"), F.col("before").alias("since"))
    bikes, ticks, here = F.coalesce("bikes", F.lit(0)), F.col("hi") - F.col("lo") + 1, F.col("until") - F.col("since")

    def rate(condition: Column, weight: Column) -> Column:
        return F.try_divide(F.sum(F.when(condition, weight).otherwise(0)), F.sum(weight))

    rates = (
        area.state.join(since, "lo")
        .join(until, "hi")
        .groupBy("nuid")
        .agg(
            round_to(F.sum(bikes * ticks) / F.sum(ticks), 2).alias("hist_avg_bikes"),
            round_to(rate(bikes == 0, ticks), 3).alias("hist_empty_rate"),
            round_to(rate(bikes <= 1, ticks), 3).alias("hist_low_rate"),
            round_to(rate(bikes == 0, here), 3).alias("hour_empty_rate"),
        )
    )
    names = area.stations.select("nuid", "station_name")
    return rates.join(names, "nuid").withColumnRenamed("nuid", "station_id")


@dataclass
class CityHistory:
    """All stations on a grid; a station is observed from its first change on."""

    changes: DataFrame
    sample_minutes: int = 60
    tz: str = "Europe/Prague"
    catalog: DataFrame | None = None

    @cached_property
    def grid(self) -> Grid:
        return Grid(self.changes, self.sample_minutes, self.catalog)

    @property
    def _stations(self) -> DataFrame:
        if self.catalog is None:
            return station_latest_position(self.changes)
        return self.catalog.drop("first_us", "last_us")

    @cached_property
    def state(self) -> DataFrame:
        return states(self.grid)

    def hold(self) -> CityHistory:
        """Settle the station states, for a report that derives many tables from them."""
        self.state = settle(self.state, "states")
        return self

    @cached_property
    def labelled_totals(self) -> DataFrame:
        us = self.grid.tick_us(F.col("tick"))
        totals = totals_per_tick(self.grid, self.state).where("observed > 0")
        return totals.withColumns({"local_hour": hour_label(us, self.tz), "local_month": month_label(us, self.tz)})

    def samples(self) -> DataFrame:
        """Station x tick with the station's latest name and position."""
        ticks = on_ticks(self.state.join(self._stations, "nuid"))
        us = self.grid.tick_us(F.col("tick"))
        return ticks.select(
            self.grid.tick_time(F.col("tick")).alias("sample_ts"),
            month_label(us, self.tz).alias("local_month"),
            hour_label(us, self.tz).alias("local_hour"),
            "nuid",
            "station_name",
            "latitude",
            "longitude",
            "bikes",
        )

    def _rates(self, *labels: str) -> dict[str, Column]:
        return {
            "samples": F.count(F.lit(1)),
            "avg_total_bikes": round_to(F.avg("total_bikes"), 2),
            "avg_bikes_per_station": round_to(F.avg(F.col("total_bikes") / F.col("observed")), 3),
            "avg_stations_with_bikes": round_to(F.avg("with_bikes"), 2),
            "empty_station_rate": round_to(F.avg(F.col("empty") / F.col("observed")), 3),
        }

    def _table(self, labels: list[str], names: list[str]) -> DataFrame:
        rates = self._rates()
        return self.labelled_totals.groupBy(*labels).agg(*[rates[n].alias(n) for n in names])

    def monthly(self) -> DataFrame:
        return self._table(["local_month"], list(self._rates()))

    def hourly(self) -> DataFrame:
        return self._table(["local_hour"], ["samples", "avg_bikes_per_station", "empty_station_rate"])

    def month_hour(self) -> DataFrame:
        return self._table(["local_month", "local_hour"], ["empty_station_rate"])

    def month_hour_matrix(self) -> DataFrame:
        return hour_matrix(self.month_hour(), "local_month", "empty_station_rate")

    def station_rates(self) -> DataFrame:
        rates = state_rates(self.state, missing_is_zero=False, digits=3)
        return rates.join(self._stations, "nuid")


def station_map_table(rates: DataFrame, local: DataFrame) -> DataFrame:
    """City station rates with a flag for the stations of an area."""
    marked = local.select("nuid", F.lit(True).alias("is_local"))
    return rates.join(marked, "nuid", "left").fillna(False, ["is_local"])


def worst_months(monthly: DataFrame, limit: int = 5) -> DataFrame:
    return monthly.orderBy(F.col("all_empty_rate").desc(), "local_month").limit(limit)


def highest(rows: DataFrame, by: str, label: str, limit: int = 15) -> DataFrame:
    """The rows with the largest values, by label where they tie."""
    require(limit > 0, "limit: above 0")
    return rows.orderBy(F.col(by).desc(), F.col(label).asc_nulls_last()).limit(limit)
