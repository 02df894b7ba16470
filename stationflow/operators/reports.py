"""Whole reports: every table of an analysis, with the shared base computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.operators.area import Area
from stationflow.operators.flows import Flows
from stationflow.operators.history import (
    AreaHistory,
    CityHistory,
    history_monthly,
    history_summary,
    station_catalog,
    station_map_table,
    worst_months,
)
from stationflow.operators.moves import Movements
from stationflow.operators.stations import latest_station_info
from stationflow.session import settle


def history_report(
    changes: DataFrame,
    lat: float,
    lon: float,
    radius_m: int = 600,
    sample_minutes: int = 60,
    max_window_minutes: int = 720,
    tz: str = "Europe/Prague",
    area_minutes: int = 15,
) -> dict[str, DataFrame]:
    """City, area and flow tables of the change log; the city is sampled each ``sample_minutes``, the area each ``area_minutes``. The log is read once for the station catalog, once
    for the states of the city, once for those of the area, and once for the flows."""
    catalog = settle(station_catalog(changes), "catalog")
    city = CityHistory(changes, sample_minutes, tz, catalog).hold()
    area = AreaHistory(changes, lat, lon, radius_m, area_minutes, tz, catalog).hold()
    flows = Flows(changes, lat, lon, radius_m, max_window_minutes, tz, catalog).hold()
    city_rates = city.station_rates()
    morning = area.morning_by_month()
    tables = {
        "city_monthly": city.monthly(),
        "city_hourly": city.hourly(),
        "city_month_hour": city.month_hour_matrix(),
        "city_station_rates": city_rates,
        "station_map": station_map_table(city_rates, area.stations),
        "local_stations": area.stations.orderBy("distance_m", "nuid"),
        "local_summary": area.summary(),
        "local_hourly": area.hourly(),
        "local_monthly_morning": morning,
        "worst_months": worst_months(morning),
        "local_station_rates": area.station_rates(),
        "local_station_hour": area.station_hours(),
        "flow_summary": flows.summary(),
        "flow_hourly": flows.hourly(),
        "flow_monthly": flows.monthly(),
        "morning_flow_totals": flows.morning_totals(),
        "top_destinations": flows.destinations(),
        "origin_stations": flows.origins(),
    }
    if "file_name" in changes.columns:
        tables |= {"raw_summary": history_summary(changes), "raw_monthly": history_monthly(changes)}
    return tables


def area_report(
    status: DataFrame, info: DataFrame, lat: float, lon: float, radius_m: int = 600, limit: int = 12, tz: str = "Europe/Prague"
) -> dict[str, DataFrame]:
    """Area tables of the snapshot panel."""
    area = Area(status, info, lat, lon, radius_m, tz)
    return {
        "coverage": area.coverage(),
        "latest": area.latest(),
        "stations": area.station_table(limit),
        "hourly": area.hourly(),
        "depletions": area.depletion_by_hour(),
        "morning_signals": area.morning_signals(),
    }


def departure_report(
    free: DataFrame,
    info: DataFrame,
    lat: float,
    lon: float,
    radius_m: int = 600,
    limit: int = 30,
    max_window_minutes: int = 240,
    open_after_minutes: int = 3,
    tz: str = "Europe/Prague",
) -> dict[str, DataFrame]:
    """Departure tables of the vehicle feed."""
    dimension = settle(latest_station_info(info), "dimension")
    moves = Movements(
        free, dimension, lat, lon, radius_m, max_window_minutes, open_after_minutes, tz=tz
    ).hold()
    return {
        "summary": moves.departure_summary(),
        "hourly": moves.departures_hourly().orderBy("local_hour"),
        "destinations": moves.departure_destinations(limit),
        "departures": moves.departures(limit),
    }


def rates_in_percent(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table with ``<rate>_pct`` next to its rates."""

    def widen(df: DataFrame) -> DataFrame:
        rates = [c for c in df.columns if c.endswith("_rate")]
        return df.withColumns({f"{c}_pct": F.col(c) * 100 for c in rates})

    return {name: widen(df) for name, df in tables.items()}
