"""Schemas of the raw snapshot document and the tables made from it. Every field may be missing."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def columns(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in kinds.items()])


def _feed(items: str, row: T.StructType) -> T.StructType:
    data = T.StructType([T.StructField(items, T.ArrayType(row))])
    return T.StructType([T.StructField("last_updated", T.LongType()), T.StructField("data", data)])


# A nested value declared as string is kept by the JSON reader as its JSON text.
_STATUS = columns(
    station_id="string",
    num_bikes_available="int",
    num_docks_available="int",
    is_installed="boolean",
    is_renting="boolean",
    is_returning="boolean",
    last_reported="bigint",
    vehicle_types_available="string",
)
_INFO = columns(
    station_id="string",
    name="string",
    short_name="string",
    lat="double",
    lon="double",
    region_id="string",
    is_virtual_station="boolean",
    capacity="int",
)
_BIKE = columns(
    bike_id="string",
    is_reserved="boolean",
    is_disabled="boolean",
    lat="double",
    lon="double",
    vehicle_type_id="string",
    station_id="string",
    pricing_plan_id="string",
    rental_uris="string",
)

FEEDS = T.StructType(
    [
        T.StructField("station_status", _feed("stations", _STATUS)),
        T.StructField("station_information", _feed("stations", _INFO)),
        T.StructField("free_bike_status", _feed("bikes", _BIKE)),
    ]
)
RAW = T.StructType([T.StructField("collected_at", T.TimestampType()), T.StructField("feeds", FEEDS)])
STATUS = T.StructType([*columns(collected_at="timestamp", feed_last_updated="bigint"), *_STATUS])
INFO = T.StructType([*columns(observed_at="timestamp", feed_last_updated="bigint"), *_INFO])
FREE_BIKES = T.StructType([*columns(collected_at="timestamp", feed_last_updated="bigint"), *_BIKE])
RUNS = columns(
    collected_at="timestamp", raw_path="string", station_count="int", bikes_available="int", free_bike_count="int"
)
CHANGES = columns(
    timestamp="timestamp_ntz",
    nuid="string",
    name="string",
    latitude="double",
    longitude="double",
    bikes="int",
    extra="string",
)
