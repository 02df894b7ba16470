"""Streaming operators as queries: the station tables are landed as documents and drained as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.tables import Tables
from stationflow.session import shared_folder
from stationflow.sources import lake
from stationflow.sources.schemas import RAW
from stationflow.sources.snapshots import land_snapshots, normalize_status
from stationflow.streaming.ingest import free_bike_stream, raw_stream, start_ingest, status_stream
from stationflow.streaming.live import live_labels, live_runs
from stationflow.streaming.transitions import departure_stream, depletion_stream, gap_stream

MARKER = "end"
HORIZON, MAX_DELAY = 180, 720
STREAM_WINDOW = 240
STREAM_GAP_SECONDS = 1800
#: Snapshots land in blocks of time, each block before the one it follows in time; the delay spans two blocks and more.
BLOCKS = 6
DELAY_BLOCKS = 2.5
FILES_PER_TRIGGER = 40
_LANDED: dict[tuple[int, str], str] = {}


def _instants(docs: DataFrame) -> DataFrame:
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("collected_at"))
    return docs.withColumn("collected_at", F.timestamp_micros(us))


def _block(t: Tables):
    """Block of a snapshot's time, and the length of a block in seconds."""
    first, last = t.raw.agg(F.min("collected_at"), F.max("collected_at")).first()
    length = ((last - first).total_seconds() + 1) / BLOCKS if first else 1.0
    since = F.timestamp_diff("SECOND", F.lit(first), F.col("collected_at"))
    return F.floor(since / F.lit(length)).cast("int"), length


def delay(t: Tables) -> str:
    return f"{int(_block(t)[1] * DELAY_BLOCKS)} seconds"


def _dealt(docs: DataFrame, files: int) -> DataFrame:
    """Documents dealt so that a landing writes so many files a day. Days are written side by side, however much has landed."""
    return docs.repartition(F.to_date("collected_at"), F.pmod(F.xxhash64("collected_at", "part"), F.lit(files)))


def landing(t: Tables) -> str:
    """Folder of all snapshots as JSON, out of order, some of them twice, and a marker far ahead that moves the watermark past them.

    A block's snapshots land after those of the block behind it. Every third hour's documents land again with
    the next block (within the delay), every fifth hour's at the end (the early ones beyond it).
    """
    key = (id(t), "streams")
    if key not in _LANDED:
        folder = f"{shared_folder(t.spark)}/stationflow/landing-{uuid.uuid4().hex}"
        block, _ = _block(t)
        docs = _instants(t.raw).withColumn("block", block).select("collected_at", "feeds", "block", "part")
        hour = F.hour("collected_at")
        for place in range(BLOCKS):
            now, before = place ^ 1, (place - 1) ^ 1
            again = (F.col("block") == before) & (hour % 3 == 0) if place else F.lit(False)
            land_snapshots(_dealt(docs.where((F.col("block") == now) | again), 4).drop("block", "part"), folder)
        land_snapshots(_dealt(docs.where(hour % 5 == 0), 4).drop("block", "part"), folder)
        marker = (
            '{"collected_at": "2100-01-01T00:00:00Z", "feeds": {"station_status": {"data": {"stations": [{"station_id": "%s"}]}},'
            ' "free_bike_status": {"data": {"bikes": [{"bike_id": "%s"}]}}}}' % (MARKER, MARKER)
        )
        text = t.spark.range(1).select(F.from_json(F.lit(marker), RAW).alias("d")).select("d.*")
        land_snapshots(text, folder)
        _LANDED[key] = folder
    return _LANDED[key]


def ingest_landing(t: Tables) -> str:
    """Folder of documents to file: parts of a snapshot in different files and at different times, copies, and what must be
    rejected: text that is no JSON, documents without a time, rows without an id."""
    key = (id(t), "ingest")
    if key not in _LANDED:
        folder = f"{shared_folder(t.spark)}/stationflow/landing-{uuid.uuid4().hex}"
        docs = _instants(t.raw).select("collected_at", "feeds", "part")
        hour = F.hour("collected_at")
        nameless = F.struct(
            F.struct(F.lit(None).cast("long").alias("last_updated"), F.struct(F.array(F.struct(F.lit(7).alias("num_docks_available"))).alias("stations")).alias("data")).alias("station_status")
        )
        odd = docs.where(hour == 6).select("collected_at").distinct()
        for rows in (docs.where("part % 2 = 0"), docs.where("part % 2 = 1"), docs.where(hour % 4 == 0)):
            land_snapshots(_dealt(rows, 2).drop("part"), folder)
        land_snapshots(odd.withColumn("feeds", nameless), folder)
        broken = odd.select(F.concat(F.lit('{"collected_at": "'), F.date_format("collected_at", "yyyy-MM-dd")).alias("value"))
        timeless = odd.select(F.concat(F.lit('{"feeds": {}, "note": "'), F.date_format("collected_at", "yyyy-MM-dd"), F.lit('"}')).alias("value"))
        # in one file, where equal documents are rejected once
        broken.union(timeless).coalesce(1).write.mode("append").text(f"{folder}/date=none")
        _LANDED[key] = folder
    return _LANDED[key]


def lake_root(t: Tables) -> str:
    """Tables that a drained stream filled from ``ingest_landing``, and a second one that read all of it again."""
    key = (id(t), "lake")
    if key not in _LANDED:
        root = f"{shared_folder(t.spark)}/stationflow/lake-{uuid.uuid4().hex}"
        for name, files in (("first", 3 * FILES_PER_TRIGGER), ("again", 1000)):
            start_ingest(t.spark, ingest_landing(t), root, f"{root}-checkpoints/{name}", files).awaitTermination()
        _LANDED[key] = root
    return _LANDED[key]


def wall_times(rows: DataFrame) -> DataFrame:
    times = [name for name, kind in rows.dtypes if kind == "timestamp"]
    return rows.withColumns({name: F.timestamp_add("MICROSECOND", F.unix_micros(name), F.expr("timestamp_ntz'1970-01-01'")) for name in times})


def drained(t: Tables, stream: DataFrame) -> DataFrame:
    """All rows the stream gives out for what has landed, as a table in the shared folder."""
    base = f"{shared_folder(t.spark)}/stationflow/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/rows")
    )
    query.awaitTermination()
    rows = t.spark.read.schema(stream.schema).parquet(f"{base}/rows")
    return wall_times(rows)


def _raw(t: Tables) -> DataFrame:
    return raw_stream(t.spark, landing(t), FILES_PER_TRIGGER)


def _status(t: Tables) -> DataFrame:
    return status_stream(_raw(t), delay(t))


def _marked(t: Tables) -> DataFrame:
    return normalize_status(_raw(t)).withWatermark("collected_at", delay(t))


def _filed(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: wall_times(lake.read_rows(t.spark, lake_root(t), name))


ON_STREAMS: dict[str, Callable[[Tables], DataFrame]] = {
    "stream_runs": lambda t: drained(t, live_runs(_status(t))),
    "stream_deduplicated": lambda t: drained(t, _status(t)).where(F.col("station_id") != MARKER),
    "stream_depletions": lambda t: drained(t, depletion_stream(_status(t))),
    "stream_departures": lambda t: drained(t, departure_stream(free_bike_stream(_raw(t), delay(t)), STREAM_WINDOW)).where(
        F.col("bike_id") != MARKER
    ),
    "stream_gaps": lambda t: drained(t, gap_stream(_raw(t).withWatermark("collected_at", delay(t)), STREAM_GAP_SECONDS)),
    "stream_labels": lambda t: drained(t, live_labels(_marked(t), _marked(t), HORIZON, MAX_DELAY)),
    "ingest_status": _filed("station_status"),
    "ingest_info": _filed("station_information"),
    "ingest_free_bikes": _filed("free_bikes"),
    # the path names a file of the landing folder, which differs from run to run
    "ingest_runs": lambda t: wall_times(lake.read_runs(t.spark, lake_root(t)).drop("raw_path")),
    "ingest_rejected": lambda t: wall_times(lake.read_rows(t.spark, lake_root(t), "rejected").drop("raw_path")),
}
