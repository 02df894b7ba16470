"""Streams against batch results, with files arriving in order and reversed."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationflow.operators.area import Area
from stationflow.sources import lake
from stationflow.sources.snapshots import normalize_info, normalize_status, read_raw
from stationflow.streaming.ingest import free_bike_stream, raw_stream, start_ingest, status_stream
from stationflow.streaming.live import live_labels, live_runs
from stationflow.streaming.transitions import departure_stream, depletion_stream, follow, gap_stream

START = datetime(2024, 3, 30, 22, 0)
STATIONS, SNAPSHOTS = 5, 24


def snapshot(i: int) -> dict:
    rng = random.Random(i)
    stations = [{"station_id": f"s{n}", "num_bikes_available": rng.choice([0, 0, 1, 2, None])} for n in range(STATIONS)]
    bikes = [{"bike_id": f"b{n}", "station_id": rng.choice(["s0", "s1", None])} for n in range(4) if rng.random() < 0.6]
    places = [{"station_id": f"s{n}", "lat": 49.2, "lon": 16.6, "name": f"S{n}"} for n in range(STATIONS)]
    return {
        "collected_at": (START + timedelta(minutes=i if i < 12 else i + 5)).isoformat() + "+00:00",
        "feeds": {
            "station_status": {"last_updated": i, "data": {"stations": stations}},
            "station_information": {"last_updated": i, "data": {"stations": places}},
            "free_bike_status": {"last_updated": i, "data": {"bikes": bikes}},
        },
    }


def land(folder, order) -> str:
    """One file per snapshot, taken in the given order, and a last empty one that moves the watermark on."""
    folder.mkdir()
    for at, i in enumerate(order):
        path = folder / f"{at:04d}.json"
        path.write_text(json.dumps(snapshot(i)))
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
    final = {"collected_at": "2024-03-31T12:00:00+00:00", "feeds": {}}
    final["feeds"]["station_status"] = {"data": {"stations": [{"station_id": "end", "num_bikes_available": 1}]}}
    final["feeds"]["free_bike_status"] = {"data": {"bikes": [{"bike_id": "end"}]}}
    path = folder / "9999.json"
    path.write_text(json.dumps(final))
    os.utime(path, (1_700_001_000, 1_700_001_000))
    return str(folder)


def drain(df, tmp_path, name):
    query = (
        df.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / f"ck-{name}"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert not query.isActive
    return df.sparkSession.table(name)


ORDERS = {"in_order": list(range(SNAPSHOTS)), "reversed": list(range(SNAPSHOTS))[::-1]}


@pytest.mark.parametrize("order", ORDERS)
def test_depletions_equal_batch_in_any_arrival_order(spark, tmp_path, order):
    landing = land(tmp_path / "landing", ORDERS[order])
    raw = read_raw(spark, landing)
    batch = Area(normalize_status(raw), normalize_info(raw), 49.2, 16.6).depletions()
    stream = status_stream(raw_stream(spark, landing, 4), "2 hours")
    got = drain(depletion_stream(stream), tmp_path, f"depletions_{order}")
    want = {(r.station_id, r.collected_at) for r in batch.collect()}
    assert want and {(r.station_id, r.collected_at) for r in got.collect()} == want
    assert got.count() == len(want)


def land_rows(folder, triggers: list[list[tuple]]) -> str:
    """One file of status documents per list of (minute, station, bikes), taken in the order given."""
    folder.mkdir()
    for at, rows in enumerate(triggers):
        documents: dict[int, list] = {}
        for minute, station, bikes in rows:
            documents.setdefault(minute, []).append({"station_id": station, "num_bikes_available": bikes})
        lines = [
            json.dumps({"collected_at": (START + timedelta(minutes=m)).isoformat() + "+00:00", "feeds": {"station_status": {"data": {"stations": r}}}})
            for m, r in documents.items()
        ]
        path = folder / f"{at:04d}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
    return str(folder)


def drain_progress(df, tmp_path, name):
    """Rows, and the progress of each trigger."""
    writer = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}"))
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive
    return df.sparkSession.table(name).collect(), query.recentProgress


def states_of(progress, operator: str) -> int:
    return max(s["numRowsTotal"] for p in progress for s in p["stateOperators"] if s["operatorName"] == operator)


def test_depletions_of_many_stations_share_states(spark, tmp_path):
    """Python is asked once per bucket and trigger: 5,000 stations make no more states than there are buckets, times two lists."""
    rows = [(minute, f"s{n}", (n + minute) % 3) for minute in range(4) for n in range(5000)]
    landing = land_rows(tmp_path / "landing", [rows[10_000:], rows[:10_000], [(10_000, "end", 1)]])
    stream = status_stream(raw_stream(spark, landing, 1), "2 hours")
    got, progress = drain_progress(depletion_stream(stream), tmp_path, "depletions_many")
    want = {(f"s{n}", START + timedelta(minutes=m)) for m in range(1, 4) for n in range(5000) if (n + m) % 3 == 0}
    assert {(r.station_id, r.collected_at) for r in got} == want and len(got) == len(want)
    assert states_of(progress, "transformWithStateInPandasExec") <= 2 * 1024


def test_follow_keeps_the_keys_of_a_bucket_apart(spark, tmp_path):
    """Keys, NULL among them, of two buckets: pairs in time order and silences, whatever the order of arrival."""
    rng = random.Random(5)
    keys = [None, "", *(f"k{n}" for n in range(12))]
    rows = [(m, k, rng.choice([None, 0, 1, 7])) for m in range(60) for k in keys if rng.random() < 0.4]
    shuffled = sorted(rows, key=lambda _: rng.random())
    landing = land_rows(tmp_path / "landing", [shuffled[i::4] for i in range(4)] + [[(10_000, "end", 1)], [(10_001, "end", 1)]])
    stream = normalize_status(raw_stream(spark, landing, 1)).withWatermark("collected_at", "3 hours")
    pairs = follow(stream, "station_id", "collected_at", ["num_bikes_available"], idle_us=3 * 60_000_000, buckets=2)
    got, _ = drain_progress(pairs, tmp_path, "follow_buckets")

    def us(minute):
        return int((START + timedelta(minutes=minute) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000

    want = []
    for key in keys:
        mine = sorted((m, v) for m, k, v in [(m, k, -1 if v is None else v) for m, k, v in rows] if k == key)
        mine = [(us(m), None if v == -1 else v) for m, v in mine]
        want += [("next", key, *b, *a) for a, b in zip([(None, None), *mine], mine)]
        nexts = [b[0] for b in mine[1:]] + [us(10_000)]
        want += [("idle", key, None, None, *a) for a, b in zip(mine, nexts) if b > a[0] + 3 * 60_000_000]
    found = [tuple(r) for r in got if r.station_id != "end"]
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("order", ORDERS)
def test_departures_in_any_arrival_order(spark, tmp_path, order):
    landing = land(tmp_path / "landing", ORDERS[order])
    stream = free_bike_stream(raw_stream(spark, landing, 4), "2 hours")
    got = drain(departure_stream(stream, open_after_minutes=3), tmp_path, f"departures_{order}").collect()
    seen: dict[str, list] = {}
    for i in range(SNAPSHOTS):
        doc = snapshot(i)
        at = datetime.fromisoformat(doc["collected_at"]).replace(tzinfo=None)
        for bike in doc["feeds"]["free_bike_status"]["data"]["bikes"]:
            seen.setdefault(bike["bike_id"], []).append((at, bike["station_id"]))
    want = set()
    for bike, rows in seen.items():
        for (t0, s0), (t1, s1) in zip(rows, rows[1:]):
            if s0 is not None and s0 != s1:
                want.add(("seen-again", bike, t0, t1))
            if s0 is not None and t1 - t0 > timedelta(minutes=3):
                want.add(("not-seen", bike, t0, None))
        if rows[-1][1] is not None:
            want.add(("not-seen", bike, rows[-1][0], None))
    found = [(r.status, r.bike_id, r.departed_after, r.next_seen_at) for r in got if r.bike_id != "end"]
    assert set(found) == want and len(found) == len(want)


def test_duplicate_documents_count_once_and_runs_add_up(spark, tmp_path):
    landing = land(tmp_path / "landing", [*range(SNAPSHOTS), *range(0, SNAPSHOTS, 3)])
    stream = status_stream(raw_stream(spark, landing, 5), "3 hours")
    runs = drain(live_runs(stream), tmp_path, "live_runs")
    assert runs.count() == SNAPSHOTS
    assert runs.where(F.col("station_count") != STATIONS).count() == 0


def test_gaps(spark, tmp_path):
    landing = land(tmp_path / "landing", ORDERS["reversed"])
    stream = raw_stream(spark, landing, 4).withWatermark("collected_at", "2 hours")
    gaps = drain(gap_stream(stream, 120), tmp_path, "gaps").collect()
    assert [(g.collected_at, g.gap_seconds) for g in gaps] == [(START + timedelta(minutes=17), 360)]


def test_gaps_over_midnight_and_over_days_without_runs(spark, tmp_path):
    """Runs of five days, one of them with a single run and one with none, in files that come out of order."""
    minutes = [0, 1, 2, 9, 1438, 1439, 1441, 1447, 2 * 1440 + 700, 4 * 1440, 4 * 1440 + 1, 4 * 1440 + 1439, 5 * 1440 + 60]
    folder = tmp_path / "landing"
    folder.mkdir()
    order = [minutes[i ^ 1] if i ^ 1 < len(minutes) else minutes[i] for i in range(len(minutes))]
    for at, minute in enumerate([*order, 40 * 1440]):
        path = folder / f"{at:04d}.json"
        path.write_text(json.dumps({"collected_at": (START + timedelta(minutes=minute)).isoformat() + "+00:00", "feeds": {}}))
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
    stream = raw_stream(spark, str(folder), 2).withWatermark("collected_at", "3 days")
    gaps = drain(gap_stream(stream, 120), tmp_path, "gaps_days").collect()
    want = [(a, b) for a, b in zip(minutes, minutes[1:]) if b - a > 2]
    found = sorted((g.previous_collected_at, g.collected_at, g.gap_seconds) for g in gaps)
    assert found == [(START + timedelta(minutes=a), START + timedelta(minutes=b), 60 * (b - a)) for a, b in want]


def test_labels_take_the_first_state_in_the_band(spark, tmp_path):
    landing = land(tmp_path / "landing", ORDERS["in_order"])

    def read():
        return normalize_status(raw_stream(spark, landing, 6)).withWatermark("collected_at", "5 minutes")

    got = drain(live_labels(read(), read(), 3, 6), tmp_path, "labels").collect()
    times = sorted(START + timedelta(minutes=i if i < 12 else i + 5) for i in range(SNAPSHOTS))
    first = {t: min((u for u in times if 180 <= (u - t).total_seconds() <= 360), default=None) for t in times}
    want = {(f"s{n}", t, u) for t, u in first.items() if u is not None for n in range(STATIONS)}
    found = [(r.station_id, r.collected_at, r.target_collected_at) for r in got]
    assert set(found) == want and len(found) == len(want)


def test_labels_of_copies_ties_and_late_rows_in_shared_states(spark, tmp_path):
    """Copies of rows and several states at one time, in files out of order: one label a row, the lower stock first; many stations share states."""
    rng = random.Random(9)
    names = [None, *(f"s{n}" for n in range(3000))]
    few = names[:40]
    rows = [(m, k, rng.choice([None, 0, 2, 5])) for m in range(0, 40, 2) for k in few for _ in range(rng.choice([0, 1, 1, 2]))]
    rows += [(m, k, 3) for m in (8, 15) for k in names[40:]]
    shuffled = sorted(rows, key=lambda _: rng.random())
    landing = land_rows(tmp_path / "landing", [shuffled[i::3] for i in range(3)] + [rows[:50], [(10_000, "end", 1)], [(2, "s1", 0), (10_001, "end", 1)]])

    def read():
        return normalize_status(raw_stream(spark, landing, 1)).withWatermark("collected_at", "2 hours")

    got, progress = drain_progress(live_labels(read(), read(), 3, 7), tmp_path, "labels_shared")
    states: dict[tuple, int] = {}
    for m, k, v in rows:
        states[m, k] = min(v or 0, states.get((m, k), 99))
    want = []
    for m, k in states:
        later = [u for u in range(m + 3, m + 8) if k is not None and (u, k) in states]
        if later:
            want.append((k, START + timedelta(minutes=m), START + timedelta(minutes=later[0]), states[later[0], k], states[later[0], k] == 0))
    assert sorted(map(tuple, got)) == sorted(want)
    assert states_of(progress, "transformWithStateInPandasExec") <= 2 * 1024


def test_ingest_files_each_snapshot_once(spark, tmp_path):
    landing = land(tmp_path / "landing", ORDERS["in_order"])
    root = str(tmp_path / "lake")
    for attempt in ("one", "two"):  # a lost checkpoint means all files are read again
        start_ingest(spark, landing, root, str(tmp_path / attempt), 7).awaitTermination(120)
    assert lake.read_runs(spark, root).count() == SNAPSHOTS + 1
    assert lake.read_rows(spark, root, "station_status").count() == SNAPSHOTS * STATIONS + 1
    assert lake.commits(spark, root).count() == 8


def test_landing_writes_days_side_by_side(spark, tmp_path):
    """As many files a day as asked for at most, every document once, and more tasks than files a day."""
    from checks.streams import _dealt

    days = spark.range(240).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 30) * 86_400).alias("collected_at"), (F.col("id") / 30).cast("int").alias("part")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = _dealt(days, 2)
        tasks = dealt.select(F.spark_partition_id().alias("task"), "collected_at").distinct()
        assert tasks.select("task").distinct().count() > 2
        assert tasks.groupBy("collected_at").count().agg(F.max("count")).first()[0] <= 2
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, days.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_without_an_id_are_picked_inside_the_document(spark):
    from stationflow.sources.schemas import RAW
    from stationflow.sources.snapshots import feed_rows

    text = '{"collected_at": "2024-01-01T00:00:00Z", "feeds": {"station_status": {"data": {"stations": [{"station_id": "a"}, {"num_docks_available": 7}]}}}}'
    raw = spark.range(1).select(F.from_json(F.lit(text), RAW).alias("d")).select("d.*")
    rows = feed_rows(raw, "station_status", "stations", "collected_at", only=lambda row: row["station_id"].isNull())
    assert [(r.station_id, r.num_docks_available) for r in rows.collect()] == [(None, 7)]
