"""Reading, landing and exporting."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stationflow.sources import history, lake, polygons, snapshots, tables


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


DOC = {
    "collected_at": "2024-05-01T08:00:00+02:00",
    "feeds": {
        "station_status": {
            "last_updated": 7,
            "data": {"stations": [{"station_id": "a", "num_bikes_available": 2, "vehicle_types_available": [{"x": 1}]}, {"station_id": "b"}]},
        },
        "system_regions": {"data": {"regions": []}},
    },
}


def test_documents_with_missing_feeds_and_fields(spark, tmp_path):
    write(tmp_path / "2024" / "05" / "01", "one.json", json.dumps(DOC))
    write(tmp_path / "2024" / "05" / "02", "broken.json", '{"collected_at": ')
    raw = snapshots.read_raw(spark, str(tmp_path))
    status = {r.station_id: r for r in snapshots.normalize_status(raw).collect()}
    assert status["a"].vehicle_types_available == '[{"x": 1}]' and status["b"].vehicle_types_available == "[]"
    assert status["b"].num_bikes_available is None and status["a"].feed_last_updated == 7
    assert status["a"].collected_at == datetime(2024, 5, 1, 6, 0)
    assert snapshots.normalize_info(raw).isEmpty() and snapshots.normalize_free_bikes(raw).isEmpty()
    (run,) = snapshots.run_rows(raw).collect()
    assert (run.station_count, run.bikes_available, run.free_bike_count) == (2, 2, 0)
    assert run.raw_path.endswith("one.json")


def test_left_out_feed_gives_no_rows(spark, tmp_path):
    write(tmp_path, "one.json", json.dumps(DOC))
    raw = snapshots.keep_feeds(snapshots.read_raw(spark, str(tmp_path)), ["station_status", "station_information"])
    assert snapshots.normalize_free_bikes(raw).isEmpty() and snapshots.run_rows(raw).count() == 1


def test_land_and_read_back(spark, tmp_path):
    write(tmp_path / "in", "one.json", json.dumps(DOC))
    raw = snapshots.read_raw(spark, str(tmp_path / "in"))
    assert raw.select(snapshots.snapshot_id(raw)).first()[0] == "20240501T060000Z"
    snapshots.land_snapshots(raw.drop("raw_path"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "date=2024-05-01").is_dir()
    again = snapshots.read_raw(spark, str(tmp_path / "out"))
    assert snapshots.normalize_status(again).exceptAll(snapshots.normalize_status(raw)).isEmpty()


def test_ingest_is_idempotent(spark, tmp_path):
    write(tmp_path / "in", "one.json", json.dumps(DOC))
    later = DOC | {"collected_at": "2024-05-03T08:00:00+02:00"}
    root = str(tmp_path / "lake")
    for number, extra in enumerate((False, False, True)):
        if extra:
            write(tmp_path / "in", "two.json", json.dumps(later))
        assert lake.ingest(snapshots.read_documents(spark, str(tmp_path / "in")), root, f"b{number}")
        assert not lake.ingest(snapshots.read_documents(spark, str(tmp_path / "in")), root, f"b{number}")
    assert lake.read_rows(spark, root, "station_status").count() == 4
    assert lake.read_runs(spark, root).count() == 2


def test_history_files(spark, tmp_path):
    folder = tmp_path / "2024001-dir"
    for month, network in (("202401", "x"), ("202402", "x"), ("202401", "y")):
        frame = spark.createDataFrame([(datetime(2024, 1, 1), "a", 1)], "timestamp timestamp_ntz, nuid string, bikes int")
        frame.coalesce(1).write.parquet(str(tmp_path / "tmp" / f"{month}{network}"))
        (part,) = (tmp_path / "tmp" / f"{month}{network}").glob("*.parquet")
        folder.mkdir(exist_ok=True)
        (folder / f"{month}-{network}-stats.parquet").write_bytes(part.read_bytes())
    rows = history.read_history(spark, str(folder), "x")
    assert [r[0] for r in rows.select(history.month_key()).distinct().sort(history.month_key()).collect()] == ["202401", "202402"]
    with pytest.raises(FileNotFoundError):
        history.read_history(spark, str(folder), "none")
    assert history.read_history(spark, str(folder), "none", missing_ok=True).isEmpty()
    held = history.list_history(spark, str(folder), "x")
    offered = held.union(spark.createDataFrame([("202403-x-stats.parquet", 5), ("202503-x-stats.parquet", 5)], "name string, size long"))
    changed = offered.withColumn("size", F.when(F.col("name").startswith("202402"), F.col("size") + 1).otherwise(F.col("size")))
    names = [r.name for r in history.files_to_fetch(changed, held).collect()]
    assert names == ["202402-x-stats.parquet", "202403-x-stats.parquet", "202503-x-stats.parquet"]
    assert history.files_to_fetch(changed, held, [2025]).count() == 1


def test_tables(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string")
    frame.createOrReplaceTempView("known")
    assert [r.n for r in tables.load_table(spark, "known", ["n"], ["n"]).collect()] == [1, 2]
    assert tables.optional_table(spark, "unknown_table") is None and tables.optional_table(spark, "known") is not None
    for call in (lambda: tables.load_table(spark, "known", ["x"]), lambda: tables.checked_name("a; drop")):
        with pytest.raises(ValueError):
            call()
    tables.write_csv_tables({"t": frame}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "tables" / "t")).count() == 2


def test_replaced_partitions_leave_the_others(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 1)], "day int, s string, n int")
    tables.save_table(frame, "by_day", ["day"], str(tmp_path / "by_day"))
    tables.replace_partitions(spark.createDataFrame([(5, 2, "d"), (7, 3, "e")], "n int, day int, s string"), "by_day")
    assert sorted(map(tuple, tables.load_table(spark, "by_day", ["day"]).select("day", "s", "n").collect())) == [
        (1, "a", 1), (1, "b", 1), (2, "d", 5), (3, "e", 7)
    ]
    with pytest.raises(ValueError):
        tables.replace_partitions(frame.drop("n"), "by_day")
    spark.sql("drop table by_day")


def test_picked_up_files_replace_their_earlier_rows(spark, tmp_path):
    offered, root = tmp_path / "offered", str(tmp_path / "held")
    offered.mkdir()

    def offer(name, n):
        spark.range(n).selectExpr("cast(id as string) as nuid").coalesce(1).write.parquet(str(tmp_path / f"{name}{n}"))
        (part,) = (tmp_path / f"{name}{n}").glob("*.parquet")
        (offered / f"{name}-x-stats.parquet").write_bytes(part.read_bytes())

    def held():
        return {(r.file_name[:6], r.version, r["count"]) for r in history.read_held(spark, root).groupBy("file_name", "version").count().collect()}

    offer("202401", 3)
    offer("202402", 4)
    assert history.pick_up(spark, str(offered), root, "x", [2023]) == 0
    assert history.pick_up(spark, str(offered), root, "x") == 2 and held() == {("202401", 1, 3), ("202402", 1, 4)}
    offer("202402", 400)
    offer("202403", 1)
    assert history.pick_up(spark, str(offered), root, "x") == 2
    assert held() == {("202401", 1, 3), ("202402", 2, 400), ("202403", 2, 1)}
    assert history.pick_up(spark, str(offered), root, "x") == 0


def test_polygon_vertices(spark):
    shape = '{"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]], [[[5,5],[6,5],[6,6],[5,5]], [[5.2,5.1],[5.3,5.1],[5.3,5.2],[5.2,5.1]]]]}'
    rows = polygons.polygon_vertices(spark, shape).collect()
    assert len(rows) == 12 and {(r.poly_id, r.ring_id, r.is_hole) for r in rows} == {(0, 0, False), (1, 0, False), (1, 1, True)}


def document(time, stations=(), bikes=None):
    feeds = {"station_status": {"last_updated": 1, "data": {"stations": [{"station_id": s, "num_bikes_available": 2} for s in stations]}}}
    if bikes:
        feeds["free_bike_status"] = {"last_updated": 1, "data": {"bikes": [{"bike_id": b} for b in bikes]}}
    return {"collected_at": time, "feeds": feeds}


def test_repeated_late_and_split_documents_correct_the_run(spark, tmp_path):
    first, late = document("2024-01-01T00:00:00", ["a", "b", None]), document("2024-01-01T00:00:00", ["b", "c", "d", "e"], ["v", None])
    landing, root = tmp_path / "in", str(tmp_path / "tables")
    landing.mkdir()
    for name, content in {"1": first, "2": first, "3": {"feeds": {}}}.items():
        (landing / f"{name}.json").write_text(json.dumps(content))
    (landing / "4.json").write_text("{ no json")

    def file(batch):
        return lake.ingest(snapshots.read_documents(spark, str(landing)), root, batch)

    def run():
        return [(r.station_count, r.bikes_available, r.free_bike_count, r.raw_path[-6:]) for r in lake.read_runs(spark, root).collect()]

    file("1")
    assert lake.read_rows(spark, root, "station_status").count() == 2 and run() == [(2, 4, 0, "1.json")]
    (landing / "5.json").write_text(json.dumps(late))
    for batch in ("2", "3"):
        file(batch)
        assert sorted(r["station_id"] for r in lake.read_rows(spark, root, "station_status").collect()) == ["a", "b", "c", "d", "e"]
        assert lake.read_rows(spark, root, "free_bikes").count() == 1 and run() == [(5, 10, 1, "1.json")]
    rejected = sorted((r.feed, r.reason, r.raw_path[-6:]) for r in lake.read_rows(spark, root, "rejected").collect())
    assert rejected == [
        ("document", "no time", "3.json"), ("document", "unreadable", "4.json"), ("free_bike_status", "no id", "5.json"),
        ("station_status", "no id", "1.json"), ("station_status", "no id", "2.json"),
    ]
    told = {r["raw_path"][-6:] for r in snapshots.read_rejected(spark, str(landing)).collect()}
    assert told == {"3.json", "4.json"}


def test_a_batch_that_fails_half_way_leaves_nothing_to_be_seen(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(document("2024-01-01T00:00:00", ["a", "b"], ["v"])))
    docs, root = snapshots.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "tables")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(lake, "_run_rows", lost)
        with pytest.raises(RuntimeError):
            lake.ingest(docs, root, "1")
    assert spark.read.parquet(f"{root}/station_status").count() == 2
    assert all(lake.read_rows(spark, root, n).isEmpty() for n in (*lake.KEYED, "rejected")) and lake.read_runs(spark, root).isEmpty()
    lake.ingest(docs, root, "1")
    assert lake.read_rows(spark, root, "station_status").count() == 2 and lake.read_runs(spark, root).first().station_count == 2


def test_indented_documents_are_read_on_request(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(document("2024-01-01T00:00:00", ["a"]), indent=2))
    assert snapshots.read_raw(spark, str(tmp_path)).isEmpty() and not snapshots.read_rejected(spark, str(tmp_path)).isEmpty()
    assert snapshots.read_raw(spark, str(tmp_path), multi_line=True).count() == 1
    assert snapshots.read_rejected(spark, str(tmp_path), multi_line=True).isEmpty()
