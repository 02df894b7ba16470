"""Rules and edges of the operators on small hand-made frames."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationflow.functions import clock, geo, rules
from stationflow.operators import features, health, models, spatial, stations
from stationflow.operators.area import Area, morning_signals
from stationflow.operators.backtest import STRATEGIES, recommendation_choices, recommendation_metrics
from stationflow.operators.flows import Flows
from stationflow.operators.history import AreaHistory, CityHistory, station_catalog
from stationflow.operators.moves import Movements
from stationflow.operators.reports import area_report, departure_report, history_report, rates_in_percent

T0 = datetime(2024, 5, 1, 6, 0)
LAT, LON = 49.2, 16.6
STATUS = """collected_at timestamp_ntz, station_id string, num_bikes_available int, num_docks_available int,
    is_renting boolean, is_returning boolean, last_reported long"""
INFO = """observed_at timestamp_ntz, station_id string, name string, short_name string, region_id string, lat double,
    lon double, capacity int"""
FREE = "collected_at timestamp_ntz, bike_id string, station_id string, lat double, lon double"
CHANGES = """timestamp timestamp_ntz, nuid string, name string, latitude double, longitude double, bikes int,
    extra string"""


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def status(spark, rows):
    return spark.createDataFrame([(at(m), s, b, None, True, True, 0) for m, s, b in rows], STATUS)


def info(spark, rows=(("a", 0), ("b", 100), ("c", 5000))):
    """Stations some metres north of the point."""
    return spark.createDataFrame(
        [(T0, s, s.upper(), None, "r", None if m is None else LAT + m / 111_194.93, LON, 10) for s, m in rows], INFO
    )


def runs(spark, minutes):
    return spark.createDataFrame([(at(m), 1, 1, 0) for m in minutes], "collected_at timestamp_ntz, station_count int, bikes_available int, free_bike_count int")


def free(spark, rows):
    return spark.createDataFrame([(at(m), b, s, LAT, LON) for m, b, s in rows], FREE)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- columns ---


def test_minutes_count_boundaries_not_durations(spark):
    pairs = spark.createDataFrame([(59_000_000, 61_000_000), (0, 59_999_999), (-1, 0)], "a long, b long")
    got = [r[0] for r in pairs.select(clock.minutes_between(F.col("a"), F.col("b"))).collect()]
    assert got == [1, 0, 1]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_local_labels_fold_the_repeated_hour(spark, kind):
    times = spark.createDataFrame([("2024-10-27 00:30:00",), ("2024-10-27 01:30:00",)], "t string")
    df = times.select(F.col("t").cast(kind).alias("t"))
    us = clock.epoch_us(df, "t")
    rows = df.select(clock.hour_label(us, "Europe/Prague"), clock.minute_label(us, "Europe/Prague"), clock.month_label(us, "Europe/Prague")).collect()
    assert [tuple(r) for r in rows] == [("02:00", "02:30", "2024-10")] * 2


def test_results_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 22, 30),)], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        us = clock.epoch_us(df, "t")
        row = one(df.select(us.alias("us"), clock.hour_label(us, "Europe/Prague").alias("h"), clock.utc_wall(us).alias("w")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row.us, row.h, row.w) == (1719873000000000, "00:00", datetime(2024, 7, 1, 22, 30))


def test_distance_edges(spark):
    pairs = [(0.0, 0.0, 0.0, 180.0), (49.2, 16.6, 49.2, 16.6), (None, 1.0, 2.0, 3.0), (10.0, 20.0, -10.0, -160.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.distance_m(*(F.col(c) for c in "abcd"))).collect()]
    assert got[0] == pytest.approx(math.pi * 6_371_000) and got[1] == 0.0 and got[2] is None
    assert got[3] == pytest.approx(math.pi * 6_371_000)


def test_labels_and_scores(spark):
    bikes = spark.createDataFrame([(-1,), (0,), (1,), (2,), (3,), (4,), (None,)], "b int")
    assert [r[0] for r in bikes.select(rules.stock_risk(F.col("b"))).collect()] == [
        "empty", "empty", "high", "medium", "medium", "low", None,
    ]
    rates = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, None), (2, 0.15), (2, 0.35), (2, 0.55), (2, 0.56)], "b int, r double")
    assert [r[0] for r in rates.select(rules.strategy_advice(F.col("b"), F.col("r"))).collect()] == [
        "empty now", "last bike", "live ok", "best", "good", "watch", "risky",
    ]
    score = rules.strategy_score(F.lit(100), F.lit(9), F.lit(None).cast("double"), F.lit(None).cast("double"))
    assert one(spark.range(1).select(score))[0] == 100 + 450 + 200 - 700
    assert [r[0] for r in bikes.select(rules.low_stock_probability(F.col("b"), 1)).collect()][:5] == [1.0, 1.0, 0.5, 0.0, 0.0]


@pytest.mark.parametrize(
    "build",
    [
        lambda: rules.require_point(91, 0),
        lambda: rules.require_point(0, -181),
        lambda: features.Spans(horizon=0),
        lambda: features.Spans(horizon=30, max_target_delay=29),
        lambda: features.Spans(lag_tolerance=-1),
        lambda: models.TemporalSplit(None, 1.0),
        lambda: spatial.inner_size(19, 24),
        lambda: Movements(None, None, 0, 0, open_after_minutes=0),
        lambda: Area(None, None, 0, 0, radius_m=0),
    ],
)
def test_parameters_are_checked(build):
    with pytest.raises(ValueError):
        build()


# --- snapshots ---


def test_latest_run_without_status_rows(spark):
    rows = status(spark, [(0, "a", 1), (0, "b", None)])
    both = runs(spark, [0, 5])
    assert stations.latest_snapshot(both, rows).isEmpty()
    assert stations.top_stations_latest(rows, both, info(spark)).isEmpty()
    assert one(Area(rows, info(spark), LAT, LON).latest()).total_bikes == 1
    assert stations.system_trend(both, rows).count() == 1


def test_unknown_stock_is_neither_empty_nor_stocked(spark):
    rows = status(spark, [(0, "a", None), (0, "b", 0), (1, "a", None), (1, "b", None)])
    row = one(stations.latest_snapshot(runs(spark, [0]), rows))
    assert (row.empty_stations, row.stations_with_bikes, row.max_bikes_at_station) == (1, 0, 0)
    assert one(stations.station_map_summary(rows, runs(spark, [0]))).empty_stations == 2
    assert one(Area(rows, info(spark), LAT, LON).hourly()).all_empty_rate == 0.5
    assert one(stations.station_profile(rows, "b")).empty_rate == 0.5


def test_station_without_information_keeps_its_id_as_name(spark):
    rows = status(spark, [(0, "x", 2)])
    assert one(stations.top_stations_avg(rows, info(spark))).name == "x"
    assert stations.station_map_points(rows, runs(spark, [0]), info(spark)).isEmpty()


def test_search_prefers_the_exact_id(spark):
    table = spark.createDataFrame(
        [(T0, "b", "Zoo", None, "r", LAT, LON, 1), (T0, "1", "Abbey", None, "r", LAT, LON, 1), (T0, "2", None, "Bx", "r", LAT, LON, 1)], INFO
    )
    assert [r.station_id for r in stations.station_search(table, "B").collect()] == ["1", "2"]
    assert [r.station_id for r in stations.station_search(table, "b").collect()] == ["b", "1", "2"]


def test_reduced_dimension_is_taken_as_it_is(spark):
    reduced = stations.latest_station_info(info(spark))
    assert stations.latest_station_info(reduced).exceptAll(reduced).isEmpty()


def test_health_of_nothing_and_of_one_run(spark):
    empty = one(health.data_health(runs(spark, []), status(spark, [])))
    assert (empty.runs, empty.expected_samples, empty.gap_count, empty.free_bike_rows) == (0, None, 0, None)
    single = one(health.data_health(runs(spark, [0]), status(spark, [(0, "a", 1)])))
    assert (single.runs, single.expected_samples, single.coverage_pct, single.max_gap_seconds) == (1, 1, 100.0, None)


def test_gaps_across_days_and_recent_window(spark):
    table = runs(spark, [0, 1, 2, 60 * 30, 60 * 30 + 1])
    rows = health.data_gaps(table, 120).collect()
    assert [(r.previous_collected_at, r.gap_seconds) for r in rows] == [(at(2), (60 * 30 - 2) * 60)]
    recent = one(health.data_health(table, status(spark, []), since_hours=1, as_of=at(60 * 30 + 2)))
    assert (recent.runs, recent.gap_count) == (2, 0)
    assert one(health.freshness(table, None, at(60 * 30 + 3))).seconds_since_latest == 120


# --- area and moves ---


def test_depletion_looks_back_over_days(spark):
    rows = status(spark, [(0, "a", 2), (3 * 1440, "a", 0), (3 * 1440 + 1, "a", 0), (0, "c", 1), (1, "c", 0)])
    area = Area(rows, info(spark), LAT, LON, tz="UTC")
    assert [(r.local_hour, r.depletion_events) for r in area.depletion_by_hour().collect()] == [("06:00", 1)]


def test_area_lists_stations_without_rows(spark):
    table = Area(status(spark, [(0, "a", 2)]), info(spark), LAT, LON).station_table().collect()
    assert [(r.station_id, r.latest_bikes, r.samples) for r in table] == [("a", 2, 1), ("b", 0, 0)]


def test_morning_signals_default(spark):
    hourly = spark.createDataFrame([("06:00", 3.0, 0.0), ("13:00", 0.0, 1.0)], "local_hour string, avg_total_bikes double, all_empty_rate double")
    assert set(one(morning_signals(hourly)).asDict().values()) == {"not observed"}


def test_moves_and_departures(spark):
    seen = free(
        spark,
        [
            (0, "m", "a"), (10, "m", "b"), (20, "m", None), (300, "m", "a"),  # a > b > street > (beyond the window) a
            (0, "n", None), (5, "n", "a"),  # from the street: a move, no departure
            (0, "o", "c"), (5, "o", "c"),  # far away and still
            (299, "p", "a"),  # seen too recently to be open
        ],
    )
    moves = Movements(seen, info(spark), LAT, LON, radius_m=600, tz="UTC")
    known = {(r.bike_id, r.from_station_id, r.to_station_id) for r in moves.move_events(None).collect() if r.status == "seen-again"}
    assert known == {("m", "a", "b"), ("m", "b", None), ("n", None, "a")}
    left = [(r.bike_id, r.status, r.from_name, r.to_name) for r in moves.departures(None).collect()]
    assert sorted(left) == [
        ("m", "seen-again", "A", "B"), ("m", "seen-again", "B", "free-floating"), ("n", "not-seen", "A", "not seen again"),
    ]
    summary = one(moves.departure_summary())
    assert (summary.departures, summary.bikes, summary.known_destinations, summary.open_departures) == (3, 2, 2, 1)
    assert moves.observations().count() == 9 and moves.bike_moves().count() == 9 - 4
    assert one(moves.move_summary()).moves == 4
    report = departure_report(seen, info(spark), LAT, LON, tz="UTC")
    assert {k: v.count() for k, v in report.items()} == {"summary": 1, "hourly": 1, "destinations": 2, "departures": 3}


def test_hot_vehicle_equals_plain_window(spark):
    rows = [(7 * i % 9000, "hot", "abc"[i % 3]) for i in range(3000)] + [(i, f"v{i}", "a") for i in range(50)]
    seen = free(spark, {(m, b): (m, b, s) for m, b, s in rows}.values())
    moves = Movements(seen, info(spark, [("a", 0), ("b", 10), ("c", 20)]), LAT, LON, max_window_minutes=30, tz="UTC")
    track = sorted((m, s) for (m, b), (_, _, s) in {(m, b): (m, b, s) for m, b, s in rows}.items() if b == "hot")
    want = sum(s != t and n - m <= 30 for (m, s), (n, t) in zip(track, track[1:]))
    assert moves.departures(None).where("status = 'seen-again'").count() == want


def test_empty_feed(spark):
    moves = Movements(free(spark, []), info(spark), LAT, LON)
    assert one(moves.move_summary()).moves == 0 and one(moves.departure_summary()).departures == 0
    assert moves.departures_hourly().isEmpty()


# --- change log ---


def change_log(spark):
    def uids(*names):
        return '{"bike_uids": [' + ", ".join(f'"{n}"' for n in names) + "]}"

    rows = [
        (at(0), "a", "A", LAT, LON, 2, uids("x", "y")),
        (at(30), "b", "B", LAT + 0.05, LON, 1, uids("x")),
        (at(40), "a", "A", LAT, LON, None, uids()),
        (at(50), "a", None, LAT, LON, 0, None),
        (at(90), "a", "A", LAT, LON, 3, "{broken"),
        (at(100), "z", "Z", None, None, 3, uids("y")),
        (at(110), "b", "B", LAT + 0.05, LON, 1, uids("y")),
    ]
    return spark.createDataFrame(rows, CHANGES)


def test_area_counts_stations_as_empty_before_their_first_change(spark):
    log = change_log(spark)
    area = AreaHistory(log, LAT, LON, radius_m=10_000, sample_minutes=20, tz="UTC")
    got = {(r.nuid, r.sample_ts): r.bikes for r in area.samples().collect()}
    assert len(got) == 12 and got["b", at(0)] is None and got["b", at(40)] == 1
    assert got["a", at(40)] is None and got["a", at(60)] == 0 and got["a", at(100)] == 3
    row = one(area.summary())
    assert (row.samples, row.avg_bikes) == (6, round((2 + 2 + 1 + 1 + 1 + 4) / 6, 2))
    rates = {r.nuid: r for r in area.station_rates().collect()}
    assert rates["b"].empty_rate == round(2 / 6, 3) and rates["a"].empty_rate == round(3 / 6, 3)


def test_city_observes_from_the_first_change(spark):
    city = CityHistory(change_log(spark), 20, "UTC")
    assert city.samples().count() == 6 + 4 + 1
    rates = {r.nuid: (r.samples, r.avg_bikes) for r in city.station_rates().collect()}
    assert rates == {"a": (6, 1.4), "b": (4, 1.0), "z": (1, 3.0)}


def test_nothing_in_radius(spark):
    area = AreaHistory(change_log(spark), -40.0, 10.0, sample_minutes=20)
    assert area.stations.isEmpty() and area.hourly().isEmpty() and area.samples().isEmpty()
    assert one(area.summary()).samples == 0


def test_flows_skip_stations_without_position(spark):
    flows = Flows(change_log(spark), LAT, LON, radius_m=600, tz="UTC")
    moves = sorted((r.bike_uid, r.prev_nuid, r.nuid, r.window_minutes) for r in flows.moves.collect())
    assert moves == [("x", "a", "b", 30), ("y", "a", "b", 110)]
    row = one(flows.summary())
    assert (row.all_city_moves, row.outbound, row.inbound, row.internal, row.bikes) == (2, 2, 0, 0, 2)
    assert Flows(change_log(spark), LAT, LON, max_window_minutes=100, tz="UTC").moves.count() == 1


def test_catalog_takes_the_latest_known_value(spark):
    rows = [(at(0), "a", "Old", 1.0, 2.0, 1, None), (at(1), "a", None, None, 3.0, 1, None)]
    row = one(station_catalog(spark.createDataFrame(rows, CHANGES)))
    assert (row.station_name, row.latitude, row.longitude) == ("Old", 1.0, 3.0)


def test_reports_build_all_tables(spark):
    log = change_log(spark).withColumn("file_name", F.lit("202405-x-stats.parquet"))
    tables = rates_in_percent(history_report(log, LAT, LON, tz="UTC"))
    assert len(tables) == 20
    for name, table in tables.items():
        assert table.count() >= (0 if name in ("worst_months", "local_monthly_morning") else 1), name
    assert "all_empty_rate_pct" in tables["local_hourly"].columns
    area = area_report(status(spark, [(0, "a", 2)]), info(spark), LAT, LON)
    assert all(t.count() >= 0 for t in area.values())


# --- spatial ---


def test_radius_on_rounded_and_unrounded_metres(spark):
    table = info(spark, [("in", 600.3), ("out", 600.7)])
    rows = status(spark, [(0, "in", 1), (0, "out", 1)])
    assert [r.station_id for r in Area(rows, table, LAT, LON, 600).stations.collect()] == ["in"]
    assert spatial.nearest_stations(rows, runs(spark, [0]), table, LAT, LON, max_distance_m=600.0).isEmpty()


def test_reliable_falls_back_when_no_station_has_enough(spark):
    rows = status(spark, [(0, "a", 1), (0, "b", 4)])
    def ask(k):
        return spatial.nearest_reliable(rows, runs(spark, [0]), info(spark), LAT, LON, reliable_min_bikes=k).collect()
    assert [(r.station_id, r.fallback, r.extra_distance_m) for r in ask(2)] == [("b", False, 100)]
    assert [(r.station_id, r.fallback) for r in ask(9)] == [("a", True), ("b", True)]


def test_search_across_the_date_line(spark):
    table = spark.createDataFrame([(T0, "e", "E", None, "r", 0.0, 179.9995, 1), (T0, "w", "W", None, "r", 0.0, -179.9995, 1)], INFO)
    rows = status(spark, [(0, "e", 1), (0, "w", 1)])
    got = spatial.nearest_stations(rows, runs(spark, [0]), table, 0.0, 180.0, max_distance_m=100.0)
    assert got.count() == 2


def test_strategy_needs_a_snapshot_and_a_fitting_radius(spark):
    rows = status(spark, [(0, "a", 1)])
    with pytest.raises(ValueError):
        spatial.strategy_ranking(rows, runs(spark, []), info(spark), None, LAT, LON, "08:00")
    with pytest.raises(ValueError):
        spatial.strategy_ranking(rows, runs(spark, [0]), info(spark), None, LAT, LON, "08:00", local_radius_m=2000)


def test_best_strategy_uses_fallback(spark):
    ranking = spatial.strategy_ranking(
        status(spark, [(0, "a", 0), (0, "b", 0), (0, "c", 3)]), runs(spark, [0]), info(spark), None, LAT, LON, "08:00",
        limit=None, max_walk_m=9000,
    )
    best = one(spatial.strategy_best(ranking))
    assert (best.best_station_id, best.local_station_id, best.uses_fallback) == ("c", None, True)
    assert one(spatial.strategy_best(ranking.where("bikes = 0"))).uses_fallback is False


SQUARE = '{"type": "Polygon", "coordinates": [[[0,0],[10,0],[10,10],[0,10],[0,0]], [[4,4],[6,4],[6,6],[4,6],[4,4]]]}'


def test_polygon_with_hole_and_edges(spark):
    points = {(5, 5): False, (2, 2): True, (11, 5): False, (0, 5): True, (10, 5): False, (6, 5): True, (4, 5): False, (-1, 5): False, (5, 10): False}
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "lon double, lat double")
    got = {(r.lon, r.lat): r.inside for r in spatial.with_inside(df, SQUARE).collect()}
    assert got == {(float(x), float(y)): v for (x, y), v in points.items()}
    holes = df.union(spark.createDataFrame([(None, 5.0)], "lon double, lat double"))
    assert spatial.geofence_filter(holes, SQUARE).count() == sum(points.values())
    with pytest.raises(ValueError):
        spatial.geofence_filter(df, '{"type": "Point", "coordinates": [1, 2]}')


def test_grid_of_one_point(spark):
    cell = one(spatial.grid_bin(spark.createDataFrame([(LAT, LON, 0)], "lat double, lon double, bikes int"), 21, 9))
    assert (cell.x, cell.y, cell.points, cell.any_bikes, cell.symbol) == (9, 3, 1, False, ".")


# --- features, models, backtest ---


def test_lookup_bounds_are_inclusive_and_rolling_leaves_out_now(spark):
    rows = status(spark, [(0, "a", 1), (15, "a", 2), (30, "a", 0), (60, "a", 4), (70, "a", 5)])
    got = {r.collected_at: r for r in features.availability_dataset(rows, info(spark)).collect()}
    assert set(got) == {at(0), at(30)}
    row = got[at(30)]
    assert (row.bikes_lag_5m, row.minutes_since_lag_5m) == (2, 15)
    assert (row.bikes_lag_15m, row.minutes_since_lag_15m, row.bikes_delta_15m) == (2, 15, -2)
    assert (row.samples_30m, row.bikes_avg_30m, row.empty_rate_30m) == (2, 1.5, 0.0)
    assert (row.bikes_future, row.minutes_to_target, row.empty_future) == (4, 30, False)
    assert (got[at(0)].samples_30m, got[at(0)].bikes_avg_30m, got[at(0)].bikes_lag_5m) == (0, None, None)
    assert got[at(0)].bikes_future == 0 and got[at(0)].empty_future is True


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "station_id string")


def test_latest_features_equal_dataset_columns(spark):
    rows = status(spark, [(m, s, (m + len(s)) % 3) for m in range(0, 90, 5) for s in ("a", "bb")])
    table = info(spark, [("a", 0), ("bb", None)])
    last = features.latest_features(rows.where(F.col("collected_at") <= at(45)), table, runs(spark, [0, 45]), ids(spark, "a", "bb"))
    whole = features.availability_dataset(rows, table).where(F.col("collected_at") == at(45))
    assert last.count() == 2
    assert last.exceptAll(whole.select(*features.MODEL_FEATURES)).isEmpty()
    assert features.latest_features(rows, table, runs(spark, [45]), ids(spark)).isEmpty()


def test_split_points(spark):
    def split(n, fraction):
        ds = spark.createDataFrame([(at(60 * i),) for i in range(n) for _ in range(2)], "collected_at timestamp_ntz")
        return one(models.TemporalSplit(ds, fraction).summary())
    assert (split(100, 0.25).split_collected_at, split(100, 0.25).test_rows) == (at(75 * 60), 50)
    assert split(2, 0.9).train_rows == 2 and split(2, 0.01).test_rows == 2
    for n in (0, 1):
        with pytest.raises(ValueError):
            split(n, 0.25)


def scored(spark, rows):
    return spark.createDataFrame([("m", bool(y), p >= 0.5, float(p)) for y, p in rows], "model string, y boolean, y_hat boolean, score double")


def test_metrics_by_hand(spark):
    row = one(models.binary_metrics(scored(spark, [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)])))
    assert (row.accuracy, row.precision, row.recall) == (4 / 6, 2 / 3, 2 / 3)
    assert row.roc_auc == pytest.approx((2.5 + 2.0 + 1.5) / 9)
    assert row.average_precision == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)


def test_metrics_of_one_class_and_of_ties(spark):
    row = one(models.binary_metrics(scored(spark, [(0, 0.2), (0, 0.1)])))
    assert (row.accuracy, row.precision, row.recall, row.f1, row.roc_auc, row.average_precision) == (1.0, 0.0, 0.0, 0.0, None, None)
    tied = one(models.binary_metrics(scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)])))
    assert (tied.roc_auc, tied.average_precision) == (0.5, 0.5)


def test_metrics_equal_pairwise_counting(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.random() < 0.4, round(rng.random(), 5)) for _ in range(700)]
    got = one(models.binary_metrics(scored(spark, rows)))
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert got.roc_auc == pytest.approx(auc, abs=1e-12)


def test_trained_models_beat_chance_and_reload(spark, tmp_path):
    rows = status(spark, [(5 * i, s, max(0, (i // 7 + j) % 4 - 1)) for i in range(160) for j, s in enumerate("abcd")])
    table = info(spark, [("a", 0), ("b", 100), ("c", 300), ("d", None)])
    ds = models.check_columns(features.availability_dataset(rows, table))
    split = models.TemporalSplit(ds.persist())
    metrics, fitted = models.train_models(split, str(tmp_path / "models"), rounds=5)
    found = {r.model: r for r in metrics.collect()}
    assert set(found) == {"logistic_regression", "boosted_trees"}
    assert all(r.roc_auc > 0.7 for r in found.values())
    latest = features.latest_features(rows, table, runs(spark, [795]), ids(spark, "a", "b", "c", "d"))
    again = models.load_model(str(tmp_path / "models" / "logistic_regression"))
    want = {r.station_id: r for r in models.predict_latest_risk(fitted["logistic_regression"], latest).collect()}
    got = {r.station_id: r for r in models.predict_latest_risk(again, latest).collect()}
    assert len(got) == 4 and got == want
    assert all(0 <= r.empty_probability <= 1 and r.risk_label in ("low", "medium", "high") for r in got.values())
    with pytest.raises(ValueError):
        models.check_columns(ds.drop("empty_future"))


def test_trees_take_places_as_categories(spark):
    """A station is one feature of the trees, whatever the number of places, and one that training did not show is scored too."""
    rows = status(spark, [(5 * i, s, int(i % 9 > 0) if s in "ab" else int(i % 9 == 0)) for i in range(90) for s in "abcd"])
    table = info(spark, [(s, 0) for s in "abcd"])
    ds = features.availability_dataset(rows, table)
    model = models.train_boosted_trees(ds.persist(), rounds=2)
    assert model.stages[-1].numFeatures == len(features.NUMERIC) + len(features.CATEGORICAL)
    strange = ds.withColumns({"station_id": F.lit("unseen"), "region_id": F.lit(None).cast("string")})
    scores = [r[0] for r in models.model_scores(model, ds.unionByName(strange)).select("empty_probability").collect()]
    assert len(scores) == 2 * ds.count() and all(0 <= p <= 1 for p in scores)


def test_backtest_reports_origins_without_candidates(spark):
    schema = "collected_at timestamp_ntz, station_id string, lat double, lon double, bikes_now int, has_bike_now boolean, has_bike_future boolean, empty_probability double"
    rows = [
        (at(0), "a", LAT, LON, 1, True, False, 0.9),
        (at(0), "b", LAT + 0.001, LON, 3, True, True, 0.1),
        (at(0), "e", LAT, LON, 0, False, True, 0.0),
        (at(5), "a", None, None, 1, True, True, 0.1),
    ]
    choices = recommendation_choices(spark.createDataFrame(rows, schema), [("here", LAT, LON), ("far", 0.0, 0.0)])
    picked = {(r.strategy, r.origin, r.collected_at): r.station_id for r in choices.collect()}
    assert len(picked) == 4 * 2 * 2
    assert [picked[s, "here", at(0)] for s in STRATEGIES] == ["a", "b", "b", "b"]
    assert all(v is None for k, v in picked.items() if k[1] == "far" or k[2] == at(5))
    metric = {r.strategy: r for r in recommendation_metrics(choices).collect()}
    assert metric["nearest_with_bike"].asDict()["success_rate"] == 0.0
    assert (metric["nearest_bikes_ge_2"].attempts, metric["nearest_bikes_ge_2"].no_candidate) == (4, 3)
    assert metric["nearest_bikes_ge_2"].avg_extra_distance_m == metric["nearest_bikes_ge_2"].avg_distance_m
