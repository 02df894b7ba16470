"""Two-level windows, time slots, carried states and restriction against brute force, with a hot key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stationflow.functions.clock import DAY_US, HOUR_US, floor_div
from stationflow.plans.bins import BIN, day_cuts, in_bins
from stationflow.plans.carry import Grid, on_ticks, states, totals_per_tick
from stationflow.plans.reach import around, home_rows, spread
from stationflow.plans.restrict import restrict
from stationflow.plans.twolevel import previous_and_last, with_previous, with_running_sums

T0 = 1_700_000_000_000_000


def hot_rows(spark, n=3000, span_us=40 * DAY_US, seed=1):
    """(k, us, v) where key 0 holds more than a third of all rows and another key a single row."""
    rng = random.Random(seed)
    times = rng.sample(range(span_us), n)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3]), T0 + t, rng.randrange(5)) for t in times]
    return spark.createDataFrame([*rows, (9, T0 + 5, 1)], "k int, us long, v int")


@pytest.mark.parametrize("bin_us", [HOUR_US, DAY_US, 90 * DAY_US])
def test_previous_row_equals_plain_lag(spark, bin_us):
    df = hot_rows(spark)
    plain = df.withColumn("p", F.lag(F.struct("us", "v")).over(Window.partitionBy("k").orderBy("us")))
    ours = with_previous(df, ["k"], "us", ["us", "v"], "p", bin_us=bin_us)
    assert ours.count() == df.count()
    assert ours.select("k", "us", "v", "p").exceptAll(plain.select("k", "us", "v", "p")).isEmpty()


def crowded_rows(spark):
    """Half of all rows are of one key within an hour, many of them at equal times."""
    rng = random.Random(4)
    rows = [(0, T0 + rng.randrange(3600) * 1_000_000 + rng.choice([0, 0, 7]), rng.randrange(9)) for _ in range(1500)]
    rows += [(rng.randrange(1, 5), T0 + rng.randrange(40 * DAY_US), rng.randrange(9)) for _ in range(1500)]
    return spark.createDataFrame(sorted(set(rows)), "k int, us long, v int")


@pytest.mark.parametrize("most", [1, 25, 10**6])
def test_measured_bins_are_even_and_give_previous_and_last_rows(spark, most):
    df = crowded_rows(spark)
    binned = in_bins(df, ["k"], "us", day_cuts(df, ["k"], "us", most)).cache()
    in_a_second = df.groupBy("k", floor_div(F.col("us"), 1_000_000)).count().agg(F.max("count")).first()[0]
    largest = binned.groupBy("k", BIN).count().agg(F.max("count")).first()[0]
    assert binned.count() == df.count() and largest < most + in_a_second
    bins = binned.groupBy("k", BIN).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    later = F.lag("last").over(Window.partitionBy("k").orderBy(BIN))
    assert bins.withColumn("before", later).where("before >= first").isEmpty()
    paired, last = previous_and_last(binned, ["k"], "us", ["us", "v"], "p", ties=["v"])
    order = Window.partitionBy("k").orderBy("us", "v")
    plain = df.withColumns({"p": F.lag(F.struct("us", "v")).over(order), "e": F.lead("us").over(order).isNull()})
    assert paired.count() == df.count()
    assert paired.select("k", "us", "v", "p").exceptAll(plain.select("k", "us", "v", "p")).isEmpty()
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, plain.where("e").select("k", "us", "v").collect()))


def test_vehicles_are_read_once(spark, tmp_path):
    """Pairs and last sightings come from one exchange of the sightings, besides the count of rows per day."""
    df = crowded_rows(spark)
    df.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    cuts = day_cuts(rows, ["k"], "us", 50)
    paired, last = previous_and_last(in_bins(rows, ["k"], "us", cuts), ["k"], "us", ["us", "v"], "p", ties=["v"])
    both = paired.select("k", "us").unionByName(last.select("k", "us"))
    both.collect()
    final = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line and "us#" in line]
    assert len(scans) == 1 and "ReusedExchange" in final


def test_previous_row_without_key(spark):
    df = hot_rows(spark).dropDuplicates(["us"])
    plain = df.withColumn("p", F.lag(F.struct("us")).over(Window.orderBy("us")))
    ours = with_previous(df, [], "us", ["us"], "p")
    assert ours.select("us", "p").exceptAll(plain.select("us", "p")).isEmpty()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_plain_window(spark, descending):
    df = hot_rows(spark).dropDuplicates(["k", "us"])
    order = F.col("us").desc() if descending else F.col("us")
    plain = df.withColumn(
        "s", F.sum("v").over(Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    )
    ours = with_running_sums(df, ["k"], floor_div(F.col("us"), DAY_US), [order], {"s": "v"}, descending)
    assert ours.select("k", "us", "s").exceptAll(plain.select("k", "us", "s")).isEmpty()


@pytest.mark.parametrize("slot_us", [None, HOUR_US * 30])
def test_slots_see_all_rows_in_reach(spark, slot_us):
    df = hot_rows(spark)
    back, ahead = 20 * HOUR_US, 7 * HOUR_US
    spaced = spread(df, F.col("us"), back, ahead, slot_us)
    frame = around(["k"], "us").rangeBetween(-back, ahead)
    ours = home_rows(spaced.withColumn("n", F.count("v").over(frame)).withColumn("s", F.sum("v").over(frame)))
    whole = Window.partitionBy("k").orderBy("us").rangeBetween(-back, ahead)
    plain = df.withColumn("n", F.count("v").over(whole)).withColumn("s", F.sum("v").over(whole))
    assert ours.count() == df.count()
    assert ours.select("k", "us", "v", "n", "s").exceptAll(plain.select("k", "us", "v", "n", "s")).isEmpty()


def test_slots_spread_a_hot_key_and_copy_little(spark):
    df = hot_rows(spark)
    spaced = spread(df, F.col("us"), HOUR_US, HOUR_US)
    slots = spaced.where("k = 0").select("_slot").distinct().count()
    assert slots >= 40
    assert spaced.count() <= df.count() * 1.2


def changes(spark, n=400, stations=6, seed=3):
    rng = random.Random(seed)
    start = datetime(2024, 3, 29)
    rows = []
    for i in range(n):
        station = rng.choice([0, 0, 0, *range(stations)])
        at = start + timedelta(seconds=rng.randrange(4 * 86400) if station < stations - 1 else 300_000 + i)
        rows.append((at, str(station), rng.choice([0, 1, 2, 5, None])))
    rows.append((start + timedelta(days=4, minutes=7), "late", 3))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, nuid string, bikes int"), rows


def brute(rows, minutes, listed=None):
    lo, hi = min(r[0] for r in rows), max(r[0] for r in rows)
    ticks = [lo + timedelta(minutes=minutes * i) for i in range(int((hi - lo) / timedelta(minutes=minutes)) + 1)]
    found = set()
    for station in listed or {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == station), key=lambda r: (r[0], r[2] is not None, r[2]))
        for i, tick in enumerate(ticks):
            before = [r for r in mine if r[0] <= tick]
            if before or listed:
                found.add((station, i, before[-1][2] if before else None))
    return found, len(ticks)


@pytest.mark.parametrize("minutes", [7, 60, 3000])
def test_states_equal_as_of_lookup(spark, minutes):
    df, rows = changes(spark)
    grid = Grid(df, minutes)
    want, ticks = brute(rows, minutes)
    got = [(r.nuid, r.tick, r.bikes) for r in on_ticks(states(grid)).collect()]
    assert grid.last_tick + 1 == ticks and grid.ticks().count() == ticks
    assert set(got) == want and len(got) == len(want)
    listed = spark.createDataFrame([("0",), ("late",), ("nowhere",)], "nuid string")
    want, _ = brute(rows, minutes, ["0", "late", "nowhere"])
    got = [(r.nuid, r.tick, r.bikes) for r in on_ticks(states(grid, df, listed).where("nuid in ('0','late','nowhere')")).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("ticks_per_bin", [4_096, 5])
def test_totals_equal_sums_over_samples(spark, monkeypatch, ticks_per_bin):
    monkeypatch.setattr("stationflow.plans.carry.TICKS_PER_BIN", ticks_per_bin)
    df, _ = changes(spark)
    grid = Grid(df, 31)
    state = states(grid)
    plain = on_ticks(state).groupBy("tick").agg(
        F.count(F.lit(1)).alias("observed"),
        F.sum("bikes").cast("long").alias("total_bikes"),
        F.sum((F.col("bikes") > 0).cast("long")).alias("with_bikes"),
        F.sum((F.col("bikes") == 0).cast("long")).alias("empty"),
    )
    ours = totals_per_tick(grid, state)
    assert ours.count() == plain.count()
    assert ours.select(*plain.columns).exceptAll(plain).isEmpty()


def test_empty_change_log(spark):
    df, _ = changes(spark)
    grid = Grid(df.limit(0), 15)
    assert grid.last_tick == -1
    assert states(grid).isEmpty() and totals_per_tick(grid, states(grid)).isEmpty()


def test_large_stock_at_one_time_is_told_apart(spark):
    df, _ = changes(spark)
    for stocks in ([2_000_000, 3_000_000, None], [None, 3_000_000, 2_000_000], [-5, None]):
        rows = df.limit(1).withColumn("bikes", F.explode(F.lit([s for s in stocks if s is not None]))).withColumn("bikes", F.col("bikes").cast(dict(df.dtypes)["bikes"]))
        rows = rows.unionByName(rows.limit(1).withColumn("bikes", F.lit(None).cast(dict(df.dtypes)["bikes"])))
        grid = Grid(rows, 200 * 24 * 60)
        assert [r.bikes for r in states(grid).collect()] == [max(s for s in stocks if s is not None)]


def test_restrict_keeps_or_drops(spark):
    df, rows = changes(spark)
    ids = spark.createDataFrame([("0",), ("late",), (None,), ("absent",)], "nuid string")
    kept = restrict(df, "nuid", ids).count()
    assert kept == sum(r[1] in ("0", "late") for r in rows)
    assert restrict(df, "nuid", ids, keep=False).count() == len(rows) - kept
    assert restrict(df, "nuid", ids.limit(0)).isEmpty()
    assert restrict(df, "nuid", ids.limit(0), keep=False).count() == len(rows)
