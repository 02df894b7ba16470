"""Previous-row logic on streams, in event-time order whatever the order of arrival.

A micro-batch holds rows as files arrive. They wait in buckets of keys (``buckets``) until the watermark has passed them and are
then handled in time order. So a trigger costs what it brings, and the state of a bucket is the last row of each of its keys and
the rows of one delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stationflow.functions.clock import DAY_US, MINUTE_US, floor_div, minutes_between, seconds_between
from stationflow.functions.rules import require
from stationflow.streaming.buckets import BUCKET, BUCKETS, Bucket, bucket_of, packed, unpacked, use_state_lists

#: Kinds of rows that ``follow`` gives out.
NEXT, IDLE, LAST = "next", "idle", "last"


class Follower(Bucket):
    """Hands out the rows of each key in time order, each with the one before it.

    ``idle_us``: tell when a key has shown no row for that long. ``span_us``: the key is the number of a span of time of that
    length; once the watermark has passed its end its last row is told and its state dropped.
    """

    def __init__(self, row: T.StructType, columns: list[str], idle_us: int | None, span_us: int | None):
        super().__init__(row)
        self.columns, self.idle_us, self.span_us = columns, idle_us, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("last", self.STATE)

    def settle(self, rows: pa.Table, passed: int) -> tuple[list[pa.Table], pa.Table]:
        due = pc.less_equal(rows["us"], passed)
        ready, rest = rows.filter(due), rows.filter(pc.invert(due))
        lines = _line(ready, came=True, told=self.idle_us is None)
        if self.held.exists():
            lines = pa.concat_tables([unpacked(self.held.get()), lines])
        if not lines.num_rows:
            return [], rest
        key, *carry = self.row.names
        # the row held from before is the first of its key
        order = [(name, "ascending") for name in (key, "came", *carry)]
        lines = lines.take(pc.sort_indices(lines, order, null_placement="at_start")).combine_chunks()
        codes = pc.dictionary_encode(lines[key].chunk(0), null_encoding="encode").indices.to_numpy()
        us, came, told = (lines[name].to_numpy() for name in ("us", "came", "told"))
        follows = np.append(False, codes[1:] == codes[:-1])
        last = np.append(~follows[1:], True)

        new = np.flatnonzero(came)
        out = [self._given(NEXT, lines, new, new, np.where(follows[new], new - 1, -1))]
        ended = np.zeros(len(us), bool)
        if self.idle_us is not None:
            before = new[follows[new]] - 1
            late = before[~told[before] & (us[before + 1] - 1 >= us[before] + self.idle_us)]
            quiet = np.flatnonzero(last & ~told & (us + self.idle_us <= passed))
            out += [self._given(IDLE, lines, at, None, at) for at in (late, quiet)]
            told = told.copy()
            told[quiet] = True
        if self.span_us is not None:
            ends = (lines[key].to_numpy() + 1) * self.span_us
            ended = last & (ends <= passed)
            over = np.flatnonzero(ended)
            out.append(self._given(LAST, lines, over, None, over))
            self._wake_at(ends[last & ~ended])
        keep = last & ~ended
        if keep.any():
            kept = lines.take(np.flatnonzero(keep)).select(self.row.names)
            self.held.update(packed(_line(kept, came=False, told=told[keep])))
            if self.idle_us is not None:
                self._wake_at(us[keep & ~told] + self.idle_us)
        else:
            self.held.clear()
        return out, rest

    def _given(self, kind: str, lines: pa.Table, key, now, before) -> pa.Table:
        """Rows to give out by their places in ``lines``; a place below 0 (``now``: None) is NULL."""
        name, *carry = self.row.names
        now = np.full(len(key), -1) if now is None else now
        places = [pa.array(at, pa.int64(), mask=at < 0) for at in (now, before)]
        parts = [lines[c].take(at) for at in places for c in carry]
        return pa.table([pa.array([kind] * len(key), pa.string()), lines[name].take(pa.array(key)), *parts], names=self.columns)

    def _wake_at(self, times: np.ndarray) -> None:
        if len(times):
            self.wake(int(times.min()))


def _line(rows: pa.Table, **flags) -> pa.Table:
    """``rows`` with flags, each of one value for all rows or of one for each."""
    for name, value in flags.items():
        rows = rows.append_column(name, pa.array(np.broadcast_to(value, rows.num_rows), pa.bool_()))
    return rows


def follow(
    stream: DataFrame, key: str, time: str, carry: list[str], idle_us: int | None = None, span_us: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Pairs of consecutive rows per key: ``kind, key, us, <carry>, previous_us, previous_<carry>``.

    ``kind`` is 'next' for a row with the one before it (NULL for the first); 'idle' (with ``idle_us``) for a key that showed no row
    for that long, and 'last' (with ``span_us``) for the last row of a span, both with a NULL current part.
    """
    use_state_lists(stream.sparkSession)
    rows = stream.select(bucket_of(key, buckets), time, key, F.unix_micros(time).alias("us"), *carry)
    kinds = {f.name: f.dataType for f in rows.schema}
    names = ["us", *carry]
    row = T.StructType([T.StructField(n, kinds[n]) for n in (key, *names)])
    schema = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField(key, kinds[key])]
        + [T.StructField(n, kinds[n]) for n in names]
        + [T.StructField(f"previous_{n}", kinds[n]) for n in names]
    )
    follower = Follower(row, schema.names, idle_us, span_us)
    return rows.groupBy(BUCKET).transformWithStateInPandas(follower, schema, "append", "eventTime")


def depletion_stream(status: DataFrame) -> DataFrame:
    """Moments a station runs out."""
    pairs = follow(status, "station_id", "collected_at", ["num_bikes_available"])
    ran_out = (F.col("previous_num_bikes_available") > 0) & (F.col("num_bikes_available") == 0)
    return pairs.where(ran_out).select("station_id", F.timestamp_micros("us").alias("collected_at"))


def departure_stream(free: DataFrame, max_window_minutes: int = 240, open_after_minutes: int = 3) -> DataFrame:
    """Departures from known stations: 'not-seen' once a vehicle is overdue, 'seen-again' when it shows
    up elsewhere within the window. A vehicle told as not seen may be seen again later."""
    require(max_window_minutes > 0, "max_window_minutes: above 0")
    require(open_after_minutes > 0, "open_after_minutes: above 0")
    pairs = follow(free, "bike_id", "collected_at", ["station_id"], open_after_minutes * MINUTE_US)
    window = minutes_between(F.col("previous_us"), F.col("us"))
    moved = F.coalesce("station_id", F.lit("")) != F.col("previous_station_id")
    again = (F.col("kind") == NEXT) & moved & (window <= max_window_minutes)
    known = pairs.where(F.col("previous_station_id").isNotNull() & ((F.col("kind") == IDLE) | again))
    return known.select(
        F.when(F.col("kind") == IDLE, "not-seen").otherwise("seen-again").alias("status"),
        "bike_id",
        F.timestamp_micros("previous_us").alias("departed_after"),
        F.timestamp_micros("us").alias("next_seen_at"),
        F.col("previous_station_id").alias("from_station_id"),
        F.col("station_id").alias("to_station_id"),
        window.alias("window_minutes"),
    )


class DayEdges(StatefulProcessor):
    """Second level of the gaps: the last run of a day is handed to the first run of the next day that has any.

    Gaps found within a day pass through under that day's key; edges, two rows a day, meet under one key. A day's rows come in
    the trigger in which the watermark passes them, so later triggers only bring later days.
    """

    EDGES = -1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for batch in rows:
            for us, previous in zip(batch["us"], batch["previous_us"]):
                found.append(tuple(None if v is None or v != v else int(v) for v in (us, previous)))
        if key[0] != self.EDGES:
            pairs = found
        else:
            last = self.held.get()[0] if self.held.exists() else None
            pairs = []
            # a day's first run (no previous) comes before its last one (no current)
            for us, previous in sorted(found, key=lambda f: (f[0] if f[0] is not None else f[1], f[0] is None)):
                if us is None:
                    last = previous
                else:
                    pairs.append((us, last))
            if last is not None:
                self.held.update((last,))
        if pairs:
            yield pd.DataFrame({n: pd.Series(c, dtype="object") for n, c in zip(("us", "previous_us"), zip(*pairs))})

    def close(self) -> None:
        pass


def gap_stream(runs: DataFrame, gap_threshold_seconds: int = 120) -> DataFrame:
    """Gaps between runs, found within each UTC day and, from one row per day's edge, between days."""
    use_state_lists(runs.sparkSession)

    def gap() -> Column:
        return seconds_between(F.col("previous_us"), F.col("us"))

    daily = runs.select(floor_div(F.unix_micros("collected_at"), DAY_US).alias("day"), "collected_at")
    rows = follow(daily, "day", "collected_at", [], span_us=DAY_US)
    edge = F.col("us").isNull() | F.col("previous_us").isNull()
    kept = rows.where(edge | (gap() > gap_threshold_seconds))
    lanes = kept.select(F.when(edge, F.lit(DayEdges.EDGES).cast("long")).otherwise(F.col("day")).alias("lane"), "us", "previous_us")
    pairs = lanes.groupBy("lane").transformWithStateInPandas(DayEdges(), "us long, previous_us long", "append", "none")
    return pairs.where(gap() > gap_threshold_seconds).select(
        F.timestamp_micros("previous_us").alias("previous_collected_at"),
        F.timestamp_micros("us").alias("collected_at"),
        gap().alias("gap_seconds"),
    )
