"""Running aggregates and labels over a status stream that carries a watermark on ``collected_at``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.functions.clock import MINUTE_US
from stationflow.functions.rules import require, round_to, tally
from stationflow.streaming.buckets import BUCKET, BUCKETS, Bucket, bucket_of, use_state_lists


def live_runs(status: DataFrame) -> DataFrame:
    """One run row per snapshot, given out once the watermark has passed it (append mode)."""
    bikes = F.col("num_bikes_available")
    return status.groupBy("collected_at").agg(
        F.count(F.lit(1)).alias("station_count"),
        F.sum(F.coalesce(bikes, F.lit(0))).alias("bikes_available"),
        tally(bikes == 0).alias("empty_stations"),
        round_to(F.avg(bikes), 2).alias("avg_bikes_per_station"),
        F.max(bikes).alias("max_bikes_at_station"),
    )


class Labeller(Bucket):
    """Pairs each row to be labelled with the first later state of its station between ``near_us`` and ``far_us`` after it.

    A row waits until the watermark has passed its target or the end of its band. Later states wait until the watermark has
    passed them: rows that come after that lie later still, and so do their bands.
    """

    def __init__(self, row: T.StructType, columns: list[str], near_us: int, far_us: int):
        super().__init__(row)
        self.columns, self.near_us, self.far_us = columns, near_us, far_us

    def due(self, rows: pa.Table) -> int | None:
        """When the first of the later states is passed, or the first band has ended."""
        return pc.min(pc.if_else(rows["later"], rows["us"], pc.add(rows["us"], self.far_us))).as_py()

    def settle(self, rows: pa.Table, passed: int) -> tuple[list[pa.Table], pa.Table]:
        us, later = rows["us"].to_numpy(), rows["later"].to_numpy()
        # a row stands where its band begins, before the states of that time, and copies of it side by side
        at = rows.append_column("at", pa.array(np.where(later, us, us + self.near_us), pa.int64()))
        usable = np.flatnonzero(~later | (us <= passed))
        order = [(name, "ascending") for name in ("station_id", "at", "later", "bikes")]
        places = usable[pc.sort_indices(at.take(pa.array(usable)), order).to_numpy()]
        lines = rows.take(pa.array(places)).combine_chunks()
        n = lines.num_rows
        if not n:
            return [], rows
        codes = pc.dictionary_encode(lines["station_id"].chunk(0)).indices.to_numpy()
        times, is_state = lines["us"].to_numpy(), lines["later"].to_numpy()
        # the next state from each place on; n: none
        ahead = np.minimum.accumulate(np.where(is_state, np.arange(n), n)[::-1])[::-1]
        target = np.minimum(ahead, n - 1)
        found = ~is_state & (ahead < n) & (codes[target] == codes) & (times[target] <= times + self.far_us)
        copy = np.append(False, (codes[1:] == codes[:-1]) & (times[1:] == times[:-1]) & (is_state[1:] == is_state[:-1]))
        given = np.flatnonzero(found & ~copy)
        rows_given, goals = lines.take(pa.array(given)), lines.take(pa.array(target[given]))
        out = pa.table([rows_given["station_id"], rows_given["us"], goals["us"], goals["bikes"]], names=self.columns)
        wait = us > np.where(later, passed, passed - self.far_us)
        wait[places[found]] = False
        return [out], rows.filter(pa.array(wait))


def live_labels(
    status: DataFrame, later: DataFrame, horizon_minutes: int = 30, max_delay_minutes: int = 40, buckets: int = BUCKETS
) -> DataFrame:
    """Label per row: its station's first state within the target band.

    ``later`` is a second reading of the same source with its own watermark. Both wait in buckets of stations (``buckets``) until
    the watermark has passed the target, so state is kept for the delay and the band's length; of states at one time the lowest is taken.
    """
    require(horizon_minutes > 0, "horizon_minutes: above 0")
    require(max_delay_minutes >= horizon_minutes, "the latest target may not lie before the horizon")
    use_state_lists(status.sparkSession)

    def rows(side: DataFrame, is_later: bool) -> DataFrame:
        bikes = F.coalesce("num_bikes_available", F.lit(0)) if is_later else F.lit(0)
        known = side.where(F.col("station_id").isNotNull() & F.col("collected_at").isNotNull())
        return known.select(
            bucket_of("station_id", buckets),
            "collected_at",
            "station_id",
            F.unix_micros("collected_at").alias("us"),
            F.lit(is_later).alias("later"),
            bikes.alias("bikes"),
        )

    both = rows(status, False).unionAll(rows(later, True))
    kinds = both.schema
    row = T.StructType([kinds[name] for name in ("station_id", "us", "later", "bikes")])
    schema = T.StructType(
        [kinds["station_id"], kinds["us"], T.StructField("target_us", T.LongType()), T.StructField("bikes_future", kinds["bikes"].dataType)]
    )
    labeller = Labeller(row, schema.names, horizon_minutes * MINUTE_US, max_delay_minutes * MINUTE_US)
    found = both.groupBy(BUCKET).transformWithStateInPandas(labeller, schema, "append", "eventTime")
    return found.select(
        "station_id",
        F.timestamp_micros("us").alias("collected_at"),
        F.timestamp_micros("target_us").alias("target_collected_at"),
        "bikes_future",
        (F.col("bikes_future") == 0).alias("empty_future"),
    )
