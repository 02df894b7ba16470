"""Station state on a regular time grid, from irregular change events.

Between two ticks only the last change of a station can be seen, so changes are first reduced to one row
per (station, tick), combined before the shuffle. What is left per station is bounded by the number of
ticks, whatever the number of its changes, and a ``lead`` over it gives tick ranges of constant state.
Totals per tick then come from adding up state differences; the station x tick table is only built where
it is the result itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.clock import MINUTE_US, epoch_us, floor_div, time_like
from stationflow.functions.rules import require
from stationflow.plans.twolevel import with_running_sums

TICKS_PER_BIN = 4_096


@dataclass
class Grid:
    """Ticks from the first to the last change, both ends included.

    The bounds are one row, fetched once, so every plan below works with plain numbers. ``catalog`` is an
    optional small table with ``first_us`` and ``last_us`` per station; with it the bounds need no
    scan of the changes.
    """

    changes: DataFrame
    minutes: int
    catalog: DataFrame | None = None

    def __post_init__(self) -> None:
        require(self.minutes > 0, "sample_minutes: above 0")

    @property
    def step_us(self) -> int:
        return self.minutes * MINUTE_US

    @cached_property
    def bounds(self) -> tuple[int, int]:
        """First and last change; (0, -1) if there is none."""
        if self.catalog is not None:
            row = self.catalog.agg(F.min("first_us"), F.max("last_us")).first()
        else:
            us = epoch_us(self.changes, "timestamp")
            row = self.changes.agg(F.min(us), F.max(us)).first()
        return (0, -1) if row[0] is None else (row[0], row[1])

    @property
    def last_tick(self) -> int:
        """-1 without any change."""
        first, last = self.bounds
        return (last - first) // self.step_us

    def tick_of(self, us: Column) -> Column:
        """First tick at or after ``us``."""
        return floor_div(us - self.bounds[0] + (self.step_us - 1), self.step_us)

    def tick_us(self, tick: Column) -> Column:
        return tick * self.step_us + self.bounds[0]

    def tick_time(self, tick: Column) -> Column:
        return time_like(self.changes, "timestamp", self.tick_us(tick))

    def ticks(self) -> DataFrame:
        """One row per tick."""
        return self.changes.sparkSession.range(self.last_tick + 1).withColumnRenamed("id", "tick")


def states(grid: Grid, changes: DataFrame | None = None, stations: DataFrame | None = None) -> DataFrame:
    """(nuid, lo, hi, bikes): the station shows ``bikes`` on ticks lo..hi.

    With ``stations`` every listed station is covered from tick 0, with NULL bikes before its first
    change; without, a station starts at its first change.
    """
    changes = grid.changes if changes is None else changes
    us = epoch_us(changes, "timestamp")
    seen = changes.where(F.col("nuid").isNotNull()).select("nuid", us.alias("us"), "bikes")
    seen = seen.withColumn("lo", grid.tick_of(F.col("us"))).where(F.col("lo") <= grid.last_tick)
    # order within the tick: time, then known before unknown stock, then the larger stock
    seen = seen.select("nuid", "lo", "bikes", F.struct("us", F.col("bikes").isNotNull().alias("known"), "bikes").alias("rank"))
    if stations is not None:
        blank = F.lit(None).cast(dict(changes.dtypes)["bikes"])
        before = F.struct(F.lit(-(1 << 63)).alias("us"), F.lit(False).alias("known"), blank.alias("bikes"))
        seen = seen.unionByName(
            stations.select("nuid", F.lit(0).cast("long").alias("lo"), blank.alias("bikes"), before.alias("rank"))
        )
    visible = seen.groupBy("nuid", "lo").agg(F.max("rank")["bikes"].alias("bikes"))
    following = F.lead("lo").over(Window.partitionBy("nuid").orderBy("lo"))
    return visible.select(
        "nuid", "lo", F.coalesce(following - 1, F.lit(grid.last_tick).cast("long")).alias("hi"), "bikes"
    )


def on_ticks(state: DataFrame) -> DataFrame:
    """One row per station and tick."""
    return state.withColumn("tick", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def ticks_before(grid: Grid, counted: Callable[[Column], Column]) -> DataFrame:
    """(tick, before): how many ticks before it satisfy ``counted``, for all ticks and the one behind the last.

    The number of such ticks in lo..hi is the difference of two rows of this table, however long the state lasts.
    """
    ends = grid.changes.sparkSession.range(grid.last_tick + 2).withColumnRenamed("id", "tick")
    flagged = ends.withColumn("is", F.coalesce(counted(F.col("tick")), F.lit(False)).cast("long"))
    sums = with_running_sums(flagged, [], floor_div(F.col("tick"), TICKS_PER_BIN), [F.col("tick")], {"upto": "is"})
    return sums.select("tick", (F.col("upto") - F.col("is")).alias("before"))


def totals_per_tick(grid: Grid, state: DataFrame) -> DataFrame:
    """(tick, observed, total_bikes, with_bikes, empty) over all stations that have a state; the last three
    are NULL where no station's stock is known.

    Every state contributes its difference to the station's state before; running sums over the
    ticks give the totals, so the cost follows the changes and not stations x ticks.
    """
    parts = {
        "total_bikes": F.coalesce(F.col("bikes"), F.lit(0)),
        "known": F.col("bikes").isNotNull(),
        "observed": F.lit(True),
        "with_bikes": F.coalesce(F.col("bikes") > 0, F.lit(False)),
        "empty": F.coalesce(F.col("bikes") == 0, F.lit(False)),
    }
    numbers = state.select("nuid", "lo", *[c.cast("long").alias(n) for n, c in parts.items()])
    track = Window.partitionBy("nuid").orderBy("lo")
    steps = numbers.select("lo", *[(F.col(n) - F.coalesce(F.lag(n).over(track), F.lit(0))).alias(n) for n in parts])
    per_tick = steps.groupBy(F.col("lo").alias("tick")).agg(*[F.sum(n).alias(f"d_{n}") for n in parts])
    dense = grid.ticks().join(per_tick, "tick", "left")
    filled = dense.select("tick", *[F.coalesce(f"d_{n}", F.lit(0)).alias(f"d_{n}") for n in parts])
    deltas = {n: f"d_{n}" for n in parts}
    sums = with_running_sums(filled, [], floor_div(F.col("tick"), TICKS_PER_BIN), [F.col("tick")], deltas)

    def if_known(name: str) -> Column:
        return F.when(F.col("known") > 0, F.col(name)).alias(name)

    return sums.select("tick", "observed", *[if_known(n) for n in ("total_bikes", "with_bikes", "empty")])
