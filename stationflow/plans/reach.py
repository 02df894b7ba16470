"""Time-bounded lookups around each row, without a self join.

A lookup that may only see ``back`` before and ``ahead`` after a row never needs the whole history of
its entity. Rows are laid into time slots several times longer than the reach; a row close to a slot's
edge is also copied into the neighbour that can see it. Windows then partition by (entity, slot), so one
entity that holds a large part of all rows is spread over as many tasks as it has slots, and the frames
still see every row in reach. The copies are a small, fixed share (reach / slot length) of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stationflow.functions.clock import DAY_US, floor_div

SLOT = "_slot"
HOME = "_home"
SLOTS_PER_REACH = 8


def slot_length(back_us: int, ahead_us: int) -> int:
    return max(DAY_US, SLOTS_PER_REACH * (back_us + ahead_us))


def spread(df: DataFrame, us: Column, back_us: int, ahead_us: int, slot_us: int | None = None) -> DataFrame:
    """Add slot and home flag; ``home`` rows are the input, the rest are copies to look at."""
    slot_us = slot_us or slot_length(back_us, ahead_us)
    first = floor_div(us - ahead_us, slot_us)
    last = floor_div(us + back_us, slot_us)
    return df.withColumn(SLOT, F.explode(F.sequence(first, last))).withColumn(
        HOME, F.col(SLOT) == floor_div(us, slot_us)
    )


def around(keys: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, SLOT).orderBy(*order)


def home_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(HOME)).drop(SLOT, HOME)
