"""Bins of even size along the time of a key, measured from the rows.

A day of one key is a bin of its own unless it holds more than ``ROWS_PER_BIN`` rows. Such days are cut: their rows are counted by
second, and a new bin begins wherever the running count passes a multiple of that size. So no bin holds many more rows than
that, whatever share of all rows one key has within an hour; what can't be cut are the rows of one key in one second.
The cuts are settled as a table with one row per day that is cut, empty for most inputs, whose size decides how it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.clock import DAY_US, SECOND_US, floor_div
from stationflow.session import settle

ROWS_PER_BIN = 1_000_000
BIN = "_bin"
#: More than any day has cuts.
PER_DAY = 100_000
_DAY, _CUTS = "_day", "_cuts"


def day_cuts(df: DataFrame, keys: list[str], us: str, most: int = ROWS_PER_BIN) -> DataFrame:
    """(keys, day, cuts): the seconds at which the bins of a day with more than ``most`` rows begin, in order."""
    dated = df.select(*keys, floor_div(F.col(us), DAY_US).alias(_DAY), floor_div(F.col(us), SECOND_US).alias("_second"))
    full = dated.groupBy(*keys, _DAY).count().where(F.col("count") > most).select(*keys, _DAY)
    cells = dated.join(full, [*keys, _DAY]).groupBy(*keys, _DAY, "_second").count()
    before = Window.partitionBy(*keys, _DAY).orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    bins = cells.withColumn("_n", floor_div(F.coalesce(F.sum("count").over(before), F.lit(0)), most))
    begins = bins.groupBy(*keys, _DAY, "_n").agg(F.min("_second").alias("_from"))
    return settle(begins.groupBy(*keys, _DAY).agg(F.sort_array(F.collect_list("_from")).alias(_CUTS)), "day-cuts")


def in_bins(df: DataFrame, keys: list[str], us: str, cuts: DataFrame) -> DataFrame:
    """``df`` with ``BIN``, a number that follows time within each key."""
    day, second = floor_div(F.col(us), DAY_US), floor_div(F.col(us), SECOND_US)
    joined = df.withColumn(_DAY, day).join(cuts, [*keys, _DAY], "left")
    passed = F.size(F.filter(F.coalesce(_CUTS, F.array().cast("array<bigint>")), lambda c: c <= second))
    return joined.withColumn(BIN, F.col(_DAY) * PER_DAY + passed).drop(_DAY, _CUTS)
