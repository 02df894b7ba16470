"""Unbounded lag, rank and running sums in two levels.

A plain window over one key puts all rows of the key in one task. Here the rows are windowed inside
(key, bin), and what one bin owes the next, a row or two per (key, bin), is windowed per key. Bins are days, measured cuts
(``plans/bins.py``), score bands or index blocks, so the second level is a tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.clock import DAY_US, floor_div
from stationflow.plans.bins import BIN



def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, [*keys, BIN], "left")


def previous_and_last(
    df: DataFrame, keys: list[str], us: str, carry: list[str], out: str, ties: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows that carry a ``BIN`` with ``out``, a struct of ``carry`` from the preceding row of the same key (NULL for the first),
    and the last row of each key.

    Rows are windowed inside (keys, bin). The first and last rows of the bins, two for each, are windowed per key: there a bin's
    first row finds the last one of the bin before. All parts read the same exchange, so ``df`` is read and dealt once.
    Keys must not be NULL. ``ties`` orders rows of equal time.
    """
    order = [us, *(ties or [])]
    here = Window.partitionBy(*keys, BIN).orderBy(*order)
    chain = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*carry))
    inside = df.withColumns({out: before.over(here), "_ends": F.lead(F.lit(1)).over(here).isNull()})
    edges = inside.where(F.col(out).isNull() | F.col("_ends")).withColumns(
        {"_edge": before.over(chain), "_final": F.lead(F.lit(1)).over(chain).isNull()}
    )
    firsts = edges.where(F.col(out).isNull()).withColumn(out, F.col("_edge"))
    kept = [*[c for c in df.columns if c != BIN], out]
    paired = inside.where(F.col(out).isNotNull()).select(*kept).unionByName(firsts.select(*kept))
    return paired, edges.where("_final").select(*kept[:-1])


def with_previous(
    df: DataFrame,
    keys: list[str],
    us: str,
    carry: list[str],
    out: str,
    ties: list[str] | None = None,
    bin_us: int = DAY_US,
) -> DataFrame:
    """Add ``out``: a struct of ``carry`` from the preceding row of the same key, NULL for the first; bins are spans of time of
    one length, so a key should have a bounded number of rows in each."""
    binned = df.withColumn(BIN, floor_div(F.col(us), bin_us))
    return previous_and_last(binned, keys, us, carry, out, ties)[0]


def with_running_sums(
    df: DataFrame, keys: list[str], bin_col: Column, order: list[Column], sums: dict[str, str], descending: bool = False
) -> DataFrame:
    """Add running totals ``{out: column}``, current row included, in ``order`` within ``keys``.

    ``bin_col`` must follow ``order``: all rows of a bin come before all rows of the next one, or after
    them when ``descending``.
    """
    binned = df.withColumn(BIN, bin_col)
    bin_order = F.col(BIN).desc() if descending else F.col(BIN).asc()
    before = Window.partitionBy(*keys).orderBy(bin_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*keys, BIN).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    offsets = totals.select(
        *keys, BIN, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    here = Window.partitionBy(*keys, BIN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = binned.withColumns({f"_i_{o}": F.sum(c).over(here) for o, c in sums.items()})
    joined = _join(inside, offsets, keys).withColumns({o: F.col(f"_i_{o}") + F.col(f"_o_{o}") for o in sums})
    return joined.drop(BIN, *[f"_{x}_{o}" for o in sums for x in "io"])
