"""Cut a large table down to a set of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restrict(fact: DataFrame, key: str, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``fact`` whose key is (or with ``keep=False`` is not) in ``ids``.

    One plan at every size, and nothing is fetched: a semi or anti join. Where ``ids`` is a settled table its size is
    exact, so Spark itself decides whether it may be broadcast.
    """
    found = ids.where(F.col(key).isNotNull()).select(key).distinct()
    return fact.join(found, key, "left_semi" if keep else "left_anti")
