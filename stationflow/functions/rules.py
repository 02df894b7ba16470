"""Scalar rules: rates, rounding, risk labels, advice and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, weights and labels that results must carry unchanged.
HIGH_RISK = 0.7
MEDIUM_RISK = 0.4
BEST_RATE = 0.15
GOOD_RATE = 0.35
WATCH_RATE = 0.55
UNKNOWN_RATE = 0.5
EMPTY_RATE_WEIGHT = 900
LOW_RATE_WEIGHT = 400
BIKE_BONUS = 140
BIKE_BONUS_CAP = 5
EMPTY_NOW_PENALTY = 5000
RISK_PENALTY_M = 350.0


def round_to(value: Column, digits: int) -> Column:
    """Half-up on the binary double, the way SQL engines with a C round do it."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def share(condition: Column) -> Column:
    """Fraction of rows where the condition holds; NULL counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def tally(condition: Column) -> Column:
    """Rows where the condition holds; NULL, not 0, where it is unknown for every row of the group."""
    return F.sum(condition.cast("long"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))


def stock_risk(bikes: Column) -> Column:
    return (
        F.when(bikes <= 0, "empty").when(bikes == 1, "high").when(bikes <= 3, "medium").when(bikes > 3, "low")
    )


def probability_label(p: Column) -> Column:
    return F.when(p >= HIGH_RISK, "high").when(p >= MEDIUM_RISK, "medium").when(p.isNotNull(), "low")


def station_advice(bikes: Column, p: Column) -> Column:
    """NULL without a prediction."""
    return F.when(
        p.isNotNull(),
        F.when(bikes <= 0, "skip").when(p >= HIGH_RISK, "risky").when(p >= MEDIUM_RISK, "watch").otherwise("safe"),
    )


def strategy_advice(bikes: Column, empty_rate: Column) -> Column:
    return (
        F.when(bikes <= 0, "empty now")
        .when(bikes == 1, "last bike")
        .when(empty_rate.isNull(), "live ok")
        .when(empty_rate <= BEST_RATE, "best")
        .when(empty_rate <= GOOD_RATE, "good")
        .when(empty_rate <= WATCH_RATE, "watch")
        .otherwise("risky")
    )


def strategy_score(metres: Column, bikes: Column, empty_rate: Column, low_rate: Column) -> Column:
    """Lower is better: walk, history and missing stock cost, stock helps."""
    empty = F.coalesce(empty_rate, F.lit(UNKNOWN_RATE)) * EMPTY_RATE_WEIGHT
    low = F.coalesce(low_rate, F.lit(UNKNOWN_RATE)) * LOW_RATE_WEIGHT
    bonus = F.least(bikes, F.lit(BIKE_BONUS_CAP)) * BIKE_BONUS
    return metres + empty + low - bonus + F.when(bikes <= 0, EMPTY_NOW_PENALTY).otherwise(0)


def penalty_score(metres: Column, p: Column) -> Column:
    return metres + p * RISK_PENALTY_M


def low_stock_probability(bikes: Column, threshold: int) -> Column:
    linear = (F.lit(threshold + 1) - bikes).cast("double") / float(threshold + 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear))


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def require_point(lat: float, lon: float) -> None:
    require(-90 <= lat <= 90, "latitude out of range (90 degrees either way)")
    require(-180 <= lon <= 180, "longitude out of range (180 degrees either way)")
