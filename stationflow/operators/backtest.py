"""Which station would a strategy have sent a rider to, and did it still have a bike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions.geo import distance_m
from stationflow.functions.rules import MEDIUM_RISK, penalty_score, require

# The reference points (name, lat, lon) and the strategies with their labels.
ORIGINS = [
    ("Moravske namesti", 49.199088, 16.607361),
    ("Ceska", 49.197050, 16.606837),
    ("Hlavni nadrazi", 49.190331, 16.612873),
    ("Luzanky", 49.206228, 16.606837),
    ("Mendlovo namesti", 49.190181, 16.594856),
]
STRATEGIES = {
    "nearest_with_bike": "nearest",
    "nearest_bikes_ge_2": "bikes>=2",
    "nearest_model_low_risk": "model<0.4",
    "distance_plus_risk_penalty": "dist+risk",
}


def _origin_array(origins: list[tuple[str, float, float]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("origin"), F.lit(lat).alias("o_lat"), F.lit(lon).alias("o_lon"))
            for name, lat, lon in origins
        ]
    )


def recommendation_choices(
    test: DataFrame, origins: list[tuple[str, float, float]] | None = None, max_distance_m: float = 1000.0
) -> DataFrame:
    """One row per time, origin and strategy: the chosen station, or ``no_candidate``.

    ``test`` holds dataset rows with ``empty_probability``. The few origins are spread from a literal,
    rows out of range end at once, and all four choices are minima of one aggregation.
    """
    require(max_distance_m > 0, "max_distance_m: above 0")
    origins = origins or ORIGINS
    places = test.where("has_bike_now and lat is not null and lon is not null").select(
        "collected_at", "station_id", "lat", "lon", "bikes_now", "has_bike_future", "empty_probability"
    )
    paired = places.select("*", F.inline(_origin_array(origins)))
    metres = distance_m(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon"))
    near = paired.withColumn("distance_m", metres).where(F.col("distance_m") <= max_distance_m)

    p = F.col("empty_probability")
    fields = ["distance_m", "station_id", "empty_probability", "has_bike_future"]
    plain = F.struct(F.col("distance_m").alias("score"), *fields)
    best = {
        "nearest_with_bike": plain,
        "nearest_bikes_ge_2": F.when(F.col("bikes_now") >= 2, plain),
        "nearest_model_low_risk": F.when(p < MEDIUM_RISK, plain),
        "distance_plus_risk_penalty": F.struct(penalty_score(F.col("distance_m"), p).alias("score"), *fields),
    }
    picks = near.groupBy("collected_at", "origin").agg(
        F.min("distance_m").alias("nearest_m"), *[F.min(pick).alias(name) for name, pick in best.items()]
    )
    tries = test.select("collected_at").distinct().select("collected_at", F.explode(_origin_array(origins)["origin"]).alias("origin"))
    named = F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(name).alias("pick")) for name in STRATEGIES])
    long = tries.join(picks, ["collected_at", "origin"], "left").select(
        "collected_at", "origin", "nearest_m", F.inline(named)
    )
    return long.select(
        "strategy",
        "collected_at",
        "origin",
        F.col("pick.station_id").alias("station_id"),
        F.col("pick.has_bike_future").alias("success"),
        F.col("pick.distance_m").alias("distance_m"),
        F.col("pick.empty_probability").alias("empty_probability"),
        (F.col("pick.distance_m") - F.col("nearest_m")).alias("extra_distance_m"),
        F.col("pick").isNull().alias("no_candidate"),
    )


def recommendation_metrics(choices: DataFrame) -> DataFrame:
    """Per strategy; rates are over the choices that found a station."""
    label = F.create_map(*[F.lit(text) for pair in STRATEGIES.items() for text in pair])[F.col("strategy")]
    return choices.groupBy("strategy", F.coalesce(label, "strategy").alias("label")).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("no_candidate").alias("no_candidate"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("distance_m").alias("avg_distance_m"),
        F.percentile("distance_m", 0.9).alias("p90_distance_m"),
        F.avg("empty_probability").alias("avg_empty_probability"),
        F.avg("extra_distance_m").alias("avg_extra_distance_m"),
    )
