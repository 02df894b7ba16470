"""All registered queries, by operator name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.lake import ON_FILES
from checks.streams import ON_STREAMS
from checks.tables import ORIGIN, RADIUS_M, TZ, Tables
from stationflow.functions.rules import round_to
from stationflow.operators import backtest, features, health, models, spatial, stations
from stationflow.operators.area import Area
from stationflow.operators.flows import Flows, bike_uid_events
from stationflow.operators.history import (
    AreaHistory,
    CityHistory,
    highest,
    history_monthly,
    history_summary,
    station_history_rates,
    station_latest_position,
    station_map_table,
    stations_in_radius,
    worst_months,
)
from stationflow.operators.moves import Movements
from stationflow.operators.reports import rates_in_percent
from stationflow.operators.features import TARGET
from stationflow.session import settle, shared_folder
from stationflow.sources import snapshots

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-31 12:00:00"
GAP_SECONDS = 181
HOUR = "08:00"
# Events are sparse, so the lookups span hours: horizon 3-12 h, lags 5-10 h and 15-20 h, rolling 30 h.
SPANS = features.Spans(horizon=180, max_target_delay=720, lag_tolerance=300, short_lag=300, long_lag=900, rolling=1800)
AREA_MINUTES = 15
CITY_MINUTES = 60
BACKTEST_M = 1000.0
BOUNDARY = (
    '{"type": "MultiPolygon", "coordinates": ['
    "[[[16.56, 49.16], [16.63, 49.155], [16.64, 49.22], [16.60, 49.245], [16.565, 49.23], [16.56, 49.16]],"
    " [[16.58, 49.18], [16.61, 49.18], [16.61, 49.21], [16.58, 49.21], [16.58, 49.18]]],"
    "[[[16.59, 49.19], [16.60, 49.19], [16.595, 49.20], [16.59, 49.19]]]]}"
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for display."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: round_to(F.col(name), digits) for name in doubles})


def _area(t: Tables) -> Area:
    return Area(t.status, t.info, *ORIGIN, radius_m=RADIUS_M, tz=TZ)


def _history(t: Tables) -> AreaHistory:
    return AreaHistory(t.changes, *ORIGIN, radius_m=RADIUS_M, sample_minutes=AREA_MINUTES, tz=TZ)


def _city(t: Tables) -> CityHistory:
    return CityHistory(t.changes, CITY_MINUTES, TZ)


def _moves(t: Tables) -> Movements:
    return Movements(t.free, t.info, *ORIGIN, radius_m=RADIUS_M, tz=TZ)


def _flows(t: Tables) -> Flows:
    return Flows(t.changes, *ORIGIN, radius_m=RADIUS_M, tz=TZ)


def _dataset(t: Tables) -> DataFrame:
    return features.availability_dataset(t.status, t.info, SPANS)


def _split(t: Tables) -> models.TemporalSplit:
    """The dataset is read several times by everything after it, so it is stored once."""
    return models.TemporalSplit(t.kept("dataset", lambda: settle(_dataset(t), "dataset")))


def _prior_rows(t: Tables) -> tuple[models.TemporalSplit, DataFrame]:
    """Test rows with the station's empty rate in training as probability."""
    split = _split(t)
    predicted = models.baseline_predictions(split).where(F.col("model") == "station_prior_empty_rate")
    probability = predicted.select("station_id", "collected_at", F.col("score").alias("empty_probability"))
    return split, split.test.join(probability, ["station_id", "collected_at"])


def _choices(t: Tables) -> DataFrame:
    _, rows = _prior_rows(t)
    return backtest.recommendation_choices(rows, max_distance_m=BACKTEST_M)


def _station_priors(t: Tables) -> DataFrame:
    profile = stations.station_profile(t.status)
    return profile.select("station_id", F.col("empty_rate").alias("empty_probability"))


def _ranking(t: Tables, limit: int | None = 12) -> DataFrame:
    return spatial.strategy_ranking(t.status, t.runs, t.info, t.changes, *ORIGIN, hour=HOUR, limit=limit, tz=TZ)


def _points(t: Tables) -> DataFrame:
    return stations.station_map_points(t.status, t.runs, t.info)


def _every_station(t: Tables) -> DataFrame:
    """Every station with its newest stock, as map points."""
    latest = stations.station_latest(t.status).select("station_id", F.col("num_bikes_available").alias("bikes"))
    return stations.latest_station_info(t.info).join(latest, "station_id")


def _evaluation(t: Tables) -> DataFrame:
    split = _split(t)
    return models.evaluation_result(split, models.binary_metrics(models.baseline_predictions(split)))


def _comparison(t: Tables) -> DataFrame:
    metrics = models.binary_metrics(models.baseline_predictions(_split(t)))
    simple = F.col("model").isin("majority_train_class", "persistence_empty_now")
    return models.best_model_comparison(metrics.where(simple), metrics.where(~simple))


def _trained(t: Tables) -> tuple[models.TemporalSplit, str]:
    """The split, and the folder in which both models, trained on its first part, are stored with their table."""

    def fit() -> str:
        folder = f"{shared_folder(t.spark)}/stationflow/models-{uuid.uuid4().hex}"
        models.train_models(_split(t), folder)
        return folder

    return _split(t), t.kept("models", fit)


def _model_facts(t: Tables, name: str) -> DataFrame:
    """What can be said of a trained model without its numbers: what it was trained and scored on, and that scores, calls and
    metrics belong together."""
    split, folder = _trained(t)
    scored = models.model_predictions(name, models.load_model(f"{folder}/{name}"), split.test)
    metrics = models.stored_models(t.spark, folder).where(F.col("model") == name).select(F.struct("*").alias("m")).scalar()
    train = split.train.agg(F.struct(F.count("*").alias("n"), F.count_if(TARGET).alias("pos")).alias("f")).scalar()
    hits, y = F.col("y_hat") == F.col("y"), F.col("y")
    facts = scored.groupBy("model").agg(
        F.count("*").alias("test_rows"),
        F.count_if(y).alias("test_positives"),
        F.avg(hits.cast("double")).alias("hit_rate"),
        F.bool_and(F.col("score").between(0, 1)).alias("scores_in_range"),
        F.bool_and((F.col("score") == 0.5) | ((F.col("score") > 0.5) == F.col("y_hat"))).alias("calls_follow_scores"),
    )
    ranked = metrics["roc_auc"].between(0, 1) & metrics["average_precision"].between(0, 1)
    agree = (F.abs(metrics["accuracy"] - F.col("hit_rate")) < 1e-9) & ranked
    return facts.select(
        "model", train["n"].alias("train_rows"), train["pos"].alias("train_positives"), "test_rows", "test_positives", "scores_in_range",
        "calls_follow_scores", agree.alias("metrics_agree"),
    )


def _scored_test(t: Tables) -> DataFrame:
    split, folder = _trained(t)
    _, model = models.best_stored(t.spark, folder)
    return models.model_scores(model, split.test)


def _label_follows() -> Column:
    p = F.col("empty_probability")
    want = F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")
    return (p.between(0, 1) & (F.col("risk_label") == want)).alias("label_follows")


def _latest_risk(t: Tables) -> DataFrame:
    _, folder = _trained(t)
    _, model = models.best_stored(t.spark, folder)
    return models.predict_latest_risk(model, _latest_features(t))


def _trained_comparison(t: Tables) -> DataFrame:
    """The best baseline against the best trained model; of the latter only what follows from its numbers."""
    split, folder = _trained(t)
    baselines = models.binary_metrics(models.baseline_predictions(split))
    told = models.best_model_comparison(baselines, models.stored_models(t.spark, folder))
    delta = F.col("model_f1") - F.col("baseline_f1")
    verdict = F.when(delta > 0.002, "model ahead").when(delta < -0.002, "baseline ahead").otherwise("tied")
    return told.select(
        "best_baseline", round_to(F.col("baseline_f1"), 6).alias("baseline_f1"),
        F.col("best_model").isin("logistic_regression", "boosted_trees").alias("model_known"),
        ((F.col("f1_delta") == delta) & (F.col("verdict") == verdict)).alias("verdict_follows"),
    )


#: Strategies that ask no model.
PLAIN_STRATEGIES = ("nearest_with_bike", "nearest_bikes_ge_2")


def _trained_choices(t: Tables) -> DataFrame:
    choices = backtest.recommendation_choices(_scored_test(t), max_distance_m=BACKTEST_M)
    plain, p = F.col("strategy").isin(*PLAIN_STRATEGIES), F.col("empty_probability")
    low = (F.col("strategy") != "nearest_model_low_risk") | (p < 0.4)
    rule = F.col("no_candidate") | (p.between(0, 1) & low & (F.col("distance_m") <= BACKTEST_M))
    own = {c: F.when(plain, F.col(c)) for c in ("station_id", "success", "no_candidate")}
    return choices.select("strategy", "collected_at", "origin", *[c.alias(n) for n, c in own.items()], rule.alias("keeps_rule"))


def _trained_choice_metrics(t: Tables) -> DataFrame:
    choices = backtest.recommendation_choices(_scored_test(t), max_distance_m=BACKTEST_M)
    plain = F.col("strategy").isin(*PLAIN_STRATEGIES)
    told = backtest.recommendation_metrics(choices)
    shown = ["no_candidate", "success_rate", "avg_distance_m", "p90_distance_m", "avg_extra_distance_m"]
    fair = F.col("avg_empty_probability").isNull() | F.col("avg_empty_probability").between(0, 1)
    return rounded(told.select("strategy", "label", "attempts", *[F.when(plain, F.col(c)).alias(c) for c in shown], fair.alias("probability_in_range")))


def _latest_features(t: Tables) -> DataFrame:
    latest = stations.latest_rows(t.status, t.runs).select("station_id")
    return features.latest_features(t.status, t.info, t.runs, latest, SPANS)


ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    # snapshots and stations
    "normalize_status": lambda t: snapshots.normalize_status(t.raw),
    "normalize_info": lambda t: snapshots.normalize_info(t.raw),
    "normalize_free_bikes": lambda t: snapshots.normalize_free_bikes(t.raw),
    "run_rows": lambda t: snapshots.add_parts(snapshots.run_rows(t.raw)),
    "collection_runs": lambda t: t.runs,
    "latest_station_info": lambda t: stations.latest_station_info(t.info),
    "db_stats": lambda t: stations.db_stats(t.runs, t.status),
    "db_summary": lambda t: stations.db_summary(t.runs, t.status),
    "latest_snapshot": lambda t: stations.latest_snapshot(t.runs, t.status),
    "freshness": lambda t: health.freshness(t.runs, t.free_hourly, AS_OF),
    "data_health": lambda t: health.data_health(t.runs, t.status, t.free_hourly, 3600, 3600),
    "data_health_recent": lambda t: health.data_health(
        t.runs, t.status, t.free_hourly, 3600, 3600, since_hours=200.5, as_of=AS_OF
    ),
    "gap_summary": lambda t: health.gap_summary(t.minute_runs, GAP_SECONDS),
    "data_gaps": lambda t: health.data_gaps(t.minute_runs, GAP_SECONDS),
    "system_trend": lambda t: stations.system_trend(t.runs, t.status),
    "top_stations_latest": lambda t: stations.top_stations_latest(t.status, t.runs, t.info).withColumn(
        "last_reported", F.unix_seconds("last_reported")
    ),
    "top_stations_avg": lambda t: stations.top_stations_avg(t.status, t.info),
    "empty_stations_latest": lambda t: stations.empty_stations_latest(t.status, t.runs, t.info).withColumn(
        "last_reported", F.unix_seconds("last_reported")
    ),
    "empty_stations_rate": lambda t: stations.empty_stations_rate(t.status, t.info),
    "station_search": lambda t: stations.station_search(t.info, "s-1"),
    "station_latest": lambda t: stations.station_latest(t.status).withColumn(
        "last_reported", F.unix_seconds("last_reported")
    ),
    "station_profile": lambda t: stations.station_profile(t.status),
    "station_recent": lambda t: stations.station_recent(t.status),
    "station_map_summary": lambda t: stations.station_map_summary(t.status, t.runs),
    "station_map_points": lambda t: stations.station_map_points(t.status, t.runs, t.info),
    "station_map_stocked": lambda t: stations.station_map_points(t.status, t.runs, t.info, include_empty=False),
    # search and ranking
    "nearest_stations": lambda t: spatial.nearest_stations(t.status, t.runs, t.info, *ORIGIN),
    "nearest_within": lambda t: spatial.nearest_stations(
        t.status, t.runs, t.info, *ORIGIN, max_distance_m=2500.0, include_empty=True
    ),
    "nearest_reliable": lambda t: spatial.nearest_reliable(t.status, t.runs, t.info, *ORIGIN, limit=5),
    "nearest_reliable_fallback": lambda t: spatial.nearest_reliable(
        t.status, t.runs, t.info, *ORIGIN, limit=5, reliable_min_bikes=9
    ),
    "nearest_with_risk": lambda t: spatial.nearest_with_risk(
        spatial.nearest_stations(t.status, t.runs, t.info, *ORIGIN), _station_priors(t)
    ),
    "station_history_rates": lambda t: station_history_rates(t.changes, *ORIGIN, hour=HOUR, tz=TZ),
    "strategy_ranking": lambda t: rounded(_ranking(t)),
    "strategy_ranking_live_only": lambda t: rounded(
        spatial.strategy_ranking(t.status, t.runs, t.info, None, *ORIGIN, hour=HOUR, max_walk_m=3000, tz=TZ)
    ),
    "strategy_best": lambda t: spatial.strategy_best(_ranking(t, limit=None)),
    "geofence_filter": lambda t: spatial.geofence_filter(stations.latest_station_info(t.info), BOUNDARY),
    "grid_bin": lambda t: spatial.grid_bin(_every_station(t), 60, 24),
    "footprint_band": lambda t: spatial.footprint_band(_points(t), 60, 24),
    # area availability
    "area_coverage": lambda t: _area(t).coverage(),
    "area_latest": lambda t: _area(t).latest(),
    "area_stations": lambda t: _area(t).station_table(),
    "area_hourly": lambda t: _area(t).hourly(),
    "depletion_by_hour": lambda t: _area(t).depletion_by_hour(),
    "area_morning_signals": lambda t: _area(t).morning_signals(),
    # vehicle movements
    "bike_observations": lambda t: _moves(t).observations(),
    "bike_moves": lambda t: _moves(t).bike_moves(),
    "move_events": lambda t: _moves(t).move_events(),
    "move_events_all": lambda t: _moves(t).move_events(limit=None),
    "move_summary": lambda t: _moves(t).move_summary(),
    "departures": lambda t: _moves(t).departures(),
    "departures_all": lambda t: _moves(t).departures(limit=None),
    "departures_hourly": lambda t: _moves(t).departures_hourly(),
    "departure_destinations": lambda t: _moves(t).departure_destinations(),
    "departure_summary": lambda t: _moves(t).departure_summary(),
    # change log
    "history_summary": lambda t: history_summary(t.changes),
    "history_monthly": lambda t: history_monthly(t.changes),
    "station_latest_position": lambda t: station_latest_position(t.changes),
    "stations_in_radius": lambda t: stations_in_radius(t.changes, *ORIGIN, radius_m=RADIUS_M),
    "sample_area_asof": lambda t: _history(t).samples(),
    "area_history_summary": lambda t: _history(t).summary(),
    "area_history_hourly": lambda t: _history(t).hourly(("04:00", "12:00")),
    "local_hourly": lambda t: _history(t).hourly(),
    "area_history_morning": lambda t: _history(t).morning_by_month(),
    "area_station_rates": lambda t: _history(t).station_rates(),
    "station_hour_rates": lambda t: _history(t).station_hours(),
    "station_hour_matrix": lambda t: _history(t).station_hour_matrix(),
    "sample_city_interval": lambda t: _city(t).samples(),
    "city_monthly": lambda t: _city(t).monthly(),
    "city_hourly": lambda t: _city(t).hourly(),
    "city_month_hour": lambda t: _city(t).month_hour(),
    "city_month_hour_matrix": lambda t: _city(t).month_hour_matrix(),
    "city_station_rates": lambda t: _city(t).station_rates(),
    "emptiest_stations": lambda t: highest(_city(t).station_rates(), "empty_rate", "nuid"),
    "station_hour_percent": lambda t: rounded(rates_in_percent({"rates": _history(t).station_hours()})["rates"]),
    "station_map_table": lambda t: station_map_table(_city(t).station_rates(), _history(t).stations),
    "worst_months": lambda t: worst_months(_history(t).morning_by_month()),
    "bike_uid_events": lambda t: bike_uid_events(t.changes),
    "flow_changes": lambda t: _flows(t).moves,
    "flow_hourly": lambda t: _flows(t).hourly(),
    "flow_monthly": lambda t: _flows(t).monthly(),
    "flow_destinations": lambda t: _flows(t).destinations(),
    "flow_destinations_head": lambda t: _flows(t).destinations(limit=12),
    "flow_origins": lambda t: _flows(t).origins(),
    "flow_summary": lambda t: _flows(t).summary(),
    "morning_flow_totals": lambda t: _flows(t).morning_totals(),
    # features, models, backtest
    "availability_dataset": lambda t: rounded(_dataset(t)),
    "dataset_summary": lambda t: features.dataset_summary(_dataset(t)),
    "dataset_change_stats": lambda t: features.dataset_change_stats(_dataset(t)),
    "latest_features": lambda t: rounded(_latest_features(t)),
    "temporal_split": lambda t: _split(t).summary(),
    "baseline_predictions": lambda t: rounded(models.baseline_predictions(_split(t))),
    "binary_metrics": lambda t: rounded(models.binary_metrics(models.baseline_predictions(_split(t)))),
    "evaluation_result": lambda t: rounded(_evaluation(t)),
    "best_model_comparison": lambda t: rounded(_comparison(t)),
    "recommendation_choices": lambda t: rounded(_choices(t)),
    "recommendation_metrics": lambda t: rounded(backtest.recommendation_metrics(_choices(t))),
    "train_logistic": lambda t: _model_facts(t, "logistic_regression"),
    "train_boosted_trees": lambda t: _model_facts(t, "boosted_trees"),
    "predict_latest_risk": lambda t: _latest_risk(t).select("station_id", _label_follows()),
    "nearest_with_trained_risk": lambda t: spatial.nearest_with_risk(
        spatial.nearest_stations(t.status, t.runs, t.info, *ORIGIN), _latest_risk(t)
    ).select("station_id", "name", "num_bikes_available", "distance_m", _label_follows()),
    "trained_comparison": _trained_comparison,
    "trained_choices": _trained_choices,
    "trained_choice_metrics": _trained_choice_metrics,
}


def queries() -> dict[str, Query]:
    def bind(build: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, folder: build(Tables.of(spark, folder))

    return {name: bind(build) for name, build in {**ON_TABLES, **ON_FILES, **ON_STREAMS}.items()}
