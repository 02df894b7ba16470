"""Time the headline queries and print one JSON line.

``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. The station tables are derived from the
given tables first; that is timed as ``store_tables``. Each query is then timed from building its plan to
its last row, into a sink that takes all rows; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from checks.registry import queries  # noqa: E402
from checks.tables import Tables  # noqa: E402
from stationflow import build_session  # noqa: E402

HEADLINES = [
    "normalize_status",
    "latest_station_info",
    "data_health",
    "gap_summary",
    "system_trend",
    "top_stations_avg",
    "empty_stations_rate",
    "station_recent",
    "nearest_reliable",
    "strategy_ranking",
    "geofence_filter",
    "area_hourly",
    "depletion_by_hour",
    "bike_observations",
    "move_events_all",
    "departures_hourly",
    "history_monthly",
    "sample_area_asof",
    "local_hourly",
    "sample_city_interval",
    "city_month_hour",
    "city_station_rates",
    "flow_changes",
    "flow_hourly",
    "availability_dataset",
    "dataset_summary",
    "baseline_predictions",
    "binary_metrics",
    "recommendation_metrics",
]
STORED = ["stations", "info", "status", "free", "free_hourly", "runs", "minute_runs", "changes"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(100_000).groupBy((F.col("id") % 7).alias("k")).count().collect()  # start-up is not a query
    start = time.perf_counter()
    tables = Tables.of(spark, folder)
    for name in STORED:
        getattr(tables, name)
    seconds = {"store_tables": round(time.perf_counter() - start, 3)}
    known = queries()
    for name in HEADLINES:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
