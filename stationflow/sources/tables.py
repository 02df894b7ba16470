"""Named tables and exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stationflow.functions.rules import require

TABLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def checked_name(name: str) -> str:
    require(TABLE_NAME.fullmatch(name) is not None, f"{name!r} is no table name: letters, digits and underscores, no digit first")
    return name


def save_table(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> None:
    """Replace the table; with ``path`` its files lie there instead of in the warehouse."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(checked_name(name))


def replace_partitions(df: DataFrame, name: str) -> None:
    """Replace only the partitions of the table that ``df`` has rows for; the others stay."""
    columns = df.sparkSession.table(checked_name(name)).columns
    require(set(columns) == set(df.columns), f"rows do not have the columns of {name!r}")
    conf, mode = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(mode)  # inserts into a named table take the mode from here, not from an option of the write
    conf.set(mode, "dynamic")
    try:
        df.select(*columns).write.mode("overwrite").insertInto(name)
    finally:
        conf.set(mode, before)


def load_table(spark: SparkSession, name: str, required: list[str] | None = None, order_by: list[str] | None = None):
    """The table, after a check of its columns; a global sort only where asked for."""
    table = spark.table(checked_name(name))
    missing = [column for column in required or [] if column not in table.columns]
    require(not missing, f"table {name!r} is missing columns: {', '.join(missing)}")
    return table.orderBy(*order_by) if order_by else table


def optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(checked_name(name)) else None


def write_csv_tables(frames: dict[str, DataFrame], folder: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").option("header", True).csv(f"{folder}/tables/{checked_name(name)}")
