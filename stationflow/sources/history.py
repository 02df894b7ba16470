"""Monthly parquet files of station change events, ``YYYYMM-<network>-stats.parquet``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.sources.schemas import CHANGES

# Fixed value: the month at the head of a history file name.
MONTH_IN_NAME = "([0-9]{6})-"


def month_key(file_name="file_name"):
    return F.regexp_extract(file_name, MONTH_IN_NAME, 1)


def read_history(spark: SparkSession, folder: str, network: str, missing_ok: bool = False) -> DataFrame:
    """All change events of a network, with the base name of their file."""
    reader = spark.read.option("pathGlobFilter", f"*-{network}-stats.parquet")
    try:
        rows = reader.parquet(folder)
    except AnalysisException as error:
        if missing_ok:
            return spark.createDataFrame([], CHANGES).withColumn("file_name", F.lit(""))
        raise FileNotFoundError(f"no history files of {network!r} in {folder}") from error
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def list_history(spark: SparkSession, folder: str, network: str) -> DataFrame:
    """(name, size) of the files, without reading them."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"*-{network}-stats.parquet").load(folder)
    return listing.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def files_to_fetch(offered: DataFrame, held: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Offered (name, size) that are not held with the same size, by name."""
    if years is not None:
        offered = offered.where(F.substring("name", 1, 4).cast("int").isin(years))
    return offered.join(held, ["name", "size"], "left_anti").orderBy("name")


# --- picking up files into a table of our own ---

_HELD = "name string, size long, version int"


def _have(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def held_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, size, version) of the files whose rows are held; of a file taken more than once, its newest taking."""
    path = f"{root}/files"
    taken = spark.read.schema(_HELD).json(path) if _have(spark, path) else spark.createDataFrame([], _HELD)
    newest = F.max_by("size", "version").alias("size")
    return taken.groupBy("name").agg(newest, F.max("version").alias("version"))


def pick_up(spark: SparkSession, folder: str, root: str, network: str, years: list[int] | None = None) -> int:
    """Take the offered files of a network that are not held with the same size; how many were taken.

    Rows go to ``{root}/rows`` under a number of this taking, and only then are the files entered as held, so a taking that
    failed half-way is not seen and a changed file replaces its earlier rows at once. Takings must follow each other.
    """
    held = held_files(spark, root)
    wanted = [r["name"] for r in files_to_fetch(list_history(spark, folder, network), held.select("name", "size"), years).collect()]
    if not wanted:
        return 0
    version = (held.agg(F.max("version").alias("v")).first()["v"] or 0) + 1
    # a taking that was broken off may have left rows under its number
    rows = spark.read.parquet(*[f"{folder}/{name}" for name in wanted])
    numbered = rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.lit(version).alias("version"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{root}/rows")
    entered = list_history(spark, folder, network).where(F.col("name").isin(wanted)).withColumn("version", F.lit(version))
    entered.coalesce(1).write.mode("append").json(f"{root}/files")
    return len(wanted)


def read_held(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all files held, each in its newest taking, with file name and version."""
    rows = spark.read.parquet(f"{root}/rows")
    newest = held_files(spark, root).select(F.col("name").alias("file_name"), F.col("version"))
    return rows.join(newest, ["file_name", "version"], "left_semi")
