"""Result, production and snapshot tables: partitioned folders that a repeated write replaces."""

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill import schemas
from panelmill.session import shuffles_dropped


#: The columns that result and production tables are partitioned by.
PARTS = ("task_id", "source")


def _write(df: DataFrame, path: str, parts: list[str], order: list[str], mode: str = "dynamic", placed: bool = False) -> None:
    """Replace the partitions that ``df`` has rows for, or with mode ``static`` all of ``path``.
    ``rebalance`` brings a partition's rows together without forcing a hot one into a single task; rows that are ``placed``
    lie together already (``clean.with_late``) and are not shuffled again.  What was shuffled for the write goes with it."""
    rows = (df if placed else df.hint("rebalance", *parts)).sortWithinPartitions(*parts, *order)
    with shuffles_dropped(df.sparkSession):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd")
             .partitionBy(*parts).parquet(path))


def _folder(name: str, value: str) -> str:
    """Folder of a partition value, escaped as Spark does."""
    return f"{name}=" + re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def write_task(df: DataFrame, path: str, task_id: str, batch: int = 0, placed: bool = False) -> None:
    """Rows of one task, in place of all it had: a source or task without rows keeps none.  Later batches of a task
    (ranges of its slices) replace only themselves and what a former run had for them.  ``placed``: the rows of a source lie
    together already."""
    if task_id == "":
        raise ValueError("a task needs an id")
    folder = f"{path}/{_folder('task_id', task_id)}"
    rows = df.drop("task_id")
    if batch == 0:
        _write(rows.withColumn("batch", F.lit(0)), folder, ["batch", "source"], ["create_time"], "static", placed)
    else:
        _write(rows, f"{folder}/batch={batch}", ["source"], ["create_time"], "static", placed)


def write_results(df: DataFrame, path: str, placed: bool = False) -> None:
    """Rows of many tasks at once, result or production; a task is replaced source by source (see ``write_task`` for
    one that is run again).  ``placed``: the rows of PARTS lie together already."""
    _write(df.withColumn("batch", F.lit(0)), path, ["task_id", "batch", "source"], ["create_time"], placed=placed)


write_production = write_results


def read_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, source_author string, panel string, create_time timestamp_ntz, " \
             "field_content string, match_content string, task_id string, batch int, source string"
    return spark.read.schema(schema).parquet(path).drop("batch")


def task_rows(results: DataFrame, task_id: str, source: str | None = None) -> DataFrame:
    """Rows of a task: a filter on partition columns, so only its folders are read."""
    df = results.where(F.col("task_id") == task_id)
    return df if source is None else df.where(F.col("source") == source)


def panel_rows(df: DataFrame) -> DataFrame:
    return df.select(*schemas.SNAPSHOT_COLUMNS)


# --- snapshots -----------------------------------------------------------------------------

def write_snapshot(df: DataFrame, path: str, version: str) -> None:
    """One version of the panels of each production group.  Earlier versions stay readable, so the
    table can be read and replaced in the same job; readers see the newest one."""
    _write(df.withColumn("version", F.lit(version)), path, ["prod_group", "version"], ["source_author"])


def read_snapshot(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    df = spark.read.schema("source_author string, panel string, create_time timestamp_ntz, "
                           "prod_group string, version string").parquet(path)
    if version is not None:
        return df.where(F.col("version") == version)
    newest = {}
    # One row per version folder of a group: the partition columns alone answer it, no file is opened.
    for r in df.select("prod_group", "version").distinct().collect():
        newest[r["prod_group"]] = max(newest.get(r["prod_group"], ""), r["version"])
    keep = F.lit(False)
    for group, v in sorted(newest.items()):
        keep = keep | ((F.col("prod_group") == group) & (F.col("version") == v))
    return df.where(keep)


def pick_snapshots(names: DataFrame, prefix: str, groups: list[str]) -> DataFrame:
    """Table names that start with the prefix and end with the name of a production group."""
    suffix = "(" + "|".join(groups) + ")$"
    return names.where(F.startswith("name", F.lit(prefix)) & F.col("name").rlike(suffix))


# --- exports -------------------------------------------------------------------------------

def export_path(base: str, name: str, now: datetime) -> str:
    return f"{base}/{now:%Y_%m_%d}/{name}_{now:%Y%m%d%H%M%S}"


def export_snapshot(df: DataFrame, base: str, name: str, now: datetime) -> str:
    """Compressed export under a dated folder, one sub-folder per production group; Parquet, so that names may hold
    line breaks, quotes and blanks."""
    path = export_path(base, name, now)
    # A plain overwrite: the dated folder belongs to this export alone.
    with shuffles_dropped(df.sparkSession):
        df.hint("rebalance", "prod_group").write.mode("overwrite").partitionBy("prod_group").option("compression", "gzip").parquet(path)
    return path


def import_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("basePath", path)
                 .schema("source_author string, panel string, create_time timestamp_ntz, prod_group string")
                 .parquet(path))
