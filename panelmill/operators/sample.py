"""Samples that repeat: rows are chosen by a hash of their id."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.constants import SAMPLE_ROWS, SAMPLE_SHARE
from panelmill.functions.text import sample_hash


def _first_k(df: DataFrame, by: Sequence[str], k: int, order: list[Column]) -> DataFrame:
    """First k rows per group; Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def sample_results(results: DataFrame, task_id: str, k: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE) -> DataFrame:
    """Up to ``k`` rows of a task per source, out of a share of its rows."""
    h = sample_hash("id")
    df = results.where((F.col("task_id") == task_id) & (h <= int(share * 2 ** 32)))
    return _first_k(df, ["source"], k, [h, F.col("id"), F.col("source_author"), F.col("panel")])


def stratified_sample(examples: DataFrame, k: int | None, label: str = "label", id_col: str = "id",
                      shuffle: bool = True) -> DataFrame:
    """``k`` rows per label, a smaller label whole; in hash order if ``shuffle``."""
    h = sample_hash(id_col)
    df = examples if k is None else _first_k(examples, [label], k, [h, F.col(id_col)])
    return df.orderBy(h, id_col) if shuffle else df
