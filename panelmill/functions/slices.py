"""Time slices: a grouping key instead of a loop of range queries."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import SLICE_HOURS


def ntz(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _hours(n: int) -> str:
    return f"INTERVAL '{int(n)}' HOUR"


def slice_index(ts: str, start: datetime, hours: int = SLICE_HOURS) -> Column:
    """0-based number of the slice of ``ts``; plain arithmetic without any time zone."""
    s = start.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"(`{ts}` - TIMESTAMP_NTZ '{s}') DIV {_hours(hours)}")


def slice_count(start: datetime, end: datetime, hours: int = SLICE_HOURS, tail: bool = True) -> int:
    step = timedelta(hours=hours)
    whole, rest = divmod(end - start, step)
    return whole + (1 if tail and rest else 0)


def with_slices(df: DataFrame, start: datetime, end: datetime, ts: str = "post_time",
                hours: int = SLICE_HOURS) -> DataFrame:
    """Half-open slices [start + i*h, start + (i+1)*h) up to ``end``, the short last one included."""
    return (df.where((F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end)))
              .withColumn("slice", slice_index(ts, start, hours)))


def with_slices_compat(df: DataFrame, start: datetime, end: datetime, ts: str = "post_time",
                       hours: int = SLICE_HOURS) -> DataFrame:
    """Slices closed at both ends: a post exactly on an inner boundary is in two slices, and a last
    slice shorter than ``hours`` is not read."""
    n = slice_count(start, end, hours, tail=False)
    last = start + timedelta(hours=hours) * n
    idx = slice_index(ts, start, hours)
    on_edge = F.expr(f"`{ts}` - {_hours(hours)} * _idx") == ntz(start)
    both = F.when(on_edge & (F.col("_idx") > 0), F.array(F.col("_idx") - 1, F.col("_idx")))
    return (df.where((F.col(ts) >= ntz(start)) & (F.col(ts) <= ntz(last)))
              .withColumn("_idx", idx)
              .withColumn("slice", F.explode(both.otherwise(F.array("_idx"))))
              .where(F.col("slice") < n)
              .drop("_idx"))
