"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: blank, and the code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Send the task functions of ``module`` with the job, so that executors need not have it installed."""
    register_pickle_by_value(sys.modules[module])


by_value(__name__)


def once(key: tuple, make: Callable):
    """``make()``, once per Python process: functions sent by value have new globals in every task."""
    import types
    kept = sys.modules.setdefault("_panelmill_kept", types.ModuleType("_panelmill_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def words(text: Column) -> Column:
    """The words of a text, as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def map_rows(df: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str, flush: int = 2_000) -> DataFrame:
    """Rows ``f(columns of one Arrow batch as lists)`` yields, in Arrow batches of ``flush`` rows."""
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            yield from to_batches(f(batch.to_pydict()), arrow, flush)

    return df.mapInArrow(run, schema)


def to_batches(rows: Iterator[tuple], schema: pa.Schema, flush: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``flush`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= flush:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str, bucket: Column) -> DataFrame:
    """Inclusive running sum of ``value`` within ``group`` by ``order``, in two levels: the sums of buckets
    (contiguous ranges of the order, of even size) are accumulated first, then each bucket for itself.  No task
    holds more than one bucket of one group, or the bucket sums of one group."""
    from pyspark.sql import Window
    b = df.withColumn("_bucket", bucket)
    sums = b.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"),
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket") == F.col("_b")]
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    drop = ["_bucket", "_b", "_before", *[f"_g{i}" for i in range(len(group))]]
    return b.join(sums, on).withColumn(out, F.sum(value).over(within) + F.col("_before")).drop(*drop)
