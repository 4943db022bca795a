"""Distinct authors of any range of slices, from bitmaps that are stored once per source and slice.

Authors are numbered without gaps, so a slice's authors are bits; bitmaps of slices are merged by OR, and a question about a range
reads the bitmaps of its slices and no posts.  A sketch per source and slice answers the same question in constant size, by
estimate.  A folder holds three tables: ``numbers`` (author, n; only appended to), ``bitmaps`` and ``sketches`` (partitioned
by slice; slices that are added again replace their earlier state).  One writer at a time.

Slices are counted from EPOCH, so the index serves jobs of any start; ranges must lie on slice borders.  Repeated posts
count once; null authors count as nobody, but keep their source in the result; an empty range gives no rows.

At scale: posts are reduced to distinct (keys, slice, author) before numbers are joined, so frequent authors and sources
send a row per task at most; numbering shuffles new authors once and needs a running sum over PARTS rows; a bitmap covers 32,768
authors, and the OR of a range is combined before its shuffle, whose keys include the bitmap's place, so one source that
holds most posts is spread by its authors.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.constants import SLICE_HOURS
from panelmill.functions.slices import slice_index
from panelmill.functions.text import trim_author
from panelmill.operators.clean import AUTHOR
from panelmill.session import materialize

EPOCH, PARTS = datetime(1970, 1, 1), 1024


def slice_of(moment: datetime, hours: int = SLICE_HOURS) -> int:
    """Number of the slice that begins at ``moment``."""
    n, rest = divmod(moment - EPOCH, timedelta(hours=hours))
    if rest:
        raise ValueError(f"{moment} is no border of slices of {hours} hours")
    return n


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table of the folder; None if it was never written, and no other error is passed over."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def numbered(authors: DataFrame, known: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """(author, n) of those distinct non-null ``authors`` that are not ``known``; numbers go on from the greatest known."""
    new, first = authors.where("author IS NOT NULL").distinct(), F.lit(0).cast("long")
    if known is not None:
        new = new.join(known, "author", "left_anti")
        first = F.lit(known.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]).cast("long")
    new = materialize(new.withColumn("part", F.pmod(F.xxhash64("author"), F.lit(parts))), "new-authors")
    sizes = new.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("author"))
    return new.withColumn("place", place).join(offsets, "part").select("author", (first + F.col("offset") + F.col("place")).alias("n"))


def add_posts(posts: DataFrame, folder: str, keys: Sequence[str] = ("source",), ts: str = "post_time",
              hours: int = SLICE_HOURS) -> None:
    """Put all slices of ``posts`` into the index of ``folder``, in place of what it had for them."""
    spark, keys = posts.sparkSession, list(keys)
    seen = posts.select(*keys, slice_index(ts, EPOCH, hours).cast("long").alias("slice"), trim_author(AUTHOR).alias("author"))
    seen = materialize(seen.where("slice IS NOT NULL").distinct(), "seen-authors")
    path = os.path.join(folder, "numbers")
    numbered(seen.select("author"), _stored(spark, path, "author string, n long")).write.mode("append").parquet(path)
    bits = seen.join(spark.read.schema("author string, n long").parquet(path), "author", "left")
    bitmaps = (bits.groupBy(*keys, "slice", F.bitmap_bucket_number("n").alias("chunk"))
                   .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")))
    # Sketches pass over empty strings, which are authors here, so they are given hashes.
    mark = F.when(F.col("author").isNotNull(), F.xxhash64("author"))
    sketches = seen.groupBy(*keys, "slice").agg(F.hll_sketch_agg(mark, 14).alias("sketch"))
    for name, table in (("bitmaps", bitmaps), ("sketches", sketches)):
        (table.repartition("slice", F.xxhash64(*keys, *(["chunk"] if name == "bitmaps" else [])) % 8)
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice")
              .parquet(os.path.join(folder, name)))


def _in_range(start: datetime, end: datetime, hours: int) -> Column:
    return (F.col("slice") >= slice_of(start, hours)) & (F.col("slice") < slice_of(end, hours))


def authors_between(spark: SparkSession, folder: str, start: datetime, end: datetime, keys: Sequence[str] = ("source",),
                    hours: int = SLICE_HOURS, approx: bool = False) -> DataFrame:
    """(keys, uniq_authors) of the half-open range; ``keys`` may be fewer than the index has, also none."""
    keys, live = list(keys), _in_range(start, end, hours)
    if approx:
        sketches = spark.read.parquet(os.path.join(folder, "sketches")).where(live)
        return (sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
                        .select(*keys, F.hll_sketch_estimate("sketch").alias("uniq_authors")))
    merged = (spark.read.parquet(os.path.join(folder, "bitmaps")).where(live)
                   .groupBy(*keys, "chunk").agg(F.bitmap_or_agg("bits").alias("bits")))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("uniq_authors"))
