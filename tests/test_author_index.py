from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill.operators import author_index as index
from panelmill.operators import metrics

T0 = datetime(2024, 1, 1)


def posts(spark, rows):
    return spark.createDataFrame(rows, "source string, source_author string, post_time timestamp_ntz")


def rows(n=400):
    out = [("Ptt" if i % 3 else None, f" u{i * i % 57}　" if i % 2 else f"u{i % 41}", T0 + timedelta(hours=i % 72)) for i in range(n)]
    return out + [("empty", None, T0), ("blog", "", T0), ("blog", None, T0), ("blog", "  ", T0 + timedelta(hours=7)), ("late", "x", None)]


def as_dict(df):
    return {r["source"]: r["uniq_authors"] for r in df.collect()}


@pytest.mark.parametrize("hours", [(0, 72), (0, 6), (18, 54), (66, 72), (72, 90), (12, 12)])
def test_ranges_equal_a_count_over_posts(spark, tmp_path_factory, hours):
    folder = str(tmp_path_factory.mktemp("index"))
    df = posts(spark, rows())
    index.add_posts(df, folder)
    a, b = (T0 + timedelta(hours=h) for h in hours)
    live = df.where((F.col("post_time") >= F.lit(str(a)).cast("timestamp_ntz")) & (F.col("post_time") < F.lit(str(b)).cast("timestamp_ntz")))
    want = as_dict(metrics.uniq_authors(live))
    assert as_dict(index.authors_between(spark, folder, a, b)) == want
    assert as_dict(index.authors_between(spark, folder, a, b, approx=True)) == want
    total = index.authors_between(spark, folder, a, b, keys=()).first()["uniq_authors"]
    assert (total or 0) == live.select(metrics.trim_author("source_author")).distinct().dropna().count()


def test_parts_added_later_and_again(spark, tmp_path):
    folder, month = str(tmp_path), (T0, T0 + timedelta(days=30))
    index.add_posts(posts(spark, [("a", f"u{i}", T0) for i in range(50)]), folder)
    index.add_posts(posts(spark, [("a", f"u{i}", T0 + timedelta(days=1)) for i in range(25, 70)] * 2), folder)
    assert as_dict(index.authors_between(spark, folder, *month)) == {"a": 70}
    index.add_posts(posts(spark, [("a", "u1", T0)]), folder)  # the first slice once more, with one author
    assert as_dict(index.authors_between(spark, folder, *month)) == {"a": 46}
    index.add_posts(posts(spark, []), folder)
    assert as_dict(index.authors_between(spark, folder, *month)) == {"a": 46}
    n = [r["n"] for r in spark.read.parquet(f"{folder}/numbers").collect()]
    assert sorted(n) == list(range(1, 71))


def test_more_authors_than_a_bitmap(spark, tmp_path):
    df = spark.range(80_000).select(F.lit("a").alias("source"), F.concat(F.lit("u"), F.col("id") % 70_000).alias("source_author"),
                                    F.lit("2024-01-01 03:00:00").cast("timestamp_ntz").alias("post_time"))
    index.add_posts(df, str(tmp_path))
    assert as_dict(index.authors_between(spark, str(tmp_path), T0, T0 + timedelta(hours=6))) == {"a": 70_000}


def test_ranges_must_lie_on_borders(spark, tmp_path):
    with pytest.raises(ValueError, match="border"):
        index.authors_between(spark, str(tmp_path), T0, T0 + timedelta(hours=1))


def test_a_question_reads_only_its_slices(spark, tmp_path):
    index.add_posts(posts(spark, rows()), str(tmp_path))
    plan = index.authors_between(spark, str(tmp_path), T0, T0 + timedelta(hours=6))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan
