"""Classification reports from label arrays joined by row id."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eval_join(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, pred, truth): a row missing on one side has no labels there."""
    none = F.array().cast("array<string>")
    return (predicted.select("id", "pred").join(truth.select("id", "truth"), "id", "full_outer")
                     .select("id", F.coalesce("pred", none).alias("pred"), F.coalesce("truth", none).alias("truth")))


def subset_accuracy(pairs: DataFrame) -> DataFrame:
    same = F.array_sort(F.array_distinct("pred")) == F.array_sort(F.array_distinct("truth"))
    return pairs.agg(F.avg(same.cast("double")).alias("accuracy"))


def _counts(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(label, tp, fp, fn) of the given classes: one pass that shuffles one row per task and label."""
    cell = F.explode(F.transform(F.lit(list(classes)), lambda c: F.struct(
        c.alias("label"), F.array_contains("pred", c).alias("p"), F.array_contains("truth", c).alias("t"))))
    return (pairs.select(cell.alias("c")).select("c.*").groupBy("label")
                 .agg(F.count_if(F.col("p") & F.col("t")).alias("tp"),
                      F.count_if(F.col("p") & ~F.col("t")).alias("fp"),
                      F.count_if(~F.col("p") & F.col("t")).alias("fn")))


def ratio(a: Column, b: Column, zero: float) -> Column:
    return F.when(b == 0, F.lit(float(zero))).otherwise(a / b)


def _prf(zero: float) -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [ratio(tp, tp + fp, zero).alias("precision"), ratio(tp, tp + fn, zero).alias("recall"),
            ratio(2 * tp, 2 * tp + fp + fn, zero).alias("f1")]


def label_report(pairs: DataFrame, classes: Sequence[str], zero_division: float = 1.0) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    return (_counts(pairs, classes)
            .select("label", *_prf(zero_division), (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn"))


def report_averages(pairs: DataFrame, classes: Sequence[str], zero_division: float = 1.0) -> DataFrame:
    """Rows (average, precision, recall, f1): micro, macro, weighted by support, and mean per row."""
    rep = label_report(pairs, classes, zero_division)
    wide = rep.agg(*[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
                   *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"), zero_division).alias(f"weighted_{m}")
                     for m in ("precision", "recall", "f1")],
                   F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    micro = [c.alias(f"micro_{n}") for c, n in zip(_prf(zero_division), ("precision", "recall", "f1"))]
    known = F.lit(list(classes))
    p = F.array_intersect("pred", known)
    t = F.array_intersect("truth", known)
    rows = pairs.select(F.size(F.array_intersect(p, t)).alias("tp"),
                        F.size(F.array_except(p, t)).alias("fp"), F.size(F.array_except(t, p)).alias("fn"))
    per_row = rows.select(*_prf(zero_division)).agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")])
    names = ("precision", "recall", "f1")
    stacked = wide.select("*", *micro).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("average"), *[F.col(f"{k}_{m}").alias(m) for m in names])
        for k in ("micro", "macro", "weighted")])).alias("r")).select("r.*")
    return stacked.unionByName(per_row.select(F.lit("samples").alias("average"), *names))


def binarize(df: DataFrame, labels: str, classes: Sequence[str], prefix: str = "is_") -> DataFrame:
    """One 0/1 column per class."""
    return df.select("id", *[F.array_contains(labels, c).cast("int").alias(f"{prefix}{c}") for c in classes])


def cell_accuracy(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Share of (row, class) cells on which prediction and truth agree."""
    agree = sum((F.array_contains("pred", c) == F.array_contains("truth", c)).cast("int") for c in classes)
    return pairs.agg((F.sum(agree) / (F.count("*") * len(classes))).alias("accuracy"))


def explode_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """One row per label of a comma-joined label string."""
    return df.withColumn(column, F.explode(F.split(column, ",")))
