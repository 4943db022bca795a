"""Session settings and the shared work folder."""

import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a job needs on top of the cluster's own settings.  Partition counts stay with AQE: it starts
# from many small shuffle partitions and merges them to the advisory size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Stream state larger than the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "panelmill", master: str | None = None, **extra) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str = "run") -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without that setting; a cluster must name a folder that all its
    machines see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="panelmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"panelmill-{name}-{uuid.uuid4().hex}")


#: Shuffle files go as soon as the write that made them has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, what a write or an action shuffled is deleted when that ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files that
    outlive any executor."""
    path = work_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Empty the work files of tables of ``materialize`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
            if folder.startswith("panelmill-"):
                spark.range(0).write.mode("overwrite").parquet(os.path.join(spark.conf.get("spark.checkpoint.dir"), folder))


def fixed_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A fixed lookup table as literal rows of the plan, whose size Spark knows."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow = pa.table({f.name: pa.array(list(c)) for f, c in zip(schema, columns)})
    return spark.createDataFrame(arrow, schema)


def maybe_in(df: DataFrame, column: Column, members: DataFrame, member: Column, each: int = 8) -> DataFrame:
    """Rows of ``df`` whose hash ``column`` (a long) may be among the hashes ``member`` of ``members``.

    A bit table of at most 2**26 bits (a million short rows) goes to all tasks, so what is sent is bounded; rows that
    pass by chance, about one in ``each`` or fewer while the table has ``each`` bits a member, are for the join that follows."""
    n = max(1, members.count())
    bits = min(26, max(14, (each * n).bit_length()))
    word = F.shiftrightunsigned("_hash", 64 - bits + 6)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_hash").bitwiseAND(F.lit(63)).cast("int"))
    table = members.select(member.alias("_hash")).groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    d = df.withColumn("_hash", column).withColumn("_w", word).join(F.broadcast(table), F.col("_w") == F.col("_word"))
    return d.where(F.col("_bits").bitwiseAND(one) != 0).drop("_hash", "_w", "_word", "_bits")


def marked_in(df: DataFrame, name: str, column: Column, members: DataFrame, member: Column, each: int = 8) -> DataFrame:
    """``df`` with the boolean ``name``: whether ``maybe_in`` would keep the row."""
    n = max(1, members.count())
    bits = min(26, max(14, (each * n).bit_length()))
    word = F.shiftrightunsigned("_hash", 64 - bits + 6)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_hash").bitwiseAND(F.lit(63)).cast("int"))
    table = members.select(member.alias("_hash")).groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    d = df.withColumn("_hash", column).withColumn("_w", word).join(F.broadcast(table), F.col("_w") == F.col("_word"), "left")
    return d.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False))).drop("_hash", "_w", "_word", "_bits")
