"""Mixing of sources to target weights by weighted fair queueing: documents of each source are shuffled by a hash and
get a virtual finish time, the words of their source so far divided by its target; over all sources the documents
are served by that time until the total budget is spent.  A source with a target above its size is passed through
again, up to ``most`` times.

Running sums are taken in two levels (``prefix_sums``), so a source with a third of all rows is spread over many
tasks; the global order is only resolved in the one bucket of finish times where the budget ends.  Only words, ids and
source names are shuffled, no texts.

Nulls and edge cases: null texts have no words and are never taken; a null source is a source of its own, the last;
sources without words have target 0; equal hashes are ordered by key; repeated rows count each for itself; an empty
table gives an empty result; columns of the input that clash with results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import prefix_sums, words
from panelmill.session import materialize

MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``place``, ``weight`` and ``target``.

    Places are counted over a written, range-partitioned order; the common level is found by repeated sums over the
    sources, in which sources above their limit are held there, so no task gathers all sources."""
    order = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id())
    order = materialize(order, "sources").withColumn("_p", F.shiftright("_m", 33))
    parts = order.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per file
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    mask = F.lit((1 << 33) - 1)
    s = order.join(parts, "_p").withColumn("place", F.col("_before") + F.col("_m").bitwiseAND(mask)).drop("_p", "_m", "_before")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    s = materialize(s, "weights")
    limit = most * F.col("source_size")
    total, heavy = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = (total / heavy if heavy else 0.0), 0
    while total:
        over = limit <= F.col("weight") * F.lit(float(level))
        n, fixed, rest = s.agg(F.sum(over.cast("int")), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held or not rest:
            break
        held, level = n, (total - (fixed or 0)) / rest
    return s.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit.cast("double")))


def mix(docs: DataFrame, keys: list[str], text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 17) -> DataFrame:
    """``keys`` with ``size``, ``source``, ``source_size``, ``target``, ``copies`` and ``taken`` (words) for every row.
    The first key orders documents of equal hash."""
    d = docs.select(*keys, F.size(words(F.col(text))).cast("long").alias("size"), F.col(source).alias("source"))
    d = materialize(d.withColumn("_h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))), "sizes")
    rows = d.count()
    buckets = max(1, math.isqrt(rows))  # as many buckets as rows in one
    s = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # Equal ranges of the hash: a bucket holds a like share of every source.
    half = 1 << 30
    bucket = ((F.shiftright("_h", 33) + half) * buckets / F.lit(2 * half)).cast("long")
    d = prefix_sums(d, ["source"], ["_h", *keys], "size", "_sum", bucket)
    d = d.join(s.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    d = materialize(d, "queue")
    budget = s.agg(F.sum("source_size")).first()[0] or 0

    def turn(e: int) -> Column:
        """Order in which the e-th pass serves a document: its finish time, then fixed ties."""
        time = F.try_divide(F.col("_sum") + e * F.col("source_size"), F.col("target"))
        return F.struct(time.alias("time"), F.col("place").alias("place"), F.lit(e).alias("e"), F.col("_h").alias("h"))

    turns = d.where((F.col("size") > 0) & (F.col("target") > 0)).select("size", F.explode(F.array(*[turn(e) for e in range(most)])).alias("turn"))
    times = max(1, min(buckets, 100_000))
    turns = turns.withColumn("_b", (F.least(F.col("turn.time"), F.lit(float(most))) * times).cast("long"))
    sums = turns.groupBy("_b").agg(F.sum("size").alias("n"))  # at most ``most`` times 100,000 rows
    upto = sums.withColumn("upto", F.sum("n").over(Window.orderBy("_b")))
    last = upto.where(F.col("upto") >= budget).orderBy("_b").limit(1).collect()
    if last:
        b, room = last[0]["_b"], budget - (last[0]["upto"] - last[0]["n"])
        served = F.sum("size").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
        end = turns.where(F.col("_b") == b).withColumn("served", served).where(F.col("served") <= room).agg(F.max("turn")).first()[0]
        taken = lambda e: (F.least(turn(e)["time"], F.lit(float(most))) * times).cast("long") < b
        if end is not None:
            stop = F.struct(F.lit(end["time"]).alias("time"), F.lit(end["place"]).alias("place"), F.lit(end["e"]).alias("e"), F.lit(end["h"]).alias("h"))
            before, taken = taken, lambda e: before(e) | (turn(e) <= stop)
    else:
        taken = lambda e: turn(e)["time"].isNotNull()
    copies = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & taken(e), 1).otherwise(0) for e in range(most)), F.lit(0))
    return d.withColumn("copies", copies).select(
        *keys, "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    d = docs.withColumn("_own_text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    ids = ["_own_key", "_own_text", "_own_source"]
    d = d.withColumn("_own_key", F.col(key)).withColumn("_own_source", F.col(source))
    chosen = mix(d, ids, text, source, **how).groupBy(*ids).agg(F.sum("copies").alias("_own_n"), F.count("*").alias("_own_m")).where("_own_n > 0")
    chosen = chosen.select(*[F.col(c).alias(f"_other{c}") for c in ids], "_own_n", "_own_m")
    on = [F.col(c).eqNullSafe(F.col(f"_other{c}")) for c in ids]
    j = d.join(chosen, on)
    # Repeated rows share what was taken of them.
    place = F.row_number().over(Window.partitionBy(*ids).orderBy(F.lit(1)))
    share = F.floor(F.col("_own_n") / F.col("_own_m")) + F.when(place <= F.col("_own_n") % F.col("_own_m"), 1).otherwise(0)
    j = j.withColumn("_own_share", F.when(F.col("_own_m") == 1, F.col("_own_n")).otherwise(share).cast("int"))
    return j.where("_own_share > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), "_own_share")).alias("_own_turn")).drop("_own_turn")
