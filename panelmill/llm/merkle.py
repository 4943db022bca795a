"""Merkle manifest of a dataset: three-way hash trees over the leaves of each group and over the groups' roots, with a
proof for every row.

Every node is labelled with the interval [lo, hi) of leaf ranks it covers within its group, so an ancestor's interval
contains those of all nodes below it.  Levels are taken in buckets of five: a block is a node together with the five
levels below it (at most 243 members), and blocks of one bucket make the members of the next.  Going up, blocks are
hashed; going down, a containment join on the level bucket attaches each block's ancestor, and within a block the
siblings of a node are the children of its parent outside its own interval.  A proof is the run of sibling digests up
to the root, and folding what is shown along it must give the root again.

What is shuffled: keys, digests and ranks of rows, a few times (texts never), and one row per block.  Ranks come from
a range sort over group, key and digest, so a group with a third of all rows is spread over tasks; the largest
thing in a task is one block.  The number of rounds is the logarithm of the rows to base 243.

Nulls and edge cases: a null value is hashed as ``-`` and an empty text as ``0:``; the null group is a group of its
own and the first; null keys come first in their group; rows of equal key are ordered by digest, and repeated rows
are a leaf each; an empty table gives an empty result; a very long text only counts while its own row is hashed; columns
not named are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.common import by_value, map_rows
from panelmill.session import materialize

by_value(__name__)

ARITY, LEVELS = 3, 5
SPAN = ARITY ** LEVELS
EMPTY = hashlib.sha256(b"").digest()


def encoded(value: Column, kind: T.DataType) -> Column:
    """A value as it is hashed: its bytes behind their number, ``-`` if null."""
    x = value if isinstance(kind, T.StringType) else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf(docs: DataFrame, fields: list[str], **other: Column) -> Column:
    """The digest of a row's ``fields``; ``other`` names values that stand in for some of them."""
    parts = [encoded(other.get(f, F.col(f"`{f}`")), docs.schema[f].dataType) for f in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def combine(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes, which go in as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def levels(members: list[tuple[int, int, bytes]], n: int) -> list[list[tuple[int, int, bytes]]]:
    """The levels of a block, members (lo, hi, digest) first, of a tree whose bucket has ``n`` members in all."""
    out = [members]
    for _ in range(min(LEVELS, height(n))):
        last = out[-1]
        runs = [last[i:i + ARITY] for i in range(0, len(last), ARITY)]
        out.append([(r[0][0], r[-1][1], combine([d for _, _, d in r])) for r in runs])
    return out


def siblings(block: list[list[tuple[int, int, bytes]]], at: int) -> bytes:
    """Digests beside the path from member ``at`` to the top of its block, level by level."""
    found = []
    for below, above in zip(block, block[1:]):
        lo, hi, _ = below[at]
        parent = at // ARITY
        first, end, _ = above[parent]
        run = below[parent * ARITY:parent * ARITY + ARITY]
        # The parent's interval less the node's own.
        found += [d for a, b, d in run if first <= a and b <= end and (b <= lo or a >= hi)]
        at = parent
    return b"".join(found)


def fold(digest: bytes, at: int, n: int, path: bytes) -> tuple[bytes, bytes]:
    """The root of a tree of ``n`` leaves from leaf ``at`` and the siblings on its path, and what is left of the path."""
    while n > 1:
        run, place = min(ARITY, n - at // ARITY * ARITY), at % ARITY
        own = [path[32 * i:32 * i + 32] for i in range(run - 1)]
        path = path[32 * (run - 1):]
        digest = combine([*own[:place], digest, *own[place:]])
        at, n = at // ARITY, -(-n // ARITY)
    return digest, path


def ranked(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within ``group`` by ``order``, nulls first, and the group's ``size``."""
    g = F.col(group) if group else F.lit(0)
    by = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    d = rows.withColumn("row", F.monotonically_increasing_id())
    d = materialize(d, "leaves")
    d = d.repartitionByRange(*by, "row").sortWithinPartitions(*by, "row").drop("row")
    d = d.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    d = materialize(d, "sorted").withColumn("in", g)
    # One row per partition and group in it.
    parts = d.groupBy(F.col("in").alias("in_"), F.col("part").alias("part_")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("in_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("in_", "part_", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                         F.sum("n").over(Window.partitionBy("in_")).alias("size"))
    d = d.join(parts, F.col("in").eqNullSafe(F.col("in_")) & (F.col("part") == F.col("part_")))
    return d.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("in", "in_", "part", "part_", "at", "first", "before")


def _blocks(members: DataFrame) -> DataFrame:
    """Blocks (g, bucket, lo, hi, n, members) of members (g, i, lo, hi, n, d): ``i`` counts the members of a level bucket
    within the group, ``n`` is how many there are."""
    b = members.groupBy("g", F.expr(f"i div {SPAN}").alias("bucket")).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "d"))).alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max("n").alias("n"))
    return b.select("g", "bucket", "lo", "hi", "n", "members")


def _members(c: dict):
    for lo, hi, d in zip(c["lo"], c["hi"], c["d"]):
        yield [(a, b, x) for a, b, x in zip(lo, hi, d)]


def _unzipped(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.select(*more, "bucket", "n", *[F.col("members")[c].alias(c) for c in ("lo", "hi", "d")])


def tops(blocks: DataFrame, kind: str) -> DataFrame:
    """The top node of each block, as a member (g, i, lo, hi, n, d) of the next bucket of levels."""
    def run(c):
        for g, bucket, n, members in zip(c["g"], c["bucket"], c["n"], _members(c)):
            lo, hi, d = levels(members, n)[-1][0]
            yield g, bucket, lo, hi, -(-n // SPAN), d

    return map_rows(_unzipped(blocks, "g"), run, f"g {kind}, i long, lo long, hi long, n long, d binary")


def tree(members: DataFrame, kind: str) -> tuple[list[DataFrame], DataFrame]:
    """All blocks by level bucket, leaves first, and the roots (g, d) of the groups."""
    buckets = []
    while True:
        blocks = materialize(_blocks(members), "blocks")
        members = materialize(tops(blocks, kind), "tops")
        buckets.append(blocks)
        if not members.where("n > 1").limit(1).count():
            return buckets, members.select("g", "d")


def paths(blocks: DataFrame, above: DataFrame, kind: str) -> DataFrame:
    """(g, lo, hi, path, own): siblings from each member of ``blocks`` to the root.  ``above`` has (g, lo, hi, path, own) of
    the tops of the blocks, found by containment of intervals within the level bucket."""
    a = above.select(F.col("g").alias("g_"), F.col("bucket").alias("bucket_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "path", "own")
    inside = F.col("g").eqNullSafe(F.col("g_")) & (F.col("bucket") == F.col("bucket_")) & (F.col("lo_") <= F.col("lo")) & (F.col("hi") <= F.col("hi_"))
    j = blocks.join(a, inside).drop("lo", "hi")

    def run(c):
        for g, bucket, n, members, path, own in zip(c["g"], c["bucket"], c["n"], _members(c), c["path"], c["own"]):
            block = levels(members, n)
            for k, (lo, hi, _) in enumerate(members):
                yield g, bucket * SPAN + k, lo, hi, siblings(block, k) + path, own

    return map_rows(_unzipped(j, "g", "path", "own"), run, f"g {kind}, bucket long, lo long, hi long, path binary, own binary")


def proofs(docs: DataFrame, fields: list[str], key: str, group: str, shown: Column | None = None) -> DataFrame:
    """Every row's key with ``leaf``, ``subroot`` (of its group), ``root``, ``proof_sha256``, and for the leaf digest
    ``shown`` in its place (a column over ``docs``; null: the leaf itself) ``folded_root`` and ``verified``."""
    whole = leaf(docs, fields)
    rows = docs.select(F.col(f"`{group}`").alias("g"), F.col(f"`{key}`").alias("k"), whole.alias("d"), (whole if shown is None else shown).alias("s"))
    # Most rows are shown as they are; theirs need not be kept.
    rows = rows.withColumn("s", F.when(F.col("s") != F.col("d"), F.col("s")))
    kind, name = docs.schema[group].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    rows = materialize(ranked(rows, "g", ["k", "d"]).select("g", "k", "d", "s", "rank", "size"), "ranked")
    members = lambda d: d.select("g", F.col("rank").alias("i"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("size").alias("n"), "d")
    buckets, subroots = tree(members(rows), kind)
    groups = materialize(ranked(subroots, None, ["g"]).select(F.col("g").alias("name"), "d", "rank", "size"), "groups")
    over, top = tree(members(groups.withColumn("g", F.lit(0))), "int")
    found = top.first()
    if found is None:
        return docs.sparkSession.createDataFrame([], f"`{key}` {name}, leaf string, subroot string, root string, proof_sha256 string, "
                                                     "folded_root string, verified boolean")
    root, n_groups = bytes(found["d"]), groups.count()
    above = top.select("g", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("lo"), F.lit(n_groups).cast("long").alias("hi"),
                       F.lit(b"").alias("path"), F.lit(b"").alias("own"))
    for blocks in reversed(over):
        above = materialize(paths(blocks, above, "int"), "paths")
    # From here on intervals are of leaves within a group; ``own`` holds the group's place and root.
    place = F.concat(F.unhex(F.lpad(F.hex("rank"), 16, "0")), F.col("d"))
    sizes = rows.select("g", "size").distinct().withColumnRenamed("g", "g_")
    above = above.join(groups, F.col("lo") == F.col("rank")).join(sizes.withColumnRenamed("size", "leaves"), F.col("name").eqNullSafe(F.col("g_")))
    above = above.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("lo"),
                         F.col("leaves").alias("hi"), "path", place.alias("own"))
    for blocks in reversed(buckets[1:]):
        above = materialize(paths(blocks, above, kind), "paths")
    whole = rows.groupBy("g", F.expr(f"rank div {SPAN}").alias("bucket")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "d", "k", "s"))).alias("rows"), F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"),
        F.max("size").alias("n"))
    a = above.select(F.col("g").alias("g_"), F.col("bucket").alias("bucket_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "path", "own")
    inside = F.col("g").eqNullSafe(F.col("g_")) & (F.col("bucket") == F.col("bucket_")) & (F.col("lo_") <= F.col("lo")) & (F.col("hi") <= F.col("hi_"))
    j = whole.join(a, inside).select("n", "path", "own", *[F.col("rows")[c].alias(c) for c in ("rank", "d", "k", "s")])

    def run(c):
        for n, path, own, ranks, ds, ks, ss in zip(c["n"], c["path"], c["own"], c["rank"], c["d"], c["k"], c["s"]):
            block = levels([(r, r + 1, d) for r, d in zip(ranks, ds)], n)
            place, subroot = int.from_bytes(own[:8], "big"), own[8:]
            for at, (r, d, k, s) in enumerate(zip(ranks, ds, ks, ss)):
                proof = siblings(block, at) + path
                up, rest = fold(s or d, r, n, proof)
                up, _ = fold(up, place, n_groups, rest)
                yield (k, d.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof.hex().encode()).hexdigest(), up.hex(), up == root)

    return map_rows(j, run, f"`{key}` {name}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
