"""Jaccard join of word n-gram sets by chosen paths: sets are split recursively on sampled tokens they share, small
buckets are compared by brute force, and runs are repeated until the wanted recall.

A set keeps a token at a node of a run's tree if the node's hash of it is below ``branch`` over the size of the set; a
node two tokens deep is a bucket.  Two sets of similarity 0.8 share a token per node with a chance that gives the number of
runs for ``recall`` (a pair's chance to meet; more similar pairs meet more often).  Buckets above ``split_above`` rows are
split on further tokens; buckets are compared through 256-bit sketches (sign bits of minima), with a margin of five
standard deviations, and give a spanning forest, not pairs.  Its components are then compared exactly, in blocks, so
links that no bucket had are found too where the two sets are otherwise connected.

Equal sets are one node, so a group of copies costs one row.  Large buckets and components are dealt as pairs of blocks
to many tasks; no task holds more than two blocks, and what leaves a task is at most one row for each set in it.

Nulls and edge cases: sets are of words as they stand; fewer words than n make one gram of all of them; null and
empty texts, and those without a word, are alone in their class with no links; repeated rows are copies of each other; a
class is named by its least key that is not null; an empty table gives an empty result; only key and text are read,
so other columns may clash or be null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import arrow_schema, by_value, map_rows
from panelmill.llm.components import components
from panelmill.session import materialize

by_value(__name__)

N, SIMILARITY, RECALL, BRANCH, DEPTH = 5, 0.8, 0.9999, 2.0, 2
SPLIT_ABOVE, DEEPEST, BLOCK, EXACT_BLOCK, SKETCH = 20_000, 6, 1024, 256, 256
MULTIPLY = np.random.default_rng(20).integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float, similarity: float, branch: float = BRANCH, depth: int = DEPTH) -> int:
    """Runs after which a pair of just ``similarity`` has met with probability ``recall``, sizes as unequal as they
    may be: each node then shares a Poisson number of children with mean branch times similarity."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-branch * similarity * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = scatter(h + w[i:len(w) - size + 1 + i])
    return np.unique(h)


def sketch(x: np.ndarray) -> bytes:
    """One bit of the least product with each of ``SKETCH`` multipliers; two sets agree in a bit with chance (1 + J) / 2."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (x[at:at + 1024, None] * MULTIPLY).min(axis=0))
    return np.packbits((low >> np.uint64(30)) & np.uint64(1)).tobytes()


def children(x: np.ndarray, paths: np.ndarray, branch: float) -> np.ndarray:
    """Paths one token longer: for each path, the tokens whose hash at that node is low enough."""
    keep = np.uint64(min((1 << 64) - 1, int(branch / len(x) * (1 << 64))))
    step = max(1, (1 << 16) // max(1, len(x)))
    out = []
    for at in range(0, len(paths), step):
        h = scatter(x[None, :] ^ paths[at:at + step, None])
        out.append(scatter(h[h <= keep] + np.uint64(1)))
    return np.unique(np.concatenate(out)) if out else paths[:0]


def leaves(x: np.ndarray, runs: int, branch: float = BRANCH, depth: int = DEPTH) -> np.ndarray:
    paths = scatter(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(20))
    for _ in range(depth):
        paths = children(x, paths, branch)
    return paths


# ---------------------------------------------------------------- groups inside tasks


def grouped(df: DataFrame, group: list[str], order: list[str], f: Callable, schema: str) -> DataFrame:
    """``f(table of one group)`` (an Arrow table) for every group; yields tuples of columns (arrays).  A task holds the
    groups of one batch."""
    arrow = arrow_schema(schema)
    at = len(group)

    def run(batches: Iterator[pa.RecordBatch]):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(at)]
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            if last is not None and last != tuple(k[0] for k in keys):
                yield from out(held)
                held = []
            if len(cuts) == 2:
                held.append(batch)
            else:
                held.append(batch.slice(0, cuts[1]))
                yield from out(held)
                if len(cuts) > 3:
                    yield from out([batch.slice(cuts[1], cuts[-2] - cuts[1])], [c - cuts[1] for c in cuts[1:-1]])
                held = [batch.slice(cuts[-2])]
            last = tuple(k[-1] for k in keys)
        if held:
            yield from out(held)

    def out(held: list, cuts: list[int] | None = None):
        table = pa.Table.from_batches(held)
        columns = f(table, cuts or [0, table.num_rows])
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type, from_pandas=False) for c, t in zip(columns, arrow)], schema=arrow)

    parts = df.select(*group, *[c for c in df.columns if c not in group]).repartition(*group)
    return parts.sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least index in the component of each."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def alike(bits: np.ndarray, sizes: np.ndarray, i: slice, j: slice, similarity: float) -> np.ndarray:
    """Whether sketches, and sizes, leave room for the similarity."""
    differ = np.zeros((i.stop - i.start, j.stop - j.start), np.int32)
    for w in range(bits.shape[1]):
        differ += np.bitwise_count(bits[i, w, None] ^ bits[None, j, w])
    p = (1 + similarity) / 2
    most = SKETCH * (1 - p) + 5 * math.sqrt(SKETCH * p * (1 - p))
    a, b = sizes[i, None], sizes[None, j]
    return (differ <= most) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)


def sketch_links(table: pa.Table, cuts: list[int], similarity: float):
    """Forest edges (u, v) of each bucket, from sketches."""
    u = table["u"].to_numpy()
    sizes = table["n"].to_numpy()
    bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(u), SKETCH // 64)
    starts = np.array(cuts)
    length = np.diff(starts)
    two = starts[:-1][length == 2]
    out_u, out_v = [], []
    if len(two):
        differ = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1)
        p = (1 + similarity) / 2
        a, b = sizes[two], sizes[two + 1]
        ok = (differ <= SKETCH * (1 - p) + 5 * math.sqrt(SKETCH * p * (1 - p))) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
        out_u.append(u[two + 1][ok])
        out_v.append(u[two][ok])
    for k in np.flatnonzero(length > 2):
        s = slice(cuts[k], cuts[k + 1])
        label = forest(alike(bits, sizes, s, s, similarity))
        own = u[s]
        moved = label != np.arange(len(label))
        out_u.append(own[moved])
        out_v.append(own[label[moved]])
    return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (u[:0], u[:0])


def exact_links(table: pa.Table, cuts: list[int], similarity: tuple[int, int]):
    """(u, v, w): per set its weight of linked sets (v null), and forest edges (w null), from whole sets.

    A group is one block, or two different ones, of which only pairs across count."""
    top, bottom = similarity
    us, vs, ws = [], [], []
    u, i, j, block, weight, size = (table[c].to_numpy() for c in ("u", "i", "j", "block", "weight", "n"))
    flat = table["grams"].combine_chunks() if table.num_rows else None
    tokens = flat.flatten().to_numpy() if flat is not None else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(cuts[:-1], cuts[1:]):
        q = b - a
        if q < 2:
            continue
        own = tokens[ends[a]:ends[b]]
        row = np.repeat(np.arange(q), size[a:b])
        values, where, times = np.unique(own, return_inverse=True, return_counts=True)
        shared = times > 1
        rank = np.cumsum(shared) - 1
        use = shared[where]
        row, column = row[use], rank[where[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((q, q), np.float32)
        for at in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, (at, at + 4096))
            m = np.zeros((q, 4096), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            both += m @ m.T
        both = np.rint(both).astype(np.int64)
        union = size[a:b, None] + size[None, a:b] - both
        near = bottom * both >= top * union
        np.fill_diagonal(near, False)
        if i[a] != j[a]:
            near &= block[a:b, None] != block[None, a:b]
        n = near.astype(np.int64) @ weight[a:b]
        linked = n > 0
        label = forest(near)
        moved = label != np.arange(q)
        us += [u[a:b][linked], u[a:b][moved]]
        vs += [[None] * int(linked.sum()), u[a:b][label[moved]].tolist()]
        ws += [n[linked].tolist(), [None] * int(moved.sum())]
    return (np.concatenate(us), [x for y in vs for x in y], [x for y in ws for x in y]) if us else (u[:0], [], [])


# ---------------------------------------------------------------- the job


def described(docs: DataFrame, key: str, text: str, n: int, runs: int, branch: float) -> DataFrame:
    """Per row: hash of the text, signature and size of its set, sketch, and buckets."""
    def rows(c):
        for k, h, t in zip(c["k"], c["t"], c["x"]):
            x = gram_set(t, n)
            if not len(x):
                yield k, h, None, 0, None, None
                continue
            yield (k, h, hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x), sketch(x),
                   leaves(x, runs, branch).astype(np.int64).tolist())

    d = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    kind = docs.schema[key].dataType.simpleString()
    d = map_rows(d, rows, f"k {kind}, t bigint, sig binary, n bigint, sketch binary, leaves array<bigint>", 1_000)
    return d.withColumn("u", F.monotonically_increasing_id())


def gram_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``wanted`` (u, k, t) with ``grams``, from the texts; repeated rows give a row each."""
    d = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_t"), F.col(text).alias("x"))
    d = d.join(wanted.select("u", "k", "t"), F.col("_k").eqNullSafe(F.col("k")) & (F.col("_t") == F.col("t")))

    def rows(c):
        for u, t in zip(c["u"], c["x"]):
            yield u, gram_set(t, n).astype(np.int64).tolist()

    return map_rows(d.select("u", "x"), rows, "u bigint, grams array<bigint>", 500)


def pairs_of_blocks(df: DataFrame, group: list[str], rows: str, block: int) -> DataFrame:
    """Deals the rows of each group to pairs (i, j) of blocks of about ``block`` rows; ``rows`` counts the group."""
    d = df.withColumn("_m", F.ceil(F.col(rows) / block).cast("int"))
    d = d.withColumn("block", F.pmod(F.xxhash64("u", F.lit(3)), F.col("_m")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return d.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_m", "_o", rows)


def candidate_links(docs: DataFrame, nodes: DataFrame, key: str, text: str, n: int, similarity: float, branch: float,
                    split_above: int, deepest: int, block: int) -> DataFrame:
    """Forest edges (u, v) between sets that met in a bucket and whose sketches agree."""
    level = nodes.select(F.explode("leaves").alias("p"), "u")
    ready, depth = None, DEPTH
    while True:
        sizes = level.groupBy("p").agg(F.count("*").alias("m")).where("m > 1")
        level = materialize(level.join(sizes, "p"), "buckets")
        small = level.where(F.col("m") <= split_above) if depth < deepest else level
        ready = small if ready is None else ready.unionByName(small)
        large = level.where(F.col("m") > split_above)
        if depth >= deepest or large.isEmpty():
            break
        wanted = nodes.join(large.select("u").distinct(), "u", "left_semi")
        sets = gram_sets(docs, wanted, key, text, n).dropDuplicates(["u"])

        def split(c):
            for p, u, grams in zip(c["p"], c["u"], c["grams"]):
                for q in children(np.array(grams, np.int64).astype(np.uint64), np.array([p], np.int64).astype(np.uint64), branch).astype(np.int64).tolist():
                    yield q, u

        level = map_rows(large.join(sets, "u").select("p", "u", "grams"), split, "p bigint, u bigint", 20_000)
        depth += 1
    d = ready.join(nodes.select("u", "n", "sketch"), "u")
    d = pairs_of_blocks(d, ["p"], "m", block)
    return grouped(d, ["p", "i", "j"], ["block", "u"], lambda t, cuts: sketch_links(t, cuts, similarity), "u bigint, v bigint").distinct()


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, similarity: tuple[int, int] = (4, 5),
                    recall: float = RECALL, branch: float = BRANCH, split_above: int = SPLIT_ABOVE, deepest: int = DEEPEST,
                    block: int = BLOCK, exact_block: int = EXACT_BLOCK) -> DataFrame:
    """Per row of ``docs``: key ``k``, text hash ``t``, ``class_id`` (the least key of its class), ``class_rows``,
    ``n_links`` (other rows of at least the similarity), ``kept`` (one row of each class).  ``similarity`` is a fraction
    (numerator, denominator)."""
    least = similarity[0] / similarity[1]
    rows = materialize(described(docs, key, text, n, runs_for(recall, least, branch, deepest), branch), "sets")
    sigs = rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("u").alias("u"), F.count("*").alias("weight"), F.min("k").alias("least"))
    sigs = materialize(sigs, "signatures")
    nodes = rows.drop("sig").join(sigs.select("u", "weight"), "u")
    found = candidate_links(docs, nodes, key, text, n, least, branch, split_above, deepest, block)
    groups = components(found)
    sizes = groups.groupBy("component").agg(F.count("*").alias("m"))
    members = groups.join(sizes, "component").withColumnRenamed("node", "u")
    wanted = members.join(nodes.select("u", "k", "t", "n", "weight"), "u")
    sets = gram_sets(docs, wanted, key, text, n).dropDuplicates(["u"])
    dealt = pairs_of_blocks(wanted.drop("k", "t").join(sets, "u"), ["component"], "m", exact_block)
    exact = materialize(grouped(dealt, ["component", "i", "j"], ["block", "u"], lambda t, cuts: exact_links(t, cuts, similarity),
                                "u bigint, v bigint, w bigint"), "exact")
    links = exact.where(F.col("w").isNotNull()).groupBy("u").agg(F.sum("w").alias("links"))
    classes = components(exact.where(F.col("v").isNotNull()).select("u", "v"))
    s = sigs.join(classes, F.col("u") == F.col("node"), "left").withColumn("c", F.coalesce("component", "u"))
    named = s.groupBy("c").agg(F.min("least").alias("class_id"), F.sum("weight").alias("class_rows"))
    s = s.join(links, "u", "left").join(named, "c")
    s = s.select("sig", "class_id", "class_rows", "c", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("u", "k", "t", "sig").join(s, "sig", "left")
    alone = F.col("c").isNull()
    return out.select("k", "t", F.when(alone, F.col("k")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("c") == F.col("u"))).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their class."""
    kept = jaccard_classes(docs, key, text, **how).groupBy("k", "t").agg(F.sum(F.col("kept").cast("int")).alias("_own_n"), F.count("*").alias("_own_m"))
    kept = materialize(kept.where("_own_n > 0").withColumnsRenamed({"k": "_own_k", "t": "_own_t"}), "kept")
    d = docs.withColumn("_own_key", F.col(key)).withColumn("_own_text", F.xxhash64(text))
    d = d.join(kept, F.col("_own_key").eqNullSafe(F.col("_own_k")) & (F.col("_own_text") == F.col("_own_t")))
    if not kept.where("_own_m > _own_n").isEmpty():  # rows that repeat key and text
        d = d.withColumn("_own_copy", F.row_number().over(Window.partitionBy("_own_key", "_own_text").orderBy(F.lit(1)))).where("_own_copy <= _own_n")
    return d.select(*docs.columns)
