"""Document fingerprints from prefix polynomial hashes: arrays of modular prefix values answer the equality of any two
spans in constant time and their longest common extension by binary search; a document's fingerprint is its whole
hash and the smallest hashes of its spans of one length, whose overlap estimates likeness.

Neighbours in the order of keys meet by one shuffle into key ranges; only the first row of each range is sent twice.

Nulls and edge cases: a null text is empty; rows with a null key come first; rows with equal keys follow each other by
text; the row after the last is the first; a single row follows itself; an empty table gives an empty result; only
key and text are read, so other columns may clash or be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import arrow_schema, by_value, map_rows, to_batches

by_value(__name__)

#: Two primes below 2**31 (products fit 62 bits) and a base for each.
MODULI = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
SPAN, KEEP = 24, 96
SHORT_SPAN, SHORT_TEXT = 5, 400


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self, p: int, base: int):
        self.p, self.base = np.uint64(p), base
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.inverse = pow(base, -1, p)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, a * np.uint64(pow(b, k, int(self.p))) % self.p]))
        return self.up[:n], self.down[:n]


POWERS = [Powers(*m) for m in MODULI]


def points(text: str) -> np.ndarray:
    """Code points, plus one so that leading NULs count."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class Prefixes:
    """Prefix hashes of one text."""

    def __init__(self, text: str):
        a = points(text)
        self.n = len(a)
        self.sums = []
        for w in POWERS:
            up, _ = w.of(self.n)
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(a * up % w.p, out=s[1:])  # below 2**31 each: no overflow before 2**33 characters
            s %= w.p
            self.sums.append(s)

    def span(self, i: int, j: int) -> int:
        """Hash of characters i to j; equal spans have equal hashes wherever they lie."""
        out = 0
        for w, s in zip(POWERS, self.sums):
            p = int(w.p)
            out = out << 31 | (int(s[j]) - int(s[i])) * int(w.of(self.n + 1)[1][i]) % p
        return out

    def windows(self, length: int) -> np.ndarray:
        """Hashes by the first modulus of all spans of one length; of the whole text if it is shorter."""
        length = min(length, self.n)
        if not length:
            return np.empty(0, np.uint64)
        w, s, n = POWERS[0], self.sums[0], self.n - length + 1
        return (s[length:] + w.p - s[:n]) % w.p * w.of(n)[1] % w.p

    def extension(self, i: int, other: "Prefixes", j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def scatter(h: np.ndarray) -> np.ndarray:
    """Mix the bits, so that the smallest values are a random choice."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def smallest(p: Prefixes, span: int, keep: int) -> str:
    """The ``keep`` smallest scattered hashes of spans, in hexadecimal."""
    h = scatter(p.windows(span))
    low = np.unique(np.partition(h, 4 * keep)[:4 * keep] if len(h) > 8 * keep else h)
    if len(low) < keep < len(h):  # many repeats among the smallest
        low = np.unique(h)
    return low[:keep].astype(">u8").tobytes().hex()


def fingerprint(p: Prefixes, span: int = SPAN, keep: int = KEEP) -> str:
    """Length, hash of the whole text, the smallest span hashes, and for short texts those of short spans."""
    short = smallest(p, SHORT_SPAN, keep) if p.n < SHORT_TEXT else ""
    return f"{p.n}-{p.span(0, p.n):016x}-{smallest(p, span, keep)}-{short}"


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """Estimated share of common spans (twice those of both over those of each) of two texts, from their fingerprints
    alone; 1 for equal texts.  Two short texts are compared by short spans."""
    if a == b:
        return 1.0
    fields = [f.split("-") for f in (a, b)]
    use = 3 if all(f[3] for f in fields) else 2
    x, y = (set(np.frombuffer(bytes.fromhex(f[use]), ">u8").tolist()) for f in fields)
    low = sorted(x | y)[:keep]
    both = sum(h in x and h in y for h in low)
    return 2 * both / (len(low) + both) if low else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first characters of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def with_neighbours(docs: DataFrame, key: str, text: str, rows_per_range: int = 1_000) -> DataFrame:
    """Rows of (range, key, text, edge), partitioned by range and sorted; the first row of the next range follows each
    range as an edge.  Keys are numbers; ranges are cut at their percentiles, at most 10,000 of them, so
    what the driver holds is bounded and no range holds more than a small share of the rows."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = d.select("k").count()
    ranges = max(1, min(10_000, n // rows_per_range))
    cuts: list = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(d.select(F.percentile_approx("k", at, max(10_000, 4 * ranges)).alias("c")).first()["c"]))
    # The range of a key is the number of cuts that are not above it: -1 for a null key.
    bounds = F.array(*[F.lit(c).cast(d.schema["k"].dataType) for c in cuts]) if cuts else None
    low = F.lit(0) if bounds is None else _place(bounds, len(cuts))
    d = d.withColumn("r", F.when(F.col("k").isNull(), F.lit(-1)).otherwise(low).cast("long"))
    firsts = d.groupBy("r").agg(F.min("k").alias("k")).orderBy("r").collect()  # one row per range
    if not firsts:
        return d.withColumn("edge", F.lit(False)).select("r", "k", "t", "edge")
    before = [(firsts[i - 1]["r"], f["r"], f["k"]) for i, f in enumerate(firsts)]
    edges = F.broadcast(spark.createDataFrame(before, "to long, r long, k " + d.schema["k"].dataType.simpleString()))
    e = d.join(edges.select(F.col("to"), F.col("r").alias("r2"), F.col("k").alias("k2")),
               (F.col("r") == F.col("r2")) & F.col("k").eqNullSafe(F.col("k2")), "left")
    own = F.struct(F.col("r").alias("r"), F.lit(False).alias("edge"))
    also = F.struct(F.col("to").alias("r"), F.lit(True).alias("edge"))
    e = e.select(F.inline(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also))), "k", "t")
    return (e.repartition("r").sortWithinPartitions("r", "edge", F.col("k").asc_nulls_first(), "t")
            .select("r", "k", "t", "edge"))


def _place(bounds, n: int):
    """Number of bounds that are not above k, by binary search in the row."""
    k = F.col("k")
    steps = max(1, n.bit_length())
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("a"), F.lit(n).alias("b")),
        lambda s, _: F.struct(
            F.when((s["a"] < s["b"]) & (F.get(bounds, ((s["a"] + s["b"]) / 2).cast("int")) <= k),
                   ((s["a"] + s["b"]) / 2).cast("int") + 1).otherwise(s["a"]).alias("a"),
            F.when((s["a"] < s["b"]) & ~(F.get(bounds, ((s["a"] + s["b"]) / 2).cast("int")) <= k),
                   ((s["a"] + s["b"]) / 2).cast("int")).otherwise(s["b"]).alias("b")))
    return span["a"]


def _compare(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Result rows from rows of (range, key, text, edge) in order."""
    held = None  # (range, key, text, prefixes, fingerprint)
    done = None  # the range whose edge has been used
    for r, k, t, edge in rows:
        if edge and (held is None or held[0] != r or done == r):
            continue
        p = Prefixes(t)
        now = (r, k, t, p, fingerprint(p))
        if held is not None and held[0] == r:
            yield _row(held, now)
        held = None if edge else now
        done = r if edge else done


def _row(a: tuple, b: tuple) -> tuple:
    new = edited(a[2], b[2])
    q = Prefixes(new)
    f = fingerprint(q)
    return (a[1], a[3].n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), a[4], f,
            likeness(a[4], f), likeness(a[4], b[4]), a[3].extension(0, q, 0))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: length, checksum of the edited text, both fingerprints, their likeness, the likeness to the
    next document, and the longest common extension of the text and the edited text from their starts."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"{key} {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, common_prefix bigint")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from to_batches(_compare(rows), arrow, 500)

    return with_neighbours(docs, key, text).mapInArrow(run, schema)


def fingerprint_texts(docs: DataFrame, keys: list[str], text: str = "text", span: int = SPAN, keep: int = KEEP) -> DataFrame:
    """``keys`` and the fingerprint of every text: row-wise, no shuffle."""
    def rows(c):
        for *k, t in zip(*[c[f"k{i}"] for i in range(len(keys))], c["t"]):
            yield (*k, fingerprint(Prefixes(t or ""), span, keep))

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")), rows,
                    f"{kinds}, fingerprint string")
