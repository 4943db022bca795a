"""Language identification by rank-order profiles: the most frequent character n-grams of a document, ranked, are
compared to each language's ranked profile by out-of-place distance.

Training counts n-grams of labelled rows with one shuffle of (language, n-gram) counts; at most ``per_language`` rows
of a language are used (a documented bound for the fit), chosen by a hash.  A profile has ``top`` n-grams, so the model
holds languages times ``top`` rows, of all languages.  Prediction is row-wise.

Nulls and edge cases: letters are those of Unicode, with the marks on them; a null text, or one without a letter, is ``und`` with score 0; null labels are not learned; ties
between n-grams go to the smaller code points, ties between languages to the first by name; repeated rows are
judged each for itself; with nothing to learn from, every row is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import by_value, map_rows
from panelmill.session import materialize

by_value(__name__)

TOP, SIZES, PER_LANGUAGE, SLICE, LARGE = 400, (1, 2, 3), 3_000, 1 << 20, 10_000
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Characters of which some are numerals or marks that the pattern above takes wrongly; letters and marks by category.
UNUSUAL = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u02b0-\U0010ffff]")
NOT_LETTERS_OR_MARKS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the letter n-grams of a whole text; words are set off by one blank."""
    t = (text or "").lower()
    usual = not UNUSUAL.search(t)
    t = (NOT_LETTERS if usual else NOT_LETTERS_OR_MARKS).sub(" ", t).strip()
    if not t or not usual and not LETTER.search(t):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    keys, counts = [], []
    for at in range(0, len(a), SLICE):
        part = []
        for n in SIZES:
            x = a[at:at + SLICE + n - 1]
            k = np.zeros(max(0, len(x) - n + 1), np.int64)
            for j in range(n):
                k = (k << 21) | x[j:len(x) - n + 1 + j]
            inner = np.zeros(len(k), bool) if n < 3 else x[1:len(k) + 1] == 32
            part.append(k[(k != 32) & ~inner])
        k, c = np.unique(np.concatenate(part), return_counts=True)
        keys.append(k)
        counts.append(c)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent keys, most frequent first."""
    return keys[np.argsort(-counts, kind="stable")[:top]]


def train(docs: DataFrame, label: str = "lang", text: str = "text", pick: Column | None = None,
          per_language: int = PER_LANGUAGE, top: int = TOP) -> dict[str, list[int]]:
    """Language -> ranked n-gram keys.  ``pick`` orders rows at random for the choice of training rows."""
    chance = F.pmod(pick if pick is not None else F.xxhash64(text), F.lit(1_000_000)) / F.lit(1e6)
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("l"), F.col(text).alias("t"), chance.alias("c"))
    sizes = materialize(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # Languages of more than one row in LARGE are fewer than LARGE and go to all tasks; only texts of others are shuffled.
    large, small = (sizes.where(x).withColumnRenamed("l", "_l") for x in (F.col("n") * LARGE > total, F.col("n") * LARGE <= total))
    marked = rows.join(F.broadcast(large), F.col("l") == F.col("_l"), "left")
    chosen = marked.where(F.col("c") * F.col("n") < per_language).select("l", "t")
    if not small.isEmpty():
        others = marked.where("_l IS NULL").select("l", "t", "c").join(small, F.col("l") == F.col("_l"))
        chosen = chosen.union(others.where(F.col("c") * F.col("n") < per_language).select("l", "t"))

    def count(c):
        for lang, t in zip(c["l"], c["t"]):
            for k, n in zip(*(x.tolist() for x in grams(t))):
                yield lang, k, n

    counted = map_rows(chosen, count, "l string, g bigint, n bigint", 50_000)
    total = counted.groupBy("l", "g").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    model: dict[str, list[int]] = {}
    for r in total.withColumn("r", place).where(F.col("r") <= top).orderBy("l", "r").collect():
        model.setdefault(r["l"], []).append(r["g"])
    return model


class Profiles:
    """Profiles ready for lookups."""

    def __init__(self, model: dict[str, list[int]], top: int):
        self.top, self.names, self.tables = top, sorted(model), []
        for name in self.names:
            keys = np.array(model[name], np.int64)
            order = np.argsort(keys)
            self.tables.append((keys[order], order))

    def guess(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 minus its distance over the greatest possible one."""
        own = ranked(*grams(text), self.top)
        if not len(own) or not self.names:
            return "und", 0.0
        best, name = None, "und"
        place = np.arange(len(own))
        for lang, (keys, rank) in zip(self.names, self.tables):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            far = np.where(keys[at] == own, np.minimum(np.abs(rank[at] - place), self.top), self.top).sum()
            if best is None or far < best:
                best, name = far, lang
        return name, float(1 - best / (len(own) * self.top))


def identify(docs: DataFrame, model: dict[str, list[int]], keys: list[str], text: str = "text", top: int = TOP) -> DataFrame:
    """``keys`` with ``lang_pred`` and ``score`` for every row."""
    def rows(c):
        p = Profiles(model, top)
        for *k, t in zip(*[c[f"k{i}"] for i in range(len(keys))], c["t"]):
            yield (*k, *p.guess(t))

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")), rows,
                    f"{kinds}, lang_pred string, score double")
