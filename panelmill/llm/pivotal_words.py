"""Grouping of spelling variants: words one edit apart are found by pivotal grams, each word points to its more frequent
near word, and pointers are followed to a root.

Bigrams are ranked by how many words have them, rare ones first.  A word's prefix are its three rarest bigrams (with all
repeats of the last), for one edit destroys at most two.  Of the prefix, dynamic programming chooses two disjoint
bigrams of least total frequency, the pivots: one edit destroys at most one.  So of two words one edit apart, the one
whose prefix ends at the rarer bigram has a pivot that lies in the prefix of the other, shifted by at most one place.
The edit lies on one side of that pivot; the other side, pivot included, is the same in both words and is the key
of the index.  Where that side is short (WEAK characters), the side with the edit is halved and the half
without it joins the key; the place of the halves follows from the length of the indexed word, of which there are
three.  What meets is verified by edit distance.  Each near pair is found, none is dropped.

What is shuffled: words with their counts, combined before the shuffle, so frequent words are one row a task; index
rows (some thirty a distinct word); near pairs.  Bigram counts are sent to all tasks: at most the square of the alphabet.

Nulls and edge cases: a null text has no words, a null key is written as an empty one; repeated rows count again; a word
without near words is its own root; ties of frequency go to the smaller word by code points; an empty table gives an
empty result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import by_value, map_rows
from panelmill.session import materialize

by_value(__name__)

LETTERS, UPPER, LOWER = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, SLIPS = 5, 3, 97
Q, EDITS, WEAK = 2, 1, 4


def slipped(run: Column, key: Column) -> Column:
    """A run with one letter left out, if the checksum of key and run says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIPS == 0, less).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the runs of letters, in lower case and with slips, of at least ``shortest`` letters and ``least``
    occurrences.  Shorter runs never make such a word, so the pattern passes over them."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    d = docs.select(F.col(f"`{key}`").alias("k"), F.explode(runs).alias("run"))
    d = d.select("k", F.translate("run", UPPER, LOWER).alias("run")).select(slipped(F.col("run"), F.col("k")).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= shortest) & (F.col("n") >= least))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often the words have each bigram."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(Q)))
    rows = words.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("c")).collect()
    return {r["g"]: r["c"] for r in rows}


def prefix(word: str, order: dict[str, int]) -> list[int]:
    """Places of the bigrams that rank up to the last of the Q * EDITS + 1 rarest."""
    ranks = [order[word[i:i + Q]] for i in range(len(word) - Q + 1)]
    last = sorted(ranks)[Q * EDITS]
    return [i for i, r in enumerate(ranks) if r <= last]


def pivots(places: list[int], cost: list[int], k: int = EDITS + 1) -> list[int]:
    """``k`` places at least Q apart of the least total cost: best[j] is the cheapest choice of j places so far, per last
    place; three places always hold two that do not overlap."""
    best: list[list[tuple[int, list[int]]]] = [[(0, [])]] + [[] for _ in range(k)]
    for p, c in zip(places, cost):
        for j in range(k, 0, -1):
            fits = [(t + c, [*at, p]) for t, at in best[j - 1] if not at or p - at[-1] >= Q]
            if fits:
                best[j].append(min(fits))
    return min(best[k])[1]


def pivot_keys(word: str, at: int) -> list[str]:
    """Keys of a word that is indexed by its pivot at ``at``."""
    n, keys = len(word), []
    if at + Q > WEAK:
        keys.append(f"<{word[:at + Q]}")
    else:
        half = at + Q + (n - at - Q) // 2
        keys += [f"<{n}<{word[:half]}", f"<{n}<{word[:at + Q]}>{word[half:]}"]
    if n - at > WEAK:
        keys.append(f">{word[at:]}")
    else:
        half = at // 2
        keys += [f">{n}>{word[half:]}", f">{n}>{word[:half]}<{word[at:]}"]
    return keys


def prefix_keys(word: str, at: int) -> list[str]:
    """Keys under which a word looks for those whose pivot is its bigram at ``at``, give or take an edit before or behind."""
    n, keys = len(word), []
    other = [m for m in (n - 1, n, n + 1) if m > Q]
    if at + Q > WEAK:
        keys.append(f"<{word[:at + Q]}")
    else:
        for m in other:
            rest = m - at - Q
            if rest >= 0:
                half = at + Q + rest // 2
                keys += [f"<{m}<{word[:half]}", f"<{m}<{word[:at + Q]}>{word[n - (m - half):]}"]
    if n - at > WEAK:
        keys.append(f">{word[at:]}")
    else:
        for m in other:
            place = at + m - n  # of the pivot in the other word
            if place >= 0:
                half = place // 2
                keys += [f">{m}>{word[n - (m - half):]}", f">{m}>{word[:half]}<{word[at:]}"]
    return keys


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b) with their counts (a_n, b_n) of words exactly one edit apart, each pair once, a < b."""
    counts = gram_counts(words)
    order = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def index(c):
        for word, n in zip(c["word"], c["n"]):
            places = prefix(word, order)
            own = pivots(places, [counts[word[i:i + Q]] for i in places])
            for key in dict.fromkeys(k for at in own for k in pivot_keys(word, at)):
                yield True, key, word, n
            for key in dict.fromkeys(k for at in places for k in prefix_keys(word, at)):
                yield False, key, word, n

    rows = materialize(map_rows(words, index, "pivot boolean, key string, word string, n long", 20_000), "grams")
    x, y = rows.where("pivot").alias("x"), rows.where("not pivot").alias("y")
    one = (F.abs(F.length("x.word") - F.length("y.word")) <= EDITS) & (F.col("x.word") != F.col("y.word"))
    alike = F.call_function("levenshtein", F.col("x.word"), F.col("y.word"), F.lit(EDITS)) == EDITS
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & one & alike)
    swap = F.col("x.word") < F.col("y.word")
    ab = [F.when(swap, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(a) for a, c in (("a", "word"), ("a_n", "n"))]
    ba = [F.when(swap, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(b) for b, c in (("b", "word"), ("b_n", "n"))]
    return met.select(*ab, *ba).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form), where form is not null, by pointer jumping: every round doubles the steps taken,
    and words that have arrived are set aside."""
    done, hops = None, materialize(forms.select("word", F.col("form").alias("to")), "hops")
    while True:
        step = hops.select(F.col("word").alias("via"), F.col("to").alias("next"))
        moved = materialize(hops.join(step, F.col("to") == F.col("via"), "left").select("word", F.coalesce("next", "to").alias("to"),
                                                                                       F.col("via").isNull().alias("end")), "hops")
        if not moved.where("not end").limit(1).count():
            return moved.select("word", F.col("to").alias("root"))
        hops = moved.select("word", "to")


def variants(words: DataFrame) -> DataFrame:
    """Every word of (word, n) with ``form`` (its most frequent near word, if at least twice as frequent), ``root``,
    ``n_near`` and ``form_n``."""
    words = materialize(words, "words")
    near = materialize(near_words(words), "near")
    both = near.select(F.col("a").alias("w"), F.col("a_n").alias("w_n"), F.col("b").alias("o"), F.col("b_n").alias("o_n")).union(
        near.select("b", "b_n", "a", "a_n"))
    best = both.groupBy("w", "w_n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("m"), "o")).alias("top"))
    fits = -F.col("top.m") >= 2 * F.col("w_n")
    best = materialize(best.select("w", "n_near", F.when(fits, F.col("top.o")).alias("form"), F.when(fits, -F.col("top.m")).alias("form_n")), "forms")
    up = roots(best.where("form is not null").select(F.col("w").alias("word"), "form")).withColumnRenamed("word", "v")
    out = words.join(best, F.col("word") == F.col("w"), "left").join(up, F.col("word") == F.col("v"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
