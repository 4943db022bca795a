"""Quality rules as a ledger of bits: every rule is evaluated once per document, its measurements and a mask of
failed rules are kept, and policies (named sets of rules, by version) are applied to the masks alone.

Built-in functions only; one pass without a shuffle.  Per-document work is linear but for the sort of the three-word
windows of documents that repeat one.

Nulls and edge cases: a null or empty text has no words and fails ``too_few_words``; other columns may be null;
repeated rows are judged each for itself; an empty table gives an empty ledger; input columns that clash with a
measurement are not read and not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import SPACES, let, words



def _rules() -> dict[str, Column]:
    """Rule -> failure, from the measurements."""
    c = F.col
    return {
        "too_few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "digits": 100 * c("n_digits") > 50 * c("word_chars"),
    }


#: In the order of their bits; a new rule is appended.
RULE_NAMES = ["too_few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "digits"]
BASE = ("too_few_words", "repeated_words")
#: Versioned policies: the rules that reject a document.
POLICIES = {"v1": BASE, "v2": tuple(RULE_NAMES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words"]


def mask_of(rules) -> int:
    return sum(1 << RULE_NAMES.index(r) for r in rules)


def repeated_window_words(ws: Column) -> Column:
    """Words inside three-word windows that occur at least twice in ``ws``, the first occurrence included."""
    def covered(grams: Column) -> Column:
        order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            hits = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"]))
                            | ((k < last) & (F.get(s, k + 1)["g"] == x["g"])))
            at = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(at))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(order, twice))

    n = F.size(ws)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(grams, covered))


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The measurements of every document, computed once from its whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    of_words = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_window_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        *keys, of_words.alias("_w"), of_lines.alias("_l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"), without("0123456789").cast("long").alias("n_digits"),
    ).select(*keys, *[F.col(f"_w.{m}") if m in ("n_words", "n_repeat_words") else F.col(f"_l.{m}") if m in ("n_lines", "n_dup_lines")
                      else F.col(m) for m in MEASURES])


def ledger(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, the measurements and ``rule_bits``: bit i is set if rule i failed."""
    rules = _rules()
    bits = None
    for i, name in enumerate(RULE_NAMES):
        b = F.when(rules[name], F.lit(1 << i)).otherwise(F.lit(0))
        bits = b if bits is None else bits.bitwiseOR(b)
    return measure(docs, keys, text).withColumn("rule_bits", bits.cast("long"))


def passes(policy: str = "v2") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("rule_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def accepted(docs: DataFrame, text: str = "text", policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that pass a policy.  A filter on the mask would be pushed below the measurements and take
    them once for every rule, so rows are kept by exploding a list of none or one."""
    judged = ledger(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text")), ["_doc"], "_text")
    one = F.filter(F.array("rule_bits"), lambda b: b.bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)
    return judged.select("_doc", F.explode(one).alias("_bits")).select("_doc.*")


def ablation(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that pass once it is left out.

    The masks are counted first, so all later work is on at most one row per mask in use."""
    mask = mask_of(POLICIES[policy])
    counts = entries.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rows = []
    for name in POLICIES[policy]:
        bit = mask_of([name])
        rows.append(F.struct(
            F.lit(name).alias("rule"), F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(0).alias("failed"),
            F.when(F.col("bits") == bit, F.col("n")).otherwise(0).alias("failed_alone"),
            F.when(F.col("bits").bitwiseAND(F.lit(mask & ~bit)) == 0, F.col("n")).otherwise(0).alias("kept_without")))
    return (counts.select(F.inline(F.array(*rows))).groupBy("rule")
            .agg(*[F.sum(c).cast("long").alias(c) for c in ("failed", "failed_alone", "kept_without")]))
