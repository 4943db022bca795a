"""Column expressions on text."""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGETS = {"content": "content", "author": "author", "author_name": "author",
           "s_area_id": "s_area_id", "title": "title"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


# All white space of Unicode, the last of it being U+3000.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def trim_author(c) -> Column:
    """Strip all white space (also Unicode blanks) at both ends; ``trim`` alone strips only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def target_name(target: str) -> str:
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}, expected one of {sorted(TARGETS)}")
    return TARGETS[target]


def target_text(target: str = "content", case_sensitive: bool = False) -> Column:
    c = F.col(target_name(target))
    return c if case_sensitive else F.lower(c)


def java_pattern(pattern: str) -> str:
    """A Python pattern for Spark's regex functions: Unicode classes, and only ``\\n`` ends a line."""
    p = re.sub(r"\(\?P<", "(?<", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    return "(?Ud)" + p


def java_pattern_of(c) -> Column:
    """The same for patterns that are a column."""
    named = F.regexp_replace(c, r"\(\?P<", "(?<")
    return F.concat(F.lit("(?Ud)"), F.regexp_replace(named, r"\(\?P=(\w+)\)", r"\\k<$1>"))


def count_substring(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    rest = F.replace(text, term, F.lit(""))
    return ((F.length(text) - F.length(rest)) / F.length(term)).cast("int")


def last_token(c, sep: str = "_") -> Column:
    return F.substring_index(c, sep, -1)


def drop_last_token(c, sep: str = "_") -> Column:
    return F.regexp_replace(c, f"{re.escape(sep)}[^{re.escape(sep)}]*$", "")


def dump_table_names(result, prefix: str) -> Column:
    """Table names of a comma list; the prefix is put on all of them unless the list has it."""
    c = F.col(result) if isinstance(result, str) else result
    names = F.split(c, ",")
    return F.when(F.contains(c, F.lit(prefix)), names).otherwise(
        F.transform(names, lambda n: F.concat(F.lit(prefix), n)))


def sample_hash(id_col) -> Column:
    """A number in [0, 2**32) that depends on the id alone, so that samples repeat on any engine."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def char_tokens(c) -> Column:
    """Characters of a text, without the empty string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def word_tokens(c) -> Column:
    """Lower-case words of two or more word characters; runs of Han characters give all their
    two- and three-character pieces instead, as no word boundary is written in them.

    A text without Han characters has no such runs and is only cut into words, by generated code."""
    text = F.lower(c)
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\w{2,})"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\p{IsHan}+|[\w&&[^\p{IsHan}]]{2,})"), F.lit(1))

    def grams(chars, k):
        n = F.size(chars)
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)),
                                          lambda i: F.array_join(F.slice(chars, i, F.lit(k)), "")))

    def pieces(run):
        han = let(char_tokens(run), lambda chars: F.concat(
            F.coalesce(grams(chars, 2), _no_strings()), F.coalesce(grams(chars, 3), _no_strings())))
        return F.when(run.rlike(r"^\p{IsHan}"), han).otherwise(F.array(run))

    return F.when(text.rlike(r"\p{IsHan}"), F.flatten(F.transform(runs, pieces))).otherwise(words)
