"""Relational TF-IDF: term counts, vocabulary and weights as DataFrames."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.text import char_tokens, target_name, word_tokens


def english_stop_words() -> list[str]:
    """Spark's English list, the default of all features below; ``()`` keeps every word."""
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(target: str = "content", stop_words: Sequence[str] | None = None) -> Column:
    """Token array of a text: words (or Han pieces); characters for author names."""
    name = target_name(target)
    if name == "author":
        return char_tokens(name)
    return _without(word_tokens(name), stop_words)


def _without(toks: Column, stop_words: Sequence[str] | None) -> Column:
    stop = english_stop_words() if stop_words is None else list(stop_words)
    if not stop:
        return toks
    return F.filter(toks, lambda t: ~t.isin(stop))


def term_counts(df: DataFrame, target: str = "content", stop_words: Sequence[str] | None = None) -> DataFrame:
    """(id, term, tf).  Counts are made on the task that holds the text, before the shuffle.  Stop words of texts are left
    out of the single terms, which is generated code, and not of the arrays."""
    single = target_name(target) != "author"
    stop = english_stop_words() if stop_words is None else list(stop_words)
    terms = df.select("id", F.explode(tokens(target, ())).alias("term"))
    if single and stop:
        terms = terms.where(~F.col("term").isin(stop))
    # The filter changes nothing, but keeps the plan equal to what a later join on term makes of it, so
    # that vocabulary and weights share one shuffle.
    return terms.where("term IS NOT NULL").groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, max_features: int, min_df: int) -> DataFrame:
    """(term, df, total): the most frequent terms that are in at least ``min_df`` texts; equal
    frequencies in alphabetical order."""
    return (counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
                  .where(F.col("df") >= min_df)
                  .orderBy(F.col("total").desc(), "term").limit(max_features))


def idf(df: Column, n_docs: int) -> Column:
    return F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + df)) + F.lit(1.0)


def tfidf(docs: DataFrame, target: str = "content", max_features: int = 5000, min_df: int = 2,
          stop_words: Sequence[str] | None = None) -> DataFrame:
    """(id, term, tf, tfidf) with unit length per text.

    The vocabulary has at most ``max_features`` rows and is broadcast for that reason.
    """
    n_docs = docs.count()
    counts = term_counts(docs, target, stop_words)
    vocab = vocabulary(counts, max_features, min_df).select("term", idf(F.col("df"), n_docs).alias("idf"))
    weighted = (counts.join(F.broadcast(vocab), "term")
                      .select("id", "term", "tf", (F.col("tf") * F.col("idf")).alias("w")))
    # The window is one text's terms.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weighted.select("id", "term", "tf", (F.col("w") / norm).alias("tfidf"))
