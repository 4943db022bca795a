"""Conflicting panels of an author: vote, latest row, and both in two stages.

Every group is reduced by aggregates that Spark applies before the shuffle, so an author or source
with a third of all rows sends no more than one row per task and panel.
"""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill import schemas
from panelmill.constants import SLICE_HOURS
from panelmill.functions.slices import slice_index
from panelmill.functions.text import trim_author
from panelmill.session import marked_in, materialize, maybe_in

AUTHOR, TEXT = "source_author", "match_content"

#: Rows that are fetched into one place together (see ``with_late``): some 8 MB of texts of 2 KB.
CELL = 4096

#: Rows that bit tables tell from others (see ``_where_they_lie``): eight bits each in the largest table.
MOST = 2**23


def trimmed(df: DataFrame) -> DataFrame:
    return df.withColumn(AUTHOR, trim_author(AUTHOR))


def panel_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, AUTHOR, "panel").agg(F.count("*").alias("n"))


def conflicted_authors(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Authors with more than one panel."""
    return (counts.groupBy(*keys, AUTHOR).agg(F.count("*").alias("panels")).where("panels > 1"))


def _check_tie(tie: str) -> None:
    if tie not in ("drop", "first_dropped"):
        raise ValueError("tie must be 'drop' or 'first_dropped'")


def majority_vote(counts: DataFrame, keys: Sequence[str] = (), tie: str = "drop",
                  carry: Sequence[str] = ()) -> DataFrame:
    """The panel with the greatest ``n`` of each author, with the columns ``carry`` of its row.

    A shared greatest count drops the author (``tie='drop'``) or keeps the greatest of the tied panel
    names (``tie='first_dropped'``).  The greatest and the least name among the leading panels are the
    same exactly when the leader is unique, so no group is ever sorted or collected.
    """
    _check_tie(tie)
    top = F.max(F.struct("n", "panel", *carry)).alias("_top")
    aggs = [top]
    if tie == "drop":
        aggs.append(F.min(F.struct((-F.col("n")).alias("n"), "panel")).alias("_low"))
    voted = counts.groupBy(*keys, AUTHOR).agg(*aggs)
    if tie == "drop":
        voted = voted.where(F.col("_top.panel") == F.col("_low.panel"))
    return voted.select(*keys, AUTHOR, "_top.*")


def latest_per_panel(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest row per author and panel; of equal times the greatest id.  Spark keeps one row per group
    and task before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys, AUTHOR, "panel").orderBy(F.col("create_time").desc(), F.col("id").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def vote_survivors(rows: DataFrame, votes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose (author, panel) won the vote."""
    return rows.join(votes.select(*keys, AUTHOR, "panel"), [*keys, AUTHOR, "panel"])


def _row(columns: Sequence[str]) -> Column:
    return F.struct("create_time", "id", *[c for c in columns if c not in ("create_time", "id")])


def late_columns(rest: Sequence[str]) -> list[str]:
    """Those of the columns ``rest`` (in their order) that follow a vote instead of taking part: the matched text and what
    comes behind it."""
    rest = [c for c in rest if c not in ("create_time", "id")]
    return rest[rest.index(TEXT):] if TEXT in rest else []


def _where_they_lie(won: DataFrame, rows: DataFrame, late: Sequence[str], narrow: DataFrame, parts: Sequence[str]) -> DataFrame | None:
    """What ``with_late`` gives, without a shuffle of texts: each row finds out where it lies whether it is one of ``won``.

    A bit table of ``won`` lets some other rows pass by chance.  ``narrow`` tells which, so that a second table holds them, a
    third those of ``won`` that pass the second by chance, and so on until none is left; every table is a small part of the one
    before, by another hash.  A row is one of ``won`` if it is missed first in a table of others, or passes all and the last is of ``won``.
    Rows that occur more than once are fetched by a shuffle.  None if hashes of 64 bits do not tell the rows apart."""
    h = F.xxhash64(*won.columns)
    some = maybe_in(narrow.select(*won.columns), h, won, h, 32).withColumn("_won", F.lit(0))
    per = some.unionByName(won.withColumn("_won", F.lit(1))).groupBy(*won.columns).agg(
        F.sum("_won").alias("_won"), F.count_if(F.col("_won") == 0).alias("_n"))
    others = materialize(per.where("_won = 0 or _n > 1").withColumn("_h", h), "others")
    twice = others.where("_won > 0")
    repeat = not twice.isEmpty()
    by = lambda n: F.xxhash64(F.lit(n), F.col("_h"))
    inside, outside, tables = won.select(h.alias("_h")), others.select("_h"), []
    if repeat:
        inside = inside.join(twice.select("_h"), "_h", "left_anti")
    while not outside.isEmpty():
        if len(tables) > 12:
            return None
        tables.append(outside)
        inside = materialize(maybe_in(inside, by(len(tables)), outside, by(len(tables)), 32), "inside")
        if inside.isEmpty():
            break
        tables.append(inside)
        outside = materialize(maybe_in(outside, by(len(tables)), inside, by(len(tables)), 32), "outside")
    d = maybe_in(rows, h, won, h, 32).withColumn("_h", h)
    ours = F.lit(len(tables) % 2 == 0)
    for n, t in reversed(list(enumerate(tables, 1))):
        d = marked_in(d, f"_in{n}", by(n), t, by(n), 32)
        ours = F.when(F.col(f"_in{n}"), ours).otherwise(F.lit(n % 2 == 1))
    found = d.where(ours).select(*won.columns, *late)
    if repeat:
        found = found.unionByName(with_late(twice.select(*won.columns), rows, late, True, parts))
    return found


def with_late(won: DataFrame, rows: DataFrame, late: Sequence[str], few: bool = True, parts: Sequence[str] = (),
              narrow: DataFrame | None = None) -> DataFrame:
    """``won``, none of whose rows occurs twice, with the columns ``late`` of the rows it was chosen from: of those that are
    alike in all columns of ``won``, the greatest.

    ``won`` is written first, so that texts are shuffled once; if it is ``few`` of the rows, a bit table of it (at most 8 MB)
    keeps the others out.  Texts are aggregated behind their shuffle, as a sort before it would spill them.  Without a use
    of ``late`` Spark leaves the join out.  ``rows`` is computed twice and must give the same rows.

    With ``parts``, the partition columns of a table to be written (of ``won``), that one shuffle brings rows of equal parts
    together, in cells of some CELL rows, so that they can be written as they lie.

    With ``narrow``, the columns of ``won`` of all ``rows`` in a form that is cheap to read, texts are not shuffled at all, if a
    part has CELL rows or more on average: a task that reads texts then has rows enough of each part for a file."""
    won = materialize(won, "won")
    if narrow is not None:
        n = won.count()
        if CELL * (won.select(*parts).distinct().count() if parts else 1) <= n <= MOST:
            found = _where_they_lie(won, rows, late, narrow, parts)
            if found is not None:
                return found
    at = F.struct(*won.columns)  # nulls in a struct are equal
    if few:
        place = F.xxhash64(*won.columns)
        rows = maybe_in(rows, place, won, place, 32)
    # Of the type that it has in ``won``, whose columns may be null: a cast at the join would shuffle the texts again.
    kind = won.select(at.alias("_at")).schema["_at"].dataType
    texts = rows.select(at.cast(kind).alias("_at"), F.struct(*late).alias("_late"))
    if parts:
        # A join would need its own shuffle by all of its keys; groups are content with one by some.
        most = won.groupBy(*parts).count().agg(F.max("count")).first()[0] or 0
        cell = [F.col("_at")[c] for c in parts] + [F.pmod(F.xxhash64("_at"), F.lit(most // CELL + 1)).alias("_cell")]
        both = texts.withColumn("_won", F.lit(False)).unionByName(
            won.select(at.alias("_at"), F.lit(None).cast(texts.schema["_late"].dataType).alias("_late"), F.lit(True).alias("_won")))
        both = both.select("*", *[c.alias(f"_p{i}") for i, c in enumerate(cell)])
        by = [f"_p{i}" for i in range(len(cell))]
        return (both.repartition(*by).groupBy(*by, "_at").agg(F.max("_late").alias("_late"), F.max("_won").alias("_won"))
                    .where("_won").select("_at.*", "_late.*"))
    texts = texts.repartition("_at").groupBy("_at").agg(F.max("_late").alias("_late"))
    return (won.withColumn("_at", at).join(texts.select("_at", "_late.*"), "_at", "left")
               .select(*won.columns, *late))


def _voted(df: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, AUTHOR, "panel")]
    per_panel = df.groupBy(*keys, AUTHOR, "panel").agg(F.count("*").alias("n"), F.max(_row(rest)).alias("_row"))
    return (majority_vote(per_panel, keys, tie, carry=["_row"])
            .select(*keys, AUTHOR, "panel", "_row.*").select(*df.columns))


def run_cleaning(df: DataFrame, keys: Sequence[str] = (), tie: str = "drop", few: bool = False,
                 parts: Sequence[str] = ()) -> DataFrame:
    """Trim authors, vote, and keep the winning panel's latest row.  ``keys`` separate independent votes.

    Rows are counted per author and panel, then panels are compared, whatever their names and number are; both aggregations
    are combined before their shuffle, and the second only sees one row per author and panel.  The matched texts are
    fetched for the rows that are left (``few`` of all or not, and where ``parts`` are to be written together: see ``with_late``)."""
    _check_tie(tie)
    df = trimmed(df)
    late = late_columns([c for c in df.columns if c not in (*keys, AUTHOR, "panel")])
    if not late:
        return _voted(df, keys, tie)
    narrow = materialize(df.drop(*late), "narrow") if few and parts else None
    won = _voted(df.drop(*late) if narrow is None else narrow, keys, tie)
    return with_late(won, df, late, few, parts, narrow).select(*df.columns)


def label_winner(counts: Sequence[Column], tie: str = "drop") -> Column:
    """Index of the greatest count in columns ordered by panel name; null if all are zero, or if
    ``tie='drop'`` and the greatest count is shared."""
    _check_tie(tie)
    if not counts:
        return F.lit(None).cast("int")
    a = F.array(*counts)
    top = F.array_max(a)
    first = F.array_position(a, top)
    last = F.size(a) + 1 - F.array_position(F.reverse(a), top)
    ok = (top > 0) & (first == last) if tie == "drop" else top > 0
    return F.when(ok, (last - 1).cast("int"))


def _sliced(results: DataFrame, start: datetime | None, hours: int) -> DataFrame:
    if "slice" in results.columns:
        return results
    return results.withColumn("slice", slice_index("create_time", start, hours))


def slice_votes(results: DataFrame, start: datetime | None = None, keys: Sequence[str] = ("source",),
                hours: int = SLICE_HOURS, tie: str = "drop", parts: Sequence[str] = ()) -> DataFrame:
    """First stage: cleaning per time slice.  ``results`` has ``slice``, or gets it from ``start``."""
    return run_cleaning(_sliced(results, start, hours), [*keys, "slice"], tie, parts=parts)


def _task_columns(keys: Sequence[str]) -> list[str]:
    return [*keys, *[c for c in schemas.RESULT_COLUMNS if c not in keys]]


def task_votes(sliced: DataFrame, keys: Sequence[str] = ("source",), tie: str = "drop", parts: Sequence[str] = ()) -> DataFrame:
    """Second stage: cleaning over the task, where each slice an author's panel won counts once."""
    return run_cleaning(sliced.select(*_task_columns(keys)), keys, tie, few=True, parts=parts)


def two_stage_vote(results: DataFrame, start: datetime | None = None, keys: Sequence[str] = ("source",),
                   hours: int = SLICE_HOURS, tie: str = "drop", parts: Sequence[str] = ()) -> DataFrame:
    """Both stages; texts are fetched once, for the rows that the second one leaves.  A row's slice is that of its time."""
    _check_tie(tie)
    rows = trimmed(_sliced(results, start, hours)).select(*_task_columns(keys), "slice")
    late = late_columns([c for c in _task_columns(keys) if c not in (*keys, AUTHOR, "panel")])
    narrow = materialize(rows.drop(*late), "narrow") if parts else None
    slices = _voted(rows.drop(*late) if narrow is None else narrow, [*keys, "slice"], tie)
    won = _voted(slices.drop("slice"), keys, tie)
    return with_late(won, rows, late, parts=parts, narrow=narrow).select(*_task_columns(keys))


def dedup_author_panel(df: DataFrame, order: Sequence[Column] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per trimmed author and panel: the last in ``order``, or any if only the key is kept."""
    df = trimmed(df)
    if order is None:
        return df.dropDuplicates([*keys, AUTHOR, "panel"])
    w = Window.partitionBy(*keys, AUTHOR, "panel").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
