"""Merging a new panel into an earlier snapshot."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import CONFLICT_GROUPS
from panelmill.functions.slices import ntz
from panelmill.operators.clean import AUTHOR, dedup_author_panel, trimmed
from panelmill.schemas import SNAPSHOT_COLUMNS


def conflict_panels(term: str) -> list[str]:
    if term not in CONFLICT_GROUPS:
        raise ValueError(f"unknown conflict term {term!r}, expected one of {sorted(CONFLICT_GROUPS)}")
    return CONFLICT_GROUPS[term]


def in_conflict(term: str) -> Column:
    return F.col("panel").isin(conflict_panels(term))


def split_conflicts(df: DataFrame, term: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose panel belongs to the conflict group, and all others."""
    return df.where(in_conflict(term)), df.where(~in_conflict(term))


def _authors(df: DataFrame) -> DataFrame:
    return df.select(AUTHOR).distinct()


def old_overlap(old: DataFrame, new: DataFrame, term: str) -> DataFrame:
    """Old conflict rows whose author is in the new panel."""
    return trimmed(old).where(in_conflict(term)).join(_authors(trimmed(new)), AUTHOR, "left_semi")


def old_only(old: DataFrame, new: DataFrame, term: str) -> DataFrame:
    return trimmed(old).where(in_conflict(term)).join(_authors(trimmed(new)), AUTHOR, "left_anti")


def new_overlap(old: DataFrame, new: DataFrame, term: str) -> DataFrame:
    """New rows whose author has an old conflict row."""
    return trimmed(new).join(_authors(trimmed(old).where(in_conflict(term))), AUTHOR, "left_semi")


def new_only(old: DataFrame, new: DataFrame, term: str) -> DataFrame:
    return trimmed(new).join(_authors(trimmed(old).where(in_conflict(term))), AUTHOR, "left_anti")


def resolve(old_panel: Column, old_time: Column, new_panel: Column, now: Column) -> tuple[Column, Column]:
    """Panel and time of an author found on both sides: a changed panel is new as of now."""
    changed = old_panel != new_panel
    return F.when(changed, new_panel).otherwise(old_panel), F.when(changed, now).otherwise(old_time)


def conflicts(old: DataFrame, new: DataFrame, term: str, now: datetime) -> DataFrame:
    """Each old conflict row of an author with each of the author's new conflict panels, resolved."""
    o = trimmed(old).where(in_conflict(term)).select(AUTHOR, F.col("panel").alias("panel_old"), "create_time")
    n = (dedup_author_panel(new.where(in_conflict(term)).select(AUTHOR, "panel"))
         .select(AUTHOR, F.col("panel").alias("panel_new")))
    panel, time = resolve(F.col("panel_old"), F.col("create_time"), F.col("panel_new"), ntz(now))
    return o.join(n, AUTHOR).select(AUTHOR, "panel_old", "panel_new", panel.alias("panel"), time.alias("create_time"))


def merge_panels(old: DataFrame, new: DataFrame, term: str, now: datetime, keys: Sequence[str] = (),
                 compat: bool = False) -> DataFrame:
    """The merged snapshot, in one full outer join.

    Panels outside the conflict group pass through from both sides; conflict panels of one side only
    stay; on both sides the new panel wins.  Pass-through rows get a join tag that the other side
    never has, so each input is read and shuffled once.  ``compat``: any new panel of an author
    replaces the author's old conflict panels.
    """
    keys = list(keys)
    o = trimmed(old).select(*keys, AUTHOR, F.col("panel").alias("_po"), F.col("create_time").alias("_to"),
                            F.when(in_conflict(term), "both").otherwise("old").alias("_tag"))
    tag = F.lit("both") if compat else F.when(in_conflict(term), "both").otherwise("new")
    n = (dedup_author_panel(new.select(*keys, AUTHOR, "panel"), keys=keys)
         .select(*keys, AUTHOR, F.col("panel").alias("_pn"), tag.alias("_tag")))
    panel, time = resolve(F.col("_po"), F.col("_to"), F.col("_pn"), ntz(now))
    return (o.join(n, [*keys, AUTHOR, "_tag"], "full_outer")
             .select(*keys, AUTHOR,
                     F.when(F.col("_po").isNull(), F.col("_pn")).when(F.col("_pn").isNull(), F.col("_po"))
                     .otherwise(panel).alias("panel"),
                     F.when(F.col("_po").isNull(), ntz(now))
                     .when(F.col("_pn").isNull(), F.coalesce("_to", ntz(now)))
                     .otherwise(time).alias("create_time")))


def first_snapshot(new: DataFrame, now: datetime, keys: Sequence[str] = ()) -> DataFrame:
    """Snapshot of a group without an earlier one."""
    return (dedup_author_panel(new.select(*keys, AUTHOR, "panel"), keys=keys)
            .withColumn("create_time", ntz(now)))


def check_merge(merged: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Surplus (author, panel) rows per key, and authors with several panels of one conflict group."""
    keys = list(keys)
    per = merged.groupBy(*keys, AUTHOR, "panel").agg(F.count("*").alias("c"))
    surplus = per.groupBy(*keys).agg(F.sum(F.col("c") - 1).alias("duplicate_rows"))
    terms = F.create_map(*[F.lit(x) for t, ps in CONFLICT_GROUPS.items() for p in ps for x in (p, t)])
    clash = (per.withColumn("term", F.try_element_at(terms, F.col("panel"))).where("term IS NOT NULL")
                .groupBy(*keys, AUTHOR, "term")
                .agg(F.array_join(F.array_sort(F.collect_set("panel")), ",").alias("panels"),
                     F.count("*").alias("n_panels"))
                .where("n_panels > 1"))
    return surplus, clash


def snapshot_columns(df: DataFrame) -> DataFrame:
    return df.select(*SNAPSHOT_COLUMNS)
