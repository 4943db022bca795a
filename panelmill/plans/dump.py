"""Dumps: new panels merged into the newest snapshot, per production group."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.text import trim_author
from panelmill.operators import audit, panel
from panelmill.operators.clean import AUTHOR, late_columns, with_late
from panelmill.session import materialize


def group_current(production: DataFrame, state: DataFrame, groups: DataFrame, task_ids: Sequence[str] | None = None,
                  first_source_only: bool = False) -> DataFrame:
    """(prod_group, source_author, panel): production rows of the given tasks (all if None) by group; every task that
    takes part must have finished."""
    where = audit.tasks_to_groups(audit.require_finished(state, task_ids), groups, first_source_only)
    return production.join(where, ["task_id", "source"]).select("prod_group", AUTHOR, "panel")


def dump_groups(current: DataFrame, old: DataFrame, term: str, now: datetime, compat: bool = False,
                names: Sequence[str] | None = None) -> DataFrame:
    """New snapshot of every group that has current rows: merged with its old snapshot, or started.

    All groups are one plan keyed by ``prod_group``; a group without old rows has nothing to match and
    so becomes a first snapshot by itself.  Groups without current rows keep their snapshot.
    """
    # The names of the groups (one short row each) as literals: they prune the partitions of the old snapshot, and
    # neither side is shuffled by group alone.
    if names is None:
        names = [r["prod_group"] for r in current.select("prod_group").distinct().collect()]
    return panel.merge_panels(old.where(F.col("prod_group").isin(sorted(names))), current, term, now,
                              keys=["prod_group"], compat=compat)


def dump(production: DataFrame, state: DataFrame, groups: DataFrame, old: DataFrame, term: str, now: datetime,
         task_ids: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """Gender or marriage dump (``term``) of the given tasks."""
    current = group_current(production, state, groups, task_ids, first_source_only=compat)
    return dump_groups(current, old, term, now, compat)


def dump_checked(current: DataFrame, old: DataFrame, term: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The dump, and per group its row count, surplus rows and authors with conflicting panels.

    The checks read the merged rows three times, so they are written first.
    """
    merged = materialize(dump_groups(current, old, term, now), "merged")
    surplus, clash = panel.check_merge(merged, ["prod_group"])
    rows = merged.groupBy("prod_group").agg(F.count("*").alias("n_rows"))
    conflicting = clash.groupBy("prod_group").agg(F.count_distinct(AUTHOR).alias("conflict_authors"))
    report = (rows.join(surplus, "prod_group").join(conflicting, "prod_group", "left")
                  .fillna(0, ["conflict_authors"]))
    return merged, report


def last_production(production: DataFrame, groups: DataFrame, task_id: str | None = None) -> DataFrame:
    """Rows of each production group: one per source table, author and panel, the latest kept."""
    df = production if task_id is None else production.where(F.col("task_id") == task_id)
    df = df.join(groups, "source").withColumn(AUTHOR, trim_author(AUTHOR))
    rest = [c for c in df.columns if c not in ("prod_group", "source", AUTHOR, "panel", "create_time", "id")]
    late = late_columns(rest)
    row = F.max(F.struct("create_time", "id", *[c for c in rest if c not in late])).alias("_r")
    narrow = materialize(df.drop(*late), "narrow") if late else df
    latest = (narrow.groupBy("prod_group", "source", AUTHOR, "panel").agg(row)
                .select("prod_group", "source", AUTHOR, "panel", "_r.*"))
    return (with_late(latest, df, late, narrow=narrow) if late else latest).select(*df.columns)
