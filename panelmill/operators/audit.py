"""Task audit: an append-only log whose newest row per task is the task's state."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.constants import RECENT_TASKS


class UnfinishedTask(ValueError):
    """A task that is to be dumped has not finished."""


def latest_status(log: DataFrame) -> DataFrame:
    """Newest row of each task; reduced before the shuffle."""
    row = F.struct(*[c for c in log.columns if c != "task_id"])
    return (log.groupBy("task_id").agg(F.max_by(row, F.col("seq")).alias("_r"))
               .select("task_id", "_r.*").select(*log.columns))


def recent_tasks(state: DataFrame, n: int = RECENT_TASKS, order: str = "create_time") -> DataFrame:
    """The ``n`` newest tasks; equal times in id order."""
    return state.orderBy(F.col(order).desc(), F.col("task_id")).limit(n)


def task_by_id(log: DataFrame, task_id: str) -> DataFrame:
    """State of one task; the filter is applied before the log is reduced."""
    return latest_status(log.where(F.col("task_id") == task_id))


def task_count(state: DataFrame) -> DataFrame:
    return state.agg(F.count("task_id").alias("n_tasks"))


def result_sources(state: DataFrame, column: str = "result") -> DataFrame:
    """(task_id, pos, source): the comma list of a task's sources as rows."""
    return state.select("task_id", F.posexplode(F.split(column, ",")).alias("pos", "source"))


def unfinished_tasks(state: DataFrame) -> DataFrame:
    """Tasks that are not finished, unknown status included."""
    return state.where(~F.col("prod_stat").eqNullSafe("finish")).select("task_id", "prod_stat")


def require_finished(state: DataFrame, task_ids: Sequence[str] | None) -> DataFrame:
    """The named tasks (all of them if None), or an error naming one that is unfinished or unknown."""
    chosen = state if task_ids is None else state.where(F.col("task_id").isin(list(task_ids)))
    bad = unfinished_tasks(chosen).take(1)
    if bad:
        raise UnfinishedTask(f"task {bad[0]['task_id']} is unfinished")
    if task_ids is not None:
        known = {r["task_id"] for r in chosen.select("task_id").collect()}  # at most the ids asked for
        if unknown := sorted(set(task_ids) - known):
            raise UnfinishedTask(f"no such task: {', '.join(unknown)}")
    return chosen


def tasks_to_groups(state: DataFrame, groups: DataFrame, first_source_only: bool = False) -> DataFrame:
    """(prod_group, task_id, source): where the rows of each task go.

    ``first_source_only`` sends all sources of a task to the group of its first one.
    """
    s = result_sources(state)
    dim = groups          # one row per source: Spark sees its size and broadcasts it
    if not first_source_only:
        return s.join(dim, "source").select("prod_group", "task_id", "source")
    lead = F.element_at(F.split("result", ","), 1)
    home = state.select("task_id", lead.alias("source")).join(dim, "source").select("task_id", "prod_group")
    return s.join(home, "task_id").select("prod_group", "task_id", "source")


def tables_to_groups(tables: DataFrame, groups: DataFrame) -> DataFrame:
    """(prod_group, name): result tables by the source at the end of their names; an error if there is none."""
    from panelmill.functions.text import last_token
    named = tables.withColumn("source", last_token("name"))
    found = named.join(groups, "source").select("prod_group", "name")
    if found.isEmpty():
        raise ValueError("none of the tables belongs to a production group")
    return found
