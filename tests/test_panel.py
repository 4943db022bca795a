import glob
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelmill import schemas
from panelmill.operators import audit, metrics, panel
from panelmill.plans import dump
from panelmill.session import CLEANUP, materialize
from panelmill.sources import rules, tables

OLD, NOW = datetime(2023, 1, 1), datetime(2024, 2, 1)


def merged(spark, old, new, term="GENDER", compat=False):
    o = spark.createDataFrame([(a, p, OLD) for a, p in old], schemas.SNAPSHOT)
    n = spark.createDataFrame(new, "source_author string, panel string")
    out = panel.merge_panels(o, n, term, NOW, compat=compat)
    return sorted((r["source_author"], r["panel"], r["create_time"]) for r in out.collect())


@pytest.mark.parametrize("old, new, want", [
    ([("a", "/male")], [("a", "/female")], [("a", "/female", NOW)]),
    ([("a ", "/male")], [("a", "/male\t"[:5])], [("a", "/male", OLD)]),
    ([("a", "/male")], [], [("a", "/male", OLD)]),
    ([], [("a", "/male"), (" a", "/male")], [("a", "/male", NOW)]),
    ([("a", "/male")], [("a", "/young")], [("a", "/male", OLD), ("a", "/young", NOW)]),
    ([("a", "/young"), ("a", "/male")], [("a", "/female")], [("a", "/female", NOW), ("a", "/young", OLD)]),
    ([("a", "/young")], [("a", "/young")], [("a", "/young", OLD), ("a", "/young", NOW)]),
    ([("a", "/male")], [("a", "/male"), ("a", "/female")], [("a", "/female", NOW), ("a", "/male", OLD)]),
])
def test_merge(spark, old, new, want):
    assert merged(spark, old, new) == want


def test_merge_compat_and_term(spark):
    assert merged(spark, [("a", "/male")], [("a", "/young")], compat=True) == [("a", "/young", NOW)]
    assert merged(spark, [("a", "/married")], [("a", "/unmarried")], "MARRIAGE") == [("a", "/unmarried", NOW)]
    assert merged(spark, [("a", "/male")], [("a", "/female")], "MARRIAGE") == [("a", "/female", NOW), ("a", "/male", OLD)]
    with pytest.raises(ValueError, match="conflict term"):
        panel.conflict_panels("AGE")


def test_merge_parts_make_the_whole(spark):
    old = spark.createDataFrame([("a", "/male", OLD), ("b", "/female", OLD), ("c", "/young", OLD)], schemas.SNAPSHOT)
    new = spark.createDataFrame([("a", "/female"), ("d", "/male"), ("c", "/male")], "source_author string, panel string")
    whole = {(r[0], r[1]) for r in panel.merge_panels(old, new, "GENDER", NOW).select("source_author", "panel").collect()}
    parts = set()
    for df in (panel.old_only(old, new, "GENDER"), panel.new_only(old, new, "GENDER"),
               panel.conflicts(old, new, "GENDER", NOW), panel.split_conflicts(old, "GENDER")[1]):
        parts |= {(r[0], r[1]) for r in df.select("source_author", "panel").collect()}
    assert whole == parts


def test_merge_plan_is_one_join(spark):
    old = spark.createDataFrame([("a", "/male", OLD)], schemas.SNAPSHOT)
    new = spark.createDataFrame([("a", "/female")], "source_author string, panel string")
    plan = panel.merge_panels(old, new, "GENDER", NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Cartesian" not in plan


def test_null_time_becomes_now(spark):
    old = spark.createDataFrame([("a", "/young", None)], schemas.SNAPSHOT)
    new = spark.createDataFrame([("b", "/male")], "source_author string, panel string")
    assert panel.merge_panels(old, new, "GENDER", NOW).where("create_time is null").count() == 0


def test_first_snapshot(spark):
    new = spark.createDataFrame([("a ", "/male"), ("a", "/male"), ("b", "/young")], "source_author string, panel string")
    got = sorted(tuple(r) for r in panel.first_snapshot(new, NOW).collect())
    assert got == [("a", "/male", NOW), ("b", "/young", NOW)]


def test_checker(spark):
    rows = [("g", "a", "/male"), ("g", "a", "/male"), ("g", "a", "/female"), ("g", "b", "/young"), ("g", "b", "/married")]
    df = spark.createDataFrame(rows, "prod_group string, source_author string, panel string")
    surplus, clash = panel.check_merge(df, ["prod_group"])
    assert surplus.first()["duplicate_rows"] == 1
    assert [tuple(r) for r in clash.collect()] == [("g", "a", "GENDER", "/female,/male", 2)]


STATE = "task_id string, prod_stat string, result string"


def test_dump_needs_finished_tasks(spark):
    state = spark.createDataFrame([("t1", "finish", "Ptt"), ("t2", None, "forum")], STATE)
    assert audit.require_finished(state, ["t1"]).count() == 1
    with pytest.raises(audit.UnfinishedTask, match="t2"):
        audit.require_finished(state, ["t1", "t2"])
    with pytest.raises(audit.UnfinishedTask):
        audit.require_finished(state, None)
    with pytest.raises(audit.UnfinishedTask, match="t9"):
        audit.require_finished(state, ["t1", "t9"])


def test_groups_of_a_task_with_several_sources(spark):
    state = spark.createDataFrame([("t1", "finish", "fbfans,Ptt,video")], STATE)
    groups = rules.production_groups(spark)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(audit.tasks_to_groups(state, groups)) == [("bbs", "t1", "Ptt"), ("fb", "t1", "fbfans")]
    assert rows(audit.tasks_to_groups(state, groups, True)) == [("fb", "t1", s) for s in ("Ptt", "fbfans", "video")]


def test_dump_keeps_first_and_merged_groups_apart(spark):
    current = spark.createDataFrame([("fb", "a", "/female"), ("bbs", "a", "/female")], "prod_group string, source_author string, panel string")
    old = spark.createDataFrame([("fb", "a", "/male", OLD), ("news", "a", "/male", OLD)],
                                "prod_group string, source_author string, panel string, create_time timestamp_ntz")
    got = sorted((r["prod_group"], r["panel"]) for r in dump.dump_groups(current, old, "GENDER", NOW).collect())
    assert got == [("bbs", "/female"), ("fb", "/female")]


def test_packed_metrics(spark):
    m = spark.createDataFrame([("t", "fbfans", 10, 4, 40.0), ("t", "Ptt", 3, 1, 33.33)],
                              "task_id string, source string, uniq_authors long, prod_rows long, rate double")
    r = metrics.packed_metrics(m).first()
    assert (r["result"], r["uniq_source_author"], r["length_prod_table"], r["rate_of_label"]) == \
        ("Ptt,fbfans", "3,10", "1,4", "33.33,40.0")


def test_duplicate_audit_ignores_trailing_blanks(spark):
    df = spark.createDataFrame([("a", "/male"), ("a ", "/male"), ("b", "/male")], "source_author string, panel string")
    assert [tuple(r) for r in metrics.duplicate_audit(df).collect()] == [("a", "/male", 2)]


def test_null_audit(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "x string, y string")
    assert sorted(tuple(r) for r in metrics.null_audit(df).collect()) == [("x", 1), ("y", 2)]


def test_group_filter_reaches_the_scan(spark, tmp_path):
    from panelmill.sources import tables
    rows = spark.createDataFrame([("1", "t1", "a", "/male", OLD, "s", "m"), ("2", "t2", "b", "/male", OLD, "s", "m")],
                                 schemas.RESULT).withColumn("source", F.lit("Ptt"))
    tables.write_results(rows, str(tmp_path / "r"))
    df = tables.task_rows(tables.read_results(spark, str(tmp_path / "r")), "t1")
    assert [r["id"] for r in df.collect()] == ["1"]
    assert "PartitionFilters: [isnotnull(task_id" in df._jdf.queryExecution().executedPlan().toString()


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    """Neither results nor work tables leave what was shuffled for them."""
    files = lambda: {f for f in glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*.data")}
    rows = spark.createDataFrame([("i", "a", "p", datetime(2021, 1, 1), "f", "m", "t", "s")], "id string, source_author string, panel string, "
                                 "create_time timestamp_ntz, field_content string, match_content string, task_id string, source string")
    before = files()
    tables.write_results(rows, str(tmp_path / "r"))
    materialize(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and tables.read_results(spark, str(tmp_path / "r")).count() == 1
    assert spark.conf.get(CLEANUP) == "false"
