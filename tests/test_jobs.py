import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill import schemas
from panelmill.catalog import fixtures as fx
from panelmill.operators import audit
from panelmill.plans import tasks
from panelmill.sources import posts as post_sources
from panelmill.sources import rules, tables
from panelmill.spec import JobSpec
from panelmill.streaming import labels as stream

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def spec(out, **kw):
    base = dict(task_id="t1", start=fx.START, end=fx.END, rules=fx.GENDER_RULES, target="content", output=out)
    return JobSpec(**{**base, **kw})


def test_spec_checks():
    with pytest.raises(ValueError, match="precede"):
        JobSpec("t", T0, T0)
    with pytest.raises(ValueError, match="model type"):
        JobSpec("t", T0, T0 + timedelta(1), model_type="magic")
    text = json.dumps({"MODEL_TYPE": "keyword_model", "PREDICT_TYPE": "author", "START_TIME": "2021-01-01T00:00:00",
                       "END_TIME": "2022-01-01T00:00:00", "PATTERN": {"男性": [["a", "start"]]}})
    s = JobSpec.from_json("t", text)
    assert s.rules == {"男性": [("a", "start")]} and s.end == datetime(2022, 1, 1)


def test_run_task_from_files(spark, tmp_path):
    """Whole job: files in, tables and audit out, a second run replaces the first."""
    fx.posts(spark, SF).write.parquet(str(tmp_path / "site"))
    s = spec(str(tmp_path / "out"), site={"format": "parquet", "path": str(tmp_path / "site")})
    first = sorted(tuple(r) for r in tasks.run_task(spark, s, fx.source_map(spark)).collect())
    again = sorted(tuple(r) for r in tasks.run_task(spark, s, fx.source_map(spark)).collect())
    assert first == again and len(first) == 4
    lazy = tasks.job_metrics(tasks.labelled_posts(fx.posts(spark, SF), s, fx.source_map(spark)), s)
    cols = ["source", "n_received", "uniq_authors", "n_labelled", "prod_rows", "rate"]
    assert sorted(tuple(r) for r in lazy.select(*cols).collect()) == first
    state = audit.latest_status(tasks.read_audit(spark, s.output)).collect()
    assert [(r["stat"], r["prod_stat"], r["result"]) for r in state] == [("SUCCESS", "finish", "Instagram,Ptt,fbfans,fbgroup")]
    prod = tables.read_results(spark, f"{s.output}/production")
    assert prod.count() == prod.select("source", "source_author").distinct().count()


def test_failed_task_is_recorded(spark, tmp_path):
    s = spec(str(tmp_path / "out"), model_type="rule_model", rules={"男性": ["(oops"]})
    with pytest.raises(Exception):
        tasks.run_task(spark, s, fx.source_map(spark), fx.posts(spark, SF))
    row, = audit.latest_status(tasks.read_audit(spark, s.output)).collect()
    assert row["stat"] == "FAILURE" and "oops" in row["error_message"] and row["check_point"] == fx.START


def test_forest_job_figures_and_compat_edge(spark, tmp_path):
    """A stored forest labels a job, whose figures come from its class names."""
    from panelmill.operators import forest
    rows = [(str(i), "s", "x", f"u{i % 7}", None, "aa bb cc " * 3 if i % 2 else "xx yy zz " * 3, T0 + timedelta(hours=i)) for i in range(30)]
    posts = spark.createDataFrame(rows, schemas.POST)
    examples = posts.select("id", "content", "content").toDF("id", "content", "x").withColumn("label", F.left("x", F.lit(2)))
    forest.save_model(forest.train_forest(examples, trees=3, max_features=20, min_df=1), str(tmp_path / "m"))
    s = spec(str(tmp_path / "out"), model_type="random_forest_model", rules={}, model_path=str(tmp_path / "m"), start=T0, end=T0 + timedelta(days=2))
    dim = spark.createDataFrame([("s", "Ptt")], schemas.SOURCE_MAP)
    out, = tasks.run_task(spark, s, dim, posts).collect()
    assert (out["n_received"], out["uniq_authors"]) == (30, 7) and out["n_labelled"] > 0
    model = tasks.load_rules(spark, s)
    lazy, = tasks.job_metrics(tasks.labelled_posts(posts, s, dim, rules=model), s, model).collect()
    assert [lazy[c] for c in ("n_labelled", "prod_rows", "rate")] == [out[c] for c in ("n_labelled", "prod_rows", "rate")]
    assert post_sources.slice_predicates(T0, T0 + timedelta(hours=7), closed=True)[-1].endswith("<= '2024-01-01 07:00:00'")


def test_unmapped_sites_count_as_received(spark, tmp_path):
    rows = [(str(i), site, "x", f"u{i}", None, "th", T0) for i, site in enumerate(["known", "other", "third"])]
    s = spec(str(tmp_path / "out"), start=T0, end=T0 + timedelta(days=1))
    tasks.run_task(spark, s, spark.createDataFrame([("known", "Ptt")], schemas.SOURCE_MAP), spark.createDataFrame(rows, schemas.POST))
    row, = audit.latest_status(tasks.read_audit(spark, s.output)).collect()
    assert (row["length_receive_table"], row["length_output_table"]) == (3, 1)
    with pytest.raises(ValueError, match="map"):
        tasks.run_task(spark, s)


def test_no_data_flag(spark, tmp_path):
    s = spec(str(tmp_path / "out"), rules={"男性": [("no such text", "absolutely")]})
    tasks.run_task(spark, s, fx.source_map(spark), fx.posts(spark, SF))
    row, = audit.latest_status(tasks.read_audit(spark, s.output)).collect()
    assert (row["stat"], row["prod_stat"]) == ("SUCCESS", "no_data")


def test_published_rates_of_the_fixture(spark):
    """Week of 2024-01-02 at sf0.01, with half-open slices from its start."""
    s = JobSpec("t", datetime(2024, 1, 2), datetime(2024, 1, 9), target="content", rules={
        "男性": [("th", "start"), ("eaux", "partially")], "女性": [("und", "partially")]})
    rows = tasks.labelled_posts(fx.posts(spark, "/root/testdata/sf0.01"), s, fx.source_map(spark))
    from panelmill.operators.metrics import panel_rates
    got = {(r["source"], r["panel"]): (r["authors"], r["uniq_authors"], r["rate"])
           for r in panel_rates(tasks.job_panels(rows, s)).collect()}
    assert got == {
        ("Instagram", "/female"): (43, 139, 30.94), ("Instagram", "/male"): (54, 139, 38.85),
        ("Ptt", "/female"): (52, 141, 36.88), ("Ptt", "/male"): (53, 141, 37.59),
        ("fbfans", "/female"): (52, 141, 36.88), ("fbfans", "/male"): (55, 141, 39.01),
        ("fbgroup", "/female"): (55, 143, 38.46), ("fbgroup", "/male"): (49, 143, 34.27)}


def test_flagship_plan(spark):
    """Hash aggregates only, no cross join, no Python, filters and columns pushed to the scans."""
    s = fx.spec()
    df = tasks.job_panels(tasks.labelled_posts(fx.posts(spark, SF), s, fx.source_map(spark)), s)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("Cartesian", "NestedLoop", "SortAggregate", "EvalPython", "Window"):
        assert bad not in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan
    assert "n_chars" not in plan and "props" not in plan


def test_sites_are_told_apart(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([("1", "s", "x", "u", None, name, T0)], schemas.POST).write.parquet(str(tmp_path / name))
    sites = {n: {"format": "parquet", "path": str(tmp_path / n)} for n in ("a", "b")}
    assert {(r["site"], r["content"]) for r in post_sources.read_sites(spark, sites).collect()} == {("a", "a"), ("b", "b")}


def test_rule_files(spark, tmp_path):
    for label, line in (("male", "bro\tpartially"), ("女", "sis \"x\"\tstart,end")):
        d = tmp_path / "rules" / label
        d.mkdir(parents=True)
        (d / "author_name.txt").write_text(line + "\n")
        (d / "content.txt").write_text("other\tend\n")
    got = {tuple(r) for r in rules.read_rule_dir(spark, str(tmp_path / "rules"), "author_name").collect()}
    assert got == {("male", "bro", "partially"), ("女", 'sis "x"', "start,end")}
    one = rules.read_keyword_file(spark, str(tmp_path / "rules" / "male" / "content.txt"), "male").collect()
    assert [tuple(r) for r in one] == [("male", "other", "end")]


def test_snapshot_versions_and_export(spark, tmp_path):
    rows = [("a ", '/x,"y"', T0, "fb"), ("two\nlines\r\n", "/male", T0, "fb"), ("b\\", "/male", T0 + timedelta(microseconds=5), "bbs")]
    df = spark.createDataFrame(rows, "source_author string, panel string, create_time timestamp_ntz, prod_group string")
    back = tables.import_snapshot(spark, tables.export_snapshot(df, str(tmp_path), "db", T0))
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == sorted(rows)
    path = str(tmp_path / "snap")
    tables.write_snapshot(df, path, "1")
    tables.write_snapshot(df.where("prod_group = 'fb'"), path, "2")
    assert {(r["prod_group"], r["version"]) for r in tables.read_snapshot(spark, path).collect()} == {("fb", "2"), ("bbs", "1")}


# --- streaming ------------------------------------------------------------------------------

def test_closed_slices_equal_the_batch(spark, tmp_path):
    """Append mode gives each slice once, when the watermark has passed it; in any session zone."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        closed_slices(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def closed_slices(spark, tmp_path):
    s = fx.spec()
    rows = tasks.labelled_posts(fx.posts(spark, SF), s, fx.source_map(spark))
    rows = rows.withColumn("panel", tasks.final_panel()).drop("slice")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    panels = tasks.panels_of(s)
    counts = stream.slice_counts(stream.event_time(src), panels, fx.START)
    q = stream.start_table(stream.vote_slices(counts, panels), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    closed = stream.closed_until(q, fx.START)
    assert closed is not None
    got = sorted((r["source"], r["slice_start"], r["source_author"], r["panel"] or "") for r in out.collect())
    batch = stream.slice_counts(rows.withColumn("event_time", stream.as_utc("create_time")), panels, fx.START)
    want = sorted((r["source"], r["slice_start"], r["source_author"], r["panel"] or "")
                  for r in stream.vote_slices(batch, panels).collect() if r["slice_start"] + timedelta(hours=6) <= closed)
    assert got == want and len(got) > 500


def test_stream_with_many_keywords(spark, tmp_path):
    many = {"男性": [(f"zz{i}", "partially") for i in range(150)] + [("th", "start")]}
    fx.posts(spark, SF).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(fx.posts(spark, SF).schema).parquet(str(tmp_path / "in"))
    s = fx.spec(many)
    rows = tasks.labelled_posts(src, s, fx.source_map(spark)).where("panel <> ''").drop("slice")
    stream.start_labels(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = fx.posts(spark, SF).where("lower(content) LIKE 'th%' AND s_id <> 'WH_X0000'").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_label_is_found_once_per_post(spark):
    """A matched-only pass must not repeat the rules in a filter below the projection."""
    many = fx.spec({"男性": [(f"zz{i}", "partially") for i in range(150)]})
    for s, mark in ((fx.spec(), "Contains("), (many, "regexp_extract_all(")):
        rows = tasks.labelled_posts(fx.posts(spark, SF), s, fx.source_map(spark), matched_only=True)
        plan = tasks.slice_results(rows, s)._jdf.queryExecution().optimizedPlan().toString()
        assert sum(mark in line for line in plan.splitlines()) == 1, plan


def test_stream_sinks_are_compressed(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from panelmill.streaming import labels as stream
    spark.createDataFrame([("a", "x" * 50)], "task_id string, match_content string").write.parquet(f"{tmp_path}/in")
    for name in ("one", "two"):
        rows = spark.readStream.schema("task_id string, match_content string").parquet(f"{tmp_path}/in").selectExpr("*", "'s' AS source")
        start = stream.start_labels if name == "one" else stream.start_table
        start(rows, f"{tmp_path}/{name}", f"{tmp_path}/c_{name}").awaitTermination()
        files = glob.glob(f"{tmp_path}/{name}/**/*.parquet", recursive=True)
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_stored_posts_are_compressed(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from panelmill.catalog import panels
    monkeypatch.setattr(panels.fx, "posts", lambda spark, sf: spark.createDataFrame([("1", "text " * 50)], "id string, content string"))
    files = glob.glob(f"{panels.stored_job(spark, '').site['path']}/*.parquet")
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}
