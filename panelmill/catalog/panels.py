"""Queries over cleaning, votes, metrics, task audit, merge and dump."""

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.catalog import fixtures as fx
from panelmill.catalog.base import query
from panelmill.functions.text import last_token, sample_hash
from panelmill.operators import audit, author_index, clean, metrics, panel, sample
from panelmill.plans import dump, tasks
from panelmill.session import work_dir
from panelmill.sources import tables

RES = "id, task_id, source_author, panel, create_time, field_content, match_content, source"
KEYS = ["task_id", "source"]
TRIMMED = f"{fx.named_rows()}, t AS (SELECT * REPLACE ({fx.TRIM} AS source_author) FROM named)"
COUNTS = f"{TRIMMED}, c AS (SELECT source, source_author, panel, count(*) AS n FROM t GROUP BY ALL)"


def counts(spark, sf):
    return clean.panel_counts(clean.trimmed(fx.named_df(spark, sf)), ["source"])


@query("panel_counts", f"WITH {COUNTS} SELECT source, source_author, panel, n FROM c")
def panel_counts(spark, sf):
    return counts(spark, sf)


@query("conflicted_authors", f"""WITH {COUNTS} SELECT source, source_author, count(*) AS panels FROM c
 GROUP BY 1, 2 HAVING count(*) > 1""")
def conflicted_authors(spark, sf):
    return clean.conflicted_authors(counts(spark, sf), ["source"])


VOTE = f"""WITH {COUNTS}, m AS (SELECT *, max(n) OVER (PARTITION BY source, source_author) AS mx FROM c)"""


@query("majority_vote", f"""{VOTE} SELECT source, source_author, max(n) AS n, max(panel) AS panel FROM m WHERE n = mx
 GROUP BY 1, 2 HAVING count(*) = 1""")
def majority_vote(spark, sf):
    return clean.majority_vote(counts(spark, sf), ["source"])


@query("majority_vote_first_dropped", f"""{VOTE} SELECT source, source_author, max(n) AS n, max(panel) AS panel
 FROM m WHERE n = mx GROUP BY 1, 2""")
def majority_vote_first_dropped(spark, sf):
    return clean.majority_vote(counts(spark, sf), ["source"], tie="first_dropped")


LATEST = f"""{TRIMMED}, l AS (SELECT *, row_number() OVER (PARTITION BY task_id, source, source_author, panel
 ORDER BY create_time DESC, id DESC) AS rn FROM t)"""


@query("latest_per_panel", f"WITH {LATEST} SELECT id, task_id, source, source_author, panel, create_time FROM l WHERE rn = 1")
def latest_per_panel(spark, sf):
    rows = clean.latest_per_panel(clean.trimmed(fx.named_df(spark, sf)), KEYS)
    return rows.select("id", *KEYS, "source_author", "panel", "create_time")


@query("vote_survivors_join", f"""{VOTE}, w AS (SELECT source, source_author, max(panel) AS panel FROM m WHERE n = mx
 GROUP BY 1, 2 HAVING count(*) = 1) SELECT t.id, source, source_author, panel FROM t JOIN w USING (source, source_author, panel)""")
def vote_survivors_join(spark, sf):
    rows = clean.trimmed(fx.named_df(spark, sf))
    votes = clean.majority_vote(clean.panel_counts(rows, ["source"]), ["source"])
    return clean.vote_survivors(rows, votes, ["source"]).select("id", "source", "source_author", "panel")


@query("run_cleaning", f"WITH {fx.named_rows()}, {fx.vote('cleaned', 'named', 'task_id, source')} SELECT {RES} FROM cleaned")
def run_cleaning(spark, sf):
    return clean.run_cleaning(fx.named_df(spark, sf).drop("slice"), KEYS)


@query("run_cleaning_first_dropped", f"""WITH {fx.named_rows()},
 {fx.vote('cleaned', 'named', 'task_id, source', 'first_dropped')} SELECT {RES} FROM cleaned""")
def run_cleaning_first_dropped(spark, sf):
    return clean.run_cleaning(fx.named_df(spark, sf).drop("slice"), KEYS, "first_dropped")


@query("two_stage_vote", f"WITH {fx.production()} SELECT {RES} FROM production")
def two_stage_vote(spark, sf):
    return fx.production_df(spark, sf)


@query("two_stage_vote_any_panel", f"WITH {fx.production()} SELECT {RES} FROM production")
def two_stage_vote_any_panel(spark, sf):
    """The same for panels that are not known beforehand."""
    return clean.two_stage_vote(fx.named_df(spark, sf), keys=KEYS)


@query("dedup_author_panel", f"""WITH {TRIMMED}, l AS (SELECT *, row_number() OVER (PARTITION BY source, source_author, panel
 ORDER BY task_id DESC, create_time, id) AS rn FROM t) SELECT id, task_id, source, source_author, panel FROM l WHERE rn = 1""")
def dedup_author_panel(spark, sf):
    order = [F.col("task_id").desc(), F.col("create_time"), F.col("id")]
    rows = clean.dedup_author_panel(fx.named_df(spark, sf), order, ["source"])
    return rows.select("id", "task_id", "source", "source_author", "panel")


# --- metrics -------------------------------------------------------------------------------

WHOLE = f"""{fx.routed()}, named AS (SELECT * REPLACE (concat('/', {fx.case('panel', fx.LABEL_NAMES, 'panel')}) AS panel)
 FROM routed WHERE panel <> ''), {fx.vote('res', 'named', 'source, slice')}, {fx.vote('prod', 'res', 'source')},
 au AS (SELECT source, count(DISTINCT {fx.TRIM}) AS uniq_authors, count(*) AS n_received FROM routed GROUP BY 1)"""
RATE = "round(CAST(100 AS DOUBLE) * {a} / {b}, 2)"


@query("rate_of_label", f"""WITH {WHOLE} SELECT source, panel, count(*) AS authors, any_value(uniq_authors) AS uniq_authors,
 {RATE.format(a='count(*)', b='any_value(uniq_authors)')} AS rate FROM prod JOIN au USING (source) GROUP BY 1, 2""")
def rate_of_label(spark, sf):
    """Flagship: scan, label, route, slice vote, task vote, distinct authors and rate in one plan."""
    spec = fx.spec()
    rows = tasks.labelled_posts(fx.posts(spark, sf), spec, fx.source_map(spark))
    return metrics.panel_rates(tasks.job_panels(rows, spec))


@query("task_metrics", f"""WITH {WHOLE} SELECT au.source, CAST(n_received AS BIGINT) AS n_received,
 (SELECT count(*) FROM res WHERE res.source = au.source) AS n_labelled, uniq_authors,
 (SELECT count(*) FROM prod WHERE prod.source = au.source) AS prod_rows,
 {RATE.format(a='(SELECT count(*) FROM prod WHERE prod.source = au.source)', b='uniq_authors')} AS rate,
 '2024-01-01 00:00:00 - 2024-01-31 00:00:00' AS date_range FROM au""")
def task_metrics(spark, sf):
    spec = fx.spec()
    rows = tasks.labelled_posts(fx.posts(spark, sf), spec, fx.source_map(spark))
    return tasks.job_metrics(rows, spec).drop("task_id").withColumn("date_range", F.lit(spec.date_range))


FIGURES = f"""au.source, CAST(n_received AS BIGINT) AS n_received, (SELECT count(*) FROM res WHERE res.source = au.source) AS n_labelled,
 uniq_authors, (SELECT count(*) FROM prod WHERE prod.source = au.source) AS prod_rows,
 {RATE.format(a='(SELECT count(*) FROM prod WHERE prod.source = au.source)', b='uniq_authors')} AS rate"""


def stored_job(spark, sf, **kw):
    """A job over posts that were written as files."""
    base = work_dir(spark, "job")
    fx.posts(spark, sf).write.option("compression", "zstd").parquet(f"{base}/site")
    return fx.spec(site={"format": "parquet", "path": f"{base}/site"}, output=f"{base}/out", **kw)


@query("run_task", f"""WITH {WHOLE} SELECT {FIGURES}, (SELECT count(*) FROM posts WHERE post_time >= TIMESTAMP '2024-01-01'
  AND post_time < TIMESTAMP '2024-01-31') AS received_total FROM au""")
def run_task(spark, sf):
    """Files in, tables and audit rows out; the figures, and the audit row's total over all sites."""
    spec = stored_job(spark, sf)
    out = tasks.run_task(spark, spec, fx.source_map(spark))
    total = audit.task_by_id(tasks.read_audit(spark, spec.output), spec.task_id).select(
        F.col("length_receive_table").cast("bigint").alias("received_total"))
    return out.join(F.broadcast(total))  # one row


OTHER_RULES = {"男性": [("eaux", "partially")]}


@query("run_task_rerun", f"""WITH {fx.named_rows(OTHER_RULES)}, {fx.vote('res', 'named', 'source, slice')}, {fx.vote('prod', 'res', 'source')}
 SELECT 'other rules' AS run, (SELECT count(*) FROM res) AS n_results, (SELECT count(*) FROM prod) AS n_production, 'finish' AS prod_stat
 UNION ALL SELECT 'no hits', 0, 0, 'no_data'""")
def run_task_rerun(spark, sf):
    """A task that is run again has the rows of its last run only, also where that has none."""
    spec, rows = stored_job(spark, sf), []
    tasks.run_task(spark, spec, fx.source_map(spark))
    for name, rules in (("other rules", OTHER_RULES), ("no hits", {"男性": [("no such text", "absolutely")]})):
        tasks.run_task(spark, replace(spec, rules=rules), fx.source_map(spark))
        n = [tables.read_results(spark, f"{spec.output}/{t}").count() for t in ("results", "production")]
        state = audit.task_by_id(tasks.read_audit(spark, spec.output), spec.task_id).first()
        rows.append((name, *n, state["prod_stat"]))
    return spark.createDataFrame(rows, "run string, n_results long, n_production long, prod_stat string")


@query("batch_resume", f"""WITH {fx.named_rows()}, {fx.vote('voted', 'named', 'source, slice')}
 SELECT id, 'task' AS task_id, source_author, panel, create_time, field_content, match_content, source FROM voted""")
def batch_resume(spark, sf):
    """A job in batches of 25 slices fails half-way and goes on from its check point: the rows are those of one whole run."""
    spec = stored_job(spark, sf, batch_slices=25)
    posts = spark.read.parquet(spec.site["path"])
    late = F.col("post_time") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    broken = posts.withColumn("content", F.when(late, F.raise_error(F.lit("site is gone")).cast("string")).otherwise(F.col("content")))
    try:
        tasks.run_task(spark, spec, fx.source_map(spark), broken)
    except Exception as e:
        if "site is gone" not in str(e):
            raise
    tasks.run_task(spark, spec, fx.source_map(spark), resume=True)
    return tables.read_results(spark, f"{spec.output}/results")


@query("uniq_authors", f"WITH {fx.routed()} SELECT source, count(DISTINCT {fx.TRIM}) AS uniq_authors FROM routed GROUP BY 1")
def uniq_authors(spark, sf):
    return metrics.uniq_authors(fx.routed_df(spark, sf))


RANGES = {"all": (fx.START, fx.END), "middle": (datetime(2024, 1, 9, 6), datetime(2024, 1, 17, 18)),
          "one slice": (datetime(2024, 1, 15), datetime(2024, 1, 15, 6))}


@query("uniq_authors_range", f"WITH {fx.routed()}, " + fx.values("ranges", "span, a, b", [(k, str(a), str(b)) for k, (a, b) in RANGES.items()])
       + f""" SELECT span, source, count(DISTINCT {fx.TRIM}) AS uniq_authors FROM routed JOIN ranges
 ON create_time >= CAST(a AS TIMESTAMP) AND create_time < CAST(b AS TIMESTAMP) GROUP BY 1, 2""")
def uniq_authors_range(spark, sf):
    """Three ranges from one stored index, to which the month was added in two parts that share some days."""
    folder, rows = work_dir(spark, "authors"), fx.routed_df(spark, sf)
    t = F.col("create_time")
    author_index.add_posts(rows.where(t < F.lit("2024-01-16").cast("timestamp_ntz")), folder, ts="create_time")
    author_index.add_posts(rows.where(t >= F.lit("2024-01-12").cast("timestamp_ntz")), folder, ts="create_time")
    spans = [author_index.authors_between(spark, folder, *r).select(F.lit(k).alias("span"), "*") for k, r in RANGES.items()]
    return reduce(DataFrame.unionByName, spans)


@query("uniq_authors_compat", f"""WITH {fx.routed(fx.AUTHOR_RULES, 'author')}, live AS (SELECT DISTINCT source, slice FROM routed WHERE panel <> '')
 SELECT source, count(DISTINCT source_author) AS uniq_authors FROM routed JOIN live USING (source, slice) GROUP BY 1""")
def uniq_authors_compat(spark, sf):
    return metrics.uniq_authors_compat(fx.routed_df(spark, sf, fx.AUTHOR_RULES, "author_name"))


@query("packed_metrics", f"""WITH {fx.routed()}, p AS (SELECT task_id, source, count(*) AS prod_rows,
  count(DISTINCT {fx.TRIM}) AS uniq_authors FROM routed GROUP BY 1, 2)
 SELECT task_id, string_agg(source, ',' ORDER BY source) AS result,
 string_agg(CAST(uniq_authors AS VARCHAR), ',' ORDER BY source) AS uniq_source_author,
 string_agg(CAST(prod_rows AS VARCHAR), ',' ORDER BY source) AS length_prod_table,
 string_agg(CAST({RATE.format(a='prod_rows', b='uniq_authors')} AS VARCHAR), ',' ORDER BY source) AS rate_of_label FROM p GROUP BY 1""")
def packed_metrics(spark, sf):
    m = (clean.trimmed(fx.routed_df(spark, sf)).groupBy("task_id", "source")
         .agg(F.count("*").alias("prod_rows"), F.count_distinct("source_author").alias("uniq_authors"))
         .withColumn("rate", metrics.rate(F.col("prod_rows"), F.col("uniq_authors"))))
    return metrics.packed_metrics(m).drop("sources")


@query("distinct_author_pairs", f"""WITH {fx.RAW_POSTS} SELECT count(*) AS n FROM (SELECT DISTINCT s_id, author FROM raw_posts
 WHERE author IS NOT NULL AND s_id IN ('WH_F0045', 'WH_F0001', 'WH_X0000') AND post_time >= TIMESTAMP '2024-01-01'
 AND post_time <= TIMESTAMP '2024-01-31')""")
def distinct_author_pairs(spark, sf):
    ids = ["WH_F0045", "WH_F0001", "WH_X0000"]
    return metrics.distinct_author_pairs(fx.raw_posts(spark, sf), ids, fx.START, fx.END)


@query("duplicate_audit", f"""WITH {fx.production()} SELECT {fx.TRIM} AS source_author, panel, count(*) AS c FROM production
 GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_audit(spark, sf):
    return metrics.duplicate_audit(fx.production_df(spark, sf))


@query("null_audit", f"""WITH {fx.RAW_POSTS} SELECT u.column_name, count(*) FILTER (u.missing) AS nulls FROM raw_posts p,
 (VALUES ('id'), ('s_id'), ('s_area_id'), ('author'), ('title'), ('content'), ('post_time')) AS c(column_name),
 LATERAL (SELECT c.column_name AS column_name, CASE c.column_name WHEN 'id' THEN p.id IS NULL WHEN 's_id' THEN p.s_id IS NULL
  WHEN 's_area_id' THEN p.s_area_id IS NULL WHEN 'author' THEN p.author IS NULL WHEN 'title' THEN p.title IS NULL
  WHEN 'content' THEN p.content IS NULL ELSE p.post_time IS NULL END AS missing) u GROUP BY 1""")
def null_audit(spark, sf):
    return metrics.null_audit(fx.raw_posts(spark, sf))


# --- task audit ----------------------------------------------------------------------------

STATE_COLS = "task_id, seq, stat, prod_stat, result, create_time, length_receive_table"


def state(spark, sf):
    return audit.latest_status(fx.audit_df(spark, sf))


@query("task_status_latest", f"WITH {fx.LATEST_STATE} SELECT {STATE_COLS} FROM state")
def task_status_latest(spark, sf):
    return state(spark, sf)


@query("recent_tasks", f"WITH {fx.LATEST_STATE} SELECT {STATE_COLS} FROM state ORDER BY create_time DESC, task_id LIMIT 5")
def recent_tasks(spark, sf):
    return audit.recent_tasks(state(spark, sf))


@query("task_by_id", f"""WITH {fx.LATEST_STATE} SELECT task_id, i - 1 AS pos, string_split(result, ',')[i] AS source
 FROM state, range(1, 10) r(i) WHERE task_id = md5('user 42') AND i <= len(string_split(result, ','))""".replace(
    "i - 1 AS pos", "CAST(i - 1 AS INTEGER) AS pos"))
def task_by_id(spark, sf):
    from hashlib import md5
    return audit.result_sources(audit.task_by_id(fx.audit_df(spark, sf), md5(b"user 42").hexdigest()))


@query("task_count", f"WITH {fx.LATEST_STATE} SELECT count(task_id) AS n_tasks FROM state")
def task_count(spark, sf):
    return audit.task_count(state(spark, sf))


@query("audit_append", f"""WITH {fx.AUDIT} SELECT stat, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT task_id) AS BIGINT) AS n_tasks,
 CAST(max(seq) AS BIGINT) AS last_seq, CAST(sum(length_receive_table) AS BIGINT) AS received FROM audit GROUP BY stat""")
def audit_append(spark, sf):
    """The log of all tasks, in two appends as jobs make them, read back."""
    output, log = work_dir(spark, "audit"), tasks.audit_frame(fx.audit_df(spark, sf))
    for turn in (0, 1):
        tasks.append_audit(log.where(F.col("seq") % 2 == turn), output)
    return tasks.read_audit(spark, output).groupBy("stat").agg(
        F.count("*").alias("n"), F.count_distinct("task_id").alias("n_tasks"), F.max("seq").alias("last_seq"),
        F.sum("length_receive_table").alias("received"))


@query("unfinished_tasks", f"""WITH {fx.LATEST_STATE} SELECT task_id, prod_stat FROM state
 WHERE prod_stat IS NULL OR prod_stat <> 'finish'""")
def unfinished_tasks(spark, sf):
    return audit.unfinished_tasks(state(spark, sf))


@query("tasks_by_ids", f"""WITH {fx.production()} SELECT id, task_id, source_author, panel FROM production
 WHERE task_id IN ('task_0', 'task_3')""")
def tasks_by_ids(spark, sf):
    from panelmill.sources.posts import tasks_by_ids as by_ids
    return by_ids(fx.production_df(spark, sf), ["task_0", "task_3"]).select("id", "task_id", "source_author", "panel")


T2G = f"""{fx.LATEST_STATE}, {fx.GROUPS}, s AS (SELECT task_id, result, unnest(string_split(result, ',')) AS source FROM state)"""


@query("tasks_to_groups", f"WITH {T2G} SELECT prod_group, task_id, source FROM s JOIN groups USING (source)")
def tasks_to_groups(spark, sf):
    return audit.tasks_to_groups(state(spark, sf), fx.groups(spark))


@query("tasks_to_groups_compat", f"""WITH {T2G} SELECT prod_group, task_id, s.source FROM s
 JOIN groups g ON g.source = split_part(s.result, ',', 1)""")
def tasks_to_groups_compat(spark, sf):
    return audit.tasks_to_groups(state(spark, sf), fx.groups(spark), first_source_only=True)


@query("tables_to_groups", f"""WITH {T2G}, n AS (SELECT DISTINCT concat('wh_panel_mapping_', source) AS name, source FROM s)
 SELECT prod_group, name FROM n JOIN groups USING (source)""")
def tables_to_groups(spark, sf):
    names = audit.result_sources(state(spark, sf)).select(
        F.concat(F.lit("wh_panel_mapping_"), "source").alias("name")).distinct()
    return audit.tables_to_groups(names, fx.groups(spark))


@query("last_name_token", f"""WITH {fx.POSTS} SELECT DISTINCT s_area_id, regexp_extract(s_area_id, '[^_]*$') AS last_part,
 regexp_replace(s_area_id, '_[^_]*$', '') AS rest FROM posts""")
def last_name_token(spark, sf):
    from panelmill.functions.text import drop_last_token
    return fx.posts(spark, sf).select("s_area_id", last_token("s_area_id").alias("last_part"),
                                      drop_last_token("s_area_id").alias("rest")).distinct()


# --- samples -------------------------------------------------------------------------------

HASH = "CAST(concat('0x', substr(md5(id), 1, 8)) AS BIGINT)"


@query("sample_result", f"""WITH {fx.results()}, s AS (SELECT *, {HASH} AS h FROM results WHERE task_id = 'task_1'),
 k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, id, source_author, panel) AS rn FROM s
  WHERE h <= CAST(floor(0.2 * 4294967296) AS BIGINT)) SELECT {RES} FROM k WHERE rn <= 50""")
def sample_result(spark, sf):
    return sample.sample_results(fx.results_df(spark, sf).drop("slice"), "task_1")


@query("stratified_sample", f"""WITH {fx.TRAINING}, s AS (SELECT *, {HASH} AS h FROM training),
 k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS rn FROM s WHERE TRUE)
 SELECT id, content, label, h FROM k WHERE rn <= 100""")
def stratified_sample(spark, sf):
    out = sample.stratified_sample(fx.training_df(spark, sf).select("id", "content", "label"), 100)
    return out.withColumn("h", sample_hash("id"))


# --- merge ---------------------------------------------------------------------------------

G2 = "('/male', '/female')"
MERGE_IN = f"""{fx.group_current()}, {fx.old_snapshot()}, o AS (SELECT * REPLACE ({fx.TRIM} AS source_author) FROM old),
 n AS (SELECT * REPLACE ({fx.TRIM} AS source_author) FROM new)"""
OC = f"(SELECT * FROM o WHERE panel IN {G2})"


def current(spark, sf, rules=fx.GENDER_RULES):
    prod = fx.stored_production(spark, sf, rules)
    return dump.group_current(prod, fx.weekly_state(prod), fx.groups(spark))


def both(spark, sf):
    return fx.old_df(spark, sf), current(spark, sf)


@query("group_current", f"WITH {fx.group_current()} SELECT prod_group, source_author, panel FROM new")
def group_current(spark, sf):
    return current(spark, sf)


@query("merge_old_overlap", f"""WITH {MERGE_IN} SELECT source_author, panel, create_time FROM {OC} x
 WHERE source_author IN (SELECT source_author FROM n)""")
def merge_old_overlap(spark, sf):
    return panel.snapshot_columns(panel.old_overlap(*both(spark, sf), "GENDER"))


@query("merge_old_only", f"""WITH {MERGE_IN} SELECT source_author, panel, create_time FROM {OC} x
 WHERE source_author NOT IN (SELECT source_author FROM n)""")
def merge_old_only(spark, sf):
    return panel.snapshot_columns(panel.old_only(*both(spark, sf), "GENDER"))


@query("merge_new_overlap", f"""WITH {MERGE_IN} SELECT source_author, panel FROM n
 WHERE source_author IN (SELECT source_author FROM {OC} x)""")
def merge_new_overlap(spark, sf):
    return panel.new_overlap(*both(spark, sf), "GENDER").select("source_author", "panel")


@query("merge_new_only", f"""WITH {MERGE_IN} SELECT source_author, panel FROM n
 WHERE source_author NOT IN (SELECT source_author FROM {OC} x)""")
def merge_new_only(spark, sf):
    return panel.new_only(*both(spark, sf), "GENDER").select("source_author", "panel")


@query("merge_conflicts", f"""WITH {MERGE_IN}, nd AS (SELECT DISTINCT source_author, panel FROM n WHERE panel IN {G2})
 SELECT x.source_author, x.panel AS panel_old, nd.panel AS panel_new, nd.panel AS panel,
 CASE WHEN x.panel <> nd.panel THEN TIMESTAMP '{fx.NOW}' ELSE x.create_time END AS create_time
 FROM {OC} x JOIN nd ON nd.source_author = x.source_author""")
def merge_conflicts(spark, sf):
    return panel.conflicts(*both(spark, sf), "GENDER", fx.NOW)


SNAP = "prod_group, source_author, panel, create_time"


@query("panel_merge", f"WITH {fx.group_current()}, {fx.old_snapshot()}, {fx.merge()} SELECT {SNAP} FROM merged")
def panel_merge(spark, sf):
    old, new = both(spark, sf)
    kept = old.join(new.select("prod_group").distinct(), "prod_group", "left_semi")
    return panel.merge_panels(kept, new, "GENDER", fx.NOW, keys=["prod_group"])


# Panels of the two jobs together, so that new rows outside the conflict group exist.
MIXED = f"""{fx.POSTS}, {fx.SOURCE_MAP}, {fx.GROUPS}, lab AS (
 SELECT s_id, author, {fx.sql_first_label(fx.GENDER_RULES, 'content')} AS label FROM posts
 UNION ALL SELECT s_id, author, {fx.sql_first_label(fx.AUTHOR_RULES, 'author')} FROM posts),
 new AS (SELECT prod_group, concat(s_id, '_', author) AS source_author, concat('/', {fx.case('label', fx.LABEL_NAMES, 'label')}) AS panel
 FROM lab JOIN source_map USING (s_id) JOIN groups USING (source) WHERE label <> '')"""


def mixed(spark, sf):
    from panelmill.operators import label as lab
    p = fx.posts(spark, sf)
    found = F.array(lab.first_label("keyword_model", fx.GENDER_RULES, "content"),
                    lab.first_label("keyword_model", fx.AUTHOR_RULES, "author"))
    rows = p.select("s_id", "author", F.explode(found).alias("panel")).where("panel <> ''")
    routed = lab.route_to_sources(rows, fx.source_map(spark)).join(F.broadcast(fx.groups(spark)), "source")
    return routed.select("prod_group", F.concat_ws("_", "s_id", "author").alias("source_author"),
                         lab.panel_name(F.col("panel")).alias("panel"))


@query("panel_merge_mixed", f"WITH {MIXED}, {fx.old_snapshot()}, {fx.merge()} SELECT {SNAP} FROM merged")
def panel_merge_mixed(spark, sf):
    return dump.dump_groups(mixed(spark, sf), fx.old_df(spark, sf), "GENDER", fx.NOW)


@query("panel_merge_compat", f"WITH {MIXED}, {fx.old_snapshot()}, {fx.merge(compat=True)} SELECT {SNAP} FROM merged")
def panel_merge_compat(spark, sf):
    """Any new panel of an author replaces the author's old conflict panels."""
    return dump.dump_groups(mixed(spark, sf), fx.old_df(spark, sf), "GENDER", fx.NOW, compat=True)


@query("panel_first_snapshot", f"""WITH {fx.group_current()} SELECT DISTINCT prod_group, {fx.TRIM} AS source_author, panel,
 TIMESTAMP '{fx.NOW}' AS create_time FROM new""")
def panel_first_snapshot(spark, sf):
    return panel.first_snapshot(current(spark, sf), fx.NOW, ["prod_group"])


@query("dump_group", f"WITH {fx.group_current()}, {fx.old_snapshot()}, {fx.merge()} SELECT {SNAP} FROM merged")
def dump_group(spark, sf):
    """Merged groups and first snapshots in one plan."""
    old, new = both(spark, sf)
    return dump.dump_groups(new, old, "GENDER", fx.NOW)


@query("dump_gender", f"WITH {fx.group_current()}, {fx.old_snapshot()}, {fx.merge()} SELECT {SNAP} FROM merged")
def dump_gender(spark, sf):
    prod = fx.stored_production(spark, sf)
    return dump.dump(prod, fx.weekly_state(prod), fx.groups(spark), fx.old_df(spark, sf), "GENDER", fx.NOW,
                     [f"task_{i}" for i in range(5)])


@query("dump_marriage", f"""WITH {fx.group_current(fx.MARRIAGE_RULES)}, {fx.old_snapshot('MARRIAGE')}, {fx.merge('MARRIAGE')}
 SELECT {SNAP} FROM merged""")
def dump_marriage(spark, sf):
    prod = fx.stored_production(spark, sf, fx.MARRIAGE_RULES)
    return dump.dump(prod, fx.weekly_state(prod), fx.groups(spark), fx.old_df(spark, sf, "MARRIAGE"), "MARRIAGE", fx.NOW)


CLASH = f"""pa AS (SELECT prod_group, source_author, panel, count(*) AS c FROM merged GROUP BY ALL),
 clash AS (SELECT prod_group, source_author, string_agg(panel, ',' ORDER BY panel) AS panels, count(*) AS n_panels
 FROM pa WHERE panel IN {G2} GROUP BY 1, 2 HAVING count(*) > 1)"""


@query("merge_checker", f"""WITH {fx.group_current()}, {fx.old_snapshot()}, {fx.merge()}, {CLASH}
 SELECT prod_group, source_author, 'GENDER' AS term, panels, n_panels FROM clash""")
def merge_checker(spark, sf):
    old, new = both(spark, sf)
    return panel.check_merge(dump.dump_groups(new, old, "GENDER", fx.NOW), ["prod_group"])[1]


@query("dump_group_checked", f"""WITH {fx.group_current()}, {fx.old_snapshot()}, {fx.merge()}, {CLASH}
 SELECT prod_group, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
 (SELECT count(*) FROM clash x WHERE x.prod_group = pa.prod_group) AS conflict_authors FROM pa GROUP BY 1""")
def dump_group_checked(spark, sf):
    old, new = both(spark, sf)
    return dump.dump_checked(new, old, "GENDER", fx.NOW)[1]


@query("last_production", f"""WITH {fx.production()}, {fx.GROUPS}, j AS (SELECT p.* REPLACE ({fx.TRIM} AS source_author), g.prod_group
 FROM production p JOIN groups g ON g.source = p.source), l AS (SELECT *, row_number() OVER (PARTITION BY prod_group, source,
 source_author, panel ORDER BY create_time DESC, id DESC) AS rn FROM j) SELECT {RES}, prod_group FROM l WHERE rn = 1""")
def last_production(spark, sf):
    return dump.last_production(fx.stored_production(spark, sf), fx.groups(spark))
