"""Queries over sources and sinks.  A sink is written below the work folder and read back."""

from pyspark.sql import functions as F

from panelmill import constants
from panelmill.catalog import fixtures as fx
from panelmill.catalog.base import query
from panelmill.functions import slices
from panelmill.operators import forest
from panelmill.operators.clean import task_votes
from panelmill.session import materialize, work_dir
from panelmill.sources import posts, rules, tables

RANGE = "post_time >= TIMESTAMP '2024-01-01' AND post_time <= TIMESTAMP '2024-01-31'"
POST_OUT = "id, s_id, author, title, post_time, length(content) AS n_chars"


def post_out(df):
    return df.select("id", "s_id", "author", "title", "post_time", F.length("content").cast("bigint").alias("n_chars"))


@query("post_scan", f"""WITH {fx.RAW_POSTS} SELECT {POST_OUT} FROM raw_posts
 WHERE author IS NOT NULL AND s_id IS NOT NULL AND title IS NOT NULL AND {RANGE}""")
def post_scan(spark, sf):
    return post_out(posts.scan_posts(fx.raw_posts(spark, sf), "title", fx.START, fx.END))


@query("post_scan_all", f"WITH {fx.RAW_POSTS} SELECT {POST_OUT} FROM raw_posts WHERE title IS NOT NULL")
def post_scan_all(spark, sf):
    return post_out(posts.scan_posts_all(fx.raw_posts(spark, sf), "title"))


HOURLY = fx.POSTS + ", h AS (SELECT id, date_trunc('hour', post_time) AS post_time FROM posts)"


@query("sliced_scan", f"""WITH {HOURLY} SELECT id, post_time, {fx.SLICE} AS slice FROM h
 WHERE post_time >= TIMESTAMP '2024-01-01' AND post_time < TIMESTAMP '2024-01-31'""")
def sliced_scan(spark, sf):
    h = fx.posts(spark, sf).select("id", F.date_trunc("hour", "post_time").cast("timestamp_ntz").alias("post_time"))
    return slices.with_slices(h, fx.START, fx.END)


# 13 hours short of the month: the last slice is one hour long and not read.
@query("sliced_scan_compat", f"""WITH {HOURLY}, b AS (
 SELECT i AS slice, TIMESTAMP '2024-01-01' + to_hours(CAST(6 * i AS INTEGER)) AS a FROM range(118) r(i))
 SELECT h.id, h.post_time, b.slice FROM h JOIN b ON h.post_time >= b.a AND h.post_time <= b.a + INTERVAL 6 HOUR""")
def sliced_scan_compat(spark, sf):
    from datetime import timedelta
    h = fx.posts(spark, sf).select("id", F.date_trunc("hour", "post_time").cast("timestamp_ntz").alias("post_time"))
    return slices.with_slices_compat(h, fx.START, fx.END - timedelta(hours=11))


@query("multi_site_union", f"""WITH {fx.POSTS} SELECT split_part(s_area_id, '_', 1) AS site, count(*) AS n_posts,
 count(DISTINCT author) AS authors, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM posts GROUP BY 1""")
def multi_site_union(spark, sf):
    root = work_dir(spark, "sites")
    fx.posts(spark, sf).withColumn("db", F.substring_index("s_area_id", "_", 1)).write.partitionBy("db").parquet(root)
    names = ["view", "click", "purchase", "signup", "error"]
    df = posts.read_sites(spark, {n: {"format": "parquet", "path": f"{root}/db={n}"} for n in names})
    return df.groupBy("site").agg(F.count("*").alias("n_posts"), F.count_distinct("author").alias("authors"),
                                  F.sum(F.length("content")).alias("n_chars"))


@query("posts_from_predictions", f"""WITH {fx.POSTS}, r AS (SELECT id, concat(s_id, '_', author) AS source_author,
  content AS applied_content, post_time AS created_at,
  CASE WHEN s_area_id LIKE 'view%' THEN 'content' ELSE 'author' END AS applied_feature FROM posts)
 SELECT id, substr(source_author, 1, 8) AS s_area_id, substr(source_author, 10) AS author, '' AS title,
  applied_content AS content, created_at AS post_time FROM r WHERE applied_feature = 'author'""")
def posts_from_predictions(spark, sf):
    r = fx.posts(spark, sf).select(
        "id", F.concat_ws("_", "s_id", "author").alias("source_author"), F.col("content").alias("applied_content"),
        F.col("post_time").alias("created_at"),
        F.when(F.col("s_area_id").startswith("view"), "content").otherwise("author").alias("applied_feature"))
    return posts.posts_from_predictions(r)


# --- rules ---------------------------------------------------------------------------------

@query("rules_from_tsv", f"""WITH {fx.RULE_TABLE}
 SELECT '男性' AS label, content AS keyword, match_type FROM rule_table""")
def rules_from_tsv(spark, sf):
    path = work_dir(spark, "rules")
    fx.rule_table_df(spark, sf).select("content", "match_type").write.csv(path, sep="\t")
    return rules.read_keyword_file(spark, path, "男性")


@query("rules_from_dir", f"""WITH {fx.RULE_TABLE} SELECT CASE labeling_job_id WHEN 1 THEN 'male' WHEN 2 THEN 'female'
  WHEN 3 THEN 'young' ELSE '學生' END AS label, content AS keyword, match_type FROM rule_table""")
def rules_from_dir(spark, sf):
    root = work_dir(spark, "ruledir")
    t = fx.rule_table_df(spark, sf)
    for job, label in ((1, "male"), (2, "female"), (3, "young"), (4, "學生")):
        (t.where(F.col("labeling_job_id") == job).select(F.concat_ws("\t", "content", "match_type"))
          .write.text(f"{root}/{label}/content.txt"))
    return rules.read_rule_dir(spark, root, "content")


@query("rules_from_table", f"""WITH {fx.RULE_TABLE} SELECT '女性' AS label, count(*) AS n_rules,
 string_agg(concat(content, '/', match_type), ' ' ORDER BY content, match_type) AS rules
 FROM rule_table WHERE labeling_job_id = 2""")
def rules_from_table(spark, sf):
    lists = rules.rule_lists(rules.rules_of_job(fx.rule_table_df(spark, sf), 2, "女性"))
    return lists.select("label", F.size("rules").cast("bigint").alias("n_rules"), F.array_join(
        F.transform("rules", lambda r: F.concat_ws("/", r["keyword"], r["match_type"])), " ").alias("rules"))


@query("rules_merge", f"""WITH {fx.RULE_TABLE}, r AS (SELECT CASE labeling_job_id WHEN 1 THEN 'a' WHEN 2 THEN 'b'
   WHEN 3 THEN 'b' ELSE 'c' END AS label, labeling_job_id, content AS keyword, match_type FROM rule_table)
 SELECT label, keyword, match_type FROM r WHERE labeling_job_id <> 2""")
def rules_merge(spark, sf):
    t = fx.rule_table_df(spark, sf)
    job = {i: rules.rules_of_job(t, i, name) for i, name in ((1, "a"), (2, "b"), (3, "b"), (4, "c"))}
    first = rules.merge_rules(rules.merge_rules(job[1], job[2]), job[3])
    return rules.merge_rules(first, job[4])


@query("source_map_csv", """SELECT concat('WH_N', doc_id) AS s_id, max(source) AS source FROM documents GROUP BY 1""")
def source_map_csv(spark, sf):
    path = work_dir(spark, "sourcemap")
    (fx.table(spark, sf, "documents")
       .select(F.concat(F.lit("WH_N"), F.col("doc_id").cast("string")).alias("source_id"), F.col("source").alias("table"))
       .write.csv(path, header=True))
    return rules.read_source_map(spark, path)


@query("training_load", f"""WITH {fx.TRAINING} SELECT content, label FROM training WHERE label IN ('good')""")
def training_load(spark, sf):
    """Texts with line breaks, as they are."""
    path = work_dir(spark, "training")
    (fx.training_df(spark, sf).select("content", "label")
       .write.csv(path, sep="\t", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return rules.read_training(spark, path, ["good"])


# --- result and production tables ----------------------------------------------------------

RES = "id, task_id, source_author, panel, create_time, field_content, match_content, source"


def written_results(spark, sf):
    path = work_dir(spark, "results")
    tables.write_results(fx.results_df(spark, sf, parts=tables.PARTS).drop("slice"), path, placed=True)
    return tables.read_results(spark, path)


@query("task_rows", f"WITH {fx.results()} SELECT {RES} FROM results WHERE task_id = 'task_1' AND source = 'Ptt'")
def task_rows(spark, sf):
    return tables.task_rows(written_results(spark, sf), "task_1", "Ptt")


@query("result_sink", f"WITH {fx.results()} SELECT {RES} FROM results")
def result_sink(spark, sf):
    """Task 2 is run twice more; its first rerun found all rows under another source, which the second one replaces."""
    path = work_dir(spark, "results")
    rows = fx.results_df(spark, sf, parts=tables.PARTS).drop("slice")
    tables.write_results(rows, path, placed=True)
    again = materialize(rows.where(F.col("task_id") == "task_2"), "again")
    tables.write_task(again.withColumn("source", F.lit("stale")), path, "task_2")
    tables.write_task(again, path, "task_2")
    return tables.read_results(spark, path)




@query("production_sink", f"WITH {fx.production()} SELECT {RES} FROM production WHERE task_id = 'task_1'")
def production_sink(spark, sf):
    rows = tables.task_rows(written_results(spark, sf), "task_1")
    path = work_dir(spark, "production")
    tables.write_production(task_votes(rows, ["task_id", "source"], parts=tables.PARTS), path, placed=True)
    return tables.read_results(spark, path)


@query("production_all_sources", f"""WITH {fx.production()}
 SELECT concat('wh_panel_mapping_', source) AS table_name, {RES} FROM production""")
def production_all_sources(spark, sf):
    """All tasks and source tables in one job, without labels known beforehand."""
    path = work_dir(spark, "production")
    tables.write_production(task_votes(written_results(spark, sf), ["task_id", "source"], parts=tables.PARTS), path, placed=True)
    return tables.read_results(spark, path).withColumn(
        "table_name", F.concat(F.lit(constants.TABLE_PREFIX), "source"))


# --- snapshots -----------------------------------------------------------------------------

@query("panel_old", f"WITH {fx.old_snapshot()} SELECT source_author, panel, create_time FROM old")
def panel_old(spark, sf):
    return tables.panel_rows(fx.old_df(spark, sf))


@query("panel_current", f"""WITH {fx.production()} SELECT source_author, panel, create_time FROM production
 WHERE task_id = 'task_2'""")
def panel_current(spark, sf):
    return tables.panel_rows(tables.task_rows(fx.production_df(spark, sf), "task_2"))


NAMES = """names AS (SELECT DISTINCT concat(CASE WHEN n_chars % 5 = 0 THEN 'tmp_' ELSE 'wh_panel_mapping_' END, source, '_',
  CASE lang WHEN 'en' THEN 'fb' WHEN 'de' THEN 'forum' WHEN 'fr' THEN 'bbs' ELSE 'misc' END) AS name FROM documents)"""


@query("snapshot_pick", f"""WITH {NAMES} SELECT name FROM names WHERE starts_with(name, 'wh_panel_mapping_')
 AND regexp_matches(name, '({"|".join(constants.PRODUCTION_GROUPS)})$')""")
def snapshot_pick(spark, sf):
    lang = F.col("lang")
    names = fx.table(spark, sf, "documents").select(F.concat(
        F.when(F.col("n_chars") % 5 == 0, "tmp_").otherwise("wh_panel_mapping_"), "source", F.lit("_"),
        F.when(lang == "en", "fb").when(lang == "de", "forum").when(lang == "fr", "bbs").otherwise("misc"))
        .alias("name")).distinct()
    return tables.pick_snapshots(names, constants.TABLE_PREFIX, list(constants.PRODUCTION_GROUPS))


@query("snapshot_sink", f"""WITH {fx.old_snapshot()}
 SELECT source_author, panel, create_time, prod_group, '2023' AS version FROM old""")
def snapshot_sink(spark, sf):
    path = work_dir(spark, "snapshot")
    tables.write_snapshot(fx.old_df(spark, sf), path, "2023")
    return tables.read_snapshot(spark, path, "2023")


@query("snapshot_replace", f"""WITH {fx.old_snapshot()} SELECT source_author,
  CASE prod_group WHEN 'fb' THEN concat(panel, '_new') ELSE panel END AS panel, create_time, prod_group,
  CASE prod_group WHEN 'fb' THEN '2024' ELSE '2023' END AS version FROM old""")
def snapshot_replace(spark, sf):
    """A new version of one group is derived from the table itself; the other group keeps its own."""
    path = work_dir(spark, "snapshot")
    tables.write_snapshot(fx.old_df(spark, sf), path, "2023")
    now = tables.read_snapshot(spark, path).where("prod_group = 'fb'").drop("version")
    tables.write_snapshot(now.withColumn("panel", F.concat("panel", F.lit("_new"))), path, "2024")
    return tables.read_snapshot(spark, path)


ODD = r"""SELECT prod_group, concat(source_author, chr(10), '"', prod_group, ', ') AS source_author, panel, create_time FROM old"""


def odd_names(spark, sf):
    """Authors with line breaks, quotes and blanks at the end."""
    return fx.old_df(spark, sf).withColumn("source_author", F.concat("source_author", F.lit('\n"'), "prod_group", F.lit(", ")))


@query("export_snapshot", f"""WITH {fx.old_snapshot()} SELECT prod_group, count(*) AS n_rows FROM old GROUP BY 1""")
def export_snapshot(spark, sf):
    """Rows of the exported files of each group."""
    path = tables.export_snapshot(odd_names(spark, sf), work_dir(spark, "export"), "site", fx.NOW)
    return spark.read.parquet(path).groupBy(F.col("prod_group").cast("string").alias("prod_group")).agg(F.count("*").alias("n_rows"))


@query("import_snapshot", f"WITH {fx.old_snapshot()} {ODD}")
def import_snapshot(spark, sf):
    path = tables.export_snapshot(odd_names(spark, sf), work_dir(spark, "export"), "site", fx.NOW)
    return tables.import_snapshot(spark, path)


# --- models on disk ------------------------------------------------------------------------

TERM_DICT = r"""dict AS (SELECT lang AS label, term, round(count(*) / 100000.0, 5) AS weight FROM (
 SELECT lang, unnest(regexp_extract_all(text, '[a-z]{4,}')) AS term FROM documents) GROUP BY 1, 2)"""


def term_dict_df(spark, sf):
    t = fx.documents(spark, sf).select(
        F.col("lang").alias("label"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    return t.groupBy("label", "term").agg(F.round(F.count("*") / F.lit(100000.0).cast("double"), 5).alias("weight"))


@query("term_dict_io", f"WITH {TERM_DICT} SELECT label, term, CAST(weight AS DOUBLE) AS weight FROM dict")
def term_dict_io(spark, sf):
    path = work_dir(spark, "terms")
    rules.write_term_dict(term_dict_df(spark, sf), path)
    return rules.read_term_dict(spark, path)


@query("model_io", "SELECT count(*) AS n, count(*) AS n_same FROM documents")
def model_io(spark, sf):
    """A forest that is stored and loaded predicts the same for all documents."""
    model = forest.train_forest(fx.training_df(spark, sf))
    path = work_dir(spark, "model")
    forest.save_model(model, path)
    own = [forest.predict(m, fx.doc_posts(spark, sf)).select("id", "predicted", "probabilities") for m in (model, forest.load_model(path))]
    both = own[0].join(own[1].withColumnsRenamed({"predicted": "again", "probabilities": "p"}), "id")
    same = (F.col("predicted") == F.col("again")) & (F.col("probabilities") == F.col("p"))
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))
