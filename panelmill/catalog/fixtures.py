"""Posts, tasks and panels as views over the given tables, in DataFrames and in SQL.

Both texts say the same thing independently: the SQL side uses plain joins, windows and CASE.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.constants import CONFLICT_GROUPS, LABEL_NAMES, PRODUCTION_GROUPS
from panelmill.functions.slices import slice_index
from panelmill.operators.clean import slice_votes, two_stage_vote
from panelmill.plans.tasks import labelled_posts, named
from panelmill.schemas import SOURCE_MAP as SOURCE_MAP_SCHEMA
from panelmill.session import fixed_table, work_dir
from panelmill.sources.rules import production_groups
from panelmill.sources.tables import PARTS, read_results, write_production
from panelmill.spec import JobSpec

START, END, NOW = datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 2, 1, 12)

# A job may find these labels; keyword rules in order of priority.
GENDER_RULES = {"男性": [("th", "start"), ("eaux", "partially")],
                "女性": [("und", "partially"), (".", "end")]}
MARRIAGE_RULES = {"未婚": [("la ", "start"), ("ción", "partially"), ("t", "start")],
                  "已婚": [("die", "partially"), ("nd", "partially")]}
AUTHOR_RULES = {"青年": [("user 42", "absolutely"), ("USER 1", "start")],
                "男性": [("7", "end"), ("9", "end")],
                "學生": [("3", "partially"), ("user 5", "start"), ("5", "end")]}
REGEX_RULES = {"男性": ["^th", "tion[a-z]{0,3} the"],
               "女性": ["[.]\nthe", "(und|oder) die", "[0-9]{3}"],
               "學生": ["[a-z]{12}"]}
SITES = {"view": "WH_F0045", "click": "WH_F0165", "purchase": "WH_F0001", "signup": "WH_F0157"}
# Old snapshots also hold authors of a site that has no posts now.
OLD_SITES = {"view": "WH_F0045", "click": "WH_F0072", "purchase": "WH_F0001"}
SITE_SOURCES = {"WH_F0045": "fbfans", "WH_F0165": "fbgroup", "WH_F0001": "Ptt", "WH_F0157": "Instagram"}
TERMS = {"fr": [("eaux", 0.9), ("la ", 0.4), ("tion", 0.05)],
         "de": [("und", 0.8), ("die", 0.7), ("heit", 0.6), ("en", 0.1)],
         "en": [("the", 0.6), ("ing", 0.5), ("aa", 0.9)],
         "es": [("ción", 1.0), ("que", 0.35), ("la ", 0.25)]}


# --- SQL pieces ----------------------------------------------------------------------------

def case(col: str, mapping: dict, other: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def sql_keyword_test(col: str, keyword: str, kind: str, case_sensitive: bool = False) -> str:
    k = "'" + (keyword if case_sensitive else keyword.lower()).replace("'", "''") + "'"
    return {"partially": f"contains({col}, {k})", "absolutely": f"{col} = {k}",
            "start": f"starts_with({col}, {k})", "end": f"ends_with({col}, {k})"}[kind]


def sql_first_label(rules: dict, col: str) -> str:
    arms = [f"WHEN {' OR '.join(sql_keyword_test(f'lower({col})', k, t) for k, t in rs)} THEN '{label}'"
            for label, rs in rules.items()]
    return "CASE " + " ".join(arms) + " ELSE '' END"


def sql_score(rules: list, col: str) -> str:
    """Score of one label: one point for all "partially" keywords together, one for each other rule."""
    part = [sql_keyword_test(f"lower({col})", k, t) for k, t in rules if t == "partially"]
    rest = [sql_keyword_test(f"lower({col})", k, t) for k, t in rules if t != "partially"]
    terms = ([f"CAST(({' OR '.join(part)}) AS INTEGER)"] if part else []) + [f"CAST({r} AS INTEGER)" for r in rest]
    return " + ".join(terms)


def sql_regex_score(patterns: list[str], col: str) -> str:
    return " + ".join(f"CAST(regexp_matches(lower({col}), '{p}') AS INTEGER)" for p in patterns)


TRIM = r"regexp_replace(source_author, '^\s+|\s+$', '', 'g')"
US = "(epoch_us({c}) - epoch_us(TIMESTAMP '2024-01-01'))"
SLICE = US.format(c="post_time") + " // 21600000000"
WEEK = "concat('task_', " + US.format(c="post_time") + " // 604800000000)"

POSTS = f"""posts AS (
 SELECT CAST(e.event_id AS VARCHAR) AS id, {case('e.event_type', SITES, "'WH_X0000'")} AS s_id,
  concat(e.event_type, '_', d.lang) AS s_area_id,
  concat('user ', e.user_id, CASE WHEN e.event_id % 7 = 0 THEN '  ' ELSE '' END) AS author,
  split_part(d.text, chr(10), 1) AS title, d.text AS content, e.ts AS post_time
 FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""

# Posts as a scan finds them: parts missing here and there.
RAW_POSTS = POSTS + """, raw_posts AS (
 SELECT p.id, CASE WHEN e.value > 120 THEN NULL ELSE p.s_id END AS s_id, p.s_area_id,
  CASE WHEN e.value < 5 THEN NULL ELSE p.author END AS author,
  CASE WHEN e.value < 10 THEN NULL ELSE p.title END AS title, p.content, p.post_time
 FROM posts p JOIN events e ON CAST(e.event_id AS VARCHAR) = p.id)"""

SOURCE_MAP = values("source_map", "s_id, source", list(SITE_SOURCES.items()))
GROUPS = values("groups", "source, prod_group", [(s, g) for g, ss in PRODUCTION_GROUPS.items() for s in ss])


def routed(rules: dict = GENDER_RULES, target: str = "content") -> str:
    """Labelled, routed and projected posts with task, source and slice; panel '' if unlabelled."""
    return f"""{POSTS}, {SOURCE_MAP}, routed AS (
 SELECT p.id, {WEEK} AS task_id, concat_ws('_', p.s_id, p.author) AS source_author, post_time AS create_time,
  {sql_first_label(rules, target)} AS panel, p.s_id AS field_content, {target} AS match_content, m.source,
  {SLICE} AS slice
 FROM posts p JOIN source_map m ON m.s_id = p.s_id
 WHERE post_time >= TIMESTAMP '2024-01-01' AND post_time < TIMESTAMP '2024-01-31')"""


def named_rows(rules: dict = GENDER_RULES, target: str = "content") -> str:
    return f"""{routed(rules, target)}, named AS (
 SELECT * REPLACE (concat('/', {case('panel', LABEL_NAMES, 'panel')}) AS panel) FROM routed WHERE panel <> '')"""


def vote(name: str, source: str, keys: str, tie: str = "drop") -> str:
    """Cleaning of ``source`` as CTE ``name``: trim, count, keep a unique leader, latest row."""
    leader = ("any_value(panel) AS panel FROM {n}_m WHERE n = mx GROUP BY {k}, source_author HAVING count(*) = 1"
              if tie == "drop" else "max(panel) AS panel FROM {n}_m WHERE n = mx GROUP BY {k}, source_author")
    leader = leader.format(n=name, k=keys)
    return f"""{name}_t AS (SELECT * REPLACE ({TRIM} AS source_author) FROM {source}),
{name}_c AS (SELECT {keys}, source_author, panel, count(*) AS n FROM {name}_t GROUP BY ALL),
{name}_m AS (SELECT *, max(n) OVER (PARTITION BY {keys}, source_author) AS mx FROM {name}_c),
{name}_w AS (SELECT {keys}, source_author, {leader}),
{name}_l AS (SELECT *, row_number() OVER (PARTITION BY {keys}, source_author, panel
  ORDER BY create_time DESC, id DESC) AS rn FROM {name}_t),
{name} AS (SELECT l.* EXCLUDE (rn) FROM {name}_l l JOIN {name}_w w USING ({keys}, source_author, panel) WHERE rn = 1)"""


def results(rules: dict = GENDER_RULES) -> str:
    return f"{named_rows(rules)}, {vote('results', 'named', 'task_id, source, slice')}"


def production(rules: dict = GENDER_RULES) -> str:
    return f"{results(rules)}, {vote('production', 'results', 'task_id, source')}"


STATE = """state AS (SELECT task_id, string_agg(DISTINCT source, ',' ORDER BY source) AS result,
 'finish' AS prod_stat FROM production GROUP BY task_id)"""


def _panel_case(panels: list[str]) -> str:
    return f"CASE e.user_id % 4 WHEN 0 THEN '{panels[0]}' WHEN 1 THEN '{panels[1]}' " \
           "WHEN 2 THEN '/young' ELSE '/employee' END"


def old_snapshot(term: str = "GENDER") -> str:
    return f"""old AS (SELECT DISTINCT CASE e.event_type WHEN 'purchase' THEN 'bbs' ELSE 'fb' END AS prod_group,
  concat({case('e.event_type', OLD_SITES)}, '_user ', e.user_id, CASE WHEN e.user_id % 5 = 0 THEN ' ' ELSE '' END)
   AS source_author,
  {_panel_case(CONFLICT_GROUPS[term])} AS panel, TIMESTAMP '2023-01-01' AS create_time
 FROM events e WHERE e.event_type IN ('purchase', 'view', 'click') AND e.value > 100)"""


def group_current(rules: dict = GENDER_RULES) -> str:
    return f"""{production(rules)}, {STATE}, {GROUPS}, tasks AS (
 SELECT task_id, unnest(string_split(result, ',')) AS source FROM state), new AS (
 SELECT g.prod_group, p.source_author, p.panel FROM production p
 JOIN tasks t ON t.task_id = p.task_id AND t.source = p.source JOIN groups g ON g.source = p.source)"""


def merge(term: str = "GENDER", name: str = "merged", compat: bool = False) -> str:
    """Merge of ``old`` and ``new`` by the one-sided and two-sided parts."""
    c = ", ".join(f"'{p}'" for p in CONFLICT_GROUPS[term])
    now = f"TIMESTAMP '{NOW}'"
    newc = "n" if compat else f"(SELECT * FROM n WHERE panel IN ({c}))"
    rest = "" if compat else f"UNION ALL SELECT prod_group, source_author, panel, {now} FROM n WHERE panel NOT IN ({c})"
    return f"""o AS (SELECT * REPLACE ({TRIM} AS source_author) FROM old
  WHERE prod_group IN (SELECT prod_group FROM new)),
n AS (SELECT DISTINCT prod_group, {TRIM} AS source_author, panel FROM new),
oc AS (SELECT * FROM o WHERE panel IN ({c})), nc AS (SELECT * FROM {newc} x),
{name} AS (
 SELECT prod_group, source_author, panel, create_time FROM o WHERE panel NOT IN ({c})
 UNION ALL SELECT prod_group, source_author, panel, create_time FROM oc
  WHERE NOT EXISTS (SELECT 1 FROM nc WHERE nc.prod_group = oc.prod_group AND nc.source_author = oc.source_author)
 UNION ALL SELECT prod_group, source_author, panel, {now} FROM nc
  WHERE NOT EXISTS (SELECT 1 FROM oc WHERE nc.prod_group = oc.prod_group AND nc.source_author = oc.source_author)
 UNION ALL SELECT oc.prod_group, oc.source_author, CASE WHEN oc.panel <> nc.panel THEN nc.panel ELSE oc.panel END,
  CASE WHEN oc.panel <> nc.panel THEN {now} ELSE oc.create_time END
  FROM oc JOIN nc ON nc.prod_group = oc.prod_group AND nc.source_author = oc.source_author
 {rest})"""


AUDIT = """audit AS (SELECT md5(concat('user ', user_id)) AS task_id, event_id AS seq,
 CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'STARTED' WHEN 'error' THEN 'FAILURE'
  ELSE 'SUCCESS' END AS stat,
 CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'finish' WHEN 'error' THEN 'no_data' END AS prod_stat,
 CASE event_type WHEN 'view' THEN 'fbfans,fbgroup' WHEN 'click' THEN 'fbgroup,Ptt' WHEN 'purchase' THEN 'Ptt,forum'
  WHEN 'signup' THEN 'Instagram' ELSE 'video' END AS result, ts AS create_time,
 CAST(floor(value * 1000) AS BIGINT) AS length_receive_table FROM events)"""

LATEST_STATE = AUDIT + """, state AS (SELECT * EXCLUDE (rn) FROM (
 SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS rn FROM audit) WHERE rn = 1)"""

RULE_TABLE = r"""rule_table AS (SELECT DISTINCT
 CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS labeling_job_id,
 regexp_extract(text, '[A-Za-z]{3,}') AS content,
 CASE n_chars % 4 WHEN 0 THEN 'partially' WHEN 1 THEN 'absolutely' WHEN 2 THEN 'start' ELSE 'end' END AS match_type
 FROM documents WHERE regexp_matches(text, '[A-Za-z]{3,}'))"""

TRAINING = r"""training AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS content,
 CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS label,
 CASE WHEN l.toxic = 1 THEN [CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END, 'toxic']
  ELSE [CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END] END AS labels,
 d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


# --- the same as DataFrames ----------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small test table of one unsplittable file over all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The texts: the part of the input that all the work hangs on."""
    return spread(table(spark, sf, "documents"), "doc_id")


def _map(col: str, mapping: dict, other=None):
    c = F.lit(other)
    for k, v in reversed(mapping.items()):
        c = F.when(F.col(col) == k, v).otherwise(c)
    return c


def posts(spark: SparkSession, sf: str, events: DataFrame | None = None, extra: tuple = ()) -> DataFrame:
    docs = documents(spark, sf)
    n = table(spark, sf, "documents").count()
    e = table(spark, sf, "events") if events is None else events
    joined = (e.withColumn("_doc", F.col("event_id") % n)
               .join(docs.select(F.col("doc_id").alias("_doc"), "lang", "text"), "_doc"))
    return joined.select(
        F.col("event_id").cast("string").alias("id"), _map("event_type", SITES, "WH_X0000").alias("s_id"),
        F.concat_ws("_", "event_type", "lang").alias("s_area_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"),
                 F.when(F.col("event_id") % 7 == 0, "  ").otherwise("")).alias("author"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.col("ts").alias("post_time"), *extra)


def raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, extra=("value",))
    return p.select("id", F.when(~(F.col("value") > 120), F.col("s_id")).alias("s_id"), "s_area_id",
                    F.when(~(F.col("value") < 5), F.col("author")).alias("author"),
                    F.when(~(F.col("value") < 10), F.col("title")).alias("title"), "content", "post_time")


def source_map(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, list(SITE_SOURCES.items()), SOURCE_MAP_SCHEMA)


def groups(spark: SparkSession) -> DataFrame:
    return production_groups(spark)


def spec(rules: dict = GENDER_RULES, target: str = "content", model: str = "keyword_model", **kw) -> JobSpec:
    return JobSpec(task_id="task", start=START, end=END, rules=rules, model_type=model, target=target, **kw)


def weekly(df: DataFrame, column: str = "create_time") -> DataFrame:
    """One task per week."""
    return df.withColumn("task_id", F.concat(F.lit("task_"), slice_index(column, START, 168).cast("string")))


def routed_df(spark: SparkSession, sf: str, rules: dict = GENDER_RULES, target: str = "content",
              model: str = "keyword_model", matched_only: bool = False) -> DataFrame:
    return weekly(labelled_posts(posts(spark, sf), spec(rules, target, model), source_map(spark), matched_only))


def named_df(spark: SparkSession, sf: str, rules: dict = GENDER_RULES, target: str = "content") -> DataFrame:
    return named(routed_df(spark, sf, rules, target, matched_only=True))


def results_df(spark: SparkSession, sf: str, rules: dict = GENDER_RULES, parts: tuple = ()) -> DataFrame:
    return slice_votes(named_df(spark, sf, rules), keys=["task_id", "source"], parts=parts)


def production_df(spark: SparkSession, sf: str, rules: dict = GENDER_RULES, parts: tuple = ()) -> DataFrame:
    return two_stage_vote(named_df(spark, sf, rules), keys=["task_id", "source"], parts=parts)


def stored_production(spark: SparkSession, sf: str, rules: dict = GENDER_RULES) -> DataFrame:
    """Production as a dump finds it: a written table."""
    path = work_dir(spark, "production")
    write_production(production_df(spark, sf, rules, PARTS), path, placed=True)
    return read_results(spark, path)


def weekly_state(prod: DataFrame) -> DataFrame:
    """State of the weekly tasks: the sources of a task are at most as many as there are sources."""
    return (prod.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("result"))
                .withColumn("prod_stat", F.lit("finish")))


def old_df(spark: SparkSession, sf: str, term: str = "GENDER") -> DataFrame:
    p = CONFLICT_GROUPS[term]
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "view", "click") & (F.col("value") > 100))
    u = F.col("user_id")
    return e.select(
        F.when(F.col("event_type") == "purchase", "bbs").otherwise("fb").alias("prod_group"),
        F.concat(_map("event_type", OLD_SITES), F.lit("_user "), u.cast("string"),
                 F.when(u % 5 == 0, " ").otherwise("")).alias("source_author"),
        F.when(u % 4 == 0, p[0]).when(u % 4 == 1, p[1]).when(u % 4 == 2, "/young").otherwise("/employee").alias("panel"),
        F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("create_time")).distinct()


def audit_df(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.md5(F.concat(F.lit("user "), F.col("user_id").cast("string")).cast("binary")).alias("task_id"),
        F.col("event_id").alias("seq"),
        _map("event_type", {"view": "PENDING", "click": "STARTED", "error": "FAILURE"}, "SUCCESS").alias("stat"),
        _map("event_type", {"purchase": "finish", "signup": "finish", "error": "no_data"}).alias("prod_stat"),
        _map("event_type", {"view": "fbfans,fbgroup", "click": "fbgroup,Ptt", "purchase": "Ptt,forum",
                            "signup": "Instagram"}, "video").alias("result"),
        F.col("ts").alias("create_time"), F.floor(F.col("value") * 1000).cast("bigint").alias("length_receive_table"))


def rule_table_df(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.col("text").rlike("[A-Za-z]{3,}"))
    n = F.col("n_chars") % 4
    return d.select(
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3)
        .otherwise(4).alias("labeling_job_id"),
        F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("content"),
        F.when(n == 0, "partially").when(n == 1, "absolutely").when(n == 2, "start").otherwise("end")
        .alias("match_type")).distinct()


def training_df(spark: SparkSession, sf: str) -> DataFrame:
    q = F.when(F.col("quality") == 1, "good").otherwise("poor")
    return (documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
            .select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), q.alias("label"),
                    F.when(F.col("toxic") == 1, F.array(q, F.lit("toxic"))).otherwise(F.array(q)).alias("labels"),
                    "lang"))


def doc_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts: every text once."""
    return documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"),
                                                F.col("text").alias("content"), "lang", "source")


