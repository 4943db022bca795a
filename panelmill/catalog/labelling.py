"""Queries over projections, labelling operators and scalar functions."""

from pyspark.sql import functions as F

from panelmill.catalog import fixtures as fx
from panelmill.catalog.base import query
from panelmill.functions import text
from panelmill.operators import label as lab
from panelmill.operators import panel, rule_join, term_weight
from panelmill.operators.clean import trimmed
from panelmill.plans import tasks



@query("result_projection", f"""WITH {fx.POSTS} SELECT id, 'task' AS task_id, concat(s_id, '_', author) AS source_author,
 post_time AS create_time, {fx.sql_first_label(fx.AUTHOR_RULES, 'author')} AS panel, s_id AS field_content,
 author AS match_content FROM posts""")
def result_projection(spark, sf):
    labelled = lab.label_posts(fx.posts(spark, sf), "keyword_model", fx.AUTHOR_RULES, "author_name")
    return lab.project_results(labelled, "author_name", "task")


AREA_RULES = {"女性": [("k_en", "end"), ("UP_", "partially")], "男性": [("view", "start")]}


@query("label_by_target", f"""WITH {fx.POSTS} SELECT id, {fx.sql_first_label(fx.GENDER_RULES, 'content')} AS by_content,
 {fx.sql_first_label(fx.AUTHOR_RULES, 'author')} AS by_author, {fx.sql_first_label(AREA_RULES, 's_area_id')} AS by_area,
 {fx.sql_first_label(fx.GENDER_RULES, 'title')} AS by_title FROM posts""")
def label_by_target(spark, sf):
    k = "keyword_model"
    return fx.posts(spark, sf).select(
        "id", lab.first_label(k, fx.GENDER_RULES, "content").alias("by_content"),
        lab.first_label(k, fx.AUTHOR_RULES, "author").alias("by_author"),
        lab.first_label(k, AREA_RULES, "s_area_id").alias("by_area"),
        lab.first_label(k, fx.GENDER_RULES, "title").alias("by_title"))


@query("labelled_only", f"WITH {fx.routed()} SELECT id, source, panel FROM routed WHERE panel <> ''")
def labelled_only(spark, sf):
    return lab.labelled_only(fx.routed_df(spark, sf)).select("id", "source", "panel")


@query("panel_name", f"""WITH {fx.POSTS}, p AS (SELECT id, {fx.sql_first_label({**fx.AUTHOR_RULES, 'odd': [('1', 'partially')]},
 'author')} AS label FROM posts) SELECT id, concat('/', {fx.case('label', fx.LABEL_NAMES, 'label')}) AS panel FROM p""")
def panel_name(spark, sf):
    label = lab.first_label("keyword_model", {**fx.AUTHOR_RULES, "odd": [("1", "partially")]}, "author")
    return fx.posts(spark, sf).select("id", label.alias("label")).select("id", lab.panel_name(F.col("label")).alias("panel"))


@query("source_routing", f"""WITH {fx.POSTS}, {fx.SOURCE_MAP} SELECT p.id, p.s_id, m.source FROM posts p
 JOIN source_map m ON m.s_id = p.s_id""")
def source_routing(spark, sf):
    return lab.route_to_sources(fx.posts(spark, sf).select("id", "s_id"), fx.source_map(spark)).select("id", "s_id", "source")


@query("author_trim", rf"""WITH {fx.POSTS}, t AS (SELECT concat(chr(9), s_id, '_', author, chr(10)) AS source_author FROM posts)
 SELECT {fx.TRIM} AS source_author, count(*) AS n FROM t GROUP BY 1""")
def author_trim(spark, sf):
    t = fx.posts(spark, sf).select(F.concat(F.lit("\t"), "s_id", F.lit("_"), "author", F.lit("\n")).alias("source_author"))
    return trimmed(t).groupBy("source_author").agg(F.count("*").alias("n"))


@query("conflict_split", f"""WITH {fx.old_snapshot()} SELECT prod_group, source_author, panel,
 panel IN ('/male', '/female') AS conflicting FROM old""")
def conflict_split(spark, sf):
    inside, outside = panel.split_conflicts(fx.old_df(spark, sf), "GENDER")
    both = inside.withColumn("conflicting", F.lit(True)).unionByName(outside.withColumn("conflicting", F.lit(False)))
    return both.select("prod_group", "source_author", "panel", "conflicting")


# --- keyword and regex rules ---------------------------------------------------------------

def sql_counts(scores: dict, source: str, cols: str = "id") -> str:
    return " UNION ALL ".join(f"SELECT {cols}, {i} AS label_pos, '{label}' AS label, {expr} AS n FROM {source} "
                              f"WHERE {expr} > 0" for i, (label, expr) in enumerate(scores.items()))


def exploded(df, counts):
    return df.select("id", F.explode(counts).alias("m")).select("id", "m.label", "m.n")


MANY_RULES = {"男性": [("th", "start"), ("eaux", "partially"), ("tion", "partially"), ("er", "partially"), (".", "end")],
              "女性": [("und", "partially"), (".", "end"), ("die", "start"), ("d", "start")],
              "青年": [("la", "start"), ("queque", "partially"), ("!!", "end"), ("!", "end")]}


@query("match_counts", f"""WITH {fx.POSTS} SELECT id, label, n FROM (
 {sql_counts({k: fx.sql_score(v, 'content') for k, v in MANY_RULES.items()}, 'posts')})""")
def match_counts(spark, sf):
    return exploded(fx.posts(spark, sf), lab.match_counts("keyword_model", MANY_RULES))


@query("multi_label", f"""WITH {fx.POSTS}, c AS ({sql_counts({k: fx.sql_score(v, 'content') for k, v in MANY_RULES.items()}, 'posts')})
 SELECT p.id, coalesce(string_agg(c.label, ',' ORDER BY c.label_pos), '') AS labels FROM posts p
 LEFT JOIN c ON c.id = p.id GROUP BY p.id""")
def multi_label(spark, sf):
    return fx.posts(spark, sf).select("id", F.array_join(lab.multi_label("keyword_model", MANY_RULES), ",").alias("labels"))


@query("first_label", f"""WITH {fx.POSTS} SELECT id, {fx.sql_first_label(MANY_RULES, 'content')} AS label FROM posts""")
def first_label(spark, sf):
    return fx.posts(spark, sf).select("id", lab.first_label("keyword_model", MANY_RULES).alias("label"))


ONE_TYPE = {
    "keyword_partially": ("content", {"男性": [("eaux", "partially"), ("tion", "partially")], "女性": [("Und", "partially")]}),
    "keyword_absolutely": ("author", {"青年": [("user 42", "absolutely"), ("USER 42", "absolutely"), ("user 7", "absolutely")],
                                      "學生": [("user 12  ", "absolutely"), ("user 77", "absolutely")]}),
    "keyword_start": ("content", {"男性": [("th", "start"), ("t", "start"), ("The", "start")], "女性": [("d", "start")]}),
    "keyword_end": ("content", {"男性": [(".", "end"), ("n.", "end")], "女性": [("e", "end"), ("!!", "end")]}),
}


def _one_type(name):
    target, rs = ONE_TYPE[name]
    sql = f"WITH {fx.POSTS} SELECT id, label, n FROM ({sql_counts({k: fx.sql_score(v, target) for k, v in rs.items()}, 'posts')})"

    @query(name, sql)
    def run(spark, sf):
        return exploded(fx.posts(spark, sf), lab.match_counts("keyword_model", rs, target))
    return run


for _name in ONE_TYPE:
    _one_type(_name)


@query("multi_match_type", f"""WITH {fx.POSTS} SELECT id, CAST(starts_with(author, 'user 4') AS INTEGER)
 + CAST(ends_with(author, 'user 4') AS INTEGER) + CAST(author = '9' AS INTEGER) + CAST(ends_with(author, '9') AS INTEGER) AS n
 FROM posts WHERE starts_with(author, 'user 4') OR ends_with(author, 'user 4') OR author = '9' OR ends_with(author, '9')""")
def multi_match_type(spark, sf):
    rs = {"青年": [("user 4", "start,end"), ("9", ["absolutely", "end"])]}
    return exploded(fx.posts(spark, sf), lab.match_counts("keyword_model", rs, "author")).select("id", "n")


RX = {k: fx.sql_regex_score(v, "content") for k, v in fx.REGEX_RULES.items()}


@query("regex_match", f"""WITH {fx.POSTS} SELECT id, CASE {' '.join(f"WHEN {e} > 0 THEN '{k}'" for k, e in RX.items())}
 ELSE '' END AS label FROM posts""")
def regex_match(spark, sf):
    return fx.posts(spark, sf).select("id", lab.first_label("rule_model", fx.REGEX_RULES).alias("label"))


@query("regex_counts", f"WITH {fx.POSTS} SELECT id, label, n FROM ({sql_counts(RX, 'posts')})")
def regex_counts(spark, sf):
    return exploded(fx.posts(spark, sf), lab.match_counts("rule_model", fx.REGEX_RULES))


RULE_FRAME = f"""{fx.RULE_TABLE}, docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, lower(text) AS t FROM documents),
r AS (SELECT labeling_job_id - 1 AS label_pos, concat('job', labeling_job_id) AS label, lower(content) AS k, match_type
 FROM rule_table), hits AS (
 SELECT d.id, r.label_pos, r.label, r.match_type FROM docs d JOIN r ON CASE r.match_type WHEN 'partially' THEN contains(d.t, r.k)
  WHEN 'absolutely' THEN d.t = r.k WHEN 'start' THEN starts_with(d.t, r.k) ELSE ends_with(d.t, r.k) END),
m AS (SELECT id, label_pos, label, CAST(max(CASE match_type WHEN 'partially' THEN 1 ELSE 0 END)
 + count(*) FILTER (match_type <> 'partially') AS INTEGER) AS n FROM hits GROUP BY id, label_pos, label)"""


def rule_frame(spark, sf):
    job = F.col("labeling_job_id")
    return fx.rule_table_df(spark, sf).select((job - 1).alias("label_pos"), F.concat(F.lit("job"), job.cast("string")).alias("label"),
                                              F.col("content").alias("keyword"), "match_type")


@query("keyword_match_join", f"WITH {RULE_FRAME} SELECT id, label_pos, label, n FROM m")
def keyword_match_join(spark, sf):
    """Rules that are a table; the number of rules decides how texts and rules meet."""
    return rule_join.match_rules(fx.doc_posts(spark, sf), rule_frame(spark, sf)).select("id", "label_pos", "label", "n")


@query("keyword_match_equijoin", f"WITH {RULE_FRAME} SELECT id, min_by(label, label_pos) AS panel FROM m GROUP BY id")
def keyword_match_equijoin(spark, sf):
    """The same by equality joins alone, for rule tables of any size; the first label wins."""
    return rule_join.first_labels(rule_join.match_by_join(fx.doc_posts(spark, sf), rule_frame(spark, sf)))


PATTERN_TABLE = """documents_ AS (SELECT CAST(doc_id AS VARCHAR) AS id, lower(text) AS t, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS label_pos,
 regexp_extract(lower(text), '[a-z]{4,}') AS w, doc_id FROM documents),
pattern_table AS (SELECT DISTINCT label_pos, CAST(label_pos AS VARCHAR) AS label, CASE doc_id % 4 WHEN 0 THEN concat('(^|[^a-z])', w, '[a-z]{1,3}[.,]')
 WHEN 1 THEN concat(left(w, 2), '[a-z]', substr(w, 4), ' [a-z]+e ') WHEN 2 THEN concat('^', w) ELSE concat(w, '[.]?\\n') END AS keyword FROM documents_ WHERE w <> '')"""


def pattern_frame(spark, sf):
    """Regular expressions made of the first longer word of each document."""
    t, w = F.lower("content"), F.regexp_extract(F.lower("content"), "[a-z]{4,}", 0)
    n = F.col("id").cast("long") % 4
    p = (F.when(n == 0, F.concat(F.lit("(^|[^a-z])"), w, F.lit("[a-z]{1,3}[.,]")))
         .when(n == 1, F.concat(F.left(w, F.lit(2)), F.lit("[a-z]"), F.substring(w, 4, 1 << 20), F.lit(" [a-z]+e ")))
         .when(n == 2, F.concat(F.lit("^"), w)).otherwise(F.concat(w, F.lit("[.]?\\n"))))
    pos = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return (fx.doc_posts(spark, sf).where(t.isNotNull() & (w != ""))
            .select(pos.alias("label_pos"), pos.cast("string").alias("label"), p.alias("keyword")).distinct())


PATTERN_COUNTS = f"""WITH {PATTERN_TABLE} SELECT d.id, p.label_pos, p.label, CAST(count(*) AS INTEGER) AS n
 FROM documents_ d JOIN pattern_table p ON regexp_matches(d.t, p.keyword) GROUP BY ALL"""


@query("regex_match_join", PATTERN_COUNTS)
def regex_match_join(spark, sf):
    """Regular expressions that are a table, each tried only where the literal it needs is."""
    return rule_join.match_patterns(fx.doc_posts(spark, sf), pattern_frame(spark, sf))


@query("regex_match_equijoin", PATTERN_COUNTS)
def regex_match_equijoin(spark, sf):
    """The same by joins alone, for tables of any size."""
    return rule_join.match_patterns_by_join(fx.doc_posts(spark, sf), pattern_frame(spark, sf))


# --- whole jobs ----------------------------------------------------------------------------

@query("label_task", f"""WITH {fx.named_rows()}, {fx.vote('voted', 'named', 'source, slice')}
 SELECT id, 'task' AS task_id, source_author, panel, create_time, field_content, match_content, source FROM voted""")
def label_task(spark, sf):
    """Match, project, route, vote per slice and rename, as one plan."""
    spec = fx.spec()
    return tasks.slice_results(
        tasks.labelled_posts(fx.posts(spark, sf), spec, fx.source_map(spark), matched_only=True), spec)


@query("label_by_model", f"""WITH {fx.POSTS} SELECT id, 'keyword_model' AS model,
  {fx.sql_first_label(fx.GENDER_RULES, 'content')} AS panel FROM posts UNION ALL SELECT id, 'rule_model',
  CASE {' '.join(f"WHEN {e} > 0 THEN '{k}'" for k, e in RX.items())} ELSE '' END FROM posts""")
def label_by_model(spark, sf):
    p = fx.posts(spark, sf)
    rs = {"keyword_model": fx.GENDER_RULES, "rule_model": fx.REGEX_RULES}
    parts = [lab.label_posts(p, m, r).select("id", F.lit(m).alias("model"), "panel") for m, r in rs.items()]
    return parts[0].unionByName(parts[1])


LONG_RULES = {"男性": [(w, "partially") for w in ("hewhou", "atare", "ingof", "tionthe", "edis", "bleou", "ortion",
                                                  "esnt", "reare", "theof")],
              "女性": [(w, "partially") for w in ("eaux", "elle", "tre", "vie", "ueq", "lao")] + [("die", "start"), ("n.", "end")],
              "青年": [("heit", "partially"), ("ción", "partially"), ("qu", "start")]}


@query("first_label_many_rules", f"WITH {fx.POSTS} SELECT id, {fx.sql_first_label(LONG_RULES, 'content')} AS panel FROM posts")
def first_label_many_rules(spark, sf):
    """All keywords in one pass over a text."""
    return fx.posts(spark, sf).select("id", lab.first_label("keyword_model", LONG_RULES, one_pass=True).alias("panel"))


@query("spec_from_json", f"""SELECT CAST(event_id AS VARCHAR) AS id, 'keyword_model' AS model_type, event_type AS predict_type,
 date_trunc('second', ts) AS start_time, date_trunc('second', ts) + INTERVAL 6 HOUR AS end_time,
 concat('wh_', event_type) AS input_schema, 1 AS n_labels, concat('user ', user_id) AS first_keyword FROM events""")
def spec_from_json(spark, sf):
    from panelmill.schemas import JOB_SPEC
    e = fx.table(spark, sf, "events")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    end = F.expr("ts + INTERVAL 6 HOUR")
    doc = F.to_json(F.struct(
        F.lit("keyword_model").alias("MODEL_TYPE"), F.col("event_type").alias("PREDICT_TYPE"),
        F.date_format("ts", iso).alias("START_TIME"), F.date_format(end, iso).alias("END_TIME"),
        F.create_map(F.lit("青年"), F.array(F.array(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.lit("start"))))
        .alias("PATTERN"), F.concat(F.lit("wh_"), "event_type").alias("INPUT_SCHEMA")))
    s = e.select(F.col("event_id").cast("string").alias("id"), F.from_json(doc, JOB_SPEC).alias("s"))
    at = lambda c: F.to_timestamp_ntz(c, F.lit(iso))
    return s.select("id", F.col("s.MODEL_TYPE").alias("model_type"), F.col("s.PREDICT_TYPE").alias("predict_type"),
                    at(F.col("s.START_TIME")).alias("start_time"), at(F.col("s.END_TIME")).alias("end_time"),
                    F.col("s.INPUT_SCHEMA").alias("input_schema"), F.size("s.PATTERN").alias("n_labels"),
                    F.map_values("s.PATTERN")[0][0][0].alias("first_keyword"))


@query("dump_table_names", f"""WITH {fx.LATEST_STATE} SELECT task_id,
 concat('wh_panel_mapping_', replace(result, ',', ',wh_panel_mapping_')) AS table_names FROM state""")
def dump_table_names(spark, sf):
    from panelmill.operators.audit import latest_status
    st = latest_status(fx.audit_df(spark, sf))
    once = st.withColumn("names", F.array_join(text.dump_table_names("result", "wh_panel_mapping_"), ","))
    # Names that already have the prefix stay as they are.
    return once.select("task_id", F.array_join(text.dump_table_names("names", "wh_panel_mapping_"), ",").alias("table_names"))


# --- term weights --------------------------------------------------------------------------

def _occurrences(t):
    return f"CAST((length(content) - length(replace(content, '{t}', ''))) // length('{t}') AS INTEGER)"


def tw_sql(terms):
    rows = " UNION ALL ".join(
        f"SELECT id, {i} AS label_pos, '{label}' AS label, '{t}' AS term, CAST({w} AS DOUBLE) AS weight, {_occurrences(t)} AS n FROM docs"
        for i, (label, tw) in enumerate(terms.items()) for t, w in tw)
    return f"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents),
hits AS (SELECT * FROM ({rows}) WHERE n > 0),
scores AS (SELECT id, label_pos, label, sum(weight * n) / sum(n) AS score, count(*) AS n_terms FROM hits GROUP BY ALL)"""


TW = tw_sql(fx.TERMS)
LONG_TERMS = {"fr": fx.TERMS["fr"] + [("elle", 0.7), ("vi", 0.15), ("ou", 0.22)],
              "en": fx.TERMS["en"] + [("enen", 0.95), ("th", 0.05), ("of ", 0.35), ("nd", 0.21)],
              "none": [("e", 0.1), ("ee", 0.9), ("a", 0.45), ("aa", 0.05)]}


@query("term_weight_score", f"""WITH {TW} SELECT d.id, coalesce(string_agg(s.label, ',' ORDER BY s.label_pos), '') AS labels
 FROM docs d LEFT JOIN scores s ON s.id = d.id AND s.score > 0.3 GROUP BY d.id""")
def term_weight_score(spark, sf):
    return fx.doc_posts(spark, sf).select("id", F.array_join(term_weight.labels(fx.TERMS), ",").alias("labels"))


@query("term_weight_many_terms", f"""WITH {tw_sql(LONG_TERMS)} SELECT d.id, coalesce(string_agg(s.label, ',' ORDER BY s.label_pos), '-') AS labels
 FROM docs d LEFT JOIN scores s ON s.id = d.id AND s.score > 0.3 GROUP BY d.id""")
def term_weight_many_terms(spark, sf):
    """All terms in one pass over a text."""
    labels = term_weight.labels(LONG_TERMS, na_label="-", one_pass=True)
    return fx.doc_posts(spark, sf).select("id", F.array_join(labels, ",").alias("labels"))


@query("term_weight_matches", f"WITH {TW} SELECT id, label, term, weight, n FROM hits")
def term_weight_matches(spark, sf):
    m = fx.doc_posts(spark, sf).select("id", F.explode(term_weight.matches(fx.TERMS)).alias("m"))
    return m.select("id", "m.label", F.explode("m.matches").alias("t")).select("id", "label", "t.*")


@query("term_weight_table", f"WITH {TW} SELECT id, label, round(score, 9) AS score, n_terms FROM scores")
def term_weight_table(spark, sf):
    """A dictionary that stays a table: equality join of text pieces with terms."""
    rows = [(label, t, w) for label, tw in fx.TERMS.items() for t, w in tw]
    terms = spark.createDataFrame(rows, "label string, term string, weight double")
    out = term_weight.score_with_table(fx.doc_posts(spark, sf), terms)
    return out.select("id", "label", F.round("score", 9).alias("score"), "n_terms")


@query("na_tag", f"""WITH {TW}, s AS (SELECT * FROM scores WHERE score > 0.7)
 SELECT d.id, coalesce(string_agg(s.label, ',' ORDER BY s.label_pos), 'none') AS labels
 FROM docs d LEFT JOIN s ON s.id = d.id GROUP BY d.id""")
def na_tag(spark, sf):
    labels = term_weight.labels(fx.TERMS, threshold=0.7, na_label="none")
    return fx.doc_posts(spark, sf).select("id", F.array_join(labels, ",").alias("labels"))


