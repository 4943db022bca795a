"""Queries over tokens, TF-IDF, evaluation and training."""

from pyspark.sql import functions as F

from panelmill import constants
from panelmill.catalog import fixtures as fx
from panelmill.catalog.base import query
from panelmill.catalog.scans import TERM_DICT, term_dict_df
from panelmill.functions.text import char_tokens
from panelmill.operators import evaluate, features, forest

STOP = ["the", "of", "and", "to", "in", "is", "la", "le", "de", "und", "die"]
CLASSES = ["good", "poor", "toxic"]
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
STOPPED = ", ".join(f"'{w}'" for w in STOP)


@query("char_tokens", f"""WITH {fx.POSTS} SELECT c, count(*) AS n FROM (SELECT unnest(string_split(author, '')) AS c FROM posts)
 WHERE c <> '' GROUP BY 1""")
def char_tokens_(spark, sf):
    return fx.posts(spark, sf).select(F.explode(char_tokens("author")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("tokens", f"""SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(list_filter({WORDS}, lambda x: x NOT IN ({STOPPED})), ' ') AS tokens
 FROM documents""")
def tokens(spark, sf):
    d = fx.doc_posts(spark, sf)
    return d.select("id", F.array_join(features.tokens("content", STOP), " ").alias("tokens"))


TF = f"""tok AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest({WORDS}) AS term FROM documents),
 tf AS (SELECT id, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOPPED}) GROUP BY 1, 2)"""


@query("term_counts", f"WITH {TF} SELECT id, term, tf FROM tf")
def term_counts(spark, sf):
    return features.term_counts(fx.doc_posts(spark, sf), "content", STOP)


@query("tfidf", f"""WITH {TF}, v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2
  ORDER BY total DESC, term LIMIT 5000), w AS (
 SELECT id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN v USING (term))
 SELECT id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS tfidf FROM w""")
def tfidf(spark, sf):
    t = features.tfidf(fx.doc_posts(spark, sf), max_features=5000, min_df=2, stop_words=STOP)
    return t.withColumn("tfidf", F.round("tfidf", 9))


SCALED = f"""{TERM_DICT}, s AS (SELECT *, min(weight) OVER (PARTITION BY label) AS lo, max(weight) OVER (PARTITION BY label) AS hi
 FROM dict), z AS (SELECT label, term, round(CASE WHEN hi > lo THEN (CAST(weight AS DOUBLE) - lo) / (CAST(hi AS DOUBLE) - lo) ELSE 0 END, 5) AS weight FROM s)"""


@query("term_weight_scale", f"WITH {SCALED} SELECT label, term, weight FROM z")
def term_weight_scale(spark, sf):
    return forest.scale_weights(term_dict_df(spark, sf))


@query("top_terms", f"""WITH {SCALED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS INTEGER)
 AS rank FROM z) SELECT label, term, weight, rank FROM r WHERE rank <= 100""")
def top_terms(spark, sf):
    return forest.top_terms(forest.scale_weights(term_dict_df(spark, sf)), 100)


# --- evaluation: labels by keyword rules against the given labels ---------------------------

PRED_RULES = {"good": [("the", "partially"), ("und", "partially")], "poor": [("!!", "partially"), (".", "start")],
              "toxic": [("hate", "partially"), ("er", "partially")]}
PAIRS = f"""{fx.TRAINING}, pr AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter([
 {', '.join(f"CASE WHEN ({fx.sql_score(v, 'text')}) > 0 THEN '{k}' END" for k, v in PRED_RULES.items())}], lambda x: x IS NOT NULL) AS pred
 FROM documents), pairs AS (SELECT pr.id, pr.pred, coalesce(t.labels, CAST([] AS VARCHAR[])) AS truth FROM pr
 LEFT JOIN training t ON t.id = pr.id)"""
BITS = "bits AS (" + " UNION ALL ".join(
    f"SELECT id, '{c}' AS label, list_contains(pred, '{c}') AS p, list_contains(truth, '{c}') AS t FROM pairs" for c in CLASSES) + ")"
REPORT = f"""{PAIRS}, {BITS}, c AS (SELECT label, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
 count(*) FILTER (NOT p AND t) AS fn FROM bits GROUP BY 1)"""


def _sql_ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 1.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


PRF = [(_sql_ratio("tp", "tp + fp"), "precision"), (_sql_ratio("tp", "tp + fn"), "recall"),
       (_sql_ratio("2 * tp", "2 * tp + fp + fn"), "f1")]
PRF_COLS = ", ".join(f"{e} AS {n}" for e, n in PRF)


def pairs(spark, sf):
    from panelmill.operators import label as lab
    pred = fx.doc_posts(spark, sf).select("id", lab.multi_label("keyword_model", PRED_RULES).alias("pred"))
    truth = fx.training_df(spark, sf).select("id", F.col("labels").alias("truth"))
    return evaluate.eval_join(pred, truth)


@query("eval_join", f"""WITH {PAIRS} SELECT id, array_to_string(pred, ',') AS pred, array_to_string(truth, ',') AS truth FROM pairs""")
def eval_join(spark, sf):
    return pairs(spark, sf).select("id", F.array_join("pred", ",").alias("pred"), F.array_join("truth", ",").alias("truth"))


@query("subset_accuracy", f"WITH {PAIRS} SELECT avg(CAST(list_sort(pred) = list_sort(truth) AS DOUBLE)) AS accuracy FROM pairs")
def subset_accuracy(spark, sf):
    return evaluate.subset_accuracy(pairs(spark, sf))


@query("label_report", f"""WITH {REPORT} SELECT label, tp, fp, fn, tp + fn AS support, {PRF_COLS} FROM c""")
def label_report(spark, sf):
    return evaluate.label_report(pairs(spark, sf), CLASSES)


AVERAGES = f"""{REPORT}, r AS (SELECT *, tp + fn AS support, {PRF_COLS} FROM c),
 s AS (SELECT id, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn
  FROM bits GROUP BY 1), sr AS (SELECT {PRF_COLS} FROM s),
 mi AS (SELECT {PRF_COLS} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c))"""


@query("report_averages", f"""WITH {AVERAGES}, a AS (
 SELECT 'micro' AS average, precision, recall, f1 FROM mi
 UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1) FROM r
 UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support) FROM r
 UNION ALL SELECT 'samples', avg(precision), avg(recall), avg(f1) FROM sr)
 SELECT average, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM a""")
def report_averages(spark, sf):
    a = evaluate.report_averages(pairs(spark, sf), CLASSES)
    return a.select("average", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("hamming_accuracy", f"WITH {PAIRS}, {BITS} SELECT avg(CAST(p = t AS DOUBLE)) AS accuracy FROM bits")
def hamming_accuracy(spark, sf):
    return evaluate.cell_accuracy(pairs(spark, sf), CLASSES)


@query("label_binarize", f"""WITH {PAIRS} SELECT id, {', '.join(f"CAST(list_contains(pred, '{c}') AS INTEGER) AS is_{c}" for c in CLASSES)}
 FROM pairs""")
def label_binarize(spark, sf):
    return evaluate.binarize(pairs(spark, sf), "pred", CLASSES)


@query("label_explode", f"WITH {fx.TRAINING} SELECT id, unnest(labels) AS label FROM training")
def label_explode(spark, sf):
    joined = fx.training_df(spark, sf).select("id", F.array_join("labels", ",").alias("label"))
    return evaluate.explode_labels(joined)


# --- training: at the fixed sizes; SQL states what any trained model must satisfy ------------

def training(spark, sf):
    return fx.training_df(spark, sf)


@query("rf_train", f"WITH {fx.TRAINING} SELECT label, count(*) AS n, TRUE AS learned FROM training GROUP BY 1")
def rf_train(spark, sf):
    """A forest finds most of its own training labels again."""
    train = training(spark, sf)
    out = forest.predict(forest.train_forest(train), train)
    return out.groupBy("label").agg(F.count("*").alias("n"), (F.count_if(F.col("label") == F.col("predicted")) > 0.8 * F.count("*")).alias("learned"))


@query("rf_predict", """SELECT CAST(doc_id AS VARCHAR) AS id, 2 AS n_classes, CAST(1 AS DOUBLE) AS total, TRUE AS leads FROM documents""")
def rf_predict(spark, sf):
    """Class probabilities of every document sum to one, and the predicted class has the greatest."""
    model = forest.train_forest(training(spark, sf))
    out = forest.predict(model, fx.doc_posts(spark, sf))
    p = F.col("probabilities")
    top = F.array_max(F.transform(p, lambda x: x["p"]))
    own = F.filter(p, lambda x: x["label"] == F.col("predicted"))
    return out.select("id", F.size(p).alias("n_classes"), F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x["p"]), 9).alias("total"),
                      (own[0]["p"] == top).alias("leads"))


@query("rf_multilabel", f"SELECT CAST(doc_id AS VARCHAR) AS id, {len(CLASSES)} AS n_classes, TRUE AS agrees FROM documents")
def rf_multilabel(spark, sf):
    """The predicted labels of every document are those with a probability above one half."""
    feats, forests = forest.train_forest_multilabel(training(spark, sf), CLASSES)
    out = forest.predict_multilabel(feats, forests, fx.doc_posts(spark, sf))
    p = F.col("probabilities")
    fits = F.forall(p, lambda x: (x["p"] >= 0) & (x["p"] <= 1) & ((x["p"] > 0.5) == F.array_contains("predicted", x["label"])))
    return out.select("id", F.size(p).alias("n_classes"), fits.alias("agrees"))


TRAIN_WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}')"


@query("term_weight_train", f"""WITH {fx.TRAINING}, v AS (SELECT term FROM (SELECT DISTINCT id, unnest({TRAIN_WORDS}) AS term FROM training)
 WHERE term NOT IN ({STOPPED}) GROUP BY 1 HAVING count(*) >= 5)
 SELECT label, (SELECT least(count(*), {constants.TERM_MAX_FEATURES}) FROM v) AS n_terms, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
 FROM (VALUES {', '.join(f"('{c}')" for c in CLASSES)}) c(label)""")
def term_weight_train(spark, sf):
    """Weights of the whole vocabulary for each label, scaled to [0, 1].  The smallest tables have no term in 50 texts."""
    terms = forest.train_term_weights(training(spark, sf), CLASSES, stop_words=STOP, min_df=5)
    return terms.groupBy("label").agg(F.count("*").alias("n_terms"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
