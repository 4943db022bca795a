import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelmill.operators import evaluate, features, forest, sample

CLASSES = ["a", "b", "c"]


def frames(spark, pred, truth):
    schema = "id string, {} array<string>"
    return evaluate.eval_join(spark.createDataFrame(pred, schema.format("pred")),
                              spark.createDataFrame(truth, schema.format("truth")))


def prf(tp, fp, fn, zero=1.0):
    div = lambda x, y: x / y if y else zero
    return div(tp, tp + fp), div(tp, tp + fn), div(2 * tp, 2 * tp + fp + fn)


def test_unmatched_row_is_a_false_negative(spark):
    p = frames(spark, [("1", ["a"])], [("1", ["a"]), ("2", ["a"])])
    r = {x["label"]: x for x in evaluate.label_report(p, CLASSES).collect()}
    assert (r["a"]["tp"], r["a"]["fn"], r["a"]["support"]) == (1, 1, 2)
    assert r["b"]["precision"] == 1.0
    assert {x["label"]: x["precision"] for x in evaluate.label_report(p, CLASSES, 0.0).collect()}["b"] == 0.0
    assert evaluate.subset_accuracy(p).first()[0] == 0.5


def test_report_against_brute_force(spark):
    rnd = random.Random(3)
    pick = lambda: [c for c in CLASSES if rnd.random() < 0.4]
    rows = [(str(i), pick(), pick()) for i in range(100)]
    p = frames(spark, [(i, x) for i, x, _ in rows], [(i, y) for i, _, y in rows])
    cells = {c: Counter((c in x, c in y) for _, x, y in rows) for c in CLASSES}
    per = {c: prf(n[True, True], n[True, False], n[False, True]) for c, n in cells.items()}
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.label_report(p, CLASSES).collect()}
    assert got.keys() == per.keys()
    for c in CLASSES:
        assert got[c] == pytest.approx(per[c])
    avg = {r["average"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.report_averages(p, CLASSES).collect()}
    support = {c: sum(c in y for _, _, y in rows) for c in CLASSES}
    total = sum(support.values())
    assert avg["macro"] == pytest.approx([sum(per[c][k] for c in CLASSES) / 3 for k in range(3)])
    assert avg["weighted"] == pytest.approx([sum(per[c][k] * support[c] for c in CLASSES) / total for k in range(3)])
    assert avg["micro"] == pytest.approx(prf(*[sum(n[k] for n in cells.values())
                                               for k in ((True, True), (True, False), (False, True))]))
    each = [prf(len(set(x) & set(y)), len(set(x) - set(y)), len(set(y) - set(x))) for _, x, y in rows]
    assert avg["samples"] == pytest.approx([sum(e[k] for e in each) / 100 for k in range(3)])
    same = sum((c in x) == (c in y) for _, x, y in rows for c in CLASSES)
    assert evaluate.cell_accuracy(p, CLASSES).first()[0] == pytest.approx(same / 300)


def test_tfidf_against_brute_force(spark):
    texts = ["aa bb aa cc", "bb cc dd", "cc", "ee zz", "aa zz zz"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    got = {(r["id"], r["term"]): r["tfidf"] for r in features.tfidf(df, max_features=3, min_df=2).collect()}
    tf = [Counter(t.split()) for t in texts]
    df_ = Counter(w for c in tf for w in c)
    total = sum(tf, Counter())
    vocab = sorted((w for w in total if df_[w] >= 2), key=lambda w: (-total[w], w))[:3]
    want = {}
    for i, c in enumerate(tf):
        w = {t: c[t] * (math.log((1 + 5) / (1 + df_[t])) + 1) for t in vocab if c[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want.update({(str(i), t): v / norm for t, v in w.items()})
    assert got == pytest.approx(want)


def docs(spark, n=60):
    rnd = random.Random(5)
    words = {"good": ["sun", "warm", "calm"], "poor": ["rain", "cold", "storm"]}
    rows = []
    for i in range(n):
        y = "good" if i % 2 else "poor"
        rows.append((str(i), " ".join(rnd.choice(words[y] + ["the", "day"]) for _ in range(12)), y,
                     [y] + (["long"] if i % 3 == 0 else []), ))
    return spark.createDataFrame(rows, "id string, content string, label string, labels array<string>")


def test_forest_learns_and_survives_saving(spark, tmp_path):
    train = docs(spark)
    model = forest.train_forest(train, trees=5, max_depth=4)
    forest.save_model(model, str(tmp_path / "m"))
    out = forest.predict(forest.load_model(str(tmp_path / "m")), train)
    assert out.where("predicted = label").count() == 60
    p = out.select(F.explode("probabilities").alias("p")).select("p.*").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in p} == {"good": 60, "poor": 60}


def test_vectors_match_relational_tfidf(spark):
    train = docs(spark)
    stages = forest._feature_stages(forest.with_tokens(train), 100, 1)
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    vec = PipelineModel(stages).transform(forest.with_tokens(train)).select("id", vector_to_array("features").alias("v"))
    vocab = stages[0].vocabulary
    dense = {(r["id"], t): x for r in vec.collect() for t, x in zip(vocab, r["v"]) if x}
    rel = {(r["id"], r["term"]): r["tfidf"] for r in features.tfidf(train, max_features=100, min_df=1).collect()}
    assert dense == pytest.approx(rel)


def test_multilabel_and_term_weights(spark):
    train = docs(spark)
    feats, forests = forest.train_forest_multilabel(train, ["good", "poor"], trees=5, max_depth=4)
    out = forest.predict_multilabel(feats, forests, train)
    assert out.where(F.array_contains("predicted", F.col("label"))).count() == 60
    w = {(r["label"], r["term"]): r["weight"] for r in
         forest.train_term_weights(train, ["good", "poor"], min_df=1, max_iter=20).collect()}
    assert max(w.values()) == 1.0 and min(w.values()) == 0.0
    assert w["good", "sun"] > w["good", "rain"] and w["poor", "storm"] > w["poor", "calm"]


def test_scale_and_top(spark):
    t = spark.createDataFrame([("a", "x", -2.0), ("a", "y", 2.0), ("a", "z", 0.0), ("b", "x", 3.0)],
                              "label string, term string, weight double")
    got = [(r["label"], r["term"], r["weight"], r["rank"]) for r in
           forest.top_terms(forest.scale_weights(t), 2).orderBy("label", "rank").collect()]
    assert got == [("a", "y", 1.0, 1), ("a", "z", 0.5, 2), ("b", "x", 0.0, 1)]


def test_samples(spark):
    ex = spark.createDataFrame([(str(i), "big" if i < 40 else "small") for i in range(45)], "id string, label string")
    one = sample.stratified_sample(ex, 10)
    n = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    assert n == {"big": 10, "small": 5}
    assert [r["id"] for r in one.collect()] == [r["id"] for r in sample.stratified_sample(ex.repartition(7), 10).collect()]
    assert sample.stratified_sample(ex, None).count() == 45
    res = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("task_id"),
                                   F.when(F.col("id") < 100, "few").otherwise("many").alias("source"),
                                   F.lit("a").alias("source_author"), F.lit("/male").alias("panel"))
    k = {r["source"]: r["count"] for r in sample.sample_results(res, "t").groupBy("source").count().collect()}
    assert k["many"] == 50 and 5 < k["few"] < 40
