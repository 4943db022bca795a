"""Text classifiers on Spark ML: random forest, and term weights by logistic regression."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill import constants
from panelmill.operators.features import tokens


#: The deepest trees that Spark grows; unlimited ones are not offered.
MAX_DEPTH = 30


def _feature_stages(docs: DataFrame, max_features: int, min_df: float) -> list:
    """Fitted stages tokens -> unit-length tf-idf vectors with idf = ln((1+n)/(1+df)) + 1.

    Spark's IDF gives ln((1+n)/(1+df)); its weights plus one scale the counts.
    """
    cv = CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=max_features, minDF=float(min_df)).fit(docs)
    counted = cv.transform(docs)
    base = IDF(inputCol="tf", outputCol="_idf").fit(counted)
    weights = [w + 1.0 for w in base.idf.toArray()]
    scale = ElementwiseProduct(inputCol="tf", outputCol="_scaled", scalingVec=Vectors.dense(weights))
    norm = Normalizer(inputCol="_scaled", outputCol="features", p=2.0)
    return [cv, scale, norm]


def with_tokens(docs: DataFrame, target: str = "content", stop_words: Sequence[str] | None = None) -> DataFrame:
    return docs.withColumn("tokens", tokens(target, stop_words))


def train_forest(examples: DataFrame, target: str = "content", trees: int = constants.FOREST_TREES,
                 max_features: int = constants.FOREST_MAX_FEATURES, min_df: float = constants.FOREST_MIN_DF,
                 stop_words: Sequence[str] | None = None, seed: int = 0, max_depth: int = MAX_DEPTH) -> PipelineModel:
    """Random forest over TF-IDF for one label per text (column ``label``)."""
    docs = with_tokens(examples, target, stop_words)
    stages = _feature_stages(docs, max_features, min_df)
    labels = StringIndexer(inputCol="label", outputCol="_label", handleInvalid="skip",
                           stringOrderType="alphabetAsc").fit(docs)
    vectors = PipelineModel(stages + [labels]).transform(docs)
    rf = RandomForestClassifier(labelCol="_label", featuresCol="features", numTrees=trees, seed=seed,
                                maxDepth=max_depth, cacheNodeIds=True, maxMemoryInMB=512).fit(vectors)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)
    return PipelineModel(stages + [rf, back])


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def predict(model: PipelineModel, docs: DataFrame, target: str = "content",
            stop_words: Sequence[str] | None = None) -> DataFrame:
    """Add ``predicted`` and ``probabilities``, an array of (label, p)."""
    names = class_names(model)
    out = model.transform(with_tokens(docs, target, stop_words))
    p = vector_to_array("probability")
    probs = F.array(*[F.struct(F.lit(n).alias("label"), p[i].alias("p")) for i, n in enumerate(names)])
    return out.withColumn("probabilities", probs).select(*docs.columns, "predicted", "probabilities")


def train_forest_multilabel(examples: DataFrame, classes: Sequence[str], target: str = "content",
                            trees: int = constants.FOREST_TREES, max_features: int = constants.FOREST_MAX_FEATURES,
                            min_df: float = constants.FOREST_MIN_DF, stop_words: Sequence[str] | None = None,
                            seed: int = 0, max_depth: int = MAX_DEPTH) -> tuple[PipelineModel, dict[str, Transformer]]:
    """One binary forest per class of the array column ``labels``; the vectors are made once."""
    docs = with_tokens(examples, target, stop_words)
    features = PipelineModel(_feature_stages(docs, max_features, min_df))
    vectors = features.transform(docs).select("id", "labels", "features").cache()
    forests = {}
    for c in classes:
        y = vectors.withColumn("y", F.array_contains("labels", c).cast("double"))
        forests[c] = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, seed=seed,
                                            maxDepth=max_depth, maxMemoryInMB=512).fit(y)
    vectors.unpersist()
    return features, forests


def predict_multilabel(features: PipelineModel, forests: dict[str, Transformer], docs: DataFrame,
                       target: str = "content", stop_words: Sequence[str] | None = None) -> DataFrame:
    """Add ``predicted`` (labels with p > 0.5) and ``probabilities``."""
    out = features.transform(with_tokens(docs, target, stop_words)).select(*docs.columns, "features")
    for i, model in enumerate(forests.values()):
        m = model.copy().setPredictionCol(f"_y_{i}").setProbabilityCol(f"_p_{i}").setRawPredictionCol(f"_r_{i}")
        out = m.transform(out).withColumn(f"_p_{i}", vector_to_array(f"_p_{i}")[1]).drop(f"_y_{i}", f"_r_{i}")
    probs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_p_{i}").alias("p")) for i, c in enumerate(forests)])
    out = out.withColumn("probabilities", probs)
    picked = F.transform(F.filter("probabilities", lambda x: x["p"] > 0.5), lambda x: x["label"])
    return out.withColumn("predicted", picked).select(*docs.columns, "predicted", "probabilities")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_term_weights(examples: DataFrame, classes: Sequence[str], target: str = "content",
                       max_features: int = constants.TERM_MAX_FEATURES, min_df: float = constants.TERM_MIN_DF,
                       stop_words: Sequence[str] | None = None, reg: float = 1e-4, max_iter: int = 50) -> DataFrame:
    """(label, term, weight): per class of ``labels`` the coefficients of a balanced logistic regression
    of that class against the rest, scaled to [0, 1]."""
    spark = examples.sparkSession
    docs = with_tokens(examples, target, stop_words)
    stages = _feature_stages(docs, max_features, min_df)
    vectors = PipelineModel(stages).transform(docs).select("labels", "features").cache()
    total = vectors.count()
    terms = stages[0].vocabulary
    parts = []
    for c in classes:
        y = F.array_contains("labels", c).cast("double")
        pos = vectors.agg(F.sum(y)).first()[0] or 0.0
        if pos in (0.0, float(total)):
            raise ValueError(f"label {c!r} needs examples with and without it")
        weight = F.when(y == 1.0, total / (2.0 * pos)).otherwise(total / (2.0 * (total - pos)))
        lr = LogisticRegression(labelCol="y", weightCol="w", elasticNetParam=constants.TERM_L1_RATIO,
                                regParam=reg, maxIter=max_iter)
        coef = lr.fit(vectors.withColumn("y", y).withColumn("w", weight)).coefficients.toArray()
        parts.append((c, coef))
    vectors.unpersist()
    # At most max_features coefficients per class: the size of the model, not of the data.
    rows = [(c, t, float(w)) for c, coef in parts for t, w in zip(terms, coef)]
    return scale_weights(spark.createDataFrame(rows, "label string, term string, weight double"))


def scale_weights(terms: DataFrame) -> DataFrame:
    """Min-max scaling to [0, 1] per label, five places; a constant label gets zeros."""
    span = terms.groupBy("label").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return (terms.join(span, "label")
                 .select("label", "term", F.round(F.coalesce(scaled, F.lit(0.0)), 5).alias("weight")))


def top_terms(terms: DataFrame, k: int | None = None) -> DataFrame:
    """Terms of each label by descending weight with their rank; the first ``k`` if given."""
    w = Window.partitionBy("label").orderBy(F.col("weight").desc(), "term")
    ranked = terms.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
