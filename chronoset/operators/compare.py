"""Comparison classifiers on window means, from pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.operators import metrics
from chronoset.sources.scratch import settle


def estimators(smaller_class: int, trees: int = 1024, seed: int = 1) -> dict:
    """A random forest, and an L1 logistic regression whose penalty is chosen among ten by cross-validation."""
    forest = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="features", labelCol="label")
    lasso = LogisticRegression(elasticNetParam=1.0, featuresCol="features", labelCol="label", maxIter=50)
    grid = ParamGridBuilder().addGrid(lasso.regParam, [10.0**-e for e in range(-4, 6)][:10]).build()
    folds = max(2, min(10, smaller_class))
    return {"random_forest": forest, "l1_logistic": CrossValidator(estimator=lasso, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, seed=seed)}


def with_vectors(features: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, y, label, features vector) with 0 for empty windows."""
    filled = F.transform("features", lambda v: F.coalesce(v, F.lit(0.0)))
    return features.join(subjects.select("subject_id", "y"), "subject_id").select("subject_id", "y", F.col("y").cast("double").alias("label"), array_to_vector(filled).alias("features"))


def crossvalidated(data: DataFrame, folds: DataFrame, estimator, n_folds: int) -> DataFrame:
    """(fold, subject_id, y, score) of held-out subjects; the estimator is fitted once for each fold."""
    dealt = settle(data.join(folds.select("subject_id", "fold"), "subject_id"), "dealt-folds")
    out = None
    for k in range(n_folds):
        fitted = estimator.fit(dealt.where(F.col("fold") != k))
        part = fitted.transform(dealt.where(F.col("fold") == k)).select("fold", "subject_id", "y", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


#: How a method gets its estimator: from the smaller class of the training data and settings.
METHODS: dict[str, Callable] = {}


def register(name: str, make: Callable) -> None:
    """Add a comparison method; ``make(smaller_class, **settings)`` returns an estimator of pyspark.ml."""
    METHODS[name] = make


register("random_forest", lambda smaller, **k: estimators(smaller, **k)["random_forest"])
register("l1_logistic", lambda smaller, **k: estimators(smaller, **k)["l1_logistic"])


def compared(features: DataFrame, subjects: DataFrame, *, methods: tuple[str, ...] = ("random_forest", "l1_logistic"), folds: int | None = 5, seed: int | None = None, **settings) -> DataFrame:
    """(method, fold, subject_id, y, score) of held-out subjects for each registered method.

    ``folds`` None leaves out one subject at a time. An unknown method raises KeyError before anything is fitted.
    """
    made = {m: METHODS[m] for m in methods}
    dealt = metrics.leave_one_out(subjects) if folds is None else metrics.stratified_folds(subjects, folds, seed)
    sizes = dict(subjects.groupBy("y").count().collect())  # two rows
    n_folds = sum(sizes.values()) if folds is None else folds
    data, out = with_vectors(features, subjects), None
    for name, make in made.items():
        part = crossvalidated(data, dealt, make(min(sizes.values()), **settings), n_folds).select(F.lit(name).alias("method"), "fold", "subject_id", "y", "score")
        out = part if out is None else out.unionByName(part)
    return out


def comparison(features: DataFrame, subjects: DataFrame, **settings) -> DataFrame:
    """The metrics of all methods, by fold and pooled; with ``folds`` None, pooled alone, since a fold is one subject."""
    found = metrics.report(settle(compared(features, subjects, **settings), "comparison-scores"))
    return found.where(F.col("fold").isNull()) if settings.get("folds", 5) is None else found
