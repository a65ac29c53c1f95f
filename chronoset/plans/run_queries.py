"""Queries that fit or draw: chains, cross-validation, comparison classifiers, simulators. Tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoset.operators import compare, detectors, metrics, sampling, simulate, transforms
from chronoset.plans.study_queries import mined
from chronoset.sources.studies import events_study

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def population(spark, sf_dir, most: int = 4):
    s, long, _ = mined(spark, sf_dir, 2)
    found = detectors.ordered(detectors.population(long, detectors.clustered_thresholds(long, most)))
    return s, found.join(s.variables, "variable", "left")


@query
def chain_run(spark, sf_dir):
    """Four chains over the detectors of the events study."""
    s, found = population(spark, sf_dir)
    return sampling.run_chains(found, sampling.outcome_bits(s.subjects), chains=4, iterations=40, draws=2)


@query
def cv_run(spark, sf_dir):
    """Three-fold cross-validation of the rule model: metrics of each fold."""
    s, long, _ = mined(spark, sf_dir, 2)
    folds = metrics.stratified_folds(s.subjects, 3)
    p = sampling.crossvalidate(long, folds, s.variables, n_folds=3, most_thresholds=4, iterations=20)
    return metrics.fold_table(p.select("fold", "y", F.col("probability").alias("score")))


def _features(spark, sf_dir):
    s = events_study(spark, sf_dir)
    names = sorted(r["variable"] for r in s.variables.collect())
    means = transforms.window_means(s.observations, s.start, s.end, 3, 1)
    data = compare.with_vectors(transforms.feature_vectors(means, 3, names), s.subjects)
    return data, metrics.stratified_folds(s.subjects, 3), s


@query
def random_forest_cv(spark, sf_dir):
    data, folds, _ = _features(spark, sf_dir)
    return metrics.fold_table(compare.crossvalidated(data, folds, compare.estimators(2, trees=32)["random_forest"], 3))


@query
def l1_logistic_cv(spark, sf_dir):
    data, folds, s = _features(spark, sf_dir)
    smaller = s.subjects.groupBy("y").count().agg(F.min("count")).first()[0]
    return metrics.fold_table(compare.crossvalidated(data, folds, compare.estimators(min(smaller, 3))["l1_logistic"], 3))


@query
def simulate_cohort(spark, sf_dir):
    s = events_study(spark, sf_dir)
    return simulate.cohort(s.observations, s.samples, ["click", "view"], 10.0, 20.0, 0.6)


@query
def dirichlet_multinomial(spark, sf_dir):
    return simulate.dirichlet_multinomial(events_study(spark, sf_dir).observations, 10_000, 281.0)
