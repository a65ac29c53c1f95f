"""Filters on variables, samples and subjects of a study's observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoset.operators.windows import blocks_of


def _kept(names: DataFrame, condition: Column, skip: tuple[str, ...]) -> DataFrame:
    return names.where(condition | F.col("variable").isin(*skip)) if skip else names.where(condition)


def high_overall_abundance(obs: DataFrame, least: float, skip: tuple[str, ...] = ()) -> DataFrame:
    """Variables whose sum over all samples is at least ``least``, or that are in ``skip``."""
    sums = obs.groupBy("variable").agg(F.sum("value").alias("total"))
    return _kept(sums, F.col("total") >= least, skip).select("variable", "total")


def select_variables(obs: DataFrame, variables: DataFrame) -> DataFrame:
    return obs.join(variables.select("variable"), "variable", "left_semi")


def select_subjects(df: DataFrame, subjects: DataFrame, invert: bool = False) -> DataFrame:
    return df.join(subjects.select("subject_id"), "subject_id", "left_anti" if invert else "left_semi")


def deep_samples(obs: DataFrame, least: float) -> DataFrame:
    """(subject_id, time, depth) of samples whose sum over variables is at least ``least``."""
    return obs.groupBy("subject_id", "time").agg(F.sum("value").alias("depth")).where(F.col("depth") >= least)


def trim(df: DataFrame, start: float, end: float) -> DataFrame:
    """Rows with start <= time <= end."""
    return df.where(F.col("time").between(start, end))


def dense_subjects(subjects: DataFrame, samples: DataFrame, start: float, end: float, intervals: int, least: int, consecutive: int = 1) -> DataFrame:
    """(subject_id, fewest) of subjects with at least ``least`` samples in every block of consecutive intervals.

    Blocks are closed on both ends, so a sample on an edge counts on both sides. A subject without samples fails.
    """
    blocks = blocks_of(start, end, intervals, consecutive)
    counts = [F.count_if(F.col("time").between(a, b)) for _, a, b in blocks]
    fewest = samples.groupBy("subject_id").agg(F.least(*counts).alias("fewest") if len(counts) > 1 else counts[0].alias("fewest"))
    joined = subjects.select("subject_id").join(fewest, "subject_id", "left").withColumn("fewest", F.coalesce("fewest", F.lit(0)).cast("long"))
    return joined.where(F.col("fewest") >= least)


def with_outcome(subjects: DataFrame, column: str) -> DataFrame:
    """Subjects whose field is there (not null, not NaN)."""
    kept = F.col(column).isNotNull()
    if dict(subjects.dtypes)[column] in ("double", "float"):
        kept = kept & ~F.isnan(column)
    return subjects.where(kept)


def longest_runs(obs: DataFrame, threshold: float) -> DataFrame:
    """(variable, subject_id, longest): the longest run of consecutive samples with value > threshold."""
    by = Window.partitionBy("variable", "subject_id").orderBy("time")
    high = F.col("value") > threshold
    rows = obs.withColumn("island", F.row_number().over(by) - F.sum(high.cast("int")).over(by)).withColumn("high", high)
    runs = rows.groupBy("variable", "subject_id", "island").agg(F.count_if("high").alias("n"))
    return runs.groupBy("variable", "subject_id").agg(F.max("n").alias("longest"))


def persistent_variables(obs: DataFrame, threshold: float, length: int = 2, subjects: int = 1, skip: tuple[str, ...] = ()) -> DataFrame:
    """Variables that stay above ``threshold`` for ``length`` consecutive samples in at least ``subjects`` subjects."""
    n = longest_runs(obs, threshold).groupBy("variable").agg(F.count_if(F.col("longest") >= length).alias("n_subjects"))
    return _kept(n, F.col("n_subjects") >= subjects, skip)


def median_deviations(obs: DataFrame) -> DataFrame:
    """(variable, median, mad): the median, and the median distance from it, over all observations."""
    middle = obs.groupBy("variable").agg(F.median("value").alias("median"))
    return obs.join(middle, "variable").groupBy("variable", "median").agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))


def varied_variables(obs: DataFrame, least_mad: float, skip: tuple[str, ...] = ()) -> DataFrame:
    return _kept(median_deviations(obs), F.col("mad") >= least_mad, skip)


def top_variance(obs: DataFrame, fraction: float) -> DataFrame:
    """(variable, variance, place) of the given fraction of variables with the largest variance, ties kept."""
    v = obs.groupBy("variable").agg(F.var_pop("value").alias("variance"))
    order = Window.orderBy(F.desc("variance"))
    ranked = v.withColumn("place", F.rank().over(order)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("place") <= F.floor(F.col("of") * fraction)).drop("of")


def spanning_subjects(subjects: DataFrame, samples: DataFrame, start: float, end: float, least: int) -> DataFrame:
    """Controls with at least ``least`` samples, the first by ``start`` and the last from ``end`` on."""
    t = samples.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    return subjects.where(~F.col("y")).select("subject_id").join(t, "subject_id").where((F.col("n") >= least) & (F.col("first") <= start) & (F.col("last") >= end))
