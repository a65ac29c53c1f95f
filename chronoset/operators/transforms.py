"""Value transforms of observations, and feature tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoset.operators.ordering import numbered
from chronoset.operators.windows import blocks_of

SAMPLE = ("subject_id", "time")


def exponentiate(obs: DataFrame) -> DataFrame:
    return obs.withColumn("value", F.exp("value"))


def log_transform(obs: DataFrame, offset: float = 1e-6, tolerance: float = 1e-10) -> DataFrame:
    """Natural log; values below ``tolerance`` count as ``offset``."""
    return obs.withColumn("value", F.ln(F.when(F.col("value") < tolerance, offset).otherwise(F.col("value"))))


def relative_abundance(obs: DataFrame) -> DataFrame:
    """Values by the sum of their sample; null in a sample that sums to 0."""
    total = F.sum("value").over(Window.partitionBy(*SAMPLE))
    return obs.withColumn("value", F.try_divide(F.col("value"), total))


def internal_normalization(obs: DataFrame, names: tuple[str, ...], reject: float | None = 1e-6) -> DataFrame:
    """Values by the sum of the named variables in their sample.

    Names that occur nowhere raise ValueError, and so do samples whose sum is at most ``reject``; None turns both
    checks off, which saves two actions, and then such samples are null.
    """
    total = F.sum(F.when(F.col("variable").isin(*names), F.col("value")).otherwise(0.0)).over(Window.partitionBy(*SAMPLE))
    scaled = obs.withColumn("of", total)
    if reject is not None:
        known = {r[0] for r in obs.where(F.col("variable").isin(*names)).select("variable").distinct().collect()}
        if missing := set(names) - known:
            raise ValueError(f"no such variables: {', '.join(sorted(missing))}")
        low = scaled.where(F.col("of") <= reject).select(*SAMPLE).distinct().orderBy(*SAMPLE).limit(5).collect()
        if low:
            raise ValueError("too little of the normalising variables in " + "; ".join(f"{r[0]} at {r[1]}" for r in low))
    return scaled.withColumn("value", F.try_divide(F.col("value"), F.col("of"))).drop("of")


def window_means(obs: DataFrame, start: float, end: float, intervals: int, consecutive: int) -> DataFrame:
    """(subject_id, window, variable, value): means over all blocks of consecutive intervals; no row for empty ones."""
    blocks = F.array(*[F.struct(F.lit(i).alias("window"), F.lit(a).alias("t0"), F.lit(b).alias("t1")) for i, a, b in blocks_of(start, end, intervals, consecutive)])
    inside = F.filter(blocks, lambda w: F.col("time").between(w["t0"], w["t1"]))
    return obs.select("subject_id", "variable", "value", F.explode(inside).alias("w")).groupBy("subject_id", F.col("w.window").alias("window"), "variable").agg(F.avg("value").alias("value"))


def feature_vectors(means: DataFrame, windows: int, variables: list[str]) -> DataFrame:
    """(subject_id, features): an array with windows as the major and variables as the minor order, null where empty."""
    cells = [F.max(F.when((F.col("window") == w) & (F.col("variable") == v), F.col("value"))) for w in range(windows) for v in variables]
    return means.groupBy("subject_id").agg(F.array(*cells).alias("features"))


def shuffled_labels(subjects: DataFrame, seed: int) -> DataFrame:
    """Subjects with outcomes dealt anew: the i-th subject in one random order gets that of the i-th in another."""
    a = numbered(subjects.drop("y"), F.xxhash64("subject_id", F.lit(seed)), "subject_id", name="n")
    b = numbered(subjects.select("subject_id", "y"), F.xxhash64("subject_id", F.lit(seed + 1)), "subject_id", name="n")
    return a.join(b.select("n", "y"), "n").drop("n")


def exclusive_sisters(obs: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """For each pair (left, right) of sister leaves and each subject, one of the two is set to zero at random."""
    coin: Column = F.pmod(F.xxhash64("subject_id", "left", F.lit(seed)), F.lit(2)) == 0
    sides = pairs.select("left", F.col("left").alias("variable"), F.lit(True).alias("is_left")).union(pairs.select("left", F.col("right"), F.lit(False)))
    joined = obs.join(sides, "variable", "left")
    zero = F.col("left").isNotNull() & (coin == F.col("is_left"))
    return joined.withColumn("value", F.when(zero, F.lit(0.0)).otherwise(F.col("value"))).drop("left", "is_left")


def dirichlet_noise(obs: DataFrame, noise: float, zero_threshold: float, seed: int) -> DataFrame:
    """Each sample's values drawn anew from the Dirichlet distribution around them.

    Its parameters are ``noise`` times the values, of which none counts less than ``zero_threshold``. A draw is a row's
    gamma variate, by a hash of its keys and the seed, over the sum of its sample's, so rows are drawn apart.
    """
    shape = F.lit(float(noise)) * F.greatest(F.col("value"), F.lit(float(zero_threshold)))
    keyed = obs.withColumn("__shape", shape).withColumn("__key", F.xxhash64("subject_id", "time", "variable", F.lit(seed)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("__key").to_numpy(), batch.column("__shape").to_numpy(), strict=True)
            drawn = np.array([np.random.Generator(np.random.Philox(key=int(k) % (1 << 63))).standard_gamma(a) for k, a in pairs], float)
            columns = {n: batch.column(n) for n in batch.schema.names if not n.startswith("__")} | {"value": pa.array(drawn)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    drawn = keyed.mapInArrow(draw, obs.schema)
    whole = Window.partitionBy(*SAMPLE).orderBy("variable").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # reruns add up alike
    return drawn.withColumn("value", F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(whole)), F.lit(0.0)))
