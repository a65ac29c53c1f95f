"""Simulated counts and cohorts; every draw depends on a seed and its row's keys only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal(*keys: Column, seed: int) -> Column:
    """A standard normal number from keys, by Box and Muller's transform."""
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(s)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.ln(u(seed))) * F.cos(F.lit(2 * np.pi) * u(seed + 1))


def dirichlet_multinomial(obs: DataFrame, depth: int, dispersion: float, seed: int = 1) -> DataFrame:
    """Counts of ``depth`` reads in every sample around its relative abundances, with the given dispersion.

    A sample's variables are one array, so a row is bounded by their number.
    """
    whole = obs.groupBy("subject_id", "time").agg(F.sort_array(F.collect_list(F.struct("variable", "value"))).alias("cells"))
    key = F.xxhash64("subject_id", "time", F.lit(seed))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for k, cells in zip(batch.column("key").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                rng = np.random.default_rng(k % (1 << 63))
                v = np.array([c["value"] for c in cells], float)
                n = np.zeros(len(v), np.int64)
                live = v > 0
                if live.any():
                    p = rng.standard_gamma(dispersion * v[live] / v[live].sum())
                    n[live] = rng.multinomial(depth, p / p.sum() if p.sum() > 0 else v[live] / v[live].sum())
                names.append([c["variable"] for c in cells])
                counts.append(n.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("subject_id"), batch.column("time"), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["subject_id", "time", "names", "counts"])

    drawn = whole.select("subject_id", "time", key.alias("key"), "cells").mapInArrow(draw, "subject_id long, time double, names array<string>, counts array<long>")
    return drawn.select("subject_id", "time", F.explode(F.arrays_zip("names", "counts")).alias("c")).select("subject_id", "time", F.col("c.names").alias("variable"), F.col("c.counts").alias("count"))


def cohort(obs: DataFrame, samples: DataFrame, clade: list[str], start: float, end: float, size: float, seed: int = 1) -> DataFrame:
    """A cohort made of a study: every second subject (in hash order) is a case whose clade is raised in a window.

    In cases the clade's share of a sample becomes size * exp(0.1 * normal) within start..end, the others shrink to
    what is left; a sample without others stays as it is. All values are relative abundances.
    """
    w = Window.partitionBy("subject_id", "time")
    case = F.pmod(F.xxhash64("subject_id", F.lit(seed)), F.lit(2)) == 0
    inside = F.col("variable").isin(*clade)
    rel = obs.withColumn("value", F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(w)), F.lit(0.0))).withColumn("case", case)
    rel = rel.withColumn("clade_sum", F.sum(F.when(inside, F.col("value")).otherwise(0.0)).over(w)).withColumn("total", F.sum("value").over(w))
    level = F.least(F.lit(0.95), F.lit(size) * F.exp(0.1 * normal(F.col("subject_id"), F.col("time"), seed=seed + 7)))
    raised = F.when(inside, F.when(F.col("clade_sum") > 0, F.col("value") / F.col("clade_sum") * level).otherwise(level / len(clade)))
    left = F.coalesce(F.try_divide(F.col("value") * (1 - level), F.col("total") - F.col("clade_sum")), F.lit(0.0))
    hit = F.col("case") & F.col("time").between(start, end) & (F.col("total") - F.col("clade_sum") > 1e-12)
    value = F.when(hit, F.coalesce(raised, left)).otherwise(F.col("value"))
    return rel.select("subject_id", "time", "variable", value.alias("value"), F.col("case").alias("y"))


def good_windows(start: int, end: int, width: int) -> list[tuple[int, int]]:
    return [(t, t + width) for t in range(start + 1, end - width - 1)]


def noisy_times(subjects: DataFrame, start: float, end: float, n: int, noise: float, seed: int = 1) -> DataFrame:
    """(subject_id, time): n equally spaced times, shifted by clipped noise; the ends never move outward."""
    step = (end - start) / (n - 1)
    rows = subjects.select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    shift = F.greatest(F.lit(-0.249), F.least(F.lit(0.249), noise * normal(F.col("subject_id"), F.col("i"), seed=seed))) * step
    return rows.select("subject_id", F.greatest(F.lit(float(start)), F.least(F.lit(float(end)), F.lit(float(start)) + F.col("i") * step + shift)).alias("time"))


def linear_test_data(subjects: DataFrame, variables: list[str], intervals: int, timepoints: int, seed: int = 1) -> DataFrame:
    """(subject_id, time, variable, value): in each interval of [0, 1) every variable follows a line of its own."""
    rows = subjects.select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(timepoints - 1))).alias("i")).withColumn("time", F.col("i") * (0.99 / max(timepoints - 1, 1)))
    rows = rows.select("subject_id", "time", F.explode(F.array(*[F.lit(v) for v in variables])).alias("variable"))
    part = F.floor(F.col("time") * intervals)
    key = (F.col("subject_id"), F.col("variable"), part)
    within = F.col("time") * intervals - part
    return rows.select("subject_id", "time", "variable", (normal(*key, seed=seed) + normal(*key, seed=seed + 5) * within).alias("value"))


def outcomes(probabilities: DataFrame, seed: int = 1) -> DataFrame:
    """(subject_id, y) drawn from (subject_id, p)."""
    u = F.shiftrightunsigned(F.xxhash64("subject_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return probabilities.select("subject_id", (u < F.col("p")).alias("y"))
