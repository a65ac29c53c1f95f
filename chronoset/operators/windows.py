"""Closed time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(start: float, end: float, intervals: int) -> list[float]:
    """``intervals + 1`` equally spaced edges; the last one is exactly ``end``."""
    return [end if i == intervals else start + i * ((end - start) / intervals) for i in range(intervals + 1)]


def blocks_of(start: float, end: float, intervals: int, consecutive: int = 1) -> list[tuple[int, float, float]]:
    """(number, start, end) of all runs of ``consecutive`` intervals."""
    e = edges(start, end, intervals)
    return [(i, e[i], e[i + consecutive]) for i in range(intervals - consecutive + 1)]


def windows_of(start: float, end: float, intervals: int, shortest: float = 0.0, longest: float = float("inf")) -> list[tuple[float, float]]:
    """All pairs of edges whose distance lies within the limits."""
    e = edges(start, end, intervals)
    return [(e[i], e[j]) for i in range(len(e)) for j in range(i + 1, len(e)) if shortest <= e[j] - e[i] <= longest]


def containing(windows: list[tuple[float, float]]) -> Column:
    """An array of the windows (struct<t0, t1>) that hold ``time``: exploded, it is the range join with few windows."""
    table = F.array(*[F.struct(F.lit(float(a)).alias("t0"), F.lit(float(b)).alias("t1")) for a, b in windows])
    return F.filter(table, lambda w: F.col("time").between(w["t0"], w["t1"]))


def window_counts(subjects: DataFrame, samples: DataFrame, windows: list[tuple[float, float]]) -> DataFrame:
    """(t0, t1, fewest): the least number of samples of any subject in each window, 0 for subjects without samples.

    Every window is one conditional count, so samples are read and shuffled once, by subject.
    """
    counts = [F.count_if(F.col("time").between(a, b)).alias(f"w{i}") for i, (a, b) in enumerate(windows)]
    per = subjects.select("subject_id").join(samples.groupBy("subject_id").agg(*counts), "subject_id", "left")
    least = per.agg(*[F.min(F.coalesce(f"w{i}", F.lit(0))).alias(f"w{i}") for i in range(len(windows))])
    table = F.array(*[F.struct(F.lit(a).alias("t0"), F.lit(b).alias("t1"), F.col(f"w{i}").alias("fewest")) for i, (a, b) in enumerate(windows)])
    return least.select(F.explode(table).alias("w")).select("w.t0", "w.t1", F.coalesce("w.fewest", F.lit(0)).alias("fewest"))


def valid_windows(subjects: DataFrame, samples: DataFrame, windows: list[tuple[float, float]]) -> DataFrame:
    """(t0, t1, fewest, slope_ok) of windows in which every subject has a sample; slopes need two."""
    return window_counts(subjects, samples, windows).where(F.col("fewest") >= 1).withColumn("slope_ok", F.col("fewest") >= 2)
