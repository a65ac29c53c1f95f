"""Subsamples of subjects and time points, each smaller one nested in the larger ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoset.operators.ordering import numbered
from chronoset.sources.scratch import settle


def shuffled(seed: int) -> Column:
    """A hash of subject_id that other engines know too; orders by it are random and repeatable."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("subject_id").cast("string")))


def draw_subjects(subjects: DataFrame, share: float, seed: int) -> DataFrame:
    """``subjects`` (subject_id, ...) less all but the first ``share`` of them in a random order."""
    rows = numbered(subjects, shuffled(seed), "subject_id")
    n = rows.agg(F.count(F.lit(1)).alias("__of"))
    return rows.crossJoin(F.broadcast(n)).where(F.col("place") + 1 <= share * F.col("__of")).drop("place", "__of")  # one row


def nested_subjects(subjects: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(size, subject_id, y): for each size half of it, rounded up, without the outcome, and the rest with it.

    Subjects of an outcome are drawn in one random order, so smaller samples are parts of larger ones. A size beyond
    the number of subjects, or of those with an outcome, raises ValueError.
    """
    known = dict(subjects.groupBy("y").count().collect())  # two rows
    for size in sizes:
        for y, wanted in ((False, -(-size // 2)), (True, size // 2)):
            if wanted > known.get(y, 0):
                raise ValueError(f"{size} subjects need {wanted} with outcome {y}, there are {known.get(y, 0)}")
    placed = numbered(subjects.select("subject_id", "y"), "y", shuffled(seed), "subject_id")
    controls = known.get(False, 0)
    at = F.when(F.col("y"), F.col("place") - controls).otherwise(F.col("place"))
    wanted = F.array(*[F.struct(F.lit(s).cast("long").alias("size"), F.lit(-(-s // 2)).alias("controls"), F.lit(s // 2).alias("cases")) for s in sizes])
    inside = F.filter(wanted, lambda w: F.when(F.col("y"), at < w["cases"]).otherwise(at < w["controls"]))
    return placed.select("subject_id", "y", F.explode(inside).alias("w")).select("w.size", "subject_id", "y")


def _pairwise(points: Column) -> Column:
    """The sum of 1 / distance² over all pairs of positions."""
    term = lambda i, x: F.aggregate(F.slice(points, i + 2, F.size(points)), F.lit(0.0), lambda s, y: s + 1.0 / ((y - x) * (y - x)))
    return F.aggregate(F.transform(points, lambda x, i: term(i, x)), F.lit(0.0), lambda s, x: s + x)


def even_choices(positions: DataFrame, size: int, n: int) -> DataFrame:
    """(subject_id, chosen): the ``size`` of each subject's sorted ``positions`` (array) that lie most evenly.

    All combinations, made by growing sorted lists element by element, are scored by the sum of 1 / distance² over all
    pairs, with -1 and ``n`` + 1 as ends; the first one in lexicographic order wins ties. A subject's combinations are
    rows that are reduced as they are made. Subjects with fewer positions get none.
    """
    grown = positions.where(F.size("positions") >= size).select("subject_id", "positions", F.array().cast("array<bigint>").alias("chosen"), F.lit(0).alias("upto"))
    for k in range(size):
        # the place of the next position, leaving enough for those that follow
        nexts = F.explode(F.sequence(F.col("upto"), F.size("positions") - (size - k)))
        grown = grown.select("subject_id", "positions", "chosen", nexts.alias("at")).select("subject_id", "positions", F.concat("chosen", F.array(F.element_at("positions", F.col("at") + 1))).alias("chosen"), (F.col("at") + 1).alias("upto"))
    ends = F.concat(F.array(F.lit(-1).cast("long")), F.col("chosen"), F.array(F.lit(n + 1).cast("long")))
    scored = grown.select("subject_id", "chosen", F.round(_pairwise(F.transform(ends, lambda x: x.cast("double"))), 12).alias("cost"))
    return scored.groupBy("subject_id").agg(F.min(F.struct("cost", "chosen")).alias("best")).select("subject_id", "best.chosen")


def nested_timepoints(samples: DataFrame, sizes: list[int], of: int | None = None) -> DataFrame:
    """(subject_id, size, position): evenly spread samples of each subject for each size, the largest first, each chosen
    among those of the size before.

    Positions are the places of a subject's samples in time, from 0; ``of`` is their number, by default each
    subject's own is not looked at and the largest one counts for all.
    """
    counts = settle(samples.groupBy("subject_id").agg(F.count(F.lit(1)).alias("__n")), "sample-counts")
    n = of if of is not None else counts.agg(F.max("__n")).first()[0] or 0
    held = counts.select("subject_id", F.least("__n", F.lit(n)).alias("__n")).where(F.col("__n") > 0)
    # what is chosen depends on the number of samples alone, of which there are few
    kinds = held.select(F.col("__n").alias("subject_id")).distinct().withColumn("positions", F.sequence(F.lit(0).cast("long"), F.col("subject_id") - 1))
    parts = []
    for size in sorted(sizes, reverse=True):
        chosen = settle(even_choices(kinds, size, n), "even-choices")
        parts.append(chosen.select(F.col("subject_id").alias("__n"), F.lit(size).cast("long").alias("size"), "chosen"))
        kinds = chosen.withColumnRenamed("chosen", "positions")
    found = held.join(F.broadcast(reduce(DataFrame.unionByName, parts)), "__n")  # a row for each number of samples and size
    return found.select("subject_id", "size", F.explode("chosen").alias("position"))


def grid(subjects: DataFrame, samples: DataFrame, subject_sizes: list[int], point_sizes: list[int], seed: int, of: int | None = None) -> DataFrame:
    """(n_subjects, n_points, subject_id, position): every number of subjects with every number of time points."""
    people = nested_subjects(subjects, subject_sizes, seed)
    points = nested_timepoints(samples.join(subjects.select("subject_id"), "subject_id", "left_semi"), point_sizes, of)
    return people.join(points.withColumnRenamed("size", "n_points"), "subject_id").select(F.col("size").alias("n_subjects"), "n_points", "subject_id", "position")
