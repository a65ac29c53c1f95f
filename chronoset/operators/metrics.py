"""Folds, classification metrics, panels and convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoset.operators.ordering import numbered


def stratified_folds(subjects: DataFrame, folds: int = 5, seed: int | None = None) -> DataFrame:
    """(subject_id, y, fold): positives, then negatives, dealt in turn; in order of id, or of a hash with a seed.

    Outcomes that are all alike raise ValueError.
    """
    if subjects.select("y").distinct().count() < 2:
        raise ValueError("all outcomes are alike")
    key = F.col("subject_id") if seed is None else F.xxhash64("subject_id", F.lit(seed))
    return numbered(subjects.select("subject_id", "y"), F.desc("y"), key, "subject_id").select("subject_id", "y", (F.col("place") % folds).alias("fold"))


def leave_one_out(subjects: DataFrame) -> DataFrame:
    return numbered(subjects.select("subject_id", "y"), "subject_id", name="fold")


def memberships(folds: DataFrame, n_folds: int) -> DataFrame:
    """(fold_id, subject_id, train): every subject once for each fold."""
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_folds - 1).cast("long"))).alias("fold_id")
    return folds.select("subject_id", "fold", ids).select("fold_id", "subject_id", (F.col("fold") != F.col("fold_id")).alias("train"))


def auc(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, auc): the rank sum of positives, ties sharing their mean rank. Running sums go over distinct scores."""
    counts = scores.groupBy(*by, "score").agg(F.count_if("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    mean_rank = F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2
    ranked = counts.select(*by, "pos", "n", mean_rank.alias("rank"))
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("all"))
    area = F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("all") - F.col("p"))).cast("double"))
    return sums.select(*by, area.alias("auc"))


def average_precision(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ap): precision at each distinct score, weighed by the recall it adds."""
    counts = scores.groupBy(*by, "score").agg(F.count_if("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    p = counts.select(*by, "pos", (F.sum("pos").over(upto) / F.sum("n").over(upto)).alias("precision"))
    return p.groupBy(*by).agg(F.try_divide(F.sum(F.col("precision") * F.col("pos")), F.sum("pos").cast("double")).alias("ap"))


def confusion(scores: DataFrame, threshold: float = 0.5, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at a threshold, reached (>=) or exceeded (>); rates without a denominator are 0."""
    said = F.col("score") > threshold if strict else F.col("score") >= threshold
    c = scores.groupBy(*by).agg(
        F.count_if(~said & ~F.col("y")).alias("tn"), F.count_if(said & ~F.col("y")).alias("fp"),
        F.count_if(~said & F.col("y")).alias("fn"), F.count_if(said & F.col("y")).alias("tp"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    rate(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def fold_table(scores: DataFrame) -> DataFrame:
    """Metrics for each fold and a last row 'all': medians of the rates, sums of the counts. A score above 0.5 counts."""
    rates, counts = ("auc", "ap", "f1", "mcc", "precision", "recall"), ("tn", "fp", "fn", "tp")
    m = auc(scores, ("fold",)).join(average_precision(scores, ("fold",)), "fold").join(confusion(scores, strict=True, by=("fold",)), "fold")
    m = m.select(F.col("fold").cast("string").alias("fold"), *rates, *counts)
    total = m.agg(*[F.median(c).alias(c) for c in rates], *[F.sum(c).alias(c) for c in counts]).select(F.lit("all").alias("fold"), *rates, *counts)
    return m.unionByName(total)


def report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of ``scores`` (method, fold, y, score) for each method and fold, and for all folds of a method pooled
    (fold null), from one pass over the rows.

    Rows are counted by distinct score, once for both groupings; ranks, precision and counts follow from running sums
    over these. A score above the threshold counts as a yes; rates without a denominator are 0, the area is null if a
    group's outcomes are all alike.
    """
    sets = [[F.col(c) for c in ("method", "fold", "score")], [F.col(c) for c in ("method", "score")]]
    counts = scores.groupingSets(sets, "method", "fold", "score").agg(F.grouping("fold").alias("pooled"), F.count_if("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    by = ("method", "fold", "pooled")
    rising = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    falling = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.coalesce(F.sum("n").over(rising), F.lit(0)) + (F.col("n") + 1) / 2
    precision = F.sum("pos").over(falling) / F.sum("n").over(falling)
    run = counts.select(*by, "score", "pos", "n", rank.alias("rank"), precision.alias("at"))
    yes, zero = F.col("score") > threshold, F.lit(0)
    pick = lambda c, where: F.sum(F.when(where, c).otherwise(zero))
    per = run.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum(F.col("at") * F.col("pos")).alias("gained"),
                               pick(F.col("n") - F.col("pos"), ~yes).alias("tn"), pick(F.col("n") - F.col("pos"), yes).alias("fp"), pick(F.col("pos"), ~yes).alias("fn"), pick(F.col("pos"), yes).alias("tp"))
    p, tp, fp, fn, tn = (F.col(c).cast("double") for c in ("p", "tp", "fp", "fn", "tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select("method", "fold", "n", F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * (F.col("n") - p)).alias("auc"), F.try_divide(F.col("gained"), p).alias("ap"),
                      rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), "tn", "fp", "fn", "tp")


def rank_panel(long: DataFrame) -> DataFrame:
    """(t0, t1, variable, type, subject_id, rank): ranks of subjects within a window, ties sharing their mean."""
    w = Window.partitionBy("t0", "t1", "variable", "type")
    ties = F.count(F.lit(1)).over(Window.partitionBy("t0", "t1", "variable", "type", "value"))
    return long.select("t0", "t1", "variable", "type", "subject_id", (F.rank().over(w.orderBy("value")) + (ties - 1) / 2).alias("rank"))


def _entropy(*counts: Column) -> Column:
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(0.0) for c in counts]
    return sum(terms[1:], terms[0])


def mi_panel(long: DataFrame, subjects: DataFrame) -> DataFrame:
    """(t0, t1, variable, type, upto, nmi): mutual information of y and rank <= upto, normalised by the mean entropy.

    ``upto`` takes the distinct ranks below the largest; sums run over distinct values.
    """
    ranked = rank_panel(long).join(subjects.select("subject_id", "y"), "subject_id")
    key = ("t0", "t1", "variable", "type")
    c = ranked.groupBy(*key, F.col("rank").alias("upto")).agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q"))
    run = Window.partitionBy(*key).orderBy("upto").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*key)
    c = c.select(*key, "upto", F.sum("p").over(run).alias("a"), F.sum("q").over(run).alias("b"), F.sum("p").over(every).alias("pos"), F.sum("q").over(every).alias("neg"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    d, e = F.col("pos") - a, F.col("neg") - b
    mutual = _entropy(a + b, d + e) + _entropy(F.col("pos").cast("double"), F.col("neg").cast("double")) - _entropy(a, b, d, e)
    half = (_entropy(a + b, d + e) + _entropy(F.col("pos").cast("double"), F.col("neg").cast("double"))) / 2
    return c.where(d + e > 0).select(*key, "upto", F.try_divide(mutual, half).alias("nmi"))


def split_rhat(traces: DataFrame, every: int = 250) -> DataFrame:
    """(parameter, upto, rhat) of traces (chain, iteration, parameter, value), iterations from 0 without gaps.

    Each chain is split in halves, the first without its last row. At every multiple ``upto`` of ``every`` that the
    first halves reach, the first upto - 1 rows of all halves are compared: variance between them and within them.
    """
    length = traces.groupBy("chain").agg((F.max("iteration") + 1).alias("n"))
    halves = traces.join(F.broadcast(length), "chain").withColumn("half", F.floor(F.col("n") / 2))  # a row for each chain
    second = F.col("iteration") >= F.col("half")
    at = F.col("iteration") - F.when(second, F.col("half")).otherwise(0)
    halves = halves.where(second | (F.col("iteration") < F.col("half") - 1)).select("chain", "parameter", "value", second.alias("second"), (F.floor((at + 1) / every) + 1).alias("part"))
    # the rows before a cut are those of the parts up to it: a part adds count, mean and squares about the mean to what is before
    of = ("chain", "second", "parameter")
    parts = halves.groupBy(*of, "part").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    upto = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.first("m", ignorenulls=True).over(Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shift = F.coalesce(F.col("m") - F.col("middle"), F.lit(0.0))
    sums = parts.withColumn("middle", middle).select(*of, "part", "middle", F.sum("n").over(upto).alias("n"), F.sum(F.col("n") * shift).over(upto).alias("s"), F.sum(F.col("n") * (F.coalesce("v", F.lit(0.0)) + shift * shift)).over(upto).alias("q"))
    reach = length.agg(F.min(F.floor(F.col("n") / 2) - 1).alias("reach"))
    run = sums.join(F.broadcast(reach), F.col("part") * every <= F.col("reach"))  # one row
    mean, spread = F.try_divide(F.col("s"), F.col("n")), F.try_divide(F.col("q") - F.col("s") * F.try_divide(F.col("s"), F.col("n")), F.col("n") - 1)
    per = run.select(*of, (F.col("part") * every).alias("upto"), (F.col("middle") + mean).alias("mean"), F.greatest(spread, F.when(spread.isNotNull(), 0.0)).alias("var"))
    n = (F.col("upto") - 1).cast("double")
    both = per.groupBy("parameter", "upto").agg(F.var_samp("mean").alias("vm"), F.avg("var").alias("w"))
    return both.select("parameter", "upto", F.sqrt(F.try_divide((n - 1) / n * F.col("w") + F.col("vm"), F.col("w"))).alias("rhat"))
