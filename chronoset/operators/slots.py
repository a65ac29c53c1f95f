"""Slot priors by Monte Carlo: hyperparameters are drawn, and every detector's share is averaged over the draws."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoset.functions.model import Hyper
from chronoset.operators.ordering import numbered
from chronoset.sources.scratch import settle

#: Pairs of a block, and cells of draws and pairs that are held at once.
PAIRS, CELLS = 4096, 1 << 18


def _uniform(index: Column, seed: int, salt: int) -> Column:
    """A number in (0, 1) that depends on its arguments only."""
    return (F.shiftrightunsigned(F.xxhash64(index, F.lit(seed), F.lit(salt)), 12) + 0.5) / F.lit(float(1 << 52))


def hyper_draws(spark: SparkSession, n: int, scale: DataFrame, hyper: Hyper = Hyper(), seed: int = 1) -> DataFrame:
    """(draw, mean, std, fraction, concentration): ``n`` draws of the hyperparameters from their priors.

    ``scale`` is the row of :func:`chronoset.functions.model.phylogeny_scale`. The mean is normal about the centre of
    the log weights, std and the fraction are uniform, the concentration is exponential.
    """
    i = F.col("id")
    normal = F.sqrt(-2.0 * F.ln(_uniform(i, seed, 1))) * F.cos(2.0 * pi * _uniform(i, seed, 2))
    rows = spark.range(n).crossJoin(F.broadcast(scale.select("centre", "mean_variance", "std_bound")))  # one row
    return rows.select(F.col("id").alias("draw"), (F.col("centre") + F.sqrt("mean_variance") * normal).alias("mean"), (F.col("std_bound") * _uniform(i, seed, 3)).alias("std"),
                       _uniform(i, seed, 4).alias("fraction"), (-hyper.concentration_typical * F.ln(_uniform(i, seed, 5))).alias("concentration"))


def slot_priors(detectors: DataFrame, draws: DataFrame, total: float, *, epsilon: float = 0.01, most_lost: float = 0.01, batch: int = 2000) -> DataFrame:
    """``detectors`` (weight, duration, ...) with prior, the mean share of a detector over the draws, and its standard error.

    Detectors of equal weight and duration have equal shares, so distinct pairs stand for them, with their numbers.
    So do distinct draws for equal ones. Blocks of ``batch`` draws meet blocks of ``PAIRS`` pairs as arrays, twice: first
    each gives its part of the draws' log-sum-exp over all pairs, then counts, means and squares of the pairs' shares.
    Draws without a finite total are left out; if more than ``most_lost`` of them are, ValueError.
    """
    d = F.col("duration") / ((1.0 + epsilon) * total)
    pairs = numbered(detectors.groupBy("weight", "duration").agg(F.count(F.lit(1)).alias("n")), "weight", "duration", name="pair")
    sizes = pairs.select("pair", "n", F.ln("weight").alias("log"), F.ln(d).alias("up"), F.ln(1 - d).alias("down")).where("log is not null and up is not null and down is not null")
    blocks = settle(sizes.groupBy(F.floor(F.col("pair") / PAIRS).alias("block")).agg(F.collect_list(F.struct("pair", "n", "log", "up", "down")).alias("p")), "slot-pairs")
    hyper = ("mean", "std", "fraction", "concentration")
    kinds = numbered(draws.groupBy(*hyper).agg(F.count(F.lit(1)).alias("m")), *hyper, name="draw")
    ab = [(F.col("concentration") * x - 1).alias(k) for k, x in (("a", F.col("fraction")), ("b", 1 - F.col("fraction")))]
    usable = kinds.select("draw", "m", "mean", "std", *ab).where("a is not null and b is not null and mean is not null and std != 0")

    met = _blocks_met(blocks, usable.withColumn("norm", F.lit(0.0)), batch)
    tops = met.mapInArrow(_totals, "draw bigint, top double, sum double")
    each = tops.groupBy("draw").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "sum")).alias("parts"))  # a part for each block of pairs
    whole = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["sum"] * F.exp(x["top"] - F.col("top")))
    norms = each.select("draw", (F.col("top") + F.ln(whole)).alias("norm"))
    finite = settle(usable.join(norms.where(F.col("norm").isNotNull() & ~F.isnan("norm") & (F.abs("norm") < float("inf"))), "draw"), "slot-norms")
    held, wanted = (df.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] for df in (finite, kinds))
    if wanted - held > most_lost * wanted:
        raise ValueError(f"{wanted - held} of {wanted} draws have no finite total")
    shares = _blocks_met(blocks, finite, batch).mapInArrow(_shares, "pair bigint, m double, mean double, squares double")
    each = shares.groupBy("pair").agg(F.collect_list(F.struct("m", "mean", "squares")).alias("parts"), (F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("prior"), F.sum("m").alias("m"))  # a part for each task
    squares = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["squares"] + x["m"] * (x["mean"] - F.col("prior")) * (x["mean"] - F.col("prior")))
    per = each.select("pair", "prior", F.when(F.col("m") > 1, F.sqrt(squares / (F.col("m") - 1)) / F.sqrt("m")).alias("standard_error"))
    return detectors.join(pairs.join(per, "pair", "left").select("weight", "duration", "prior", "standard_error"), ["weight", "duration"])


def _blocks_met(blocks: DataFrame, draws: DataFrame, batch: int) -> DataFrame:
    """A row of arrays for each block of pairs and each of ``batch`` draws."""
    names = ("draw", "m", "mean", "std", "a", "b", "norm")
    packs = settle(draws.groupBy(F.floor(F.col("draw") / batch).alias("pack")).agg(F.collect_list(F.struct(*names)).alias("h")), "slot-draws")
    dealt = blocks.crossJoin(packs.select("pack"))
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(packs, "pack").repartition(n, "block", "pack")
    return met.select("block", *[F.col(f"p.{c}").alias(c) for c in ("pair", "n", "log", "up", "down")], *[F.col(f"h.{c}").alias(c) for c in names])


def _met(batches):
    """For each row the arrays by name, and slices of the draws with the logs of their densities, of a bounded size."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            x = {c: row.column(c).flatten().to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "block"}
            step = max(1, CELLS // max(len(x["pair"]), 1))
            for k in range(0, len(x["draw"]), step):
                at = slice(k, k + step)
                with np.errstate(all="ignore"):
                    raw = (x["log"] - x["mean"][at, None]) / x["std"][at, None]
                    raw *= raw
                    raw *= -0.5
                    raw += x["a"][at, None] * x["up"] + x["b"][at, None] * x["down"]
                yield row.column("block")[0].as_py(), x, at, raw


def _totals(batches):
    for _, x, at, raw in _met(batches):
        with np.errstate(all="ignore"):
            top = raw.max(axis=1)
            raw -= top[:, None]
            sums = np.exp(raw, out=raw) @ x["n"].astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(x["draw"][at]), pa.array(top), pa.array(sums)], ["draw", "top", "sum"])


def _shares(batches):
    held = {}
    for block, x, at, raw in _met(batches):
        raw -= x["norm"][at, None]
        share, m = np.exp(raw, out=raw), x["m"][at].astype(float)
        n = m.sum()
        mean = m @ share / n
        share -= mean
        squares = m @ np.square(share, out=share)
        if block in held:
            pair, n0, mean0, squares0 = held[block]
            off = mean - mean0
            held[block] = (pair, n0 + n, mean0 + off * (n / (n0 + n)), squares0 + squares + off * off * (n0 * n / (n0 + n)))
        else:
            held[block] = (x["pair"], n, mean, squares)
    for pair, n, mean, squares in held.values():  # of the blocks of pairs in the task
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(pair), n)), pa.array(mean), pa.array(squares)], ["pair", "m", "mean", "squares"])
