"""Chains over mined detectors, one Spark task for each chain or fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.functions.chain import Chain
from chronoset.functions.model import Hyper
from chronoset.operators import detectors
from chronoset.sources.scratch import settle

STATES = "chain long, iteration long, length long, n_rules long, rules string, log_lik double, log_prior double, mean double, std double, fraction double, concentration double, empty double, beta array<double>"


def _chain(pdf: pd.DataFrame, truths: np.ndarray, y: np.ndarray, seed: int, prior_only: bool, hyper: Hyper = Hyper()) -> Chain:
    """A chain over detectors (rows of ``pdf`` and ``truths``) and the outcomes ``y`` of subjects."""
    keys = [tuple(r) for r in pdf[["t0", "t1", "variable", "type", "threshold", "direction"]].itertuples(index=False)]
    at = {k: i for i, k in enumerate(keys)}
    inverse = np.array([at[(*k[:5], "below" if k[5] == "above" else "above")] for k in keys])
    span = float((pdf["t1"].max() - pdf["t0"].min()) or 1.0)
    logs = np.log(pdf["weight"].to_numpy(float))
    delta = max(float(logs.max() - np.percentile(logs, 2.5)), 1e-3)
    first = int(np.argmin([(t != y).sum() for t in truths]))
    return Chain(truths, logs, ((pdf["t1"] - pdf["t0"]) / span).to_numpy(float), inverse, y.astype(float), [[first]], np.random.default_rng(seed), delta, float(np.median(logs)), hyper, prior_only)


def run_chains(population: DataFrame, outcome_bits: str, *, chains: int = 4, iterations: int = 100, seed: int = 1, draws: int = 10, prior_only: bool = False, hyper: Hyper = Hyper()) -> DataFrame:
    """States of independent chains over ``population`` (detector_id, key, threshold, direction, bits, weight).

    ``outcome_bits`` are the outcomes in subject order, one bit for each subject. Each chain is one group whose size
    is that of the population; chain i starts from seed + i, so reruns repeat.
    """
    dealt = population.withColumn("outcome", F.lit(outcome_bits)).withColumn("chain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chains - 1).cast("long"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["chain"].iloc[0])
        pdf = pdf.sort_values("detector_id").reset_index(drop=True)
        truths = np.array([np.frombuffer(b.encode(), np.uint8) == 49 for b in pdf["bits"]])
        chain = _chain(pdf, truths, np.frombuffer(pdf["outcome"].iloc[0].encode(), np.uint8) == 49, seed + number, prior_only, hyper)
        rows = []
        for it in range(iterations):
            chain.step(draws)
            rules = "/".join("+".join(map(str, r)) for r in chain.rules)
            rows.append((number, it, sum(map(len, chain.rules)), len(chain.rules), rules, chain.log_likelihood(), chain.prior(), chain.mean, chain.std, chain.fraction, chain.concentration, chain.empty, list(map(float, chain.beta))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])

    return dealt.groupBy("chain").applyInPandas(run, STATES)


def outcome_bits(subjects: DataFrame) -> str:
    """One bit for each subject, in subject order."""
    return "".join("1" if r["y"] else "0" for r in subjects.select("subject_id", "y").orderBy("subject_id").collect())


def crossvalidate(long: DataFrame, folds: DataFrame, weights: DataFrame, *, n_folds: int, most_thresholds: int = 10, iterations: int = 60, seed: int = 1, burn_in: float = 0.3) -> DataFrame:
    """(fold, subject_id, y, probability): ensemble probabilities of held-out subjects, one task for each fold.

    Detector values of training subjects are mined again within the fold; windows stay as they are. The values of one key
    are one group, from which the truths of its detectors in all folds come, eight to a byte. A fold's chain gets these:
    its memory is a byte for each detector and subject. Every subject needs a value of every key, else ValueError.
    """
    mined = long.join(folds.select("subject_id", F.col("fold").alias("own")), "subject_id").select(*detectors.KEY, "subject_id", "value", "own")

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in detectors.KEY]
        pdf = pdf.sort_values("subject_id")
        v, own = pdf["value"].to_numpy(float), pdf["own"].to_numpy()
        rows = []
        for fold in range(n_folds):
            train, test = v[own != fold], v[own == fold]
            x, sizes = np.unique(train, return_counts=True)
            if len(train) > most_thresholds + 1:
                edge = np.nonzero(np.diff(detectors.average_linkage_cut(x, most_thresholds + 1, sizes)))[0]
                cuts = np.unique(0.5 * (x[edge] + x[edge + 1]))
            else:
                cuts = np.unique(np.concatenate([0.5 * (x[:-1] + x[1:]), x[sizes > 1]]))
            rows += [(fold, *key, float(t), np.packbits(train > t).tobytes(), np.packbits(test > t).tobytes(), len(train), len(test)) for t in cuts]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in kinds.split(", ")])

    kinds = "fold long, " + ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in detectors.KEY) + ", threshold double, train binary, test binary, n_train long, n_test long"
    # truths of one key and fold are rows; they are settled, as they are made from groups of all subjects
    found = settle(mined.groupBy(*detectors.KEY).applyInPandas(mine, kinds), "fold-truths").join(weights, "variable", "left")
    people = folds.join(long.select("subject_id").distinct(), "subject_id", "left_semi").select("subject_id", "y", F.col("fold").alias("own"))
    people = people.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_folds - 1).cast("long"))))

    def run(table: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
        fold = int(who["fold"].iloc[0])
        who = who.sort_values("subject_id")
        held_out = who["own"].to_numpy() == fold
        y, n = who["y"].to_numpy(bool), (int((~held_out).sum()), int(held_out.sum()))
        if ((table["n_train"] != n[0]) | (table["n_test"] != n[1])).any():
            raise ValueError("a subject has no value of some detector, or several")
        table = table.sort_values([*detectors.KEY, "threshold"]).reset_index(drop=True)

        def both(column: str, n: int) -> np.ndarray:
            out = np.empty((2 * len(table), n), bool)  # above, below
            for i, packed in enumerate(table[column]):
                out[2 * i] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n)
                np.logical_not(out[2 * i], out=out[2 * i + 1])
            return out

        truths = both("test", n[1])
        rows = table[[*detectors.KEY, "threshold", "weight"]].loc[table.index.repeat(2)].reset_index(drop=True)
        rows["direction"] = ["above", "below"] * len(table)
        chain = _chain(rows, both("train", n[0]), y[~held_out], seed + fold, False)
        total, used = np.zeros(n[1]), 0
        for it in range(iterations):
            chain.step()
            if it >= int(burn_in * iterations):
                x = np.column_stack([*(truths[r].all(axis=0) for r in chain.rules), np.ones(n[1])]).astype(float)
                total += 1 / (1 + np.exp(-x @ chain.beta))
                used += 1
        return pd.DataFrame({"fold": fold, "subject_id": who["subject_id"].to_numpy()[held_out], "y": y[held_out], "probability": total / max(used, 1)})

    kind = folds.schema["subject_id"].dataType.simpleString()
    return found.groupBy("fold").cogroup(people.groupBy("fold")).applyInPandas(run, f"fold long, subject_id {kind}, y boolean, probability double")
