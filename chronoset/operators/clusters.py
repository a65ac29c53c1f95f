"""Clusters of detectors, rules and lists of a run's stored states, made in blocks; nothing is gathered on the driver.

Items are taken by falling probability: the likeliest one left starts a cluster, which takes in what may join it. The
least likely item of all is never taken in.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoset.operators.ordering import numbered
from chronoset.sources.scratch import settle

BLOCK = ["variable", "type", "direction"]


def _last(items: DataFrame, key: str) -> DataFrame:
    """The least likely item, one row."""
    return items.agg(F.min(F.struct("probability", key)).alias("m")).select(F.col("m")[key].alias(key), F.lit(True).alias("last"))


def _ranked(clusters: DataFrame, key: str) -> DataFrame:
    """(key, cluster, posterior): clusters numbered from 0 by falling total probability, then by their seed."""
    totals = clusters.groupBy("seed").agg(F.round(F.sum("probability"), 12).alias("posterior"))
    places = numbered(totals, F.desc("posterior"), "seed", name="cluster")
    return clusters.join(places, "seed").select(key, "seed", "cluster", "posterior")


def complete_linkage(windows: list[tuple[float, float]], least: float) -> list[int]:
    """For windows by falling probability, the place of the one that starts their cluster.

    A window joins if it overlaps all windows of the cluster by ``least`` of the shorter one of the two.
    """
    seed = [-1] * len(windows)
    for s in range(len(windows)):
        if seed[s] >= 0:
            continue
        held = [windows[s]]
        seed[s] = s
        for i in range(s + 1, len(windows)):
            a, b = windows[i]
            if seed[i] < 0 and all(a < y and x < b and min(b, y) - max(a, x) >= least * min(b - a, y - x) for x, y in held):
                held.append((a, b))
                seed[i] = s
    return seed


def cluster_detectors(items: DataFrame, least: float = 0.5) -> DataFrame:
    """(detector, seed, cluster, posterior) of ``items`` (detector, variable, t0, t1, type, direction, probability).

    Detectors may share a cluster if they agree in variable, type and direction and their windows overlap. So blocks
    of these three are clustered by themselves, and within one the detectors of a window stand or fall together: a
    block's rows are its distinct windows, of which a study has few, not its detectors.
    """
    last = _last(items, "detector")
    marked = items.join(F.broadcast(last), "detector", "left")
    free = settle(marked.where(F.col("last").isNull()).drop("last"), "cluster-items")
    windows = free.groupBy(*BLOCK, "t0", "t1").agg(F.max(F.struct("probability", "detector")).alias("top"))
    windows = windows.select(*BLOCK, "t0", "t1", F.col("top.probability").alias("probability"), F.col("top.detector").alias("detector"))
    kind = items.schema["detector"].dataType.simpleString()

    def seeds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["probability", "detector"], ascending=False, ignore_index=True)
        first = complete_linkage(list(zip(pdf["t0"], pdf["t1"], strict=True)), least)
        return pdf[[*BLOCK, "t0", "t1"]].assign(seed=pdf["detector"].to_numpy()[first])

    found = windows.groupBy(*BLOCK).applyInPandas(seeds, f"variable string, type string, direction string, t0 double, t1 double, seed {kind}")
    joined = free.join(found, [*BLOCK, "t0", "t1"]).select("detector", "probability", "seed")
    alone = marked.where(F.col("last").isNotNull()).select("detector", "probability", F.col("detector").alias("seed"))
    return _ranked(settle(joined.unionByName(alone), "detector-clusters"), "detector")


def opposites(items: DataFrame) -> DataFrame:
    """(detector, opposite): the stored detector that differs in nothing but the direction."""
    key = [c for c in ("variable", "t0", "t1", "type", "threshold") if c in items.columns]
    other = items.select(*key, F.col("direction").alias("__d"), F.col("detector").alias("opposite"))
    return items.join(other, key).where(F.col("direction") != F.col("__d")).select("detector", "opposite")


def rules_of(atoms: DataFrame) -> DataFrame:
    """(state, rule, subrule): each stored rule as the sorted list of its detectors, in one text."""
    return atoms.groupBy("state", "rule").agg(F.array_join(F.sort_array(F.collect_list(F.col("detector").cast("string"))), ",").alias("subrule"))


def cluster_rules(rules: DataFrame, n_states: int, detectors: DataFrame, items: DataFrame) -> DataFrame:
    """(subrule, seed, cluster, posterior) of the distinct stored rules (state, rule, subrule).

    A rule joins the cluster of one whose detectors lie in the same clusters; a single detector also joins that of a
    single one whose opposite lies in its cluster. ``detectors`` are the clusters of detectors, ``items`` their facts.
    """
    found = rules.groupBy("subrule").agg((F.countDistinct("state") / n_states).alias("probability"))
    found = settle(found.withColumn("detector", F.explode(F.split("subrule", ","))), "rule-atoms")
    of = detectors.select(F.col("detector").cast("string").alias("detector"), F.col("seed").cast("string").alias("of"))
    turned = opposites(items).select(F.col("detector").cast("string").alias("detector"), F.col("opposite").cast("string").alias("opposite"))
    turned = turned.join(of.select(F.col("detector").alias("opposite"), F.col("of").alias("turned")), "opposite").drop("opposite")
    per = found.join(of, "detector").join(turned, "detector", "left").groupBy("subrule", "probability").agg(
        F.array_join(F.sort_array(F.collect_list("of")), ",").alias("form"), F.count(F.lit(1)).alias("n"), F.max("turned").alias("turned"))
    per = settle(per, "rule-forms")
    last = _last(per, "subrule")
    marked = per.join(F.broadcast(last), "subrule", "left")
    free = marked.where(F.col("last").isNull())
    top = F.max(F.struct("probability", "subrule", "turned"))
    many = free.where("n > 1").groupBy("form").agg(top.alias("top")).select("form", F.lit(1).alias("many"), F.col("top.subrule").alias("seed"))
    # single detectors: forms of one variable and type can meet, others cannot
    place = items.select(F.col("detector").cast("string").alias("form"), "variable", "type")
    ones = free.where("n = 1").groupBy("form").agg(top.alias("top")).join(place, "form")
    ones = ones.select("variable", "type", "form", F.col("top.probability").alias("probability"), F.col("top.subrule").alias("seed"), F.col("top.turned").alias("turned"))

    def pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["probability", "seed"], ascending=False)
        taken: dict[str, str] = {}
        there = set(pdf["form"])
        for form, seed, turned in zip(pdf["form"], pdf["seed"], pdf["turned"], strict=True):
            if form not in taken:
                taken[form] = seed
                if isinstance(turned, str) and turned in there and turned not in taken:
                    taken[turned] = seed
        return pd.DataFrame({"form": list(taken), "many": 0, "seed": list(taken.values())})

    single = ones.groupBy("variable", "type").applyInPandas(pair_up, "form string, many int, seed string")
    seeds = many.unionByName(single)
    joined = free.withColumn("many", (F.col("n") > 1).cast("int")).join(seeds, ["form", "many"]).select("subrule", "probability", "seed")
    alone = marked.where(F.col("last").isNotNull()).select("subrule", "probability", F.col("subrule").alias("seed"))
    return _ranked(settle(joined.unionByName(alone), "rule-clusters"), "subrule")


def cluster_lists(rules: DataFrame, n_states: int, subrules: DataFrame) -> DataFrame:
    """(list, seed, cluster, posterior) of the distinct stored lists of rules: one cluster for each set of rule clusters."""
    named = rules.join(subrules.select("subrule", F.col("seed").alias("of")), "subrule")
    text = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "/")
    lists = named.groupBy("state").agg(text("subrule").alias("list"), text("of").alias("form"))
    found = settle(lists.groupBy("list", "form").agg((F.count(F.lit(1)) / n_states).alias("probability")), "list-forms")
    last = _last(found, "list")
    marked = found.join(F.broadcast(last), "list", "left")
    free = marked.where(F.col("last").isNull())
    seeds = free.groupBy("form").agg(F.max(F.struct("probability", "list")).alias("top")).select("form", F.col("top.list").alias("seed"))
    joined = free.join(seeds, "form").select("list", "probability", "seed")
    alone = marked.where(F.col("last").isNotNull()).select("list", "probability", F.col("list").alias("seed"))
    return _ranked(settle(joined.unionByName(alone), "list-clusters"), "list")


def cluster_run(states: DataFrame, atoms: DataFrame, detectors: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The clusters of detectors, of rules and of lists of stored states; ``detectors`` has their facts.

    States without a detector are in no list's cluster but count for probabilities.
    """
    n = max(states.count(), 1)
    probability: Column = F.countDistinct("state") / n
    seen = atoms.groupBy("detector").agg(probability.alias("probability"))
    items = settle(detectors.join(seen, "detector"), "stored-detectors")
    primitives = cluster_detectors(items, least)
    rules = settle(rules_of(atoms), "stored-rules")
    subrules = cluster_rules(rules, n, primitives, items)
    return primitives, subrules, cluster_lists(rules, n, subrules)


def members(clusters: DataFrame, key: str, most: int) -> list[list]:
    """Members of the ``most`` likeliest clusters, for a report."""
    rows = clusters.where(F.col("cluster") < most).groupBy("cluster").agg(F.sort_array(F.collect_list(key)).alias("m")).orderBy("cluster").collect()
    return [list(r["m"]) for r in rows]
