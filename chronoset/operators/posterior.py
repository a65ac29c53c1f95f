"""Summaries of stored chain states: frequencies, point and ensemble, Bayes factors and clusters.

States have (state, score, length), atoms (state, rule, place, detector, ..., beta), a row for each detector in a state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.operators import clusters


def with_lengths(states: DataFrame, atoms: DataFrame) -> DataFrame:
    n = atoms.groupBy("state").agg(F.count(F.lit(1)).alias("length"))
    return states.join(n, "state", "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))


def after_burn_in(states: DataFrame, fraction: float) -> DataFrame:
    """States from int(fraction * n) on, but for the last one, by iteration from 0."""
    n = states.agg((F.max("iteration") + 1).alias("n"))
    return states.crossJoin(F.broadcast(n)).where((F.col("iteration") >= F.floor(F.col("n") * fraction)) & (F.col("iteration") < F.col("n") - 1)).drop("n")


def tabulate(states: DataFrame, atoms: DataFrame, column: str) -> DataFrame:
    """For each value of ``column``: occurrences, states with it, their share, and the median and 95 % range of beta."""
    total = states.agg(F.count(F.lit(1)).alias("total"))
    per = atoms.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("state").alias("n_states"), F.median("beta").alias("beta_median"), F.percentile("beta", F.lit(0.025)).alias("beta_low"), F.percentile("beta", F.lit(0.975)).alias("beta_high"))
    return per.crossJoin(F.broadcast(total)).withColumn("posterior", F.col("n_states") / F.col("total")).drop("total")


def subrules(atoms: DataFrame) -> DataFrame:
    """(subrule, n, posterior): rules as sorted lists of their detectors, and their share of all rules."""
    names = F.array_join(F.sort_array(F.collect_list(F.col("detector").cast("string"))), ",")
    per = atoms.groupBy("state", "rule").agg(names.alias("subrule")).groupBy("subrule").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("posterior", F.col("n") / F.sum("n").over(Window.partitionBy()))


def length_distribution(states: DataFrame) -> DataFrame:
    """(length, n, share) for every length from 0 to the largest."""
    n = states.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    every = states.agg(F.max("length").alias("top"), F.count(F.lit(1)).alias("total")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("length"), "total")
    return every.join(n, "length", "left").select("length", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def point_state(states: DataFrame) -> DataFrame:
    """The state with the highest score among those of the modal length, the first on ties.

    Lists without detectors count for the mode only if half of the states or more are such; equal frequencies go to
    the larger length.
    """
    n = states.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    share = states.agg(F.avg((F.col("length") == 0).cast("int")).alias("empty"))
    usable = n.crossJoin(F.broadcast(share)).where((F.col("length") > 0) | (F.col("empty") >= 0.5))
    modal = usable.agg(F.max_by("length", F.struct("n", "length")).alias("modal"))
    return states.join(F.broadcast(modal), F.col("length") == F.col("modal")).drop("modal").orderBy(F.desc("score"), "state").limit(1).select("state", "length", "score")


def ensemble(votes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(subject_id, probability, predicted) of (subject_id, p) rows, one for each state: the mean, and the vote."""
    return votes.groupBy("subject_id").agg(F.avg("p").alias("probability"), (F.avg((F.col("p") >= threshold).cast("int")) >= 0.5).alias("predicted"))


def inclusion_priors(slots: DataFrame, column: str, lengths: list[float]) -> DataFrame:
    """(column, prior): the chance that a list holds a category, from slot priors and the prior of lengths."""
    per = slots.groupBy(column).agg(F.sum("prior").alias("slot"))
    table = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(float(p)).alias("p")) for i, p in enumerate(lengths)])
    prior = F.aggregate(table, F.lit(0.0), lambda s, x: s + x["p"] * (1 - F.pow(1 - F.col("slot"), x["n"])))
    return per.select(column, prior.alias("prior"))


def bayes_factors(slots: DataFrame, states: DataFrame, atoms: DataFrame, column: str, lengths: list[float], eps: float = 1e-9) -> DataFrame:
    """(column, prior, posterior, bayes_factor): posterior odds by prior odds; infinite without prior or doubt."""
    total = states.agg(F.count(F.lit(1)).alias("total"))
    seen = atoms.groupBy(column).agg(F.countDistinct("state").alias("n"))
    both = inclusion_priors(slots, column, lengths).join(seen, column, "left").crossJoin(F.broadcast(total))
    p = F.coalesce("n", F.lit(0)) / F.col("total")
    both = both.select(column, "prior", p.alias("posterior"))
    odds = lambda c: F.col(c) / (1 - F.col(c))
    bf = F.when((F.col("prior") == 0) | (F.col("posterior") > 1 - eps), F.lit(float("inf"))).otherwise(odds("posterior") / odds("prior"))
    return both.withColumn("bayes_factor", bf)


def may_join(a: dict, b: dict, least: float = 0.5) -> bool:
    """Whether two detectors agree in variable, type and direction and overlap by ``least`` of the shorter window."""
    if any(a[k] != b[k] for k in ("variable", "type", "direction")):
        return False
    overlap = min(a["t1"], b["t1"]) - max(a["t0"], b["t0"])
    return overlap >= least * min(a["t1"] - a["t0"], b["t1"] - b["t0"])


def greedy_clusters(items: list[tuple[float, object]], test: Callable[[list, object], bool], scan_last: bool = False) -> list[list]:
    """Clusters of (probability, item): the likeliest item left starts one, and takes in, in falling order, all that
    pass ``test(cluster, item)``. By default the least likely item left is never taken in. Clusters come by falling
    total probability.

    This runs on the driver over the distinct items of a summary, which are few.
    """
    left = sorted(items, key=lambda x: x[0])
    out = []
    while left:
        cluster = [left.pop()]
        i = len(left) - 1
        while i >= (0 if scan_last else 1):
            if test([x for _, x in cluster], left[i][1]):
                cluster.append(left.pop(i))
            i -= 1
        out.append(cluster)
    out.sort(key=lambda c: -sum(p for p, _ in c))
    return [[x for _, x in c] for c in out]


def states_and_atoms(chain_states: DataFrame, burn_in: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(states, atoms) of stored chain states, less those of the burn-in.

    Chain states have chain, iteration, rules ("1+2/3": detectors of a rule by +, rules by /), log_lik, log_prior and
    beta (one for each rule, then the constant term). A state's number is chain:iteration, its score the posterior.
    """
    one = chain_states.groupBy("chain").agg((F.max("iteration") + 1).alias("of_chain"))
    kept = chain_states.join(F.broadcast(one), "chain")  # a row for each chain
    kept = kept.where((F.col("iteration") >= F.floor(F.col("of_chain") * burn_in)) & (F.col("iteration") < F.col("of_chain") - 1))
    kept = kept.withColumn("state", F.concat_ws(":", "chain", "iteration"))
    states = kept.select("state", "iteration", (F.col("log_lik") + F.col("log_prior")).alias("score"), "length", "n_rules")
    ruled = kept.where(F.col("rules") != "").select("state", "beta", F.posexplode(F.split("rules", "/")).alias("rule", "text"))
    ruled = ruled.select("state", "rule", F.element_at("beta", F.col("rule") + 1).alias("beta"), F.posexplode(F.split("text", r"\+")).alias("place", "detector"))
    return states, ruled.select("state", F.col("rule").cast("long").alias("rule"), F.col("place").cast("long").alias("place"), F.col("detector").cast("long").alias("detector"), "beta")


def grid_cells(detectors: DataFrame, paths: DataFrame, leaves: DataFrame, intervals: list[tuple[float, float]]) -> DataFrame:
    """(detector, cell): cells are an interval and a leaf; a detector covers those whose interval's middle lies in its
    window and whose leaf is its variable or below it.

    ``detectors`` has detector, variable, t0, t1; variables outside the tree have no cells.
    """
    middles = F.array(*[F.struct(F.lit(i).alias("n"), F.lit((a + b) / 2).alias("at")) for i, (a, b) in enumerate(intervals)])
    inside = F.filter(middles, lambda m: (m["at"] >= F.col("t0")) & (m["at"] <= F.col("t1")))
    placed = detectors.select("detector", F.col("variable").alias("ancestor"), F.explode(inside).alias("m"))
    ends = paths.join(leaves.select(F.col("node").alias("descendant")), "descendant", "left_semi").select("ancestor", F.col("descendant").alias("leaf"))
    return placed.join(ends, "ancestor").select("detector", F.concat_ws(":", F.col("m.n"), "leaf").alias("cell"))


def emptiness_factor(states: DataFrame, empty_prior: float, eps: float = 1e-9) -> DataFrame:
    """(prior, posterior, bayes_factor) of lists without a detector."""
    p = F.avg((F.col("length") == 0).cast("int"))
    odds = F.col("posterior") / (1 - F.col("posterior")) / F.lit(empty_prior / (1 - empty_prior) if empty_prior < 1 else float("inf"))
    out = states.agg(F.lit(float(empty_prior)).alias("prior"), p.alias("posterior"))
    return out.withColumn("bayes_factor", F.when((F.col("prior") == 0) | (F.col("posterior") > 1 - eps), F.lit(float("inf"))).otherwise(odds))


def best_by_factor(factors: DataFrame, key: str, tabulated: DataFrame, most: int = 10, least: float | None = None) -> DataFrame:
    """The ``most`` categories with the largest Bayes factors (at least ``least``), with how often each was seen and
    the median and 95 % range of its coefficients; ties to the larger key."""
    wanted = factors if least is None else factors.where(F.col("bayes_factor") >= least)
    top = wanted.orderBy(F.desc("bayes_factor"), F.desc(key)).limit(most)
    seen = tabulated.select(key, "n_states", "beta_median", "beta_low", "beta_high")
    return top.join(seen, key, "left").withColumn("n_states", F.coalesce("n_states", F.lit(0)).cast("long"))


def quick_report(states: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row on a run: states, the share without detectors, mean length, and the point state with its rules."""
    overall = states.agg(F.count(F.lit(1)).alias("n_states"), F.avg((F.col("length") == 0).cast("int")).alias("empty"), F.avg("length").alias("mean_length"))
    point = point_state(states).select(F.col("state").alias("point_state"), F.col("score").alias("point_score"))
    rules = atoms.join(F.broadcast(point.select(F.col("point_state").alias("state"))), "state").groupBy("state", "rule").agg(F.sort_array(F.collect_list(F.struct("place", "detector"))).alias("r"))
    said = rules.groupBy("state").agg(F.sort_array(F.collect_list(F.struct("rule", F.array_join(F.transform("r", lambda x: x["detector"].cast("string")), "+").alias("t")))).alias("l"))
    said = said.select(F.col("state").alias("point_state"), F.array_join(F.transform("l", lambda x: x["t"]), "/").alias("point_rules"))
    return overall.crossJoin(F.broadcast(point)).join(F.broadcast(said), "point_state", "left").withColumn("point_rules", F.coalesce("point_rules", F.lit("")))


def cluster_passes(states: DataFrame, atoms: DataFrame, detectors: DataFrame, most: int = 100) -> dict[str, list[list]]:
    """The ``most`` likeliest clusters of detectors, of rules and of lists, from :mod:`chronoset.operators.clusters`."""
    primitives, subrules, lists = clusters.cluster_run(states, atoms, detectors)
    return {"primitives": clusters.members(primitives, "detector", most), "subrules": clusters.members(subrules, "subrule", most), "lists": clusters.members(lists, "list", most)}
