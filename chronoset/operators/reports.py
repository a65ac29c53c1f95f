"""Reports on stored states as text: what is said is computed on Spark for all lists at once, and small rows are written out."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.functions import model
from chronoset.functions.model import Hyper
from chronoset.operators import clusters, metrics, posterior, rules, slots
from chronoset.sources.scratch import settle

FACTS = ("variable", "t0", "t1", "type", "direction", "threshold")


@dataclass(frozen=True)
class Stored:
    """Stored states after the burn-in, with the study behind them."""

    chain_states: DataFrame  # state, rules, beta
    states: DataFrame
    atoms: DataFrame
    detectors: DataFrame  # detector and its facts
    values: DataFrame
    subjects: DataFrame

    @classmethod
    def of(cls, chain_states: DataFrame, burn_in: float, detectors: DataFrame, values: DataFrame, subjects: DataFrame) -> Stored:
        """From what a run has made; ``detectors`` has detector_id, facts and weight."""
        states, atoms = posterior.states_and_atoms(chain_states, burn_in)
        states, atoms = settle(states, "stored-states"), settle(atoms, "stored-atoms")
        named = chain_states.withColumn("state", F.concat_ws(":", "chain", "iteration")).select("state", "rules", "beta")
        facts = detectors.select(F.col("detector_id").alias("detector"), *FACTS, "weight")
        return cls(settle(named.join(states.select("state"), "state", "left_semi"), "stored-lists"), states, atoms, facts, values, subjects.select("subject_id", "y"))


def coefficients(lists: DataFrame, chain_states: DataFrame) -> DataFrame:
    """(label, place, median, low, high) of each coefficient of ``lists`` (label, rules) over the states that hold just
    that list; the constant term comes after those of the rules."""
    rows = chain_states.join(lists, "rules").select("label", F.posexplode("beta").alias("place", "beta"))
    q = lambda p: F.percentile("beta", F.lit(p))
    return rows.groupBy("label", "place").agg(q(0.5).alias("median"), q(0.025).alias("low"), q(0.975).alias("high"))


def list_atoms(lists: DataFrame, detectors: DataFrame) -> DataFrame:
    """(label, rule, place, detector, facts) of ``lists`` (label, rules)."""
    ruled = lists.where(F.col("rules") != "").select("label", F.posexplode(F.split("rules", "/")).alias("rule", "text"))
    atoms = ruled.select("label", "rule", F.posexplode(F.split("text", r"\+")).alias("place", "detector")).withColumn("detector", F.col("detector").cast("long"))
    return atoms.join(detectors.select("detector", *FACTS), "detector")


def list_scores(lists: DataFrame, betas: DataFrame, truths: DataFrame, subjects: DataFrame) -> DataFrame:
    """(label, subject_id, y, score): the probability that a list with its median coefficients gives each subject."""
    n_rules = F.when(F.col("rules") == "", 0).otherwise(F.size(F.split("rules", "/")))
    constant = lists.select("label", n_rules.alias("place")).join(betas, ["label", "place"]).select("label", F.col("median").alias("constant"))
    moved = truths.where("truth").join(betas.select("label", F.col("place").alias("rule"), "median"), ["label", "rule"]).groupBy("label", "subject_id").agg(F.sum("median").alias("moved"))
    every = subjects.withColumn("one", F.lit(1)).join(F.broadcast(constant.withColumn("one", F.lit(1))), "one")  # the lists of a report
    eta = F.col("constant") + F.coalesce("moved", F.lit(0.0))
    return every.join(moved, ["label", "subject_id"], "left").select("label", "subject_id", "y", (1.0 / (1.0 + F.exp(-eta))).alias("score"))


def _span(row, turn=lambda x: x) -> str:
    return f"{turn(row['median']):.3g} ({turn(row['low']):.3g} to {turn(row['high']):.3g})"


def described(lists: DataFrame, stored: Stored) -> dict:
    """For each label of ``lists`` (label, rules) the text of the list and of its accuracy: rules with coefficients and
    their 95 % ranges, probabilities, coverage, area under the curve and confusion counts. All lists are worked on
    together; what comes to the driver are the lists' own rows."""
    lists = settle(lists, "report-lists")
    betas = settle(coefficients(lists, stored.chain_states), "report-betas")
    atoms = settle(list_atoms(lists, stored.detectors), "report-atoms")
    truths = settle(rules.rule_truths(atoms, stored.values, by=("label",)), "report-truths")
    covered = truths.join(stored.subjects, "subject_id").groupBy("label", "rule").agg(F.count_if("truth").alias("n"), F.count_if(F.col("truth") & F.col("y")).alias("k"))
    scores = settle(list_scores(lists, betas, truths, stored.subjects), "report-scores")
    quality = metrics.confusion(scores, by=("label",)).join(metrics.auc(scores, ("label",)), "label")
    loglik = F.sum(F.when(F.col("y"), F.ln("score")).otherwise(F.ln(1 - F.col("score"))))
    quality = {r["label"]: r for r in quality.join(scores.groupBy("label").agg(loglik.alias("loglik")), "label").collect()}
    by_rule: dict = defaultdict(lambda: defaultdict(list))
    for r in atoms.orderBy("label", "rule", "place").collect():
        by_rule[r["label"]][r["rule"]].append(r)
    beta = {(r["label"], r["place"]): r for r in betas.collect()}
    cover = {(r["label"], r["rule"]): r for r in covered.collect()}
    n, k = stored.subjects.agg(F.count(F.lit(1)), F.count_if("y")).first()
    odds = lambda x: 1 / (1 + 2.718281828459045 ** -x)
    out = {}
    for row in lists.collect():
        label = row["label"]
        held = by_rule[label]
        q, constant = quality[label], beta[label, len(held)]
        lines = [f"List of {len(held)} rules, log likelihood {q['loglik']:.3g}; {k} of {n} subjects are positive ({k / max(n, 1):.3f})",
                 f"No rule holds: probability {_span(constant, odds)}, log-odds {_span(constant)}"]
        for i in sorted(held):
            b, c = beta[label, i], cover.get((label, i))
            lines.append(f"Rule {i + 1}: log-odds {'rise' if b['median'] > 0 else 'fall'} by {_span(b)}; alone, probability {odds(b['median'] + constant['median']):.3g}, if")
            lines += [f"  {a['type']} of {a['variable']} from {a['t0']:.3f} to {a['t1']:.3f} is {a['direction']} {a['threshold']:.4f}" for a in held[i]]
            if c is not None:
                lines.append(f"  holds for {c['n']} of {n} subjects, {c['k']} of them positive")
        area = "none" if q["auc"] is None else f"{q['auc']:.3f}"
        accuracy = f"Area under the curve {area}; true negatives {q['tn']}, false positives {q['fp']}, false negatives {q['fn']}, true positives {q['tp']}"
        out[label] = ("\n".join(lines), accuracy)
    return out


def ensemble_accuracy(stored: Stored) -> str:
    """Accuracy of the mean over states; equal lists of equal coefficients count as often as they were stored."""
    n = max(stored.states.count(), 1)
    distinct = stored.chain_states.groupBy("rules", "beta").agg(F.count(F.lit(1)).alias("times"))
    lists = settle(distinct.withColumn("label", F.xxhash64("rules", F.col("beta").cast("string"))), "ensemble-lists")
    atoms = list_atoms(lists.select("label", "rules"), stored.detectors)
    truths = rules.rule_truths(atoms, stored.values, by=("label",)).where("truth")
    b = lists.select("label", "times", F.posexplode("beta").alias("rule", "b"))
    moved = truths.join(b.select("label", "rule", "b"), ["label", "rule"]).groupBy("label", "subject_id").agg(F.sum("b").alias("moved"))
    constant = lists.select("label", "times", F.element_at("beta", -1).alias("constant"))
    # subjects for whom no rule of a list holds get its constant term; the others are corrected by what rules move
    sigma = lambda x: 1.0 / (1.0 + F.exp(-x))
    base = constant.agg((F.sum(F.col("times") * sigma(F.col("constant"))) / n).alias("base"))
    shift = moved.join(constant, "label").groupBy("subject_id").agg((F.sum(F.col("times") * (sigma(F.col("constant") + F.col("moved")) - sigma(F.col("constant")))) / n).alias("shift"))
    scores = stored.subjects.join(shift, "subject_id", "left").crossJoin(F.broadcast(base)).select("y", (F.col("base") + F.coalesce("shift", F.lit(0.0))).alias("score"))  # one row
    scores = settle(scores, "ensemble-scores")
    q, area = metrics.confusion(scores).first(), metrics.auc(scores).first()["auc"]
    return f"Area under the curve {'none' if area is None else f'{area:.3f}'}; true negatives {q['tn']}, false positives {q['fp']}, false negatives {q['fn']}, true positives {q['tp']}"


def quick(stored: Stored, hyper: Hyper = Hyper(), lengths: int = 5) -> str:
    """The factor of the empty list, the point list with its accuracy, the ensemble's, and the commonest lengths."""
    point = posterior.point_state(stored.states).select("state").join(stored.chain_states, "state").select(F.lit("point").alias("label"), "rules")
    text, accuracy = described(point, stored)["point"]
    prior = hyper.a_empty / (hyper.a_empty + hyper.b_empty)
    empty = posterior.emptiness_factor(stored.states, prior).first()
    seen = posterior.length_distribution(stored.states).orderBy(F.desc("n"), F.desc("length")).limit(lengths).collect()
    lines = [f"Bayes factor of the empty list: {empty['bayes_factor']:.3g}", "", "Point summary", text, accuracy, "", "Ensemble", ensemble_accuracy(stored), "",
             f"{stored.states.count()} states after the burn-in", "Commonest numbers of detectors:", *[f"  {r['length']}: {r['share']:.3g}" for r in seen]]
    return "\n".join(lines) + "\n"


def cluster_table(stored: Stored, most: int = 100) -> str:
    """The likeliest clusters of lists, each with its likeliest list and that list's accuracy."""
    found = clusters.cluster_run(stored.states, stored.atoms, stored.detectors)[2]
    top = found.where((F.col("cluster") < most) & (F.col("list") == F.col("seed"))).select("list", "cluster", "posterior")
    # a stored list that has the seed's rules, in whatever order, speaks for it: the one stored most often
    named = clusters.rules_of(stored.atoms).groupBy("state").agg(F.array_join(F.sort_array(F.collect_list("subrule")), "/").alias("list"))
    texts = named.join(stored.chain_states, "state").groupBy("list", "rules").agg(F.count(F.lit(1)).alias("n")).groupBy("list").agg(F.max_by("rules", F.struct("n", "rules")).alias("rules"))
    lists = settle(top.join(texts, "list"), "cluster-lists").select(F.col("cluster").alias("label"), "rules", "posterior")
    shares = {r["label"]: r["posterior"] for r in lists.collect()}
    if not shares:
        return "No list of a detector was stored\n"
    said = described(lists.select("label", "rules"), stored)
    return "\n".join(f"Cluster {i + 1}: posterior probability {shares[i]:.3g}\n{said[i][0]}\n{said[i][1]}\n" for i in sorted(shares))


def factor_tables(stored: Stored, hyper: Hyper, total: float, n_draws: int, seed: int) -> dict[str, DataFrame]:
    """Bayes factors of detectors and of variables, from slot priors by Monte Carlo and the prior of lengths."""
    spark = stored.states.sparkSession
    variables = stored.detectors.select("variable", "weight").distinct()
    draws = slots.hyper_draws(spark, n_draws, model.phylogeny_scale(variables, hyper), hyper, seed)
    found = stored.detectors.withColumn("duration", F.col("t1") - F.col("t0"))
    priors = settle(slots.slot_priors(found, settle(draws, "hyper-draws"), total, epsilon=hyper.duration_epsilon), "slot-priors")
    lengths = [float(p) for p in model.length_prior(hyper)]
    atoms = settle(stored.atoms.join(stored.detectors.select("detector", "variable"), "detector"), "factor-atoms")
    return {c: posterior.best_by_factor(posterior.bayes_factors(priors, stored.states, atoms, c, lengths), c, posterior.tabulate(stored.states, atoms, c)) for c in ("variable", "detector")}


def bayes(stored: Stored, hyper: Hyper, total: float, n_draws: int, seed: int = 1) -> str:
    """The best supported variables and detectors, with factors, states that hold them, and coefficients."""
    tables = factor_tables(stored, hyper, total, n_draws, seed)
    lines = ["Best supported variables"]
    lines += [f"  {r['variable']}: factor {r['bayes_factor']:.3g}, in {r['n_states']} states" for r in tables["variable"].orderBy(F.desc("bayes_factor"), F.desc("variable")).collect()]
    lines.append("Best supported detectors")
    for r in tables["detector"].join(stored.detectors, "detector").orderBy(F.desc("bayes_factor"), F.desc("detector")).collect():
        effect = "" if r["beta_median"] is None else f", coefficient {r['beta_median']:.3g} ({r['beta_low']:.3g} to {r['beta_high']:.3g})"
        lines.append(f"  {r['type']} of {r['variable']} from {r['t0']:.3f} to {r['t1']:.3f} {r['direction']} {r['threshold']:.4f}: factor {r['bayes_factor']:.3g}, in {r['n_states']} states{effect}")
    return "\n".join(lines) + "\n"
