"""Rule lists: conjunctions of detectors, covariates, predictions and similarities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATOM = "variable string, t0 double, t1 double, type string, direction string, threshold double"


@dataclass(frozen=True, order=True)
class Detector:
    """A variable's average or slope in a closed window, above or at most a threshold."""

    variable: str
    t0: float
    t1: float
    type: str
    direction: str
    threshold: float

    def inverted(self) -> Detector:
        other = "below" if self.direction == "above" else "above"
        return Detector(self.variable, self.t0, self.t1, self.type, other, self.threshold)


@dataclass(frozen=True)
class RuleList:
    """Rules in order, each a conjunction of at least one detector."""

    rules: tuple[tuple[Detector, ...], ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(tuple(r) for r in self.rules))
        if any(not r for r in self.rules):
            raise ValueError("a rule needs at least one detector")

    def __len__(self) -> int:
        return len(self.rules)

    def structure(self) -> str:
        """Variables, types and directions only, sorted within rules."""
        return " / ".join(" and ".join(sorted(f"{d.variable} {d.type} {d.direction}" for d in r)) for r in self.rules)

    def atoms(self, spark: SparkSession) -> DataFrame:
        """(rule, atom, variable, t0, t1, type, direction, threshold)."""
        rows = [(i, j, d.variable, d.t0, d.t1, d.type, d.direction, d.threshold) for i, r in enumerate(self.rules) for j, d in enumerate(r)]
        return spark.createDataFrame(rows, f"rule int, atom int, {ATOM}")


def rule_truths(atoms: DataFrame, long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(rule, subject_id, truth): whether all detectors of a rule hold; ``by`` names further keys of the atoms."""
    met = atoms.join(long, ["t0", "t1", "variable", "type"])
    holds = F.when(F.col("direction") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return met.groupBy(*by, "rule", "subject_id").agg(F.bool_and(holds).alias("truth"))


def covariates(truths: DataFrame, n_rules: int, extra: DataFrame | None = None) -> DataFrame:
    """(subject_id, x): rule truths in rule order, the constant, then extra covariates in order of ord."""
    cells = [F.max(F.when(F.col("rule") == i, F.col("truth").cast("double"))) for i in range(n_rules)]
    x = truths.groupBy("subject_id").agg(F.array(*cells, F.lit(1.0)).alias("x"))
    if extra is None:
        return x
    more = extra.groupBy("subject_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"]).alias("more"))
    return x.join(more, "subject_id").select("subject_id", F.concat("x", "more").alias("x"))


def one_hot(subjects: DataFrame, column: str, default) -> DataFrame:
    """(subject_id, label, value): a 0/1 covariate for every value but the default, in sorted order."""
    seen = subjects.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    if seen.where(F.col("label") == default).isEmpty():
        raise ValueError(f"no subject has {column} = {default}")
    labels = seen.where(F.col("label") != default)
    levels = labels.agg(F.sort_array(F.collect_set("label")).alias("levels"))
    flat = subjects.select("subject_id", F.col(column).alias("own")).join(F.broadcast(levels), how="cross")
    return flat.select("subject_id", "own", F.explode("levels").alias("label")).select("subject_id", "label", (F.col("own").eqNullSafe(F.col("label"))).cast("double").alias("value"))


def centred(subjects: DataFrame, column: str) -> DataFrame:
    return subjects.join(F.broadcast(subjects.agg(F.avg(column).alias("mean"))), how="cross").select("subject_id", F.lit(column).alias("label"), (F.col(column) - F.col("mean")).alias("value"))


def first_match(subjects: DataFrame, truths: DataFrame, n_rules: int) -> DataFrame:
    """(subject_id, y, stratum): the first rule that fires, or ``n_rules``."""
    fired = truths.where("truth").groupBy("subject_id").agg(F.min("rule").alias("rule"))
    return subjects.select("subject_id", "y").join(fired, "subject_id", "left").select("subject_id", "y", F.coalesce("rule", F.lit(n_rules)).alias("stratum"))


def outcomes_by_stratum(strata: DataFrame, n_rules: int) -> DataFrame:
    """(stratum, positives, total) with a row for empty strata as well."""
    counts = [F.struct(F.lit(i).alias("stratum"), F.count_if((F.col("stratum") == i) & F.col("y")).alias("positives"), F.count_if(F.col("stratum") == i).alias("total")) for i in range(n_rules + 1)]
    return strata.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.stratum", "c.positives", "c.total")


def probability(x: Column, beta: list[float]) -> Column:
    eta = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return 1.0 / (1.0 + F.exp(-eta))


def window_similarity(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The overlap of two windows by the length of the longer one."""
    overlap = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.try_divide(overlap, F.greatest(a1 - a0, b1 - b0))


def atom_scores(base: DataFrame, target: DataFrame, similarity: DataFrame) -> DataFrame:
    """Scores of base atoms (list, rule, atom, ...) against target atoms of the same type and related variables.

    Pairs of unrelated variables score 0 and are not made: the join goes through the similarity table.
    """
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns])
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns])
    met = b.join(similarity, F.col("b_variable") == F.col("a")).join(t, (F.col("b") == F.col("t_variable")) & (F.col("b_type") == F.col("t_type")))
    return met.withColumn("score", window_similarity(F.col("b_t0"), F.col("b_t1"), F.col("t_t0"), F.col("t_t1")) * F.col("similarity"))


def match_features(base: DataFrame, target: DataFrame, similarity: DataFrame) -> DataFrame:
    """(list, rule, atom, score): the best score of each base atom among target atoms, 0 without any."""
    best = atom_scores(base, target, similarity).groupBy("b_list", "b_rule", "b_atom").agg(F.max("score").alias("score"))
    return base.select("list", "rule", "atom").join(best.select(F.col("b_list").alias("list"), F.col("b_rule").alias("rule"), F.col("b_atom").alias("atom"), "score"), ["list", "rule", "atom"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def match_pairs(base: DataFrame, target: DataFrame, similarity: DataFrame) -> DataFrame:
    """(list, rule, first, second, score): for each pair of atoms in a base rule the best product of scores over pairs
    of different atoms within one target rule.

    If both prefer the same target atom, the better of the two reassignments of one of them to its second choice is
    taken.
    """
    s = atom_scores(base, target, similarity).select("b_list", "b_rule", "b_atom", "t_list", "t_rule", "t_atom", "score")
    order = Window.partitionBy("b_list", "b_rule", "b_atom", "t_list", "t_rule").orderBy(F.desc("score"), "t_atom")
    ranked = s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2)
    top = ranked.groupBy("b_list", "b_rule", "b_atom", "t_list", "t_rule").agg(F.max(F.when(F.col("place") == 1, F.col("t_atom"))).alias("best"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("s1"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("s2"))
    x, y = top.alias("x"), top.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("b_list", "b_rule", "t_list", "t_rule")]
    pairs = x.join(y, [*same, F.col("x.b_atom") < F.col("y.b_atom")])
    apart = F.col("x.s1") * F.col("y.s1")
    clash = F.greatest(F.col("x.s1") * F.col("y.s2"), F.col("x.s2") * F.col("y.s1"))
    scored = pairs.select(F.col("x.b_list").alias("list"), F.col("x.b_rule").alias("rule"), F.col("x.b_atom").alias("first"), F.col("y.b_atom").alias("second"), F.when(F.col("x.best") != F.col("y.best"), apart).otherwise(clash).alias("score"))
    best = scored.groupBy("list", "rule", "first", "second").agg(F.max("score").alias("score"))
    a, b = base.select("list", "rule", F.col("atom").alias("first")), base.select("list", "rule", F.col("atom").alias("second"))
    every = a.join(b, ["list", "rule"]).where(F.col("first") < F.col("second"))
    return every.join(best, ["list", "rule", "first", "second"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
