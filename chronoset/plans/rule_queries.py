"""Queries on rule lists, metrics, posterior summaries and Bayes factors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoset.functions import model
from chronoset.operators import detectors, metrics, posterior, rules
from chronoset.operators.ordering import numbered
from chronoset.plans.study_queries import EVENTS, detector_sql, mined
from chronoset.plans.tree_queries import TREE, closed
from chronoset.sources.studies import events_study, r6, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


D = rules.Detector
RULES = rules.RuleList((
    (D("click", 0.0, 10.0, "average", "above", 12.0), D("view", 10.0, 20.0, "average", "below", 14.0)),
    (D("purchase", 0.0, 30.0, "slope", "above", 0.0),),
    (D("error", 0.0, 30.0, "average", "below", 9.0), D("signup", 20.0, 30.0, "average", "above", 8.0)),
))
BETA = [1.5, -0.7, 0.4, -1.1]
_ATOMS = "atoms AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d.variable}', {d.t0}::DOUBLE, {d.t1}::DOUBLE, '{d.type}', '{d.direction}', {d.threshold}::DOUBLE)" for i, r in enumerate(RULES.rules) for d in r) + ") t(rule, variable, t0, t1, type, direction, threshold))"
RULED = f"{detector_sql()}, {_ATOMS}, truth AS (SELECT rule, subject_id, bool_and(CASE WHEN direction = 'above' THEN value > threshold ELSE value <= threshold END) AS truth FROM atoms JOIN long USING (t0, t1, variable, type) GROUP BY ALL)"
_X = ", ".join(f"max(CASE WHEN rule = {i} THEN truth::INT::DOUBLE END) AS x{i}" for i in range(3))
_ETA = "(" + " + ".join([*(f"x{i} * {BETA[i]}::DOUBLE" for i in range(3)), f"{BETA[3]}::DOUBLE"]) + ")"


def truths(spark, sf_dir):
    s, long, _ = mined(spark, sf_dir)
    return s, rules.rule_truths(RULES.atoms(spark), long)


@query("rule_truth", f"WITH {RULED} SELECT rule::BIGINT AS rule, subject_id, truth FROM truth")
def rule_truth(spark, sf_dir):
    return truths(spark, sf_dir)[1].withColumn("rule", F.col("rule").cast("long"))


@query("covariate_matrix", f"WITH {RULED} SELECT subject_id, {_X}, 1.0::DOUBLE AS x3 FROM truth GROUP BY 1")
def covariate_matrix(spark, sf_dir):
    x = rules.covariates(truths(spark, sf_dir)[1], len(RULES))
    return x.select("subject_id", *[F.col("x")[i].alias(f"x{i}") for i in range(4)])


@query("onehot_covariates", "WITH v AS (SELECT DISTINCT c_mktsegment AS label FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT c_custkey AS subject_id, label, (c_mktsegment = label)::INT::DOUBLE AS value FROM customer, v")
def onehot_covariates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_mktsegment")
    return rules.one_hot(c, "c_mktsegment", "BUILDING")


@query("centred_covariate", "SELECT c_custkey AS subject_id, 'c_acctbal' AS label, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) + 0.0 AS value FROM customer")
def centred_covariate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_acctbal")
    return rules.centred(c, "c_acctbal").withColumn("value", r6("value"))


@query("stratify_first_match", f"WITH {RULED} SELECT s.subject_id, s.y, coalesce(min(rule) FILTER (truth), 3)::BIGINT AS stratum FROM subj s LEFT JOIN truth USING (subject_id) GROUP BY ALL")
def stratify_first_match(spark, sf_dir):
    s, t = truths(spark, sf_dir)
    return rules.first_match(s.subjects, t, len(RULES)).withColumn("stratum", F.col("stratum").cast("long"))


@query("y_by_class", f"WITH {RULED}, st AS (SELECT s.subject_id, s.y, coalesce(min(rule) FILTER (truth), 3) AS stratum FROM subj s LEFT JOIN truth USING (subject_id) GROUP BY ALL) SELECT i::BIGINT AS stratum, count(st.subject_id) FILTER (st.y)::BIGINT AS positives, count(st.subject_id)::BIGINT AS total FROM range(4) r(i) LEFT JOIN st ON stratum = i GROUP BY i")
def y_by_class(spark, sf_dir):
    s, t = truths(spark, sf_dir)
    return rules.outcomes_by_stratum(rules.first_match(s.subjects, t, len(RULES)), len(RULES)).withColumn("stratum", F.col("stratum").cast("long"))


@query("predict_probability", f"WITH {RULED}, x AS (SELECT subject_id, {_X} FROM truth GROUP BY 1) SELECT subject_id, round(1 / (1 + exp(-{_ETA})), 6) AS p, 1 / (1 + exp(-{_ETA})) >= 0.5 AS predicted FROM x")
def predict_probability(spark, sf_dir):
    x = rules.covariates(truths(spark, sf_dir)[1], len(RULES))
    p = rules.probability(F.col("x"), BETA)
    return x.select("subject_id", F.round(p, 6).alias("p"), (p >= 0.5).alias("predicted"))


@query("bernoulli_loglik", f"WITH {RULED}, x AS (SELECT subject_id, {_X} FROM truth GROUP BY 1) SELECT round(sum(CASE WHEN y THEN {_ETA} ELSE 0 END - ln(1 + exp({_ETA}))), 5) AS loglik, count(*)::BIGINT AS n FROM x JOIN subj USING (subject_id)")
def bernoulli_loglik(spark, sf_dir):
    s, t = truths(spark, sf_dir)
    x = rules.covariates(t, len(RULES)).join(s.subjects, "subject_id")
    eta = F.aggregate(F.zip_with("x", F.array(*[F.lit(b) for b in BETA]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return x.agg(F.round(F.sum(F.when(F.col("y"), eta).otherwise(0.0) - F.ln(1.0 + F.exp(eta))), 5).alias("loglik"), F.count(F.lit(1)).alias("n"))


@query("initial_detector", f"WITH {detector_sql()}, a AS (SELECT t.t0, t.t1, t.variable, t.type, t.threshold, count(*) FILTER ((l.value > t.threshold) <> s.y) AS above, count(*) FILTER ((l.value <= t.threshold) <> s.y) AS below FROM thr t JOIN long l USING (t0, t1, variable, type) JOIN subj s USING (subject_id) GROUP BY ALL), u AS (SELECT t0, t1, variable, type, threshold, 'above' AS direction, above AS distance FROM a UNION ALL SELECT t0, t1, variable, type, threshold, 'below', below FROM a) SELECT * REPLACE (distance::BIGINT AS distance) FROM u ORDER BY distance, t0, t1, variable, type, threshold, direction LIMIT 1")
def initial_detector(spark, sf_dir):
    """Where a chain starts: the detector with the smallest Hamming distance to the outcome."""
    s, long, cuts = mined(spark, sf_dir)
    n = s.subjects.count()
    d = detectors.agreement(long, cuts, s.subjects).select("*", (F.lit(n) - F.col("agree")).alias("distance")).drop("agree")
    return d.orderBy("distance", "t0", "t1", "variable", "type", "threshold", "direction").limit(1)


# ------------------------------------------------------------------------------------------------ similarity of lists
# Base lists are orders, their atoms line items: variable = supplier, window = quantities, type = return flag.

_LISTS = """
base AS (SELECT l_orderkey AS list, l_linenumber % 2 AS rule, l_linenumber AS atom, s_name AS variable, l_quantity AS t0, l_quantity + 1 + l_partkey % 7 AS t1, l_returnflag AS type
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
target AS (SELECT 0 AS list, p_size % 3 AS rule, p_partkey AS atom, s_name AS variable, p_size::DOUBLE AS t0, p_size + 3.0::DOUBLE AS t1, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS type
  FROM part JOIN supplier ON s_suppkey = 1 + p_partkey % (SELECT max(s_suppkey) FROM supplier)),
sim AS (SELECT ancestor AS a, descendant AS b, pow(0.5, depth) AS similarity FROM paths UNION ALL SELECT descendant, ancestor, pow(0.5, depth) FROM paths WHERE depth > 0),
scored AS (SELECT b.list, b.rule, b.atom, t.rule AS t_rule, t.atom AS t_atom, greatest(0.0, least(b.t1, t.t1) - greatest(b.t0, t.t0)) / nullif(greatest(b.t1 - b.t0, t.t1 - t.t0), 0) * similarity AS score
  FROM base b JOIN sim ON b.variable = sim.a JOIN target t ON t.variable = sim.b AND t.type = b.type)
"""


def lists(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    base = lines.select(F.col("l_orderkey").alias("list"), (F.col("l_linenumber") % 2).cast("long").alias("rule"), F.col("l_linenumber").cast("long").alias("atom"), F.col("s_name").alias("variable"), F.col("l_quantity").alias("t0"), (F.col("l_quantity") + 1 + F.col("l_partkey") % 7).alias("t1"), F.col("l_returnflag").alias("type"))
    n = s.agg(F.max("s_suppkey").alias("n"))
    p = table(spark, sf_dir, "part").crossJoin(F.broadcast(n)).withColumn("k", 1 + F.col("p_partkey") % F.col("n")).join(s, F.col("k") == F.col("s_suppkey"))
    kind = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_partkey") % 3 + 1).cast("int"))
    target = p.select(F.lit(0).cast("long").alias("list"), (F.col("p_size") % 3).cast("long").alias("rule"), F.col("p_partkey").alias("atom"), F.col("s_name").alias("variable"), F.col("p_size").cast("double").alias("t0"), (F.col("p_size") + 3.0).alias("t1"), kind.alias("type"))
    from chronoset.operators import tree

    return base, target, tree.similarities(closed(spark, sf_dir)[1])


@query("match_features", f"WITH {TREE}, {_LISTS} SELECT base.list, base.rule::BIGINT AS rule, base.atom::BIGINT AS atom, round(coalesce(max(score), 0.0), 6) AS score FROM base LEFT JOIN scored USING (list, rule, atom) GROUP BY ALL")
def match_features(spark, sf_dir):
    return rules.match_features(*lists(spark, sf_dir)).withColumn("score", F.round("score", 6)).distinct()


@query("match_pairs", f"""WITH {TREE}, {_LISTS},
placed AS (SELECT *, row_number() OVER (PARTITION BY list, rule, atom, t_rule ORDER BY score DESC, t_atom) AS place FROM scored),
top AS (SELECT list, rule, atom, t_rule, max(t_atom) FILTER (place = 1) AS best, max(score) FILTER (place = 1) AS s1, coalesce(max(score) FILTER (place = 2), 0.0) AS s2 FROM placed WHERE place <= 2 GROUP BY ALL),
pairs AS (SELECT x.list, x.rule, x.atom AS first, y.atom AS second, max(CASE WHEN x.best <> y.best THEN x.s1 * y.s1 ELSE greatest(x.s1 * y.s2, x.s2 * y.s1) END) AS score
  FROM top x JOIN top y ON x.list = y.list AND x.rule = y.rule AND x.t_rule = y.t_rule AND x.atom < y.atom GROUP BY ALL)
SELECT a.list, a.rule::BIGINT AS rule, a.atom::BIGINT AS first, b.atom::BIGINT AS second, round(coalesce(p.score, 0.0), 6) AS score
FROM base a JOIN base b ON a.list = b.list AND a.rule = b.rule AND a.atom < b.atom LEFT JOIN pairs p ON p.list = a.list AND p.rule = a.rule AND p.first = a.atom AND p.second = b.atom""")
def match_pairs(spark, sf_dir):
    return rules.match_pairs(*lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------------------------------------ metrics

_SCORES = "scores AS (SELECT doc_id, doc_id % 5 AS fold, quality = 1 AS y, coalesce(length(text), 0)::DOUBLE / (SELECT max(length(text)) FROM documents) AS score FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def scores(spark, sf_dir):
    """Outcomes and scores with ties: quality of documents, and their length by the longest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("n"))
    longest = d.agg(F.max("n").alias("top"))
    s = table(spark, sf_dir, "labels").where("quality is not null").join(d, "doc_id").crossJoin(F.broadcast(longest))
    return s.select("doc_id", (F.col("doc_id") % 5).alias("fold"), (F.col("quality") == 1).alias("y"), (F.col("n") / F.col("top")).alias("score"))


_AUC = "SELECT {by} (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0)::DOUBLE AS auc FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY score) + (count(*) OVER (PARTITION BY {part}, score) - 1) / 2.0::DOUBLE AS r FROM scores) {group}"


@query("metric_auc", f"WITH {_SCORES} SELECT round(auc, 9) AS auc FROM ({_AUC.format(by='', part='1', group='')})")
def metric_auc(spark, sf_dir):
    return metrics.auc(scores(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


_AP = "SELECT {by} sum(p * pos) / nullif(sum(pos), 0) AS ap FROM (SELECT {by} pos, sum(pos) OVER w / sum(n) OVER w AS p FROM (SELECT {by} score, count(*) FILTER (y) AS pos, count(*) AS n FROM scores GROUP BY ALL) WINDOW w AS ({part} ORDER BY score DESC)) {group}"


@query("metric_average_precision", f"WITH {_SCORES} SELECT round(ap, 9) AS ap FROM ({_AP.format(by='', part='', group='')})")
def metric_average_precision(spark, sf_dir):
    return metrics.average_precision(scores(spark, sf_dir)).withColumn("ap", F.round("ap", 9))


def _confusion(test: str) -> str:
    c = f"count(*) FILTER (NOT score {test} AND NOT y) AS tn, count(*) FILTER (score {test} AND NOT y) AS fp, count(*) FILTER (NOT score {test} AND y) AS fn, count(*) FILTER (score {test} AND y) AS tp"
    return c.replace("NOT score >= 0.1", "score < 0.1").replace("NOT score > 0.5", "score <= 0.5")


_RATES = """coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc"""


@query("metric_confusion", f"WITH {_SCORES}, c AS (SELECT {_confusion('>= 0.1')} FROM scores) SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(mcc, 9) AS mcc FROM (SELECT *, {_RATES} FROM c)")
def metric_confusion(spark, sf_dir):
    c = metrics.confusion(scores(spark, sf_dir), 0.1)
    return c.select("tn", "fp", "fn", "tp", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1", "mcc")])


@query("metric_table_folds", f"""WITH {_SCORES}, a AS ({_AUC.format(by='fold,', part='fold', group='GROUP BY fold')}), p AS ({_AP.format(by='fold,', part='PARTITION BY fold', group='GROUP BY fold')}),
c AS (SELECT fold, {_confusion('> 0.5')} FROM scores GROUP BY fold), m AS (SELECT fold, auc, ap, tn, fp, fn, tp, {_RATES} FROM a JOIN p USING (fold) JOIN c USING (fold)),
u AS (SELECT fold::VARCHAR AS fold, auc, ap, f1, mcc, precision, recall, tn, fp, fn, tp FROM m UNION ALL SELECT 'all', median(auc), median(ap), median(f1), median(mcc), median(precision), median(recall), sum(tn), sum(fp), sum(fn), sum(tp) FROM m)
SELECT fold, round(auc, 8) AS auc, round(ap, 8) AS ap, round(f1, 8) AS f1, round(mcc, 8) AS mcc, round(precision, 8) AS precision, round(recall, 8) AS recall, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM u""")
def metric_table_folds(spark, sf_dir):
    t = metrics.fold_table(scores(spark, sf_dir))
    return t.select("fold", *[F.round(c, 8).alias(c) for c in ("auc", "ap", "f1", "mcc", "precision", "recall")], "tn", "fp", "fn", "tp")


@query("stratified_folds", "SELECT c_custkey AS subject_id, c_mktsegment = 'BUILDING' AS y, ((row_number() OVER (ORDER BY c_mktsegment = 'BUILDING' DESC, c_custkey) - 1) % 5)::BIGINT AS fold FROM customer")
def stratified_folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_mktsegment") == "BUILDING").alias("y"))
    return metrics.stratified_folds(c, 5)


@query("loo_folds", "SELECT c_custkey AS subject_id, c_mktsegment = 'BUILDING' AS y, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS fold FROM customer")
def loo_folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_mktsegment") == "BUILDING").alias("y"))
    return metrics.leave_one_out(c)


@query("fold_detectors", f"""WITH {detector_sql()}, f AS (SELECT subject_id, (row_number() OVER (ORDER BY y DESC, subject_id) - 1) % 3 AS fold FROM subj),
l AS (SELECT k.k AS fold_id, long.* FROM long JOIN f USING (subject_id), range(3) k(k) WHERE f.fold <> k.k)
SELECT fold_id::BIGINT AS fold_id, t0, t1, variable, type, count(DISTINCT threshold)::BIGINT AS n_thresholds FROM (
  SELECT *, round(0.5 * (value + lead(value) OVER (PARTITION BY fold_id, t0, t1, variable, type ORDER BY value)), 8) AS threshold FROM l) WHERE threshold IS NOT NULL GROUP BY ALL""")
def fold_detectors(spark, sf_dir):
    """Thresholds mined again on the training subjects of each fold, all folds at once; windows stay as they are."""
    s, long, _ = mined(spark, sf_dir)
    train = metrics.memberships(metrics.stratified_folds(s.subjects, 3), 3).where("train").select("fold_id", "subject_id")
    cuts = detectors.thresholds(long.join(train, "subject_id"), ("fold_id",))
    return cuts.groupBy("fold_id", "t0", "t1", "variable", "type").agg(F.count(F.lit(1)).alias("n_thresholds"))


@query("rhat_trace", """WITH t AS (SELECT o_custkey % 4 AS chain, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v FROM orders),
n AS (SELECT chain, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT t.chain, i >= n // 2 AS second, CASE WHEN i >= n // 2 THEN i - n // 2 ELSE i END AS pos, v FROM t JOIN n USING (chain) WHERE i >= n // 2 OR i < n // 2 - 1),
c AS (SELECT unnest(generate_series(250, (SELECT min(n // 2 - 1) FROM n), 250)) AS upto),
p AS (SELECT chain, second, upto, avg(v) AS mean, var_samp(v) AS var FROM h JOIN c ON pos < upto - 1 GROUP BY ALL),
b AS (SELECT upto, var_samp(mean) AS vm, avg(var) AS w FROM p GROUP BY 1)
SELECT 'price' AS parameter, upto::BIGINT AS upto, round(sqrt(((upto - 2) / (upto - 1)::DOUBLE * w + vm) / w), 6) AS rhat FROM b""")
def rhat_trace(spark, sf_dir):
    """Split R-hat of order prices, with customers modulo 4 as chains and orders as iterations."""
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("chain"), "o_orderkey", F.col("o_totalprice").alias("value"))
    t = numbered(t, "chain", "o_orderkey")
    starts = t.groupBy("chain").agg(F.min("place").alias("start"))
    t = t.join(F.broadcast(starts), "chain").select("chain", (F.col("place") - F.col("start")).alias("iteration"), F.lit("price").alias("parameter"), "value")  # a row for each chain
    return metrics.split_rhat(t).withColumn("rhat", F.round("rhat", 6))


# ------------------------------------------------------------------------------------------------ posterior
# Stored states are orders, the detectors in them the suppliers of their line items.

_STATES = """
atom AS (SELECT l_orderkey AS state, l_linenumber % 3 AS rule, l_linenumber AS place, l_suppkey AS detector, s_nationkey AS variable, l_quantity AS beta FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
state AS (SELECT o_orderkey AS state, coalesce(n, 0) AS length, round(-o_totalprice / 1000, 6) AS score FROM orders LEFT JOIN (SELECT state, count(*) AS n FROM atom GROUP BY 1) c ON state = o_orderkey)
"""


def states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("variable"))
    lines = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    atoms = lines.select(F.col("l_orderkey").alias("state"), (F.col("l_linenumber") % 3).alias("rule"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("detector"), "variable", F.col("l_quantity").alias("beta"))
    st = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("state"), F.round(-F.col("o_totalprice") / 1000, 6).alias("score"))
    return posterior.with_lengths(st, atoms), atoms


@query("posterior_primitive_freq", f"WITH {_STATES} SELECT detector, count(*)::BIGINT AS n, count(DISTINCT state)::BIGINT AS n_states, round(count(DISTINCT state)::DOUBLE / (SELECT count(*) FROM state), 9) AS posterior, median(beta) AS beta_median, round(quantile_cont(beta, 0.025), 6) AS beta_low, round(quantile_cont(beta, 0.975), 6) AS beta_high FROM atom GROUP BY 1")
def posterior_primitive_freq(spark, sf_dir):
    st, atoms = states(spark, sf_dir)
    t = posterior.tabulate(st, atoms, "detector")
    return t.select("detector", "n", "n_states", F.round("posterior", 9).alias("posterior"), "beta_median", F.round("beta_low", 6).alias("beta_low"), F.round("beta_high", 6).alias("beta_high"))


@query("posterior_subrule_freq", f"WITH {_STATES}, sub AS (SELECT state, rule, string_agg(detector::VARCHAR, ',' ORDER BY detector::VARCHAR) AS subrule FROM atom GROUP BY 1, 2) SELECT subrule, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM sub), 12) AS posterior FROM sub GROUP BY 1")
def posterior_subrule_freq(spark, sf_dir):
    return posterior.subrules(states(spark, sf_dir)[1]).withColumn("posterior", F.round("posterior", 12))


@query("posterior_length_dist", f"WITH {_STATES} SELECT i::BIGINT AS length, count(state)::BIGINT AS n, round(count(state)::DOUBLE / (SELECT count(*) FROM state), 9) AS share FROM range((SELECT max(length) + 1 FROM state)) r(i) LEFT JOIN state ON length = i GROUP BY i")
def posterior_length_dist(spark, sf_dir):
    return posterior.length_distribution(states(spark, sf_dir)[0]).withColumn("share", F.round("share", 9))


@query("posterior_top_lengths", f"WITH {_STATES} SELECT length::BIGINT AS length, count(*)::BIGINT AS n FROM state GROUP BY 1 ORDER BY n DESC, length DESC LIMIT 5")
def posterior_top_lengths(spark, sf_dir):
    return states(spark, sf_dir)[0].groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(5)


@query("point_summary", f"WITH {_STATES}, m AS (SELECT arg_max(length, (n, length)) FILTER (length > 0 OR share >= 0.5) AS modal FROM (SELECT length, count(*) AS n, avg((length = 0)::INT) OVER () AS ignored, (SELECT avg((length = 0)::INT) FROM state) AS share FROM state GROUP BY 1)) SELECT state, length::BIGINT AS length, score FROM state WHERE length = (SELECT modal FROM m) ORDER BY score DESC, state LIMIT 1")
def point_summary(spark, sf_dir):
    """The best state among those of the modal length; the first one wins ties."""
    return posterior.point_state(states(spark, sf_dir)[0])


@query("ensemble_probability", "SELECT l_partkey AS subject_id, round(avg(1 / (1 + exp(-(l_quantity - 25) / 10))), 6) AS probability, avg((1 / (1 + exp(-(l_quantity - 25) / 10)) >= 0.5)::INT) >= 0.5 AS predicted FROM lineitem GROUP BY 1")
def ensemble_probability(spark, sf_dir):
    """Means and votes of stored states' probabilities for each subject (parts, with line items as states)."""
    p = 1.0 / (1.0 + F.exp(-(F.col("l_quantity") - 25) / 10))
    return posterior.ensemble(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject_id"), p.alias("p"))).withColumn("probability", F.round("probability", 6))


_LEN = model.length_prior()
_LENS = "len AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {float(p)!r}::DOUBLE)" for i, p in enumerate(_LEN)) + ") t(length, p))"
_PRIOR = f"""{_STATES}, {_LENS},
w AS (SELECT s_suppkey AS detector, s_nationkey AS variable, exp(s_acctbal / 10000) AS w FROM supplier),
slot AS (SELECT detector, variable, w / (SELECT sum(w) FROM w) AS prior FROM w)"""
_BF = "CASE WHEN prior = 0 OR posterior > 1 - 1e-9 THEN 'Infinity'::DOUBLE ELSE posterior / (1 - posterior) / (prior / (1 - prior)) END"


def slot_priors(spark, sf_dir):
    """(detector, variable, prior): what a slot of a rule holds before data, from balances of suppliers."""
    w = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("detector"), F.col("s_nationkey").cast("long").alias("variable"), F.exp(F.col("s_acctbal") / 10000).alias("w"))
    return w.select("detector", "variable", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("prior"))


@query("inclusion_prior", f"WITH {_PRIOR} SELECT detector, round((SELECT sum(p * (1 - pow(1 - slot.prior, length))) FROM len), 9) AS prior FROM slot")
def inclusion_prior(spark, sf_dir):
    return posterior.inclusion_priors(slot_priors(spark, sf_dir), "detector", list(_LEN)).withColumn("prior", F.round("prior", 9))


def _bayes(column: str) -> str:
    return f"""WITH {_PRIOR}, cat AS (SELECT {column}, sum(prior) AS slot FROM slot GROUP BY 1),
pr AS (SELECT {column}, (SELECT sum(p * (1 - pow(1 - cat.slot, length))) FROM len) AS prior FROM cat),
po AS (SELECT {column}, count(DISTINCT state)::DOUBLE / (SELECT count(*) FROM state) AS posterior FROM atom GROUP BY 1),
j AS (SELECT {column}, prior, coalesce(posterior, 0) AS posterior FROM pr LEFT JOIN po USING ({column}))
SELECT {column}::BIGINT AS {column}, round(prior, 9) AS prior, round(posterior, 9) AS posterior, round({_BF}, 6) AS bayes_factor FROM j"""


def _factors(spark, sf_dir, column):
    st, atoms = states(spark, sf_dir)
    f = posterior.bayes_factors(slot_priors(spark, sf_dir), st, atoms, column, list(_LEN))
    return f.select(F.col(column).cast("long").alias(column), *[F.round(c, d).alias(c) for c, d in (("prior", 9), ("posterior", 9), ("bayes_factor", 6))])


@query("bayes_factor_detector", _bayes("detector"))
def bayes_factor_detector(spark, sf_dir):
    return _factors(spark, sf_dir, "detector")


@query("bayes_factor_variable", _bayes("variable"))
def bayes_factor_variable(spark, sf_dir):
    return _factors(spark, sf_dir, "variable")


@query("bayes_factor_top", f"SELECT * FROM ({_bayes('detector')}) ORDER BY bayes_factor DESC, detector DESC LIMIT 10")
def bayes_factor_top(spark, sf_dir):
    return _factors(spark, sf_dir, "detector").orderBy(F.desc("bayes_factor"), F.desc("detector")).limit(10)


@query("flat_prior", """WITH d AS (SELECT p_partkey AS detector, p_retailprice AS weight, p_size::DOUBLE AS duration FROM part WHERE p_size IS NOT NULL AND p_retailprice > 0),
u AS (SELECT detector, (5.0 * 0.4 - 1) * ln(duration / (1.01 * 60)) + (5.0 * 0.6 - 1) * ln(1 - duration / (1.01 * 60)) - pow((ln(weight) - 7.0) / 0.5, 2) / 2 AS raw FROM d)
SELECT detector, round(raw - (SELECT max(raw) FROM u) - ln((SELECT sum(exp(raw - (SELECT max(raw) FROM u))) FROM u)), 6) AS log_prior FROM u""")
def flat_prior(spark, sf_dir):
    d = table(spark, sf_dir, "part").where("p_size is not null and p_retailprice > 0").select(F.col("p_partkey").alias("detector"), F.col("p_retailprice").alias("weight"), F.col("p_size").cast("double").alias("duration"))
    return model.flat_prior(d, 60.0, mean=7.0, std=0.5, fraction=0.4, concentration=5.0).select("detector", F.round("log_prior", 6).alias("log_prior"))


@query("phylogeny_scale", "WITH w AS (SELECT ln(p_retailprice) AS w FROM part WHERE p_retailprice > 0), s AS (SELECT greatest(max(w) - quantile_cont(w, 0.025), 1e-3) AS delta, median(w) AS centre FROM w) SELECT round(delta, 8) AS delta, round(centre, 8) AS centre, round(50 * delta * delta, 7) AS mean_variance, round(25 * delta, 7) AS std_bound FROM s")
def phylogeny_scale(spark, sf_dir):
    w = table(spark, sf_dir, "part").where("p_retailprice > 0").select(F.col("p_retailprice").alias("weight"))
    return model.phylogeny_scale(w).select(F.round("delta", 8).alias("delta"), F.round("centre", 8).alias("centre"), F.round("mean_variance", 7).alias("mean_variance"), F.round("std_bound", 7).alias("std_bound"))


@query("weighted_choice", "WITH r AS (SELECT c_nationkey, c_custkey, sum(abs(c_acctbal)) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS upto, sum(abs(c_acctbal)) OVER (PARTITION BY c_nationkey) AS total FROM customer) SELECT c_nationkey::BIGINT AS category, min(c_custkey) FILTER (upto >= 0.37 * total) AS chosen FROM r GROUP BY 1")
def weighted_choice(spark, sf_dir):
    """For each nation the first customer at which the running weight reaches 0.37 of the total."""
    run = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    w = F.abs("c_acctbal")
    r = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.sum(w).over(run).alias("upto"), F.sum(w).over(Window.partitionBy("c_nationkey")).alias("total"))
    return r.groupBy(F.col("c_nationkey").cast("long").alias("category")).agg(F.min(F.when(F.col("upto") >= 0.37 * F.col("total"), F.col("c_custkey"))).alias("chosen"))


@query("mixing_traces", f"WITH {_STATES} SELECT state, -score AS likelihood, length::BIGINT AS length FROM state")
def mixing_traces(spark, sf_dir):
    return states(spark, sf_dir)[0].select("state", (-F.col("score")).alias("likelihood"), "length")


@query("subject_events", f"WITH {EVENTS} SELECT subject_id, y, variable, round(avg(value), 6) AS mean FROM obs JOIN subj USING (subject_id) GROUP BY ALL")
def subject_events(spark, sf_dir):
    s = events_study(spark, sf_dir)
    return s.observations.join(s.subjects, "subject_id").groupBy("subject_id", "y", "variable").agg(F.round(F.avg("value"), 6).alias("mean"))


_CHAIN = "SELECT o_orderkey % 5 AS chain, o_orderkey // 5 AS iteration FROM orders"


def stored_states(spark, sf_dir):
    """Chain states as the sampler stores them, made from orders: their parts are detectors, line numbers tell rules."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("rule")).agg(F.sort_array(F.collect_list(F.col("l_partkey"))).alias("d"), F.sum("l_quantity").alias("b"))
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("rule", F.array_join(F.transform("d", lambda x: x.cast("string")), "+").alias("t"), F.col("b").cast("double").alias("b"), F.size("d").alias("n")))).alias("r"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")).join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.withColumn("r", F.coalesce("r", F.array().cast("array<struct<rule:long,t:string,b:double,n:int>>")))
    return rows.select((F.col("o_orderkey") % 5).alias("chain"), F.floor(F.col("o_orderkey") / 5).alias("iteration"), F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("length"),
                       F.size("r").cast("long").alias("n_rules"), F.array_join(F.transform("r", lambda x: x["t"]), "/").alias("rules"), (-F.col("price")).alias("log_lik"), F.lit(0.0).alias("log_prior"), F.concat(F.transform("r", lambda x: x["b"]), F.array(F.lit(0.0))).alias("beta"))


_STORED = f"""c AS ({_CHAIN}), top AS (SELECT chain, max(iteration) + 1 AS of_chain FROM c GROUP BY 1),
kept AS (SELECT o_orderkey FROM orders JOIN top ON o_orderkey % 5 = chain WHERE o_orderkey // 5 >= floor(of_chain * 0.25) AND o_orderkey // 5 < of_chain - 1),
sub AS (SELECT l_orderkey, l_linenumber % 2 AS rule, sum(l_quantity)::DOUBLE AS beta FROM lineitem GROUP BY 1, 2),
atom AS (SELECT l.l_orderkey AS state, l.l_partkey AS detector, beta FROM lineitem l JOIN kept ON l.l_orderkey = o_orderkey JOIN sub s ON s.l_orderkey = l.l_orderkey AND s.rule = l.l_linenumber % 2)"""


@query("stored_state_summary", f"WITH {_STORED} SELECT detector, count(*)::BIGINT AS n, count(DISTINCT state)::BIGINT AS n_states, round(count(DISTINCT state)::DOUBLE / (SELECT count(*) FROM kept), 9) AS posterior, median(beta) AS beta_median FROM atom GROUP BY 1")
def stored_state_summary(spark, sf_dir):
    """Stored states less a quarter as burn-in, their rules taken apart, and how often each detector occurs."""
    st, atoms = posterior.states_and_atoms(stored_states(spark, sf_dir), 0.25)
    return posterior.tabulate(st, atoms, "detector").select("detector", "n", "n_states", F.round("posterior", 9).alias("posterior"), "beta_median")


@query("emptiness_factor", f"WITH {_STATES}, p AS (SELECT avg((length = 0)::INT) AS posterior FROM state) SELECT 0.25::DOUBLE AS prior, round(posterior, 9) AS posterior, round(CASE WHEN posterior > 1 - 1e-9 THEN 'Infinity'::DOUBLE ELSE posterior / (1 - posterior) / (0.25 / 0.75) END, 6) AS bayes_factor FROM p")
def emptiness_factor(spark, sf_dir):
    """Posterior odds of lists without a detector by their prior odds."""
    return posterior.emptiness_factor(states(spark, sf_dir)[0], 0.25).select("prior", F.round("posterior", 9).alias("posterior"), F.round("bayes_factor", 6).alias("bayes_factor"))


@query("bayes_factor_top_betas", f"WITH b AS ({_bayes('detector')}), {_STATES.split('WITH ')[-1]}, t AS (SELECT detector, count(DISTINCT state)::BIGINT AS n_states, median(beta) AS beta_median FROM atom GROUP BY 1) SELECT b.detector, bayes_factor, coalesce(n_states, 0)::BIGINT AS n_states, beta_median FROM (SELECT * FROM b WHERE bayes_factor >= 0.5 ORDER BY bayes_factor DESC, detector DESC LIMIT 10) b LEFT JOIN t USING (detector)")
def bayes_factor_top_betas(spark, sf_dir):
    """The ten detectors with the largest Bayes factors, how often they were seen, and their coefficients."""
    st, atoms = states(spark, sf_dir)
    top = posterior.best_by_factor(_factors(spark, sf_dir, "detector"), "detector", posterior.tabulate(st, atoms, "detector"), 10, 0.5)
    return top.select("detector", "bayes_factor", "n_states", "beta_median")


@query("bayes_factor_top_ranges", f"WITH b AS ({_bayes('variable')}), {_STATES.split('WITH ')[-1]}, t AS (SELECT variable, count(DISTINCT state)::BIGINT AS n_states, median(beta) AS beta_median, quantile_cont(beta, 0.025) AS lo, quantile_cont(beta, 0.975) AS hi FROM atom GROUP BY 1) SELECT b.variable, bayes_factor, coalesce(n_states, 0)::BIGINT AS n_states, beta_median, round(lo, 6) AS beta_low, round(hi, 6) AS beta_high FROM (SELECT * FROM b ORDER BY bayes_factor DESC, variable DESC LIMIT 10) b LEFT JOIN t USING (variable)")
def bayes_factor_top_ranges(spark, sf_dir):
    """The ten variables with the largest Bayes factors, with the 95 % ranges of their coefficients."""
    st, atoms = states(spark, sf_dir)
    top = posterior.best_by_factor(_factors(spark, sf_dir, "variable"), "variable", posterior.tabulate(st, atoms, "variable"), 10)
    return top.select("variable", "bayes_factor", "n_states", "beta_median", F.round("beta_low", 6).alias("beta_low"), F.round("beta_high", 6).alias("beta_high"))


@query("grid_cells", f"""WITH {TREE}, d AS (SELECT l_orderkey * 10 + l_linenumber AS detector, s_name AS ancestor, l_quantity::DOUBLE AS t0, (l_quantity + l_partkey % 20)::DOUBLE AS t1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT i AS n, i * 10 + 5.0 AS mid FROM range(6) r(i))
SELECT leaf || '' AS leaf, n::BIGINT AS n, count(*)::BIGINT AS n_detectors FROM (SELECT detector, n, descendant AS leaf FROM d JOIN m ON mid BETWEEN t0 AND t1 JOIN paths USING (ancestor) WHERE descendant IN (SELECT node FROM leaf)) GROUP BY ALL""")
def grid_cells(spark, sf_dir):
    """How many detectors cover each cell of an interval's middle and a leaf of the tree."""
    from chronoset.operators import tree

    edges, paths = closed(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    d = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("detector"), F.col("s_name").alias("variable"), F.col("l_quantity").cast("double").alias("t0"), (F.col("l_quantity") + F.col("l_partkey") % 20).cast("double").alias("t1"))
    cells = posterior.grid_cells(d, paths, tree.leaves(edges), [(10.0 * i, 10.0 * i + 10) for i in range(6)])
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_detectors")).select(F.substring_index("cell", ":", -1).alias("leaf"), F.substring_index("cell", ":", 1).cast("long").alias("n"), "n_detectors")
