"""Global numbering, packed truths, linkage in runs, clusters, slot priors, placements and subsamples against plain Python."""

import itertools
import math
import random
import statistics
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoset.functions import model
from chronoset.operators import clusters, compare, detectors, linkage, metrics, ordering, posterior, sampling, slots, subsample, tree, truths
from chronoset.plans import catalogue
from chronoset.sources import scratch

LONG = "t0 double, t1 double, variable string, type string, subject_id long, value double"


def test_rows_are_numbered_in_order(spark):
    rows = [(int(x), int(x) % 3) for x in np.random.default_rng(0).permutation(500)]
    out = ordering.numbered(spark.createDataFrame(rows, "x long, g long").repartition(7), F.desc("g"), "x", name="n").toPandas().sort_values("n")
    assert list(out["n"]) == list(range(500)) and list(zip(-out["g"], out["x"])) == sorted((-g, x) for x, g in rows)
    assert ordering.numbered(spark.createDataFrame([], "x long"), "x").count() == 0
    run = ordering.running_sum(spark.createDataFrame(rows, "x long, g long"), F.col("x"), ("g",), "x", place="at").toPandas().sort_values(["g", "x"])
    assert (run["upto"] == run.groupby("g")["x"].cumsum()).all() and list(run["at"]) == list(range(500))


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    assert scratch.shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://x:7077")
    monkeypatch.setattr(spark.sparkContext, "_chronoset_shared_dir", None, raising=False)
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            scratch.shared_dir(spark)


def values(n, seed, digits=3):
    return np.round(np.random.default_rng(seed).normal(size=n) ** 3, digits)


@pytest.mark.parametrize("run", [20_000, 13])
def test_linkage_in_runs_is_that_of_all_values(spark, run):
    """Borders of runs change nothing; ties, repeated values, short keys and single values included."""
    sets = {"many": values(150, 1), "tied": np.repeat([1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 13.5], 4), "even": np.arange(40.0), "few": np.array([1.0, 1.0, 4.0]), "one": np.array([2.0])}
    rows = [(0.0, 1.0, k, "average", i, float(x)) for k, v in sets.items() for i, x in enumerate(v)]
    out = linkage.clustered_thresholds(spark.createDataFrame(rows, LONG), detectors.KEY, 4, run=run).collect()
    for k, v in sets.items():
        x = np.sort(v)
        if len(x) > 5:
            edge = np.nonzero(np.diff(detectors.average_linkage_cut(x, 5)))[0]
            want = {round(0.5 * (x[i] + x[i + 1]), 8) for i in edge}
        else:
            want = {round(0.5 * (a + b), 8) for a, b in itertools.pairwise(x)}
        assert {r["threshold"] for r in out if r["variable"] == k} == want, k


def test_packed_truths(spark):
    """Words over more than two blocks: order, counts and distances are those of the texts of bits."""
    rows = [(0.0, 1.0, v, "average", i, float(x)) for v, s in (("a", 1), ("b", 2)) for i, x in enumerate(values(150, s, 1))]
    long = spark.createDataFrame(rows, LONG)
    subjects = spark.createDataFrame([(i, i % 4 == 0) for i in range(150)], "subject_id long, y boolean")
    cuts = detectors.clustered_thresholds(long, 5)
    places = truths.placed(subjects)
    words = scratch.settle(truths.packed(long, cuts, places), "words")
    assert words.groupBy(*truths.DETECTOR).count().agg(F.max("count")).first()[0] == 3
    got = truths.ordered(words).join(truths.as_text(words, places), list(truths.DETECTOR)).toPandas().sort_values("detector_id")
    want = detectors.ordered(detectors.population(long, cuts)).toPandas().sort_values("detector_id")
    for c in ("bits", *truths.DETECTOR):
        assert list(got[c]) == list(want[c]), c
    y = "".join("1" if i % 4 == 0 else "0" for i in range(150))
    found = {tuple(r[c] for c in truths.DETECTOR): (r["n_true"], r["distance"]) for r in truths.hamming(words, truths.outcome_words(subjects, places)).collect()}
    assert found == {tuple(r[c] for c in truths.DETECTOR): (r["bits"].count("1"), sum(a != b for a, b in zip(r["bits"], y))) for _, r in want.iterrows()}


def test_bins_between_thresholds(spark):
    long = spark.createDataFrame([(0.0, 1.0, "a", "average", i, x) for i, x in enumerate([1.0, 2.0, 3.0, 10.0, 11.0, 30.0])], LONG)
    cuts = spark.createDataFrame([(0.0, 1.0, "a", "average", t) for t in (2.5, 6.0, 6.5, 20.0)], "t0 double, t1 double, variable string, type string, threshold double")
    bins = sorted((r["bin"], r["upper"], r["median"]) for r in linkage.bin_medians(long, cuts, detectors.KEY).collect())
    assert bins == [(0, 2.5, 1.5), (1, 6.0, 3.0), (2, 6.5, 6.5), (3, 20.0, 10.5), (4, math.inf, 30.0)]  # an empty bin has its upper edge
    keep = lambda *a, **k: sorted(r["threshold"] for r in linkage.filter_by_bin_medians(long, cuts, detectors.KEY, *a, **k).collect())
    assert keep(0.0) == [2.5, 6.0, 6.5, 20.0] and keep(15.0) == [20.0] and keep({"average": 15.0}) == [20.0]
    assert keep(math.inf, 10.0) == [2.5, 6.0, 6.5, 20.0] and keep(math.inf, 1e9) == [20.0]


def test_clusters_are_those_of_the_greedy_walk(spark):
    """Blocks and windows give what one walk over all detectors gives, and so do rules and lists."""
    r = random.Random(6)
    facts = {}
    for d in range(160):
        a = r.choice([0.0, 5.0, 10.0, 20.0])
        facts[d] = (r.choice("ab"), a, a + r.choice([5.0, 8.0, 20.0]), r.choice(["average", "slope"]), r.choice(["above", "below"]), float(r.randrange(3)))
    seen = {v: d for d, v in facts.items()}  # distinct facts
    facts = {d: v for v, d in seen.items()}
    ids = sorted(facts)
    states = [(f"s{i}", [[r.choice(ids) for _ in range(r.choice([1, 1, 2]))] for _ in range(r.choice([1, 1, 2]))]) for i in range(120)]
    atoms = spark.createDataFrame([(s, i, j, d, 0.1) for s, rules in states for i, rule in enumerate(rules) for j, d in enumerate(rule)], "state string, rule long, place long, detector long, beta double")
    frame = spark.createDataFrame([(d, *facts[d]) for d in ids], "detector long, variable string, t0 double, t1 double, type string, direction string, threshold double")
    primitives, subrules, lists = clusters.cluster_run(spark.createDataFrame([(s,) for s, _ in states], "state string"), atoms, frame)
    as_sets = lambda df, k: sorted(sorted(m) for m in clusters.members(df, k, 10**6))

    held = {d: {s for s, rules in states if any(d in x for x in rules)} for d in ids}
    items = [(len(held[d]) / len(states), d) for d in ids if held[d]]
    fact = {d: dict(zip(("variable", "t0", "t1", "type", "direction"), facts[d])) for d in ids}
    want = posterior.greedy_clusters(sorted(items), lambda c, d: all(posterior.may_join(fact[x], fact[d]) for x in c))
    assert as_sets(primitives, "detector") == sorted(map(sorted, want))
    of = {d: i for i, c in enumerate(want) for d in c}

    name = lambda rule: ",".join(sorted(map(str, rule)))
    rules = {n: {s for s, x in states if n in map(name, x)} for n in {name(rule) for _, x in states for rule in x}}
    form = lambda n: sorted(of[int(d)] for d in n.split(","))
    turned = {d: next((e for e in ids if held[e] and facts[e][:4] == facts[d][:4] and facts[e][5] == facts[d][5] and facts[e][4] != facts[d][4]), None) for d in ids}

    def may(c, n):
        seed = c[0]
        if form(seed) == form(n):
            return True
        other = turned[int(seed)] if "," not in seed else None
        return "," not in n and other is not None and form(n) == [of[other]]

    want = posterior.greedy_clusters(sorted((len(v) / len(states), n) for n, v in rules.items()), may)
    assert as_sets(subrules, "subrule") == sorted(map(sorted, want))
    of_rule = {n: i for i, c in enumerate(want) for n in c}
    texts = ["/".join(sorted(map(name, x))) for _, x in states]
    shape = lambda t: sorted(of_rule[n] for n in t.split("/"))
    want = posterior.greedy_clusters(sorted((texts.count(t) / len(texts), t) for t in set(texts)), lambda c, t: shape(c[0]) == shape(t))
    assert as_sets(lists, "list") == sorted(map(sorted, want))
    shares = [row["posterior"] for row in lists.select("cluster", "posterior").distinct().orderBy("cluster").collect()]
    assert shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(1)


def test_slot_priors_average_flat_priors(spark):
    d = spark.createDataFrame([(i, float(w), float(x)) for i, (w, x) in enumerate([(1, 5), (1, 5), (3, 5), (2, 9), (7, 2)])], "detector long, weight double, duration double")
    scale = model.phylogeny_scale(d.select("weight"))
    draws = scratch.settle(slots.hyper_draws(spark, 7, scale), "draws")
    rows = draws.collect()
    assert all(0 < r["fraction"] < 1 and r["std"] > 0 and r["concentration"] > 0 for r in rows)
    each = [{r["detector"]: math.exp(r["log_prior"]) for r in model.flat_prior(d, 10.0, mean=h["mean"], std=h["std"], fraction=h["fraction"], concentration=h["concentration"]).collect()} for h in rows]
    for r in slots.slot_priors(d, draws, 10.0, batch=3).collect():
        p = [e[r["detector"]] for e in each]
        assert r["prior"] == pytest.approx(statistics.mean(p)) and r["standard_error"] == pytest.approx(statistics.stdev(p) / math.sqrt(7))
    broken = draws.withColumn("std", F.when(F.col("draw") == 0, 0.0).otherwise(F.col("std")))
    with pytest.raises(ValueError):
        slots.slot_priors(d, broken, 10.0)
    many = scratch.settle(slots.hyper_draws(spark, 4000, scale, seed=3), "draws").toPandas()
    row = scale.first()
    assert abs(many["mean"].mean() - row["centre"]) < 0.1 * math.sqrt(row["mean_variance"]) and many["mean"].std() == pytest.approx(math.sqrt(row["mean_variance"]), rel=0.1)
    assert many["concentration"].mean() == pytest.approx(5.0, rel=0.1) and many["fraction"].mean() == pytest.approx(0.5, abs=0.05)


def test_placements_weigh_ancestors(spark):
    edges = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 1.0), ("c", "q", 1.0), ("d", "q", 1.0), ("p", "r", 0.5), ("q", "r", 0.5)], "node string, parent string, dist double")
    placed = spark.createDataFrame([("x", "a", 0.75, 0.2), ("x", "b", 0.25, 0.6), ("y", "c", 1.0, 0.1), ("z", "d", 1.0, 9.0)], "sequence string, edge string, lwr double, pendant double")
    obs = spark.createDataFrame([(1, 0.0, "x", 8.0), (1, 0.0, "y", 2.0)], "subject_id long, time double, variable string, value double")
    out, lengths = tree.aggregate_by_placements(obs, placed, edges)
    assert {r["variable"]: r["value"] for r in out.collect()} == {"x": 8.0, "y": 2.0, "a": 6.0, "b": 2.0, "p": 8.0, "c": 2.0, "r": 10.0}  # q has one child left
    w = {r["variable"]: round(r["weight"], 9) for r in lengths.collect()}
    assert w == {"x": 0.3, "y": 0.1, "a": 1.2, "b": 1.6, "p": 3.3, "c": 1.6, "r": 4.9}
    with pytest.raises(ValueError):
        tree.aggregate_by_placements(obs.unionByName(obs.withColumn("variable", F.lit("lost"))), placed, edges)


def test_clades_by_peak(spark):
    rows = [(s, float(t), v, x) for s, t, a, b, c in [(1, 0, 1, 1, 8), (1, 1, 4, 4, 2), (2, 0, 2, 1, 7), (3, 0, 0, 0, 0), (3, 1, 5, 5, 0)] for v, x in zip("abc", map(float, (a, b, c)))]
    obs = spark.createDataFrame(rows, "subject_id long, time double, variable string, value double")
    clades = spark.createDataFrame([("ab", "a"), ("ab", "b"), ("c", "c"), ("all", "a"), ("all", "b"), ("all", "c")], "clade string, member string")
    found = {r["clade"]: (r["n_members"], round(r["lowest"], 9), round(r["highest"], 9)) for r in tree.clades_by_peak(obs, clades, 0.0, 1.0, 2).collect()}
    assert found == {"ab": (2, 0.3, 1.0), "c": (1, 0.0, 0.8)}
    assert [r["clade"] for r in tree.clades_by_peak(obs, clades, 0.2, 1.0, 3).orderBy("clade").collect()] == ["ab", "all"]


def test_subsamples_are_nested_and_even(spark):
    def best(positions, k, n):
        cost = lambda c: round(sum(1 / (b - a) ** 2 for a, b in itertools.combinations((-1, *c, n + 1), 2)), 12)
        return list(min(itertools.combinations(positions, k), key=lambda c: (cost(c), c)))

    samples = spark.createDataFrame([(s, float(t * t)) for s, m in ((1, 9), (2, 4), (3, 2)) for t in range(m)], "subject_id long, time double")
    out = subsample.nested_timepoints(samples, [2, 4]).toPandas()
    got = {(r.subject_id, r.size): [] for r in out.itertuples(index=False)}
    for row in out.sort_values("position").to_dict("records"):
        got[row["subject_id"], row["size"]] = got.get((row["subject_id"], row["size"]), []) + [row["position"]]
    for s, m in ((1, 9), (2, 4)):
        four = best(range(m), 4, 9)
        assert got[s, 4] == four and got[s, 2] == best(four, 2, 9)
    assert not any(k[0] == 3 for k in got if got[k])
    people = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "subject_id long, y boolean")
    held = subsample.nested_subjects(people, [4, 9], seed=2).toPandas()
    small, large = (set(held[held["size"] == k]["subject_id"]) for k in (4, 9))
    assert small < large and held[held["size"] == 9]["y"].sum() == 4 and len(large) == 9
    with pytest.raises(ValueError):
        subsample.nested_subjects(people, [40], seed=2)


def test_report_agrees_with_single_metrics(spark):
    r = np.random.default_rng(9)
    scores = spark.createDataFrame([(m, f, bool(r.random() < 0.4), round(float(r.random()), 2)) for m in "ab" for f in range(3) for _ in range(40)] + [("c", 0, True, 0.7)], "method string, fold long, y boolean, score double")
    got = {(x["method"], x["fold"]): x for x in metrics.report(scores).collect()}
    assert len(got) == 10
    one = lambda df: df.first()
    for (m, f), x in got.items():
        part = scores.where(F.col("method") == m) if f is None else scores.where((F.col("method") == m) & (F.col("fold") == f))
        c = one(metrics.confusion(part, strict=True))
        assert all(x[k] == pytest.approx(c[k]) for k in ("tn", "fp", "fn", "tp", "precision", "recall", "f1", "mcc"))
        for k, v in (("auc", one(metrics.auc(part))["auc"]), ("ap", one(metrics.average_precision(part))["ap"])):
            assert x[k] is None and v is None or x[k] == pytest.approx(v)


def test_methods_are_looked_up(spark):
    features = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(12)], "subject_id long, features array<double>")
    subjects = spark.createDataFrame([(i, i % 2 == 0) for i in range(12)], "subject_id long, y boolean")
    with pytest.raises(KeyError):
        compare.comparison(features, subjects, methods=("nothing",))
    found = compare.comparison(features, subjects, methods=("random_forest",), folds=2, trees=4).collect()
    assert {x["fold"] for x in found} == {None, 0, 1} and all(x["auc"] == 1.0 for x in found)
    alone = compare.comparison(features, subjects, methods=("random_forest",), folds=None, trees=2).collect()
    assert len(alone) == 1 and alone[0]["n"] == 12 and alone[0]["tp"] == 6


def drawn(n, seed):
    """Rows of two keys: values of which many are equal, and distinct ones."""
    r = np.random.default_rng(seed)
    return [(0.0, 1.0, v, "average", i, float(x)) for v, xs in (("a", r.integers(0, 40, n) / 4), ("b", r.permutation(n) / 8)) for i, x in enumerate(xs)]


def joins_of_keys(df):
    """Joins of the plan whose condition names the variable: values that meet the thresholds of their key."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "variable" in line]


def test_sides_are_counted_without_pairs(spark):
    """Values above a threshold come from running counts, never from pairs of values and thresholds."""
    rows = drawn(300, 3)
    long = spark.createDataFrame(rows, LONG)
    cuts = scratch.settle(detectors.thresholds(long), "cuts")
    out = detectors.counted_above(long, cuts)
    assert not joins_of_keys(out)
    got = {(r["variable"], r["threshold"]): (r["n_above"], r["n"]) for r in out.collect()}
    assert got == {(c["variable"], c["threshold"]): (sum(x[5] > c["threshold"] for x in rows if x[2] == c["variable"]), 300) for c in cuts.collect()}
    query = joins_of_keys(catalogue.QUERIES["detector_filter"](spark, "/root/testdata/sf0.001"))
    assert not query, query


def test_medians_of_sides_without_pairs(spark):
    """Medians on both sides are read at their places in the order; nulls are on neither side."""
    rows = drawn(101, 4)
    long = spark.createDataFrame([*rows, (0.0, 1.0, "a", "average", 999, None)], LONG)
    cuts = scratch.settle(detectors.thresholds(spark.createDataFrame(rows, LONG)), "cuts")
    for gap in (0.0, 4.0, 6.25):
        out = detectors.filter_thresholds(cuts, long, gap)
        assert not joins_of_keys(out)
        want = set()
        for c in cuts.collect():
            sides = [[x[5] for x in rows if x[2] == c["variable"] and (x[5] > c["threshold"]) == up] for up in (True, False)]
            if all(sides) and statistics.median(sides[0]) - statistics.median(sides[1]) >= gap:
                want.add((c["variable"], c["threshold"]))
        assert {(r["variable"], r["threshold"]) for r in out.collect()} == want and want


def test_distances_without_pairs(spark):
    """Counts of true subjects and distances to the outcome, some of which are unknown."""
    rows = drawn(90, 5)
    y = [None if i % 7 == 0 else i % 3 == 0 for i in range(90)]
    long, cuts = spark.createDataFrame(rows, LONG), scratch.settle(detectors.thresholds(spark.createDataFrame(rows, LONG)), "cuts")
    out = detectors.distances(long, cuts, spark.createDataFrame(list(enumerate(y)), "subject_id long, y boolean"))
    assert not joins_of_keys(out) and not joins_of_keys(catalogue.QUERIES["truth_hamming"](spark, "/root/testdata/sf0.001"))
    got = {(r["variable"], r["threshold"], r["direction"]): (r["n_true"], r["distance"]) for r in out.collect()}
    assert len(got) == 2 * cuts.count()
    for (v, t, d), found in got.items():
        truth = [((x[5] > t) == (d == "above"), y[x[4]]) for x in rows if x[2] == v]
        assert found == (sum(a for a, _ in truth), sum(a != b for a, b in truth if b is not None))


def test_truths_without_pairs(spark, monkeypatch):
    """Words and texts over parts of thresholds and groups of blocks; nulls, unequal subjects and all directions."""
    monkeypatch.setattr(truths, "BLOCKS", 2)
    monkeypatch.setattr(truths, "PART", 50)
    monkeypatch.setattr(truths, "TEXTS", 30)
    monkeypatch.setattr(truths, "BYTES", 2000)
    rows = [r for r in drawn(200, 6) if r[2] == "a" or r[4] < 140]
    long = spark.createDataFrame([*rows, (0.0, 1.0, "b", "average", 150, None)], LONG)
    cuts = scratch.settle(detectors.thresholds(spark.createDataFrame(rows, LONG)), "cuts")
    subjects = spark.createDataFrame([(i,) for i in range(200)], "subject_id long")
    words = {(r["variable"], r["threshold"], r["direction"], r["block"]): r["word"] for r in truths.packed(long, cuts, truths.placed(subjects)).collect()}
    of = {v: {x[4]: x[5] for x in rows if x[2] == v} for v in "ab"}
    want = {}
    for c in cuts.collect():
        for i, x in of[c["variable"]].items():
            for d in ("above", "below"):
                k = (c["variable"], c["threshold"], d, i // 63)
                want[k] = want.get(k, 0) | ((x > c["threshold"]) == (d == "above")) << (62 - i % 63)
    assert words == want
    got = truths.numbered_texts(long, cuts).toPandas().sort_values("detector_id")
    texts = detectors.ordered(detectors.population(long, cuts)).toPandas().sort_values("detector_id")
    for c in ("detector_id", "bits", *truths.DETECTOR):
        assert list(got[c]) == list(texts[c]), c
    assert set(got["bits"].str.len()) == {200, 141}


def test_split_rhat_adds_parts(spark):
    """R-hat at every cut from sums over the parts between cuts: no row is met by each later cut."""
    r = np.random.default_rng(8)
    x = {c: r.normal(1e4, 2.0, 400 + c) for c in range(3)}
    df = spark.createDataFrame([(c, i, "p", float(v)) for c, xs in x.items() for i, v in enumerate(xs)], "chain long, iteration long, parameter string, value double")
    out = metrics.split_rhat(df, every=30)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {row["upto"]: row["rhat"] for row in out.collect()}
    assert sorted(got) == list(range(30, 200, 30))
    for upto, found in got.items():
        halves = [h[: upto - 1] for xs in x.values() for h in (xs[: len(xs) // 2 - 1], xs[len(xs) // 2 :])]
        w, between = np.mean([h.var(ddof=1) for h in halves]), np.var([h.mean() for h in halves], ddof=1)
        assert found == pytest.approx(math.sqrt(((upto - 2) / (upto - 1) * w + between) / w), abs=1e-9)


def test_choices_are_made_once_for_each_number_of_samples(spark, monkeypatch):
    """Combinations are scored once for all subjects with as many samples."""
    asked, choose = [], subsample.even_choices
    monkeypatch.setattr(subsample, "even_choices", lambda positions, size, n: asked.append(positions.count()) or choose(positions, size, n))
    samples = spark.createDataFrame([(s, float(t)) for s in range(60) for t in range(3 + s % 5)], "subject_id long, time double")
    for of, m in ((None, 7), (5, 5)):
        asked.clear()
        got = {}
        for r in subsample.nested_timepoints(samples, [2, 4], of).collect():
            got.setdefault((r["subject_id"], r["size"]), []).append(r["position"])
        assert asked[0] <= 5 and len(asked) == 2
        assert {k[0] for k in got} == {s for s in range(60) if s % 5}
        cost = lambda c: round(sum(1 / (b - a) ** 2 for a, b in itertools.combinations((-1, *c, m + 1), 2)), 12)  # noqa: B023, E731
        for s in (1, 3, 4):
            four = min(itertools.combinations(range(min(3 + s, m)), 4), key=lambda c: (cost(c), c))
            assert sorted(got[s, 4]) == list(four) and sorted(got[s, 2]) == list(min(itertools.combinations(four, 2), key=lambda c: (cost(c), c)))


def test_slot_priors_meet_in_blocks(spark, monkeypatch):
    """Pairs and draws meet as blocks of arrays; the rows that Spark holds do not grow with their product."""
    monkeypatch.setattr(slots, "PAIRS", 5)
    monkeypatch.setattr(slots, "CELLS", 8)
    r = np.random.default_rng(11)
    parts = [(i, float(r.integers(1, 5)), float(r.integers(1, 5))) for i in range(40)]
    hyper = [(i, *map(float, r.uniform((0.1, 0.3, 0.2, 1.0), (1.0, 1.0, 0.8, 4.0)))) for i in range(12)]
    hyper += [(12 + i, *h[1:]) for i, h in enumerate(hyper[:5])]  # equal draws
    written, settle = [], scratch.settle
    monkeypatch.setattr(slots, "settle", lambda df, name: written.append((out := settle(df, name)).count()) or out)
    d = spark.createDataFrame(parts, "detector long, weight double, duration double").repartition(3)
    out = slots.slot_priors(d, spark.createDataFrame(hyper, "draw long, mean double, std double, fraction double, concentration double"), 10.0, batch=3).collect()
    assert max(written) <= len(hyper)
    shares = []
    for _, mean, std, f, c in hyper:
        logs = [(c * f - 1) * math.log(t / 10.1) + (c * (1 - f) - 1) * math.log(1 - t / 10.1) - ((math.log(w) - mean) / std) ** 2 / 2 for _, w, t in parts]
        shares.append(np.exp(logs) / np.exp(logs).sum())
    shares = np.array(shares)
    assert len(out) == 40
    for x in out:
        s = shares[:, x["detector"]]
        assert x["prior"] == pytest.approx(s.mean(), rel=1e-10) and x["standard_error"] == pytest.approx(s.std(ddof=1) / math.sqrt(len(s)), rel=1e-9)


def test_memory_of_folds_is_bounded(spark, monkeypatch):
    """Likelihoods of all detectors come in blocks, and folds hold packed truths in place of all values."""
    r = np.random.default_rng(12)
    options, omega, y = r.random((120, 20_000)) < 0.3, r.random(20_000) + 0.1, (r.random(20_000) < 0.5).astype(float)
    whole = model.log_likelihoods_of_options(np.ones((20_000, 1)), options, omega, y, 100.0)
    monkeypatch.setattr(model, "CELLS", 100_000)
    tracemalloc.start()
    blocks = model.log_likelihoods_of_options(np.ones((20_000, 1)), options, omega, y, 100.0)
    assert tracemalloc.get_traced_memory()[1] < 6e6
    tracemalloc.stop()
    assert blocks == pytest.approx(whole, rel=1e-12)
    rows = [(0.0, 1.0, v, "average", i, x) for v in "ab" for i, x in enumerate(r.integers(0, 9, 90).astype(float).tolist())]
    long, people = spark.createDataFrame(rows, LONG), spark.createDataFrame([(i, i % 2 == 0, i % 3) for i in range(90)], "subject_id long, y boolean, fold long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "variable string, weight double")
    written, settle = [], scratch.settle
    monkeypatch.setattr(sampling, "settle", lambda df, name: written.append((out := settle(df, name)).toPandas()) or out)
    out = sampling.crossvalidate(long, people, weights, n_folds=3, most_thresholds=3, iterations=3).toPandas()
    assert sorted(out["subject_id"]) == list(range(90)) and (out["fold"] == out["subject_id"] % 3).all() and out["probability"].between(0, 1).all()
    assert len(written[0]) <= 3 * 2 * 3
    for c in written[0].to_dict("records"):
        x = np.array([z[5] for z in rows if z[2] == c["variable"]])
        assert (np.unpackbits(np.frombuffer(c["train"], np.uint8), count=60) == (x[np.arange(90) % 3 != c["fold"]] > c["threshold"])).all()
        cut = detectors.average_linkage_cut(np.sort(x[np.arange(90) % 3 != c["fold"]]), 4)
        assert cut.max() == len(written[0].query("fold == @c['fold'] and variable == @c['variable']"))
    with pytest.raises(Exception, match="no value"):
        sampling.crossvalidate(long.where("subject_id > 0 or variable = 'a'"), people, weights, n_folds=3, most_thresholds=3, iterations=3).collect()


def test_placed_sums_are_not_shuffled(spark, monkeypatch):
    """Sums by sample and node come from the samples' own ranges: after the product no exchange, whatever the size."""
    monkeypatch.setattr(tree, "RANGE", 700)
    r = np.random.default_rng(13)
    names = [f"x{i}" for i in range(30)]
    share = {v: dict(zip(sorted(f"n{k}" for k in r.choice(12, 4, replace=False)), r.random(4).tolist(), strict=True)) for v in names}
    obs = [(int(s), float(t), v, None if r.random() < 0.02 else float(r.integers(1, 50))) for s in range(400) for t in range(3) for v in r.choice(names, 5, replace=False).tolist()]
    obs += [(1, None, "x1", 3.0), (1, None, "x2", 4.0), (2, 9.0, "x3", None), (3, 9.0, "lost", 5.0)]
    values = spark.createDataFrame(obs, "subject_id long, time double, variable string, value double").repartition(7)
    weights = spark.createDataFrame([(v, n, p) for v, of in share.items() for n, p in of.items()], "sequence string, node string, probability double")
    out = tree._weighted_sums(values, weights)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")]
    want = {}
    for s, t, v, x in obs:
        for n, p in share.get(v, {}).items():
            old = want.get((s, t, n))
            want[s, t, n] = old if x is None else (old or 0.0) + x * p
    rows = out.collect()
    got = {(x["subject_id"], x["time"], x["variable"]): x["value"] for x in rows}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert all(got[k] is None if x is None else got[k] == pytest.approx(x) for k, x in want.items())
