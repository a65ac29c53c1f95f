"""Golden cases and properties of the library's own operators."""

import numpy as np
import pytest

from chronoset import config
from chronoset.functions import model
from chronoset.functions.chain import Chain
from chronoset.operators import detectors, filters, metrics, posterior, rules, transforms, tree
from chronoset.operators import windows as W
from chronoset.sources import readers
from chronoset.streaming import statistics

OBS = "subject_id long, time double, variable string, value double"


def test_windows_are_closed(spark):
    obs = spark.createDataFrame([(1, 0.0, "a", 1.0), (1, 1.0, "a", 3.0), (1, 2.0, "a", 5.0)], OBS)
    n = {(r["t0"], r["t1"]): r["n"] for r in detectors.values(obs, [(0.0, 1.0), (1.0, 2.0)]).collect()}
    assert n == {(0.0, 1.0): 2, (1.0, 2.0): 2}
    assert W.edges(0.0, 1.0, 3)[-1] == 1.0


def test_slope_of_equal_times(spark):
    obs = spark.createDataFrame([(1, 3.0, "a", 3.0), (1, 3.0, "a", 5.0)], OBS)
    for made in (detectors.values(obs, [(-1.0, 3.0)]), detectors.values_by_atoms(obs, -1.0, 3.0, 1, [(-1.0, 3.0)])):
        assert made.first()["slope"] == pytest.approx(1.6)


def test_atoms_agree_with_values(spark):
    rng = np.random.default_rng(0)
    rows = [(int(s), float(t), v, float(x)) for s in range(4) for t in (0, 1, 2.5, 5, 5, 7.5, 9, 10) for v, x in zip("ab", rng.normal(size=2))]
    obs = spark.createDataFrame(rows, OBS)
    w = W.windows_of(0.0, 10.0, 4)
    key = ["t0", "t1", "variable", "subject_id"]
    a = detectors.values(obs, w).toPandas().sort_values(key)
    b = detectors.values_by_atoms(obs, 0.0, 10.0, 4, w).toPandas().sort_values(key)
    for c in ("average", "slope", "n"):
        assert np.allclose(a[c], b[c], atol=1e-9)


def test_thresholds_truths_and_order(spark):
    long = spark.createDataFrame([(0.0, 1.0, "a", "average", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 5.0])], "t0 double, t1 double, variable string, type string, subject_id long, value double")
    cuts = detectors.thresholds(long)
    assert sorted(r["threshold"] for r in cuts.collect()) == [1.5, 2.0, 3.5]
    pop = detectors.ordered(detectors.population(long, cuts)).collect()
    bits = [r["bits"] for r in sorted(pop, key=lambda r: r["detector_id"])]
    assert bits == sorted(bits) and len(bits) == 6
    by = {(r["threshold"], r["direction"]): r["bits"] for r in pop}
    for t in (1.5, 2.0, 3.5):
        assert all(a != b for a, b in zip(by[t, "above"], by[t, "below"]))
    subjects = spark.createDataFrame([(i, y) for i, y in enumerate([False, True, False, True])], "subject_id long, y boolean")
    agree = {(r["threshold"], r["direction"]): r["agree"] for r in detectors.agreement(long, cuts, subjects).collect()}
    y = "0101"
    assert agree == {k: sum(a == b for a, b in zip(v, y)) for k, v in by.items()}


def test_average_linkage():
    assert detectors.average_linkage_cut(np.array([0.0, 0.1, 5.0, 5.2, 9.0]), 3).tolist() == [0, 0, 1, 1, 2]
    assert detectors.average_linkage_cut(np.array([1.0, 2.0, 3.0]), 2).tolist() == [0, 0, 1]
    assert detectors.average_linkage_cut(np.array([0.0, 1.0, 10.0, 11.0]), 3).tolist() == [0, 0, 1, 1]
    assert detectors.average_linkage_cut(np.array([2.0, 2.0, 2.0]), 3).tolist() == [0, 1, 2]
    rng = np.random.default_rng(2)
    x = np.sort(rng.normal(size=30))
    groups = [[i] for i in range(30)]
    while len(groups) > 6:
        d = [np.mean(np.abs(x[a][:, None] - x[b][None, :])) for a, b in zip(groups, groups[1:])]
        i = int(np.argmin(d))
        groups[i : i + 2] = [groups[i] + groups[i + 1]]
    assert detectors.average_linkage_cut(x, 6).tolist() == [k for k, g in enumerate(groups) for _ in g]


def test_filters(spark):
    obs = spark.createDataFrame([(1, float(t), "a", v) for t, v in enumerate([2.0, 3.0, 0.0, 4.0])], OBS)
    assert filters.longest_runs(obs, 1.0).first()["longest"] == 2
    mad = spark.createDataFrame([(1, float(i), "a", v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0])], OBS)
    r = filters.median_deviations(mad).first()
    assert (r["median"], r["mad"]) == (2.5, 1.0)
    subjects = spark.createDataFrame([(1,), (2,)], "subject_id long")
    kept = filters.dense_subjects(subjects, obs.select("subject_id", "time"), 0.0, 3.0, 1, 1)
    assert [r["subject_id"] for r in kept.collect()] == [1]


def test_transforms(spark):
    obs = spark.createDataFrame([(1, 0.0, "a", 0.0), (1, 0.0, "b", 1e-11), (1, 1.0, "a", 0.0), (1, 1.0, "b", 0.0)], OBS)
    logs = {r["value"] for r in transforms.log_transform(obs).collect()}
    assert len(logs) == 1 and logs.pop() == pytest.approx(np.log(1e-6))
    rel = transforms.relative_abundance(obs).where("time = 1").collect()
    assert [r["value"] for r in rel] == [None, None]
    with pytest.raises(ValueError, match="no such"):
        transforms.internal_normalization(obs, ("zzz",))
    with pytest.raises(ValueError, match="too little"):
        transforms.internal_normalization(obs, ("a",))


def test_trees(spark):
    edges = spark.createDataFrame([("a", "root", 1.0), ("b", "a", 2.0), ("c", "root", 4.0)], "node string, parent string, dist double")
    paths = tree.closure(edges)
    got = {(r["a"], r["b"]): r["similarity"] for r in tree.similarities(paths).collect()}
    assert got["root", "b"] == 0.25 and got["b", "b"] == 1.0
    cut = tree.prune(edges, paths, spark.createDataFrame([("b",)], "node string")).collect()
    assert [(r["node"], r["parent"], r["dist"]) for r in cut] == [("b", "root", 3.0)]
    lengths = {r["node"]: r["length"] for r in tree.subtree_lengths(edges, paths).collect()}
    assert lengths == {"root": 7.0, "a": 3.0, "b": 2.0, "c": 4.0}
    placed = spark.createDataFrame([("s", "b", 0.4, 1.0), ("s", "c", 0.35, 2.0), ("t", "c", 0.9, 1.0)], "sequence string, edge string, lwr double, pendant double")
    assert {r["sequence"]: r["node"] for r in tree.best_placements(placed, paths).collect()} == {"s": "root", "t": "c"}


def test_rules_and_structures():
    d = rules.Detector("v", 0.0, 1.0, "average", "above", 0.5)
    assert d.inverted().direction == "below" and rules.RuleList(((d,),)).structure() == "v average above"
    with pytest.raises(ValueError):
        rules.RuleList(((),))
    assert model.structure_prior([], 0.5) == pytest.approx(np.log(0.5))
    assert model.structure_prior([1] * 11, 0.5) == -np.inf
    assert model.log_multinomial([1, 1, 2]) == pytest.approx(np.log(3))
    assert model.length_prior().sum() == pytest.approx(1.0)


def test_options_equal_dense_normal():
    rng = np.random.default_rng(3)
    x = np.c_[rng.random((30, 2)) > 0.5, np.ones(30)].astype(float)
    y, omega = (rng.random(30) > 0.5).astype(float), rng.random(30) + 0.1
    options = rng.random((6, 30)) > 0.5
    z = (y - 0.5) / omega
    for v, got in zip(options, model.log_likelihoods_of_options(x, options, omega, y, 100.0)):
        full = np.c_[x, v]
        c = np.diag(1 / omega) + 100.0 * full @ full.T
        want = -0.5 * (30 * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + z @ np.linalg.solve(c, z))
        assert got == pytest.approx(want, abs=1e-8)


def test_polya_gamma_moments():
    rng = np.random.default_rng(0)
    for z in (0.0, 1.0, 5.0):
        d = model.polya_gamma(np.full(20_000, z), rng)
        mean = np.tanh(z / 2) / (2 * z) if z else 0.25
        assert d.mean() == pytest.approx(mean, rel=0.02)


def test_prior_only_chain_follows_the_prior():
    n, s = 20, 6
    t = np.random.default_rng(0).random((n, s)) > 0.5
    truths = np.repeat(t, 2, axis=0)
    truths[1::2] = ~t
    chain = Chain(truths, np.zeros(2 * n), np.full(2 * n, 0.5), np.arange(2 * n) ^ 1, np.array([1.0, 0, 1, 0, 1, 0]), [], np.random.default_rng(2), delta=0.5, prior_only=True)
    empty = []
    for _ in range(3000):
        chain.step(1)
        empty.append(not chain.rules)
    assert np.mean(empty) == pytest.approx(0.5, abs=0.12)


def test_metrics(spark):
    s = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.8, True)], "score double, y boolean")
    assert metrics.auc(s).first()["auc"] == pytest.approx(0.875)
    c = metrics.confusion(s, 0.4).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (1, 1, 0, 2)
    rows = [(c, i, "p", float(i % 7)) for c in range(2) for i in range(42)]
    r = metrics.split_rhat(spark.createDataFrame(rows, "chain long, iteration long, parameter string, value double"), every=15).collect()
    assert [x["upto"] for x in r] == [15] and r[0]["rhat"] == pytest.approx(np.sqrt(13 / 14), abs=1e-9)


def test_clusters():
    a = {"variable": "v", "type": "average", "direction": "above", "t0": 0.0, "t1": 10.0}
    b, c = a | {"t0": 4.0}, a | {"t0": 20.0, "t1": 30.0}
    assert posterior.may_join(a, b) and not posterior.may_join(a, c)
    items = [(0.5, a), (0.3, b), (0.2, c)]
    test = lambda cluster, x: all(posterior.may_join(m, x) for m in cluster)
    assert posterior.greedy_clusters(items, test) == [[a, b], [c]]


def test_readers(spark, tmp_path):
    (tmp_path / "ab.csv").write_text('"","O1","O2"\n"s1",1,2\n"s2",3,4\n')
    (tmp_path / "meta.csv").write_text('"s1",10,0.5\ns2,9,1\ns3,9,2\n')
    (tmp_path / "subj.csv").write_text("id,diet\n9,a\n10,b\n")
    (tmp_path / "key.fa").write_text(">O1\nACGT\n>O2\nGGTT\n")
    meta = readers.sample_metadata(spark, str(tmp_path / "meta.csv"))
    assert {r["subject_id"]: r["subject_ord"] for r in meta.collect()} == {"9": 1, "10": 2}
    ab = readers.abundances(spark, str(tmp_path / "ab.csv"))
    subjects, samples, obs = readers.combine(ab, meta, readers.subjects(spark, str(tmp_path / "subj.csv")), "diet", "a")
    assert samples.count() == 2 and obs.count() == 4 and subjects.where("y").count() == 1
    assert {r["name"] for r in readers.fasta(spark, str(tmp_path / "key.fa")).collect()} == {"O1", "O2"}
    rows = readers.newick_edges("((A:1{0},B:2{1}):0.5{2},C:3{3}){4};")
    assert {(n, p, d) for n, p, d, _, _ in rows} == {("0", "2", 1.0), ("1", "2", 2.0), ("2", "4", 0.5), ("3", "4", 3.0), ("4", "", 0.0)}
    (tmp_path / "p.json").write_text('{"tree": "(A:1{0},B:1{1}){2};", "fields": ["edge_num", "like_weight_ratio", "distal_length", "pendant_length"], "placements": [{"p": [[0, 0.9, 0.1, 0.2]], "nm": [["q", 1], ["r", 1]]}]}')
    doc = readers.jplace(spark, str(tmp_path / "p.json"))
    assert {(r["sequence"], r["edge"], r["lwr"]) for r in readers.placements(doc).collect()} == {("q", "0", 0.9), ("r", "0", 0.9)}
    assert readers.tree_edges(doc).count() == 3


def test_config():
    c = config.read_config("[model]\nmax_rules = 4.0\n[preprocessing]\nlog_transform = true\n")
    assert c.model.max_rules == 4 and c.preprocessing.log_transform
    with pytest.raises(KeyError):
        config.read_config("[model]\nzzz = 1\n")


def test_streamed_sums_equal_batch(spark, tmp_path):
    rows = [(1, float(t), "a", float(t * t)) for t in range(6)]
    obs = spark.createDataFrame(rows, OBS)
    for i in range(2):
        obs.where(f"time % 2 = {i}").write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(OBS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    w = [(0.0, 3.0), (3.0, 5.0)]
    q = statistics.write_sums(stream, w, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = statistics.values_of(statistics.merged(spark.read.parquet(str(tmp_path / "out")))).toPandas().sort_values("t0")
    want = detectors.values(obs, w).toPandas().sort_values("t0")
    assert np.allclose(got["slope"], want["slope"]) and np.allclose(got["average"], want["average"])


def test_builders():
    from chronoset.functions import builders

    edges = builders.even_tree(["a", "b", "c", "d"], 2.0)
    assert len(edges) == 6 and {p for _, p, _ in edges} == {"node1", "node2", "root"}
    assert [e[1] for e in builders.uneven_tree(["a", "b", "c"])] == ["node1", "node1", "root", "root"]
    assert builders.random_tree(["a", "b"], seed=3) == builders.random_tree(["a", "b"], seed=3)
    picks = builders.nested_choices(9, [4, 2])
    assert set(picks[2]) <= set(picks[4]) and len(picks[4]) == 4


def test_linear_data_and_outcomes(spark):
    from chronoset.operators import simulate

    subjects = spark.createDataFrame([(i,) for i in range(3)], "subject_id long")
    data = simulate.linear_test_data(subjects, ["a", "b"], 2, 5)
    assert data.count() == 30 and data.toPandas().equals(simulate.linear_test_data(subjects, ["a", "b"], 2, 5).toPandas())
    y = simulate.outcomes(spark.createDataFrame([(1, 0.0), (2, 1.0)], "subject_id long, p double"))
    assert {r["subject_id"]: r["y"] for r in y.collect()} == {1: False, 2: True}
