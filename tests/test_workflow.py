"""Small bundles of files from settings to summaries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronoset import __main__ as command
from chronoset import config
from chronoset.operators import transforms
from chronoset.plans import workflow

SETTINGS = """[description]
tag = tiny
[data]
abundance_data = {0}/abundance.csv
sequence_key = {0}/key.fa
sample_metadata = {0}/samples.csv
subject_data = {0}/subjects.csv
jplace_file = {0}/placement.jplace
placement_table = {0}/taxa.csv
outcome_variable = diet
outcome_positive_value = fd
[preprocessing]
min_sample_reads = 10
density_filter_n_samples = 1
density_filter_n_intervals = 2
{1}
[model]
n_intervals = 2
max_thresholds = 3
max_rules = 2
[sampling]
total_samples = 25
chains = 2
[postprocessing]
quick_summary = True
full_summary = True
bayes_factor_samples = 50
"""

TREE = "take_relative_abundance = True\naggregate_on_phylogeny = True\ndiscard_surplus_internal_nodes = True"


@pytest.fixture(scope="module")
def bundle(tmp_path_factory):
    """Twelve subjects, four variables on a tree of four leaves; the outcome follows the first variable late on."""
    r, folder = random.Random(3), tmp_path_factory.mktemp("bundle")
    names, sequences = ["otu1", "otu2", "otu3", "otu4"], ["ACGT", "CCGT", "GGTT", "TTAA"]
    (folder / "key.fa").write_text("".join(f">{n}\n{s}\n" for n, s in zip(names, sequences)))
    samples, rows, subjects = [], [], []
    for s in range(12):
        positive = s % 2 == 0
        subjects.append(f"s{s},{'fd' if positive else 'bd'}")
        for t in range(6):
            samples.append(f"m{s}_{t},s{s},{t * 10}")
            first = 60 if positive and t >= 3 else 10
            rows.append(f"m{s}_{t}," + ",".join(str(x) for x in (first + r.randrange(5), 20 + r.randrange(9), 15 + r.randrange(9), 30 + r.randrange(9))))
    (folder / "samples.csv").write_text("\n".join(samples) + "\n")
    (folder / "subjects.csv").write_text("id,diet\n" + "\n".join(subjects) + "\n")
    (folder / "abundance.csv").write_text("id," + ",".join(sequences) + "\n" + "\n".join(rows) + "\n")
    (folder / "taxa.csv").write_text("id,genus,species\n" + "\n".join(f"{s},{g},x{i}" for i, (s, g) in enumerate(zip(sequences, "AABB"))) + "\n")
    (folder / "norm.txt").write_text("otu3\notu4\n")
    placed = [{"p": [[edge, -1.0, 0.9, 0.01, 0.1], [4 if edge < 2 else 5, -2.0, 0.1, 0.01, 0.2]], "nm": [[name, 1]]} for name, edge in zip(names, (0, 1, 2, 3))]
    tree = "((a:1.0{0},b:1.0{1}):0.5{4},(c:1.0{2},d:1.0{3}):0.5{5}):0.0{6};"
    text = {"tree": tree, "fields": ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"], "placements": placed, "version": 3, "metadata": {}}
    (folder / "placement.jplace").write_text(json.dumps(text))
    return folder


def test_bundle_with_a_tree_runs_end_to_end(spark, bundle):
    settings = config.read_config(SETTINGS.format(bundle, TREE))
    made = workflow.execute(spark, settings)
    seen = {r["variable"] for r in made.observations.select("variable").distinct().collect()}
    assert {"otu1", "otu2", "otu3", "otu4"} < seen, "nodes of the tree are variables too"
    assert made.subjects.count() == 12 and made.states.count() == 2 * 25
    assert made.states.selectExpr("max(n_rules)").first()[0] <= 2
    texts = workflow.summaries(made, settings)
    assert set(texts) == {"quick", "full", "bayes"}
    assert "Bayes factor of the empty list" in texts["quick"] and "6 of 12 subjects are positive" in texts["quick"]
    assert texts["full"].count("Cluster 1:") == 1 and "Best supported variables" in texts["bayes"]
    area = float(texts["quick"].split("Ensemble\nArea under the curve ")[1].split(";")[0])
    assert area > 0.9, "the outcome follows one variable"
    again = workflow.execute(spark, settings)
    assert made.states.select("rules").collect() == again.states.select("rules").collect()


def test_normalization_subsampling_and_shuffled_labels(spark, bundle):
    def preprocessed(lines):
        c = config.read_config(SETTINGS.format(bundle, lines))
        subjects, samples, obs, edges = workflow.loaded(spark, c)
        return workflow.preprocess(obs, samples, subjects, c, edges, workflow.normalizers(spark, c))

    by_file = preprocessed(f"do_internal_normalization = True\nnormalization_variables_file = {bundle}/norm.txt")[0]
    by_taxon = preprocessed("do_internal_normalization = True\nnormalize_by_taxon = B")[0]
    key = ["subject_id", "time", "variable"]
    a, b = (f.select(*key, "value").toPandas().sort_values(key, ignore_index=True) for f in (by_file, by_taxon))
    assert (a["value"] == b["value"]).all()
    sums = a[a["variable"].isin(["otu3", "otu4"])].groupby(["subject_id", "time"])["value"].sum()
    assert (abs(sums - 1) < 1e-9).all()
    few = preprocessed("subsample_subjects = 5")
    assert few[2].count() == 5 and few[0].select("subject_id").distinct().count() == 5
    shuffled = preprocessed("randomize_labels = True")[2]
    assert shuffled.where("y").count() == 6
    with pytest.raises(ValueError):
        preprocessed("subsample_subjects = 50")
    with pytest.raises(ValueError):
        preprocessed("do_internal_normalization = True\nnormalize_by_taxon = nowhere")


@pytest.mark.parametrize("section, lines", [
    ("data", "additional_subject_covariates = sex"), ("data", "data_type = other"), ("crossvalidation", "folds = 3"),
    ("preprocessing", "take_relative_abundance = True\ndo_internal_normalization = True\nnormalize_by_taxon = A"),
    ("preprocessing", "do_internal_normalization = True"), ("data", "load_example = x"), ("preprocessing", "do_internal_normalization = True\nnormalize_by_taxon = A")])
def test_settings_without_effect_are_refused(spark, section, lines):
    with pytest.raises(ValueError):
        workflow.execute(spark, config.read_config(f"[{section}]\n{lines}"))


def test_examples_fill_in_settings():
    held = config.read_examples("[one]\ntag = first\nabundance_data = $DIR/a.csv\noutcome_variable = diet\n[two]\ndata_type = metaphlan\n", "/bundles/")
    c = config.with_example(config.read_config("[data]\nload_example = one\noutcome_variable = other\n[model]\nn_intervals = 3"), held)
    assert (c.data.abundance_data, c.data.outcome_variable, c.description.tag, c.model.n_intervals) == ("/bundles/one/a.csv", "other", "first", 3)
    assert held["two"][1].data_type == "metaphlan"
    with pytest.raises(KeyError):
        config.with_example(config.read_config("[data]\nload_example = three"), held)
    with pytest.raises(KeyError):
        config.read_examples("[one]\nnothing = 1", "/x")


def test_metaphlan_bundle(spark, tmp_path):
    clades = ["k__Bacteria", "k__Bacteria|p__A", "k__Bacteria|p__A|c__X", "k__Bacteria|p__A|c__Y", "k__Bacteria|p__B"]
    samples = [f"m{s}_{t}" for s in range(4) for t in range(3)]
    lines = ["ID\t" + "\t".join(samples)]
    shares = {clades[0]: 100, clades[1]: 60, clades[2]: 40, clades[3]: 20, clades[4]: 40}
    lines += [c + "\t" + "\t".join(str(shares[c] + i % 3) for i in range(len(samples))) for c in clades]
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "m.csv").write_text("".join(f"m{s}_{t},{s},{t}\n" for s in range(4) for t in range(3)))
    (tmp_path / "s.csv").write_text("id,Case_Control\n0,case\n1,control\n2,case\n3,control\n")
    text = f"[data]\ndata_type = metaphlan\nabundance_data = {tmp_path}/t.txt\nsample_metadata = {tmp_path}/m.csv\nsubject_data = {tmp_path}/s.csv\noutcome_variable = Case_Control\noutcome_positive_value = case\n"
    c = config.read_config(text + "[preprocessing]\naggregate_on_phylogeny = True\n")
    subjects, samples_, obs, edges = workflow.loaded(spark, c)
    out = workflow.preprocess(obs, samples_, subjects, c, edges)
    assert out[0].count() == 5 * 12 and out[2].where("y").count() == 2  # clades are in the table: none are added
    w = {r["variable"]: r["weight"] for r in workflow.weights(obs.select("variable").distinct(), edges).collect()}
    assert w["k__Bacteria|p__A"] == 3.0 and w["k__Bacteria|p__B"] == 1.0


def test_commands(spark, bundle, tmp_path):
    settings = tmp_path / "run.ini"
    settings.write_text(SETTINGS.format(bundle, TREE).replace("total_samples = 25", "total_samples = 8").replace("full_summary = True", "full_summary = False"))
    assert command.main(["run", str(settings), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/states")).count() == 16
    assert "Point summary" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out/summaries/quick")).collect())
    spark.createDataFrame([(i, i % 2 == 0) for i in range(8)], "subject_id long, y boolean").write.parquet(str(tmp_path / "study/subjects"))
    spark.createDataFrame([(i, float(t)) for i in range(8) for t in range(6)], "subject_id long, time double").write.parquet(str(tmp_path / "study/samples"))
    assert command.main(["subsample", str(tmp_path / "study"), str(tmp_path / "grid"), "6,4", "4,2", "1"]) == 0
    grid = spark.read.parquet(str(tmp_path / "grid"))
    assert {(r["n_subjects"], r["n_points"]): r["count"] for r in grid.groupBy("n_subjects", "n_points").count().collect()} == {(6, 4): 24, (6, 2): 12, (4, 4): 16, (4, 2): 8}
    assert command.main([]) == 2


def test_benchmark_protocol(spark, bundle):
    sections = "[benchmarking]\nnoise_parameter = 300\nzero_threshold = 1e-4\n[comparison_methods]\nn_intervals = 2\nn_consecutive = 1\nn_folds = 2\n[crossvalidation]\nn_folds = 2\ntotal_samples = 10\n"
    c = config.read_config(SETTINGS.format(bundle, TREE) + sections)
    out = workflow.benchmark(spark, c, methods=("random_forest",), trees=4)
    assert list(out) == ["step3", "step4", "step5", "step6"]
    for step, table in out.items():
        rows = {r["fold"]: r for r in table.collect()}
        assert set(rows) == {None, 0, 1} and rows[None]["n"] == 12, step
    with pytest.raises(ValueError):
        workflow.benchmark(spark, config.read_config(SETTINGS.format(bundle, TREE)))


def test_dirichlet_noise(spark):
    obs = spark.createDataFrame([(s, 0.0, v, x) for s in range(400) for v, x in zip("abc", (0.7, 0.3, 0.0))], "subject_id long, time double, variable string, value double")
    out = transforms.dirichlet_noise(obs, 50.0, 0.01, seed=1)
    sums = out.groupBy("subject_id", "time").sum("value").toPandas()["sum(value)"]
    assert (abs(sums - 1) < 1e-9).all() and out.columns == obs.columns
    mean = {r["variable"]: (r["m"], r["s"]) for r in out.groupBy("variable").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).collect()}
    assert mean["a"][0] == pytest.approx(0.7 / 1.01, abs=0.02) and mean["c"][0] == pytest.approx(0.01 / 1.01, abs=0.005)
    assert mean["a"][1] == pytest.approx((0.693 * 0.307 / 51.5) ** 0.5, rel=0.15)
    again = transforms.dirichlet_noise(obs.repartition(3), 50.0, 0.01, seed=1)
    assert out.exceptAll(again).count() == 0
