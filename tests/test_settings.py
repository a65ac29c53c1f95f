"""Settings, readers and summaries of stored states."""

import pytest

from chronoset import config
from chronoset.operators import posterior
from chronoset.sources import readers

TEXT = """[general]
verbose = True
[description]
tag = a_study
[data]
load_example = x
outcome_positive_value = 1 ; a remark
[preprocessing]
aggregate_on_phylogeny = True
discard_surplus_internal_nodes = True
[postprocessing]
burnin_fraction = 0.1
gui_output = True
[crossvalidation]
folds = 5
"""


def test_all_sections_are_read():
    c = config.read_config(TEXT)
    assert c.general.verbose and c.description.tag == "a_study" and c.data.outcome_positive_value == "1"
    assert c.preprocessing.aggregate_on_phylogeny and c.postprocessing.burnin_fraction == 0.1 and c.other["crossvalidation"] == {"folds": "5"}
    for bad in ("[nothing]\na = 1", "[other]\na = 1", "[model]\nnothing = 1"):
        with pytest.raises(KeyError):
            config.read_config(bad)


def test_outcomes_are_compared_by_type(spark):
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, y boolean")
    numbers = spark.createDataFrame([(1, 1.0), (2, 0.0)], "id int, y double")
    words = spark.createDataFrame([(1, "Plant"), (2, "Animal"), (3, "1")], "id int, y string")
    held = lambda f, v: [r[0] for r in f.orderBy("id").select(readers.equals(f, "y", v)).collect()]
    assert held(flags, "1") == [True, False, False] and held(flags, "TRUE") == [True, False, False] and held(flags, 0) == [False, True, False]
    assert held(numbers, "1") == [True, False] and held(words, "Plant") == [True, False, False] and held(words, "1") == [False, False, True]


def test_placement_tables_and_variable_lists(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,genus,species\nACGT,A,a\nTTTT,B,\nGGGG,A,b\n")
    (tmp_path / "v.txt").write_text("one\n\n two \none\n")
    names = spark.createDataFrame([("ACGT", "one")], "sequence string, name string")
    table = readers.placement_table(spark, str(tmp_path / "p.csv"), names)
    assert sorted(r["variable"] for r in table.collect()) == ["GGGG", "TTTT", "one"]
    assert sorted(r["variable"] for r in readers.variables_of_taxon(table, "A").collect()) == ["GGGG", "one"]
    assert sorted(r["variable"] for r in readers.variable_list(spark, str(tmp_path / "v.txt")).collect()) == ["one", "two"]


STATES = "chain long, iteration long, length long, n_rules long, rules string, log_lik double, log_prior double, beta array<double>"


def test_stored_states_become_summaries(spark):
    rows = [(c, i, 3, 2, "1+2/3", -float(i), -1.0, [0.5, 1.5, 0.0]) for c in (0, 1) for i in range(9)] + [(c, 9, 0, 0, "", 0.0, 0.0, [0.0]) for c in (0, 1)]
    states, atoms = posterior.states_and_atoms(spark.createDataFrame(rows, STATES), 0.2)
    assert states.count() == 14 and atoms.count() == 14 * 3  # iterations 2 to 8 of each chain
    beta = {r["detector"]: r["beta_median"] for r in posterior.tabulate(states, atoms, "detector").collect()}
    assert beta == {1: 0.5, 2: 0.5, 3: 1.5}
    report = posterior.quick_report(states, atoms).first()
    assert (report["n_states"], report["empty"], report["mean_length"], report["point_rules"], report["point_score"]) == (14, 0.0, 3.0, "1+2/3", -3.0)
    facts = spark.createDataFrame([(1, "a", 0.0, 2.0, "average", "above"), (2, "a", 1.0, 3.0, "average", "above"), (3, "b", 0.0, 2.0, "slope", "below")], "detector long, variable string, t0 double, t1 double, type string, direction string")
    found = posterior.cluster_passes(states, atoms, facts)
    assert sorted(map(sorted, found["primitives"])) == [[1], [2], [3]] or sorted(map(sorted, found["primitives"])) == [[1, 2], [3]]
    assert found["lists"] == [["1,2/3"]] and len(found["subrules"]) == 2
