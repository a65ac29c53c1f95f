"""Every registered query with SQL against DuckDB, on the smallest tables."""

import pytest

from chronoset.plans import catalogue
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def con(small_dir):
    return connection(small_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(spark, con, small_dir, name):
    assert_same(spark, con, catalogue.QUERIES[name], catalogue.ORACLE[name], small_dir)


def test_entry_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "detector_best_match_outcome" in e.queries()


def test_runs_and_draws(spark, small_dir):
    states = catalogue.QUERIES["chain_run"](spark, small_dir).toPandas()
    assert len(states) == 160 and states["chain"].nunique() == 4 and states["log_lik"].notna().all()
    again = catalogue.QUERIES["chain_run"](spark, small_dir).toPandas()
    assert states["rules"].tolist() == again["rules"].tolist()
    cohort = catalogue.QUERIES["simulate_cohort"](spark, small_dir)
    sums = cohort.groupBy("subject_id", "time").sum("value").toPandas()["sum(value)"]
    assert (((sums - 1).abs() < 1e-9) | (sums.abs() < 1e-9)).all()
    counts = catalogue.QUERIES["dirichlet_multinomial"](spark, small_dir).groupBy("subject_id", "time").sum("count").toPandas()["sum(count)"]
    assert set(counts) <= {0, 10_000}
