"""Every query of the catalog runs, and equals its SQL statement where it has one."""

import pytest

from tests.compare import difference, duck
from __spark_entry__ import entry, oracle_sql, queries
from assay.plans.catalog import QUERIES as OWN

# The training-data operators have tests of their own.
QUERIES, ORACLE = {name: query for name, query in queries().items() if name in OWN}, oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    problem, _, _, _ = difference(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
    assert problem is None


def test_statements_belong_to_queries():
    assert set(ORACLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_experiments_are_registered_whole(spark, monkeypatch):
    """All configurations, seeds and published settings reach the jobs behind the queries; no model is fitted here."""
    from assay.plans import catalog, experiments, training

    seen = {}

    class Reached(Exception):
        pass

    def catch(name):
        def job(*args, **named):
            seen[name] = args[3:], named
            raise Reached

        return job

    monkeypatch.setattr(catalog, "_verifier_inputs", lambda *_: (None,) * 5)
    monkeypatch.setattr(experiments, "ablations", catch("ablation_matrix"))
    monkeypatch.setattr(experiments, "baselines", catch("baseline_runs"))
    for name in ("ablation_matrix", "baseline_runs"):
        with pytest.raises(Reached):
            OWN[name](spark, "unused")
    (_, _, configs), rest = seen["ablation_matrix"]
    assert configs == experiments.ABLATIONS and rest == {"seeds": experiments.SEEDS, "base": training.VerifierOptions()}
    assert seen["baseline_runs"][1] == {"seeds": experiments.SEEDS}
    for name in ("verifier_fit", "robustness_run"):
        monkeypatch.setattr(training, "fit_verifier", lambda *args, **named: catch("fit")(None, *args, **named))
        with pytest.raises(Reached):
            OWN[name](spark, "unused")
        assert training.VerifierOptions() in seen["fit"][0]
