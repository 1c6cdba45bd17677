"""Every registered query against its SQL on the smallest tables."""

import pytest

from gleanframe.operators import ml
from gleanframe.registry import ORACLES, QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
# run with few trees here, compared in test_ml and test_boosting
TREES = {"ml_rf_reg", "ml_gbt_reg", "ml_gbt_clf", "ml_rf_clf", "ml_gbt_multi"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert differences(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - TREES))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(TREES))
def test_tree_models_give_rows(spark, monkeypatch, name):
    monkeypatch.setattr(ml, "TREES", 5)
    monkeypatch.setattr(ml, "BOOSTS", 3)
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    sections = {r["section"] for r in contract.entry(spark).collect()}
    assert sections == {"overview", "feature", "finding", "recommendation"}
    assert set(contract.oracle_sql()) <= set(contract.queries())
