"""Every registered query of the engine against its DuckDB twin."""

import pytest

from graphloom.plans import registry
from tests.compare import differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert differences(spark, SF, registry.QUERIES[name], registry.ORACLES[name]) == ""


def test_loss_falls(spark):
    losses = [r["loss"] for r in registry.train_loss_curve(spark, SF).orderBy("epoch").collect()]
    assert losses[0] > losses[1] > losses[2]
