"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest
from compare import connect, differences

from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    assert not differences(df, con, ORACLES[name])
