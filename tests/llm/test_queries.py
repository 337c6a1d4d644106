"""The thin queries against their SQL, on a small scale."""

import pytest

from dwellspark.llm.queries import ORACLES, QUERIES

from ..compare import SF_DIR, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert same(QUERIES[name](spark, SF_DIR), ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
