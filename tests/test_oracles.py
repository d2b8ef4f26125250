"""Every query against its SQL twin, on the smallest tables."""

import pytest

from datatrawl.checks.compare import differences, duck
from datatrawl.checks.oracles import ORACLES
from datatrawl.checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_but_the_tree_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == {"html_tree", "nodes_containing", "scope_nodes"}


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, con, name):
    rows, found = differences(spark, con, name, SF)
    assert found == []
    assert rows > 0 or name == "tab_spatialextent"
