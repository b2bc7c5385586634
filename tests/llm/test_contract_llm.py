"""The training-data queries of the contract against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_contract import SF, duck, same  # noqa: F401

NAMES = [n for n in entry.queries() if n.startswith("op")]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_all_ten():
    assert {n.split("_")[0] for n in NAMES} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in entry.queries()
