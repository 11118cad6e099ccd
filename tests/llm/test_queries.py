"""The registered queries on the small tables, beside their SQL where they have it."""

import pytest

from assay.llm.catalog import QUERIES
from assay.llm.oracle import ORACLE
from tests.compare import difference, duck


@pytest.mark.parametrize("name", list(ORACLE))
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert difference(spark, duck(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir)[0] is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
