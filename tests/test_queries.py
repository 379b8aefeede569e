"""Registered queries against their SQL on the smallest tables; sound measures, which have none, must give rows.

Model fits and permutation tests without SQL are run by ``tests/compare.py``.
"""

import pytest
from compare import compare, duck

from fieldhush.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
# On so few visits the operator gives the exact p and the SQL the normal one; test_stats.py has the exact p-values.
EXACT_P = {"t2_wilcoxon_signed_rank"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) > 150


@pytest.mark.parametrize("name", sorted(set(SQL) - EXACT_P))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    # Some filters (a number of rows per group) leave nothing on these tables, in both engines.
    assert ok or message.endswith("rows=0"), message


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if n.startswith("d")))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["rec", "n_clips", "n_alerts", "n_alerts_sim"]
    assert df.count() == 6
