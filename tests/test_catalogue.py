"""Every panel query against its SQL, or for its rows."""

import pytest

from terrapanel.plans.catalogue import ORACLE_SQL, QUERIES

from .conftest import canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf01, duck, name):
    got, want = QUERIES[name](spark, sf01).toPandas(), duck(sf01).execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf01, name):
    assert len(QUERIES[name](spark, sf01).toPandas())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
