"""Every registered query of the accountability engine against its SQL oracle."""

import math

import duckdb
import pytest

from tallybook.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if value is not None and not isinstance(value, int) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_oracle(spark, sf_dir, oracle, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert name in registry.ORACLES, "every query of the engine has an oracle"
    result = oracle.sql(registry.ORACLES[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[k]) for k in places) for row in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
