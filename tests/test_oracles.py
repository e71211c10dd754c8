"""Every registered query against its SQL twin (or for rows only) on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    ok, message = oracle.compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["component"] for r in rows} == {"ned", "rhythm_ned", "pitch_ned", "lift_ned", "articulation_ned", "slur_ned"}
