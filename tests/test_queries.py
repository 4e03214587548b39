"""Every registered map-data query against its SQL."""

import pytest
from oracle import SF, database, same

from tilewright.jobs.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    same(QUERIES[name](spark, SF), db, ORACLES[name])


#: Queries without SQL; each is held against a second implementation in test_cases.py.
PLAIN = {"c10_fit_groups"}


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLES) == PLAIN
