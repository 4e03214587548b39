"""Requests take part twice in c06, and are made once."""

from oracle import SF

from tilewright.jobs.queries import QUERIES


def test_requests_are_made_once(spark):
    plan = QUERIES["c06_missing_tiles"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan
