"""Every query against its SQL counterpart."""

from __future__ import annotations

import os

import pytest

from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""


NO_BROADCAST = [
    "q10_clipped_floored_share", "q11_lookup_enrich", "q15_cumulative_tiers", "q16_one_vs_rest", "q24_point_in_polygon", "q25_lookup_back",
    "q34_state_facility_table", "q36_exposure_table",
]
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
SALTED = {**SHUFFLED, "spark.sql.adaptive.enabled": "false"}


@pytest.mark.parametrize("settings", [SHUFFLED, SALTED], ids=["shuffled", "salted"])
@pytest.mark.parametrize("name", NO_BROADCAST)
def test_query_matches_sql_without_broadcast(spark, con, name, settings):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
