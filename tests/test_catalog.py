"""Registered queries against their SQL, on the smallest tables."""

import datetime

import duckdb
import pytest

import __spark_entry__ as contract
from riskframe.catalog import ORACLES, QUERIES
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()



@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float) and v != v:
            return None
        return v.isoformat() if isinstance(v, datetime.date) else v

    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in data)


PICKED = [
    "split_summary", "join_left_flag", "frequency_encoding", "entity_stats_fit", "vocabulary_fit", "velocity",
    "velocity_tied", "rule_score", "ranking_metrics", "recall_at_capacity", "review_shares", "policy_rehearsal",
    "global_cut_best", "cost_sweep", "stability_index", "trigger_windows", "reason_codes", "top_share",
    "level_capture", "daily_profile", "stream_tumbling_rates",
]


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_oracle(spark, db, name):
    got = QUERIES[name](spark, SMALL)
    found = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(found.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(found.columns, found.fetchall())


def test_entry_and_registries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 120


def test_entry_runs(spark):
    row = contract.entry(spark).first()
    assert row["rows"] > 0 and row["usd_per_1000"] > 0


def test_flagship_regression(spark):
    row = QUERIES["ev_policy_summary"](spark, "/root/testdata/sf0.01").first()
    assert (row["rows"], row["usd_per_1000"], row["reviews_per_day"], row["block_rate"]) == (1661, 11809.711017, 3.0, 0.777845)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["io_scan_pruned"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(l_quantity" in plan
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "l_comment" not in scan and "l_extendedprice" not in scan


def test_no_plan_pairs_all_rows(spark):
    for name in ("velocity", "review_shares", "ranking_metrics", "frequency_encoding", "column_drift", "entity_stats_apply"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
