"""The registered queries use the domain's windows: 756 sessions and 504 readings, 252 outcomes; small fixtures small ones."""

import datetime as dt
import os

import pytest

import __spark_entry__ as entry
from parity import connection, spark_rows, sql_rows
from tidemark.plans import audit_queries, feature_queries

SMALL = "/root/testdata/sf0.01"


def test_percentile_looks_back_756_sessions_and_needs_504(spark, monkeypatch):
    """Values fall for 300 sessions, then rise: which of them a rank counts shows in its value."""
    values = [float(2000 - i) for i in range(300)] + [float(i) for i in range(300, 1000)]
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), i, v, "m") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, session_date date, idx int, value double, method string")
    monkeypatch.setattr(feature_queries, "_with_method", lambda *a: df)
    got = [r.percentile for r in feature_queries.midrank_by_regime(spark, "").orderBy("session_date").collect()]
    state = {r.idx: r for r in feature_queries.state_frame(spark, "").collect()}
    for i, v in enumerate(values):
        before = values[max(0, i - 756) : i]
        want = sum(b < v for b in before) / len(before) if len(before) >= 504 else None
        assert got[i] == pytest.approx(want) and state[i].p_value == pytest.approx(want)
        assert (state[i].shock is None) == (i < 504 + 5)


def test_base_rate_needs_252_outcomes(spark, monkeypatch):
    t0 = dt.datetime(2020, 1, 1)
    rows = [(i, "a", t0 + dt.timedelta(days=i), t0 + dt.timedelta(days=i, hours=1), i % 2, "ELIGIBLE", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "prediction_id bigint, event_id string, decision_at timestamp_ntz, outcome_available_at timestamp_ntz, label int, event_status string, prediction_date date")
    monkeypatch.setattr(audit_queries, "ledger", lambda *a: df)
    rates = {r.n: r.base_rate for r in audit_queries.base_rate(spark, "").collect()}
    assert rates[251] is None and rates[252] == round(127 / 254, 9)
    assert audit_queries.kth_outcome(spark, "").first().ready_at == rows[251][3]
    decided = {r.prediction_id: r.decision for r in audit_queries.publication_decision(spark, "").collect()}
    assert decided[251] == "INSUFFICIENT_HISTORY" and decided[252] == "BASE_RATE_ONLY"
    assert audit_queries.predictions(spark, "").count() == 48


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("window,least", [(756, 504), (252, 126)])
@pytest.mark.parametrize("name", ["weighted_scores", "phase_ladder", "true_clusters"])
def test_states_equal_sql(spark, monkeypatch, name, window, least):
    monkeypatch.setattr(feature_queries, "WINDOW", window)
    monkeypatch.setattr(feature_queries, "LEAST", least)
    sql = entry.oracle_sql()[name]
    assert "a.idx - 756 " in sql and ">= 504\n" in sql
    got = spark_rows(entry.queries()[name](spark, SMALL))
    assert got[1] and got == sql_rows(connection(SMALL), sql.replace("a.idx - 756 ", f"a.idx - {window} ").replace(">= 504\n", f">= {least}\n"))
