"""Walk-forward predictions against brute force; nothing that became known later reaches the past."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.events import causal_base_rate
from tidemark.operators.probability import FitRules, bootstrap_skill, fit_intercept, fit_logistic, predict, walk_forward

RULES = FitRules(most=60, least=20, least_each=5, calibration_most=30, calibration_each=4)
SCHEMA = "prediction_id bigint, event_id string, decision_at timestamp_ntz, outcome_available_at timestamp_ntz, label int, f1 double, f2 double, k string, t int"


def ledger(n=260, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        at = dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 300), hours=rng.randint(0, 23))
        f1, f2 = rng.gauss(0, 1), rng.choice([rng.gauss(0, 1), rng.gauss(0, 1), None, float("nan")])
        label = rng.choice([None, 0, 1]) if i % 9 == 0 else int(rng.random() < 1 / (1 + np.exp(-f1)))
        rows.append((i, rng.choice(["a", "b"]), at if i % 17 else None, at + dt.timedelta(days=rng.randint(1, 20)) if i % 13 else None, label, f1, f2, "clash", 0))
    return rows


def brute(rows):
    out = {}
    rows = [r for r in rows if r[6] is not None and r[6] == r[6]]
    for r in rows:
        if r[2] is None:
            continue
        t = dt.datetime(r[2].year, r[2].month, 1)
        known = sorted((x for x in rows if x[1] == r[1] and x[4] is not None and x[3] is not None and x[3] <= t), key=lambda x: (x[3], x[0]))
        cohort, p = known[-RULES.most :], None
        if len(known) >= RULES.least:
            x, y = np.array([[c[5], c[6]] for c in cohort]), np.array([float(c[4]) for c in cohort])
            if min(y.sum(), len(y) - y.sum()) >= RULES.least_each:
                w = fit_logistic(x, y)
                late = slice(-RULES.calibration_most, None)
                b = fit_intercept(predict(w, x[late]), y[late]) if min(y[late].sum(), len(y[late]) - y[late].sum()) >= RULES.calibration_each else 0.0
                raw = predict(w, np.array([[r[5], r[6]]]))[0]
                p = (raw, 1 / (1 + np.exp(-(np.log(raw / (1 - raw)) + b))))
        out[r[0]] = p
    return out


def run(spark, rows):
    got = walk_forward(spark.createDataFrame(rows, SCHEMA), ["f1", "f2"], RULES).collect()
    return {r.prediction_id: None if r.raw_probability is None else (r.raw_probability, r.probability) for r in got}


def test_walk_forward_equals_brute_force(spark):
    rows = ledger()
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 50
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-7))


def test_future_labels_do_not_reach_the_past(spark):
    rows = ledger()
    cut = dt.datetime(2020, 8, 1)
    turned = [(*r[:4], 1 - r[4] if r[4] is not None and r[3] is not None and r[3] > cut else r[4], *r[5:]) for r in rows]
    a, b = run(spark, rows), run(spark, turned)
    early = {r[0] for r in rows if r[2] is not None and r[2] < cut}
    assert {k: a[k] for k in a if k in early} == {k: b[k] for k in b if k in early}
    assert a != b


def test_base_rate_equals_brute_force(spark):
    rows = ledger()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.event_id, r.decision_at): (r.n, r.positive, r.base_rate) for r in causal_base_rate(df, "event_id", "prediction_id", "decision_at", "outcome_available_at", "label", last=25, minimum=10).collect()}
    for r in rows:
        if r[2] is None:
            continue
        known = sorted((x for x in rows if x[1] == r[1] and x[4] is not None and x[3] is not None and x[3] <= r[2]), key=lambda x: (x[3], x[0]))[-25:]
        s = sum(x[4] for x in known)
        assert got[r[1], r[2]] == (len(known), s, (s + 1) / (len(known) + 2) if len(known) >= 10 else None)


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert walk_forward(empty, ["f1", "f2"], RULES).count() == 0
    assert causal_base_rate(empty, "event_id", "prediction_id", "decision_at", "outcome_available_at", "label").count() == 0


def test_bootstrap_interval_is_reproducible_and_holds_the_estimate(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"event_id": "a", "block": np.arange(600) // 20, "c": rng.random(600) * 0.2, "b": 0.25})
    df = spark.createDataFrame(rows)
    one = bootstrap_skill(df, "event_id", "block", "c", "b", draws=500).first()
    two = bootstrap_skill(df.orderBy(F.rand(3)), "event_id", "block", "c", "b", draws=500).first()
    assert one.low < one.skill < one.high
    assert (two.skill, two.low, two.high) == pytest.approx((one.skill, one.low, one.high), abs=1e-9)
