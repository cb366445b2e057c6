"""Sequential walk-forward against brute force: a fit per decision, purged, calibrated from earlier raw probabilities."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators.probability import FitRules, fit_intercept, fit_logistic, predict, sequential_walk_forward
from tidemark.plans import audit_queries

RULES = FitRules(most=50, least=20, least_each=5, calibration_most=25, calibration_each=4, purge=20)
SCHEMA = "prediction_id bigint, event_id string, session int, decision_at timestamp_ntz, outcome_available_at timestamp_ntz, label int, event_status string, f1 double, f2 double"


def ledger(n=420, seed=7):
    """Several predictions a session; some decide early or late, some outcomes come late or never."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = rng.randint(0, 160)
        at = dt.datetime(2020, 1, 1) + dt.timedelta(days=day)
        decision = at + dt.timedelta(days=rng.choice([1, 1, 1, 1, -14, 60]))
        known = at + dt.timedelta(days=rng.choice([5, 8, 12, 12, 45, 140]))
        f1, f2 = rng.gauss(0, 1), rng.choice([rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), None, float("nan")])
        label = None if i % 11 == 0 else int(rng.random() < 1 / (1 + np.exp(-f1)))
        status = "UNOBSERVABLE" if i % 11 == 0 and i % 2 else "ELIGIBLE"
        rows.append((i, rng.choice(["a", "a", "b"]), day if i % 29 else None, decision if i % 17 else None, known if i % 13 else None, label, status, f1, f2))
    return rows


def brute(rows, rules=RULES):
    rows = [r for r in rows if r[8] is not None and r[8] == r[8] and r[2] is not None]
    rows.sort(key=lambda r: (r[2], r[0]))
    raw, out = {}, {}
    for r in (r for r in rows if r[6] == "ELIGIBLE" and r[3] is not None):
        known = [x for x in rows if x[1] == r[1] and x[5] is not None and x[4] is not None and x[4] <= r[3]]
        cohort = [x for x in known if x[2] < r[2] and x[2] <= r[2] - rules.purge][-rules.most :]
        y = np.array([float(c[5]) for c in cohort])
        if len(y) < rules.least or min(y.sum(), len(y) - y.sum()) < rules.least_each:
            continue
        raw[r[0]] = predict(fit_logistic(np.array([[c[7], c[8]] for c in cohort]), y), np.array([[r[7], r[8]]]))[0]
        prior = [x for x in known if x[0] in raw and x[2] < r[2]][-rules.calibration_most :]
        y2, b, p = np.array([float(x[5]) for x in prior]), None, raw[r[0]]
        if prior and min(y2.sum(), len(y2) - y2.sum()) >= rules.calibration_each:
            b = fit_intercept(np.array([raw[x[0]] for x in prior]), y2)
            p = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + b)))
        out[r[0]] = (len(y), int(y.sum()), raw[r[0]], len(prior), int(y2.sum()), b, p)
    return out


def run(spark, rows, rules=RULES):
    got = sequential_walk_forward(spark.createDataFrame(rows, SCHEMA), ["f1", "f2"], rules).collect()
    return {r.prediction_id: (r.n, r.positive, r.raw_probability, r.calibration_n, r.calibration_positive, r.intercept, r.probability) for r in got}


@pytest.mark.parametrize("purge", [0, 20])
def test_equals_brute_force(spark, purge):
    rules = FitRules(most=50, least=20, least_each=5, calibration_most=25, calibration_each=4, purge=purge)
    got, want = run(spark, ledger(), rules), brute(ledger(), rules)
    assert got.keys() == want.keys() and len(want) > 80 and sum(v[5] is not None for v in want.values()) > 30
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-7), k


def test_outcomes_of_purged_sessions_do_not_matter(spark):
    rows = ledger()
    turned = [(*r[:5], 1 - r[5] if r[5] is not None and r[2] is not None and r[2] > 100 else r[5], *r[6:]) for r in rows]
    a, b = run(spark, rows), run(spark, turned)
    early = {r[0] for r in rows if r[2] is not None and r[2] <= 120}
    assert {k: v[:3] for k, v in a.items() if k in early} == {k: v[:3] for k, v in b.items() if k in early}
    assert a != b


def test_empty_ledger(spark):
    assert sequential_walk_forward(spark.createDataFrame([], SCHEMA), ["f1", "f2"], RULES).count() == 0


def test_registered_query_uses_the_domains_rules(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(audit_queries, "_features", lambda *a: None)
    monkeypatch.setattr(audit_queries.probability, "sequential_walk_forward", lambda ledger, features, rules=FitRules(): seen.append(rules))
    audit_queries.logistic_walk_forward(None, "")
    r = seen[0]
    assert (r.most, r.least, r.least_each, r.purge, r.calibration_most, r.calibration_each) == (1500, 252, 30, 20, 252, 20)
