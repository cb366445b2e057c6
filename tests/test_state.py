"""The state layer on rows made by hand: precedence of states, answers, withheld scores, labels with censored tails."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import state

D0 = dt.date(2020, 1, 1)
BASE = dict(
    slope=0.1, basis=0.1, near=-0.1, mid_slope=0.1, d5_mid=0.0, d5_mid_slope=0.0, d5_inversion=0.0, inversion=0.0, p_mid=0.3, shock=20.0, confirmations=0, hard_acute=False, tail=10.0, repair=10.0,
    formal=True, front_formal=True, status="OK", base=30.0, d5_base=0.0,
)
TYPES = {"confirmations": "int", "hard_acute": "boolean", "formal": "boolean", "front_formal": "boolean", "status": "string"}
INPUTS = "carry_risk persistence p_slope p_d5_slope p_basis p_d5_mid p_d5_mid_slope p_d5_near".split()


def frame(spark, rows):
    full = [BASE | {c: 0.5 for c in INPUTS} | r for r in rows]
    names = list(full[0])
    schema = "market string, idx int, session_date date, decision_at timestamp_ntz, " + ", ".join(f"{c} {TYPES.get(c, 'double')}" for c in names)
    data = [("M", i, D0 + dt.timedelta(days=i), dt.datetime(2020, 1, 2) + dt.timedelta(days=i), *[r[c] for c in names]) for i, r in enumerate(full)]
    return spark.createDataFrame(data, schema)


def states(spark, rows):
    return state.with_answers(state.with_predicates(frame(spark, rows), "market", "idx"))


def test_predicates_take_their_precedence_and_know_what_they_do_not_know(spark):
    rows = [{}] * 11 + [{"p_mid": 0.8}, {"d5_mid": -1.0, "d5_mid_slope": 1.0}, {"p_mid": None}, {"d5_mid": 1.0, "d5_inversion": 0.5, "near": 0.2}, {"slope": -0.1}]
    got = [(r.mid_state, r.scope, r.carry_state) for r in states(spark, rows).orderBy("idx").collect()]
    assert got[0] == ("QUIET", "NONE", "RECOVERING")  # no fall of the mid curve, so the unknown days before don't matter
    assert got[10] == ("QUIET", "NONE", "OPEN")
    assert got[11] == ("PRICED", "MID", "CLOSED") and got[12] == ("RECEDING", "NONE", "RECOVERING")
    assert got[13] == ("UNKNOWN", "UNKNOWN", "UNKNOWN") and got[14] == ("RISING", "BROAD", "CLOSED") and got[15][1] == "FRONT"


def test_answers_phases_and_what_is_withheld(spark):
    rows = [{}] * 12 + [{"shock": 90.0, "confirmations": 2, "hard_acute": True}, {"tail": 80.0}, {"tail": None}, {"confirmations": None, "hard_acute": None}, {"formal": False, "status": "PARTIAL"}]
    out = states(spark, rows).orderBy("idx").collect()
    assert (out[11].raw_phase, out[11].pressure_level, out[11].direction) == ("CARRY_SUPPORTIVE_LOW_STRESS", "LOW", "STABLE")
    assert out[12].raw_phase == "ACUTE_FRONT_STRESS" and out[12].shock_answer == "ACUTE" and out[13].raw_phase == "TAIL_RICH_QUIET_CURVE"
    for r in out[14:]:
        assert r.published_status == "PARTIAL" and r.raw_phase == "UNKNOWN" and r.baseline is None and r.pressure_level == "UNKNOWN" and set(r[a] for a in state.ANSWERS) == {"UNKNOWN"}
    assert out[0].published_status == "PARTIAL"  # three of five days can't be known yet


def test_ledger_labels_statuses_and_tails(spark):
    rows = [{}] * 30
    rows[20] = {"hard_acute": True, "shock": 90.0, "confirmations": 2}
    rows[24] = {"hard_acute": None, "confirmations": None}
    led = {(r.event_id, r.idx): r for r in state.event_ledger(states(spark, rows), "market", "idx", "session_date", "decision_at").collect()}
    assert len(led) == 150
    acute = [led["acute_front_stress_5d", i] for i in range(30)]
    hit, miss = acute[17], acute[12]
    assert (hit.event_status, hit.label, hit.label_status, hit.first_hit) == ("ELIGIBLE", 1, "OBSERVED_1", 20)
    assert hit.valid_through == D0 + dt.timedelta(days=22) and hit.outcome_available_at == dt.datetime(2020, 1, 24)  # not before the horizon ends
    assert (miss.label, miss.label_status) == (0, "OBSERVED_0")
    assert acute[20].event_status == "NOT_APPLICABLE" and acute[20].label_status == "NOT_APPLICABLE"
    assert acute[21].label_status == "CENSORED" and acute[24].event_status == "UNOBSERVABLE" and acute[28].label_status == "CENSORED"
    assert led["front_inversion_5d", 21].label == 0  # an unknown of another axis censors nothing here


def test_a_missing_component_leaves_its_axis_null(spark):
    row = {f"p_{c}": 0.5 for c in state.RANKED} | {"inversion": 0.2, "vix": 20.0, "vix9d": 21.0, "f1": 2.0, "f2": 1.0, "value30": 20.0}
    data = [("M", i, *[r[c] for c in row], True) for i, r in enumerate([row, row | {"p_skew": None}, row | {"f1": None}])]
    df = spark.createDataFrame(data, "market string, idx int, " + ", ".join(f"{c} double" for c in row) + ", formal boolean")
    a, b, c = state.with_scores(df, "market", "idx").orderBy("idx").collect()
    assert (a.status, a.confirmations, a.hard_acute) == ("OK", 2, False) and abs(a.base - (0.3 * 50 + 0.3 * 50 + 0.2 * 50 + 0.2 * (45 + 2))) < 1e-9
    assert b.tail is None and b.base is None and b.status == "PARTIAL" and b.shock == a.shock
    assert c.confirmations is None and c.hard_acute is None
    assert df.select(F.count("*")).first()[0] == 3
