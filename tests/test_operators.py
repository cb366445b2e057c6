"""Golden values and properties of the domain's operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vintage
from tidemark.functions.calendar import rule_settlement, snap_back, third_friday, wall_time
from tidemark.functions.identity import frame_digest
from tidemark.functions.scalars import bucket, forward_variance, forward_volatility, log_ratio, ratio, same, weighted_score
from tidemark.operators import folds, pit
from tidemark.operators.audit import leave_one_out_direction
from tidemark.operators.backtest import probe_ledger
from tidemark.operators.curve import curve_table
from tidemark.operators.events import forward_labels, spell_age
from tidemark.operators.probability import fit_intercept, fit_logistic, predict
from tidemark.operators.windows import along, any_true, at_least_true, midrank_percentile, trailing


def feed(machine, values):
    return [machine.push(v) for v in values]


def test_smoothed_average_restarts_after_a_gap():
    assert feed(folds.ema(3), [1, 2, 3, 4, None, 10, 11, 12]) == [None, None, 2, 3, None, None, None, 11]


def test_wilder_average():
    got = feed(folds.Wilder(3), [2, 3, 3, 3])
    assert got[:2] == [None, None] and got[2:] == pytest.approx([8 / 3, (2 * 8 / 3 + 3) / 3])


def test_rsi_limits():
    assert feed(folds.Rsi(14), range(20))[-1] == 100
    assert feed(folds.Rsi(14), [5.0] * 20)[-1] == 50
    assert feed(folds.Rsi(14), range(20, 0, -1))[-1] == 0


def test_macd_first_values():
    out = feed(folds.Macd(), [float(x) for x in range(1, 50)])
    assert next(i for i, (line, _) in enumerate(out) if line is not None) == 25
    assert next(i for i, (_, s) in enumerate(out) if s is not None) == 33


def test_ewma_variance_keeps_its_state_over_a_gap():
    x = [math.log(100) + 0.001 * i for i in range(260)]
    x[254] = None
    out = feed(folds.EwmaVariance(), x)
    assert [i for i, v in enumerate(out) if v is not None] == [252, 253, 256, 257, 258, 259]


A, M, T, C = folds.ACUTE, "MIXED_TRANSITION", "TAIL_RICH_QUIET_CURVE", "CARRY_SUPPORTIVE_LOW_STRESS"


def phases(raw, idx=None, acute=None, shock=None, ok=None):
    n = len(raw)
    rows = zip(raw, ok or [True] * n, acute or [False] * n, shock or [10.0] * n, idx or range(n))
    machine = folds.Hysteresis()
    return [machine.push(r) for r in rows]


@pytest.mark.parametrize("move", [(M, T), (M, C), (T, C)])
def test_slow_moves_need_three_sessions(move):
    a, b = move
    assert phases([a, b, b, b]) == [a, a, a, b]


def test_hysteresis_cases():
    assert phases([M, T, T, T, T], idx=[0, 1, 3, 4, 5]) == [M, M, M, M, T]
    assert phases([M, T, C, C, C]) == [M, M, M, M, C]
    assert phases([A, M, M]) == [A, A, M]
    assert phases([A, M, M, M], shock=[90, 80, 10, 10]) == [A, A, A, M]
    assert phases([A, M, M, M], acute=[True, None, False, False]) == [A, A, A, M]
    assert phases([A, M, M], idx=[0, 1, 5]) == [A, A, M]
    assert phases([M, T, "UNKNOWN", T]) == [M, M, "UNKNOWN", T]
    assert phases([M, T, T, T], ok=[True, True, False, True]) == [M, M, T, T]


def test_logistic_and_intercept():
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0], [0.2, 0.8], [0.8, 0.2]])
    w = fit_logistic(x, np.array([0, 0, 1, 1, 0, 1.0]))
    assert predict(w, np.array([[0.7, 0.3]]))[0] == pytest.approx(0.5597825227001174, abs=1e-8)
    p, y = np.array([0.2, 0.4, 0.6, 0.3]), np.array([1, 0, 1, 1.0])
    b = fit_intercept(p, y)
    assert (1 / (1 + np.exp(-(np.log(p / (1 - p)) + b)))).mean() == pytest.approx(0.75, abs=1e-9)


def one(spark, *cols, row=((1,),), schema="x int"):
    return tuple(spark.createDataFrame(list(row), schema).select(*cols).first())


def test_scalars(spark):
    n = lambda v: F.lit(v).cast("double")
    got = one(spark, ratio(n(1), n(0)), log_ratio(n(0), n(1)), forward_variance(n(20), n(30), n(25), n(93)), forward_volatility(n(-1)), weighted_score([(n(0.5), 0.4), (n(None), 0.6)]), bucket(n(35), [35, 55], ["a", "b", "c"]), same(n(None), n(None)), same(n(1), n(None)))
    assert got == (None, None, pytest.approx((93 * 0.25**2 - 30 * 0.2**2) / 63), None, None, "b", True, False)


def test_vintages(spark):
    arr = lambda *k: F.array(*[F.lit(x) for x in k]) if k else F.array().cast("array<string>")
    got = one(spark, vintage.weakest(arr("OBSERVED_PIT", "ASSUMED_PIT")), vintage.weakest(arr()), vintage.all_formal(arr()), vintage.all_formal(arr("OBSERVED_PIT", "PROVIDER_BACKTESTED")), vintage.evidence(F.lit(None).cast("string")))
    assert got == ("ASSUMED_PIT", None, False, False, "UNKNOWN")


def test_calendar(spark):
    days = [dt.date(2025, 4, 1) + dt.timedelta(days=i) for i in range(40)]
    sessions = spark.createDataFrame([(d,) for d in days if d.weekday() < 5 and d != dt.date(2025, 4, 18)], "session_date date")
    rows = spark.createDataFrame([(2025, 4)], "y int, m int").select(third_friday(F.col("y"), F.col("m")).alias("f"), rule_settlement(F.col("y"), F.col("m")).alias("r"))
    got = snap_back(rows, "r", sessions, "s").first()
    assert (got.f, got.s) == (dt.date(2025, 4, 18), dt.date(2025, 4, 16))
    when = [tuple(r)[0] for r in spark.createDataFrame([(dt.date(2025, 7, 1),), (dt.date(2025, 1, 2),)], "d date").select(wall_time(F.col("d"), 9, 20, "America/New_York")).collect()]
    assert when == [dt.datetime(2025, 7, 1, 13, 20), dt.datetime(2025, 1, 2, 14, 20)]


def test_three_valued_windows(spark):
    def last(values, n, k):
        rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "e string, i int, v boolean")
        w = along(["e"], ["i"])
        return rows.select("i", at_least_true(F.col("v"), trailing(w, n), n, k).alias("x"), any_true(F.col("v"), trailing(w, n), n).alias("y")).orderBy("i").collect()[-1]

    t, f = True, False
    assert last([t, t, None, f, f], 5, 3).x is None
    assert last([t, t, t, None, None], 5, 3).x is True
    assert last([t, f, f, f, None], 5, 3).x is False
    assert last([f, f, None], 3, 2).y is None and last([f, f, f], 3, 2).y is False and last([f, f], 3, 2).y is None


def test_midrank_percentile(spark):
    def run(values, sigs=None, window=4, least=1, cell=3):
        rows = spark.createDataFrame([("a", i, v, (sigs or ["m"] * len(values))[i]) for i, v in enumerate(values)], "e string, i int, v double, s string")
        out = midrank_percentile(rows, "e", "i", "v", "s" if sigs else None, window, least, cell)
        return [r.percentile for r in out.orderBy("i").collect()]

    assert run([1.0, 2.0, 2.0, 3.0, 2.0])[-1] == 0.5
    assert run([0.0, 100.0, None, 2.0], window=2, least=2)[-1] is None
    assert run([1.0, 2.0, 3.0, 1.0, 2.0, 3.0, 4.0], list("AAABBB") + [None], window=3, least=2) == [None, None, 1.0, None, None, 1.0, None]
    rng = np.random.default_rng(2)
    v = rng.integers(0, 9, 200).astype(float).tolist()
    want = [None if i < 5 else (sum(a < v[i] for a in v[max(0, i - 20) : i]) + 0.5 * sum(a == v[i] for a in v[max(0, i - 20) : i])) / min(i, 20) for i in range(200)]
    for cell in (7, 64, 4096):
        assert run(v, window=20, least=5, cell=cell) == want
    assert run([]) == []


def curve(spark, settles, days, kinds=None, months=None):
    n = len(settles)
    rows = [("F", dt.date(2025, 1, 2), i + 1, f"c{i}", float(s), float(d), (kinds or ["OBSERVED_PIT"] * n)[i], 2025, (months or list(range(1, n + 1)))[i]) for i, (s, d) in enumerate(zip(settles, days))]
    return curve_table(spark.createDataFrame(rows, "series_id string, session_date date, place int, contract_id string, settle double, days double, vintage_kind string, contract_year int, contract_month int")).first()


def test_curve_goldens(spark):
    ten = [10, 40, 70, 100, 130, 160, 190]
    a = curve(spark, [20.0, 22, 23, 24, 25, 26, 27], ten)
    assert a.ts12 == pytest.approx(0.1) and a.front_slope30 == pytest.approx(math.log(1.1))
    assert a.value30 == pytest.approx(20 + 2 * 20 / 30) and a.value30_kind == "DIRECT_BRACKET_INTERPOLATION"
    b = curve(spark, [19.0, 20, 21, 22, 23, 24, 25], [d + 24 for d in ten])
    assert b.value30 == pytest.approx(19 + (30 - 34) / 30) and b.value30_kind == "BOUNDED_BACKWARD_EXTRAPOLATION"
    assert curve(spark, [19.0] * 7, [d + 27 for d in ten]).value30 is None
    assert curve(spark, [20.0, 19, 21, 20, 22, 21, 23], ten).inversion_share == pytest.approx(0.6)
    c = curve(spark, [20.0, 21, 22, 24, 23, 22, 21], ten)
    assert (c.mid_level, c.mid_inversion_share) == (22.5, 1.0) and c.mid_slope30 == pytest.approx(math.log(21 / 24) * 30 / 90)
    assert not curve(spark, [20.0] * 6, ten[:6]).complete
    assert not curve(spark, [20.0] * 7, ten, months=[1, 2, 3, 5, 6, 7, 8]).complete
    d = curve(spark, [20.0] * 7, ten, ["PROVIDER_BACKTESTED"] + ["OBSERVED_PIT"] * 6)
    assert d.complete and not d.formal and d.value30 is None


OBS = "series_id string, session_date date, value double, available_at timestamp_ntz, ingested_at timestamp_ntz, revision_id string, vintage_kind string"


def test_late_revisions_are_not_backdated(spark):
    d, known = dt.date(2025, 1, 2), dt.datetime(2025, 1, 3, 14, 20)
    old = spark.createDataFrame([("V", d, 20.0, known, dt.datetime(2025, 1, 3, 13), "r1", "ASSUMED_PIT")], OBS)
    new = spark.createDataFrame([("V", d, 21.0, known, dt.datetime(2025, 2, 1, 15, 30), "r2", "ASSUMED_PIT"), ("V", d, 20.0, known, dt.datetime(2025, 2, 2), "r3", "ASSUMED_PIT"), ("W", d, 5.0, known, dt.datetime(2025, 2, 2), "r4", "ASSUMED_PIT")], OBS)
    merged = pit.merge_revisions(old, new, ["series_id", "session_date"], ["value", "vintage_kind"])
    got = {r.revision_id: r.available_at for r in merged.collect()}
    assert got == {"r1": known, "r2": dt.datetime(2025, 2, 1, 15, 30), "r4": known}
    rows = merged.select(*[c.split()[0] for c in OBS.split(", ")])
    assert [r.value for r in pit.known_at(rows, "2025-01-03 14:20:00").where("series_id = 'V'").collect()] == [20.0]
    assert [r.value for r in pit.known_at(rows, "2025-02-02 00:00:00").where("series_id = 'V'").collect()] == [21.0]


def test_labels_and_spells(spark):
    hits = [False, True, True, False, True, True, False, False, False, True, False]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(hits)], "e string, i int, v boolean")
    out = {r.i: r for r in forward_labels(rows, ["e"], "i", "i", F.col("v"), F.lit(True), 10, 5).collect()}
    assert (out[0].label, out[0].first_hit) == (1, 9) and out[1].label_status == "CENSORED"
    fewer = rows.withColumn("v", F.col("v") & (F.col("i") != 9))
    assert {r.i: r.label for r in forward_labels(fewer, ["e"], "i", "i", F.col("v"), F.lit(True), 10, 5).collect()}[0] == 0
    spell = spark.createDataFrame([("a", i, v) for i, v in enumerate([True, True, None, True, True, False])], "e string, i int, v boolean")
    assert [r.spell_age for r in spell_age(spell, ["e"], "i", F.col("v")).orderBy("i").collect()] == [1, 2, None, 1, 2, None]


def test_probe_ledger_first_row_and_switch(spark):
    rows = spark.createDataFrame([("a", 0, "X", 0.10), ("a", 1, "Y", 0.0)], "e string, i int, h string, r double")
    a, b = probe_ledger(rows, "e", "i", F.col("h"), F.col("r")).orderBy("i").collect()
    assert a.nav == pytest.approx(9995 * 1.1) and (a.turnover, b.turnover) == (1, 2) and b.nav == pytest.approx(9995 * 1.1 * 0.999)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0, 3.0], [-1.0, 2.0, 3.0], [-2.0, -1.0, 2.0, 3.0], [-5.0, -1.0, 0.5, 2.0, 2.0], [1.0, 1.0, -1.0, -1.0]])
def test_leave_one_out_direction(spark, values):
    got = leave_one_out_direction(spark.createDataFrame([("a", v) for v in values], "e string, v double"), "e", "v").first()
    if len(values) < 3:
        assert got.status == "INSUFFICIENT_EVIDENCE" and got.rate is None
        return
    keeps = [float(np.median(np.delete(values, i))) > 0 for i in range(len(values))]
    assert got.rate == pytest.approx(np.mean(keeps)) and got.status == ("STABLE" if all(keeps) else "UNSTABLE") and got["median"] == np.median(values)


def test_digest_ignores_order_but_counts_copies(spark):
    a = spark.createDataFrame([(1, 2.5, None), (2, None, "x")], "a int, b double, c string")
    d = lambda df: frame_digest(df, ["a", "b", "c"]).first()
    assert d(a) == d(a.orderBy(F.desc("a"))) and d(a) != d(a.union(a)) and d(a.limit(0)).n_rows == 0
