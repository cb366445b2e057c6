"""Regularised logistic fits, walk-forward predictions, recalibration and their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import require_columns, shared_dir
from .events import known_by, outcome_sequence


@dataclass(frozen=True)
class FitRules:
    """How much history a fit may see and needs; `purge` is in sessions, for `sequential_walk_forward` only."""

    most: int = 1500
    least: int = 252
    least_each: int = 30
    calibration_most: int = 252
    calibration_each: int = 20
    strength: float = 1.0
    purge: int = 20


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, tolerance: float = 1e-10, steps: int = 100) -> np.ndarray | None:
    """Intercept and weights minimising log loss + |w|^2 / (2 * strength), intercept free; Newton with halving.
    None if it doesn't converge."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag(np.r_[0.0, np.full(x.shape[1], 1 / strength)])
    w = np.zeros(a.shape[1])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * v @ ridge @ v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (p - y) + ridge @ w
        if np.abs(slope).max() < tolerance * max(1, len(y)):
            return w
        move = np.linalg.lstsq((a * (p * (1 - p))[:, None]).T @ a + ridge, slope, rcond=None)[0]
        size = 1.0
        while size > 1e-10 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        then = loss(w)
        if abs(now - then) <= 1e-15 * max(1, abs(now)) and np.abs(slope).max() < 1e-6 * max(1, len(y)):
            return w
        now = then
    return None


def predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(weights[0] + x @ weights[1:])))


def fit_intercept(p: np.ndarray, y: np.ndarray, bound: float = 40.0) -> float:
    """The shift b with mean(sigmoid(logit p + b)) = mean y, by bisection on [-bound, bound]."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    z, goal = np.log(q / (1 - q)), y.mean()
    low, high = -bound, bound
    for _ in range(200):
        mid = (low + high) / 2
        if (1 / (1 + np.exp(-(z + mid)))).mean() < goal:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def walk_forward(ledger: DataFrame, features: Sequence[str], rules: FitRules = FitRules(), refit: str = "month") -> DataFrame:
    """(event_id, prediction_id, fitted_at, n, positive, raw_probability, intercept, probability).

    Once per event and `refit` period a model is fitted to the last `most` outcomes with features that were
    known when the period began, and scores the period's predictions; never one that became known later.
    The intercept is moved so that the fit's latest `calibration_most` outcomes come out right on average.
    That is a cheaper schedule than one fit per decision, without a purge, and the intercept is fitted in sample;
    `sequential_walk_forward` does neither. Too little history of either class leaves null. Fits get their rows by an equi-join on (event, cell of the
    outcome's number), at most twice `most` rows each, so neither time nor data grows a single fit.
    """
    names = list(features)
    usable = F.lit(True)
    for c in names:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c)
    rows = ledger.where(usable & F.col("event_id").isNotNull())
    outcomes = outcome_sequence(rows, "event_id", "prediction_id", "outcome_available_at", "label", names)
    asked = rows.where(F.col("decision_at").isNotNull()).withColumn("t", F.date_trunc(refit, "decision_at").cast("timestamp_ntz"))
    counted = known_by(asked.select(F.col("event_id").alias("k"), "t").distinct(), outcomes.withColumn("t", F.col("t").cast("timestamp_ntz")))
    cells = F.expr(f"sequence(cast(floor(greatest(n - {rules.most}, 0) / {rules.most}) as int), cast(floor(greatest(n - 1, 0) / {rules.most}) as int))")
    fits = counted.where(F.col("n") >= rules.least).withColumn("cell", F.explode(cells)).alias("f")
    history = outcomes.withColumn("cell", F.floor((F.col("seq") - 1) / rules.most).cast("int")).select("k", "cell", "seq", "y", *names).alias("h")
    cohort = fits.join(history, ["k", "cell"]).where(f"seq <= n and seq > n - {rules.most}").select("k", F.col("f.t").alias("t"), "seq", "y", *names)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        y, x = group["y"].to_numpy(float), group[names].to_numpy(float)
        positive = int(y.sum())
        weights = fit_logistic(x, y, rules.strength) if min(positive, len(y) - positive) >= rules.least_each else None
        shift = None
        if weights is not None:
            recent = slice(-rules.calibration_most, None)
            if min(y[recent].sum(), len(y[recent]) - y[recent].sum()) >= rules.calibration_each:
                shift = fit_intercept(predict(weights, x[recent]), y[recent])
        return pd.DataFrame({"k": [key[0]], "t": [key[1]], "n": [len(y)], "positive": [positive], "w": [None if weights is None else weights.tolist()], "shift": [shift]})

    models = cohort.groupBy("k", "t").applyInPandas(fit, "k string, t timestamp_ntz, n bigint, positive bigint, w array<double>, shift double")
    scored = asked.select(F.col("event_id").alias("k"), "t", "prediction_id", *names).join(models, ["k", "t"], "left")
    z = F.get("w", F.lit(0))
    for i, c in enumerate(names):
        z = z + F.get("w", F.lit(i + 1)) * F.col(c)
    raw = 1 / (1 + F.exp(-z))
    moved = 1 / (1 + F.exp(-(z + F.coalesce("shift", F.lit(0.0)))))
    return scored.select(F.col("k").alias("event_id"), "prediction_id", F.col("t").alias("fitted_at"), "n", "positive", raw.alias("raw_probability"), F.col("shift").alias("intercept"), moved.alias("probability"))


def _by_cohort(asks: DataFrame, outcomes: DataFrame, most: int, lag: int, run: Callable[[pd.DataFrame, pd.DataFrame, Callable[[int, np.datetime64], np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """`run(asks, history, pick)` over groups of the asks (k, session, t, ...); pick(n, t) gives the rows of an ask's
    cohort in `history`: the last `most` outcomes (k, session, id, known, ...) in the order of (session, id) whose
    session lies at least `lag` before the ask's and which were known at t.

    Outcomes are numbered and cut into cells of `most`. An ask needs the cell of its last outcome and those back
    to one that was known as a whole by t, which is nearly always the cell before; so a group, the asks of
    one cell, holds about twice `most` outcomes, and time and data grow with the rows only.
    """
    inside = Window.partitionBy("k", "session").orderBy("id")
    upto = Window.partitionBy("k").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    sizes = outcomes.groupBy("k", "session").agg(F.count("*").alias("c"))
    numbered = outcomes.join(sizes.withColumn("before", F.sum("c").over(upto) - F.col("c")).drop("c"), ["k", "session"])
    numbered = numbered.withColumn("seq", F.row_number().over(inside) + F.col("before")).drop("before")
    history = numbered.withColumn("cell", F.floor((F.col("seq") - 1) / most))

    line = sizes.unionByName(asks.select("k", (F.col("session") - lag).alias("session"), F.lit(0).cast("bigint").alias("c")).distinct())
    line = line.groupBy("k", "session").agg(F.sum("c").alias("c")).select("k", (F.col("session") + lag).alias("session"), F.sum("c").over(upto).alias("last"))
    asked = asks.join(line, ["k", "session"]).where(F.col("last") > 0).withColumn("top", F.floor((F.col("last") - 1) / most))

    cells = history.groupBy("k", "cell").agg(F.max("known").alias("whole"))
    so_far = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.select("k", F.max("whole").over(so_far).alias("t"), (F.col("cell") + 1).alias("seq"))
    full = known_by(asks.select("k", "t").distinct(), filled).withColumnRenamed("n", "full")
    before = cells.select("k", (F.col("cell") + 1).alias("top"), "whole")
    asked = asked.join(full, ["k", "t"]).join(before, ["k", "top"], "left")
    low = F.when(F.col("whole") <= F.col("t"), F.col("top") - 1).otherwise(F.greatest(F.least(F.col("top"), "full") - 1, F.lit(0)))
    asked = asked.withColumn("low", low).drop("full", "whole")
    reach = asked.select("k", "low", "top").distinct().withColumn("cell", F.explode(F.sequence("low", "top")))
    parts = reach.join(history, ["k", "cell"]).withColumnsRenamed({"k": "of_k", "low": "of_low", "top": "of_top"})

    def group(ask: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        past = past.sort_values("seq").reset_index(drop=True)
        seq, known = past["seq"].to_numpy(), past["known"].to_numpy()
        return run(ask, past, lambda last, t: np.flatnonzero(known[: np.searchsorted(seq, last, "right")] <= t)[-most:])

    return asked.groupBy("k", "low", "top").cogroup(parts.groupBy("of_k", "of_low", "of_top")).applyInPandas(group, schema)


def sequential_walk_forward(ledger: DataFrame, features: Sequence[str], rules: FitRules = FitRules(), session: str = "session") -> DataFrame:
    """(event_id, prediction_id, fitted_at, n, positive, raw_probability, calibration_n, calibration_positive, intercept, probability).

    Give one row a prediction. Every eligible one is scored by a model of its own decision: fitted to the last `most` outcomes of
    its event that have features, were known at decision_at, and whose prediction lies at least `purge` sessions
    back (`session` is the number of the prediction's session). Its intercept is fitted to the raw
    probabilities which the last `calibration_most` predictions of earlier sessions got from *their* models, as far as
    their outcomes were known at decision_at; with fewer than `calibration_each` of either class it is null and the raw
    probability stands. Predictions without features or without a model (too little history, no
    convergence) are left out. Decisions that see the same outcomes share a fit.

    The predictions and the raw probabilities are written once each to the shared folder.
    """
    names = list(features)
    require_columns(ledger, "event_id", "prediction_id", "decision_at", "outcome_available_at", "label", "event_status", session, *names)
    shared_dir(ledger.sparkSession)
    usable = F.col("event_id").isNotNull() & F.col(session).isNotNull()
    for c in names:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c)
    as_feature = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
    rows = ledger.where(usable).select(
        F.col("event_id").alias("k"), F.col(session).cast("bigint").alias("session"), F.col("prediction_id").alias("id"), F.col("decision_at").alias("t"),
        F.col("outcome_available_at").alias("known"), F.col("label").cast("bigint").alias("y"), (F.col("event_status") == "ELIGIBLE").alias("eligible"), *as_feature,
    ).checkpoint()
    xs = [f"x{i}" for i in range(len(names))]
    done = F.col("y").isNotNull() & F.col("known").isNotNull()
    asks = rows.where(F.col("eligible") & F.col("t").isNotNull()).select("k", "session", "id", "t", "known", "y", *xs)

    def score(ask: pd.DataFrame, past: pd.DataFrame, pick: Callable) -> pd.DataFrame:
        x, y, own = past[xs].to_numpy(float), past["y"].to_numpy(float), ask[xs].to_numpy(float)
        fits, n, positive, raw = {}, np.zeros(len(ask), int), np.zeros(len(ask), int), np.full(len(ask), np.nan)
        for i, (last, t) in enumerate(zip(ask["last"].to_numpy(), ask["t"].to_numpy(), strict=True)):
            at = pick(last, t)
            if (seen := at.tobytes()) not in fits:
                yes = int(y[at].sum())
                enough = len(at) >= rules.least and min(yes, len(at) - yes) >= rules.least_each
                fits[seen] = yes, fit_logistic(x[at], y[at], rules.strength) if enough else None
            n[i], (positive[i], weights) = len(at), fits[seen]
            if weights is not None:
                raw[i] = predict(weights, own[i : i + 1])[0]
        return ask[["k", "session", "id", "t", "known", "y"]].assign(n=n, positive=positive, raw=raw).dropna(subset=["raw"])

    kind = rows.schema["id"].dataType.simpleString()
    moment = rows.schema["t"].dataType.simpleString()
    head = f"k string, session bigint, id {kind}, t {moment}, "
    raw = _by_cohort(asks, rows.where(done).select("k", "session", "id", "known", "y", *xs), rules.most, max(rules.purge, 1), score, head + "known timestamp_ntz, y bigint, n bigint, positive bigint, raw double").checkpoint()

    def calibrate(ask: pd.DataFrame, past: pd.DataFrame, pick: Callable) -> pd.DataFrame:
        p, y = past["raw"].to_numpy(float), past["y"].to_numpy(float)
        fits, n, positive, shift = {}, np.zeros(len(ask), int), np.zeros(len(ask), int), np.full(len(ask), np.nan)
        for i, (last, t) in enumerate(zip(ask["last"].to_numpy(), ask["t"].to_numpy(), strict=True)):
            at = pick(last, t)
            if (seen := at.tobytes()) not in fits:
                yes = int(y[at].sum())
                fits[seen] = yes, fit_intercept(p[at], y[at]) if min(yes, len(at) - yes) >= rules.calibration_each else np.nan
            n[i], (positive[i], shift[i]) = len(at), fits[seen]
        return pd.DataFrame({"k": ask["k"], "session": ask["session"], "id": ask["id"], "t": ask["t"], "calibration_n": n, "calibration_positive": positive, "intercept": [None if np.isnan(b) else b for b in shift]})

    shifts = _by_cohort(raw.select("k", "session", "id", "t"), raw.where(done).select("k", "session", "id", "known", "y", "raw"), rules.calibration_most, 1, calibrate, head + "calibration_n bigint, calibration_positive bigint, intercept double")
    both = raw.join(shifts.select("k", "id", "t", "calibration_n", "calibration_positive", "intercept"), ["k", "id", "t"], "left")
    low, high = F.lit(1e-6), F.lit(1 - 1e-6)
    q = F.least(F.greatest("raw", low), high)
    moved = F.least(F.greatest(1 / (1 + F.exp(-(F.ln(q / (1 - q)) + F.col("intercept")))), low), high)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("calibration_n", "calibration_positive")]
    return both.select(F.col("k").alias("event_id"), F.col("id").alias("prediction_id"), F.col("t").alias("fitted_at"), "n", "positive", F.col("raw").alias("raw_probability"), *counts, "intercept", F.when(F.col("intercept").isNull(), F.col("raw")).otherwise(moved).alias("probability"))


def bootstrap_skill(losses: DataFrame, key: str, block: str, candidate: str, base: str, draws: int = 10_000, seed: int = 20260823, chunk: int = 1_000_000) -> DataFrame:
    """(key, blocks, skill, q05, low, high): Brier skill with its one-sided 5 % quantile and a two-sided 95 % interval from a block bootstrap.

    `block` is a number; blocks between a key's first and last without rows count with sums of 0. Rows are summed to blocks first, so a draw
    resamples block sums, never rows. Draws are made in chunks of bounded size, whatever the number of blocks.
    """
    sums = losses.groupBy(key, block).agg(F.sum(candidate).alias("c"), F.sum(base).alias("b"))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        at = group[block].to_numpy(np.int64)
        c, b = np.zeros(at.max() - at.min() + 1), np.zeros(at.max() - at.min() + 1)
        c[at - at.min()], b[at - at.min()] = group["c"].to_numpy(float), group["b"].to_numpy(float)
        rng = np.random.Generator(np.random.PCG64(seed))
        top, low = np.empty(draws), np.empty(draws)
        step = max(1, chunk // len(c))
        for i in range(0, draws, step):
            picks = rng.integers(0, len(c), (min(step, draws - i), len(c)))
            top[i : i + step], low[i : i + step] = c[picks].sum(1), b[picks].sum(1)
        skill = 1 - top[low > 0] / low[low > 0]
        q = np.quantile(skill, [0.05, 0.025, 0.975]) if len(skill) else [None] * 3
        whole = 1 - c.sum() / b.sum() if b.sum() > 0 else None
        return pd.DataFrame({key: [group[key].iloc[0]], "blocks": [len(c)], "skill": [whole], "q05": [q[0]], "low": [q[1]], "high": [q[2]]})

    return sums.groupBy(key).applyInPandas(draw, f"`{key}` string, blocks bigint, skill double, q05 double, low double, high double")
