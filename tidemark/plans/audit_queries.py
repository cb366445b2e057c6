"""Queries on events, probabilities, backtests, audits and publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import indexed_sessions
from ..functions.scalars import clipped
from ..operators import audit, backtest, events, pit, probability
from ..operators.state import EVENTS
from ..operators.windows import along, clusters, level_change, log_change
from ..session import real, shared_dir, table
from .feature_queries import G, S, T, _states, state_frame
from .pit_queries import on_calendar

LEAST = 252  # outcomes a base rate needs
AS_OF = "2020-01-01 00:00:00"
SHORT = 60  # outcomes that the short rate looks back on
CRISIS = ("2020-02-20", "2020-06-30")
BASE_ONLY = ("broad_stress_persists_10d",)  # events without a model of their own


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions once each; a row written twice is the same row."""
    cols = ["event_id", "series_id", "prediction_date", "decision_at", "event_status", "label", "label_status", "horizon_sessions", "outcome_available_at", "formal_vintage_eligible"]
    rows = table(spark, sf_dir, "target_ledger").groupBy("prediction_id").agg(F.max(F.struct(*cols)).alias("x"))
    return rows.select("prediction_id", "x.*")


def event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("event_id", "event_status", "label_status").agg(F.count("*").alias("n"), F.sum("label").alias("positive"))


def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the series fall within 5 sessions, and on 5 of the next 10? Sessions without a change are unobservable."""
    w = along(["series_id"], ["idx"])
    rows = on_calendar(spark, sf_dir).withColumn("d", F.round(level_change(F.col("value"), 1, w), 6))
    hit, seen = F.col("d") < 0, F.col("d").isNotNull()
    any5 = events.forward_labels(rows, ["series_id"], "idx", "idx", hit, seen, 5).select("series_id", "idx", "d", F.col("label").alias("any5"), F.col("label_status").alias("status5"), F.col("first_hit").alias("hit5"))
    both = events.forward_labels(any5, ["series_id"], "idx", "idx", hit, seen, 10, 5)
    return both.select("series_id", "idx", "any5", "status5", "hit5", F.col("label").alias("five10"), F.col("label_status").alias("status10"), F.col("first_hit").alias("hit10"))


def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.causal_base_rate(ledger(spark, sf_dir), "event_id", "prediction_id", "decision_at", "outcome_available_at", "label", minimum=LEAST)
    return out.select("event_id", "decision_at", "n", "positive", F.round("base_rate", 9).alias("base_rate"))


def causal_cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    outcomes = events.outcome_sequence(rows, "event_id", "prediction_id", "outcome_available_at", "label")
    asks = rows.where("decision_at is not null and event_id is not null").select(F.col("event_id").alias("k"), F.col("decision_at").alias("t")).distinct()
    return events.known_by(asks, outcomes).select(F.col("k").alias("event_id"), F.col("t").alias("decision_at"), "n")


def rate(spark: SparkSession, sf_dir: str, last: int, minimum: int) -> DataFrame:
    return events.causal_base_rate(ledger(spark, sf_dir), "event_id", "prediction_id", "decision_at", "outcome_available_at", "label", last, minimum)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved predictions with p, the rate of the last 60 outcomes known at their decision, against b, the base rate known then."""
    base = rate(spark, sf_dir, 756, LEAST).select("event_id", "decision_at", F.round("base_rate", 9).alias("b"))
    short = rate(spark, sf_dir, SHORT, 1).select("event_id", "decision_at", F.round("base_rate", 9).alias("p"))
    rows = ledger(spark, sf_dir).where("label is not null").join(base, ["event_id", "decision_at"]).join(short, ["event_id", "decision_at"])
    return rows.where("b is not null").withColumn("y", F.col("label").cast("double"))


def _scores() -> list[Column]:
    p, b, y = F.col("p"), F.col("b"), F.col("y")
    return [F.count("*").alias("n"), F.sum("label").alias("positive"), audit.brier(p, y).alias("brier"), audit.brier(b, y).alias("base_brier")]


def brier_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the base rate."""
    out = predictions(spark, sf_dir).groupBy("event_id").agg(*_scores(), audit.log_loss(F.col("p"), F.col("y")).alias("log_loss"), (F.avg("p") - F.avg("y")).alias("gap"))
    return out.select("event_id", "n", "positive", *[F.round(c, 7).alias(c) for c in ("brier", "base_brier", "log_loss", "gap")], F.round(1 - F.col("brier") / F.col("base_brier"), 7).alias("skill"))


def yearly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year, and in and out of the crisis."""
    crisis = F.col("prediction_date").between(*[F.lit(d).cast("date") for d in CRISIS])
    strata = F.array(F.year("prediction_date").cast("string"), F.when(crisis, "CRISIS").otherwise("CALM"))
    out = predictions(spark, sf_dir).withColumn("stratum", F.explode(strata)).groupBy("event_id", "stratum").agg(*_scores(), (F.avg("p") - F.avg("y")).alias("gap"))
    return out.select("event_id", "stratum", "n", "positive", F.round("brier", 7).alias("brier"), F.round("base_brier", 7).alias("base_brier"), F.round("gap", 7).alias("gap"))


def ece_252(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.last_rows(predictions(spark, sf_dir), ["event_id"], [F.desc("prediction_date"), F.desc("prediction_id")], 252)
    return audit.calibration_error(rows, "event_id", "p", "y", ["prediction_date", "prediction_id"]).select("event_id", "n", F.round("ece", 7).alias("ece"))


def _accepted(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, positive, skill, ece, accepted) of each key's rows: the publication gate."""
    score = rows.groupBy(key).agg(*_scores())
    out = score.join(audit.calibration_error(rows, key, "p", "y", ["prediction_date", "prediction_id"]).select(key, "ece"), key)
    skill = F.when(F.col("base_brier") > 0, 1 - F.col("brier") / F.col("base_brier"))
    ok = (F.col("n") == 252) & (F.col("positive") >= 20) & (F.col("n") - F.col("positive") >= 20) & (skill >= 0.02) & (F.col("ece") <= 0.07)
    return out.select(key, "n", "positive", F.round(skill, 7).alias("skill"), F.round("ece", 7).alias("ece"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def acceptance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publication gate over each event's last 252 resolved predictions."""
    return _accepted(audit.last_rows(predictions(spark, sf_dir), ["event_id"], [F.desc("prediction_date"), F.desc("prediction_id")], 252), "event_id")


def validation_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publication gate as it stood at the start of each year: the last 252 outcomes known by then."""
    shared_dir(spark)
    rows = predictions(spark, sf_dir).withColumnsRenamed({"p": "pm"}).checkpoint()  # used for the years and for their cohorts
    start = F.date_trunc("year", "decision_at").cast("timestamp_ntz")
    done = events.outcome_sequence(rows, "event_id", "prediction_id", "outcome_available_at", "label", ["pm", "b", "prediction_date"])
    done = done.withColumn("t", F.col("t").cast("timestamp_ntz"))
    asks = rows.select(F.col("event_id").alias("k"), start.alias("t")).distinct()
    reach = F.sequence(F.floor(F.greatest(F.col("n") - 252, F.lit(0)) / 252), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / 252))
    asked = events.known_by(asks, done).withColumn("cell", F.explode(reach)).withColumnRenamed("t", "at")
    held = done.select("k", F.floor((F.col("seq") - 1) / 252).alias("cell"), "seq", F.col("id").alias("prediction_id"), "prediction_date", F.col("pm").alias("p"), "b", F.col("y").alias("label"), F.col("y").cast("double").alias("y"))
    cohort = asked.join(held, ["k", "cell"]).where("seq <= n and seq > n - 252").withColumn("key", F.concat_ws("|", "k", F.year("at").cast("string")))
    out = _accepted(cohort.drop("n"), "key")
    return out.select(F.substring_index("key", "|", 1).alias("event_id"), F.substring_index("key", "|", -1).cast("int").alias("year"), "n", "positive", "skill", "ece", "accepted")


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.reliability(predictions(spark, sf_dir), "event_id", "p", "y")
    return out.select("event_id", "bin", "n", F.round("mean_p", 7).alias("mean_p"), F.round("mean_y", 7).alias("mean_y"))


def outlook_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per decision day the event whose rate lies furthest above its base rate, of equals the first in the catalogue; NONE below an edge of .1."""
    place = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event_id"))
    base = rate(spark, sf_dir, 756, LEAST).where("base_rate is not null").select("event_id", "decision_at", F.col("base_rate").alias("b"))
    rows = rate(spark, sf_dir, SHORT, 1).join(base, ["event_id", "decision_at"]).withColumn("day", F.to_date("decision_at"))
    best = rows.groupBy("day").agg(F.max(F.struct(F.round(F.round("base_rate", 9) - F.round("b", 9), 9).alias("edge"), (-place).alias("place"), "event_id")).alias("x"))
    return best.select("day", F.when(F.col("x.edge") >= 0.1, F.col("x.event_id")).otherwise("NONE").alias("pick"), F.col("x.edge").alias("edge"))


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event and decision: how many outcomes are known, and whether the last 252 give enough of either class to calibrate."""
    enough = (F.col("n") >= 40) & (F.col("positive") >= 20) & (F.col("n") - F.col("positive") >= 20)
    known = causal_cohort_counts(spark, sf_dir)
    return known.join(rate(spark, sf_dir, 252, 1).select("event_id", "decision_at", enough.alias("calibrated")), ["event_id", "decision_at"])


def kth_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event's first and 252nd outcome became known, and its first decisions with a base rate and with a calibration."""
    rows = events.outcome_sequence(ledger(spark, sf_dir), "event_id", "prediction_id", "outcome_available_at", "label")
    dates = rows.groupBy(F.col("k").alias("event_id")).agg(F.min("t").alias("first_known"), F.max(F.when(F.col("seq") == LEAST, F.col("t"))).alias("ready_at"), F.count("*").alias("n"))
    at = _calibration(spark, sf_dir).groupBy("event_id").agg(
        F.min(F.when(F.col("n") >= LEAST, F.col("decision_at"))).alias("first_rate"), F.min(F.when((F.col("n") >= LEAST) & F.col("calibrated"), F.col("decision_at"))).alias("first_calibrated"),
    )
    return dates.join(at, "event_id", "left")


def publication_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be published for each prediction: its status first, then the history known at its decision, then whether the
    event has a model, enough to calibrate it, and passed the gate at the start of the year."""
    rows = ledger(spark, sf_dir).where("decision_at is not null and event_id is not null").withColumn("year", F.year("decision_at"))
    rows = rows.join(_calibration(spark, sf_dir), ["event_id", "decision_at"], "left")
    rows = rows.join(validation_as_of(spark, sf_dir).select("event_id", "year", "accepted"), ["event_id", "year"], "left")
    kind = (
        F.when(F.col("event_status").isin("UNOBSERVABLE", "NOT_APPLICABLE"), F.col("event_status")).when(F.coalesce("n", F.lit(0)) < LEAST, "INSUFFICIENT_HISTORY")
        .when(F.col("event_id").isin(*BASE_ONLY), "BASE_RATE_ONLY").when(~F.coalesce("calibrated", F.lit(False)), "IDENTITY_WARMUP")
        .when(F.coalesce("accepted", F.lit(False)), "CALIBRATED_MODEL").otherwise("BASE_RATE_ONLY")
    )
    return rows.select("prediction_id", kind.alias("decision"))


def due_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the evidence at one moment: captured, pending, due, resolved."""
    at = F.lit(AS_OF).cast("timestamp_ntz")
    rows = ledger(spark, sf_dir).where(F.col("decision_at") <= at)
    due = F.col("outcome_available_at") <= at
    status = F.when(F.col("event_status") != "ELIGIBLE", "OUT_OF_SCOPE").when(due & F.col("label").isNotNull(), "RESOLVED").when(due, "GAP").otherwise("PENDING")
    return rows.groupBy("event_id", status.alias("status")).agg(F.count("*").alias("n"))


def ledger_truth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the ledger; each counts its violations."""
    rows = ledger(spark, sf_dir)
    gates = [
        ("label agrees with status", rows.where("(label_status = 'OBSERVED_1' and coalesce(label, -1) <> 1) or (label_status = 'OBSERVED_0' and coalesce(label, -1) <> 0)")),
        ("no label without outcome time", rows.where("label is not null and outcome_available_at is null")),
        ("censored has no label", rows.where("label_status = 'CENSORED' and label is not null")),
        ("only eligible events have labels", rows.where("event_status <> 'ELIGIBLE' and label is not null")),
        ("outcome after prediction", rows.where("outcome_available_at <= cast(prediction_date as timestamp_ntz)")),
        ("one row per prediction", table(spark, sf_dir, "target_ledger").distinct().groupBy("prediction_id").count().where("count > 1")),
    ]
    return reduce(DataFrame.unionByName, [audit.gate(n, v) for n, v in gates])


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal on a session, bought at the next open, sold at the open after: positions along each ticker's own sessions."""
    rows = table(spark, sf_dir, "prices").where("ticker is not null and session_date is not null").withColumn("adjusted_open", real(F.col("adjusted_open")))
    rows = pit.latest_row(rows, ["ticker", "session_date"], ["adjusted_open"], ["adjusted_open"]).where("adjusted_open > 0")
    w = along(["ticker"], ["session_date"])
    o1, o2 = F.lead("adjusted_open", 1).over(w), F.lead("adjusted_open", 2).over(w)
    rows = rows.select("ticker", "session_date", "adjusted_open", F.lead("session_date", 1).over(w).alias("execution"), (o2 / o1 - 1).alias("asset_return"), (F.col("adjusted_open") >= F.lag("adjusted_open", 5).over(w)).alias("up"))
    return rows.where("asset_return is not null and up is not null")


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = F.when(F.col("up"), "RISK").otherwise("CASH")
    return backtest.probe_ledger(_returns(spark, sf_dir), "ticker", "session_date", asset, F.when(F.col("up"), F.col("asset_return")).otherwise(0.0))


def probe_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir).select("ticker", "session_date", "execution", "asset", "turnover", F.round("nav", 4).alias("nav"), F.round("drawdown", 7).alias("drawdown"))


def rolling20_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probe(spark, sf_dir)
    r = backtest.compounded(F.col("growth") - 1, 20, along(["ticker"], ["session_date"]))
    return rows.select("ticker", "session_date", F.round(r, 7).alias("r20")).where("r20 is not null")


def probe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probe(spark, sf_dir)
    rows = rows.withColumn("r20", backtest.compounded(F.col("growth") - 1, 20, along(["ticker"], ["session_date"])))
    return rows.groupBy("ticker").agg(
        F.count("*").alias("sessions"), F.min("session_date").alias("first"), F.max("session_date").alias("last"), F.round(F.max_by("nav", "session_date"), 4).alias("final_nav"),
        F.round(F.min("drawdown"), 7).alias("max_drawdown"), F.round(F.min("r20"), 7).alias("worst20"), F.count(F.when(F.col("turnover") == 2, 1)).alias("switches"),
        F.sum("turnover").alias("turnover"), F.count(F.when(F.col("asset") == "RISK", 1)).alias("risk_sessions"), F.round(10_000 * F.exp(F.sum(F.ln(1 + F.col("ret")))), 4).alias("gross_nav"),
    )


def worst20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty worst days of all assets, with what was held."""
    rows = _probe(spark, sf_dir).orderBy(F.col("asset_return"), "ticker", "session_date").limit(20)
    return rows.select("ticker", "session_date", F.round("asset_return", 9).alias("asset_return"), "asset")


def _rises(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = state_frame(spark, sf_dir)
    return clusters(rows, ["series_id"], "idx", F.col("p_value") >= 0.9), clusters(rows, ["series_id"], "idx", F.col("p_d5") >= 0.9)


def true_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rises(spark, sf_dir)[0].withColumn("cluster", F.col("cluster").cast("bigint"))


def cluster_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.matched_clusters(*_rises(spark, sf_dir), "series_id", 5, 5)
    return out.select("series_id", F.col("cluster").cast("bigint").alias("cluster"), "first", "last", F.col("signal").cast("bigint").alias("signal"), "offset", "n_signals")


def crosstab_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.crosstab(_states(spark, sf_dir), "mid_state", "carry_state")
    return out.select("mid_state", "carry_state", "n", F.round("rate", 9).alias("rate"))


def distribution_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.distribution(_states(spark, sf_dir), ["mid_state"], "d5")
    return out.select("mid_state", "n", *[F.round(c, 7).alias(c) for c in ("q25", "median", "q75", "positive")])


def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's value as the estimate of today's, per series."""
    rows = on_calendar(spark, sf_dir).withColumn("before", F.lag("value").over(along(["series_id"], ["idx"])))
    out = audit.error_bundle(rows, ["series_id"], "value", "before")
    return out.select("series_id", "n", *[F.round(c, 5).alias(c) for c in ("bias", "mae", "median_ape", "p95_ape", "max_ape", "correlation")])


def forward_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = along(["series_id"], ["idx"])
    ahead, x = w.rowsBetween(1, 5), F.col("value")
    there = F.lead("idx", 5).over(w).isNotNull()
    rows = on_calendar(spark, sf_dir)
    return rows.select("series_id", "idx", F.when(there, F.max(x).over(ahead)).alias("max5"), F.round(F.when(there, F.avg(x).over(ahead)), 6).alias("mean5"), F.round(F.lead(x, 5).over(w) - x, 6).alias("change5"))


def loco_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the typical length of a cluster stay above two sessions whichever one is left out?"""
    rows = true_clusters(spark, sf_dir).withColumn("x", (F.col("length") - 2).cast("double"))
    return audit.leave_one_out_direction(rows, "series_id", "x").select("series_id", "n", "median", F.round("rate", 9).alias("rate"), "status")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = along(["series_id"], ["idx"])
    return on_calendar(spark, sf_dir).withColumn("label", (log_change(F.col("value"), 5, w) > 0.05).cast("int")).where("label is not null")


def episode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.episodes(_labels(spark, sf_dir), "series_id", "idx", "label", 5)


def block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.blocks(_labels(spark, sf_dir), "series_id", "idx", "label", 20)


def negative_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with rows but without a positive."""
    return block_sums(spark, sf_dir).groupBy("series_id").agg(F.count(F.when((F.col("n") > 0) & (F.col("total") == 0), 1)).alias("negative_blocks"), F.count("*").alias("n_blocks"))


def power_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks needed to see a shift of 2 % at one-sided 5 % with 80 % power, from the spread of block means."""
    means = block_sums(spark, sf_dir).where("n > 0").withColumn("m", F.col("total") / F.col("n"))
    out = means.groupBy("series_id").agg(F.stddev_samp("m").alias("sd"), F.count("*").alias("n_blocks"))
    return out.select("series_id", "n_blocks", F.round("sd", 7).alias("sd"), F.round(F.pow((1.6448536 + 0.8416212) * F.col("sd") / 0.02, F.lit(2.0)), 4).alias("needed"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour, with the value's spread."""
    rows = table(spark, sf_dir, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return rows.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), cents.alias("cents"), F.countDistinct("user_id").alias("users"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint").getField("k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count(k).alias("n"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = along(["series_id"], ["idx"])
    x = F.col("value")
    rows = on_calendar(spark, sf_dir)
    rows = rows.select("series_id", F.col("session_date").alias("prediction_date"), F.col("idx").alias("session"), clipped(log_change(x, 1, w) * 10, -3.0, 3.0).alias("f1"), clipped(log_change(x, 5, w) * 10, -3.0, 3.0).alias("f5"))
    return ledger(spark, sf_dir).join(rows, ["series_id", "prediction_date"], "left")


def logistic_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit per decision with the domain's own rules: 252 outcomes, 30 of each class, a purge of 20 sessions."""
    return probability.sequential_walk_forward(_features(spark, sf_dir), ["f1", "f5"])


def bootstrap_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill against the base rate, resampled in blocks of 20 sessions."""
    days = indexed_sessions(table(spark, sf_dir, "exchange_sessions")).select(F.col("session_date").alias("prediction_date"), F.floor(F.col("idx") / 20).cast("int").alias("block"))
    rows = predictions(spark, sf_dir).join(days, "prediction_date")
    rows = rows.withColumns({"c": F.pow(F.col("p") - F.col("y"), F.lit(2.0)), "b2": F.pow(F.col("b") - F.col("y"), F.lit(2.0))})
    return probability.bootstrap_skill(rows, "event_id", "block", "c", "b2")


def snapshot_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per series for its last session with a score."""
    rows = _states(spark, sf_dir).where("shock is not null")
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("idx")))
    doc = F.to_json(F.struct("series_id", F.col("session_date").cast("string").alias("session_date"), "status", F.struct("shock", "carry").alias("scores"), F.struct("mid_state", "carry_state").alias("states")))
    return rows.withColumn("place", place).where("place = 1").select("series_id", doc.alias("document"))


_NAMES = (
    event_status, forward_labels, base_rate, causal_cohort_counts, brier_skill, yearly_metrics, ece_252, acceptance_metrics, validation_as_of, reliability_bins, outlook_pick, kth_outcome, publication_decision,
    due_outcomes, ledger_truth_audit, probe_ledger, rolling20_return, probe_metrics, worst20, true_clusters, cluster_matching, crosstab_rates, distribution_by_state, error_metrics, forward_max_mean,
    loco_direction, episode_counts, block_sums, negative_blocks, power_calc, event_windows, json_props, logistic_walk_forward, bootstrap_skill, snapshot_document,
)
QUERIES = {f.__name__: f for f in _NAMES}

L = "led as (select distinct prediction_id, event_id, series_id, prediction_date, decision_at, event_status, label, label_status, horizon_sessions, outcome_available_at, formal_vintage_eligible from target_ledger)"
OUT = f"""{L}, oc as (select event_id, outcome_available_at as t, label::bigint as y, row_number() over (partition by event_id order by outcome_available_at, prediction_id) as seq from led where label is not null and outcome_available_at is not null),
ask as (select distinct event_id, decision_at from led where decision_at is not null and event_id is not null),
cnt as (select ask.event_id, ask.decision_at, count(oc.seq) as n from ask left join oc on oc.event_id = ask.event_id and oc.t <= ask.decision_at group by all),
br as (select cnt.event_id, cnt.decision_at, least(cnt.n, 756) as n, coalesce(sum(oc.y), 0)::bigint as positive,
  case when cnt.n >= {LEAST} then round((coalesce(sum(oc.y), 0) + 1) / (least(cnt.n, 756) + 2), 9) end as base_rate
  from cnt left join oc on oc.event_id = cnt.event_id and oc.seq <= cnt.n and oc.seq > cnt.n - 756 group by cnt.event_id, cnt.decision_at, cnt.n)"""
MODEL = f"""{OUT}, m60 as (select cnt.event_id, cnt.decision_at, round((coalesce(sum(oc.y), 0) + 1) / (least(cnt.n, {SHORT}) + 2), 9) as p
  from cnt join oc on oc.event_id = cnt.event_id and oc.seq <= cnt.n and oc.seq > cnt.n - {SHORT} group by cnt.event_id, cnt.decision_at, cnt.n),
cal as (select cnt.event_id, cnt.decision_at, cnt.n, least(cnt.n, 252) >= 40 and coalesce(sum(oc.y), 0) >= 20 and least(cnt.n, 252) - coalesce(sum(oc.y), 0) >= 20 as calibrated
  from cnt left join oc on oc.event_id = cnt.event_id and oc.seq <= cnt.n and oc.seq > cnt.n - 252 group by cnt.event_id, cnt.decision_at, cnt.n)"""
PRED = f"{MODEL}, pr as (select led.*, m60.p, br.base_rate as b, label::double as y from led join br using (event_id, decision_at) join m60 using (event_id, decision_at) where label is not null and base_rate is not null)"
GATE = "n = 252 and positive >= 20 and n - positive >= 20 and coalesce(skill >= 0.02, false) and ece <= 0.07"
VALID = f"""{PRED}, vs as (select *, row_number() over (partition by event_id order by outcome_available_at, prediction_id) as seq from pr where outcome_available_at is not null),
vy as (select distinct event_id, date_trunc('year', decision_at) as t from pr), vn as (select vy.event_id, vy.t, count(vs.seq) as k from vy left join vs on vs.event_id = vy.event_id and vs.outcome_available_at <= vy.t group by all),
vc as (select vn.t, vs.*, ntile(5) over (partition by vs.event_id, vn.t order by p, prediction_date, prediction_id) as bin from vn join vs on vs.event_id = vn.event_id and vs.seq <= vn.k and vs.seq > vn.k - 252),
vb as (select event_id, t, bin, count(*) as c, abs(avg(p) - avg(y)) as gap from vc group by all), ve as (select event_id, t, sum(c * gap) / sum(c) as ece from vb group by all),
vm as (select event_id, t, count(*) as n, sum(label)::bigint as positive, case when avg((b - y) * (b - y)) > 0 then 1 - avg((p - y) * (p - y)) / avg((b - y) * (b - y)) end as skill from vc group by all),
va as (select event_id, year(t)::int as year, n, positive, round(skill, 7) as skill, round(ece, 7) as ece, {GATE} as accepted from vm join ve using (event_id, t))"""
LAST = f"{PRED}, la as (select * from pr qualify row_number() over (partition by event_id order by prediction_date desc, prediction_id desc) <= 252)"
BINS = f"""{LAST}, bi as (select *, ntile(5) over (partition by event_id order by p, prediction_date, prediction_id) as bin from la),
be as (select event_id, bin, count(*) as n, avg(p) as mp, avg(y) as my from bi group by all), ec as (select event_id, sum(n)::bigint as n, sum(n * abs(mp - my)) / sum(n) as ece from be group by event_id)"""
PX = """px as (select ticker, session_date, max(adjusted_open) as o from prices where ticker is not null and session_date is not null and not isnan(adjusted_open) group by all having max(adjusted_open) > 0),
py as (select ticker, session_date, o, lead(session_date) over w as execution, lead(o, 2) over w / lead(o) over w - 1 as asset_return, o >= lag(o, 5) over w as up from px window w as (partition by ticker order by session_date)),
pz as (select *, case when up then 'RISK' else 'CASH' end as asset, case when up then asset_return else 0.0 end as ret from py where asset_return is not null and up is not null),
pt as (select *, case when lag(asset) over w is null then 1 when lag(asset) over w <> asset then 2 else 0 end as turnover from pz window w as (partition by ticker order by session_date)),
pg as (select *, (1 - 0.0005 * turnover) * (1 + ret) as growth from pt),
pn as (select *, 10000 * exp(sum(ln(growth)) over w) as nav, case when count(*) over r = 20 then exp(sum(ln(growth)) over r) - 1 end as r20 from pg
  window w as (partition by ticker order by session_date rows between unbounded preceding and current row), r as (partition by ticker order by session_date rows between 19 preceding and current row)),
pd as (select *, nav / greatest(10000, max(nav) over (partition by ticker order by session_date rows between unbounded preceding and current row)) - 1 as drawdown from pn)"""


def _clusters_sql(name: str, flag: str) -> str:
    return f"""{name}0 as (select series_id, idx, coalesce({flag}, false) as f, coalesce({flag}, false) and not coalesce(lag(coalesce({flag}, false)) over (partition by series_id order by idx), false) as b from st),
{name}1 as (select *, sum(b::int) over (partition by series_id order by idx rows between unbounded preceding and current row)::bigint as cluster from {name}0),
{name} as (select series_id, cluster, min(idx) as first, max(idx) as last, count(*) as length from {name}1 where f group by all)"""


CL = f"{S}, {_clusters_sql('ce', 'p_value >= 0.9')}, {_clusters_sql('cs', 'p_d5 >= 0.9')}"
LAB = f"{G}, lb as (select series_id, idx, (ln(value / v5) > 0.05)::int as label from (select *, lag(value, 5) over (partition by series_id order by idx) as v5 from g) where value > 0 and v5 > 0)"
BLK = f"""{LAB}, lo as (select series_id, min(idx) as lo, max(idx) as hi from lb group by all), sp as (select series_id, lo, unnest(generate_series(0, (hi - lo) // 20))::int as block from lo),
bs as (select lb.series_id, ((idx - lo) // 20)::int as block, sum(label)::bigint as total, count(*) as n from lb join lo using (series_id) group by all),
bl as (select sp.series_id, sp.block, coalesce(total, 0)::bigint as total, coalesce(n, 0)::bigint as n from sp left join bs using (series_id, block))"""


def _label_sql(h: int, need: int) -> str:
    w = f"(partition by series_id order by idx rows between 1 following and {h} following)"
    return f"""select series_id, idx, case when ok then case when list_count(hits) >= {need} then 1 else 0 end end as label, case when not ok then 'CENSORED' when list_count(hits) >= {need} then 'OBSERVED_1' else 'OBSERVED_0' end as status,
      case when ok and list_count(hits) >= {need} then hits[{need}] end as hit from (select series_id, idx, count(*) over {w} = {h} and count(d) over {w} = {h} as ok,
      list_sort(list_filter(list(case when d < 0 then idx end) over {w}, lambda x: x is not null)) as hits from dd)"""


ORACLE = {
    "event_status": f"with {L} select event_id, event_status, label_status, count(*) as n, sum(label)::bigint as positive from led group by all",
    "forward_labels": f"""{G}, dd as (select series_id, idx, round(value - lag(value) over (partition by series_id order by idx), 6) as d from g), a as ({_label_sql(5, 1)}), b as ({_label_sql(10, 5)})
      select a.series_id, a.idx, a.label as any5, a.status as status5, a.hit as hit5, b.label as five10, b.status as status10, b.hit as hit10 from a join b using (series_id, idx)""",
    "base_rate": f"with {OUT} select * from br",
    "causal_cohort_counts": f"with {OUT} select event_id, decision_at, n from cnt",
    "brier_skill": f"""with {PRED} select event_id, count(*) as n, sum(label)::bigint as positive, round(avg((p - y) * (p - y)), 7) as brier, round(avg((b - y) * (b - y)), 7) as base_brier,
      round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 7) as log_loss, round(avg(p) - avg(y), 7) as gap, round(1 - avg((p - y) * (p - y)) / avg((b - y) * (b - y)), 7) as skill from pr group by all""",
    "yearly_metrics": f"""with {PRED}, sy as (select *, year(prediction_date)::varchar as stratum from pr union all select *, case when prediction_date between date '{CRISIS[0]}' and date '{CRISIS[1]}' then 'CRISIS' else 'CALM' end from pr)
      select event_id, stratum, count(*) as n, sum(label)::bigint as positive, round(avg((p - y) * (p - y)), 7) as brier, round(avg((b - y) * (b - y)), 7) as base_brier, round(avg(p) - avg(y), 7) as gap from sy group by event_id, stratum""",
    "ece_252": f"with {BINS} select event_id, n, round(ece, 7) as ece from ec",
    "acceptance_metrics": f"""with {BINS}, sc as (select event_id, count(*) as n, sum(label)::bigint as positive, case when avg((b - y) * (b - y)) > 0 then 1 - avg((p - y) * (p - y)) / avg((b - y) * (b - y)) end as skill from la group by all),
      jn as (select sc.*, ece from sc join ec using (event_id)) select event_id, n, positive, round(skill, 7) as skill, round(ece, 7) as ece, {GATE} as accepted from jn""",
    "validation_as_of": f"with {VALID} select * from va",
    "reliability_bins": f"with {PRED} select event_id, greatest(ceil(p * 10), 1)::int as bin, count(*) as n, round(avg(p), 7) as mean_p, round(avg(y), 7) as mean_y from pr group by event_id, greatest(ceil(p * 10), 1)",
    "outlook_pick": f"""with {MODEL}, d as (select decision_at::date as day, round(m60.p - br.base_rate, 9) as edge, event_id, list_position({list(EVENTS)!r}, event_id) as place from br join m60 using (event_id, decision_at) where base_rate is not null),
      b as (select * from d qualify row_number() over (partition by day order by edge desc, place) = 1) select day, case when edge >= 0.1 then event_id else 'NONE' end as pick, edge from b""",
    "kth_outcome": f"""with {MODEL}, a as (select event_id, min(t) as first_known, max(case when seq = {LEAST} then t end) as ready_at, count(*) as n from oc group by event_id),
      f as (select event_id, min(case when n >= {LEAST} then decision_at end) as first_rate, min(case when n >= {LEAST} and calibrated then decision_at end) as first_calibrated from cal group by event_id) select * from a left join f using (event_id)""",
    "publication_decision": f"""with {VALID} select prediction_id, case when event_status in ('UNOBSERVABLE', 'NOT_APPLICABLE') then event_status when n < {LEAST} then 'INSUFFICIENT_HISTORY' when led.event_id = '{BASE_ONLY[0]}' then 'BASE_RATE_ONLY'
      when not calibrated then 'IDENTITY_WARMUP' when coalesce(accepted, false) then 'CALIBRATED_MODEL' else 'BASE_RATE_ONLY' end as decision from led join cal using (event_id, decision_at) left join (select event_id, year, accepted from va) v on v.event_id = led.event_id and v.year = year(led.decision_at)""",
    "due_outcomes": f"""with {L} select event_id, case when event_status <> 'ELIGIBLE' then 'OUT_OF_SCOPE' when outcome_available_at <= timestamp '{AS_OF}' and label is not null then 'RESOLVED'
      when outcome_available_at <= timestamp '{AS_OF}' then 'GAP' else 'PENDING' end as status, count(*) as n from led where decision_at <= timestamp '{AS_OF}' group by all""",
    "ledger_truth_audit": f"""with {L}, v(gate, violations) as (
      select 'label agrees with status', count(*) from led where (label_status = 'OBSERVED_1' and coalesce(label, -1) <> 1) or (label_status = 'OBSERVED_0' and coalesce(label, -1) <> 0) union all
      select 'no label without outcome time', count(*) from led where label is not null and outcome_available_at is null union all
      select 'censored has no label', count(*) from led where label_status = 'CENSORED' and label is not null union all
      select 'only eligible events have labels', count(*) from led where event_status <> 'ELIGIBLE' and label is not null union all
      select 'outcome after prediction', count(*) from led where outcome_available_at <= prediction_date union all
      select 'one row per prediction', count(*) from (select prediction_id from (select distinct * from target_ledger) group by 1 having count(*) > 1))
      select gate, violations, violations = 0 as passed from v""",
    "probe_ledger": f"with {PX} select ticker, session_date, execution, asset, turnover::int as turnover, round(nav, 4) as nav, round(drawdown, 7) as drawdown from pd",
    "rolling20_return": f"with {PX} select ticker, session_date, round(r20, 7) as r20 from pd where r20 is not null",
    "probe_metrics": f"""with {PX} select ticker, count(*) as sessions, min(session_date) as first, max(session_date) as last, round(arg_max(nav, session_date), 4) as final_nav, round(min(drawdown), 7) as max_drawdown,
      round(min(r20), 7) as worst20, count(*) filter (turnover = 2) as switches, sum(turnover)::bigint as turnover, count(*) filter (asset = 'RISK') as risk_sessions, round(10000 * exp(sum(ln(1 + ret))), 4) as gross_nav from pd group by ticker""",
    "worst20": f"with {PX} select ticker, session_date, round(asset_return, 9) as asset_return, asset from pd order by pd.asset_return, ticker, session_date limit 20",
    "true_clusters": f"{CL} select * from ce",
    "cluster_matching": f"""{CL}, m as (select ce.series_id, ce.cluster, ce.first as f, cs.cluster as sc, cs.first as sf, row_number() over (partition by ce.series_id, ce.cluster order by abs(cs.first - ce.first), cs.first) as rn,
        count(*) over (partition by ce.series_id, ce.cluster) as c from ce join cs on cs.series_id = ce.series_id and cs.first <= ce.last + 5 and cs.last >= ce.first - 5)
      select ce.series_id, ce.cluster, ce.first, ce.last, m.sc as signal, m.sf - ce.first as "offset", coalesce(m.c, 0)::bigint as n_signals from ce left join m on m.series_id = ce.series_id and m.cluster = ce.cluster and rn = 1""",
    "crosstab_rates": f"{T}, n as (select mid_state, carry_state, count(*) as n from t4 group by all) select *, round(n / sum(n) over (partition by mid_state), 9) as rate from n",
    "distribution_by_state": f"""{T} select mid_state, count(*) as n, round(quantile_cont(d5, 0.25), 7) as q25, round(quantile_cont(d5, 0.5), 7) as median, round(quantile_cont(d5, 0.75), 7) as q75,
      round(avg((d5 > 0)::int), 7) as positive from t4 where d5 is not null group by all""",
    "error_metrics": f"""{G}, b as (select series_id, value as a, lag(value) over (partition by series_id order by idx) as e from g)
      select series_id, count(*) as n, round(avg(e - a), 5) as bias, round(avg(abs(e - a)), 5) as mae, round(quantile_cont(case when a <> 0 then abs((e - a) / a) end, 0.5), 5) as median_ape,
      round(quantile_cont(case when a <> 0 then abs((e - a) / a) end, 0.95), 5) as p95_ape, round(max(case when a <> 0 then abs((e - a) / a) end), 5) as max_ape, round(corr(a, e), 5) as correlation
      from b where a is not null and e is not null group by series_id""",
    "forward_max_mean": f"""{G} select series_id, idx, case when lead(idx, 5) over w is not null then max(value) over a end as max5, round(case when lead(idx, 5) over w is not null then avg(value) over a end, 6) as mean5,
      round(lead(value, 5) over w - value, 6) as change5 from g window w as (partition by series_id order by idx), a as (partition by series_id order by idx rows between 1 following and 5 following)""",
    "loco_direction": f"""{CL}, xl as (select series_id, cluster, (length - 2)::double as x from ce), nl as (select series_id, count(*) as n, median(x) as median from xl group by all),
      ol as (select a.series_id, a.cluster, median(b.x) > 0 as keeps from xl a join xl b on a.series_id = b.series_id and a.cluster <> b.cluster group by all), kl as (select series_id, avg(keeps::int) as rate, bool_and(keeps) as stable from ol group by all)
      select nl.series_id, nl.n, case when nl.n >= 3 then nl.median end as median, case when nl.n >= 3 then round(rate, 9) end as rate, case when nl.n < 3 then 'INSUFFICIENT_EVIDENCE' when stable then 'STABLE' else 'UNSTABLE' end as status
      from nl left join kl using (series_id)""",
    "episode_counts": f"{LAB}, p as (select series_id, idx - lag(idx) over (partition by series_id order by idx) as gap from lb where label = 1) select series_id, count(*) filter (gap is null or gap > 5) as n_episodes from p group by all",
    "block_sums": f"{BLK} select * from bl",
    "negative_blocks": f"{BLK} select series_id, count(*) filter (n > 0 and total = 0) as negative_blocks, count(*) as n_blocks from bl group by all",
    "power_calc": f"{BLK} select series_id, count(*) as n_blocks, round(stddev_samp(total / n), 7) as sd, round(pow((1.6448536 + 0.8416212) * stddev_samp(total / n) / 0.02, 2), 4) as needed from bl where n > 0 group by all",
    "event_windows": "select event_type, date_trunc('hour', ts) as hour, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents, count(distinct user_id) as users from events group by event_type, date_trunc('hour', ts)",
    "json_props": "select event_type, sum((props->>'$.k')::bigint)::bigint as k_sum, max((props->>'$.k')::bigint) as k_max, count(props->>'$.k') as n from events group by all",
}
