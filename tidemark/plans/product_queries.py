"""Queries behind publication: readiness, lineage, comparisons, narratives, caches and causality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vintage
from ..functions.scalars import ratio
from ..operators import audit, backtest, events, pit
from ..operators.asof import attributes_as_of
from ..operators.windows import along, filled
from ..session import real, table
from .audit_queries import AS_OF, CL, L, OUT, PX, _probe, _returns, _rises, causal_cohort_counts, ledger
from .feature_queries import CURVE, S, T, _brackets, _curve, _nearest, _states, state_frame
from .pit_queries import B, BASE, IS, KNOWN, POINT, R, V, readings

SPLIT_DAY = "2018-12-31"


def usable_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol the first session with all its series, and not before the first formal curve."""
    rows = readings(spark, sf_dir).select(F.regexp_replace("series_id", BASE, "").alias("symbol"), "series_id", "session_date")
    need = rows.groupBy("symbol").agg(F.countDistinct("series_id").alias("need"))
    daily = rows.groupBy("symbol", "session_date").agg(F.countDistinct("series_id").alias("n"))
    first = daily.join(need, "symbol").where("n = need").groupBy("symbol").agg(F.min("session_date").alias("first_complete"))
    curve = _curve(spark, sf_dir).where("formal").agg(F.min("session_date").alias("first_curve"))  # one row
    return first.withColumn("one", F.lit(1)).join(curve.withColumn("one", F.lit(1)), "one").select("symbol", "first_complete", F.greatest("first_complete", "first_curve").alias("usable_from"))


def observability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions of each series may be judged, and what keeps the others out (first reason that holds)."""
    rows = state_frame(spark, sf_dir)
    reason = F.when(F.col("value").isNull(), "NO_VALUE").when(F.col("p_value").isNull(), "NO_HISTORY").when(F.col("d5").isNull(), "NO_CHANGE").when(F.col("p_d1").isNull() | F.col("p_d5").isNull(), "NO_CHANGE_HISTORY").otherwise("OBSERVABLE")
    return rows.groupBy("series_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def front_curve_formal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose two nearest contracts are formal and give a slope."""
    rows = _nearest(spark, sf_dir).where("place <= 2").groupBy("series_id", "session_date")
    out = rows.agg(F.count("*").alias("n"), F.min(vintage.is_formal(F.col("vintage_kind"))).alias("f"), F.min("settle").alias("s"))
    return out.select("series_id", "session_date", ((F.col("n") == 2) & F.col("f") & (F.col("s") > 0)).alias("front_formal"))


def product_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READY, DEGRADED or BLOCKED per symbol with the reasons, from the freshness of its series."""
    rows = pit.freshness(table(spark, sf_dir, "observations"), "2025-06-30").withColumn("symbol", F.regexp_replace("series_id", BASE, ""))
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), n("FRESH").alias("fresh"), n("STALE").alias("stale"), n("MISSING").alias("missing"), n("INCOMPLETE").alias("incomplete"))
    reasons = F.concat_ws(",", F.when(F.col("stale") > 0, "STALE"), F.when(F.col("missing") > 0, "MISSING"), F.when(F.col("incomplete") > 0, "INCOMPLETE"))
    status = F.when(F.col("fresh") == F.col("n"), "READY").when(F.col("fresh") > 0, "DEGRADED").otherwise("BLOCKED")
    return out.select("symbol", status.alias("status"), reasons.alias("reasons"))


def observation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol and session: what is there, which of the symbol's series are missing, values that no level has."""
    rows = readings(spark, sf_dir).where(F.col("series_id").rlike(BASE)).select(F.regexp_replace("series_id", BASE, "").alias("symbol"), "series_id", "session_date", "value")
    all_of = rows.groupBy("symbol").agg(F.collect_set("series_id").alias("want"))  # at most four parts of a symbol
    daily = rows.groupBy("symbol", "session_date").agg(F.collect_set("series_id").alias("have"), F.count(F.when(F.col("value") <= 0, 1)).alias("nonpositive"))
    return daily.join(all_of, "symbol").select("symbol", "session_date", F.size("have").alias("n"), F.array_join(F.sort_array(F.array_except("want", "have")), ",").alias("missing"), "nonpositive")


def curve_methodology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family and session the methodologies of the contracts, the last known set filled forward."""
    rows = table(spark, sf_dir, "vx_contracts").groupBy("series_id", "session_date").agg(F.nullif(F.array_join(F.sort_array(F.collect_set("methodology_version")), ","), F.lit("")).alias("m"))
    return rows.select("series_id", "session_date", F.concat(F.lit("VX="), filled(F.col("m"), along(["series_id"], ["session_date"]))).alias("signature"))


def input_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the selected inputs of each series and month: the sorted days and revisions, a month's worth at once."""
    rows = pit.known_at_decision(table(spark, sf_dir, "observations"), table(spark, sf_dir, "exchange_sessions"))
    line = F.concat_ws("|", F.date_format("session_date", "yyyy-MM-dd"), F.col("revision_id"))
    month = rows.groupBy("series_id", F.date_format("session_date", "yyyy-MM").alias("month")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    return month.select("series_id", "month", F.size("x").cast("bigint").alias("n"), F.sha2(F.array_join("x", ";"), 256).alias("digest"))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of phases and kinds as one text each."""
    def text(df: DataFrame, column: str) -> DataFrame:
        counts = df.groupBy(F.coalesce(F.col(column), F.lit("NULL")).alias("v")).agg(F.count("*").alias("n"))  # a handful of kinds
        return counts.agg(F.lit(column).alias("what"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "v", F.col("n").cast("string")))), ",").alias("counts"))

    o, t = table(spark, sf_dir, "observations"), ledger(spark, sf_dir)
    return reduce(DataFrame.unionByName, [text(o, "vintage_kind"), text(t, "event_status"), text(t, "label_status")])


def candidate_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible, completed and positive predictions overall, in development and in confirmation."""
    rows = ledger(spark, sf_dir)
    split = F.when(F.col("prediction_date") <= F.lit(SPLIT_DAY).cast("date"), "development").otherwise("confirmation")
    long = rows.select("event_id", "event_status", "label", F.explode(F.array(F.lit("overall"), split)).alias("part"))
    out = long.groupBy("event_id", "part").agg(F.count(F.when(F.col("event_status") == "ELIGIBLE", 1)).alias("eligible"), F.count("label").alias("completed"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive"))
    return out.withColumn("base_rate", F.round(ratio(F.col("positive").cast("double"), F.col("completed").cast("double")), 9))


def stage_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median score of each mid-curve state per year where at least 20 sessions tell."""
    rows = _states(spark, sf_dir).where("shock is not null")
    out = rows.groupBy(F.year("session_date").alias("year"), "mid_state").agg(F.count("*").alias("n"), F.median("shock").alias("m"))
    return out.where("n >= 20").select("year", "mid_state", "n", F.round("m", 7).alias("median"))


def basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant 30-day value against the spot index of the day."""
    spot = readings(spark, sf_dir).where(F.col("series_id").rlike("^VIX.*_CLOSE$")).select("series_id", "session_date", "value")
    value = _curve(spark, sf_dir).where("value30 is not null").select(F.col("series_id").alias("family"), "session_date", "value30")
    return value.join(spot, "session_date").select("family", "series_id", "session_date", F.round(F.when(F.col("value") != 0, F.col("value30") / F.col("value") - 1), 7).alias("basis"))


def cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last rows of every stretch of high level."""
    w = along(["series_id"], ["idx"])
    high = F.coalesce(F.col("p_value") >= 0.9, F.lit(False))
    rows = state_frame(spark, sf_dir).select("series_id", "idx", high.alias("high"))
    rows = rows.withColumns({"begins": F.col("high") & ~F.coalesce(F.lag("high").over(w), F.lit(False)), "ends": F.col("high") & ~F.coalesce(F.lead("high").over(w), F.lit(False))})
    return rows.where("begins or ends")


def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How signals met events: hits, misses, false alarms (signals that no event selected), the median and 90th percentile of the offset."""
    high, rise = _rises(spark, sf_dir)
    met = events.matched_clusters(high, rise, "series_id", 5, 5)
    hits = met.groupBy("series_id").agg(F.count("signal").alias("hits"), F.count(F.when(F.col("signal").isNull(), 1)).alias("misses"), F.percentile(F.col("offset"), F.lit(0.5)).alias("median_offset"), F.percentile(F.col("offset"), F.lit(0.9)).alias("p90_offset"))
    chosen = met.where("signal is not null").select("series_id", F.col("signal").alias("cluster")).distinct()
    back = rise.join(chosen, ["series_id", "cluster"], "left_anti").groupBy("series_id").agg(F.count("*").alias("false_alarms"))
    return hits.join(back, "series_id", "left").select("series_id", "hits", "misses", F.coalesce("false_alarms", F.lit(0)).alias("false_alarms"), F.round("median_offset", 6).alias("median_offset"), F.round("p90_offset", 6).alias("p90_offset"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's part in the score of the last scored session, and the conditions that would change the view."""
    rows = state_frame(spark, sf_dir).where("shock is not null")
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("idx")))
    last = rows.withColumn("place", place).where("place = 1")
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.round(F.lit(w) * (F.col(c) - 0.5), 9).alias("contribution")) for c, w in (("p_value", 0.5), ("p_d1", 0.25), ("p_d5", 0.25))])
    triggers = F.concat_ws(",", F.when(F.col("shock") >= 65, "SHOCK_HIGH"), F.when(F.col("p_d5") <= 0.35, "FALLING"), F.when(F.col("hard_acute"), "ACUTE"))
    return last.select("series_id", triggers.alias("triggers"), F.explode(parts).alias("x")).select("series_id", "triggers", "x.*")


def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of codes from the signs of three changes; null where one is unknown."""
    sign = lambda c, up, down: F.when(F.col(c) > 0, up).when(F.col(c) < 0, down).when(F.col(c) == 0, "FLAT")
    rows = state_frame(spark, sf_dir)
    whole = F.col("d1").isNotNull() & F.col("d5").isNotNull() & F.col("shock").isNotNull()
    text = F.concat_ws(" ", F.concat(F.lit("day:"), sign("d1", "UP", "DOWN")), F.concat(F.lit("week:"), sign("d5", "UP", "DOWN")), F.concat(F.lit("score:"), F.floor("shock").cast("string")))
    return rows.select("series_id", "session_date", F.when(whole, text).alias("line")).where("line is not null")


def candidate_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rejected candidate's onset: any of four warnings, or carry closed on two sessions in a row; three-valued."""
    w = along(["series_id"], ["idx"])
    rows = _states(spark, sf_dir)
    closed = F.when(F.col("carry_state") != "UNKNOWN", F.col("carry_state") == "CLOSED")
    rows = rows.withColumn("closed", closed)
    onset = (F.col("p_value") >= 0.9) | (F.col("p_d1") >= 0.95) | (F.col("p_d5") >= 0.95) | F.col("hard_acute") | (F.col("closed") & F.lag("closed").over(w))
    counted = rows.withColumn("onset", onset).groupBy("series_id")
    return counted.agg(F.count(F.when(F.col("onset"), 1)).alias("yes"), F.count(F.when(~F.col("onset"), 1)).alias("no"), F.count(F.when(F.col("onset").isNull(), 1)).alias("unknown"))


def common_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions on which every ticker has a price of those that were listed then, per month."""
    rows = table(spark, sf_dir, "prices").where(real(F.col("adjusted_open")).isNotNull() & F.col("ticker").isNotNull()).select("ticker", "session_date").distinct()
    span = rows.groupBy("ticker").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    steps = span.select(F.col("a").alias("session_date"), F.lit(1).alias("s")).unionByName(span.select(F.date_add("b", 1).alias("session_date"), F.lit(-1).alias("s")))
    days = rows.groupBy("session_date").agg(F.count("*").alias("n"))
    line = days.unionByName(steps.groupBy("session_date").agg(F.sum("s").alias("s")), allowMissingColumns=True).groupBy("session_date").agg(F.max("n").alias("n"), F.sum(F.coalesce("s", F.lit(0))).alias("s"))
    listed = F.sum("s").over(Window.orderBy("session_date"))  # one row a calendar day at most
    return line.withColumn("listed", listed).where("n is not null").groupBy(F.date_format("session_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("sessions"), F.count(F.when(F.col("n") == F.col("listed"), 1)).alias("common"))


def _second_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate may only remove exposure: at risk when the baseline is and the last day didn't lose."""
    w = along(["ticker"], ["session_date"])
    rows = _returns(spark, sf_dir)
    keeps = F.col("up") & F.coalesce(F.col("adjusted_open") >= F.lag("adjusted_open").over(w), F.lit(True))
    rows = rows.withColumn("keeps", keeps)
    return backtest.probe_ledger(rows, "ticker", "session_date", F.when(F.col("keeps"), "RISK").otherwise("CASH"), F.when(F.col("keeps"), F.col("asset_return")).otherwise(0.0))


def probe_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate against baseline per ticker: final values, drawdowns, rows where it added exposure, and the class."""
    w = along(["ticker"], ["session_date"])
    pick = lambda df, p: df.withColumn("r20", backtest.compounded(F.col("growth") - 1, 20, w)).select("ticker", "session_date", *[F.col(c).alias(f"{p}_{c}") for c in ("asset", "nav", "drawdown", "r20")])
    both = pick(_probe(spark, sf_dir), "a").join(pick(_second_probe(spark, sf_dir), "b"), ["ticker", "session_date"])
    out = both.groupBy("ticker").agg(
        *[F.round(F.max_by(f"{p}_nav", "session_date"), 4).alias(f"{p}_nav") for p in "ab"], *[F.round(F.min(f"{p}_drawdown"), 7).alias(f"{p}_drawdown") for p in "ab"],
        *[F.round(F.min(f"{p}_r20"), 7).alias(f"{p}_worst20") for p in "ab"], F.count(F.when((F.col("a_asset") == "CASH") & (F.col("b_asset") == "RISK"), 1)).alias("added"),
    )
    not_worse = (F.col("b_drawdown") >= F.col("a_drawdown")) & (F.col("b_worst20") >= F.col("a_worst20"))
    better = (F.col("b_drawdown") > F.col("a_drawdown")) | (F.col("b_worst20") > F.col("a_worst20"))
    kind = F.when((F.col("b_nav") > F.col("a_nav")) & not_worse & better, "POSITIVE").when((F.col("b_nav") < F.col("a_nav")) & ~not_worse, "NEGATIVE").otherwise("MIXED")
    return out.withColumn("verdict", kind)


def daily_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily change of the candidate's lead over the baseline; the first day keeps the lead itself."""
    w = along(["ticker"], ["session_date"])
    both = _probe(spark, sf_dir).select("ticker", "session_date", F.col("nav").alias("a")).join(_second_probe(spark, sf_dir).select("ticker", "session_date", F.col("nav").alias("b")), ["ticker", "session_date"])
    rows = both.withColumn("lead", F.col("b") - F.col("a"))
    return rows.select("ticker", "session_date", F.round(F.coalesce(F.col("lead") - F.lag("lead").over(w), F.col("lead")), 4).alias("change"))


def extended_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending later predictions to an earlier ledger and refreshing its outcomes gives the full ledger: rows kept,
    added, with refreshed outcomes, and how far the result is from the rebuild (0)."""
    full = ledger(spark, sf_dir).select("prediction_id", "event_id", "decision_at", "label", "outcome_available_at")
    at = F.lit(AS_OF).cast("timestamp_ntz")
    early = full.where(F.col("decision_at") <= at)
    old = early.withColumn("label", F.when(F.col("outcome_available_at") <= at, F.col("label")))
    news = full.select("prediction_id", F.col("label").alias("now"))
    refreshed = old.join(news, "prediction_id", "left")
    result = refreshed.withColumn("label", F.coalesce("label", "now")).drop("now").unionByName(full.where((F.col("decision_at") > at) | F.col("decision_at").isNull()))
    gone = full.exceptAll(result).agg(F.count("*").alias("lost")).withColumn("one", F.lit(1))
    changed = refreshed.agg(F.count("*").alias("kept"), F.count(F.when(F.col("label").isNull() & F.col("now").isNotNull(), 1)).alias("refreshed")).withColumn("one", F.lit(1))
    added = result.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return changed.join(added, "one").join(gone, "one").select("kept", "refreshed", (F.col("total") - F.col("kept")).alias("added"), "lost")


def cache_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored history is good for, from one pass over the present one: a forced or missing or unreadable store is rebuilt, the same digest is a
    hit, the same on the stored part an append, a longer store means that history was cut, else it has changed.

    Digests are sums of row hashes, so each scenario's store and the present history are conditional sums of the same scan.
    """
    rows = readings(spark, sf_dir)
    early = F.col("session_date") <= F.lit(SPLIT_DAY).cast("date")
    cols = ["series_id", "session_date", "value"]
    h, other = F.xxhash64(*cols).cast("decimal(38,0)"), F.xxhash64("series_id", "session_date", F.col("value") + 1).cast("decimal(38,0)")
    facts = rows.agg(
        F.count("*").alias("n"), F.sum(h).alias("now"), F.count(F.when(early, 1)).alias("n_part"), F.sum(F.when(early, h)).alias("part"),
        F.sum(F.when(early, F.when(F.col("value") > 100, other).otherwise(h))).alias("changed"), F.count(F.when(early & (F.col("value") > 100), 1)).alias("n_changed"),
    )
    nothing, text = F.lit(None).cast("decimal(38,0)"), lambda x: F.lit(x)
    cases = [  # name, forced, rows held (null: no store), digest held (null: unreadable)
        ("same", False, F.col("n"), F.col("now")), ("shorter", False, F.col("n_part"), F.col("part")), ("altered", False, F.col("n_part"), F.col("changed")),
        ("longer", False, F.col("n") + 1, F.col("now") + 1), ("forced", True, F.col("n"), F.col("now")), ("missing", False, F.lit(None).cast("bigint"), nothing), ("unreadable", False, F.col("n"), nothing),
    ]
    stores = F.array(*[F.struct(text(n).alias("stored"), text(f).alias("forced"), k.cast("bigint").alias("n_held"), d.cast("decimal(38,0)").alias("held")) for n, f, k, d in cases])
    kind = (
        F.when(F.col("forced"), "FULL_REBUILD_FORCED").when(F.col("n_held").isNull(), "FULL_REBUILD_MISSING_CACHE").when(F.col("held").isNull(), "FULL_REBUILD_INVALID_CACHE")
        .when(F.col("held") == F.col("now"), "EXACT_CACHE_HIT").when(F.col("n_held") > F.col("n"), "FULL_REBUILD_HISTORY_TRUNCATED")
        .when((F.col("n_held") == F.col("n_part")) & (F.col("held") == F.col("part")), "INCREMENTAL_APPEND").otherwise("FULL_REBUILD_HISTORY_CHANGED")
    )
    return facts.withColumn("s", F.explode(stores)).select("*", "s.*").select("stored", kind.alias("resolution"), "n_held")


def causality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that no future information reaches the past. Each choice is made a second time by other means and compared; violations are rows that differ."""
    days = table(spark, sf_dir, "exchange_sessions").select("session_date", "decision_at")
    rows = table(spark, sf_dir, "observations").where(vintage.is_formal(F.col("vintage_kind")))
    chosen = pit.known_at_decision(table(spark, sf_dir, "observations"), days).select("series_id", "session_date", "revision_id")
    points = rows.select("series_id", "session_date").distinct().join(days, "session_date").withColumn("ask", F.concat_ws("|", "series_id", "session_date"))
    again = attributes_as_of(points, rows, "ask", "series_id", "session_date", "decision_at").where("revision_id is not null").select("series_id", "session_date", "revision_id")
    both = chosen.join(again.withColumnRenamed("revision_id", "other"), ["series_id", "session_date"], "full_outer")

    led = ledger(spark, sf_dir).where("event_id is not null")
    asks = led.where("decision_at is not null").select("event_id", F.col("decision_at").alias("t"), F.lit(0).alias("known"), F.lit(1).alias("ask"))
    outs = led.where("label is not null and outcome_available_at is not null").select("event_id", F.col("outcome_available_at").alias("t"), F.lit(1).alias("known"), F.lit(0).alias("ask"))
    w = Window.partitionBy("event_id").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = asks.unionByName(outs).groupBy("event_id", "t").agg(F.sum("known").alias("known"), F.max("ask").alias("ask")).withColumn("n2", F.sum("known").over(w)).where("ask = 1")
    cohort = causal_cohort_counts(spark, sf_dir).withColumnRenamed("decision_at", "t").join(counted.select("event_id", "t", "n2"), ["event_id", "t"], "full_outer")
    early = led.where("outcome_available_at <= decision_at and label is not null")
    gates = [
        ("revisions chosen twice", both.where("not (revision_id <=> other)")),
        ("cohorts counted twice", cohort.where("not (n <=> n2)")),
        ("outcomes after their decision", early),
        ("sessions follow each other", days.groupBy("session_date").count().where("count > 1")),
    ]
    return reduce(DataFrame.unionByName, [audit.gate(n, v) for n, v in gates])


def one_to_one_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that would break a one-to-one join of predictions to readings, on either side, and how many pair up."""
    t, r = ledger(spark, sf_dir).select("prediction_id", "series_id", F.col("prediction_date").alias("session_date")), readings(spark, sf_dir)
    left = t.groupBy("series_id", "session_date").agg(F.count("*").alias("a"))
    both = left.join(r.groupBy("series_id", "session_date").agg(F.count("*").alias("b")), ["series_id", "session_date"], "left")
    return both.agg(F.count(F.when(F.col("a") > 1, 1)).alias("left_repeats"), F.count(F.when(F.col("b") > 1, 1)).alias("right_repeats"), F.count("b").alias("matched"), F.count(F.when(F.col("b").isNull(), 1)).alias("unmatched"))


QUERIES = {
    f.__name__: f
    for f in (
        usable_start, observability_gate, front_curve_formal, product_readiness, observation_audit, curve_methodology, input_manifest, value_counts, candidate_cohort, stage_medians, basis, cluster_edges,
        timing_audit, contributions, narrative, candidate_event, common_sessions, probe_comparison, daily_attribution, extended_ledger, cache_resolution, causality_gates, one_to_one_joins,
    )
}

PQ = PX.replace("when up then 'RISK' else 'CASH' end as asset, case when up then asset_return", "when keeps then 'RISK' else 'CASH' end as asset, case when keeps then asset_return")
for _n in ("px", "py", "pz", "pt", "pg", "pn", "pd"):
    PQ = PQ.replace(f"{_n} as (", f"q{_n} as (").replace(f"from {_n} ", f"from q{_n} ").replace(f"from {_n})", f"from q{_n})").replace(f"from {_n}\n", f"from q{_n}\n")
PQ = PQ.replace("from qpy where", "from (select *, up and coalesce(o >= lag(o) over (partition by ticker order by session_date), true) as keeps from qpy where asset_return is not null and up is not null) where")
BOTH = f"{PX}, {PQ}, bo as (select a.ticker, a.session_date, a.asset as aa, b.asset as ba, a.nav as an, b.nav as bn, a.drawdown as ad, b.drawdown as bd, a.r20 as ar, b.r20 as br from pd a join qpd b using (ticker, session_date))"
ORACLE = {
    "usable_start": rf"""with {R}, {CURVE}, y as (select regexp_replace(series_id, '_(OPEN|HIGH|LOW|CLOSE)$', '') as symbol, series_id, session_date from r),
      n as (select symbol, count(distinct series_id) as need from y group by all), d as (select symbol, session_date, count(distinct series_id) as n from y group by all)
      select symbol, min(session_date) as first_complete, greatest(min(session_date), (select min(session_date) from cc where formal)) as usable_from from d join n using (symbol) where d.n = need group by all""",
    "observability_gate": f"""{S} select series_id, case when value is null then 'NO_VALUE' when p_value is null then 'NO_HISTORY' when d5 is null then 'NO_CHANGE' when p_d1 is null or p_d5 is null then 'NO_CHANGE_HISTORY'
      else 'OBSERVABLE' end as reason, count(*) as n from st group by all""",
    "front_curve_formal": f"with {CURVE} select series_id, session_date, count(*) = 2 and bool_and(coalesce(vintage_kind in ('OBSERVED_PIT', 'ASSUMED_PIT'), false)) and min(settle) > 0 as front_formal from near where place <= 2 group by all",
    "product_readiness": rf"""with f as (select regexp_replace(series_id, '_(OPEN|HIGH|LOW|CLOSE)$', '') as symbol, max(case when {V} is not null then session_date end) as l,
        bool_or(session_date = date '2025-06-30' and {V} is not null) as hit, bool_or(session_date = date '2025-06-30') as row_ from observations group by series_id),
      s as (select symbol, case when l is null then 'MISSING' when hit then 'FRESH' when row_ then 'INCOMPLETE' when l < date '2025-06-30' then 'STALE' else 'SESSION_GAP' end as status from f)
      select symbol, case when count(*) filter (status = 'FRESH') = count(*) then 'READY' when count(*) filter (status = 'FRESH') > 0 then 'DEGRADED' else 'BLOCKED' end as status,
        concat_ws(',', case when count(*) filter (status = 'STALE') > 0 then 'STALE' end, case when count(*) filter (status = 'MISSING') > 0 then 'MISSING' end, case when count(*) filter (status = 'INCOMPLETE') > 0 then 'INCOMPLETE' end) as reasons
      from s group by symbol""",
    "observation_audit": f"""with {R}, y as (select {B} as symbol, series_id, session_date, value from r where {IS}), w as (select distinct symbol, series_id from y), d as (select symbol, session_date, count(distinct series_id)::int as n,
        count(*) filter (value <= 0) as nonpositive from y group by all), x as (select d.symbol, d.session_date, string_agg(w.series_id, ',' order by w.series_id) as missing from d join w using (symbol)
        where not exists (select 1 from y where y.symbol = d.symbol and y.session_date = d.session_date and y.series_id = w.series_id) group by all)
      select d.symbol, d.session_date, n, coalesce(missing, '') as missing, nonpositive from d left join x using (symbol, session_date)""",
    "curve_methodology": """with m as (select series_id, session_date, string_agg(distinct methodology_version, ',' order by methodology_version) as m from vx_contracts group by all)
      select series_id, session_date, 'VX=' || last_value(m ignore nulls) over (partition by series_id order by session_date rows between unbounded preceding and current row) as signature from m""",
    "input_manifest": f"""with k as ({KNOWN}) select series_id, strftime(session_date, '%Y-%m') as month, count(*) as n,
      sha256(string_agg(strftime(session_date, '%Y-%m-%d') || '|' || revision_id, ';' order by strftime(session_date, '%Y-%m-%d') || '|' || revision_id)) as digest from k group by series_id, strftime(session_date, '%Y-%m')""",
    "value_counts": f"""with {L}, c as (select 'vintage_kind' as what, coalesce(vintage_kind, 'NULL') as v, count(*) as n from observations group by all union all select 'event_status', coalesce(event_status, 'NULL'), count(*) from led group by all
      union all select 'label_status', coalesce(label_status, 'NULL'), count(*) from led group by all) select what, string_agg(v || '=' || n, ',' order by v || '=' || n) as counts from c group by what""",
    "candidate_cohort": f"""with {L}, p as (select *, 'overall' as part from led union all select *, case when prediction_date <= date '{SPLIT_DAY}' then 'development' else 'confirmation' end from led)
      select event_id, part, count(*) filter (event_status = 'ELIGIBLE') as eligible, count(label) as completed, coalesce(sum(label), 0)::bigint as positive,
        case when count(label) > 0 then round(coalesce(sum(label), 0)::double / count(label), 9) end as base_rate from p group by all""",
    "stage_medians": f"{T} select year(session_date)::int as year, mid_state, count(*) as n, round(median(shock), 7) as median from t4 where shock is not null group by year(session_date), mid_state having count(*) >= 20",
    "basis": f"""with {R}, {CURVE}, v as (select series_id as family, session_date, {_brackets()[0]} as value30 from cc where formal)
      select family, r.series_id, session_date, case when value <> 0 then round(value30 / value - 1, 7) end as basis from v join r using (session_date) where value30 is not null and regexp_matches(r.series_id, '^VIX.*_CLOSE$')""",
    "cluster_edges": f"""{S}, h as (select series_id, idx, coalesce(p_value >= 0.9, false) as high from st),
      e as (select *, high and not coalesce(lag(high) over w, false) as begins, high and not coalesce(lead(high) over w, false) as ends from h window w as (partition by series_id order by idx)) select * from e where begins or ends""",
    "timing_audit": f"""{CL}, m1 as (select ce.series_id, ce.cluster, cs.cluster as signal, cs.first - ce.first as off from ce left join cs on cs.series_id = ce.series_id and cs.first <= ce.last + 5 and cs.last >= ce.first - 5
        qualify row_number() over (partition by ce.series_id, ce.cluster order by abs(cs.first - ce.first), cs.first) = 1),
      h as (select series_id, count(off) as hits, count(*) filter (off is null) as misses, round(quantile_cont(off, 0.5), 6) as median_offset, round(quantile_cont(off, 0.9), 6) as p90_offset from m1 group by all),
      f as (select cs.series_id, count(*) as false_alarms from cs where not exists (select 1 from m1 where m1.series_id = cs.series_id and m1.signal = cs.cluster) group by all)
      select h.series_id, hits, misses, coalesce(false_alarms, 0)::bigint as false_alarms, median_offset, p90_offset from h left join f using (series_id)""",
    "contributions": f"""{S}, l as (select *, concat_ws(',', case when shock >= 65 then 'SHOCK_HIGH' end, case when p_d5 <= 0.35 then 'FALLING' end, case when hard_acute then 'ACUTE' end) as triggers from st where shock is not null
        qualify row_number() over (partition by series_id order by idx desc) = 1)
      select series_id, triggers, 'p_value' as component, round(0.5::double * (p_value - 0.5), 9) as contribution from l union all select series_id, triggers, 'p_d1', round(0.25::double * (p_d1 - 0.5), 9) from l
      union all select series_id, triggers, 'p_d5', round(0.25::double * (p_d5 - 0.5), 9) from l""",
    "narrative": f"""{S} select series_id, session_date, 'day:' || case when d1 > 0 then 'UP' when d1 < 0 then 'DOWN' else 'FLAT' end || ' week:' || case when d5 > 0 then 'UP' when d5 < 0 then 'DOWN' else 'FLAT' end
      || ' score:' || floor(shock)::bigint as line from st where d1 is not null and d5 is not null and shock is not null""",
    "candidate_event": f"""{T}, c as (select *, case when carry_state <> 'UNKNOWN' then carry_state = 'CLOSED' end as closed from t4), d as (select *, lag(closed) over (partition by series_id order by idx) as before_closed from c),
      o as (select series_id, p_value >= 0.9 or p_d1 >= 0.95 or p_d5 >= 0.95 or hard_acute or (closed and before_closed) as onset from d)
      select series_id, count(*) filter (onset) as yes, count(*) filter (not onset) as no, count(*) filter (onset is null) as unknown from o group by all""",
    "common_sessions": """with r as (select distinct ticker, session_date from prices where ticker is not null and adjusted_open is not null and not isnan(adjusted_open)), s as (select ticker, min(session_date) as a, max(session_date) as b from r group by ticker),
      d as (select session_date, count(*) as n from r group by session_date), l as (select d.session_date, d.n, (select count(*) from s where s.a <= d.session_date and s.b >= d.session_date) as listed from d)
      select strftime(session_date, '%Y-%m') as month, count(*) as sessions, count(*) filter (n = listed) as common from l group by strftime(session_date, '%Y-%m')""",
    "probe_comparison": f"""with {BOTH}, c as (select ticker, round(arg_max(an, session_date), 4) as a_nav, round(arg_max(bn, session_date), 4) as b_nav, round(min(ad), 7) as a_drawdown, round(min(bd), 7) as b_drawdown,
        round(min(ar), 7) as a_worst20, round(min(br), 7) as b_worst20, count(*) filter (aa = 'CASH' and ba = 'RISK') as added from bo group by ticker)
      select *, case when b_nav > a_nav and b_drawdown >= a_drawdown and b_worst20 >= a_worst20 and (b_drawdown > a_drawdown or b_worst20 > a_worst20) then 'POSITIVE'
        when b_nav < a_nav and not (b_drawdown >= a_drawdown and b_worst20 >= a_worst20) then 'NEGATIVE' else 'MIXED' end as verdict from c""",
    "daily_attribution": f"with {BOTH} select ticker, session_date, round(coalesce((bn - an) - lag(bn - an) over (partition by ticker order by session_date), bn - an), 4) as change from bo",
    "extended_ledger": f"""with {L} select count(*) filter (decision_at <= timestamp '{AS_OF}') as kept, count(*) filter (decision_at <= timestamp '{AS_OF}' and label is not null and not coalesce(outcome_available_at <= timestamp '{AS_OF}', false)) as refreshed,
      count(*) filter (decision_at > timestamp '{AS_OF}' or decision_at is null) as added, 0::bigint as lost from led""",
    "cache_resolution": f"""with {R}, f as (select count(*) as n, count(*) filter (session_date <= date '{SPLIT_DAY}') as p, count(*) filter (session_date <= date '{SPLIT_DAY}' and value > 100) as c,
        count(*) filter (session_date > date '{SPLIT_DAY}') as later from r)
      select 'same' as stored, 'EXACT_CACHE_HIT' as resolution, n as n_held from f union all select 'shorter', case when later = 0 then 'EXACT_CACHE_HIT' else 'INCREMENTAL_APPEND' end, p from f
      union all select 'altered', case when c > 0 then 'FULL_REBUILD_HISTORY_CHANGED' when later = 0 then 'EXACT_CACHE_HIT' else 'INCREMENTAL_APPEND' end, p from f
      union all select 'longer', 'FULL_REBUILD_HISTORY_TRUNCATED', n + 1 from f union all select 'forced', 'FULL_REBUILD_FORCED', n from f union all select 'missing', 'FULL_REBUILD_MISSING_CACHE', null from f
      union all select 'unreadable', 'FULL_REBUILD_INVALID_CACHE', n from f""",
    "causality_gates": f"""with {OUT}, k as ({KNOWN}),
      o as (select series_id, session_date, arg_max(revision_id, (available_at, ingested_at, revision_id)) as other from observations join exchange_sessions using (session_date)
        where available_at <= decision_at and vintage_kind in ('OBSERVED_PIT', 'ASSUMED_PIT') group by all),
      e as (select event_id, t, sum(y) over (partition by event_id order by t range between unbounded preceding and current row) as n2, ask from (
        select event_id, t, sum(y) as y, max(ask) as ask from (select event_id, t, 1 as y, 0 as ask from oc where event_id is not null union all select event_id, decision_at, 0, 1 from ask) group by all)),
      v(gate, violations) as (
        select 'revisions chosen twice', count(*) from k full join o using (series_id, session_date) where revision_id is distinct from other
        union all select 'cohorts counted twice', count(*) from cnt full join (select * from e where ask = 1) e on e.event_id = cnt.event_id and e.t = cnt.decision_at where n is distinct from n2
        union all select 'outcomes after their decision', count(*) from led where outcome_available_at <= decision_at and label is not null and event_id is not null
        union all select 'sessions follow each other', count(*) from (select session_date from exchange_sessions group by 1 having count(*) > 1))
      select gate, violations, violations = 0 as passed from v""",
    "one_to_one_joins": f"""with {R}, {L}, a as (select series_id, prediction_date as session_date, count(*) as a from led group by all)
      select count(*) filter (a > 1) as left_repeats, 0::bigint as right_repeats, count(r.session_date) as matched, count(*) filter (r.session_date is null) as unmatched from a left join r using (series_id, session_date)""",
}
