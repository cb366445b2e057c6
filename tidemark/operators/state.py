"""The state of a market per session: axis scores, three-valued predicates, answers, the raw phase, and event outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket, weighted_score
from .events import forward_labels
from .windows import along, any_true, at_least_true, level_change, log_change, trailing

# The percentiles that each axis weighs; "-x" counts the percentile of x from above, "=x" takes x as it is.
AXES = {
    "carry_risk": (("-slope", 0.45), ("-basis", 0.35), ("-d5_slope", 0.20)),
    "shock": (("near", 0.30), ("d1_vix", 0.20), ("d5_vix", 0.20), ("d5_vvix", 0.15), ("vvix", 0.15)),
    "tail": (("skew", 0.70), ("d5_skew", 0.30)),
    "persistence": (("mid", 0.40), ("-mid_slope", 0.30), ("d5_mid", 0.20), ("=inversion", 0.10)),
    "repair": (("-d5_vix", 0.30), ("-d5_near", 0.25), ("d5_slope", 0.20), ("-d5_vvix", 0.15), ("-d5_mid", 0.10)),
}
BASELINE = {"carry_risk": 0.30, "shock": 0.30, "tail": 0.20, "persistence": 0.20}
# What is ranked.
RANKED = "slope basis d5_slope near d1_vix d5_vix d5_vvix vvix skew d5_skew mid mid_slope d5_mid d5_near d5_mid_slope oscillator premium".split()
# Names and thresholds of levels, answers and directions.
LEVELS = ([35, 55, 70, 85], ["LOW", "WATCH", "ELEVATED", "HIGH", "EXTREME"])
TAILS = ([60, 75, 90], ["NORMAL", "ELEVATED", "RICH", "EXTREME"])
ACUTE_SHOCK, ACUTE_SIGNS, STEP = 85.0, 2, 7.5
ANSWERS = ("carry_answer", "shock_answer", "tail_answer", "persistence_answer", "repair_answer")
# Events, their horizons, the hits that they need, and whether a model is fitted.
EVENTS = {
    "acute_front_stress_5d": (5, 1), "front_inversion_5d": (5, 1), "mid_curve_pressure_accelerates_5d": (5, 1),
    "broad_stress_persists_10d": (10, 5), "carry_environment_recovers_10d": (10, 1),
}


def _changed(x: Column, k: int, w, log: bool) -> Column:
    return F.round(log_change(x, k, w) if log else level_change(x, k, w), 9)


def with_changes(rows: DataFrame, key: str, idx: str) -> DataFrame:
    """Adds the changes that the axes look at, over rows of a gapless session index."""
    w = along([key], [idx])
    plan = {"d1_vix": ("vix", 1, True), "d5_vix": ("vix", 5, True), "d5_vvix": ("vvix", 5, True), "d5_mid": ("mid", 5, True)}
    plan |= {f"d5_{c}": (c, 5, False) for c in ("slope", "near", "skew", "mid_slope", "inversion")}
    return rows.withColumns({name: _changed(F.col(c), k, w, log) for name, (c, k, log) in plan.items()})


def _part(name: str) -> Column:
    return F.col(name[1:]) if name[0] == "=" else 1 - F.col(f"p_{name[1:]}") if name[0] == "-" else F.col(f"p_{name}")


def with_scores(rows: DataFrame, key: str, idx: str) -> DataFrame:
    """Adds the six scores, confirmations, hard_acute, the data status and the published levels. A missing component
    leaves its axis null. The five-session change is taken before scores of sessions that aren't OK are withheld."""
    w = along([key], [idx])
    out = rows.withColumns({axis: weighted_score([(_part(c), weight) for c, weight in parts]) for axis, parts in AXES.items()})
    base = F.lit(0.0)
    for axis, weight in BASELINE.items():
        base = base + F.col(axis) * weight
    out = out.withColumn("base", base).withColumn("d5_base", F.col("base") - F.lag("base", 5).over(w))
    signs = [F.col("vix9d") > F.col("vix"), F.col("f1") > F.col("f2"), F.col("p_oscillator") >= 0.90]
    out = out.withColumn("confirmations", sum(s.cast("int") for s in signs))  # null unless all three are known
    acute = (F.col("shock") >= ACUTE_SHOCK) & (F.col("confirmations") >= ACUTE_SIGNS)
    known = F.col("shock").isNotNull() & F.col("confirmations").isNotNull()
    whole = F.lit(True)
    for c in (*AXES, "base"):
        whole = whole & F.col(c).isNotNull()
    status = F.when(F.col("vix").isNull() | F.col("value30").isNull(), "UNKNOWN").when(whole & F.col("formal"), "OK").otherwise("PARTIAL")
    premium = F.col("p_premium")
    return out.withColumns({
        "hard_acute": F.when(known, acute), "status": status,
        "compensation": F.when(premium < 0.35, "THIN").when(premium >= 0.75, "RICH").when(premium.isNotNull(), "NORMAL").otherwise("UNKNOWN"),
    })


def scaled(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def with_predicates(rows: DataFrame, key: str, idx: str) -> DataFrame:
    """Adds the three-valued day facts and the states of the mid curve, the front, the tenor scope and the carry environment.
    SQL's AND and OR over null are the three-valued logic; windows reach over rows of the session index."""
    w = along([key], [idx])
    up, down = F.col("d5_mid") > 0, F.col("d5_mid") < 0
    out = rows.withColumns({
        "priced": (F.col("p_mid") >= 0.75) | (F.col("inversion") >= 2 / 3),
        "rising": up & ((F.col("d5_mid_slope") < 0) | (F.col("d5_inversion") > 0)),
        "front": (F.col("near") > 0) | (F.col("slope") < 0),
    })
    receding = any_true(F.col("priced"), w.rowsBetween(-10, -1), 10) & down & ((F.col("d5_mid_slope") > 0) | (F.col("d5_inversion") < 0))
    out = out.withColumn("receding", receding)
    mid = F.lit("QUIET")
    for name in ("rising", "priced", "receding"):
        mid = F.when(F.col(name), name.upper()).when(F.col(name).isNull(), "UNKNOWN").otherwise(mid)
    out = out.withColumn("mid_state", mid)
    pressed = F.col("mid_state").isin("RISING", "PRICED")
    scope = (
        F.when(F.col("front").isNull() | (F.col("mid_state") == "UNKNOWN"), "UNKNOWN").when(F.col("front") & pressed, "BROAD").when(pressed, "MID")
        .when(F.col("front"), "FRONT").otherwise("NONE")
    )
    quiet = F.when(F.col("mid_state") != "UNKNOWN", F.col("mid_state") == "QUIET")
    out = out.withColumns({"scope": scope, "open_day": (F.col("slope") > 0) & (F.col("basis") > 0) & (F.col("near") <= 0) & (F.col("mid_slope") > 0) & quiet})
    before = F.lag("open_day").over(w)
    carry = (
        F.when(F.col("open_day").isNull(), "UNKNOWN").when(F.col("open_day") & F.coalesce(before, F.lit(False)), "OPEN")
        .when(F.col("open_day") | (F.col("mid_state") == "RECEDING"), "RECOVERING").otherwise("CLOSED")
    )
    scoped = lambda test: F.when(F.col("scope") != "UNKNOWN", test)
    out = out.withColumns({"carry_state": carry, "broad_day": scoped(F.col("scope") == "BROAD"), "stress_day": scoped(F.col("scope") != "NONE") | F.col("hard_acute")})
    out = out.withColumns({
        "broad_now": at_least_true(F.col("broad_day"), trailing(w, 5), 5, 3), "recent_stress": any_true(F.col("stress_day"), trailing(w, 10), 10),
        "repair_confirmed": F.when(F.col("mid_state") != "UNKNOWN", F.col("mid_state") == "RECEDING"),
    })
    return out.withColumns({  # evidence of each predicate's own inputs
        "acute_formal": F.col("formal") & F.col("hard_acute").isNotNull(), "slope_formal": F.col("front_formal"),
        "mid_formal": F.col("formal") & (F.col("mid_state") != "UNKNOWN"), "broad_formal": F.col("formal") & F.col("broad_day").isNotNull(),
        "carry_formal": F.col("formal") & (F.col("carry_state") != "UNKNOWN"), "repair_formal": F.col("formal") & F.col("repair_confirmed").isNotNull(),
    })


def with_answers(rows: DataFrame) -> DataFrame:
    """Adds the five answers and the raw phase; a session whose answers aren't all known is PARTIAL, and one that isn't OK
    publishes UNKNOWN and no baseline."""
    shock, repair = F.col("shock"), F.col("repair")
    carry = (
        F.when((F.col("carry_state") == "UNKNOWN") | F.col("slope").isNull(), "UNKNOWN").when(F.col("carry_state") == "OPEN", "SUPPORTIVE")
        .when(F.col("slope") < 0, "INVERTED").when(F.col("carry_state") == "CLOSED", "STRESSED").otherwise("MIXED")
    )
    level = F.when(shock.isNull() | F.col("confirmations").isNull(), "UNKNOWN").when(F.col("hard_acute"), "ACUTE").when(shock >= 65, "HIGH").when(shock >= 40, "BUILDING").otherwise("CALM")
    lasting = (
        F.when(F.col("broad_now").isNull() | (F.col("scope") == "UNKNOWN") | (F.col("mid_state") == "UNKNOWN"), "UNKNOWN").when(F.col("broad_now"), "PERSISTENT")
        .when((F.col("scope") == "BROAD") & (F.col("mid_state") == "RISING"), "DIFFUSING").when(F.col("scope") == "FRONT", "FRONT_LOCALIZED")
        .when((F.col("scope") == "NONE") & (F.col("mid_state") == "QUIET"), "NORMAL").otherwise("MIXED")
    )
    building = F.col("recent_stress") & (repair >= 60)
    mended = (
        F.when(repair.isNull() | F.col("repair_confirmed").isNull(), "UNKNOWN").when(F.col("repair_confirmed"), "CONFIRMED").when(building, "BUILDING")
        .when(building.isNull(), "UNKNOWN").otherwise("INACTIVE")
    )
    out = rows.withColumns({
        "carry_answer": carry, "shock_answer": level, "tail_answer": F.coalesce(bucket(F.col("tail"), *TAILS), F.lit("UNKNOWN")), "persistence_answer": lasting, "repair_answer": mended,
    })
    unknown = F.lit(False)
    for a in ANSWERS:
        unknown = unknown | (F.col(a) == "UNKNOWN")
    out = out.withColumn("published_status", F.when((F.col("status") == "OK") & unknown, "PARTIAL").otherwise(F.col("status")))
    ok = F.col("published_status") == "OK"
    calm = (F.col("carry_answer") == "SUPPORTIVE") & (F.col("shock_answer") == "CALM") & (F.col("persistence_answer") == "NORMAL")
    phase = (
        F.when(~ok, "UNKNOWN").when(F.col("hard_acute"), "ACUTE_FRONT_STRESS").when(F.col("persistence_answer") == "PERSISTENT", "BROAD_PERSISTENT_STRESS")
        .when(F.col("persistence_answer") == "DIFFUSING", "PRESSURE_DIFFUSING").when(F.col("repair_answer") == "CONFIRMED", "REPAIR_IN_PROGRESS")
        .when(F.col("persistence_answer") == "FRONT_LOCALIZED", "FRONT_LOCALIZED_STRESS").when(calm & F.col("tail_answer").isin("RICH", "EXTREME"), "TAIL_RICH_QUIET_CURVE")
        .when(calm, "CARRY_SUPPORTIVE_LOW_STRESS").otherwise("MIXED_TRANSITION")
    )
    shown = F.when(ok, F.col("base"))
    change = F.when(ok, F.col("d5_base"))
    out = out.withColumns({"raw_phase": phase, **{a: F.when(ok, F.col(a)).otherwise("UNKNOWN") for a in ANSWERS}})
    return out.withColumns({
        "baseline": shown, "d5_baseline": change, "pressure_level": F.coalesce(bucket(shown, *LEVELS), F.lit("UNKNOWN")),
        "direction": F.when(change >= STEP, "RISING").when(change <= -STEP, "FALLING").when(change.isNotNull(), "STABLE").otherwise("UNKNOWN"),
    })


def event_facts() -> dict[str, tuple[Column, Column, Column, Sequence[str]]]:
    """Per event: when it may begin, what must come true, the evidence for that, and the inputs of its model (those which
    follow from an earlier eligibility left out, so that they can't decide it)."""
    mid, carry = F.col("mid_state"), F.col("carry_state")
    known_mid = lambda test: F.when(mid != "UNKNOWN", test)
    known_carry = lambda test: F.when(carry != "UNKNOWN", test)
    closed = known_carry(carry.isin("CLOSED", "RECOVERING"))
    return {
        "acute_front_stress_5d": (~F.col("hard_acute"), F.col("hard_acute"), F.col("acute_formal"), ("carry_risk", "shock", "tail", "persistence", "d5_base", "confirmations")),
        "front_inversion_5d": (F.col("slope") >= 0, F.col("slope") < 0, F.col("slope_formal"), ("p_slope", "p_d5_slope", "p_basis", "shock")),
        "mid_curve_pressure_accelerates_5d": (
            known_mid(mid.isin("QUIET", "RECEDING")), known_mid(mid == "RISING"), F.col("mid_formal"), ("p_mid", "p_d5_mid", "p_d5_mid_slope", "inversion", "shock", "d5_base"),
        ),
        "broad_stress_persists_10d": (F.col("broad_day"), F.col("broad_day"), F.col("broad_formal"), ()),
        "carry_environment_recovers_10d": (
            closed & (F.col("front") | known_mid(mid != "QUIET")), known_carry(carry == "OPEN"), F.col("carry_formal"), ("repair", "p_d5_slope", "p_d5_near", "p_d5_mid_slope", "p_d5_mid", "shock"),
        ),
    }


def event_ledger(states: DataFrame, key: str, idx: str, day: str, decision: str) -> DataFrame:
    """(key, day, idx, event_id, onset, event_status, label, label_status, first_hit, valid_through, outcome_available_at):
    one row a session and event.

    An event is UNOBSERVABLE unless the session is OK and formal and all inputs of its model are known; else its onset says
    whether it is ELIGIBLE. A label needs all sessions of the horizon with the predicate and its evidence known, else it
    is CENSORED; it becomes known at the decision of the horizon's last session even if the event came early.
    """
    w, out, items = along([key], [idx]), states, []
    for i, (event, (onset, hit, evidence, inputs)) in enumerate(event_facts().items()):
        horizon, needed = EVENTS[event]
        seen = (F.col("published_status") == "OK") & F.col("formal")
        for c in inputs:
            seen = seen & F.col(c).isNotNull()
        status = F.when(~F.coalesce(seen, F.lit(False)) | onset.isNull(), "UNOBSERVABLE").when(onset, "ELIGIBLE").otherwise("NOT_APPLICABLE")
        out = forward_labels(out, [key], "session", idx, hit, evidence, horizon, needed)
        out = out.withColumnsRenamed({c: f"{c}_{i}" for c in ("label", "label_status", "first_hit")})
        out = out.withColumns({f"onset_{i}": onset, f"status_{i}": status, f"through_{i}": F.lead(day, horizon).over(w), f"known_{i}": F.lead(decision, horizon).over(w)})
        asked = F.col(f"status_{i}") == "ELIGIBLE"
        whole = asked & (F.col(f"label_status_{i}") != "CENSORED")
        shown = F.when(F.col(f"status_{i}") == "NOT_APPLICABLE", "NOT_APPLICABLE").when(asked, F.col(f"label_status_{i}")).otherwise("CENSORED")
        items.append(F.struct(
            F.lit(event).alias("event_id"), F.col(f"onset_{i}").alias("onset"), F.col(f"status_{i}").alias("event_status"), F.when(asked, F.col(f"label_{i}")).alias("label"),
            shown.alias("label_status"), F.when(asked, F.col(f"first_hit_{i}")).alias("first_hit"), F.when(whole, F.col(f"through_{i}")).alias("valid_through"),
            F.when(whole, F.col(f"known_{i}")).alias("outcome_available_at"),
        ))
    return out.select(key, day, idx, F.explode(F.array(*items)).alias("x")).select(key, day, idx, "x.*")
