"""Queries on what was known when: selection, revisions, lineage, calendars and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vintage
from ..functions.calendar import indexed_sessions, rule_settlement, snap_back, third_friday, wall_time
from ..functions.identity import fingerprint, frame_digest
from ..operators import pit
from ..operators.windows import along, filled, run_number
from ..session import real, table

SPLIT = "2018-06-30 00:00:00"
TARGET = "2025-06-30"
MEANING = ["value", "unit", "source", "source_symbol", "observed_at", "methodology_version", "vintage_kind"]
POINT = ["series_id", "session_date"]
BASE = r"_(OPEN|HIGH|LOW|CLOSE)$"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, session_date, value): the reading last loaded of each point; missing ones are out."""
    rows = table(spark, sf_dir, "observations").where("series_id is not null and session_date is not null").withColumn("value", real(F.col("value")))
    return pit.latest_row(rows, POINT, ["ingested_at", "value"], ["value"]).where("value is not null")


def pit_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.known_at_decision(table(spark, sf_dir, "observations"), table(spark, sf_dir, "exchange_sessions"))


def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.known_at(table(spark, sf_dir, "observations"), SPLIT)


def revision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "observations")
    early = F.col("ingested_at") < F.lit(SPLIT).cast("timestamp_ntz")
    merged = pit.merge_revisions(rows.where(early), rows.where(~early), POINT, MEANING)
    return merged.withColumn("value", real(F.col("value"))).select(*POINT, "revision_id", "value", "available_at", "ingested_at")


def identity_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame([("CBOE", "OBSERVED_PIT"), ("CBOE", "ASSUMED_PIT"), ("CFE", "OBSERVED_PIT")], "source string, vintage_kind string")
    rows = pit.admitted(table(spark, sf_dir, "observations"), policy, ["source", "vintage_kind"])
    return rows.groupBy("source", "vintage_kind").agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("n_series"))


def vintage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.vintage_summary(table(spark, sf_dir, "observations"))


def vintage_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakest kind, evidence and formality of each point's deliveries."""
    rows = table(spark, sf_dir, "observations").groupBy(*POINT).agg(F.collect_set("vintage_kind").alias("kinds"))  # three kinds at most
    return rows.select(*POINT, vintage.weakest(F.col("kinds")).alias("weakest"), vintage.evidence(vintage.weakest(F.col("kinds"))).alias("evidence"), vintage.all_formal(F.col("kinds")).alias("formal"))


def methodology_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol and session the methodologies of its four daily series, each filled forward; null until all are known."""
    rows = table(spark, sf_dir, "observations").where(F.col("series_id").rlike(BASE) & F.col("methodology_version").isNotNull())
    last = pit.latest_row(rows, POINT, ["ingested_at", "methodology_version"], ["methodology_version"])
    parts = ["OPEN", "HIGH", "LOW", "CLOSE"]
    wide = (
        last.select(F.regexp_replace("series_id", BASE, "").alias("symbol"), F.regexp_extract("series_id", BASE, 1).alias("part"), "session_date", "methodology_version")
        .groupBy("symbol", "session_date").pivot("part", parts).agg(F.max("methodology_version"))
    )
    w = along(["symbol"], ["session_date"])
    known = wide.select("symbol", "session_date", *[filled(F.col(p), w).alias(p) for p in parts])
    text = F.concat_ws("|", *[F.concat(F.lit(f"{p}="), F.col(p)) for p in sorted(parts)])
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.col(p).isNotNull()
    return known.select("symbol", "session_date", F.when(whole, text).alias("signature"))


def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).where(F.col("series_id").rlike(BASE))
    keyed = rows.select(F.regexp_replace("series_id", BASE, "").alias("symbol"), "session_date", F.lower(F.regexp_extract("series_id", BASE, 1)).alias("part"), "value")
    one = F.when(F.count("value") <= 1, F.max("value")).otherwise(F.raise_error(F.lit("more than one reading for a symbol, session and part")).cast("double"))
    return keyed.groupBy("symbol", "session_date").pivot("part", ["open", "high", "low", "close"]).agg(one)


def on_calendar(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Readings on the sessions from each series' first to its last; gaps are null rows. The calendar is a dimension
    of a few thousand rows at every scale."""
    days = indexed_sessions(table(spark, sf_dir, "exchange_sessions"))
    data = (rows if rows is not None else readings(spark, sf_dir)).join(days.select("session_date", "idx"), "session_date")
    spine = data.groupBy("series_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).select("series_id", F.explode(F.sequence("lo", "hi")).alias("idx"))
    spine = spine.join(days.select("session_date", "idx"), "idx")
    return spine.join(data.select("series_id", "idx", "value"), ["series_id", "idx"], "left").select("series_id", "session_date", "idx", "value")


def calendar_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_calendar(spark, sf_dir)


def latest_complete_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "observations").where(F.col("series_id").rlike(BASE))
    return pit.latest_complete_session(rows, F.regexp_replace("series_id", BASE, ""))


def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.freshness(table(spark, sf_dir, "observations"), TARGET)


def regime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one methodology in each series, the last known one filled forward; before any is known there is no run."""
    rows = pit.latest_row(table(spark, sf_dir, "observations"), POINT, ["ingested_at", "methodology_version"], ["methodology_version", "vintage_kind"])
    w = along(["series_id"], ["session_date"])
    rows = rows.withColumn("method", filled(F.col("methodology_version"), w)).where("method is not null")
    before = F.lag("method").over(w)
    rows = rows.withColumn("run", run_number(before.isNull() | (before != F.col("method")), w))
    return rows.groupBy("series_id", "run").agg(F.min("method").alias("method"), F.min("session_date").alias("first"), F.max("session_date").alias("last"), F.count("*").alias("n"), F.min(vintage.rank(F.col("vintage_kind"))).alias("weakest_rank"))


def running_weakest_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pit.latest_row(table(spark, sf_dir, "observations"), POINT, ["ingested_at", "vintage_kind"], ["vintage_kind"])
    w = along(["series_id"], ["session_date"]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*POINT, vintage.kind_of(F.min(vintage.rank(F.col("vintage_kind"))).over(w)).alias("weakest_so_far"))


def duplicate_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "observations").groupBy("series_id", "session_date", "ingested_at").agg(F.count("*").alias("n"))
    return rows.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"))


def set_ops_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without any reading, and reading days that are no sessions, and how many are common."""
    have, want = readings(spark, sf_dir).select("session_date"), table(spark, sf_dir, "exchange_sessions").select("session_date")
    kinds = [("missing", want.subtract(have)), ("extra", have.distinct().exceptAll(want)), ("common", want.intersect(have))]
    out = None
    for name, df in kinds:
        one = df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "observations")
    return frame_digest(rows.select(*POINT, *MEANING, "revision_id"), [*POINT, *MEANING, "revision_id"])


def semantic_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct meanings and revisions each point has had."""
    rows = table(spark, sf_dir, "observations")
    rows = rows.withColumn("print", fingerprint(rows, ["value", "methodology_version", "vintage_kind"]))
    return rows.groupBy(*POINT).agg(F.countDistinct("print").alias("n_meanings"), F.countDistinct("revision_id").alias("n_revisions"))


def decision_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = indexed_sessions(table(spark, sf_dir, "exchange_sessions"))
    nxt = F.lead("session_date").over(along([], ["idx"]))
    rows = days.withColumn("next_session", nxt)
    return rows.select("session_date", "idx", wall_time(F.col("session_date"), 16, 15, "America/New_York").alias("observed_at"), wall_time(F.col("next_session"), 9, 20, "America/New_York").alias("decision_at")).where("next_session is not null")


def settlement_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "exchange_sessions").select(F.year("session_date").alias("y"), F.month("session_date").alias("m")).distinct()
    rows = months.select("y", "m", third_friday(F.col("y"), F.col("m")).alias("third_friday"), rule_settlement(F.col("y"), F.col("m")).alias("rule_day"))
    return snap_back(rows, "rule_day", table(spark, sf_dir, "exchange_sessions"), "settlement")


QUERIES = {
    f.__name__: f
    for f in (
        pit_latest_revision, asof_snapshot, revision_merge, identity_admission, vintage_summary, vintage_lattice, methodology_signature, wide_pivot,
        calendar_gap_fill, latest_complete_session, freshness_status, regime_runs, running_weakest_vintage, duplicate_key_audit, set_ops_sessions,
        content_digests, semantic_fingerprints, decision_times, settlement_rule,
    )
}

V = "case when isnan(value) then null else value end"
R = f"""r as (select series_id, session_date, x.v as value from (
  select series_id, session_date, max(struct_pack(o := ingested_at, v := {V})) as x from observations
  where series_id is not null and session_date is not null group by all) where x.v is not null)"""
CAL = """cal as (select session_date, row_number() over (order by session_date)::int as idx, decision_at from exchange_sessions),
g0 as (select r.series_id, cal.idx, r.value from r join cal using (session_date)),
g1 as (select series_id, unnest(generate_series(min(idx), max(idx)))::int as idx from g0 group by series_id),
g as (select g1.series_id, cal.session_date, g1.idx, g0.value from g1 join cal using (idx) left join g0 on g0.series_id = g1.series_id and g0.idx = g1.idx)"""
# the shortest text of a double, filled up to 17 significant digits
DIGITS = f"rpad(({V})::varchar, 18 + (value < 0)::int + case when value = 0 or abs(value) >= 1 then 0 else -floor(log10(abs(value)))::int end, '0')"
RANK = "case vintage_kind when 'OBSERVED_PIT' then 2 when 'ASSUMED_PIT' then 1 when 'PROVIDER_BACKTESTED' then 0 end"
KNOWN = f"""select series_id, session_date, revision_id, {V} as value, available_at from (
  select o.*, row_number() over (partition by series_id, session_date order by available_at desc, ingested_at desc, revision_id desc) as rn
  from observations o join exchange_sessions s using (session_date) where available_at <= s.decision_at and vintage_kind in ('OBSERVED_PIT', 'ASSUMED_PIT')) where rn = 1"""
B = r"regexp_replace(series_id, '_(OPEN|HIGH|LOW|CLOSE)$', '')"
P = r"regexp_extract(series_id, '_(OPEN|HIGH|LOW|CLOSE)$', 1)"
IS = r"regexp_matches(series_id, '_(OPEN|HIGH|LOW|CLOSE)$')"
ORACLE = {
    "pit_latest_revision": KNOWN,
    "asof_snapshot": f"""select series_id, session_date, revision_id, {V} as value, available_at from observations where available_at <= timestamp '{SPLIT}'
      qualify row_number() over (partition by series_id, session_date order by available_at desc, ingested_at desc, revision_id desc) = 1""",
    "revision_merge": f"""with o as (select *, concat_ws(chr(1), series_id, session_date, coalesce(({V})::varchar, '~'), coalesce(unit, '~'), coalesce(source, '~'),
        coalesce(source_symbol, '~'), coalesce(observed_at::varchar, '~'), coalesce(methodology_version, '~'), coalesce(vintage_kind, '~')) as fp from observations),
      e as (select * from o where ingested_at < timestamp '{SPLIT}'), i as (select * from o where ingested_at >= timestamp '{SPLIT}'),
      f as (select * from i where fp not in (select fp from e) qualify row_number() over (partition by fp order by ingested_at, available_at nulls first, revision_id) = 1),
      p as (select f.*, row_number() over (partition by series_id, session_date order by ingested_at, available_at nulls first, revision_id, fp) as place from f),
      k as (select distinct series_id, session_date, true as known from e)
      select series_id, session_date, revision_id, {V} as value, available_at, ingested_at from e
      union all select p.series_id, p.session_date, revision_id, {V} as value,
        case when k.known or place > 1 then greatest(available_at, ingested_at) else available_at end, ingested_at
      from p left join k using (series_id, session_date)""",
    "identity_admission": """select source, vintage_kind, count(*) as n, count(distinct series_id) as n_series from observations
      where (source, vintage_kind) in (('CBOE', 'OBSERVED_PIT'), ('CBOE', 'ASSUMED_PIT'), ('CFE', 'OBSERVED_PIT')) group by all""",
    "vintage_summary": f"""select session_date, count(*) as n_rows, count(distinct series_id) as n_series, min({RANK})::int as weakest_rank,
      bool_and(coalesce(vintage_kind in ('OBSERVED_PIT', 'ASSUMED_PIT'), false)) as formal from observations group by all""",
    "vintage_lattice": f"""select series_id, session_date, case w when 2 then 'OBSERVED_PIT' when 1 then 'ASSUMED_PIT' when 0 then 'PROVIDER_BACKTESTED' end as weakest,
      case w when 2 then 'OBSERVED' when 1 then 'ASSUMED' when 0 then 'RESEARCH_ONLY' else 'UNKNOWN' end as evidence, coalesce(w >= 1, false) as formal
      from (select series_id, session_date, min({RANK}) as w from observations group by all)""",
    "methodology_signature": f"""with l as (select series_id, session_date, max(struct_pack(o := ingested_at, m := methodology_version)).m as m from observations
        where {IS} and methodology_version is not null group by all),
      p as (select {B} as symbol, session_date, {", ".join(f"max(case when {P} = '{x}' then m end) as {x}" for x in ("OPEN", "HIGH", "LOW", "CLOSE"))} from l group by all),
      f as (select symbol, session_date, {", ".join(f"last_value({x} ignore nulls) over w as {x}" for x in ("OPEN", "HIGH", "LOW", "CLOSE"))} from p
        window w as (partition by symbol order by session_date rows between unbounded preceding and current row))
      select symbol, session_date, 'CLOSE=' || "CLOSE" || '|HIGH=' || "HIGH" || '|LOW=' || "LOW" || '|OPEN=' || "OPEN" as signature from f""",
    "wide_pivot": f"""with {R} select {B} as symbol, session_date, {", ".join(f"max(case when {P} = '{x.upper()}' then value end) as {x}" for x in ("open", "high", "low", "close"))}
      from r where {IS} group by all""",
    "calendar_gap_fill": f"with {R}, {CAL} select series_id, session_date, idx, value from g",
    "latest_complete_session": f"""with o as (select distinct {B} as grp, series_id, session_date from observations where {IS} and {V} is not null),
      n as (select grp, count(distinct series_id) as n_needed from o group by grp), d as (select grp, session_date, count(*) as n from o group by all)
      select n.grp, n_needed, max(case when d.n = n_needed then session_date end) as last_complete from n join d using (grp) group by all""",
    "freshness_status": f"""select series_id, l as last_value_day, case when l is null then 'MISSING' when hit then 'FRESH' when row_ then 'INCOMPLETE'
        when l < date '{TARGET}' then 'STALE' else 'SESSION_GAP' end as status from (
      select series_id, max(case when {V} is not null then session_date end) as l, bool_or(session_date = date '{TARGET}' and {V} is not null) as hit,
        bool_or(session_date = date '{TARGET}') as row_ from observations group by series_id)""",
    "regime_runs": f"""with l as (select series_id, session_date, max(struct_pack(o := ingested_at, m := methodology_version, k := vintage_kind)) as x from observations group by all),
      f as (select series_id, session_date, x.k as vintage_kind, last_value(x.m ignore nulls) over (partition by series_id order by session_date rows between unbounded preceding and current row) as m from l),
      c as (select *, lag(m) over (partition by series_id order by session_date) as b from f where m is not null),
      n as (select *, sum(case when b is null or b <> m then 1 else 0 end) over (partition by series_id order by session_date rows between unbounded preceding and current row)::bigint as run from c)
      select series_id, run, min(m) as method, min(session_date) as first, max(session_date) as last, count(*) as n, min({RANK})::int as weakest_rank from n group by all""",
    "running_weakest_vintage": f"""with l as (select series_id, session_date, max(struct_pack(o := ingested_at, k := vintage_kind)).k as vintage_kind from observations group by all)
      select series_id, session_date, case min({RANK}) over (partition by series_id order by session_date rows between unbounded preceding and current row)
        when 2 then 'OBSERVED_PIT' when 1 then 'ASSUMED_PIT' when 0 then 'PROVIDER_BACKTESTED' end as weakest_so_far from l""",
    "duplicate_key_audit": """select sum(n)::bigint as n_rows, count(*) as n_keys, count(*) filter (n > 1) as n_repeated
      from (select series_id, session_date, ingested_at, count(*) as n from observations group by all)""",
    "set_ops_sessions": f"""with {R}, h as (select distinct session_date from r), w as (select session_date from exchange_sessions)
      select 'missing' as kind, count(*) as n from (select * from w except select * from h) union all
      select 'extra', count(*) from (select * from h except select * from w) union all select 'common', count(*) from (select * from w intersect select * from h)""",
    "content_digests": f"""with t as (select sha256(concat_ws(chr(1), '=' || series_id, '=' || session_date::varchar, coalesce('=' || {DIGITS}, '~'), {", ".join(f"coalesce('=' || {c}, '~')" for c in ("unit", "source", "source_symbol"))},
        coalesce('=' || strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f'), '~'), {", ".join(f"coalesce('=' || {c}, '~')" for c in ("methodology_version", "vintage_kind", "revision_id"))})) as h from observations),
      s as (select count(*) as n_rows, {", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint), 0)::varchar as l{i}" for i in range(4))} from t)
      select n_rows, sha256(l0 || '-' || l1 || '-' || l2 || '-' || l3) as digest from s""",
    "semantic_fingerprints": f"""select series_id, session_date, count(distinct concat_ws('|', coalesce(({V})::varchar, '~'), coalesce(methodology_version, '~'), coalesce(vintage_kind, '~'))) as n_meanings,
      count(distinct revision_id) as n_revisions from observations group by all""",
    "decision_times": "with c as (select session_date, row_number() over (order by session_date)::int as idx, observed_at, decision_at, lead(session_date) over (order by session_date) as n from exchange_sessions) select session_date, idx, observed_at, decision_at from c where n is not null",
    "settlement_rule": """with m as (select distinct year(session_date)::int as y, month(session_date)::int as m from exchange_sessions),
      d as (select y, m, make_date(y, m, 1) as a, (make_date(y, m, 1) + interval 1 month)::date as b from m),
      t as (select y, m, a + ((5 - dayofweek(a) + 7) % 7 + 14)::int as third_friday, b + ((5 - dayofweek(b) + 7) % 7 + 14)::int - 30 as rule_day from d)
      select y, m, third_friday, rule_day, (select max(session_date) from exchange_sessions s where s.session_date <= t.rule_day) as settlement from t""",
}
