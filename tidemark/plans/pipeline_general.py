"""Queries pN_ of the general data-pipeline problems, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import attributes_as_of
from ..operators.history import attribute_history
from ..operators.rolling import rolling_totals
from ..operators.spikes import implausible_readings
from ..operators.snapshot_diff import plain_hash, plain_session, plain_symbol, snapshot_changes
from ..session import epoch_seconds, iso, table


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_totals(table(spark, sf_dir, "observations"))
    shown = []
    for p in (7, 30):  # sums of doubles depend on their order in the last digits, so both sides divide the rounded total
        total = F.round(f"total_{p}", 6)
        shown += [total.alias(f"total_{p}"), F.when(F.col(f"n_{p}") > 0, total / F.col(f"n_{p}")).alias(f"avg_{p}"), f"n_{p}"]
    return out.select("series_id", "as_of_day", *shown)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_totals(table(spark, sf_dir, "observations"))
    return out.where("n_7 = 0 and n_30 > 0").select("series_id", iso(F.col("as_of_day")).alias("as_of_day"))


def _as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes_as_of(table(spark, sf_dir, "target_ledger"), table(spark, sf_dir, "observations"))


def p2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_known(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_known(spark, sf_dir).where("known_from is not null").select("prediction_id", "revision_id")


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_history(table(spark, sf_dir, "observations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    several = attribute_history(table(spark, sf_dir, "observations")).where("version_no > 1 or valid_to is not null")
    return several.select(
        "series_id", iso(F.col("session_date")).alias("session_date"), "revision_id", "methodology_version", epoch_seconds(F.col("valid_from")).alias("valid_from")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "source_attempts").select(
        "snapshot_id",
        "attempt_id",
        plain_symbol(F.col("source_symbol")).alias("source_symbol"),
        plain_session(F.col("source_session")).alias("source_session"),
        plain_hash(F.col("content_hash")).alias("content_hash"),
    )
    return snapshot_changes(attempts)


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(table(spark, sf_dir, "observations"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(table(spark, sf_dir, "observations")).select("series_id", iso(F.col("session_date")).alias("session_date"))


QUERIES = {f.__name__: f for f in (p1_totals, p1_found, p2_as_of, p2_found, p3_history, p3_found, p4_found, p5_flags, p5_found)}

_P1 = """
with last as (
  select series_id, session_date, max(struct_pack(o := ingested_at, v := case when isnan(value) then null else value end)) as x
  from observations where series_id is not null and session_date is not null group by all),
r as (select series_id, session_date, x.v as v from last where x.v is not null),
c as (select series_id, unnest(generate_series(min(session_date), max(session_date), interval 1 day))::date as d from r group by series_id),
t as (
  select c.series_id, c.d as as_of_day, r.v from c left join r on r.series_id = c.series_id and r.session_date = c.d),
w as (
  select series_id, as_of_day,
    coalesce(sum(v) over a, 0) as s7, count(v) over a as n_7, coalesce(sum(v) over b, 0) as s30, count(v) over b as n_30
  from t window a as (partition by series_id order by as_of_day range between interval 6 days preceding and current row),
    b as (partition by series_id order by as_of_day range between interval 29 days preceding and current row))
"""
_P2 = """
with e as (select distinct prediction_id, series_id, prediction_date, decision_at from target_ledger),
k as (
  select e.*, o.available_at, o.revision_id, case when not isnan(o.value) then o.value end as value,
    row_number() over (partition by e.prediction_id order by o.available_at desc nulls last, o.ingested_at desc, o.revision_id desc) as rn
  from e left join observations o
    on o.series_id = e.series_id and o.session_date = e.prediction_date and o.available_at <= e.decision_at)
"""
_P3 = """
with d as (select distinct series_id, session_date, ingested_at, revision_id, methodology_version from observations),
l as (
  select *, row_number() over w as rn, lag(revision_id) over w as r0, lag(methodology_version) over w as m0
  from d window w as (partition by series_id, session_date order by ingested_at, revision_id nulls first, methodology_version nulls first)),
v as (select * from l where rn = 1 or revision_id is distinct from r0 or methodology_version is distinct from m0),
h as (
  select series_id, session_date, revision_id, methodology_version, ingested_at as valid_from,
    lead(ingested_at) over x as valid_to, row_number() over x as version_no
  from v window x as (partition by series_id, session_date order by ingested_at, revision_id nulls first, methodology_version nulls first))
"""
ORACLE = {
    "p1_totals": _P1
    + """select series_id, as_of_day, round(s7, 6) as total_7, round(s30, 6) as total_30,
    case when n_7 > 0 then round(s7, 6) / n_7 end as avg_7, case when n_30 > 0 then round(s30, 6) / n_30 end as avg_30,
    n_7, n_30 from w""",
    "p1_found": _P1 + "select series_id, strftime(as_of_day, '%Y-%m-%d') as as_of_day from w where n_7 = 0 and n_30 > 0",
    "p2_as_of": _P2
    + """select prediction_id, series_id, prediction_date, decision_at, available_at as known_from, revision_id, value
    from k where rn = 1""",
    "p2_found": _P2 + "select prediction_id, revision_id from k where rn = 1 and available_at is not null",
    "p3_history": _P3
    + """select series_id, session_date, revision_id, methodology_version, valid_from, valid_to, version_no::int as version_no from h""",
    "p3_found": _P3
    + """select series_id, strftime(session_date, '%Y-%m-%d') as session_date, revision_id, methodology_version,
    epoch(date_trunc('second', valid_from))::bigint as valid_from from h where version_no > 1 or valid_to is not null""",
    "p4_found": r"""
with n as (
  select snapshot_id, attempt_id, nullif(upper(trim(source_symbol)), '') as source_symbol,
    nullif(regexp_replace(trim(source_session), '^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})$', '\1-\2-\3'), '') as source_session,
    nullif(regexp_replace(lower(trim(content_hash)), '^sha-?256[:=]\s*', ''), '') as content_hash from source_attempts),
h as (
  select * from n where source_symbol is not null and source_session is not null and snapshot_id is not null
  qualify row_number() over (partition by snapshot_id, source_symbol, source_session order by attempt_id desc) = 1),
s as (select snapshot_id, lag(snapshot_id) over (order by snapshot_id) as before from (select distinct snapshot_id from n)),
x as (select s.snapshot_id, h.* exclude (snapshot_id) from s join h on h.snapshot_id = s.snapshot_id where s.before is not null),
y as (select s.snapshot_id, h.* exclude (snapshot_id) from s join h on h.snapshot_id = s.before)
select coalesce(x.snapshot_id, y.snapshot_id) as snapshot_id, coalesce(x.source_symbol, y.source_symbol) as source_symbol,
  coalesce(x.source_session, y.source_session) as source_session,
  case when y.snapshot_id is null then 'added' when x.snapshot_id is null then 'removed' else 'changed' end as change
from x full join y on x.snapshot_id = y.snapshot_id and x.source_symbol = y.source_symbol and x.source_session = y.source_session
where x.snapshot_id is null or y.snapshot_id is null or x.content_hash is distinct from y.content_hash""",
}
