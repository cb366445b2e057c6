"""The general pipeline operators against brute force, and their defined results on awkward input."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.asof import attributes_as_of
from tidemark.operators.history import attribute_history, merge_versions
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.snapshot_diff import diff_bucket, plain_hash, plain_session, plain_symbol, snapshot_changes
from tidemark.operators.spikes import NormalBehaviour, excursions, implausible_readings

D0 = dt.date(2020, 1, 1)
OBS = "series_id string, session_date date, value double, ingested_at timestamp_ntz, available_at timestamp_ntz, revision_id string, methodology_version string, total_7 int, e string, k int"


def day(n):
    return D0 + dt.timedelta(days=n)


def at(n, h=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n, hours=h)


def obs(spark, rows):
    """rows: (series, day, value, loaded[, known, revision, method]); extra columns clash with inner names on purpose."""
    full = [(*r, *[None] * (7 - len(r)), 1, "x", 2) for r in rows]
    return spark.createDataFrame(full, OBS)


def test_rolling_totals_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s in ("A", "B"):
        for n in sorted(rng.sample(range(400), 120)):
            for copy in range(rng.choice([1, 1, 2])):
                rows.append((s, day(n), rng.choice([None, float("nan"), rng.randint(-50, 50) / 4]), at(n, copy)))
    got = {(r.series_id, r.as_of_day): r for r in rolling_totals(obs(spark, rows), bucket_days=50).collect()}
    last = {}
    for s, d, v, o, *_ in rows:
        if (s, d) not in last or last[s, d][0] < o:
            last[s, d] = (o, v)
    read = {k: v for k, (_, v) in last.items() if v is not None and v == v}
    want = 0
    for s in ("A", "B"):
        days = sorted(d for x, d in read if x == s)
        for n in range((days[-1] - days[0]).days + 1):
            d = days[0] + dt.timedelta(days=n)
            want += 1
            r = got[s, d]
            for p in (7, 30):
                inside = [v for (x, y), v in read.items() if x == s and 0 <= (d - y).days < p]
                assert r[f"n_{p}"] == len(inside)
                assert r[f"total_{p}"] == pytest.approx(sum(inside))
                assert (r[f"avg_{p}"] is None) == (not inside)
    assert want == len(got)


def test_rolling_totals_edges(spark):
    assert rolling_totals(obs(spark, [])).count() == 0
    rows = [(None, day(0), 1.0, at(0)), ("A", None, 1.0, at(0)), ("A", day(0), None, at(0)), ("A", day(3), 2.0, None), ("A", day(3), 5.0, None)]
    out = rolling_totals(obs(spark, rows)).collect()
    assert [(r.as_of_day, r.total_7, r.n_30) for r in out] == [(day(3), 5.0, 1)]


EVENTS = "prediction_id bigint, series_id string, prediction_date date, decision_at timestamp_ntz, value double, d int"


def test_as_of_matches_brute_force(spark):
    rng = random.Random(7)
    facts = [(rng.choice("AB"), day(rng.randint(0, 3)), rng.random(), at(rng.randint(0, 900)), rng.choice([None, at(rng.randint(0, 900))]), f"r{rng.randint(0, 30)}") for _ in range(200)]
    events = [(i, rng.choice(["A", "B", "C", None]), rng.choice([day(rng.randint(0, 4)), None]), rng.choice([at(rng.randint(-5, 1500)), None]), 1.0, 1) for i in range(150)]
    events += events[:10]
    got = {r.prediction_id: (r.revision_id, r.value) for r in attributes_as_of(spark.createDataFrame(events, EVENTS), obs(spark, facts)).collect()}
    assert len(got) == 150
    for i, s, d, t, *_ in events:
        known = [f for f in facts if s and d and t and f[0] == s and f[1] == d and f[4] and f[4] <= t]
        best = max(known, key=lambda f: (f[4], f[3], f[5], f[2]), default=None)
        assert got[i] == ((best[5], best[2]) if best else (None, None))


def test_as_of_boundaries_and_empty(spark):
    facts = [("A", day(0), 1.0, at(0), at(2), "r1"), ("A", day(0), 2.0, at(1), at(5), "r2")]
    events = [(1, "A", day(0), at(2), 0.0, 0), (2, "A", day(0), at(2) - dt.timedelta(microseconds=1), 0.0, 0), (3, "A", day(0), at(5), 0.0, 0), (4, "A", day(0), at(5000), 0.0, 0)]
    ev = spark.createDataFrame(events, EVENTS)
    got = {r.prediction_id: r.revision_id for r in attributes_as_of(ev, obs(spark, facts)).collect()}
    assert got == {1: "r1", 2: None, 3: "r2", 4: "r2"}
    assert attributes_as_of(ev, obs(spark, [])).where("revision_id is not null").count() == 0
    assert attributes_as_of(ev.limit(0), obs(spark, facts)).count() == 0


def brute_versions(rows):
    out, points = [], {}
    for r in rows:
        points.setdefault((r[0], r[1]), set()).add((r[3], r[5], r[6]))
    for key, seen in points.items():
        order = sorted(seen, key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        versions = []
        for t, rev, m in order:
            if not versions or versions[-1][1:3] != (rev, m):
                versions.append((t, rev, m))
        for i, (t, rev, m) in enumerate(versions):
            out.append((*key, rev, m, t, versions[i + 1][0] if i + 1 < len(versions) else None, i + 1))
    return sorted(out, key=repr)


def test_history_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["A", "B", None]), day(rng.randint(0, 5)), 1.0, at(rng.randint(0, 40)), None, rng.choice(["r1", "r2", None]), rng.choice(["m", None])) for _ in range(300)]
    got = sorted((tuple(r) for r in attribute_history(obs(spark, rows)).collect()), key=repr)
    assert got == brute_versions(rows)


def test_history_takes_snapshots_and_empty_tables(spark):
    a = [("A", day(0), 1.0, at(0), None, "r1", "m"), ("A", day(0), 1.0, at(0), None, "r1", "m")]
    b = [("A", day(0), 1.0, at(3), None, "r1", "m"), ("A", day(0), 1.0, at(5), None, "r2", "m"), ("A", day(0), 1.0, None, None, "r9", "m")]
    got = [(r.revision_id, r.valid_from, r.valid_to, r.version_no) for r in attribute_history([obs(spark, a), obs(spark, b)]).collect()]
    assert sorted(got) == [("r1", at(0), at(5), 1), ("r2", at(5), None, 2)]
    assert attribute_history(obs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["x", "y", None])), max_size=30), st.integers(1, 7))
def test_version_stream_does_not_depend_on_batches(pairs, size):
    pairs = sorted(pairs, key=lambda p: p[0])
    table = pa.table({"e": pa.array([p[0] for p in pairs], pa.string()), "p": pa.array([p[1] for p in pairs], pa.string()), "t": pa.array(range(len(pairs)), pa.int64())})
    parts = [b for i in range(0, table.num_rows, size) for b in table.slice(i, size).combine_chunks().to_batches()]
    run = lambda batches: [r for b in merge_versions(batches, ("e",), ("p",), "t") for r in b.to_pylist()]
    assert run(parts) == run(table.combine_chunks().to_batches())


def test_notations(spark):
    row = spark.createDataFrame([(" vix ", " 20250613", "SHA256:ABCDEF "), ("Vix", "2025-06-13", "abcdef"), ("  ", "", " ")], "s string, d string, h string")
    got = [tuple(r) for r in row.select(plain_symbol(F.col("s")), plain_session(F.col("d")), plain_hash(F.col("h"))).collect()]
    assert got == [("VIX", "2025-06-13", "abcdef")] * 2 + [(None, None, None)]


ATT = "snapshot_id bigint, source_symbol string, source_session string, content_hash string, attempt_id bigint, bucket int, k1 int"


def test_snapshot_changes_match_brute_force(spark):
    rng = random.Random(11)
    rows, n = [], 0
    for snap in (3, 4, 8):
        for _ in range(120):
            n += 1
            rows.append((snap, rng.choice(["A", "B", None]), rng.choice([f"s{i}" for i in range(30)] + [None]), rng.choice(["h1", "h2", None]), n, 0, 0))
    got = {(r.snapshot_id, r.source_symbol, r.source_session, r.change) for r in snapshot_changes(spark.createDataFrame(rows, ATT), rows_per_bucket=40).collect()}
    held = {}
    for snap, s, d, h, i, *_ in rows:
        if s and d:
            held.setdefault(snap, {})[s, d] = h
    want = set()
    for a, b in ((3, 4), (4, 8)):
        for key in held[a].keys() | held[b].keys():
            kind = "added" if key not in held[a] else "removed" if key not in held[b] else "changed" if held[a][key] != held[b][key] else None
            if kind:
                want.add((b, *key, kind))
    assert got == want


def test_snapshot_changes_edges(spark):
    empty = spark.createDataFrame([], ATT)
    assert snapshot_changes(empty).count() == 0
    one = spark.createDataFrame([(1, "A", "s", None, 1, 0, 0)], ATT)
    assert snapshot_changes(one).count() == 0
    same = one.unionByName(one.withColumn("snapshot_id", F.lit(2).cast("bigint")))
    assert snapshot_changes(same).count() == 0
    a = np.array
    snap, k1, k2, code = diff_bucket(a([1, 1, 3]), a([5, 5, 5]), a([1, 2, 1]), a([9, 9, 8]), a([1, 2, 3]))
    assert sorted(zip(snap.tolist(), k2.tolist(), code.tolist())) == [(2, 1, 1), (2, 2, 1), (3, 1, 0)]  # keys that share one hash stay apart


def walk(n, seed, start=50.0):
    rng = np.random.default_rng(seed)
    return np.round(start * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 3)


def test_excursions_ignore_lasting_moves():
    x = np.log(walk(60, 1))
    x[30:] += 1.0
    x[45] += 0.8
    distance, odd = excursions(np.zeros(60, int), np.arange(60), x, NormalBehaviour())
    assert distance[45] > 0.7 and odd[45]
    assert distance[30] < 0.2 and distance[29] < 0.2


def test_implausible_readings_find_planted_cases(spark):
    rows, want = [], set()
    for i, s in enumerate(("A_CLOSE", "B_HIGH", "C_BASIS")):
        v = walk(900, i) if s != "C_BASIS" else np.round(walk(900, i) - 50, 3)
        v = v.tolist()
        for n, x in ((100, 3.0), (300, 10.0), (301, 10.0)):
            v[n] = v[n] * x if s != "C_BASIS" else v[n] + 40
            want.add((s, day(n)))
        v[400] = -999.0
        want.add((s, day(400)))
        for n in range(720, 740):  # over the border of two cells
            v[n] = v[719]
            want.add((s, day(n)))
        v[500:] = [y * 2 if s == "A_CLOSE" else y for y in v[500:]]  # a lasting move
        v[600] = None
        v[601] = float("nan")
        for n, y in enumerate(v):
            rows.append((s, day(n), y, at(n, 1)))
            if n not in (600, 601):  # there a later delivery would be the first reading
                rows.append((s, day(n), 1e6, at(n, 2)))
    got = {(r.series_id, r.session_date) for r in implausible_readings(obs(spark, rows)).collect()}
    assert got == want


def test_implausible_readings_edges(spark):
    assert implausible_readings(obs(spark, [])).count() == 0
    rows = [(None, day(0), 1.0, at(0)), ("A", None, 1.0, at(0)), ("A", day(0), float("nan"), at(0)), ("A", day(1), 1.0, None), ("B", day(0), 0.0, at(0)), ("B", day(0), 0.0, at(0)), ("C", day(0), 7.0, at(0))]
    got = [(r.series_id, r.spike, r.stuck, r.impossible) for r in implausible_readings(obs(spark, rows)).collect()]
    assert got == [("B", False, False, True)]


def test_as_of_settles_nan_and_repeated_asks(spark):
    facts = [("A", day(0), float("nan"), at(0), at(2), "r1"), ("A", day(0), 2.0, at(1), at(5), "r2")]
    events = [(i, "A", day(0), at(3), 0.0, 0) for i in range(50)] + [(99, "A", day(0), at(6), 0.0, 0)]
    got = {r.prediction_id: (r.revision_id, r.value) for r in attributes_as_of(spark.createDataFrame(events, EVENTS), obs(spark, facts)).collect()}
    assert got == {i: ("r1", None) for i in range(50)} | {99: ("r2", 2.0)}


def test_as_of_grows_in_proportion_on_one_point(spark):
    """All changes and all events on one point within a day: twice the rows take about twice the time, not four times."""
    import time

    def took(n):
        step = F.expr(f"timestamp_ntz'2020-01-05 00:00:00' + make_dt_interval(0, 0, 0, id * {86400 / n})")
        facts = spark.range(n).select(
            F.lit("A").alias("series_id"), F.lit(D0).alias("session_date"), step.alias("available_at"), F.lit(at(9)).cast("timestamp_ntz").alias("ingested_at"),
            F.concat(F.lit("r"), "id").alias("revision_id"), F.col("id").cast("double").alias("value"),
        )
        events = spark.range(n).select(F.col("id").alias("prediction_id"), F.lit("A").alias("series_id"), F.lit(D0).alias("prediction_date"), step.alias("decision_at"))
        begun = time.perf_counter()
        out = attributes_as_of(events, facts)
        right = out.where("revision_id = concat('r', prediction_id)").count()
        assert right == n
        return time.perf_counter() - begun

    took(1000)
    small = took(40_000)
    assert took(80_000) < 2.5 * small + 0.5


def test_snapshots_may_be_dates_or_texts(spark):
    rows = [("2020-01-09", "A", "s1", "h", 1, 0, 0), ("2020-01-09", "A", "s2", "h", 2, 0, 0), ("2020-01-31", "A", "s1", "g", 3, 0, 0), ("2020-02-03", "A", "s1", "g", 4, 0, 0), ("2020-02-03", "B", "s1", "g", 5, 0, 0)]
    texts = spark.createDataFrame(rows, ATT.replace("snapshot_id bigint", "snapshot_id string"))
    want = {("2020-01-31", "A", "s1", "changed"), ("2020-01-31", "A", "s2", "removed"), ("2020-02-03", "B", "s1", "added")}
    assert {tuple(r) for r in snapshot_changes(texts).collect()} == want
    dates = snapshot_changes(texts.withColumn("snapshot_id", F.col("snapshot_id").cast("date")))
    assert {(str(a), b, c, d) for a, b, c, d in dates.collect()} == want


def test_values_are_fetched_only_for_keys_that_differ(spark):
    """In the plan the semi-join with the differences lies below the aggregate that gathers the keys' full values."""
    one = spark.createDataFrame([(1, "A", "s", None, 1, 0, 0), (2, "A", "s", "h", 2, 0, 0)], ATT)
    plan = snapshot_changes(one)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {kind: min(len(x) - len(x.lstrip(" :+-")) for x in plan if kind in x) for kind in ("LeftSemi", "Aggregate [k1")}
    assert depth["LeftSemi"] > depth["Aggregate [k1"]
