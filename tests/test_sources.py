"""File dialects, sinks and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.sources import files, store
from tidemark.streaming import live


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_index_history_dialects(spark, tmp_path):
    full = put(tmp_path, "a.csv", " Date ,Open,High,Low,Close\n01/02/2025,1,2,0.5,1.5\n01/03/2025,1,,0.5,x\n01/02/2025,9,9,9,9\nbad,1,1,1,1\n")
    got = {(r.series_id, r.session_date.day): r.value for r in files.read_index_history(spark, full, "VIX").collect()}
    assert got == {("VIX_OPEN", 2): 9, ("VIX_HIGH", 2): 9, ("VIX_LOW", 2): 9, ("VIX_CLOSE", 2): 9, ("VIX_OPEN", 3): 1, ("VIX_LOW", 3): 0.5}
    one = put(tmp_path, "b.csv", "DATE,SKEW\n2025-01-02,120.5\n")
    assert [tuple(r) for r in files.read_index_history(spark, one, "skew").collect()] == [("SKEW_CLOSE", dt.date(2025, 1, 2), 120.5)]
    with pytest.raises(ValueError):
        files.read_index_history(spark, put(tmp_path, "c.csv", "DAY,X\n1,2\n"), "X")


def test_close_history_dialects(spark, tmp_path):
    a = put(tmp_path, "a.csv", "observation_date,SP500\n2025-01-02,5000.5\n2025-01-03,.\n")
    b = put(tmp_path, "b.csv", "DATE,VALUE\n2025-01-02,1\n2025-01-02,2\n")
    assert [r.value for r in files.read_close_history(spark, a).collect()] == [5000.5]
    assert [r.value for r in files.read_close_history(spark, b).collect()] == [2.0]


def test_contract_files(spark, tmp_path):
    days = [dt.date(2025, 3, 3) + dt.timedelta(days=i) for i in range(120)]
    sessions = spark.createDataFrame([(d,) for d in days if d.weekday() < 5 and d != dt.date(2025, 4, 18)], "session_date date")
    put(tmp_path, "VX_2025-04-16.csv", "Trade Date,Futures,Settle\n2025-03-05,F (Apr 2025),18.5\n2025-03-06,,19\n2025-03-07,x,0\n")
    put(tmp_path, "VX_2025-04-23.csv", "Trade Date,Futures,Settle\n2025-03-05,weekly,18.5\n")
    got = sorted((r.contract_id, r.settle, r.contract_month) for r in files.read_contract_files(spark, str(tmp_path), sessions).collect())
    assert got == [("F (Apr 2025)", 18.5, 4), ("VX202504", 19.0, 4)]


def test_daily_settlement(spark, tmp_path):
    good = put(tmp_path, "a.csv", 'Product,Symbol,Expiration Date,Price\nVX,VX/F5,2025-01-22,"1,018.5*"\nVX,VX01/F5,2025-01-08,17\nES,ES/F5,2025-01-22,1\nVX,VX/G5,2025-02-19,0\n')
    assert [tuple(r) for r in files.read_daily_settlement(spark, good).collect()] == [("F (Jan 2025)", dt.date(2025, 1, 22), 1018.5)]
    bad = put(tmp_path, "b.csv", "Product,Symbol,Expiration Date,Price\nVX,VX/F5,2025-02-19,17\n")
    with pytest.raises(Exception, match="disagree"):
        files.read_daily_settlement(spark, bad).collect()


def test_chart_json(spark, tmp_path):
    doc = {"chart": {"result": [{"timestamp": [1735828200, 1735914600], "indicators": {"quote": [{"open": [10.0, None], "close": [20.0, 21.0]}], "adjclose": [{"adjclose": [10.0, 20.0]}]}}]}}
    got = files.read_chart_json(spark, put(tmp_path, "a.json", json.dumps(doc)), "T").collect()
    assert [tuple(r) for r in got] == [(dt.date(2025, 1, 2), "T", 5.0)]


def test_stamped_rows_have_content_ids(spark):
    sessions = spark.createDataFrame([(dt.date(2025, 1, 2), dt.datetime(2025, 1, 2, 21, 15), dt.datetime(2025, 1, 3, 14, 20))], "session_date date, observed_at timestamp_ntz, decision_at timestamp_ntz")
    rows = spark.createDataFrame([("V", dt.date(2025, 1, 2), 1.0), ("V", dt.date(2025, 1, 2), 1.0), ("V", dt.date(2025, 1, 4), 1.0)], "series_id string, session_date date, value double")
    got = files.stamped(rows, sessions, "CBOE", "V", "2025-01-05 00:00:00", "m1").collect()
    assert len(got) == 2 and got[0].revision_id == got[1].revision_id and got[0].available_at == dt.datetime(2025, 1, 3, 14, 20)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    path = str(tmp_path / "t")
    assert store.write_if_changed(df, path) and not store.write_if_changed(df.orderBy("y"), path)
    assert store.write_if_changed(df.limit(1), path) and store.read_table(spark, path).count() == 1
    held = store.current_generation(spark, path)
    with pytest.raises(Exception):  # a write that fails leaves the table as it was
        store.write_table(df.select(F.raise_error(F.lit("no")).alias("x")), path)
    assert store.current_generation(spark, path) == held and store.read_table(spark, path).count() == 1
    store.write_table(df, path)
    assert store.read_table(spark, path).count() == 2 and spark.read.parquet(held).count() == 1  # whoever still reads the generation before can finish
    doc = str(tmp_path / "d.json")
    store.write_document({"b": float("nan"), "a": dt.date(2025, 1, 2)}, doc)
    assert json.loads(open(doc).read()) == {"a": "2025-01-02", "b": None}
    once = str(tmp_path / "once.json")
    assert store.write_once({"a": 1}, once) and not store.write_once({"a": 1}, once)
    with pytest.raises(ValueError):
        store.write_once({"a": 2}, once)


def test_manifest(spark, tmp_path):
    put(tmp_path, "a.csv", "x")
    put(tmp_path, "b.csv", "y")
    found = store.manifest(spark, str(tmp_path), "*.csv")
    want = spark.createDataFrame([("a.csv", store.digest_of(str(tmp_path / "a.csv"))), ("b.csv", "0"), ("c.csv", "0")], "name string, sha256 string")
    assert {tuple(r) for r in store.manifest_violations(found, want).collect()} == {("b.csv", "CHANGED"), ("c.csv", "MISSING")}


def test_streamed_phases_equal_the_batch(spark, tmp_path):
    raw = ["MIXED_TRANSITION", "TAIL_RICH_QUIET_CURVE", "TAIL_RICH_QUIET_CURVE", "TAIL_RICH_QUIET_CURVE", folds.ACUTE, "MIXED_TRANSITION", "MIXED_TRANSITION", "UNKNOWN"]
    rows = [(s, i, r, True, r == folds.ACUTE, 10.0) for s in ("a", "b") for i, r in enumerate(raw)]
    schema = "series_id string, idx bigint, raw_phase string, counts boolean, hard_acute boolean, shock double"
    for part in (rows[:3] + rows[8:12], rows[3:8] + rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.published_phases(stream).writeStream.format("memory").queryName("phases").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {s: [r.phase for r in spark.sql(f"select * from phases where series_id = '{s}' order by idx").collect()] for s in ("a", "b")}
    machine = folds.Hysteresis()
    want = [machine.push((r, True, r == folds.ACUTE, 10.0, i)) for i, r in enumerate(raw)]
    assert got == {"a": want, "b": want}


def test_stream_ingest_and_windows(spark, tmp_path):
    rows = [("a", dt.datetime(2025, 1, 1, 0, 10), 1.0), ("a", dt.datetime(2025, 1, 1, 0, 10), 1.0), ("b", dt.datetime(2025, 1, 1, 1, 10), 3.0)]
    spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        live.ingest(stream.withColumn("revision_id", F.col("k")), str(tmp_path / "out"), str(tmp_path / "cp"), ["k", "ts"], "ts")
    live.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k", "ts"], "ts").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    query = live.windowed_counts(stream, "ts", "k", "v").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.k, r.n, r.total) for r in spark.table("windows").collect()) == [("a", 2, 2.0), ("b", 1, 3.0)]
