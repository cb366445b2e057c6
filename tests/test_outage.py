"""A snapshot that brought no record still stands in the sequence of snapshots."""

import duckdb

from tidemark.plans.pipeline_general import ORACLE, QUERIES

COLUMNS = "snapshot_id, attempt_id, source_symbol, source_session, content_hash"
ROWS = "(1, 1, 'A', '2025-01-31', 'aa'), (1, 2, 'B', '2025-01-31', 'bb'), (2, 3, 'A', null, null), (2, 4, 'B', ' ', 'bb'), (3, 5, 'A', '2025-01-31', 'aa'), (3, 6, 'B', '2025-01-31', 'b2'), (null, 7, 'C', '2025-01-31', 'cc'), (4, 8, null, null, null)"


def test_a_snapshot_without_records_removes_and_the_next_adds(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"create table source_attempts as select snapshot_id::bigint as snapshot_id, attempt_id::bigint as attempt_id, source_symbol, source_session, content_hash from (values {ROWS}) t({COLUMNS})")
    con.execute(f"copy source_attempts to '{tmp_path}/source_attempts.parquet' (format parquet)")
    got = sorted((r.snapshot_id, r.source_symbol, r.source_session, r.change) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"select snapshot_id, source_symbol, source_session, change from ({ORACLE['p4_found']})").fetchall())
    assert got == [(s, k, "2025-01-31", c) for s, c in ((2, "removed"), (3, "added"), (4, "removed")) for k in "AB"]
