"""What changed between consecutive full snapshots (problem 4)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import require_columns

#: Rows that one hash bucket should hold; the number of buckets follows from the number of rows.
ROWS_PER_BUCKET = 400_000
#: Stands for a null row hash.
NO_HASH = 0


def plain_symbol(col: Column) -> Column:
    """Capitals without surrounding spaces; blank is null."""
    return F.nullif(F.upper(F.trim(col)), F.lit(""))


def plain_session(col: Column) -> Column:
    """`YYYY-MM-DD` for 20250131, 2025-01-31, 2025/01/31 and 2025.01.31; other texts only trimmed; blank is null."""
    text = F.trim(col)
    day = F.regexp_replace(text, r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})$", "$1-$2-$3")
    return F.nullif(day, F.lit(""))


def plain_hash(col: Column) -> Column:
    """Hex digits in small letters, without spaces or an algorithm's prefix; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), r"^sha-?256[:=]\s*", ""), F.lit(""))


def diff_bucket(snaps: np.ndarray, k1: np.ndarray, k2: np.ndarray, row: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """Differences between consecutive snapshots within one hash bucket, over compact arrays.

    Each key occurs once a snapshot. Returns (snapshot, k1, k2, change) with change 0 added, 1 removed,
    2 changed. `order` holds all snapshots present in the table, so a bucket that lacks one sees removals.
    """
    perm = np.lexsort((k2, k1))
    a, b = k1[perm], k2[perm]
    step = np.ones(len(perm), dtype=bool)
    step[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    dense = np.empty(len(perm), dtype=np.int64)
    dense[perm] = np.cumsum(step) - 1
    first = perm[step]
    by_snap = np.lexsort((dense, snaps))
    lo, hi = np.searchsorted(snaps[by_snap], order, "left"), np.searchsorted(snaps[by_snap], order, "right")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(1, len(order)):
        old, new = by_snap[lo[i - 1] : hi[i - 1]], by_snap[lo[i] : hi[i]]
        ko, kn = dense[old], dense[new]
        at = np.searchsorted(ko, kn)
        safe = np.minimum(at, max(len(ko) - 1, 0))
        both = (ko[safe] == kn) if len(ko) else np.zeros(len(kn), dtype=bool)
        back = np.minimum(np.searchsorted(kn, ko), max(len(kn) - 1, 0))
        kept = (kn[back] == ko) if len(kn) else np.zeros(len(ko), dtype=bool)
        moved = kn[both][row[new[both]] != row[old[safe[both]]]]
        for code, keys in ((0, kn[~both]), (1, ko[~kept]), (2, moved)):
            out.append((np.full(len(keys), order[i]), keys, np.full(len(keys), code)))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    snap, key, code = (np.concatenate(x) for x in zip(*out, strict=True))
    return snap, k1[first[key]], k2[first[key]], code


def snapshot_changes(
    attempts: DataFrame,
    snapshot: str = "snapshot_id",
    keys: Sequence[str] = ("source_symbol", "source_session"),
    content: str = "content_hash",
    latest: str = "attempt_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(snapshot, keys, change) for each record added, removed or changed against the snapshot before.

    Give normalised keys and contents. Of several rows of a key in a snapshot the one with the greatest
    `latest` holds. Rows with a null key or snapshot are no records, but a
    snapshot whose rows all lack a key still counts: all records before it are removed in it. A null content equals null and
    differs from any value. Snapshots may be numbers, dates or texts; they follow each other in their own order. The first
    snapshot has no changes; empty in, empty out.

    Rows shrink to (snapshot, two 64-bit key hashes, row hash); the latest of each key is found by an
    aggregate that combines before the shuffle; hash buckets of bounded size are sorted and compared in
    numpy. Full values are fetched only for keys that differ: the table is read once more for its keys, a semi-join with the
    differences comes first, and only what it leaves is aggregated. Buckets hold distinct keys, so no
    key, however often repeated, makes a bucket large; their number follows the number of rows.
    """
    require_columns(attempts, snapshot, *keys, content, latest)
    spark = attempts.sparkSession
    given = attempts.select(
        F.col(snapshot).alias("snap"), *[F.col(c).alias(f"key{i}") for i, c in enumerate(keys)], F.col(content).alias("content"), F.col(latest).alias("latest")
    ).where("snap is not null")
    named = given.where(" and ".join(f"key{i} is not null" for i in range(len(keys))))
    ks = [F.col(f"key{i}") for i in range(len(keys))]
    named = named.withColumns({"k1": F.xxhash64(*ks), "k2": F.xxhash64(F.lit("second"), *reversed(ks))})
    row = F.when(F.col("content").isNull(), F.lit(NO_HASH)).otherwise(F.xxhash64("content"))
    rank = F.coalesce(F.col("latest").cast("bigint"), F.lit(-(1 << 63)))  # a row without a number counts only where there is no other
    held = named.groupBy("snap", "k1", "k2").agg(F.max_by(row, rank).alias("row"))
    # one row per snapshot, also of those without a record; their order and the number of rows come from the same pass
    order = given.groupBy("snap").agg(F.count("*").alias("n")).sort("snap").collect()
    buckets = max(1, -(-sum(r.n for r in order) // rows_per_bucket))
    edges = np.arange(len(order), dtype=np.int64)
    kind = attempts.schema[snapshot].dataType
    numbers = spark.createDataFrame([(r.snap, i) for i, r in enumerate(order)], T.StructType([T.StructField("snap", kind), T.StructField("no", T.LongType())]))

    def compare(bucket: pa.Table) -> pa.Table:
        arrays = (bucket.column(c).to_numpy() for c in ("no", "k1", "k2", "row"))
        found = diff_bucket(*arrays, edges)
        return pa.table([pa.array(x.astype(np.int64)) for x in found], names=["no", "k1", "k2", "code"])

    compact = held.join(numbers, "snap").select(F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets)).alias("bucket"), "no", "k1", "k2", "row")
    found = compact.groupBy("bucket").applyInArrow(compare, "no bigint, k1 bigint, k2 bigint, code bigint")
    differing = named.select("k1", "k2", *ks).join(found.select("k1", "k2"), ["k1", "k2"], "left_semi")
    full = differing.groupBy("k1", "k2").agg(*[F.min(f"key{i}").alias(f"key{i}") for i in range(len(keys))])
    return found.join(full, ["k1", "k2"]).join(numbers, "no").select(
        F.col("snap").alias(snapshot), *[F.col(f"key{i}").alias(c) for i, c in enumerate(keys)],
        F.element_at(F.array(*map(F.lit, ("added", "removed", "changed"))), (F.col("code") + 1).cast("int")).alias("change"),
    )
