"""Ordered operators over each entity's rows: changes, runs, fills, three-valued windows, percentiles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalars import log_ratio


def along(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows that end with the current one."""
    return w.rowsBetween(-(n - 1), 0)


def log_change(x: Column, k: int, w: WindowSpec) -> Column:
    return log_ratio(x, F.lag(x, k).over(w))


def level_change(x: Column, k: int, w: WindowSpec) -> Column:
    return x - F.lag(x, k).over(w)


def filled(x: Column, w: WindowSpec) -> Column:
    """The last value that isn't null, the current row's included."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def run_number(changed: Column, w: WindowSpec) -> Column:
    """Counts the rows where a new run begins."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def any_true(x: Column, frame: WindowSpec, n: int) -> Column:
    """Three-valued OR over a frame of n rows; rows that the frame lacks count as unknown."""
    yes, no = F.count(F.when(x, 1)).over(frame), F.count(F.when(~x, 1)).over(frame)
    return F.when(yes > 0, True).when(no == n, False)


def at_least_true(x: Column, frame: WindowSpec, n: int, k: int) -> Column:
    """Three-valued "k of n": true as soon as k are, false as soon as k cannot be reached, else unknown."""
    yes, no = F.count(F.when(x, 1)).over(frame), F.count(F.when(~x, 1)).over(frame)
    return F.when(yes >= k, True).when(n - no < k, False)


def clusters(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """(keys, cluster, first, last, length): runs of true rows. Null counts as not true."""
    w = along(keys, [order])
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    starts = F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False))
    marked = marked.withColumn("cluster", run_number(starts, w)).where("__f")
    return marked.groupBy(*keys, "cluster").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def _midranks(x: np.ndarray, sig: np.ndarray | None, start: int, window: int, minimum: int) -> np.ndarray:
    """Mid-rank of x[i] among the `window` rows before it, for i from start on; NaN is no reading, -1 no signature."""
    out = np.full(len(x) - start, np.nan)
    padded = np.concatenate([np.full(window, np.nan), x])
    grid = np.lib.stride_tricks.sliding_window_view(padded, window)[start : len(x)]
    marks = None
    if sig is not None:
        marks = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window, -2), sig]), window)[start : len(x)]
    for at in range(0, len(out), 1024):
        g, cur = grid[at : at + 1024], x[start + at : start + at + 1024, None]
        valid = ~np.isnan(g)
        if marks is not None:
            valid &= marks[at : at + 1024] == sig[start + at : start + at + 1024, None]
        n = valid.sum(axis=1)
        score = (valid & (g < cur)).sum(axis=1) + 0.5 * (valid & (g == cur)).sum(axis=1)
        ok = (n >= minimum) & ~np.isnan(cur[:, 0])
        if sig is not None:
            ok &= sig[start + at : start + at + 1024] >= 0
        out[at : at + 1024] = np.where(ok, score / np.maximum(n, 1), np.nan)
    return out


def midrank_percentiles(
    df: DataFrame, key: str, order: str, values: Sequence[str], signature: str | None = None, window: int = 756, minimum: int = 504, cell: int = 4096, position: str | None = None
) -> DataFrame:
    """(key, order, p_value...) with the share of the `window` rows before each row that lie below its value,
    ties counting half. The current row is not among them, rows without a value keep their place but aren't
    counted, and below `minimum` counted rows the result is null. With `signature` only rows of the same
    signature count, wherever they stand; a null signature gives null.

    Entities are cut into cells of `cell` rows, each with the `window` rows before it, so a long entity is
    spread over tasks and no row carries an array; a cell is one vectorised pass for all values at once. `position` names a column
    that numbers the rows of each entity without gaps (a session index); without it they are numbered by a window over the entity.
    """
    sig = F.xxhash64(signature).bitwiseAND(F.lit((1 << 62) - 1)) if signature else F.lit(0).cast("bigint")
    sig = F.when(F.col(signature).isNull(), F.lit(-1).cast("bigint")).otherwise(sig) if signature else sig
    place = F.col(position).cast("bigint") if position else F.row_number().over(along([key], [order])) - 1
    xs = [f"x{n}" for n in range(len(values))]
    rows = df.select(F.col(key).alias("e"), F.col(order).alias("o"), *[F.col(v).cast("double").alias(x) for v, x in zip(values, xs, strict=True)], sig.alias("sig"), place.alias("i"))
    cells = rows.withColumn("c", F.explode(F.expr(f"sequence(cast(i div {cell} as int), cast((i + {window}) div {cell} as int))")))
    cells = cells.repartition("e", "c").sortWithinPartitions("e", "c", "i")
    used, names = signature is not None, [key, order, *[f"p_{v}" for v in values]]

    def whole_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            e, c = batch.column("e"), batch.column("c")
            last = pc.and_(pc.fill_null(pc.equal(e, e[-1]), not e[-1].is_valid), pc.equal(c, c[-1])).to_numpy(zero_copy_only=False)
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            table = table.combine_chunks()
            columns = [table.column(x).to_numpy(zero_copy_only=False).astype(float) for x in xs]
            s, c, i = (table.column(x).to_numpy() for x in ("sig", "c", "i"))
            new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (c[1:] != c[:-1])])
            for a, b in zip(new, np.r_[new[1:], len(i)], strict=True):
                start = int(np.searchsorted(i[a:b], c[a] * cell))
                if a + start >= b:
                    continue
                ranked = [pa.array(_midranks(x[a:b], s[a:b] if used else None, start, window, minimum), from_pandas=True) for x in columns]
                part = table.slice(a + start, b - a - start)
                yield from pa.table([part.column("e"), part.column("o"), *ranked], names=names).to_batches()

    kinds = [df.schema[c].dataType.simpleString() for c in (key, order)]
    return cells.mapInArrow(run, ", ".join([f"`{key}` {kinds[0]}", f"`{order}` {kinds[1]}", *[f"`{n}` double" for n in names[2:]]]))


def midrank_percentile(
    df: DataFrame, key: str, order: str, value: str, signature: str | None = None, window: int = 756, minimum: int = 504, cell: int = 4096, position: str | None = None
) -> DataFrame:
    """(key, order, percentile): `midrank_percentiles` of one value."""
    return midrank_percentiles(df, key, order, [value], signature, window, minimum, cell, position).withColumnRenamed(f"p_{value}", "percentile")
