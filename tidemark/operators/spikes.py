"""Spikes, stuck and impossible readings, judged by each series' own behaviour (problem 5)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import real, require_columns, shared_dir


@dataclass(frozen=True)
class NormalBehaviour:
    """What counts as abnormal. Levels are judged on the log scale, signed series (differences) as they are."""

    neighbours: int = 7  # readings on each side of the rolling window
    reach_days: int = 60  # a neighbour further away tells nothing
    hampel: float = 3.0  # times 1.4826 MAD from the rolling median
    steps: float = 14.0  # times the series' usual step, from either side's median
    min_run: int = 7  # shorter runs of unchanged readings are never stuck
    run_factor: float = 3.0  # times the run length that nine tenths of the series' runs don't exceed
    level_bounds: tuple[float, float] = (0.0, 99_999.0)  # open interval of possible levels
    signed_bound: float = 999.0  # differences stay below this in size
    cell_days: int = 730  # length of the pieces that a series is cut into


CANDIDATE, SCALE, RUNS, MEMBER, IMPOSSIBLE = range(5)
_OUT = pa.schema(
    [("kind", pa.int32()), ("e", pa.string()), ("c", pa.int32()), ("k", pa.int32()), ("num", pa.float64()), ("n", pa.int64()), ("start", pa.int32()), ("edge", pa.int32())]
)
_DDL = "kind int, e string, c int, k int, num double, n bigint, start int, edge int"


def _median_of(columns: list[np.ndarray], present: list[np.ndarray]) -> np.ndarray:
    """Row-wise median of the columns that are present; NaN where none is."""
    if not len(columns[0]):
        return np.empty(0)
    grid = np.stack([np.where(p, c, np.inf) for c, p in zip(columns, present, strict=True)], axis=1)
    n = np.stack(present, axis=1).sum(axis=1)
    grid.sort(axis=1)
    row = np.arange(len(n))
    low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, grid.shape[1] - 1)
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (grid[row, low] + grid[row, high]) / 2, np.nan)


def _return_trip(outside, first, last, back, a, b) -> np.ndarray:
    """Height of an excursion from `outside` to `first` and from `last` back to `back`: the smaller of the two
    steps if they oppose each other and what lies between, and between the two ends, is less than half of it."""
    out, home = first - outside, last - back
    height = np.where(out * home > 0, np.minimum(np.abs(out), np.abs(home)), 0.0)
    return np.where((np.abs(outside - back) < height / 2) & (np.abs(a - b) < height / 2), height, 0.0)


def excursions(group: np.ndarray, day: np.ndarray, x: np.ndarray, rule: NormalBehaviour) -> tuple[np.ndarray, np.ndarray]:
    """(distance beyond both sides' medians, passes the Hampel filter) for each reading.

    The distance is 0 unless the reading lies on the same side of the median before it and the median
    after it, so a lasting move, where one side agrees, has none; without readings on both sides it is 0.
    One or two readings that leave and come back at once lie as far off as the smaller of the two steps, even
    where the series itself is on the move.
    """
    n, sides = len(x), {}
    for sign in (-1, 1):
        columns, present = [], []
        for j in range(1, rule.neighbours + 1):
            at = np.arange(n) + sign * j
            ok = (at >= 0) & (at < n)
            at = np.where(ok, at, 0)
            ok &= (group[at] == group) & (np.abs(day[at] - day) <= rule.reach_days)
            columns.append(x[at])
            present.append(ok)
        sides[sign] = columns, present
    before, after = _median_of(*sides[-1]), _median_of(*sides[1])
    columns, present = sides[-1][0] + sides[1][0], sides[-1][1] + sides[1][1]
    centre = _median_of(columns, present)
    mad = _median_of([np.abs(c - centre) for c in columns], present)
    with np.errstate(invalid="ignore"):
        same = (x - before) * (x - after) > 0
        distance = np.where(same, np.minimum(np.abs(x - before), np.abs(x - after)), 0.0)
        (b1, b2, *_), (a1, a2, *_) = (([np.where(p, c, np.nan) for c, p in zip(*sides[s], strict=True)]) for s in (-1, 1))
        for enter, leave, inner in (((b1, x), (x, a1), (x, x)), ((b1, x), (a1, a2), (x, a1)), ((b2, b1), (x, a1), (b1, x))):
            height = _return_trip(*enter, *leave, *inner)
            distance = np.fmax(distance, height)
        return distance, np.abs(x - centre) > rule.hampel * 1.4826 * mad


def _scan(rows: pa.Table, rule: NormalBehaviour) -> pa.Table:
    """Evidence of whole cells (e, c): candidates, scale, run lengths, members of long or cut runs, impossible readings."""
    name = rows.column("e").combine_chunks()
    c, k = rows.column("c").to_numpy(), rows.column("k").to_numpy()
    v, core = rows.column("v").to_numpy(), rows.column("core").to_numpy(zero_copy_only=False)
    signed = rows.column("signed").to_numpy(zero_copy_only=False)
    other = np.ones(len(v), dtype=bool)
    other[1:] = pc.not_equal(name.slice(1), name.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False) | (c[1:] != c[:-1])
    group = np.cumsum(other) - 1
    low, high = rule.level_bounds
    bad = np.where(signed, np.abs(v) >= rule.signed_bound, (v <= low) | (v >= high))
    parts: list[tuple] = []

    def put(kind: int, at: np.ndarray, num=None, n=None, start=None, edge=None) -> None:
        size = len(at)
        parts.append((np.full(size, kind), at, c[at], k[at], np.zeros(size) if num is None else num, *(np.zeros(size, dtype=np.int64) if z is None else z for z in (n, start, edge))))

    put(IMPOSSIBLE, np.flatnonzero(bad & core))
    good = np.flatnonzero(~bad)
    g, day = group[good], k[good]
    x = np.where(signed[good], v[good], np.log(np.where(signed[good], 1.0, v[good])))
    distance, odd = excursions(g, day, x, rule)
    hit = odd & (distance > 0) & core[good]
    put(CANDIDATE, good[hit], num=distance[hit])

    inner = good[core[good]]
    g, val = group[inner], v[inner]
    if len(inner):
        xi = np.where(signed[inner], val, np.log(np.where(signed[inner], 1.0, val)))
        step = np.abs(np.diff(xi))
        usable = np.flatnonzero((g[1:] == g[:-1]) & (step > 1e-12)) + 1
        if len(usable):
            order = np.lexsort((step[usable - 1], g[usable]))
            sg, ss = g[usable][order], step[usable - 1][order]
            first = np.flatnonzero(np.r_[True, sg[1:] != sg[:-1]])
            size = np.diff(np.r_[first, len(sg)])
            put(SCALE, inner[usable[order[first]]], num=(ss[first + (size - 1) // 2] + ss[first + size // 2]) / 2, n=size)
        begins = np.r_[True, (g[1:] != g[:-1]) | (val[1:] != val[:-1])]
        first = np.flatnonzero(begins)
        length = np.diff(np.r_[first, len(val)])
        rg = g[first]
        edge = np.r_[True, rg[1:] != rg[:-1]] * 1 + np.r_[rg[1:] != rg[:-1], True] * 2
        whole = np.flatnonzero(edge == 0)
        if len(whole):
            order = np.lexsort((length[whole], rg[whole]))
            og, ol = rg[whole][order], length[whole][order]
            new = np.flatnonzero(np.r_[True, (og[1:] != og[:-1]) | (ol[1:] != ol[:-1])])
            put(RUNS, inner[first[whole[order[new]]]], num=np.diff(np.r_[new, len(og)]).astype(float), n=ol[new])
        kept = (edge > 0) | (length >= rule.min_run)
        run = np.cumsum(begins) - 1
        member = np.flatnonzero(kept[run])
        of = run[member]
        put(MEMBER, inner[member], num=val[member], n=length[of], start=k[inner[first[of]]], edge=edge[of])
    kind, at, cc, kk, num, n, start, edge = (np.concatenate(z) for z in zip(*parts, strict=True))
    arrays = [pa.array(kind, pa.int32()), name.take(pa.array(at)).cast(pa.string())]
    return pa.table(arrays + [pa.array(z.astype(t.to_pandas_dtype()), t) for z, t in zip((cc, kk, num, n, start, edge), _OUT.types[2:], strict=True)], schema=_OUT)


def scan_cells(batches: Iterable[pa.RecordBatch], rule: NormalBehaviour) -> Iterator[pa.RecordBatch]:
    """Streams sorted cells; only the cell that a batch leaves unfinished is carried on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        e, c = batch.column("e"), batch.column("c")
        last = pc.and_(pc.equal(e, e[-1]), pc.equal(c, c[-1])).to_numpy(zero_copy_only=False)
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            done = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks()
            yield from _scan(done, rule).to_batches()
            held = [batch.slice(cut)]
    if held:
        yield from _scan(pa.Table.from_batches(held).combine_chunks(), rule).to_batches()


def first_readings(df: DataFrame, entity: str, day: str, value: str, loaded: str) -> DataFrame:
    """(e, k, v): of each point the reading delivered first; missing values are no readings. Ties: the smallest value."""
    rows = df.select(
        F.col(entity).alias("e"),
        F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).alias("k"),
        F.col(loaded).alias("o"),
        real(F.col(value).cast("double")).alias("v"),
    ).where("e is not null and k is not null and v is not null and o is not null")
    return rows.groupBy("e", "k").agg(F.min(F.struct("o", "v")).alias("x")).select("e", "k", F.col("x.v").alias("v"))


def implausible_readings(
    df: DataFrame,
    entity: str = "series_id",
    day: str = "session_date",
    value: str = "value",
    loaded: str = "ingested_at",
    signed_pattern: str = "_BASIS$",
    rule: NormalBehaviour = NormalBehaviour(),
) -> DataFrame:
    """(entity, day, spike, stuck, impossible) of each point whose first reading is implausible.

    A spike fails a Hampel filter (rolling median and MAD of the neighbouring readings) and lies more than
    `steps` usual steps of its series beyond the medians on both sides. Stuck readings repeat the one before
    inside a run much longer than nine tenths of the series' runs; the run's first reading is sound.
    Impossible readings break the physical bounds of their kind; entities matching `signed_pattern` are
    differences, all others positive levels.

    Series are cut into cells of `cell_days` with `reach_days` of halo, so a series that holds most of the
    rows is spread over tasks and every window is still complete. One streaming pass over the sorted cells
    leaves small evidence, written once to the shared folder: the usual step is the median of the cells'
    median steps, and runs cut by a cell's edge are joined again. Nulls, NaN, points without entity, day or
    load time are no readings; empty in, empty out; ties between copies don't matter.
    """
    require_columns(df, entity, day, value, loaded)
    size, reach = rule.cell_days, rule.reach_days
    readings = first_readings(df, entity, day, value, loaded)
    cells = (
        readings.withColumn("c", F.explode(F.expr(f"sequence(cast(floor((k - {reach}) / {size}) as int), cast(floor((k + {reach}) / {size}) as int))")))
        .select("e", "c", "k", "v", F.expr(f"floor(k / {size}) = c").alias("core"), F.col("e").rlike(signed_pattern).alias("signed"))
        .repartition("e", "c")
        .sortWithinPartitions("e", "c", "k")
    )
    shared_dir(df.sparkSession)
    evidence = cells.mapInArrow(lambda it: scan_cells(it, rule), _DDL).checkpoint()

    usual = evidence.where(F.col("kind") == SCALE).groupBy("e").agg(F.median("num").alias("usual"))
    spikes = evidence.where(F.col("kind") == CANDIDATE).join(usual, "e").where(F.col("num") >= rule.steps * F.col("usual")).select("e", "k", F.lit("spike").alias("why"))

    members = evidence.where(F.col("kind") == MEMBER)
    pieces = members.where("edge > 0").groupBy("e", "c", "start", "edge").agg(F.min("num").alias("v"), F.max("n").alias("n"))
    along = Window.partitionBy("e").orderBy("c", "start")
    goes_on = (F.col("edge").bitwiseAND(1) > 0) & (F.lag("edge").over(along).bitwiseAND(2) > 0) & (F.lag("v").over(along) == F.col("v"))
    joined = pieces.withColumn("fresh", F.when(goes_on, None).otherwise(F.col("start"))).withColumn("begin", F.last("fresh", ignorenulls=True).over(along))
    whole = joined.groupBy("e", "begin").agg(F.sum("n").alias("total"))
    counts = evidence.where(F.col("kind") == RUNS).select("e", "n", F.col("num").cast("bigint").alias("times")).unionByName(whole.select("e", F.col("total").alias("n"), F.lit(1).cast("bigint").alias("times")))
    by_length = counts.groupBy("e", "n").agg(F.sum("times").alias("times"))
    up, all_of = Window.partitionBy("e").orderBy("n").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("e")
    limits = (
        by_length.withColumns({"seen": F.sum("times").over(up), "runs": F.sum("times").over(all_of)})
        .where("seen >= floor(0.9 * runs)")
        .groupBy("e")
        .agg(F.greatest(F.lit(rule.min_run), F.ceil(rule.run_factor * F.min("n"))).alias("limit"))
    )
    inside = members.where("edge = 0").select("e", "k", F.col("start").alias("begin"), F.col("n").alias("total"))
    long_cut = whole.where(F.col("total") >= rule.min_run)
    across = members.where("edge > 0").join(joined.select("e", "c", "start", "begin"), ["e", "c", "start"]).join(long_cut, ["e", "begin"]).select("e", "k", "begin", "total")
    stuck = inside.unionByName(across).join(limits, "e").where("total >= limit and k > begin").select("e", "k", F.lit("stuck").alias("why"))

    impossible = evidence.where(F.col("kind") == IMPOSSIBLE).select("e", "k", F.lit("impossible").alias("why"))
    flags = [F.max(F.col("why") == w).alias(w) for w in ("spike", "stuck", "impossible")]
    found = spikes.unionByName(stuck).unionByName(impossible).groupBy("e", "k").agg(*flags)
    return found.select(F.col("e").alias(entity), F.date_from_unix_date("k").alias(day), "spike", "stuck", "impossible")
