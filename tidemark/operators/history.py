"""Full history of changing attributes from periodic deliveries (problem 3)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_columns


def _differs(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """For each row but the first: does any of the columns differ from the row before (null equals null)?"""
    n = table.num_rows
    out = np.zeros(max(n - 1, 0), dtype=bool)
    for name in columns:
        col = table.column(name).combine_chunks()
        before, after = col.slice(0, n - 1), col.slice(1)
        null = pc.xor(pc.is_null(before), pc.is_null(after))
        out |= pc.or_(pc.fill_null(pc.not_equal(before, after), False), null).to_numpy(zero_copy_only=False)
    return out


def merge_versions(batches: Iterable[pa.RecordBatch], keys: Sequence[str], payload: Sequence[str], at: str) -> Iterator[pa.RecordBatch]:
    """Versions from deliveries sorted by keys and time. One batch and one open version are held, no history.

    Yields keys, payload, valid_from, valid_to (null while open) and version_no (from 1 in each entity).
    """
    carry, carried_no = None, 1

    def emit(starts: pa.Table, valid_to: pa.Array, numbers: np.ndarray) -> list[pa.RecordBatch]:
        columns = [starts.column(c) for c in (*keys, *payload, at)] + [valid_to, pa.array(numbers, pa.int32())]
        return pa.table(columns, names=[*keys, *payload, "valid_from", "valid_to", "version_no"]).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if carry is not None:
            rows = pa.concat_tables([carry, rows]).combine_chunks()
        other = np.concatenate(([True], _differs(rows, keys)))  # a new entity begins
        start = other | np.concatenate(([True], _differs(rows, payload)))
        at_row = np.flatnonzero(start)
        fresh = other[at_row]
        fresh[0] = carry is None
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(at_row)), 0))
        numbers = np.arange(len(at_row)) - begun + 1
        if carry is not None:
            numbers[: np.flatnonzero(fresh)[0] if fresh.any() else None] += carried_no - 1
        starts = rows.take(pa.array(at_row))
        if len(at_row) > 1:
            closes = starts.column(at).combine_chunks().slice(1)
            ends = pc.if_else(pa.array(~fresh[1:]), closes, pa.scalar(None, closes.type))
            yield from emit(starts.slice(0, len(at_row) - 1), ends, numbers[:-1])
        carry, carried_no = starts.slice(len(at_row) - 1).combine_chunks(), int(numbers[-1])
    if carry is not None:
        yield from emit(carry, pa.nulls(1, carry.schema.field(at).type), np.array([carried_no]))


def sorted_runs(batches: Iterable[pa.RecordBatch], order: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Each batch without its exact copies, sorted by `order`: what a map task hands to the merge."""
    for batch in batches:
        run = pa.Table.from_batches([batch]).group_by(list(order)).aggregate([]).select(list(order))
        yield from run.sort_by([(c, "ascending") for c in order]).combine_chunks().to_batches()


def attribute_history(
    deliveries: DataFrame | Sequence[DataFrame],
    keys: Sequence[str] = ("series_id", "session_date"),
    payload: Sequence[str] = ("revision_id", "methodology_version"),
    at: str = "ingested_at",
) -> DataFrame:
    """Every version of every entity with the half-open period [valid_from, valid_to) in which it was current.

    Takes one table of deliveries or several snapshots. Map tasks cut what they read into key-sorted runs
    without exact copies, one exchange brings the runs of an entity together, and Spark's external sorter
    merges them k ways by entity and time; one streaming pass over the merged iterator closes a version
    where the payload changes, holding a batch and one open version. A repeat of the current payload begins nothing,
    a return to an earlier one does. Null payloads equal each other. Deliveries at the same moment are ordered by payload, nulls
    first; deliveries without `at` are dropped; null keys form an entity of their own. Empty in, empty out.
    """
    frames = [deliveries] if isinstance(deliveries, DataFrame) else list(deliveries)
    for f in frames:
        require_columns(f, *keys, *payload, at)
    names = [*keys, *payload, at]
    rows = reduce(DataFrame.unionByName, [f.select(*names) for f in frames]).where(F.col(at).isNotNull())
    ks, ps, order = tuple(keys), tuple(payload), (*keys, at, *payload)
    runs = rows.select(*order).mapInArrow(lambda it: sorted_runs(it, order), rows.select(*order).schema)
    merged = runs.repartition(*keys).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (*keys, *payload)], f"valid_from {kinds[at]}", f"valid_to {kinds[at]}", "version_no int"])
    return merged.mapInArrow(lambda it: merge_versions(it, ks, ps, at), schema)
