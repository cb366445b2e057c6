"""Recursions along each entity's rows. They stream over sorted partitions and carry only their state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame


class Smoothed:
    """Moving average with memory: the plain mean of the first n values, then step + weight * (new - step).
    A missing value ends the stretch; the next one starts anew."""

    def __init__(self, n: int, weight: float) -> None:
        self.n, self.weight = n, weight
        self.reset()

    def reset(self) -> None:
        self.seed: list[float] = []
        self.level: float | None = None

    def push(self, x: float | None) -> float | None:
        if x is None:
            self.reset()
            return None
        if self.level is not None:
            self.level = self.weight * x + (1 - self.weight) * self.level
        else:
            self.seed.append(x)
            if len(self.seed) == self.n:
                self.level = sum(self.seed) / self.n
        return self.level


def ema(n: int) -> Smoothed:
    return Smoothed(n, 2 / (n + 1))


class Wilder:
    """Wilder's average: the mean of the first n values, then (previous * (n - 1) + new) / n."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.reset()

    def reset(self) -> None:
        self.seed: list[float] = []
        self.level: float | None = None

    def push(self, x: float | None) -> float | None:
        if x is None:
            self.reset()
            return None
        if self.level is not None:
            self.level = (self.level * (self.n - 1) + x) / self.n
        else:
            self.seed.append(x)
            if len(self.seed) == self.n:
                self.level = sum(self.seed) / self.n
        return self.level


class Rsi:
    """Relative strength from Wilder averages of gains and losses; 100 without losses, 50 without either."""

    def __init__(self, n: int) -> None:
        self.up, self.down, self.last = Wilder(n), Wilder(n), None

    def push(self, x: float | None) -> float | None:
        step = None if x is None or self.last is None else x - self.last
        self.last = x
        gain = self.up.push(None if step is None else max(step, 0.0))
        loss = self.down.push(None if step is None else max(-step, 0.0))
        if gain is None:
            return None
        if loss == 0:
            return 50.0 if gain == 0 else 100.0
        return 100 - 100 / (1 + gain / loss)


class Macd:
    """(line, signal): fast minus slow average, and the line's own average."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9) -> None:
        self.fast, self.slow, self.signal = ema(fast), ema(slow), ema(signal)

    def push(self, x: float | None) -> tuple[float | None, float | None]:
        a, b = self.fast.push(x), self.slow.push(x)
        line = None if a is None or b is None else a - b
        return line, self.signal.push(line)


class EwmaVariance:
    """Decaying variance of returns. Seeded by the sample variance of the first `seed` returns in a row; a gap
    keeps the state but publishes nothing for the gap and for the row after it."""

    def __init__(self, decay: float = 0.94, seed: int = 252) -> None:
        self.decay, self.n = decay, seed
        self.seed: list[float] = []
        self.level: float | None = None
        self.last: float | None = None

    def push(self, x: float | None) -> float | None:
        """x is the log price; its step from the row before is the return."""
        step = None if x is None or self.last is None else x - self.last
        self.last = x
        if self.level is None:
            if step is None:
                self.seed = []
                return None
            self.seed.append(step)
            if len(self.seed) < self.n:
                return None
            mean = sum(self.seed) / self.n
            self.level = sum((r - mean) ** 2 for r in self.seed) / (self.n - 1)
            return self.level
        if step is None:
            return None
        self.level = self.decay * self.level + (1 - self.decay) * step * step
        return self.level


# The names of the phases that the transition rules speak of.
ACUTE = "ACUTE_FRONT_STRESS"
SLOW_MOVES = {
    ("MIXED_TRANSITION", "TAIL_RICH_QUIET_CURVE"),
    ("MIXED_TRANSITION", "CARRY_SUPPORTIVE_LOW_STRESS"),
    ("TAIL_RICH_QUIET_CURVE", "CARRY_SUPPORTIVE_LOW_STRESS"),
}


class Hysteresis:
    """Published phase from the raw one. Leaving the acute phase takes `release` rows in a row that are known
    to be calm; the slow moves towards risk take `confirm` rows with the same target; an unknown row publishes
    itself and clears all counters; a missing session clears what waits for confirmation."""

    def __init__(self, release: int = 2, confirm: int = 3, calm_below: float = 75.0) -> None:
        self.release, self.confirm, self.calm_below = release, confirm, calm_below
        self.phase: str | None = None
        self.idx: int | None = None
        self.calm = self.seen = 0
        self.target: str | None = None

    def push(self, row: tuple) -> str | None:
        """row: raw phase, whether it counts (status OK), hard acute or None, shock score or None, session index."""
        raw, counts, acute, shock, idx = row
        waiting = (self.target, self.seen) if self.idx is None or idx == self.idx + 1 else (None, 0)
        self.idx, self.target, self.seen = idx, None, 0
        if not counts or raw is None or raw == "UNKNOWN":
            self.phase, self.calm = raw, 0
        elif self.phase == ACUTE:
            quiet = raw != ACUTE and acute is False and shock is not None and shock < self.calm_below
            self.calm = self.calm + 1 if quiet else 0
            if self.calm >= self.release:
                self.phase, self.calm = raw, 0
        elif (self.phase, raw) in SLOW_MOVES:
            seen = waiting[1] + 1 if waiting[0] == raw else 1
            if seen >= self.confirm:
                self.phase = raw
            else:
                self.target, self.seen = raw, seen
        else:
            self.phase = raw
        return self.phase


def stream_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: Sequence[tuple[str, str]], state: Callable[[], Callable[[tuple], tuple]]
) -> DataFrame:
    """(keys, order, outputs): runs a recursion along each entity. `state()` gives a fresh step function that maps
    the inputs of a row to its outputs; entities are sorted within their partition and never collected."""
    names = [*keys, *order, *inputs]
    rows = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, *order)], *[f"`{c}` {t}" for c, t in outputs]])
    n_keys, first = len(keys), len(keys) + len(order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            entity = list(zip(*columns[:n_keys], strict=True))
            results = []
            for key, row in zip(entity, zip(*columns[first:], strict=True), strict=True):
                if key != current:
                    current, step = key, state()
                results.append(step(row))
            kinds = {"double": pa.float64(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
            made = [pa.array([r[i] for r in results], kinds[t]) for i, (_, t) in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], *made], names=[*keys, *order, *[c for c, _ in outputs]])

    return rows.mapInArrow(run, schema)


def volatility(variance: float | None, year: int = 252) -> float | None:
    return None if variance is None else 100 * sqrt(variance * year)
