"""Event labels over future windows, spells, and causal statistics of the outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import along, run_number


def forward_labels(df: DataFrame, keys: Sequence[str], order: str, idx: str, hit: Column, observable: Column, horizon: int, needed: int = 1) -> DataFrame:
    """Adds label (0/1/null), label_status and first_hit (the index of the deciding row).

    The window is the next `horizon` rows, which must be the next sessions and all observable, else the label
    is CENSORED; it is 1 once `needed` of them hit.
    """
    ahead = along(keys, [idx]).rowsBetween(1, horizon)
    marked = df.withColumns({"__hit": F.coalesce(hit, F.lit(False)), "__ok": F.coalesce(observable, F.lit(False)) & hit.isNotNull()})
    seen, good = F.count("*").over(ahead), F.count(F.when(F.col("__ok"), 1)).over(ahead)
    whole = (seen == horizon) & (good == horizon) & (F.max(idx).over(ahead) == F.col(idx) + horizon)
    hits = F.sort_array(F.collect_list(F.when(F.col("__hit"), F.col(idx))).over(ahead))  # at most `horizon` indexes
    yes = F.size(hits) >= needed
    return marked.withColumns({
        "label": F.when(whole, F.when(yes, 1).otherwise(0)),
        "label_status": F.when(~whole, "CENSORED").when(yes, "OBSERVED_1").otherwise("OBSERVED_0"),
        "first_hit": F.when(whole & yes, F.get(hits, F.lit(needed - 1))),
    }).drop("__hit", "__ok")


def spell_age(df: DataFrame, keys: Sequence[str], idx: str, eligible: Column) -> DataFrame:
    """Adds spell_age: consecutive sessions of the current spell, from 1; null outside of one. A row that isn't
    eligible or a missing session ends a spell."""
    w = along(keys, [idx])
    marked = df.withColumn("__in", F.coalesce(eligible, F.lit(False)))
    joined = F.coalesce(F.lag("__in").over(w) & (F.lag(idx).over(w) + 1 == F.col(idx)), F.lit(False))
    marked = marked.withColumn("__spell", run_number(F.col("__in") & ~joined, w))
    age = F.row_number().over(Window.partitionBy(*keys, "__spell", "__in").orderBy(idx))
    return marked.withColumn("spell_age", F.when(F.col("__in"), age)).drop("__in", "__spell")


def outcome_sequence(ledger: DataFrame, key: str, ident: str, known: str, label: str, carry: Sequence[str] = (), cell: str = "month") -> DataFrame:
    """(k, t, seq, p, y, carry...): the known outcomes of each key in the order in which they became known, with
    their number and the positives so far. Numbered within time cells first, then shifted by the cells' totals,
    so that a key with a large share of the rows is no single task."""
    done = ledger.where(F.col(label).isNotNull() & F.col(known).isNotNull())
    done = done.select(F.col(key).alias("k"), F.col(known).alias("t"), F.col(ident).alias("id"), F.col(label).cast("bigint").alias("y"), *carry)
    done = done.withColumn("c", F.date_trunc(cell, "t"))
    inside = Window.partitionBy("k", "c").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    totals = done.groupBy("k", "c").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    shift = totals.select("k", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("p0"))
    numbered = done.withColumns({"n": F.count("*").over(inside), "s": F.sum("y").over(inside)}).join(shift, ["k", "c"])
    return numbered.select("k", "t", "id", (F.col("n") + F.col("n0")).alias("seq"), (F.col("s") + F.col("p0")).alias("p"), "y", *carry)


def known_by(asks: DataFrame, outcomes: DataFrame, cell: str = "month") -> DataFrame:
    """Adds n to the asks (k, t): how many outcomes of the key were known by then. One merged timeline per key
    and cell, no pairs."""
    line = outcomes.select("k", "t", F.col("seq").alias("n"), F.lit(False).alias("ask")).unionByName(asks.select("k", "t", F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("ask")))
    line = line.withColumn("c", F.date_trunc(cell, "t"))
    inside = Window.partitionBy("k", "c").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    start = line.groupBy("k", "c").agg(F.max("n").alias("m")).select("k", "c", F.coalesce(F.max("m").over(before), F.lit(0)).alias("n0"))
    here = line.withColumn("m", F.max("n").over(inside)).where("ask").select("k", "t", "c", "m").distinct()
    return here.join(start, ["k", "c"]).select("k", "t", F.coalesce("m", "n0").alias("n"))


def causal_base_rate(ledger: DataFrame, key: str, ident: str, at: str, known: str, label: str, last: int = 756, minimum: int = 252) -> DataFrame:
    """(key, at, n, positive, base_rate) per decision moment: of the last `last` outcomes that were known by then
    the smoothed rate (positive + 1) / (n + 2), null below `minimum`. Differences of running counts, looked up
    by number; nothing is joined by a range."""
    outcomes = outcome_sequence(ledger, key, ident, known, label)
    asks = ledger.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t")).distinct()
    counted = known_by(asks, outcomes)
    marks = outcomes.select("k", "seq", "p")
    upper = counted.join(marks.withColumnRenamed("p", "hi"), (counted.k == marks.k) & (counted.n == marks.seq), "left").select(counted.k, "t", "n", "hi")
    low = marks.select(F.col("k").alias("k2"), F.col("seq").alias("seq2"), F.col("p").alias("lo"))
    both = upper.join(low, (F.col("k") == F.col("k2")) & (F.col("n") - last == F.col("seq2")), "left")
    n = F.least("n", F.lit(last))
    p = F.coalesce("hi", F.lit(0)) - F.coalesce("lo", F.lit(0))
    return both.select(F.col("k").alias(key), F.col("t").alias(at), n.alias("n"), p.alias("positive"), F.when(n >= minimum, (p + 1) / (n + 2)).alias("base_rate"))


def episodes(df: DataFrame, key: str, idx: str, label: str, gap: int) -> DataFrame:
    """Per key: number of positive episodes; a new one begins after more than `gap` sessions without a positive."""
    w = along([key], [idx])
    pos = df.where(F.col(label) == 1).withColumn("__d", F.col(idx) - F.lag(idx).over(w))
    return pos.groupBy(key).agg(F.count(F.when(F.col("__d").isNull() | (F.col("__d") > gap), 1)).alias("n_episodes"))


def blocks(df: DataFrame, key: str, idx: str, value: str, size: int) -> DataFrame:
    """(key, block, total, n): sums over blocks of `size` sessions from the key's first, empty blocks included."""
    bounds = df.groupBy(key).agg(F.min(idx).alias("__lo"), F.max(idx).alias("__hi"))
    spine = bounds.select(key, "__lo", F.explode(F.expr(f"sequence(0, cast(floor((__hi - __lo) / {size}) as int))")).alias("block"))
    sums = df.join(bounds, key).groupBy(key, F.floor((F.col(idx) - F.col("__lo")) / size).cast("int").alias("block")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return spine.join(sums, [key, "block"], "left").select(key, "block", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def matched_clusters(events: DataFrame, signals: DataFrame, key: str, lead: int, lag: int, cell: int = 64) -> DataFrame:
    """Each event cluster with the nearest signal cluster that overlaps it within `lead` sessions before and `lag`
    after; the earliest of equally near ones; null signal for a miss. Clusters are (key, cluster, first, last).

    An interval join by cells: both sides are put into the cells of `cell` sessions they reach, met there by an
    equi-join, and counted once, in the first cell they share.
    """
    def spread(df: DataFrame, lo: Column, hi: Column, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias("k"), F.struct("cluster", "first", "last").alias(name), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi"))
        cells = F.expr(f"sequence(cast(floor({name}_lo / {cell}) as int), cast(floor({name}_hi / {cell}) as int))")
        return rows.withColumn("c", F.explode(cells))

    e = spread(events, F.col("first") - lead, F.col("last") + lag, "e")
    s = spread(signals, F.col("first"), F.col("last"), "s")
    met = e.join(s, ["k", "c"]).where("s_lo <= e_hi and s_hi >= e_lo").where(F.col("c") == F.floor(F.greatest("e_lo", "s_lo") / cell))
    near = F.struct(F.abs(F.col("s.first") - F.col("e.first")).alias("far"), F.col("s.first").alias("first"), F.col("s.cluster").alias("cluster"))
    best = met.groupBy("k", F.col("e.cluster").alias("cluster")).agg(F.min(near).alias("b"), F.count("*").alias("n_signals"))
    base = events.select(F.col(key).alias("k"), "cluster", "first", "last")
    return base.join(best, ["k", "cluster"], "left").select(
        F.col("k").alias(key), "cluster", "first", "last", F.col("b.cluster").alias("signal"), (F.col("b.first") - F.col("first")).alias("offset"), F.coalesce("n_signals", F.lit(0)).alias("n_signals")
    )
