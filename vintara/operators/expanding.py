"""Statistics of samples that grow with time, read from prefixes.

A sample is a cell; an event puts a value into a cell from a time on (weight 1) or takes it out again (weight -1).
Times are the tested editions, a calendar. What a cell holds at a time is the sum of its events up to then, so an event is one row
whatever the number of times that can see it: values are counted by bucket, the counts of a bucket are added up
over the times, and those of the buckets before over the buckets. A quantile then reads the one bucket that holds
its rank, a score the one that holds its outcome.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.operators.quantiles import BUCKETS, in_value_buckets

#: Values that a bucket of a cell holds at least, on average.
PER_BUCKET = 64
#: Times whose running sums one pass over the buckets carries.
AT_ONCE = 24


def in_buckets(events: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Adds ``_bucket`` to events (cell, x, t, w): common value edges, taken together for cells of few values."""
    sizes = events.groupBy("cell").agg(F.greatest(F.lit(1), F.least(F.lit(2 * BUCKETS), F.ceil(F.lit(2 * BUCKETS * PER_BUCKET) / F.greatest(F.sum(F.abs("w")), F.lit(1))))).cast("int").alias("_width"))
    return in_value_buckets(events, "x", like).join(sizes, "cell").withColumn("_bucket", F.floor(F.col("_bucket") / F.col("_width")).cast("int")).drop("_width")


def _by_time(times: Sequence[int], value: str) -> Column:
    """Sums of ``value`` over the events up to every time, as one array; written as one text, as the times are many."""
    return F.expr(f"array({', '.join(f'sum({_held(t, value)})' for t in times)})")


def _held(t: int, value: str) -> str:
    return f"CASE WHEN t <= {t} THEN {value} ELSE 0 END"


def _exploded(rows: DataFrame, times: Sequence[int], keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row per time from arrays over the times."""
    zipped = F.arrays_zip(F.expr(f"array({', '.join(map(str, times))})").alias("v"), *[F.col(a) for a in arrays])
    return rows.select(*keys, F.explode(zipped).alias("_z")).select(*keys, "_z.*")


def totals(events: DataFrame, times: Sequence[int], sums: Mapping[str, str]) -> DataFrame:
    """(cell, v): sums over what the cell holds at time v."""
    rows = events.groupBy("cell").agg(*[_by_time(times, c).alias(n) for n, c in sums.items()])
    return _exploded(rows, times, ["cell"], list(sums))


def quantiles(placed: DataFrame, times: Sequence[int], targets: Mapping[str, float]) -> DataFrame:
    """(cell, v): interpolated quantiles of what the cell holds at time v; an empty cell has no row."""
    counted = placed.groupBy("cell", "_bucket").agg(_by_time(times, "w").alias("_in"))
    order = Window.partitionBy("cell", "v").orderBy("_bucket")
    grid = _exploded(counted, times, ["cell", "_bucket"], ["_in"]).where("_in > 0").withColumns({
        "_upto": F.sum("_in").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.sum("_in").over(Window.partitionBy("cell", "v"))})
    names = list(targets)
    ranks = F.array(*[
        F.struct(F.lit(2 * i + up).alias("slot"), (side(at := (F.col("_n") - 1) * F.lit(float(targets[n]))) + 1).alias("rank"), (at - F.floor(at)).alias("part"))
        for i, n in enumerate(names) for up, side in enumerate((F.floor, F.ceil))])
    held = F.filter(ranks, lambda r: (r["rank"] > F.col("_upto") - F.col("_in")) & (r["rank"] <= F.col("_upto")))
    asked = grid.withColumn("r", F.explode(held)).select(
        "cell", "v", "_bucket", "r.slot", "r.part", (F.col("r.rank") - F.col("_upto") + F.col("_in")).alias("need"))
    inside = asked.join(placed.select("cell", "_bucket", "x", "t", "w"), ["cell", "_bucket"]).where("t <= v")
    kept = inside.groupBy("cell", "v", "slot", "part", "need", "x").agg(F.sum("w").alias("_c")).where("_c > 0")
    run = F.sum("_c").over(Window.partitionBy("cell", "v", "slot").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = kept.withColumn("_run", run).where("_run >= need").groupBy("cell", "v").agg(*[
        side.alias(f"_{n}_{i}") for k, n in enumerate(names) for i, side in enumerate((
            F.min(F.when(F.col("slot") == 2 * k, F.col("x"))), F.min(F.when(F.col("slot") == 2 * k + 1, F.col("x"))), F.max(F.when(F.col("slot") == 2 * k, F.col("part")))))])
    return found.select("cell", "v", *[(F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * F.col(f"_{n}_2")).alias(n) for n in names])


def crps(placed: DataFrame, times: Sequence[int]) -> DataFrame:
    """H2: CRPS of the sample that a cell holds at time v, for outcomes y: (cell, v, y, crps), E|X - y| - E|X - X'| / 2.

    The outcomes are events too, of weight 0 at their time, each once. Both expectations are sums of the counts
    and of the values before a place; within a bucket these run along its values, once for every time.
    """
    parts = [times[k : k + AT_ONCE] for k in range(0, len(times), AT_ONCE)]
    scores = [_crps(placed, part) for part in parts]
    whole = scores[0]
    for more in scores[1:]:
        whole = whole.unionByName(more)
    return whole


def _crps(placed: DataFrame, times: Sequence[int]) -> DataFrame:
    known = F.col("w") != 0
    frame = "OVER (PARTITION BY cell, _bucket ORDER BY x, t, w ROWS UNBOUNDED PRECEDING)"
    run = placed.selectExpr("cell", "_bucket", "x", "t", "w", *[f"sum({_held(t, 'w')}) {frame} AS _r{t}" for t in times], *[f"sum({_held(t, 'w * x')}) {frame} AS _p{t}" for t in times])
    # The summed distances of the pairs inside a bucket, by time: a value times the count before it, less the sum before it.
    pairs = f"array({', '.join(f'sum({_held(t, f"w * (x * _r{t} - _p{t})")})' for t in times)})"
    buckets = run.where(known).groupBy("cell", "_bucket").agg(_by_time(times, "w").alias("_n"), _by_time(times, "w * x").alias("_s"), F.expr(pairs).alias("_d"))
    empty = placed.where(~known).select("cell", "_bucket").distinct().select(
        "cell", "_bucket", *[F.array_repeat(F.lit(0).cast(k), len(times)).alias(c) for c, k in (("_n", "bigint"), ("_s", "double"), ("_d", "double"))])
    each = _exploded(buckets.unionByName(empty), times, ["cell", "_bucket"], ["_n", "_s", "_d"]).groupBy("cell", "v", "_bucket").agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_d")])
    order = Window.partitionBy("cell", "v").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("cell", "v")
    each = each.withColumns({"_n0": F.sum("_n").over(order) - F.col("_n"), "_s0": F.sum("_s").over(order) - F.col("_s")})
    each = each.withColumns({
        "_all": F.sum("_n").over(every), "_sum": F.sum("_s").over(every),
        "_spread": F.sum(F.col("_n0") * F.col("_s") - F.col("_s0") * F.col("_n") + F.col("_d")).over(every)})
    at = lambda c: f"CASE t {' '.join(f'WHEN {t} THEN {c}{t}' for t in times)} END AS {c}"
    outcomes = run.where(~known & F.col("t").isin(list(times))).selectExpr("cell", "_bucket", "t AS v", "x AS y", at("_r"), at("_p"))
    k, below, n, y = F.col("_n0") + F.col("_r"), F.col("_s0") + F.col("_p"), F.col("_all"), F.col("y")
    distance = (y * k - below) + (F.col("_sum") - below) - y * (n - k)
    return outcomes.join(each, ["cell", "v", "_bucket"]).where("_all > 0").select(
        "cell", "v", "y", (distance / n - F.col("_spread") / (n * n)).alias("crps"))
