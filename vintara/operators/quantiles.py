"""Exact order statistics of groups of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one task, and a
window over a group sorts it whole in one task. A handful of groups (horizons, classes)
may hold all the rows, so neither survives scale; nor does one sketch a group, where groups
are many. Here common edges of a measure cut it into buckets; rows are counted by group and
bucket, combined before the shuffle, and the counts tell which bucket holds a wanted rank.
Only the values of those buckets are read, unless the rank is at a bucket's end.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.session import materialize

SKETCH_ACCURACY = 10_000
SELECTION_BUCKETS, SELECTION_ACCURACY = 256, 2_000  # of one measure in grouped_quantiles, besides those of single values
BUCKETS = 1024  # of values, besides those of single values


def not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups never contain a NULL key: such rows belong to no group."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def _attach(df: DataFrame, groups: DataFrame, keys: Sequence[str], bounded_groups: bool) -> DataFrame:
    """Join per-group values back; broadcast only when the keys come from fixed domains."""
    return df.join(F.broadcast(groups) if bounded_groups else groups, list(keys))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column | str],
    targets: Mapping[str, tuple[str, float]],
    bounded_groups: bool = False,
    accuracy: int = SELECTION_ACCURACY,
    spread: tuple[str, Column, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per group: the linearly interpolated quantiles named in ``targets``.

    ``targets`` maps an output column to (measure, probability). ``bounded_groups`` states
    that the keys take their values in fixed domains (horizons, seasons, classes, listed
    groups), so the table of groups may be broadcast; otherwise Spark decides by size.
    ``spread`` is one more key: its name, the array of a row's members, and the columns that
    make it. Rows are counted by those columns first, and only the counts are sent to every member.
    """
    keys = list(keys)
    fine, groups = keys, keys
    if spread is not None:
        name, members, made_of = spread
        fine, groups = list(dict.fromkeys([*keys, *made_of])), [*keys, name]
    each = (lambda rows: rows) if spread is None else (lambda rows: rows.withColumn(name, F.explode(members)))
    names = list(measures)
    columns = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in measures.values()]
    rows = not_null(df, keys)

    # Common edges of each measure, as one small value of the plan; they even out the buckets, and results don't depend on them. Written, as two jobs ask for them.
    shares = F.expr(f"array({', '.join(f'{i / SELECTION_BUCKETS!r}D' for i in range(1, SELECTION_BUCKETS))})")
    sketches = materialize(rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), c), shares, accuracy).alias(f"_e{i}") for i, c in enumerate(columns)]), "sketches")
    infinite = F.lit(float("inf"))
    tidy = [F.coalesce(F.array_sort(F.array_distinct(F.filter(f"_e{i}", lambda e: F.abs(e) != infinite))), F.array().cast("array<double>")) for i in range(len(names))]
    edges = F.get(sketches.select(F.array(*tidy).alias("_e")).scalar(), F.col("_m"))
    placed = (
        rows.select(*fine, F.posexplode(F.array(*columns)).alias("_m", "_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_edges", edges).withColumn("_at", F.lit(0))
    )
    placed = _search(placed, "_edges", "_v", SELECTION_BUCKETS)
    single = F.get("_edges", F.col("_at") - 1) == F.col("_v")
    values = placed.select(*fine, "_m", (2 * F.col("_at") + F.when(single, 0).otherwise(1)).alias("_bucket"), "_v")
    merged = [F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    counts = values.groupBy(*fine, "_m", "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if spread is not None:
        counted = materialize(counts, "fine_counts")
        counts = each(counted).groupBy(*groups, "_m", "_bucket").agg(*merged)

    whole = Window.partitionBy(*groups, "_m")
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_n": F.sum("_c").over(whole), "_end": F.sum("_c").over(upto)}).withColumn("_start", F.col("_end") - F.col("_c"))

    # The ranks wanted of each measure, two per probability; a bucket holds some of them. As many
    # rows per group as are listed here, so they are gathered in one map, and the plan has the same size for any list.
    wanted = sorted({(names.index(m), p) for m, p in targets.values()})
    ranks = F.array(*[
        F.struct(F.lit(2 * i + up).alias("slot"), F.lit(m).alias("m"), (rank(position := (F.col("_n") - 1) * F.lit(float(p))) + 1).alias("rank"), (position - F.floor(position)).alias("part"))
        for i, (m, p) in enumerate(wanted) for up, rank in enumerate((F.floor, F.ceil))])
    held = F.filter(ranks, lambda r: (r["m"] == F.col("_m")) & (F.col("_start") < r["rank"]) & (r["rank"] <= F.col("_end")))
    place = F.col("r.rank") - F.col("_start")
    at_end = F.when((place == 1) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).when(place == F.col("_c"), F.col("_hi"))
    asked = materialize(ranked.withColumn("r", F.explode(held)).select(
        *groups, "_m", "_bucket", F.col("r.slot").alias("slot"), F.col("r.part").alias("part"), place.alias("_place"), at_end.alias("v")), "ranks_asked")
    answer = F.struct("slot", F.struct("v", "part").alias("at")).alias("a")
    known = asked.where("v IS NOT NULL").select(*groups, answer)

    # Only the buckets that hold a wanted rank between two values are read, value by value.
    inner = [*groups, "_m", "_bucket"]
    open_buckets = asked.where("v IS NULL").groupBy(*inner).agg(F.collect_list(F.struct("slot", "part", "_place")).alias("_asks"))
    if spread is None:
        held_rows = _attach(values, open_buckets.select(*inner), inner, bounded_groups)
    else:
        # The members that want a value of a bucket, by what makes them: a row meets one list, and most rows none.
        at = [*fine, "_m", "_bucket"]
        wanting = each(counted.select(*at)).join(open_buckets.select(*inner), inner).groupBy(*at).agg(F.collect_list(name).alias("_wanting"))
        wanting = materialize(wanting.select(*[F.col(c).alias(f"_w_{c}") for c in at], "_wanting"), "wanting_cells")
        same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in at]
        held_rows = values.join(F.broadcast(wanting) if bounded_groups else wanting, same).withColumn(name, F.explode("_wanting"))
    inside = held_rows.groupBy(*inner, F.col("_v").alias("v")).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*inner).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held_here = F.filter("_asks", lambda r: (F.col("_upto") - F.col("_c") < r["_place"]) & (r["_place"] <= F.col("_upto")))
    read = _attach(inside.withColumn("_upto", F.sum("_c").over(run)), open_buckets, inner, bounded_groups).select(
        *groups, "v", F.explode(held_here).alias("r")).select(*groups, "v", "r.slot", "r.part").select(*groups, answer)
    gathered = known.unionByName(read).groupBy(*groups).agg(F.map_from_entries(F.collect_list("a")).alias("_at"))

    def quantile(name: str, measure: str, p: float) -> Column:
        i = wanted.index((names.index(measure), p))
        low, high = F.col("_at")[2 * i], F.col("_at")[2 * i + 1]
        return (low["v"] + (high["v"] - low["v"]) * low["part"]).alias(name)

    return gathered.select(*groups, *[quantile(name, *of) for name, of in targets.items()])


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    measures: Mapping[str, Column | str],
    targets: Mapping[str, tuple[str, float]],
    bounded_groups: bool = True,
    spread: tuple[str, Column, Sequence[str]] | None = None,
) -> DataFrame:
    """Plain aggregates of every group next to its exact quantiles."""
    keys = list(keys)
    rows, groups = not_null(df, keys), keys
    if spread is not None:
        rows, groups = rows.withColumn(spread[0], F.explode(spread[1])), [*keys, spread[0]]
    plain = rows.groupBy(*groups).agg(*aggregates)
    exact = grouped_quantiles(df, keys, measures, targets, bounded_groups, spread=spread)
    return plain.join(exact, groups, "left")


def in_value_buckets(df: DataFrame, value: str, like: DataFrame | None = None) -> DataFrame:
    """Adds ``_bucket``: common value edges cut all rows, and so every group of them, into buckets of at most about a 1024th of the rows.

    A value that fills a bucket or more is an edge. Every edge has a bucket of its own, an even number, between the odd
    ones. The edges, 1023 numbers at most, pass through the driver, and a row finds its bucket by binary search.
    They may be taken from ``like``, a table at hand of one column of similar values: edges even out the buckets, and results don't depend on them.
    """
    values = df.select(value) if like is None else like
    shares = ", ".join(f"{i / BUCKETS!r}D" for i in range(1, BUCKETS))
    found = values.agg(F.expr(f"percentile_approx({values.columns[0]}, array({shares}), {SKETCH_ACCURACY})")).first()[0] or [0.0]
    edges = sorted({e for e in found if math.isfinite(e)}) or [0.0]
    # As one text: a call for each number would cost more than the job.
    listed = f"array({', '.join(f'{float(e)!r}D' for e in edges)})"
    placed = df.withColumn("_listed", F.expr(listed)).withColumn("_at", F.lit(0))
    placed = _search(placed, "_listed", value, BUCKETS)
    single = F.get("_listed", F.col("_at") - 1) == F.col(value)
    return placed.withColumn("_bucket", 2 * F.col("_at") + F.when(single, 0).otherwise(1)).drop("_listed", "_at")


def _search(df: DataFrame, edges: str, value: str, buckets: int) -> DataFrame:
    """Counts in ``_at``, a column of 0 so far, the sorted edges that are at most the value: a binary search, a column a step, as columns are compiled and functions of arrays are not."""
    for k in range(1, buckets.bit_length()):
        step = buckets >> k
        df = df.withColumn("_at", F.when(F.get(edges, F.col("_at") + (step - 1)) <= F.col(value), F.col("_at") + step).otherwise(F.col("_at")))
    return df


def with_ranks(
    df: DataFrame, keys: Sequence[str], value: str, descending: bool = False, bounded_groups: bool = False
) -> DataFrame:
    """Adds to every row its rank by ``value`` in its group: ``rank_min`` (ties share the first), ``rank_avg`` and ``n`` (rows of the group).

    Rows without a key or value go. A group is cut into value buckets; a row's rank is the rows of the buckets before,
    which are counted, plus its place in its own bucket, which is sorted alone, so nothing is joined by value. A value
    that fills a bucket or more is an edge of the buckets and has one of its own, where all ranks are the same: its rows need no sort and stay spread out.
    """
    keys = list(keys)
    rows = not_null(df, [*keys, value]).withColumn("_s", F.col(value).cast("double") * (-1 if descending else 1))
    placed = in_value_buckets(rows, "_s")
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in")).select(
        *keys, "_bucket", "_in",
        (F.sum("_in").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).alias("_before"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias("n"),
    )
    single = F.col("_bucket") % 2 == 0
    salted = _attach(placed, offsets, [*keys, "_bucket"], bounded_groups).withColumn("_salt", F.when(single, F.spark_partition_id()).otherwise(0))
    inner = [*keys, "_bucket", "_salt"]
    first = F.when(single, 1).otherwise(F.rank().over(Window.partitionBy(*inner).orderBy("_s")))
    ties = F.when(single, F.col("_in")).otherwise(F.count(F.lit(1)).over(Window.partitionBy(*inner, "_s")))
    return salted.withColumns({"rank_min": F.col("_before") + first, "_ties": ties}).withColumn(
        "rank_avg", F.col("rank_min") + (F.col("_ties") - 1) / 2.0).drop("_s", "_bucket", "_in", "_before", "_salt", "_ties")


def quantiles_at(
    values: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, like: DataFrame | None = None,
    spread: tuple[str, Column, Sequence[str]] | None = None,
) -> DataFrame:
    """Any number of quantiles by rank selection: ``wanted`` (keys and other columns, probability ``p``) with the interpolated quantile ``q``.

    The plan is the same whatever is wanted. Values are counted by bucket; a wanted rank first finds its bucket among a group's
    buckets, as the last that begins at or before it. It is a bucket's least or largest value, or is looked for among the values of that bucket;
    the others are not read again. Rows of ``wanted`` without values in their group are left out. ``like``: see ``in_value_buckets``.
    ``spread`` makes one of the keys: its name, the array of a row's members, and the columns that make it, by which rows are counted first.
    """
    keys = list(keys)
    name, members, made_of = spread or (None, None, [])
    fine = list(dict.fromkeys([*[k for k in keys if k != name], *made_of]))
    each = (lambda rows: rows) if spread is None else (lambda rows: rows.withColumn(name, F.explode(members)))
    rows = not_null(values, [*[k for k in keys if k != name], value]).select(*fine, F.col(value).cast("double").alias("_x")).where(~F.isnan("_x"))
    placed = in_value_buckets(rows, "_x", like)
    counts = placed.groupBy(*fine, "_bucket").agg(F.count(F.lit(1)).alias("_in"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    if spread is not None:
        counts = not_null(each(counts), [name]).groupBy(*keys, "_bucket").agg(F.sum("_in").alias("_in"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = materialize(counts.withColumns({
        "_before": F.sum("_in").over(upto) - F.col("_in"), "_n": F.sum("_in").over(Window.partitionBy(*keys))}), "value_buckets")
    sides = F.array(F.lit(0), F.lit(1))
    asked = wanted.join(offsets.select(*keys, "_n").distinct(), keys).withColumn("_position", (F.col("_n") - 1) * F.col("p"))
    asked = asked.withColumn("_side", F.explode(sides)).withColumn(
        "_rank", (F.when(F.col("_side") == 0, F.floor("_position")).otherwise(F.ceil("_position"))).cast("bigint"))
    row = F.struct(*wanted.columns, "_position", "_side")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)

    def last(by: list[str], entries: DataFrame, asking: DataFrame, *columns: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy("_rank", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return entries.unionByName(asking).withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns}).where("_asks = 1")

    asking = asked.select(*keys, "_rank", F.lit(1).alias("_asks"), row.alias("_row"), none("_bucket", "int"), none("_at", "struct<before:bigint,n:bigint,lo:double,hi:double>"))
    empty = none("_row", asking.schema["_row"].dataType)
    at = F.struct(F.col("_before").alias("before"), F.col("_in").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).alias("_at")
    buckets = offsets.select(*keys, F.col("_before").alias("_rank"), F.lit(0).alias("_asks"), empty, "_bucket", at)
    place = F.col("_rank") - F.col("_at.before")
    at_end = F.when((place == 0) | (F.col("_at.lo") == F.col("_at.hi")), F.col("_at.lo")).when(place == F.col("_at.n") - 1, F.col("_at.hi"))
    found = materialize(last(keys, buckets, asking, "_bucket", "_at").select(
        *keys, "_bucket", place.alias("_rank"), F.lit(1).alias("_asks"), "_row", at_end.alias("_x")), "ranks_asked")
    open_ranks = found.where("_x IS NULL")
    inside = each(placed).join(open_ranks.select(*keys, "_bucket").distinct(), [*keys, "_bucket"]).groupBy(*keys, "_bucket", "_x").agg(F.count(F.lit(1)).alias("_c"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = inside.select(*keys, "_bucket", (F.sum("_c").over(inner) - F.col("_c")).alias("_rank"), F.lit(0).alias("_asks"), empty, "_x")
    read = last([*keys, "_bucket"], begun, open_ranks, "_x")
    picked = found.where("_x IS NOT NULL").select("_row.*", "_x").unionByName(read.select("_row.*", "_x"))
    low, high = (F.max(F.when(F.col("_side") == side, F.col("_x"))) for side in (0, 1))
    return picked.groupBy(*wanted.columns, "_position").agg(low.alias("_low"), high.alias("_high")).select(
        *wanted.columns, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_position") - F.floor("_position"))).alias("q"))
