"""Real-time probabilistic calibration.

Training sets grow with the tested edition. A case is one row from the first edition that could know it; what an edition
has seen is a prefix (``expanding``), and all editions are treated in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators import expanding
from vintara.operators.bands import cell_id, class_id, classify, crisis_probabilities, group_id, in_crisis, memberships, mixture, with_cells
from vintara.operators.quantiles import summarise
from vintara.session import materialize

RETAINED = "class x group"
METHODS = (RETAINED, "class", "group", "all", "own history")
PATH = "announced path"
MIXTURE = "class x group, crises apart"
CASE = ["entity", "edition"]


def training_sizes(cases: DataFrame, horizon: int, first: int, last: int) -> DataFrame:
    """What every tested edition v has to train on: the cases of editions m <= v - h - 2, whose error it could know.

    A case counts from one edition on; the counts are added up over the editions, and no case is sent to each of them.
    """
    start = F.greatest(F.col("edition_period") + horizon + 2, F.lit(first))
    begun = cases.where(start <= last).groupBy(start.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.max("edition_period").alias("latest"))
    calendar = begun.agg(F.min("v").alias("v")).where("v IS NOT NULL").select(F.explode(F.sequence("v", F.lit(last))).alias("v"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per edition of the calendar
    return calendar.join(begun, "v", "left").select("v", F.sum("n").over(upto).alias("n"), F.max("latest").over(upto).alias("latest"))


def class_events(cases: DataFrame, edges: DataFrame, horizon: int) -> DataFrame:
    """Events (cell, x, t, w, down, crisis, crisis_down) of the training cases, in which class they are for each tested edition.

    The class edges move with the edition, but a case changes its class a few times at most: it enters a cell at the
    first edition that knows it or that puts it there, and leaves at the edition that moves it.
    """
    calendar = Window.orderBy("v")  # one row per tested edition
    told = edges.select("v", "edges", F.lag("v").over(calendar).alias("last_v"), F.lag("edges").over(calendar).alias("last_edges"))
    every = told.agg(F.collect_list(F.struct("v", "edges", "last_v", "last_edges"))).scalar()
    start = F.col("edition_period") + horizon + 2
    steps = cases.withColumn("_every", every).withColumn("_s", F.explode(F.filter("_every", lambda e: e["v"] >= start)))
    first = F.col("_s.last_v").isNull() | (F.col("_s.last_v") < start)
    moved = steps.select(
        "grp", F.col("level_error_own").alias("x"), (F.col("worst_realised") < 0).cast("bigint").alias("_d"), F.col("crisis").cast("bigint").alias("_c"),
        F.col("_s.v").alias("t"), first.alias("_first"), expr.digitize("projected_growth_pct", F.col("_s.edges")).alias("cls"),
        F.when(~first, expr.digitize("projected_growth_pct", F.col("_s.last_edges"))).alias("_was")).where("_first OR cls <> _was")

    def event(cell: Column, w: int) -> Column:
        return F.when(cell.isNotNull(), F.struct(cell.alias("cell"), F.lit(w).cast("bigint").alias("w")))

    lasting = [F.when(F.col("_first"), event(c, 1)) for c in (F.lit("all"), group_id())]
    entered, left = ([event(class_id(c), w), event(cell_id(c), w)] for c, w in (("cls", 1), ("_was", -1)))
    rows = moved.select("x", "t", "_d", "_c", F.explode(F.filter(F.array(*lasting, *entered, *left), lambda e: e.isNotNull())).alias("e")).select("e.*", "x", "t", "_d", "_c")
    return rows.groupBy("cell", "x", "t").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("_d")).alias("down"), F.sum(F.col("w") * F.col("_c")).alias("crisis"),
        F.sum(F.col("w") * F.col("_c") * F.col("_d")).alias("crisis_down"))


def own_history(cases: DataFrame, horizon: int, first: int, minimum: int) -> DataFrame:
    """An entity's own past errors at every case to be tested: band, downturn share and CRPS from its earlier cases.

    An entity has a case per edition: its past fits a window frame, whatever the number of entities.
    """
    low, high = fixed.BAND_QUANTILES
    past = Window.partitionBy("entity").orderBy("edition_period").rangeBetween(Window.unboundedPreceding, -(horizon + 2))
    held = F.collect_list(F.struct(F.col("level_error_own").alias("x"), (F.col("worst_realised") < 0).cast("double").alias("d")))
    rows = cases.withColumn("_h", F.array_sort(held.over(past))).where((F.col("edition_period") >= first) & (F.size("_h") >= minimum))
    rows = rows.withColumns({"_x": F.col("_h.x"), "_n": F.size("_h"), "_y": F.col("level_error_own")})

    def at(p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(p)
        below = F.get("_x", F.floor(place).cast("int"))
        return below + (F.get("_x", F.ceil(place).cast("int")) - below) * (place - F.floor(place))

    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    distance = total(F.transform("_x", lambda x: F.abs(x - F.col("_y")))) / F.col("_n")
    spread = total(F.transform("_x", lambda x, i: (2 * i + 1 - F.col("_n")) * x)) / (F.col("_n") * F.col("_n"))
    return rows.select(*CASE, at(low).alias("_lo"), at(high).alias("_hi"), (total(F.col("_h.d")) / F.col("_n")).alias("_f"), (distance - spread).alias("_crps"))


def realtime_predictions(
    levels: DataFrame, horizon: int, first: int, world: DataFrame | None = None,
    min_cell: int = fixed.MIN_CELL, own_min: int = fixed.OWN_HISTORY_MIN,
) -> DataFrame:
    """H1: band, CRPS and downturn probability of every tested case by every method."""
    low, high = fixed.BAND_QUANTILES
    needed = ["level_error_own", "projected_growth_pct", "worst_realised", "worst_projected"]
    cases = levels.where(F.col("horizon") == horizon).dropna(subset=needed).select(
        "entity", "grp", "edition", "edition_period", "period", "weight", *needed)
    cases = cases.withColumn("crisis", F.lit(False)) if world is None else in_crisis(cases, world, F.lit(horizon))
    cases = materialize(cases, "rt_cases")
    last = cases.agg(F.max("edition_period").alias("m")).first()["m"]  # one number of the calendar
    if last is None or last < first:
        raise ValueError("no edition to test in real time")
    times = list(range(first, last + 1))

    # Class edges of every edition with enough cases, from the growth known to it.
    start = F.greatest(F.col("edition_period") + horizon + 2, F.lit(first))
    growth = cases.where(start <= last).groupBy(F.lit("growth").alias("cell"), F.col("projected_growth_pct").alias("x"), start.alias("t")).agg(F.count(F.lit(1)).alias("w"))
    growth = materialize(expanding.in_buckets(growth, cases.select("projected_growth_pct")), "rt_growth")
    inner = {f"_e{i}": i / fixed.GROWTH_CLASSES for i in range(1, fixed.GROWTH_CLASSES)}
    enough = training_sizes(cases, horizon, first, last).where(F.col("n") >= min_cell).select("v")
    edges = expanding.quantiles(growth, times, inner).join(enough, "v").select("v", F.array(*inner).alias("edges"))
    edges = materialize(edges, "rt_edges")
    test = classify(cases.where(F.col("edition_period") >= first).withColumn("v", F.col("edition_period")), edges, ["v"])

    # A cell's sample at an edition; the outcomes to be scored in it are events without weight.
    events = class_events(cases, edges, horizon)
    zero = F.lit(0).cast("bigint")
    scored = test.select(F.explode(memberships()).alias("cell"), F.col("level_error_own").alias("x"), F.col("v").alias("t")).distinct().select(
        "cell", "x", "t", *[zero.alias(c) for c in ("w", "down", "crisis", "crisis_down")])
    placed = materialize(expanding.in_buckets(events.where("w <> 0 OR down <> 0 OR crisis <> 0 OR crisis_down <> 0").unionByName(scored), cases.select("level_error_own")), "rt_events")
    counts = expanding.totals(placed, times, {"n": "w", "d": "down", "c": "crisis", "k": "crisis_down"})
    calm, calm_down = F.col("n") - F.col("c"), F.col("d") - F.col("k")
    wide = counts.where("n > 0").join(expanding.quantiles(placed, times, {"lo0": low, "hi0": high}), ["cell", "v"]).select(
        "v", "cell", F.col("n").alias("n0"), (F.col("d") / F.col("n")).alias("frequency0"), "lo0", "hi0",
        F.col("c").alias("n1"), F.try_divide(F.col("k"), F.col("c")).alias("frequency1"), calm.alias("n2"), F.try_divide(calm_down, calm).alias("frequency2"))
    wide = materialize(wide, "rt_cells")
    own = own_history(cases, horizon, first, own_min)
    rows = with_cells(test, wide, ["v"], min_cell).join(own, CASE, "left")
    if world is not None:
        pi = crisis_probabilities(edges.select("v"), world, F.lit(horizon), F.col("v") - 2)
        rows = rows.join(F.broadcast(pi), "v")  # one row per tested edition

    def method(name: str, cell: Column | None, stats: Column | None, p: Column) -> Column:
        null = F.lit(None)
        bound = lambda c: null.cast("double") if stats is None else stats[c]
        return F.struct(F.lit(name).alias("method"), (null if cell is None else cell).cast("string").alias("cell"), bound("lo").alias("lo"), bound("hi").alias("hi"),
                        null.cast("double").alias("own_crps"), p.cast("double").alias("p"))

    def fallback(name: str, cell: Column, stats: str) -> Column:
        has = F.col(stats).isNotNull()
        picked = F.when(has, F.col(stats)).otherwise(F.col("_all"))
        return method(name, F.when(has, cell).otherwise("all"), picked, picked["frequency"])

    options = [
        method(RETAINED, F.col("_cell"), F.col("_q0"), F.col("_q0.frequency")), fallback("class", class_id(), "_class"), fallback("group", group_id(), "_group"),
        method("all", F.lit("all"), F.col("_all"), F.col("_all.frequency")),
        F.when(F.col("_f").isNotNull(), F.struct(
            F.lit("own history").alias("method"), F.lit(None).cast("string").alias("cell"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_crps").alias("own_crps"), F.col("_f").alias("p"))),
        method(PATH, None, None, (F.col("worst_projected") < 0)),
    ]
    if world is not None:
        options.append(method(MIXTURE, None, None, mixture(F.col("pi"))["p_mix"]))
    long = rows.select(
        "entity", "grp", "edition", "v", "period", "weight", "cls", F.col("level_error_own").alias("error"),
        (F.col("worst_realised") < 0).cast("double").alias("down"),
        F.explode(F.filter(F.array(*options), lambda m: m.isNotNull())).alias("m"),
    ).select("*", "m.*").drop("m")
    scores = expanding.crps(placed, times).withColumnRenamed("y", "error")
    return long.join(scores, ["v", "cell", "error"], "left").select(
        *CASE, "grp", "v", "period", "weight", "cls", "error", "down", "method", "lo", "hi", F.coalesce("own_crps", "crps").alias("crps"), "p",
        expr.covered("lo", "hi", "error").alias("covered"), expr.interval_score("lo", "hi", "error").alias("score"),
        expr.brier("p", "down").alias("brier"),
    )


def common_cases(predictions: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Cases for which every method has a prediction."""
    kept = predictions.where(F.col("method").isin(list(methods)))
    return kept.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*CASE))).where(F.col("_k") == len(methods)).drop("_k")


def of_method(method: str, column: str) -> Column:
    """Value of one method on the same case, for differences of scores."""
    return F.max(F.when(F.col("method") == method, F.col(column))).over(Window.partitionBy(*CASE))


def bootstrap_intervals(
    rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], statistics: Mapping[str, Column],
    draws: int = fixed.BOOTSTRAP_DRAWS, seed: str = "vintara", block: str = "period",
) -> DataFrame:
    """H3: 95 % interval of statistics by resampling blocks.

    Every statistic is a function of sums, so a draw only re-adds the sums of its blocks:
    rows are read once, and draws x blocks is a small table whatever the data. The blocks
    of a key are drawn by a seeded hash of (draw, slot).
    """
    keys = list(keys)
    table = rows.groupBy(*keys, block).agg(*[c.alias(n) for n, c in sums.items()])
    order = Window.partitionBy(*keys).orderBy(block)
    table = materialize(
        table.withColumns({"_i": F.row_number().over(order) - 1, "_b": F.count(F.lit(1)).over(Window.partitionBy(*keys))}), "blocks")
    sizes = table.select(F.col("_b")).distinct()
    slots = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    digest = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8)
    picks = slots.select("_b", "draw", F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.col("_b")).cast("int").alias("_i")).groupBy(
        "_b", "draw", "_i").agg(F.count(F.lit(1)).alias("_times"))
    drawn = table.join(picks, ["_b", "_i"]).groupBy(*keys, "draw").agg(
        *[F.sum(F.col(n) * F.col("_times")).alias(n) for n in sums])
    values = drawn.select(*keys, *[c.alias(n) for n, c in statistics.items()])
    return values.groupBy(*keys).agg(*[
        F.percentile(n, F.lit(q)).alias(f"{n}_{side}") for n in statistics for side, q in (("ci_low", 0.025), ("ci_high", 0.975))])


def _with_intervals(rows, keys, sums, statistics, draws):
    point = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()]).select(
        *keys, *[c.alias(n) for n, c in statistics.items()])
    return point.join(bootstrap_intervals(rows, keys, sums, statistics, draws), list(keys))


def band_scores(predictions: DataFrame, draws: int = fixed.BOOTSTRAP_DRAWS) -> DataFrame:
    """H4: coverage, interval score, CRPS and gap to the retained method, on common cases."""
    w = F.coalesce("weight", F.lit(0.0))
    rows = materialize(common_cases(predictions).withColumn("gap", of_method(RETAINED, "score") - F.col("score")), "common")
    sums = {
        "s_n": F.count(F.lit(1)), "s_cov": F.sum("covered"), "s_score": F.sum("score"), "s_crps": F.sum("crps"), "s_gap": F.sum("gap"),
        "s_w": F.sum(w), "s_wscore": F.sum(w * F.col("score")), "s_wgap": F.sum(w * F.col("gap")),
    }
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    statistics = {
        "coverage_pct": ratio("s_cov", "s_n") * 100, "score": ratio("s_score", "s_n"), "crps": ratio("s_crps", "s_n"),
        "gap": ratio("s_gap", "s_n"), "weighted_score": ratio("s_wscore", "s_w"), "weighted_gap": ratio("s_wgap", "s_w"),
    }
    plain = summarise(
        rows, ["method"], [F.count(F.lit(1)).alias("cases"), F.min("v").alias("first_edition"), F.max("v").alias("last_edition")],
        {"w": F.col("hi") - F.col("lo")}, {"median_width": ("w", 0.5)})
    return plain.join(_with_intervals(rows, ["method"], sums, statistics, draws), "method").withColumn(
        "retained", F.col("method") == RETAINED)


def gap_by_subsample(
    predictions: DataFrame, subsamples: Mapping[str, Column], method: str = "group", min_cases: int = fixed.MIN_CELL,
    draws: int = fixed.BOOTSTRAP_DRAWS,
) -> DataFrame:
    """H5: score gap of one method to the retained one on overlapping sub-samples."""
    both = common_cases(predictions).withColumns({
        "gap": of_method(RETAINED, "score") - F.col("score"), "covered_retained": of_method(RETAINED, "covered")})
    names = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in subsamples.items()]), lambda n: n.isNotNull())
    w = F.coalesce("weight", F.lit(0.0))
    rows = both.where(F.col("method") == method).select("*", F.explode(names).alias("subsample"))
    rows = materialize(rows, "subsamples")
    kept = rows.groupBy("subsample").agg(
        F.count(F.lit(1)).alias("cases"), (F.avg("covered_retained") * 100).alias("coverage_retained_pct"),
        (F.avg("covered") * 100).alias("coverage_pct"), F.sum(w).alias("_w"),
    ).where((F.col("cases") >= min_cases) & (F.col("_w") > 0)).drop("_w")
    sums = {"s_n": F.count(F.lit(1)), "s_gap": F.sum("gap"), "s_w": F.sum(w), "s_wgap": F.sum(w * F.col("gap"))}
    statistics = {"gap": F.try_divide(F.col("s_gap"), F.col("s_n")), "weighted_gap": F.try_divide(F.col("s_wgap"), F.col("s_w"))}
    return kept.join(_with_intervals(rows, ["subsample"], sums, statistics, draws), "subsample")


def coverage_by_cell(predictions: DataFrame) -> DataFrame:
    """H6: coverage and median width of the retained method by class and group."""
    return summarise(
        predictions.where(F.col("method") == RETAINED), ["cls", "grp"],
        [F.count("covered").alias("cases"), (F.avg("covered") * 100).alias("coverage_pct")],
        {"w": F.col("hi") - F.col("lo")}, {"median_width": ("w", 0.5)}, bounded_groups=False)


def coverage_by_edition(predictions: DataFrame) -> DataFrame:
    """H6: coverage of the retained method by tested edition, and the side of the misses."""
    return predictions.where(F.col("method") == RETAINED).groupBy("v").agg(
        F.count("covered").alias("cases"), (F.avg("covered") * 100).alias("coverage_pct"),
        expr.share_pct(F.col("error") > F.col("hi")).alias("too_high_pct"),
        expr.share_pct(F.col("error") < F.col("lo")).alias("too_low_pct"))


def downturn_scores(predictions: DataFrame, draws: int = fixed.BOOTSTRAP_DRAWS, methods: Sequence[str] = (*METHODS, MIXTURE, PATH)) -> DataFrame:
    """H7: Brier score, skill against the unconditional probability, gain over the retained cells."""
    rows = common_cases(predictions, methods).withColumns({
        "brier_base": of_method("all", "brier"), "brier_cells": of_method(RETAINED, "brier")})
    rows = materialize(rows, "downturns")
    sums = {"s_n": F.count(F.lit(1)), "s_b": F.sum("brier"), "s_base": F.sum("brier_base"), "s_cells": F.sum("brier_cells")}
    statistics = {
        "brier": F.try_divide(F.col("s_b"), F.col("s_n")), "skill": 1 - F.try_divide(F.col("s_b"), F.col("s_base")),
        "gain": F.try_divide(F.col("s_cells") - F.col("s_b"), F.col("s_n")),
    }
    plain = rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("p").alias("mean_probability"), F.avg("down").alias("observed"))
    return plain.join(_with_intervals(rows, ["method"], sums, statistics, draws), "method")


def reliability(predictions: DataFrame, methods: Sequence[str] = (RETAINED, MIXTURE), bins: int = 10) -> DataFrame:
    """H8: mean probability and observed frequency by right-closed probability bin."""
    edges = [i / bins for i in range(bins + 1)]
    return predictions.where(F.col("method").isin(list(methods)) & F.col("p").isNotNull()).withColumn(
        "bin", expr.right_closed_bin("p", edges)).groupBy("method", "bin").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("p").alias("mean_probability"), F.avg("down").alias("observed"))
