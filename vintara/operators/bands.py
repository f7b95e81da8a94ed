"""Empirical bands from past errors.

Past cases are grouped by cells: growth class x group, class, group and all. Their statistics are a table of one row per
key (a horizon, or a test edition) and cell. A row's cascade of fallbacks is resolved once for all rows of its class and group, then joined to
them (``with_cells``), so groups may be any number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vintara.functions import expr, fixed
from vintara.operators.evaluation import flag_large, quantile_edges
from vintara.operators.quantiles import grouped_quantiles, summarise
from vintara.operators.vintages import by_key
from vintara.session import materialize


def groups_at_edition(cases: DataFrame, history: DataFrame, column: str = "grp") -> DataFrame:
    """Group of the fiscal period known at the edition (its own in spring, the next in
    autumn); the current group where the history says nothing.

    The history of an entity is one map, so cases that lie by entity stay where they are.
    """
    known = by_key(history.groupBy("entity", "fiscal").agg(F.min("grp").alias("_then")), "fiscal", F.col("_then"), "_known")
    fiscal = F.col("edition_period") + F.when(F.col("season") == "F", 1).otherwise(0)
    return (
        cases.join(known, "entity", "left")
        .withColumn(column, F.coalesce(F.try_element_at("_known", fiscal), column))
        .drop("_known")
    )


# ---------------------------------------------------------------- world crises

def recession_periods(world: DataFrame, upto: int | None = None) -> DataFrame:
    """periods of negative world growth, as known up to a period."""
    known = world if upto is None else world.where(F.col("period") <= upto)
    return known.where("value < 0").select("period")


def crisis_probabilities(keys: DataFrame, world: DataFrame, duration: Column, upto: Column | None = None) -> DataFrame:
    """share of the complete windows of ``duration`` periods holding a recession.

    The world series is one value per period of the calendar: it travels as two arrays.
    """
    periods = world.agg(F.sort_array(F.collect_list("period"))).scalar()
    bad = world.where("value < 0").agg(F.sort_array(F.collect_list("period"))).scalar()
    limit = upto if upto is not None else F.array_max("_all")
    return (
        keys.withColumn("_all", periods).withColumn("_bad", bad)
        .withColumn("_known", F.filter("_all", lambda p: p <= limit))
        .withColumn("_starts", F.filter("_known", lambda a: a + duration - 1 <= F.array_max("_known")))
        .withColumn("pi", F.try_divide(
            F.size(F.filter("_starts", lambda a: F.exists("_bad", lambda r: (r >= a) & (r <= a + duration - 1)))),
            F.size("_starts")))
        .drop("_all", "_bad", "_known", "_starts")
    )


def in_crisis(rows: DataFrame, world: DataFrame, duration: Column, upto: Column | None = None) -> DataFrame:
    """Does the period after the edition (m+1 .. m+duration) contain a known recession?"""
    bad = world.where("value < 0").agg(F.sort_array(F.collect_list("period"))).scalar()
    hit = lambda r: (r > F.col("edition_period")) & (r <= F.col("edition_period") + duration)
    known = (lambda r: hit(r) & (r <= upto)) if upto is not None else hit
    return rows.withColumn("_bad", bad).withColumn("crisis", F.exists("_bad", known)).drop("_bad")


# ---------------------------------------------------------------- cells

def cell_id(cls: str = "cls", grp: str = "grp") -> Column:
    return F.concat(F.lit("cell|"), F.col(cls).cast("string"), F.lit("|"), F.col(grp))


def class_id(cls: str = "cls") -> Column:
    return F.concat(F.lit("class|"), F.col(cls).cast("string"))


def group_id(grp: str = "grp") -> Column:
    return F.concat(F.lit("group|"), F.col(grp))


def memberships() -> Column:
    """Cells a case belongs to; a NULL class or group belongs to none of its own."""
    return F.filter(F.array(cell_id(), class_id(), group_id(), F.lit("all")), lambda c: c.isNotNull())


def classify(cases: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """class of every case by the edges of its key."""
    return cases.join(F.broadcast(edges), list(keys)).withColumn(
        "cls", expr.digitize("projected_growth_pct", F.col("edges"))).drop("edges")


REGIMES = ("", "crisis:", "calm:")  # prefixes of the cells' names, in the order of the numbered columns
STATISTICS = ("n", "frequency", "downturn_pct", "lo", "hi", "median", "depth")


def wide_statistics(cases: DataFrame, keys: Sequence[str], regimes: bool = False) -> DataFrame:
    """one row per key and cell: size, downturn share, band quantiles, median and depth.

    The columns of all cases end in 0; with ``regimes`` those of the cases in a world crisis in 1, of the others in 2.
    """
    low, high = fixed.BAND_QUANTILES
    extra = ["crisis"] if regimes else []
    rows = cases.select(*keys, *extra, "cls", "grp", "level_error_own", "worst_realised")
    down = F.col("worst_realised") < 0
    parts = [F.lit(True)] + ([F.col("crisis"), ~F.col("crisis")] if regimes else [])
    aggregates, measures, targets = [], {}, {}
    for i, inside in enumerate(parts):
        aggregates += [
            F.count_if(inside).alias(f"n{i}"), F.avg(F.when(inside, F.coalesce(down, F.lit(False)).cast("double"))).alias(f"frequency{i}"),
            expr.share_pct(F.when(inside, down)).alias(f"downturn_pct{i}")]
        measures |= {f"e{i}": F.when(inside, F.col("level_error_own")), f"w{i}": F.when(inside & down, F.col("worst_realised"))}
        targets |= {f"lo{i}": (f"e{i}", low), f"hi{i}": (f"e{i}", high), f"median{i}": (f"e{i}", 0.5), f"depth{i}": (f"w{i}", 0.5)}
    return summarise(rows, keys, aggregates, measures, targets, bounded_groups=False, spread=("cell", memberships(), ["cls", "grp"]))


def cell_statistics(cases: DataFrame, keys: Sequence[str], regimes: bool = False) -> DataFrame:
    """The same with a row for each regime, as cells of their own (``crisis:``, ``calm:``)."""
    table = wide_statistics(cases, keys, regimes)
    cells = F.array(*[
        F.struct(F.concat(F.lit(name), "cell").alias("cell"), *[F.col(f"{c}{i}").alias(c) for c in STATISTICS])
        for i, name in enumerate(REGIMES[: 3 if regimes else 1])])
    return table.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("n > 0")


def with_cells(rows: DataFrame, wide: DataFrame, keys: Sequence[str], min_cell: int) -> DataFrame:
    """Adds to every row of (keys, cls, grp) the statistics its cascade of cells leads to.

    The cascade is resolved once per distinct key, class and group, which is joined to the cells' statistics level by level and then to
    the rows by equality; a class x group cell stands on its own from ``min_cell`` cases, the others from one. Added are
    ``_cell`` (the identity picked), ``_q0`` and, where ``wide`` has regimes, ``_q1`` and ``_q2`` (statistics picked), and the
    statistics of all cases of the own class, the own group and everything, ``_class``, ``_group``, ``_all`` (null where empty).
    What is resolved is written, so that Spark joins it by its true size and the rows need no shuffle where it is small.
    """
    keys = list(keys)
    regimes = [i for i in range(len(REGIMES)) if f"n{i}" in wide.columns]
    columns = [c for c in wide.columns if c not in (*keys, "cell")]
    names = lambda i: [c for c in STATISTICS if f"{c}{i}" in columns]
    asked = rows.select(*keys, "cls", "grp").distinct().withColumns({"_c0": cell_id(), "_c1": class_id(), "_c2": group_id(), "_c3": F.lit("all")})
    for level in range(4):
        asked = asked.join(wide.select(*keys, F.col("cell").alias(f"_c{level}"), F.struct(*columns).alias(f"_s{level}")), [*keys, f"_c{level}"], "left")

    def of(level: int, i: int, least: int = 1) -> Column:
        at = F.col(f"_s{level}")
        return F.when(at[f"n{i}"] >= least, F.struct(*[at[f"{c}{i}"].alias(c) for c in names(i)]))

    stands = [F.col("_s0")["n0"] >= min_cell, F.col("_s1")["n0"] > 0]
    resolved = asked.select(
        *[F.col(k).alias(f"_k_{k}") for k in (*keys, "cls", "grp")], F.when(stands[0], F.col("_c0")).when(stands[1], F.col("_c1")).otherwise("all").alias("_cell"),
        *[F.coalesce(of(0, i, min_cell), of(1, i), of(3, i)).alias(f"_q{i}") for i in regimes],
        of(1, 0).alias("_class"), of(2, 0).alias("_group"), of(3, 0).alias("_all"))
    resolved = materialize(resolved, "resolved_cells")
    same = [rows[k].eqNullSafe(resolved[f"_k_{k}"]) for k in (*keys, "cls", "grp")]
    return rows.join(resolved, same, "left").drop(*[f"_k_{k}" for k in (*keys, "cls", "grp")])


def mixture(pi: Column) -> dict[str, Column]:
    """downturn probability, world crises apart; a regime without cases takes the overall frequency."""
    base = F.col("_q0")["frequency"]
    crisis = F.coalesce(F.col("_q1")["frequency"], base)
    calm = F.coalesce(F.col("_q2")["frequency"], base)
    return {"p_crisis": crisis, "p_calm": calm, "p_mix": pi * crisis + (1 - pi) * calm}


def projection_bands(
    levels: DataFrame,
    current: DataFrame,
    entities: DataFrame,
    world: DataFrame,
    horizons: int,
    min_cell: int = fixed.MIN_CELL,
) -> DataFrame:
    """Band of every entity at every horizon 0..h, one job for all horizons.

    ``levels`` are past cases (group as known at the edition), ``current`` the growth the
    latest edition projects, ``entities`` today's entities and groups.
    """
    keys = ["horizon"]
    past = levels.where(
        F.col("horizon").between(0, horizons) & F.col("level_error_own").isNotNull() & F.col("projected_growth_pct").isNotNull())
    edges = quantile_edges(past, keys, "projected_growth_pct")
    classed = in_crisis(classify(past, edges, keys), world, F.col("horizon"))
    cells = materialize(wide_statistics(classed, keys, regimes=True), "band_cells")
    tables = crisis_probabilities(edges, world, F.col("horizon"))

    rows = entities.select("entity", "name", "grp", F.explode(F.sequence(F.lit(0), F.lit(horizons))).alias("horizon"))
    rows = rows.join(current, ["entity", "horizon"], "left").join(F.broadcast(tables), "horizon")  # a row per horizon
    rows = rows.withColumn("cls", expr.digitize("projected_growth_pct", F.col("edges"))).drop("edges")
    rows = with_cells(rows, cells, keys, min_cell).withColumns({
        "_g": F.when(F.col("_group.n") >= min_cell, F.col("_group")).otherwise(F.col("_all")), **mixture(F.col("pi"))})
    return rows.select(
        "entity", "name", "grp", "horizon", "projected_growth_pct", "cls",
        F.substring_index("_cell", "|", 1).alias("based_on"),
        F.col("_q0.n").alias("cases"), F.col("_q0.lo").alias("error_p10"), F.col("_q0.median").alias("error_median"),
        F.col("_q0.hi").alias("error_p90"),
        expr.inverted_bound("_q0.hi").alias("low_pct"), expr.inverted_bound("_q0.lo").alias("high_pct"),
        expr.inverted_bound("_g.hi").alias("low_pct_group"), expr.inverted_bound("_g.lo").alias("high_pct_group"),
        (F.col("p_mix") * 100).alias("downturn_pct"), (F.col("p_crisis") * 100).alias("downturn_crisis_pct"),
        (F.col("p_calm") * 100).alias("downturn_calm_pct"), (F.col("pi") * 100).alias("crisis_pct"),
        F.col("_q1.median").alias("error_median_crisis"), F.col("_q0.depth").alias("depth_median"),
    )


def retrospective_calibration(
    levels: DataFrame, horizon: int, cut: int, poorest: str, min_cell: int = fixed.MIN_CELL
) -> DataFrame:
    """bands from editions up to ``cut`` tested on later ones, four ways of grouping."""
    low, high = fixed.BAND_QUANTILES
    cases = materialize(flag_large(levels.where(
        (F.col("horizon") == horizon) & F.col("level_error_own").isNotNull() & F.col("projected_growth_pct").isNotNull())), "retrospective_cases")
    train = cases.where(F.col("edition_period") <= cut)
    test = cases.where(F.col("edition_period") > cut)
    edges = quantile_edges(train, ["horizon"], "projected_growth_pct")
    cells = materialize(wide_statistics(classify(train, edges, ["horizon"]), ["horizon"]), "retrospective_cells")
    own = grouped_quantiles(train, ["entity"], {"e": "level_error_own"}, {"_lo": ("e", low), "_hi": ("e", high)})
    rows = with_cells(classify(test, edges, ["horizon"]), cells, ["horizon"], min_cell).join(own, "entity", "left")
    by_cell = F.when(F.col("_cell") != "all", F.col("_q0"))

    def method(name: str, stats_lo: Column, stats_hi: Column) -> Column:
        return F.struct(F.lit(name).alias("method"), stats_lo.alias("lo"), stats_hi.alias("hi"))

    by_class, by_group = F.col("_class"), F.col("_group")
    long = rows.select(
        "large", "grp", "weight", "level_error_own", F.explode(F.array(
            method("class x group", by_cell["lo"], by_cell["hi"]), method("class", by_class["lo"], by_class["hi"]),
            method("group", by_group["lo"], by_group["hi"]), method("own history", F.col("_lo"), F.col("_hi")),
        )).alias("m"),
    ).select("*", "m.*").where("lo IS NOT NULL AND hi IS NOT NULL").withColumn(
        "inside", expr.covered("lo", "hi", "level_error_own")).drop("m")
    return summarise(
        materialize(long, "retrospective_bands"), ["method"],
        [F.count(F.lit(1)).alias("cases"), (F.avg("inside") * 100).alias("coverage_pct"),
         (F.avg(F.when(F.col("large"), F.col("inside"))) * 100).alias("coverage_large_pct"),
         (F.avg(F.when(F.col("grp") == poorest, F.col("inside"))) * 100).alias("coverage_poorest_pct"),
         (expr.weighted_mean("inside", "weight") * 100).alias("coverage_weighted_pct")],
        {"w": F.col("hi") - F.col("lo")}, {"median_width": ("w", 0.5)},
    ).withColumn("verdict", coverage_verdict(F.col("coverage_pct"), (high - low) * 100))


def coverage_verdict(coverage: Column, target: float) -> Column:
    """Wide, narrow or right, five points around the target."""
    return F.when(coverage > target + 5, "cautious").when(coverage < target - 5, "too narrow").otherwise("right")


def band_facts(bands: DataFrame, horizon: int) -> DataFrame:
    """Link between projected growth and the upper bound, extreme downturn probabilities."""
    rows = bands.where((F.col("horizon") == horizon) & F.col("projected_growth_pct").isNotNull())
    return rows.agg(
        F.when(F.count(F.lit(1)) > 2, F.corr("projected_growth_pct", "high_pct")).alias("growth_bound_link"),
        F.min("downturn_pct").alias("lowest_downturn"), F.max("downturn_pct").alias("highest_downturn"),
    )
