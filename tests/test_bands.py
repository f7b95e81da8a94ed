import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintara.operators import archive as a, bands as b, calibration as c, draws as w, longrun as l, population as pop, scenarios as sc

WORLD = [(y, -1.0 if y in (1975, 1982, 1991, 2009, 2020) else 2.0) for y in range(1961, 2026)]


@pytest.fixture(scope="module")
def world(spark):
    return spark.createDataFrame(WORLD, "period int, value double")


def cases(spark, first=1990, last=2006, entities=30, jump=1998):
    rng = np.random.default_rng(0)
    rows = []
    for m in range(first, last + 1):
        for i in range(entities):
            err = float(rng.normal(0, 5)) + (50.0 if m > jump else 0.0)
            rows.append((f"E{i}", "HIC" if i % 2 else "LIC", f"S{m}", "S", m, m + 5, 5, 1.0, float(i), float(rng.normal()), float(rng.normal(2)), err))
    return spark.createDataFrame(rows, "entity string, grp string, edition string, season string, edition_period int, period int, horizon int, weight double, projected_growth_pct double, worst_realised double, worst_projected double, level_error_own double")


def test_crisis_probability_and_knowledge_at_date(spark, world):
    keys = spark.createDataFrame([(5, 2025), (5, 2000)], "d int, upto int")
    got = {x.upto: x.pi for x in b.crisis_probabilities(keys, world, F.col("d"), F.col("upto")).collect()}
    for upto in (2025, 2000):
        years = [y for y, _ in WORLD if y <= upto]
        bad = [y for y, x in WORLD if x < 0 and y <= upto]
        starts = [y for y in years if y + 4 <= years[-1]]
        assert got[upto] == pytest.approx(np.mean([any(y <= z <= y + 4 for z in bad) for y in starts]))
    assert [x.period for x in b.recession_periods(world, 2009).orderBy("period").collect()] == [1975, 1982, 1991, 2009]


def test_realtime_training_never_sees_the_future(spark):
    preds = c.realtime_predictions(cases(spark), 5, 2000, min_cell=100).where("method = 'all'").toPandas()
    # Errors jump after 1998: at edition v only m <= v - 7 is known, so the band of 2005 ignores the jump.
    assert preds[preds["v"] <= 2005]["hi"].max() < 20 and preds["v"].min() == 2000
    train = c.training_sizes(cases(spark), 5, 2000, 2006).collect()
    assert [x.v for x in sorted(train)] == list(range(2000, 2007)) and all(x.latest == x.v - 7 and x.n == 30 * (x.v - 1996) for x in train)


def test_group_known_at_the_edition(spark):
    rows = spark.createDataFrame([("A", "S", 2010, "HIC"), ("A", "F", 2010, "HIC"), ("B", "S", 2010, "HIC")], "entity string, season string, edition_period int, grp string")
    history = spark.createDataFrame([("A", 2010, "LIC"), ("A", 2011, "LMC")], "entity string, fiscal int, grp string")
    assert {(x.entity, x.season): x.grp for x in b.groups_at_edition(rows, history).collect()} == {("A", "S"): "LIC", ("A", "F"): "LMC", ("B", "S"): "HIC"}


def test_cascade_over_many_groups(spark):
    """20,000 groups of a few cases each: no cell stands, some classes do, and every row keeps its own group's statistics."""
    levels = spark.range(80_000).select(
        F.concat(F.lit("E"), F.col("id").cast("string")).alias("entity"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("g"), (F.col("id") % 20_000).cast("string"))).alias("grp"),
        F.lit(1).alias("horizon"), (F.col("id") % 5 + 1).cast("int").alias("cls"), (F.col("id") % 97).cast("double").alias("level_error_own"), F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0).alias("worst_realised"))
    rows = levels.where("id % 40 = 0").select("entity", "grp", "horizon", F.when(F.expr("level_error_own % 3 > 0"), F.col("cls")).alias("cls"))
    found = b.with_cells(rows, b.wide_statistics(levels, ["horizon"]), ["horizon"], 100).toPandas()
    assert len(found) == 2000 and set(found["_cell"].str.split("|").str[0]) == {"class", "all"}
    assert all((r["_q0"]["n"] == 16_000) == (r["cls"] == r["cls"]) and r["_all"]["n"] == 80_000 for _, r in found.iterrows())
    known = found[found["grp"].notna()]
    assert len(known) and all(g["n"] <= 4 for g in known["_group"]) and found[found["grp"].isna()]["_group"].isna().all()


def test_bands_cell_class_and_overall_fallbacks(spark, world):
    rows = []
    for grp, slow, fast in (("HIC", 120, 120), ("LIC", 0, 0)):
        rows += [(f"{grp}{i}", grp, f"S{1990 + i % 10}", "S", 1990 + i % 10, 1995, 5, 1.0, 10.0 + i * 1e-6, None, -5 + 10 * i / 119) for i in range(slow)]
        rows += [(f"{grp}f{i}", grp, f"S{1990 + i % 10}", "S", 1990 + i % 10, 1995, 5, 1.0, 50.0 + i * 1e-6, None, 10 + 20 * i / 119) for i in range(fast)]
    levels = spark.createDataFrame(rows, "entity string, grp string, edition string, season string, edition_period int, period int, horizon int, weight double, projected_growth_pct double, worst_realised double, level_error_own double")
    entities = spark.createDataFrame([("X", "X", "HIC"), ("Y", "Y", "LIC"), ("Z", "Z", None)], "entity string, name string, grp string")
    current = spark.createDataFrame([("X", 5, 60.0), ("Y", 5, 60.0)], "entity string, horizon int, projected_growth_pct double")
    got = {x.entity: x for x in b.projection_bands(levels, current, entities, world, 5, min_cell=40).where("horizon = 5").collect()}
    assert [got[k].based_on for k in "XYZ"] == ["cell", "class", "all"]
    assert got["X"].low_pct == pytest.approx((1 / (1 + got["X"].error_p90 / 100) - 1) * 100) and got["X"].low_pct < got["X"].high_pct


def test_bootstrap_of_equal_blocks_is_degenerate_and_deterministic(spark):
    rows = spark.createDataFrame([("m", p, 2.0) for p in range(6) for _ in range(3)], "method string, period int, x double")
    run = lambda: c.bootstrap_intervals(rows, ["method"], {"n": F.count("x"), "s": F.sum("x")}, {"mean": F.col("s") / F.col("n")}, draws=50).first()
    assert run().mean_ci_low == 2.0 and run().mean_ci_high == 2.0 and run() == run()


def test_revisions_since_publication(spark):
    rows = [(200001, "A", 1999, 1.0), (200101, "A", 1999, 2.0), (200501, "A", 1999, 3.0), (200501, "A", 1990, 9.0), (200501, "A", 2004, 4.0)]
    archive = spark.createDataFrame(rows, "version int, entity string, period int, value double")
    got = {(x.period, x.delay): x.value for x in a.revisions_since_publication(archive).collect()}
    assert got == {(1999, "1"): 2.0, (1999, "2"): 2.0, (1999, "5"): 3.0, (1999, "latest"): 3.0, (2004, "latest"): 4.0}


def test_power_law_recovery_and_widening(spark):
    law = lambda h, s: 100 * np.expm1(s * (0.02 + 0.05 * (h + 1.0) ** 0.7))
    rows = [(g, h, 200, 12, float(law(h, -1)), 0.0, float(law(h, 1))) for g in ("all", "HIC") for h in range(0, 16)]
    q = spark.createDataFrame(rows, "member string, horizon int, cases int, edition_periods int, p10 double, p50 double, p90 double")
    bands = l.smooth_bands(q, 10, 40)
    got = bands.where("member = 'all' AND horizon = 30").first()
    assert got.p90_smooth == pytest.approx(law(30, 1), rel=1e-6) and got.last_fitted == 15
    f = l.widening(bands, 5).where("member = 'HIC' AND horizon = 20").first()
    assert f.low_factor == pytest.approx((1 + law(5, 1) / 100) / (1 + law(20, 1) / 100), rel=1e-6) and f.high_factor > 1 > f.low_factor


def test_drift_ignores_the_last_two_periods(spark):
    real = spark.createDataFrame([("A", y, 2.0) for y in range(2000, 2012)] + [("A", 2012, 90.0)], "entity string, period int, growth double")
    got = {x.edition_period: x.drift_pct for x in l.drifts(real).collect()}
    assert got[2013] == pytest.approx(2.0) and got[2014] > 5 and 2008 not in got


def test_third_of_a_width_with_ties(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (1, 2, 2, 2, 3, 4)], "horizon int, width double")
    got = pop.width_third(rows, ["horizon"], "width").orderBy("width").toPandas()
    ranks = pd.Series([1, 2, 2, 2, 3, 4]).rank(method="average")
    expected = np.array(pop.THIRDS)[np.minimum(2, np.floor(3 * (ranks - 0.5) / 6)).astype(int)]
    assert got["third"].tolist() == expected.tolist()


def test_quantile_levels_and_ties_in_name_order(spark):
    rows = spark.createDataFrame([("A", "S2000", 0.9), ("A", "F2000", 0.1), ("A", "S2001", 0.5), ("B", "S2000", 0.5), ("B", "F2000", 0.5)], "entity string, edition string, u double")
    got = {(x.entity, x.edition): x.level_q for x in w.quantile_levels(rows, ["entity"], "edition").collect()}
    assert got[("A", "S2000")] == pytest.approx(5 / 6) and got[("A", "F2000")] == pytest.approx(1 / 6) and got[("A", "S2001")] == pytest.approx(0.5)
    assert got[("B", "F2000")] == 0.25 and got[("B", "S2000")] == 0.75


def test_revisions_are_assigned_in_chronological_blocks(spark):
    editions = spark.createDataFrame([(e,) for e in ("F2001", "S2000", "S2001", "F2000")], "edition string")
    revs = spark.createDataFrame([(1998,), (2000,)], "revision int")
    got = {x.draw: x.revision for x in w.assign_revisions(editions, revs).collect()}
    assert got == {"S2000": 1998, "F2000": 1998, "S2001": 2000, "F2001": 2000}


def test_growth_zone_fallbacks(spark):
    entities = spark.createDataFrame([("FRA", "ECS"), ("XXX", "ECS"), ("YYY", "SAS")], "entity string, region string")
    series = spark.createDataFrame([("FRA",), ("E_S4",), ("W",)], "zone string")
    got = {x.entity: (x.zone, x.zone_level) for x in sc.growth_zones(entities, series, {"ECS": "E_S4", "SAS": "S7"}).collect()}
    assert got == {"FRA": ("FRA", "own"), "XXX": ("E_S4", "region"), "YYY": ("W", "world")}


def test_long_run_extremes_by_the_whole_period(spark):
    rows = [("Z", s, 2030 + k, g ** k) for s, g in (("BAU1", 1.01), ("P", 0.99), ("Q", 1.03)) for k in range(4)]
    got = sc.long_run_growth(spark.createDataFrame(rows, "zone string, scenario string, period int, value double"), 2030, 2033).where("period = 2033").first()
    assert (got.scenario_low, got.scenario_high) == ("P", "Q") and got.g_central == pytest.approx(1.01 ** 3) and got.g_low == pytest.approx(0.99 ** 3)


def test_rows_are_joined_to_their_cells_without_a_shuffle(spark):
    """What a key, class and group lead to is written first, so the rows, which few keys would gather in few tasks, stay where they are."""
    past = cases(spark).withColumn("cls", (F.col("edition_period") % 5 + 1).cast("int")).withColumn("grp", F.when(F.col("weight") != 3, F.col("grp")))
    wide = b.wide_statistics(past, ["horizon"])
    got = b.with_cells(past, wide, ["horizon"], 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    pdf = got.toPandas()
    assert len(pdf) == past.count() and (pdf[pdf["grp"].isna()]["_cell"].str.startswith("class|")).all()
    sizes = past.groupBy("cls", "grp").count().toPandas().dropna()
    for r in sizes.itertuples():
        own = pdf[(pdf["cls"] == r.cls) & (pdf["grp"] == r.grp)]["_cell"].unique()
        assert list(own) == ([f"cell|{r.cls}|{r.grp}"] if r[3] >= 40 else [f"class|{r.cls}"])


def test_positions_of_past_revisions_are_ranked_once(spark):
    """The ranks are written with the grid of entities and revisions: neither its medians nor its rows make them again."""
    past = spark.createDataFrame([(r, f"E{i}", "small" if i % 2 else "large", float((i * 7 + r) % 5)) for r in (24, 27, 30) for i in range(20) if (i + r) % 4], "revision int, entity string, size string, z double")
    entities = spark.createDataFrame([(f"E{i}",) for i in range(22)], "entity string")
    got = w.population_levels(past, entities)
    assert "rank(" not in got._jdf.queryExecution().executedPlan().toString()
    levels, pdf = got.toPandas(), past.toPandas()
    pdf["u"] = (pdf.groupby("size")["z"].rank(method="average") - 0.5) / pdf.groupby("size")["z"].transform("size")
    known = pdf.set_index(["entity", "revision"])["u"]
    assert len(levels) == 22 * 3 and (levels.groupby("entity")["k"].max() == 3).all()
    for r in levels.itertuples():
        assert r.u == pytest.approx(known.get((r.entity, r.revision), pdf[pdf.revision == r.revision]["u"].median()))
