import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintara.operators import bands as b, evaluation as e, revisions as r, vintages as v

EV = "entity string, name string, grp string, edition string, season string, edition_period int, period int, horizon int, weight double, value double, realised_own double, realised_other double"


def evaluation(spark, values, own, horizons=None):
    horizons = horizons or list(range(len(values)))
    return spark.createDataFrame(
        [("A", "A", "HIC", "S2015", "S", 2015, 2015 + h, h, 1.0, x, o, o) for h, x, o in zip(horizons, values, own)], EV)


def test_wide_sheet(spark):
    wide = spark.createDataFrame(
        [("Kosovo", "KOS", 2019, "3.5", ".", "4.0"), ("World", "G001", 2019, "3.0", "2.9", "2.8")], "name string, entity string, period int, S2018x string, F2018x string, F2020x string")
    extra = spark.createDataFrame([("KOSOVO", "KOS", 2019, "F2020", 9.0), ("KOSOVO", "KOS", 2019, "S2021", 5.0)], "name string, entity string, period int, edition string, value double")
    got = {(x.entity, x.edition): x for x in v.wide_to_long(wide, "x", extra).collect()}
    assert ("XKX", "F2018") not in got and got[("XKX", "F2020")].value == 4.0  # the sheet wins, "." is missing
    assert got[("XKX", "S2021")].name == "Kosovo" and got[("XKX", "S2021")].horizon == -2 and not got[("XKX", "S2021")].is_projection
    assert {x.entity for x in v.drop_aggregates(v.wide_to_long(wide, "x")).collect()} == {"XKX"}


def test_reference_is_the_autumn_re_estimate_or_any(spark):
    rows = [("A", 2018, "S2019", "S", 2019, -1, 1.0), ("A", 2018, "F2019", "F", 2019, -1, 2.0), ("A", 2018, "F2020", "F", 2020, -2, 3.0)]
    schema = "entity string, period int, edition string, season string, edition_period int, horizon int, value double"
    df = spark.createDataFrame(rows, schema)
    assert v.own_reference(df).first()["realised_own"] == 2.0
    assert v.own_reference(df.where("season = 'S'")).first()["realised_own"] == 1.0


def test_naive_forecast_knows_nothing_after_v_minus_2(spark):
    ref = spark.createDataFrame([("A", y, 1.0) for y in range(2010, 2016)] + [("A", 2016, 1000.0), ("B", 2010, 1.0), ("B", 2016, 1.0)], "entity string, period int, realised_own double")
    got = {(x.entity, x.edition_period): x.naive for x in v.naive_forecast(ref).collect()}
    assert got[("A", 2017)] == 1.0 and got[("A", 2018)] == pytest.approx((1000 + 3) / 4)
    assert got[("A", 2014)] == 1.0 and ("A", 2013) not in got  # three of four periods are enough, two are not
    assert not [k for k in got if k[0] == "B"]


def test_level_error_closed_form_and_breaks(spark):
    ahead, later = [3.1, -0.4, 5.2, 1.7, 0.6], [2.4, 0.9, -6.5, 1.7, 2.2]
    path, real = np.cumprod(1 + np.array(ahead) / 100), np.cumprod(1 + np.array(later) / 100)
    got = e.level_errors(evaluation(spark, ahead, later)).orderBy("horizon").collect()
    assert [x.level_error_own for x in got] == pytest.approx(list((path / real - 1) * 100))
    late = e.level_errors(evaluation(spark, ahead, [*later[:3], None, later[4]])).orderBy("horizon").collect()
    assert [x.level_error_own is None for x in late] == [False] * 3 + [True] * 2
    assert late[4].projected_growth_pct == pytest.approx((path[4] - 1) * 100)
    gap = e.level_errors(evaluation(spark, ahead[:4], later[:4], [0, 1, 4, 5])).orderBy("horizon").collect()
    assert [x.level_error_own is None for x in gap] == [False, False, True, True]


def test_worst_growth_starts_at_horizon_1(spark):
    rows = e.level_errors(evaluation(spark, [1.0, 1.0, 1.0, 1.0], [-5.0, 1.0, 2.0, -0.5])).orderBy("horizon").collect()
    assert [x.worst_realised for x in rows] == [None, 1.0, 1.0, -0.5]


def test_clustered_interval_and_two_clusters(spark):
    rows = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 3.0), ("x", 2, -2.0), ("x", 2, 0.0), ("y", 1, 5.0)], "k string, period int, e double")
    got = {x.k: x for x in e.clustered_interval(rows, ["k"], "e", "period").collect()}
    se = (2 / 1 * (3.0 ** 2 + 3.0 ** 2)) ** 0.5 / 4
    assert got["x"].ci_low == pytest.approx(0.5 - 1.96 * se) and got["x"].ci_high == pytest.approx(0.5 + 1.96 * se)
    assert got["y"].ci_low is None


def test_efficiency_recovers_a_line(spark):
    rows = spark.range(200).select(F.lit(1).alias("horizon"), (F.col("id") % 50 * 0.1).alias("value")).withColumn("realised_own", 0.5 + 0.6 * F.col("value"))
    got = e.efficiency(rows).first()
    assert got.slope == pytest.approx(0.6) and got.intercept == pytest.approx(0.5)


def test_classes_of_one_to_ten(spark):
    rows = spark.range(1, 11).select(F.lit(0).alias("h"), F.col("id").cast("double").alias("projected_growth_pct"))
    from vintara.functions import expr

    edges = e.quantile_edges(rows, ["h"], "projected_growth_pct")
    got = [x.c for x in rows.join(edges, "h").select("projected_growth_pct", expr.digitize("projected_growth_pct", F.col("edges")).alias("c")).orderBy("projected_growth_pct").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_no_revision_across_a_missing_edition(spark):
    rows = [("A", 2020, f"{s}{y}", s, y, 2020 - y, x) for s, y, x in (("S", 2018, 3.0), ("F", 2018, 2.5), ("F", 2019, 2.0), ("S", 2020, 1.0), ("F", 2020, 0.5))]
    df = spark.createDataFrame(rows, "entity string, period int, edition string, season string, edition_period int, horizon int, value double")
    got = {x.edition: (x.revision, x.previous_revision) for x in r.successive_revisions(df).collect()}
    assert got["S2018"] == (None, None) and got["F2018"] == (-0.5, None)
    assert got["F2019"] == (None, None) and got["S2020"] == (-1.0, None) and got["F2020"] == (-0.5, -1.0)


def test_large_flag_is_by_edition(spark):
    rows = [(5, ed, f"E{i}", float(i)) for ed in ("S2010", "F2010") for i in range(30)]
    df = spark.createDataFrame(rows, "horizon int, edition string, entity string, weight double")
    got = e.flag_large(df).where("large").groupBy("edition").count().collect()
    assert [x["count"] for x in got] == [20, 20]


def test_base_year_change_and_unknowns(spark):
    rows = [("S1", "A", "SNA 1993", "2010"), ("F1", "A", " SNA 2008", "2010"), ("F1", "B", "SNA 2008", "2015"), ("S1", "C", "Not applicable", "1"), ("F1", "C", "x", "2")]
    df = spark.createDataFrame(rows, "edition string, entity string, methodology string, base_year string")
    got = {x.entity: x for x in r.method_changes(df, "S1", "F1").collect()}
    assert got["A"].standard_changed is True and got["A"].base_year_changed is False
    assert got["B"].standard_changed is None and got["C"].standard_changed is None and got["C"].base_year_changed is True


PROJECTED = "entity string, name string, period int, edition string, season string, edition_period int, horizon int, value double, is_projection boolean"
PANEL = "entity string, period int, grp string, is_forecast boolean, growth double, nominal double"


def test_evaluation_meets_its_references_by_entity_alone(spark):
    rows = [(c, c, 2015 + h, "F2015", "F", 2015, h, 1.0 + h, True) for c in ("A", "B") for h in range(3)]
    rows += [("A", "A", p, f"F{p + 1}", "F", p + 1, -1, float(p), False) for p in (2015, 2016)]
    panel = [("A", 2015, "HIC", False, 1.5, 10.0), ("A", 2015, None, False, 2.5, 20.0), ("A", None, "LIC", False, 9.0, 9.0), (None, 2016, "LIC", False, 9.0, 9.0)]
    ev = v.evaluate(spark.createDataFrame(rows, PROJECTED), spark.createDataFrame(panel, PANEL))
    got = sorted((x.entity, x.period, x.realised_own, x.realised_other, x.weight) for x in ev.where("entity = 'A'").collect())
    assert got[:2] == [("A", 2015, 2015.0, 1.5, 10.0), ("A", 2015, 2015.0, 2.5, 20.0)]  # two panel rows stay two
    assert got[2:] == [("A", 2016, 2016.0, None, None), ("A", 2017, None, None, None)] and ev.where("entity = 'B' AND weight IS NULL").count() == 3
    history = spark.createDataFrame([("A", 2016, "LMC"), ("A", None, "UMC")], "entity string, fiscal int, grp string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grouped = b.groups_at_edition(e.level_errors(ev), history)
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        assert {x.grp for x in grouped.where("entity = 'A'").collect()} == {"LMC"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = re.findall(r"SortMergeJoin \[([^]]*)\]", plan)
    assert joins and all("," not in keys and keys.startswith("entity#") for keys in joins)
    assert not re.search(r"hashpartitioning\(entity#\d+, edition#", plan)
