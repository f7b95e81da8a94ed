import math

import pytest
from pyspark.sql import functions as F

from vintara.functions import expr, fixed


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_cagr_and_degenerate_cases(spark):
    n = F.lit(None).cast("double")
    got = values(spark, expr.cagr(F.lit(100.0), F.lit(200.0), 10), expr.cagr(n, F.lit(200.0), 10), expr.cagr(F.lit(-5.0), F.lit(200.0), 10),
                 expr.cagr(F.lit(100.0), F.lit(0.0), 10), expr.cagr(F.lit(100.0), F.lit(200.0), 0))
    assert got[0] == pytest.approx((2 ** 0.1 - 1) * 100)
    assert got[1:] == [None] * 4


def test_interval_score_inside_below_above(spark):
    low, high = F.lit(-10.0), F.lit(10.0)
    assert values(spark, *[expr.interval_score(low, high, F.lit(y)) for y in (0.0, -15.0, 14.0)]) == pytest.approx([20, 70, 60])


def test_classes_are_left_closed_and_bins_right_closed(spark):
    edges = F.array(F.lit(2.0), F.lit(4.0))
    assert values(spark, *[expr.digitize(F.lit(x), edges) for x in (1.0, 2.0, 3.0, 4.0)]) == [1, 2, 2, 3]
    assert values(spark, *[expr.right_closed_bin(F.lit(x), [0.0, 2.0, 4.0]) for x in (0.0, 2.0, 2.5, 4.0)]) == [0, 0, 1, 1]


def test_error_inversion_swaps_the_sides(spark):
    assert values(spark, expr.inverted_bound(F.lit(10.0)))[0] == pytest.approx(-9.0909, abs=1e-4)


def test_missing_values_and_codes(spark):
    got = values(spark, expr.finite(F.lit(float("nan"))), expr.finite(F.lit(float("inf"))), expr.finite(F.lit(1.5)), expr.recode(F.lit("KOS")),
                 expr.recode(F.lit("FRA")), expr.known_text(F.lit(" Not applicable ")), expr.per_capita(F.lit(1.0), F.lit(0.0)))
    assert got == [None, None, 1.5, "XKX", "FRA", None, None]


def test_edition_order_and_step(spark):
    got = values(spark, expr.edition_order(F.lit(2019), F.lit("S")), expr.edition_order(F.lit(2019), F.lit("F")), expr.edition_order(F.lit(2020), F.lit("S")))
    assert got[1] - got[0] == 1 and got[2] - got[1] == 1
    assert values(spark, expr.step_label(F.lit(-1), F.lit("F")), expr.step_label(F.lit(2), F.lit("S"))) == ["autumn, re-estimate", "spring, horizon 2"]
    assert expr.editions_around(2009) == ["S2008", "F2008", "S2009", "F2009", "S2010", "F2010"]


def test_inverse_normal(spark):
    got = values(spark, expr.inverse_normal(F.lit(0.9)), expr.inverse_normal(F.lit(0.5)))
    assert got[0] == pytest.approx(fixed.Z90) and math.isclose(got[1], 0.0, abs_tol=1e-12)


def test_inverse_normal_over_its_whole_range(spark):
    from statistics import NormalDist

    levels = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.31, 0.5, 0.6, 0.9249, 0.9251, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in [*levels, 0.0, 1.0, None]], "p double").select("p", expr.inverse_normal("p").alias("z")).collect()
    for r in got:
        assert r.z is None if r.p in (None, 0.0, 1.0) else r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)
