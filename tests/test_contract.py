"""The registered queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "t3_panel", "d4_report_panel", "d8_reference_period", "e2_common_panel_rank", "f4_evaluation", "f7_bias_by_horizon", "f12_level_errors",
    "f21_f27_f32_projection_bands", "f30_downturn_risk", "g3_b10_revision_summary", "g6_publication_revisions", "c7_as_of_join", "g15_levels_by_edition",
    "h1_h2_realtime_predictions", "h3_h4_band_scores", "l10_smooth_bands", "p7_p8_multipliers", "s2_scenarios", "a15_indexed_series", "a16_cube",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(a, b):
    if a is None or b is None or (isinstance(a, float) and math.isnan(a)) or (isinstance(b, float) and math.isnan(b)):
        return (a is None or a != a) and (b is None or b != b)
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-3) if isinstance(a, float) else a == b


def test_every_query_has_an_oracle():
    assert set(entry.plans.queries()) == set(entry.plans.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    rows = lambda t: sorted(map(tuple, t[columns].astype(object).where(t[columns].notna(), None).to_numpy().tolist()), key=lambda r: [str(x) if not isinstance(x, float) else f"{x:.2f}" for x in r])
    for a, b in zip(rows(got), rows(want)):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)
