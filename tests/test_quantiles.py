"""The distributed order statistics against brute force, with ties, NULLs and a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintara.operators.archive import as_of_join
from vintara.operators import expanding
from vintara.operators.quantiles import grouped_quantiles, quantiles_at, with_ranks
from vintara.session import materialize

rng = np.random.default_rng(7)


@pytest.fixture(scope="module")
def sample():
    hot = pd.DataFrame({"g": "hot", "x": np.round(rng.standard_t(2, 3000), 1)})  # many ties, heavy tails
    rest = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "x": rng.normal(size=400)})
    one = pd.DataFrame({"g": ["one", "two", "two"], "x": [4.0, 1.0, 3.0]})
    same = pd.DataFrame({"g": "same", "x": [2.5] * 50})
    return pd.concat([hot, rest, one, same], ignore_index=True)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_bracketed_quantiles_are_exact(spark, sample, accuracy):
    probabilities = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    got = grouped_quantiles(
        spark.createDataFrame(sample), ["g"], {"x": "x", "a": F.abs("x")},
        {**{n: ("x", p) for n, p in probabilities.items()}, "mad": ("a", 0.5)}, accuracy=accuracy).toPandas().set_index("g")
    for g, rows in sample.groupby("g"):
        for n, p in probabilities.items():
            assert got.loc[g, n] == pytest.approx(rows["x"].quantile(p)), (g, n)
        assert got.loc[g, "mad"] == pytest.approx(rows["x"].abs().median())


def test_null_keys_form_no_group_and_nan_is_no_value(spark, sample):
    rows = pd.concat([sample, pd.DataFrame({"g": [None], "x": [1.0]}), pd.DataFrame({"g": ["a", "nan"], "x": [np.nan, np.nan]})], ignore_index=True)
    got = grouped_quantiles(spark.createDataFrame(rows), ["g"], {"x": "x"}, {"m": ("x", 0.3)}).toPandas().set_index("g")["m"].dropna()
    expected = rows.dropna().groupby("g")["x"].quantile(0.3)
    pd.testing.assert_series_equal(got.sort_index(), expected.sort_index(), check_names=False)


def test_many_groups(spark):
    rows = pd.DataFrame({"g": np.arange(60_000) % 20_000, "x": rng.normal(size=60_000)})
    got = grouped_quantiles(spark.createDataFrame(rows), ["g"], {"x": "x"}, {"m": ("x", 0.5), "lo": ("x", 0.1)}).toPandas().set_index("g").sort_index()
    assert np.allclose(got["m"], rows.groupby("g")["x"].median()) and np.allclose(got["lo"], rows.groupby("g")["x"].quantile(0.1))


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_attached_to_rows(spark, sample, descending):
    half = pd.DataFrame({"g": "h", "x": np.append(np.full(3000, 1.5), rng.normal(size=3000))})  # one value holds half of a group
    rows = pd.concat([sample[["g", "x"]], half]).reset_index(drop=True)
    got = with_ranks(spark.createDataFrame(rows.assign(i=np.arange(len(rows)))).repartition(5), ["g"], "x", descending=descending).toPandas().set_index("i").sort_index()
    known = rows[rows["g"].notna() & rows["x"].notna()]
    by = known.groupby("g")["x"]
    assert len(got) == len(known)
    assert (got["rank_min"] == by.rank(method="min", ascending=not descending)).all() and (got["rank_avg"] == by.rank(method="average", ascending=not descending)).all()
    assert (got["n"] == by.transform("size")).all()


def test_any_number_of_quantiles_by_rank(spark, sample):
    values = sample[sample["g"].notna() & sample["x"].notna()]
    levels = [0.0, 0.013, 0.25, 1 / 3, 0.5, 0.77, 0.999, 1.0]
    wanted = pd.DataFrame([(g, i, p) for g in [*values["g"].unique(), "nowhere"] for i, p in enumerate(levels)], columns=["g", "i", "p"])
    got = quantiles_at(spark.createDataFrame(values[["g", "x"]]), ["g"], "x", spark.createDataFrame(wanted)).toPandas()
    assert len(got) == len(levels) * values["g"].nunique()
    for r in got.itertuples():
        assert r.q == pytest.approx(np.quantile(values[values["g"] == r.g]["x"], r.p), abs=1e-12)


def test_expanding_samples_against_their_definition(spark):
    """Values enter cells at some time and leave some at a later one; every time sees what is there."""
    values = np.round(rng.normal(size=400), 1)
    rows = [("a" if k % 3 else "b", float(x), int(rng.integers(1, 6)), 1) for k, x in enumerate(values)]
    rows += [(c, x, min(t + 2, 7), -1) for c, x, t, _ in rows[::4]]
    outcomes = [(c, y, t, 0) for c in "ab" for y in (-4.0, 0.0, 0.3, 5.0) for t in (1, 4, 6)]
    events = spark.createDataFrame(rows + outcomes, "cell string, x double, t int, w long").groupBy("cell", "x", "t", F.expr("w = 0").alias("o")).agg(F.sum("w").alias("w")).where("w <> 0 OR o").drop("o")
    times = [1, 2, 3, 4, 5, 6]

    def held(cell, v):
        here = [(x, w) for c, x, t, w in rows if c == cell and t <= v]
        return np.repeat(*map(np.array, zip(*[(x, sum(w for y, w in here if y == x)) for x in sorted({x for x, _ in here})])))

    for per_bucket in (expanding.PER_BUCKET, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(expanding, "PER_BUCKET", per_bucket)
            patch.setattr(expanding, "AT_ONCE", 4)
            placed = expanding.in_buckets(events)
            got = expanding.quantiles(placed, times, {"lo": 0.1, "mid": 0.5}).toPandas()
            assert len(got) == 12
            for r in got.itertuples():
                assert [r.lo, r.mid] == pytest.approx(np.quantile(held(r.cell, r.v), [0.1, 0.5]))
            scores = expanding.crps(placed, times).toPandas()
            assert len(scores) == len(outcomes)
            for r in scores.itertuples():
                x = held(r.cell, r.v)
                assert r.crps == pytest.approx(np.abs(x - r.y).mean() - np.abs(x[:, None] - x[None, :]).mean() / 2)
    sums = expanding.totals(events, times, {"n": "w"}).toPandas()
    assert all(r.n == len(held(r.cell, r.v)) for r in sums.itertuples())


def test_as_of_join_against_a_plain_search(spark):
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 200), "t": rng.integers(0, 500, 200)}).drop_duplicates(["k", "t"])
    right["v"] = np.arange(len(right), dtype=float)
    left = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 80), "at": rng.integers(-10, 520, 80)}).drop_duplicates()
    left["id"] = np.arange(len(left))
    got = as_of_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "at", "t", "v", width=13).toPandas().set_index("id")["v"]
    for r in left.itertuples():
        known = right[(right["k"] == r.k) & (right["t"] <= r.at)].sort_values("t")
        assert (np.isnan(got[r.id]) if known.empty else got[r.id] == known["v"].iloc[-1])


def test_many_groups_spread_over_cells_are_counted_before_they_are_sent(spark):
    """A row belongs to several cells: the plan counts rows by what makes a cell, and no sketch is kept for each."""
    rows = [(i % 3, i % 5, "AB"[i % 2] if i % 7 else None, float((i * 37) % 101) if i % 11 else None, float(i % 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "h int, cls int, grp string, x double, tied double")
    members = F.filter(F.array(F.concat(F.lit("c"), "cls"), F.concat(F.lit("g"), "grp"), F.lit("all")), lambda m: m.isNotNull())
    targets = {"lo": ("x", 0.1), "mid": ("x", 0.5), "hi": ("x", 0.9), "tie": ("t", 0.3)}
    got = grouped_quantiles(df, ["h"], {"x": "x", "t": "tied"}, targets, spread=("cell", members, ["cls", "grp"])).toPandas().set_index(["h", "cell"])
    pdf = df.toPandas()
    assert len(got) == 3 * (5 + 2 + 1)
    for (h, cell), row in got.iterrows():
        part = pdf[pdf.h == h]
        part = part if cell == "all" else part[part.cls == int(cell[1:])] if cell[0] == "c" else part[part.grp == cell[1:]]
        for name, column, p in (("lo", "x", 0.1), ("mid", "x", 0.5), ("hi", "x", 0.9), ("tie", "tied", 0.3)):
            assert abs(row[name] - part[column].dropna().quantile(p)) < 1e-9


def test_rows_are_sent_to_the_cells_that_want_their_value_only(spark):
    """What sends a row to its cells is a small table by class and group; edges are made once, and null classes and groups keep their rows."""
    rows = [(i % 3, i % 5 if i % 13 else None, "AB"[i % 2] if i % 7 else None, float((i * 37) % 4001) / 8) for i in range(4000)]
    df = materialize(spark.createDataFrame(rows, "h int, cls int, grp string, x double"), "sent_rows")
    members = F.filter(F.array(F.concat(F.lit("c"), "cls"), F.concat(F.lit("g"), "grp"), F.lit("all")), lambda m: m.isNotNull())
    for bounded in (False, True):
        found = grouped_quantiles(df, ["h"], {"x": "x"}, {"lo": ("x", 0.1234), "hi": ("x", 0.9)}, bounded, spread=("cell", members, ["cls", "grp"]))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "concat(" not in plan and "percentile_approx" not in plan
        got, pdf = found.toPandas().set_index(["h", "cell"]), df.toPandas()
        assert len(got) == 3 * (5 + 2 + 1)
        for (h, cell), row in got.iterrows():
            part = pdf[pdf.h == h]
            part = part if cell == "all" else part[part.cls == int(cell[1:])] if cell[0] == "c" else part[part.grp == cell[1:]]
            assert abs(row["lo"] - part["x"].quantile(0.1234)) < 1e-9 and abs(row["hi"] - part["x"].quantile(0.9)) < 1e-9


def test_any_number_of_quantiles_of_rows_in_several_groups(spark):
    """A row belongs to several cells; rows are counted by what makes a cell, and only the buckets that hold a wanted rank are read again."""
    rows = [(i % 2, i % 5, "AB"[i % 2] if i % 7 else None, float((i * 7919) % 3001) if i % 11 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "h int, cls int, grp string, x double")
    members = F.filter(F.array(F.concat(F.lit("c"), "cls"), F.concat(F.lit("g"), "grp"), F.lit("all")), lambda m: m.isNotNull())
    wanted = [(h, cell, k, (k - 0.5) / 9) for h in (0, 1) for cell in ("c0", "c3", "gA", "gB", "all", "nowhere") for k in range(1, 10)]
    got = quantiles_at(df, ["h", "cell"], "x", spark.createDataFrame(wanted, "h int, cell string, k int, p double"), spread=("cell", members, ["cls", "grp"])).toPandas()
    pdf = df.toPandas().dropna(subset=["x"])
    own = lambda h, cell: pdf[(pdf.h == h) & (True if cell == "all" else pdf.cls == int(cell[1:]) if cell[0] == "c" else pdf.grp == cell[1:])]
    known = {(h, cell) for h, cell, _, _ in wanted if cell != "nowhere" and len(own(h, cell))}
    assert {(r.h, r.cell) for r in got.itertuples()} == known and len(got) == 9 * len(known)
    for r in got.itertuples():
        assert r.q == pytest.approx(own(r.h, r.cell)["x"].quantile(r.p), abs=1e-9)
