import json

import pytest
from pyspark.sql import functions as F

from vintara.sources import archives as ar, documents as d, tables as t


def body(spark, *docs):
    return spark.createDataFrame([(json.dumps(x),) for x in docs], "body string")


def test_indexed_series(spark):
    """Seven periods in reverse, three entities, two indicators; every third observation is missing or says nothing."""
    periods, entities, indicators = [str(y) for y in range(1996, 1989, -1)], [("NOR", "Norway"), ("CHL", None), ("KEN", "Kenya")], ["LUR", "PCPI"]
    series, expected = {}, {}
    for i, (code, name) in enumerate(entities):
        for j, indicator in enumerate(indicators):
            texts = {k: None if (i + j + k) % 3 == 0 else "" if (i + j + k) % 3 == 1 and k == 4 else f"{100 * i + 10 * j + k}.25" for k in range(len(periods)) if k != 5}
            series[f"{i}:{j}:0"] = {"observations": {str(k): [v] for k, v in texts.items()}}
            expected |= {(code, name or code, indicator, int(periods[k])): float(v) for k, v in texts.items() if v}
    doc = {"structure": {"dimensions": {"series": [{"values": [{"id": c, **({"name": n} if n else {})} for c, n in entities]}, {"values": [{"id": x} for x in indicators]}, {"values": [{"id": "Q"}]}],
                                        "observation": [{"values": [{"id": y} for y in periods]}]}}, "dataSets": [{"series": series}]}
    assert {(x.entity, x.name, x.indicator, x.period): x.value for x in d.indexed_series(body(spark, doc), "body").collect()} == expected


def test_cube_of_four_dimensions(spark):
    """Sizes 2, 4, 3 and 5, the places neither first nor last; cells in gaps of one, two and eleven."""
    names, codes = ["unit", "geo", "time", "age"], [["EUR", "NAC"], ["PT", "GR", "IE", "LU"], ["2007", "2003", "2011"], list("abcde")]
    cells, expected = {}, []
    for u in range(2):
        for g, geo in enumerate(codes[1]):
            for p, period in enumerate(codes[2]):
                for a in range(5):
                    index = ((u * 4 + g) * 3 + p) * 5 + a
                    if index % 4 and not 60 <= index <= 70:
                        cells[str(index)] = index / 8
                        expected.append((geo, int(period), index / 8))
    doc = {"id": names, "size": [2, 4, 3, 5], "dimension": {n: {"category": {"index": {c: k for k, c in enumerate(cs)}}} for n, cs in zip(names, codes)}, "value": cells}
    assert sorted((x.geo, x.period, x.value) for x in d.cube(body(spark, doc), "body").collect()) == sorted(expected)


def test_nested_values_skip_what_is_not_a_number(spark):
    doc = {"values": {"LP": {"KOS": {"1994": -0.5, "1997": "1e3", "1998": "", "199x": 4}, "MEX": {"1995": True, "1996": "12.75"}}, "GGR": {"OEMDC": {"1996": " 8 ", "1999": 0}}}}
    real = spark.createDataFrame([("KOS",), ("MEX",)], "entity string")
    got = {(x.indicator, x.entity, x.period): (x.value, x.is_forecast, x.is_aggregate) for x in d.nested_values(body(spark, doc), "body", 1997, real).collect()}
    assert got.pop(("GGR", "OEMDC", 1999)) == (0.0, True, True)
    assert {k: v for k, v in got.items() if k[0] == "LP"} == {("LP", "XKX", 1994): (-0.5, False, False), ("LP", "XKX", 1997): (1000.0, True, False), ("LP", "MEX", 1996): (12.75, False, False)}


def test_indicator_pages(spark):
    page = [{"page": 1}, [{"countryiso3code": "FRA", "country": {"value": "France"}, "date": "2020", "value": 3}, {"countryiso3code": "FRA", "country": {"value": "France"}, "date": "2021", "value": None},
                          {"countryiso3code": "", "country": {"value": "?"}, "date": "2020", "value": 1}, {"countryiso3code": "WLD", "country": {"value": "World"}, "date": "2020", "value": 9}]]
    got = {x.entity: (x.value, x.is_aggregate) for x in d.indicator_pages(body(spark, page), "body", "g", spark.createDataFrame([("FRA",)], "entity string")).collect()}
    assert got == {"FRA": (3.0, False), "WLD": (9.0, True)}


def test_concept_records(spark):
    doc = {"source": {"data": [{"variable": [{"concept": "Time", "id": "YR1999"}, {"concept": "Country", "id": "FRA"}], "value": 2.0}, {"variable": [], "value": None}]}}
    assert [tuple(x) for x in d.concept_records(body(spark, doc), "body").collect()] == [("FRA", 1999, 2.0)]


def test_group_history(spark):
    """Years on both sides of the century, a class of two stars, blanks, an empty and an unknown class, and a row that is no entity."""
    wide = spark.createDataFrame([("URY", " UM", "H**", None, "x"), ("NPL", "L ", "", "LM", "L"), ("total", "H", "H", "H", "H")],
                                 "entity string, FY97 string, FY00 string, FY51 string, FY49 string")
    assert {tuple(x) for x in t.group_history(wide).collect()} == {
        ("URY", 1997, "UMC"), ("URY", 2000, "HIC"), ("NPL", 1997, "LIC"), ("NPL", 1951, "LMC"), ("NPL", 2049, "LIC")}


def test_edition_names_and_refusal_to_guess(spark):
    # Two archives with a gap between them, the later of autumn; a month that names no half-year counts as autumn.
    flows = spark.createDataFrame([("OUT_1997_JUN_VINTAGE",), ("OUT_2003_SEP_VINTAGE",), ("OUT_2001_XXX_VINTAGE",), ("NOW",)], "flow string")
    want = {"OUT_1997_JUN_VINTAGE": "S1997", "OUT_2003_SEP_VINTAGE": "F2003", "OUT_2001_XXX_VINTAGE": "F2001", "NOW": "S2004"}
    assert {x.flow: x.edition for x in ar.edition_names(flows, 2012, span=8).collect()} == want
    for reach in (2011, 2013):
        with pytest.raises(Exception, match="cannot be dated"):
            ar.edition_names(flows, reach, span=8).collect()


ARCHIVE = "entity string, value double, edition string"


def archived(spark, path):
    return {(x.edition, x.value) for x in ar.read_archive(spark, path, ARCHIVE).collect()}


def test_archive_is_written_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([("S1", "A", 1.0), ("F1", "A", 2.0), ("F1", "B", 2.5), (None, "A", 7.0)], "edition string, entity string, value double")
    assert ar.archive_once(rows, path, "edition") == ["F1", "S1"]
    later = spark.createDataFrame([("F1", "A", 99.0), ("S2", "A", 3.0)], "edition string, entity string, value double")
    assert ar.archive_once(later, path, "edition") == ["S2"] and ar.archive_once(later, path, "edition") == []
    assert archived(spark, path) == {("S1", 1.0), ("F1", 2.0), ("F1", 2.5), ("S2", 3.0)}
    assert ar.archived_partitions(spark, path) == ["F1", "S1", "S2"]
    index = {r.partition: (r["values"], r.entities, r.indicators) for r in ar.Folder(spark, path).index(ar.ARCHIVE_INDEX).collect()}
    assert index == {"S1": (1, 1, None), "F1": (2, 2, None), "S2": (1, 1, None)}
    assert ar.archived_partitions(spark, str(tmp_path / "nowhere")) == []


@pytest.mark.parametrize("step", ["move", "commit"])
def test_an_append_that_dies_is_invisible_and_can_be_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([("S1", "A", 1.0), ("F1", "A", 2.0)], "edition string, entity string, value double")
    ar.archive_once(rows.where("edition = 'S1'"), path, "edition")

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(ar.Folder, step, die)
        with pytest.raises(KeyboardInterrupt):
            ar.archive_once(rows.withColumn("value", F.lit(-1.0)), path, "edition")
    assert archived(spark, path) == {("S1", 1.0)}
    assert ar.archive_once(rows, path, "edition") == ["F1"]
    assert archived(spark, path) == {("S1", 1.0), ("F1", 2.0)}


def test_complement_updates_keep_the_old_copy_until_they_are_done(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "complement"), "indicator string, entity string, period int, value double, edition string"
    read = lambda: {(x.edition, x.value) for x in ar.read_complement(spark, path, schema).collect()}
    rows = lambda *values: spark.createDataFrame([("g", "A", 2024, v, e) for e, v in values], schema)
    main = lambda *editions: spark.createDataFrame([("g", e) for e in editions], "indicator string, edition string")
    assert read() == set()
    assert ar.update_complement(rows(("F2024", 1.0), ("S2024", 1.0), ("S2023", 1.0)), main(), path) == 1
    with monkeypatch.context() as patch:
        patch.setattr(ar.Folder, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            ar.update_complement(rows(("F2024", 2.0)), main("S2023"), path)
    assert read() == {("F2024", 1.0), ("S2024", 1.0), ("S2023", 1.0)}
    assert ar.update_complement(rows(("F2024", 3.0), ("S2025", 3.0)), main("S2023"), path) == 2
    assert read() == {("F2024", 3.0), ("S2024", 1.0), ("S2025", 3.0)}
    ar.update_complement(rows(("S2023", 4.0)), main(), path)
    assert read() == {("F2024", 3.0), ("S2024", 1.0), ("S2025", 3.0), ("S2023", 4.0)}


def test_complement_replaces_served_editions_only(spark):
    schema = "indicator string, edition string, entity string, period int, value double"
    old = spark.createDataFrame([("g", "F2024", "A", 2024, 1.0), ("g", "S2025", "A", 2025, 1.0), ("g", "S2023", "A", 2023, 1.0)], schema)
    new = spark.createDataFrame([("g", "S2025", "A", 2025, 2.0), ("g", "S2025", "A", 2035, 2.0)], schema)
    main = spark.createDataFrame([("g", "S2023")], "indicator string, edition string")
    assert {(x.edition, x.value) for x in ar.complement_editions(old, new, main).collect()} == {("F2024", 1.0), ("S2025", 2.0)}


def test_scan_turns_nan_into_null(spark, tmp_path):
    path = str(tmp_path / "world")
    spark.createDataFrame([(2000, float("nan")), (2001, 1.0)], "period int, value double").write.parquet(path)
    assert {x.period: x.value for x in t.scan(spark, path, "world").collect()} == {2000: None, 2001: 1.0}
