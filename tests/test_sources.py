"""Readers of staged files, and what callers bring."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline import plugins
from loomline.operators import regression
from loomline.sources import files as S


def test_wide_sheets_and_industries(spark, tmp_path):
    (tmp_path / "w.csv").write_text('iso,name,Y2019,Y2020,note\nusa,gdp,"1,200.5",x,n\nfra,gdp,7,NaN,n\n')
    got = S.read_melted(spark, str(tmp_path / "w.csv"), "iso", "w", variable_col="name").collect()
    assert sorted((r.code, r.date, r.variable, r.value) for r in got) == [("FRA", dt.date(2019, 1, 1), "gdp", 7.0), ("USA", dt.date(2019, 1, 1), "gdp", 1200.5)]
    (tmp_path / "k.csv").write_text("country,code,var,_1995,_1996\nDE,C,VA,1.5,\nDE,D,VA,2,3\n")
    got = S.read_industries(spark, str(tmp_path / "k.csv"), "k").collect()
    assert sorted((r.code, r.industry, r.date.year, r.value) for r in got) == [("DE", "C", 1995, 1.5), ("DE", "D", 1995, 2.0), ("DE", "D", 1996, 3.0)]


def test_fixed_layout_and_guard(spark, tmp_path):
    (tmp_path / "f.txt").write_text("HEAD\nAB 2020  1.5\nCD 2021     \n")
    d = S.read_fixed(spark, str(tmp_path / "f.txt"), {"state": (1, 2), "year": (4, 7), "value": (9, 13)}, r"^[A-Z]{2} ")
    assert sorted(map(tuple, d.collect())) == [("AB", "2020", "1.5"), ("CD", "2021", None)]
    assert S.guard(d, {"state": "^AB$", "year": r"^\d{4}$"}) is d
    for marks in ({"state": "^XX$"}, {"nothing": "."}):
        with pytest.raises(ValueError):
            S.guard(d, marks)


def test_dialects_and_labour(spark, tmp_path):
    (tmp_path / "a.csv").write_text("LOCATION,TIME,Value,SEX\nusa,2020-Q2,3,T\nusa,2020-Q3,4,M\n")
    (tmp_path / "b.csv").write_text("geo,TIME_PERIOD,OBS_VALUE,SEX\nusa,2020-Q2,9,T\nfra,2020-Q2,5,T\n")
    assert [(r.code, str(r.date), r.value) for r in S.read_sdmx(spark, str(tmp_path / "a.csv"), "u", "s", "location", SEX="T").collect()] == [("USA", "2020-04-01", 3.0)]
    got = S.read_labour(spark, {"location": str(tmp_path / "a.csv"), "geo": str(tmp_path / "b.csv")}, {"urate": {"SEX": "T"}})
    assert sorted((r.code, r.value, r.source) for r in got.collect()) == [("FRA", 5.0, "geo"), ("USA", 3.0, "location")]


def test_corpus_series_map_and_country(spark, tmp_path):
    (tmp_path / "c.csv").write_text('date,text,lang\n2020-01-02,"two\nlines, ""quoted""",en\n,no date,en\n2020-01-03,,de\n')
    (r,) = S.read_corpus(spark, str(tmp_path / "c.csv"), metadata=("lang",)).collect()
    assert (str(r.date), r.text, r.metadata) == ("2020-01-02", 'two\nlines, "quoted"', {"lang": "en"}) and r.url.startswith("file://")
    for name, v in (("a", 1.0), ("b", float(np.e))):
        (tmp_path / f"{name}.csv").write_text(f"date,value\n2020-01-01,{v}\n")
    p = S.read_series_map(spark, lambda i: str(tmp_path / f"{i}.csv"), {"a": ("x", "level"), "b": ("y", "log")}, "USA", "s")
    got = S.load_country(p, "USA", ["x", "y"]).first()
    assert (got.x, round(got.y, 12)) == (1.0, 1.0)


def test_what_callers_bring(spark):
    c = plugins.Catalog()
    c.register("one", lambda s: s.createDataFrame([("2020-01-01", 1)], "date string, value int"), family="oil")
    c.register("two", lambda s: s.createDataFrame([("2020-01-01", 2)], "date string, value int"))
    assert c.names() == ["one", "two"] and c.names(family="oil") == ["one"]
    assert sorted((r.name, r.value) for r in c.load(spark, "one", "two").collect()) == [("one", 1.0), ("two", 2.0)]
    with pytest.raises(KeyError):
        c.register("one", None)
    r = np.random.default_rng(0)
    d = spark.createDataFrame([(i, float(x), float(z), float(2 * x + z)) for i, (x, z) in enumerate(r.standard_normal((60, 2)))], "t int, x double, z double, y double")
    curve = plugins.specification_curve(d, [{"controls": []}, {"controls": ["z"]}], lambda f, s: regression.ols(f, [], "y", ["x", *s["controls"]], "x")).collect()
    assert {x.spec for x in curve} == {0, 1} and abs(next(x.beta for x in curve if x.spec == 1) - 2) < 1e-9 and curve[0].beta <= curve[1].beta
    for kind in ("wild", "block"):
        draws = plugins.refit(d, "t", "x", np.mean, 50, kind)
        a, b = ([x.value for x in draws.orderBy("draw").collect()] for _ in range(2))
        assert a == b and len(set(a)) > 40
    v = spark.createDataFrame([("s", f"2020-0{o}-01", f"2020-0{w}-15", float(o * w)) for w in (3, 4) for o in range(1, w)], "series_id string, observation_date string, vintage_date string, value double")
    got = {r.vintage_date: (r.forecast, r.revision) for r in plugins.forecast_revisions(v, lambda s: s.iloc[-1]).collect()}
    assert got == {"2020-03-15": (6.0, None), "2020-04-15": (12.0, 6.0)}
