from math import isclose

from pyspark.sql import functions as F

from loomline.functions import stats
from loomline.operators import panel, scoring, shares, text, windows
from loomline.sources import panel as src
from loomline.streaming import measures


def test_distributions():
    assert isclose(stats.chi2_sf(3.841459, 1), 0.05, abs_tol=1e-6) and isclose(stats.chi2_sf(50, 20), 0.000221477, abs_tol=1e-7)
    assert isclose(stats.f_sf(3.0, 4, 20), 0.043104, abs_tol=1e-4) and isclose(stats.t_sf2(2.085963, 20), 0.05, abs_tol=1e-6)
    assert stats.beta_inc(2, 3, 0) == 0 and stats.beta_inc(2, 3, 1) == 1


def test_band_pass_weights_cancel():
    w = windows.band_pass_weights()
    assert abs(w[0] + 2 * sum(w[1:])) < 1e-12


def test_scores(spark):
    d = spark.createDataFrame([(1.0, 0.0, 1.0, [0.0, 2.0, 4.0])], "y double, mu double, s double, x array<double>")
    r = d.select(scoring.normal_cdf(F.col("y")).alias("p"), scoring.crps_gaussian(F.col("y"), F.col("mu"), F.col("s")).alias("c"), scoring.crps_ensemble(F.col("y"), F.col("x"), True).alias("f"), scoring.crps_ensemble(F.col("y"), F.col("x"), False).alias("e")).first()
    assert isclose(r.p, stats.norm_cdf(1), abs_tol=2e-7) and isclose(r.c, 0.602441, abs_tol=1e-5)
    pairs = sum(abs(a - b) for a in (0, 2, 4) for b in (0, 2, 4))
    assert isclose(r.f, 5 / 3 - pairs / 12) and isclose(r.e, 5 / 3 - pairs / 18)


def test_text(spark):
    d = spark.createDataFrame([("Not very uncertain. Uncertain, deeply! UNCERTAINTY",), (None,), ("",)], "t string")
    t = F.col("t")
    got = d.select(text.count_terms(t, ["uncertain"]).alias("a"), text.count_terms_unnegated(t, ["uncertain"], ["not"]).alias("b"), F.size(text.sentences(t)).alias("s")).collect()
    # the second hit is the fourth word after the negation
    assert [tuple(r) for r in got] == [(2, 0, 3), (0, 0, 0), (0, 0, 0)]
    money = spark.createDataFrame([("cost $5.2 billion, or 7,100 million",), ("1.5 trillion",), ("a rise of 25 bps by 0.5 percentage points",), (None,)], "t string")
    assert [tuple(round(x, 9) for x in r) for r in money.select(text.billions(t), text.basis_points(t)).collect()] == [(7.1, 0.0), (1500.0, 0.0), (0.0, 50.0), (0.0, 0.0)]
    more = spark.createDataFrame([("$3B and 900M",), ("by 2 percentage points, 150 basis points",), ("2 percentage points",), ("1,200.5 Million",)], "t string")
    assert [tuple(round(x, 9) for x in r) for r in more.select(text.billions(t), text.basis_points(t)).collect()] == [(3.0, 0.0), (0.0, 200.0), (0.0, 0.0), (1.2005, 0.0)]
    cjk = spark.createDataFrame([("不确定不确定",)], "t string")
    assert cjk.select(text.count_terms(t, ["不确定"], "zh")).first()[0] == 2


def test_sources_and_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,value\n2020-01-01,1.5\n2020-02-01,.\n2020-03-01,NaN\n")
    (tmp_path / "b.csv").write_text("REF_AREA,TIME_PERIOD,OBS_VALUE\nusa,2020-Q2,3\nusa,2020-05,4\nusa,2021,5\nEA,2020-01-01,x\n")
    a = src.read_series_csv(spark, str(tmp_path / "a.csv"), "USA", "y")
    assert [(r.code, str(r.date), r.value) for r in a.collect()] == [("USA", "2020-01-01", 1.5)]
    b = src.read_sdmx_csv(spark, str(tmp_path / "b.csv"), "y", "s")
    assert sorted((str(r.date), r.value) for r in b.collect()) == [("2020-04-01", 3.0), ("2020-05-01", 4.0), ("2021-01-01", 5.0)]
    assert panel.check_panel(b) == {"duplicates": 0, "aggregates": 0}
    src.write_panel(b, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    wide = spark.createDataFrame([("2020-01-01", 1.0, 2.0)], "date string, GDP_20200401 double, GDP_20200701 double")
    assert sorted(str(r.vintage_date) for r in src.unpivot_vintages(wide, "GDP").collect()) == ["2020-04-01", "2020-07-01"]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"2024-01-{1 + i % 20:02d} 10:00:00", "abc"[i % 3], "success" if i % 2 else "error", "live", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "t string, source string, outcome string, fallback_used string, r double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    for name, f in (("health", measures.health), ("rv", lambda d: measures.daily_variance(d, "source"))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(df).collect()))
    v = spark.createDataFrame([("s", "2020-01-01", "2020-02-01", 1.0), ("s", "2020-01-01", "2020-03-01", 2.0)], "series_id string, observation_date string, vintage_date string, value double")
    v.write.parquet(str(tmp_path / "v"))
    for value in (1.0, 5.0):
        v.where("vintage_date = '2020-03-01'").withColumn("value", F.lit(value)).write.mode("append").parquet(str(tmp_path / "v"))
        measures.upsert_vintages(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.vintage_date, r.value) for r in measures.latest(spark, str(tmp_path / "out")).collect()) == [("2020-02-01", 1.0), ("2020-03-01", 5.0)]
    measures.compact(spark, str(tmp_path / "out"))
    assert len([x for x in (tmp_path / "out").iterdir() if x.name.startswith("v=")]) == 1
    assert sorted((r.vintage_date, r.value) for r in measures.latest(spark, str(tmp_path / "out")).collect()) == [("2020-02-01", 1.0), ("2020-03-01", 5.0)]


def test_last_arrival_of_a_batch_stands(spark, tmp_path):
    v = spark.createDataFrame([("s", "a", "b", 9.0, 1), ("s", "a", "b", 2.0, 3), ("s", "a", "b", 5.0, 2)], "series_id string, observation_date string, vintage_date string, value double, n int")
    v.coalesce(1).write.parquet(str(tmp_path / "v"))
    measures.upsert_vintages(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v")), str(tmp_path / "out"), str(tmp_path / "cp"), "n").awaitTermination()
    assert [r.value for r in measures.latest(spark, str(tmp_path / "out")).collect()] == [2.0]


def test_exposure_needs_most_coefficients(spark):
    import pytest

    shares_ = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5)], "geo string, industry string, share double")
    betas = spark.createDataFrame([("x", 2.0)], "industry string, beta double")
    with pytest.raises(ValueError):
        shares.exposure(shares_, betas)
    assert shares.exposure(shares_, betas, None).first().exposure == 1.0
