import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabweave.operators import conditional, features, metrics, mvdist, ranks, risk, synthesizer, timeseries
from tabweave.plans import catalogue
from tabweave.sources import formats, readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(frame, columns):
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame[columns].astype(object).to_numpy()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_disclosure_golden(spark):
    real = spark.createDataFrame([("a", 1, "u"), ("a", 1, "v"), ("b", 1, "u"), ("b", 2, "u"), ("c", 1, "v")], ["k1", "k2", "y"])
    syn = spark.createDataFrame([("a", 1, "v"), ("a", 1, "v"), ("a", 1, "u"), ("b", 2, "u"), ("d", 1, "u")], ["k1", "k2", "y"])
    r = risk.disclosure_risk(real, syn, ["k1", "k2"], "y")
    assert r.n_real_uniques == 3 and r.replicated_uniques == pytest.approx(1 / 3)
    assert r.attributes["y"] == pytest.approx({"match_rate": 0.6, "cap": 2 / 3, "cap_uniques": 1.0, "cap_baseline": 0.6})


def test_disclosure_numeric_golden(spark):
    real = spark.createDataFrame([(1, 100.0, "a"), (1, 110.0, "a"), (2, 200.0, "b"), (3, None, "c")], "k int, y double, g string")
    syn = spark.createDataFrame([(1, 104.0, "a"), (2, 300.0, "b"), (2, 300.0, "b"), (4, 1.0, "b")], "k int, y double, g string")
    r = risk.disclosure_risk(real, syn, ["k"], ["y", "g"], tolerance=0.05)
    assert r.attributes["y"]["cap"] == pytest.approx(1 / 3) and r.attributes["g"]["match_rate"] == 0.75 and r.attributes["g"]["cap"] == 1
    assert r.n_real_uniques == 2 and r.replicated_uniques == 0


def test_gower_golden():
    n = np.nan
    real = np.array([[1, n, 2, n, n], [n, 5, 3, n, n], [10, 10, 10, 10, 10]]) / np.array([9, 5, 8, 1, 1])
    syn = np.array([[n, n, 2.9, n, n]]) / np.array([9, 5, 8, 1, 1])
    d, w = risk.nearest(syn, real, np.ones(5, bool), exclude=False)
    assert d[0] == pytest.approx(1.0125 / 5 + 0, abs=1e-6) or d[0] == pytest.approx((1 + 0.1 / 8) / 5)
    d, w = risk.nearest(syn, real, np.ones(5, bool), exclude=True)
    assert d[0] == pytest.approx(0.1 / 8) and w[0] == pytest.approx(1 / 5)


def test_lag_windows_golden(spark):
    s = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], ["t", "x"])
    a = timeseries.ts_windows(s, "t", ["x"], 3).orderBy("t").collect()
    assert len(a) == 7 and tuple(a[0])[1:] == (4.0, 3.0, 2.0, 1.0)
    b = timeseries.ts_windows(s, "t", ["x"], 2, horizon=3).orderBy("t").collect()
    assert tuple(b[0])[1:] == (5.0, 2.0, 1.0)


def test_gaps_are_interpolated(spark):
    s = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, 3.0), (5, None)], "t int, x double")
    assert [r["x"] for r in timeseries.interpolated(s, "t", "x").orderBy("t").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_feature_golden():

    f = features.Features(pd.DataFrame({"x": [1, 2, 3, None], "g": ["a", "b", "a", "a"]}))
    assert f.names == ["x..NA", "x", "g==b"]
    m = f.matrix(pd.DataFrame({"x": [100, None], "g": ["zzz", "b"]}))
    assert m[0, 1] == pytest.approx(98 / np.std([1, 2, 3, 2], ddof=1)) and m[1].tolist() == [1, 0, 1]


@pytest.fixture(scope="module")
def mixed(spark):
    x = mvdist.r_mvdist(spark, 4000, {"num": "norm", "cnt": {"dist": "pois", "rate": 3.0}, "fac": mvdist.margin_categorical(["a", "b", "c"], [0.5, 0.3, 0.2])}, corr=0.6, seed=4)
    return x.select("num", F.col("cnt").cast("int").alias("cnt"), F.col("fac").cast("string").alias("fac", metadata={}), (F.col("num") > 0.3).alias("flag"), F.date_add(F.lit("2020-01-01").cast("date"), F.round(F.col("num") * 100).cast("int")).alias("day"), F.when(F.col("num") < 1, F.col("num") * 2).alias("gap"))


def test_types_dependence_and_missingness_survive(spark, mixed):
    model = synthesizer.fit(mixed)
    out = synthesizer.generate(model, spark, 4000, seed=9)
    assert out.dtypes == mixed.dtypes
    R = model.correlation()
    assert R.loc["num", "cnt"] == pytest.approx(0.6, abs=0.06) and abs(R.loc["num", "fac"]) == pytest.approx(0.6, abs=0.08)
    m = {r["variable"]: r for r in metrics.marginal_metrics(mixed, out).collect()}
    assert m["num"]["ks"] < 0.05 and m["fac"]["tvd"] < 0.05 and abs(m["gap"]["missing_real"] - m["gap"]["missing_synthetic"]) < 0.03
    again = synthesizer.generate(model, spark, 4000, seed=9, partitions=7)
    hash_ = lambda df: df.agg(F.bit_xor(F.xxhash64(*df.columns))).first()[0]
    assert hash_(out) == hash_(again) != hash_(synthesizer.generate(model, spark, 4000, seed=10))


def test_neutral_perturbation_changes_nothing_and_scale_only_its_column(spark, mixed):
    model = synthesizer.fit(mixed.select("num", "cnt", "fac"))
    base = synthesizer.generate(model, spark, 300).toPandas()
    assert base.equals(synthesizer.generate(model, spark, 300, perturb=synthesizer.Perturbation()).toPandas())
    moved = synthesizer.generate(model, spark, 300, perturb=synthesizer.Perturbation(scale={"num": 2.0})).toPandas()
    assert moved[["cnt", "fac"]].equals(base[["cnt", "fac"]]) and not moved["num"].equals(base["num"])
    with pytest.raises(ValueError, match="unknown"):
        synthesizer.generate(model, spark, 3, perturb=synthesizer.Perturbation(noise={"nope": 1.0}))


def test_strata_ids_and_augmentation(spark, mixed):
    df = mixed.withColumn("id", F.concat(F.lit("r"), F.monotonically_increasing_id())).withColumn("k", F.when(F.col("num") > 0, "hi").otherwise("lo")).select("id", "k", "num")
    out = synthesizer.generate(synthesizer.fit(df, by=["k"], ids=["id"]), spark, 100, stratum_sizes="proportional").toPandas()
    assert out["id"].is_unique and out["id"].iloc[0].startswith("syn") and (out[out.k == "hi"].num > 0).all()
    both = synthesizer.augment(mixed.select("num", "fac"), n=50, label="synthetic")
    assert both.groupBy("synthetic").count().count() == 2


def test_list_columns_are_rejected(spark):
    with pytest.raises(TypeError, match="Unsupported column class"):
        synthesizer.fit(spark.createDataFrame([([1],), ([2],)], "a array<int>"))


def test_conditional_models(spark, mixed):
    df = mixed.withColumn("id", F.monotonically_increasing_id())
    tree = conditional.fit_tree(df, "gap", ["num", "fac"])
    assert tree.draw(df, "id", 1).count() == df.count()
    smooth = conditional.fit_smooth(df, "gap", ["num", "fac"])
    drawn = smooth.draw(df, "id", 1).join(df, "id").agg(F.corr("draw", F.col("num") * 2)).first()[0]
    assert drawn > 0.95
    name, scores = conditional.select_engine(df, "gap", ["num"], "id", folds=3)
    assert name == "smooth" and scores["smooth"] <= scores["tree"]
    nominal = conditional.fit_nominal(df, "fac", ["num"])
    assert {r["draw"] for r in nominal.draw(df, "id", 1).select("draw").distinct().collect()} <= {"a", "b", "c"}


def test_conditional_models_inside_the_fit(spark, mixed, tmp_path):
    df = mixed.select("num", "fac", F.when(F.col("num") < 1.5, F.pow("num", 2) + 0.1 * F.rand(3)).alias("y"))
    for settings in ({"engine": "cart"}, {"engine": "gam", "residual": "global"}, {"engine": "cart", "residual": "none", "calibration": "none"}):
        out = synthesizer.synthesize(df, n=1500, seed=3, nonlinear_target="y", **settings)
        assert out.dtypes == df.dtypes and out.count() == 1500
        seen = out.filter("y is not null")
        assert seen.agg(F.corr("y", F.pow("num", 2))).first()[0] > 0.85  # the copula alone gives about 0
        assert 0.02 < 1 - seen.count() / 1500 < 0.12
    auto = synthesizer.fit(df, nonlinear_target="y", engine="auto", cv={"folds": 2, "max_rows": 800})
    assert auto.pooled.conditional.engine in ("cart", "gam") and set(auto.pooled.conditional.scores) == {"tree", "smooth"}
    with pytest.raises(ValueError, match="closeness"):
        synthesizer.generate(auto, spark, 5, closeness=0.5)
    by = df.withColumn("k", F.when(F.col("num") > 0, "hi").otherwise("lo"))
    out = synthesizer.synthesize(by, n=400, by=["k"], nonlinear_target="y", file=f"{tmp_path}/o.csv")
    assert out.count() == 400 and os.path.isdir(f"{tmp_path}/o.csv")
    label = synthesizer.synthesize(df.select("num", F.when(F.abs("num") > 1, "far").otherwise("near").alias("c")), n=800, nominal_target="c")
    assert {r["c"] for r in label.select("c").distinct().collect()} == {"far", "near"}
    with pytest.raises(ValueError, match="exclude"):
        synthesizer.fit(df, nonlinear_target="y", nominal_target="fac")
    assert synthesizer.synthesize(np.arange(50.0), n=20).columns == ["x"] and synthesizer.synthesize(np.ones((9, 2)), n=3).columns == ["V1", "V2"]


def test_t_copula_and_strata(spark):
    x = mvdist.r_copula(spark, 4000, "t", 3, corr=0.5, df=4.0, seed=3)
    gaps = x.select(F.when(F.col("U1") > 0.2, F.col("U1")).alias("a"), F.col("U2").alias("b"), (F.col("U3") > 0.5).alias("k"))
    model = synthesizer.fit(x, copula="t")
    assert model.correlation().loc["U1", "U2"] == pytest.approx(0.5, abs=0.08) and 2 <= model.pooled.copula.df <= 8
    assert synthesizer.fit(gaps, copula="t", by=["k"]).n_pair((True,)).loc["a", "b"] > 1000
    with pytest.raises(ValueError, match="unknown stratum"):
        synthesizer.fit(gaps, by=["k"]).correlation(("nope",))


def test_series_methods(spark):
    s = spark.range(60).select(F.col("id").alias("t"), F.when(F.col("id") != 7, F.sin(F.col("id") / 5.0)).alias("x"))
    for method in ("block", "stationary", "iid"):
        with pytest.warns(UserWarning, match="interpolated"):
            model = timeseries.fit_series(s, "t", ["x"], method=method, start=2000.0, frequency=12.0)
        out = timeseries.dated(timeseries.generate_series(model, spark, 30, sims=2), model)
        assert out.groupBy("sim").count().orderBy("sim").collect() == [(1, 30), (2, 30)] and out.filter("t = 13").first()["time"] == 2001.0
    with pytest.warns(UserWarning, match="not used"):
        timeseries.fit_series(s.dropna(), "t", ["x"], method="block", order=2)


def test_plot_data(spark, mixed):
    from tabweave.operators import plotdata

    assert plotdata.percent(0.1234) == "12.3%" and plotdata.picked(mixed, mixed, numbers=True) == ["num", "cnt", "day", "gap"]
    with pytest.warns(UserWarning, match="first 5"):
        assert len(plotdata.pair_points(mixed, points=10).columns) == 5
    with pytest.raises(ValueError, match="at most 5"):
        plotdata.pair_points(mixed, mixed.columns)
    tiles = plotdata.association_tiles(mixed.select("num", "fac"), mixed.select("num", "fac"))
    assert tiles.count() == 4 and tiles.agg(F.max("difference")).first()[0] == 0
    bars = plotdata.distance_histogram(spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.5), ("b", None)], "source string, distance double"), 2)
    assert sorted((r["source"], r["bin"], r["share"]) for r in bars.collect()) == [("a", 0, 0.5), ("a", 1, 0.5), ("b", 1, 1.0)]


def test_series_models(spark):
    s = spark.range(400).select(F.col("id").alias("t"), F.sin(F.col("id") / 5).alias("x"), F.cos(F.col("id") / 7).alias("y"))
    model = timeseries.fit_series(s, "t", ["x", "y"], max_lag=4)
    paths = timeseries.generate_series(model, spark, 50, sims=3)
    assert paths.groupBy("sim").count().orderBy("sim").collect() == [(1, 50), (2, 50), (3, 50)] and model.order >= 1
    assert timeseries.bootstrap(s, "t", ["x"], 30, "iid").count() == 30


def test_generators(spark):
    x = mvdist.r_mvnorm(spark, 5000, [1.0, 2.0], [[1, 0.5], [0.5, 2]]).agg(F.avg("X1"), F.covar_samp("X1", "X2")).first()
    assert x[0] == pytest.approx(1, abs=0.06) and x[1] == pytest.approx(0.5, abs=0.08)
    d = mvdist.r_dirichlet(spark, 500, [0.01, 1.0, 2.0]).select((F.col("X1") + F.col("X2") + F.col("X3")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert d[0] == pytest.approx(1) and d[1] == pytest.approx(1)
    assert mvdist.r_mvmixture(spark, 200, [0.5, 0.5], [[0.0], [9.0]], [[[1.0]], [[1.0]]], return_component=True).select("component").distinct().count() == 2
    assert mvdist.r_mvskewnorm(spark, 2000, alpha=5.0).agg(F.skewness("X1")).first()[0] > 0.5
    assert mvdist.census_sim(spark, 200).count() == 200 and mvdist.r_mvt(spark, 10, 3).count() == 10


def test_calibration_finds_a_reachable_target(spark, mixed):
    model = synthesizer.fit(mixed.select("num", "cnt"))
    c = synthesizer.calibrate(model, mixed.select("num", "cnt"), 0.3, lambda a, b: b.select(F.corr("num", "cnt")).first()[0], n=1500, grid=(0.0, 0.5, 1.0), refine=2)
    assert c.attainable and abs(c.value - 0.3) < 0.12


@pytest.mark.parametrize("name", ["a.csv", "a.tsv", "a.ndjson", "a.json", "a.json.gz", "a.parquet", "a.feather", "a.dta", "a.csv.gz"])
def test_round_trips(spark, tmp_path, name):
    df = spark.createDataFrame([(1, 1.5, "x", True), (2, None, 'a "b"', False), (3, 2.5, None, True)], "i int, d double, s string, b boolean")
    path = writers.write_data(df, f"{tmp_path}/{name}")
    back = readers.read_data(spark, path, template=df)
    got, want = (sorted(map(tuple, x.select("i", "d", "b").collect()), key=str) for x in (back, df))
    assert got == want and {r["s"] for r in back.select("s").collect()} - {"", None} == {"x", 'a "b"'}


def test_json_keeps_every_row(spark, tmp_path):
    df = spark.range(100).repartition(4).withColumn("t", F.expr("timestamp_micros(id * 1234567)"))
    for name in ("o.json", "o.json.bz2", "one.json"):
        path = writers.write_data(df.coalesce(1) if name[:3] == "one" else df, f"{tmp_path}/{name}")
        back = readers.read_data(spark, path, template=df)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    df.drop("t").write.json(f"{tmp_path}/lines.json")
    assert readers.read_data(spark, f"{tmp_path}/lines.json").count() == 100
    (tmp_path / "pretty.json").write_text('{\n "id": 1\n}')
    assert readers.read_data(spark, f"{tmp_path}/pretty.json").count() == 1


def test_times_of_every_shape(spark):
    shapes = {
        "2024/03/05": "2024-03-05 00:00:00", "2024-03-05": "2024-03-05 00:00:00", "2024-03-05 10:11:12.345": "2024-03-05 10:11:12.345000", "2024-03-05 10:11+02:00": "2024-03-05 08:11:00",
        "2024-03-05T10:11": "2024-03-05 10:11:00", "2024/03/05 10:11:12": "2024-03-05 10:11:12", "2024-03-05T10:11:12.5Z": "2024-03-05 10:11:12.500000", "2024-03-05T10:11:12-0530": "2024-03-05 15:41:12",
        " 2024-3-5 1:02 ": "2024-03-05 01:02:00", "2024-03-05 99:99": "2024-03-05 00:00:00", "2024-13-05": None, "soon": None, "": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in shapes], "t string").select("t", readers.parse_datetime(F.col("t")).alias("p")).collect()
    assert {r["t"]: None if r["p"] is None else str(r["p"]) for r in got} == shapes


def test_formats_and_coercion(spark):
    assert formats.detect("x/y.CSV.gz")[0].name == "csv" and formats.detect("x.bin", "pq")[0].name == "parquet"
    with pytest.raises(ValueError):
        formats.detect("a.parquet.gz")
    assert len(formats.supported_formats()) == 15
    times = ["2024-01-01T10:00:00Z", "2024-01-01T13:00:00+03:00", "2024-01-01T06:00:00-0400", "2024/01/01 12:00:00", "2024-01-01 12:00"]
    got = spark.createDataFrame([(t,) for t in times], ["t"]).select(readers.parse_datetime(F.col("t"), "Europe/Bucharest").alias("t")).collect()
    assert {str(r["t"]) for r in got} == {"2024-01-01 10:00:00"}
    with pytest.warns(UserWarning):
        assert writers.stata_names(["a b", "1x", "if"]) == ["a_b", "v1x", "if_"]


def test_generate_to_file(spark, tmp_path, mixed):
    model = synthesizer.fit(mixed.select("num", "cnt"))
    info = writers.generate_to_file(model, spark, 1000, f"{tmp_path}/big.parquet", chunk_size=400)
    assert info["chunks"] == 3 and len(glob.glob(f"{tmp_path}/big.parquet/*.parquet")) == 3 and spark.read.parquet(info["path"]).count() == 1000


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    assert sorted(str(r["r"]) for r in ranks.average_rank(df, "x", "r").collect() if r["x"] is not None) == ["1.0", "2.5", "2.5"]
