"""Queries of normal-based draws, conditional models and tables behind plots.

The normal distribution function and its inverse are rational functions, so that DuckDB
computes them from the same constants."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabweave.functions import special
from tabweave.functions.linalg import matrix_root
from tabweave.functions.rng import check_seed
from tabweave.functions.rng import uniform_block_sql as u_sql
from tabweave.operators import conditional, features, metrics, mvdist, plotdata, synthesizer
from tabweave.operators.marginals import fit_marginals
from tabweave.plans.registry import halves, query, r6, table, values


def horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(float(coefficients[0])) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def quantile_sql(p: str) -> str:
    """Normal quantile of a column."""
    q, r, s = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {s} <= 5 THEN {horner(f'({s} - 1.6)', special.Q_C)} / {horner(f'({s} - 1.6)', special.Q_D)} ELSE {horner(f'({s} - 5.0)', special.Q_E)} / {horner(f'({s} - 5.0)', special.Q_F)} END"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner(r, special.Q_A)} / {horner(r, special.Q_B)} ELSE sign({q}) * ({tail}) END)"


def normal_sql(x: str) -> str:
    """Normal distribution function of a column (within seven deviations)."""
    a = f"abs({x})"
    tail = f"exp(-({x}) * ({x}) / 2) * {horner(a, special.PHI_NUM)} / {horner(a, special.PHI_DEN)}"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def normals_sql(n: int, seed: int, tags: list[str], more: dict[str, str] | None = None) -> str:
    """i, independent normals z0, z1, ... of the tags, and further uniforms by name."""
    u = ", ".join([f"{u_sql(seed, t, 'i')} AS u{k}" for k, t in enumerate(tags)] + [f"{u_sql(seed, t, 'i')} AS {name}" for name, t in (more or {}).items()])
    z = ", ".join([f"{quantile_sql(f'u{k}')} AS z{k}" for k in range(len(tags))] + list(more or {}))
    return f"(SELECT i, {z} FROM (SELECT i, {u} FROM range({n}) t(i)))"


def mixed_sql(A: np.ndarray, k: int) -> str:
    return "(" + " + ".join(f"{float(a)!r} * z{j}" for j, a in enumerate(A[k])) + ")"


def rounded(df, names: list[str]):
    return df.select(*[r6(c).alias(c) for c in names])


S2 = np.array([[1.0, 0.5], [0.5, 2.0]])
ROOT = matrix_root(S2)


@query(f"SELECT round(1.0 + {mixed_sql(ROOT, 0)}, 6) AS X1, round(-2.0 + {mixed_sql(ROOT, 1)}, 6) AS X2 FROM {normals_sql(2000, 41, ['z0', 'z1'])}")
def normal_vectors(spark, d):
    return rounded(mvdist.r_mvnorm(spark, 2000, [1.0, -2.0], S2, seed=41), ["X1", "X2"])


@query(f"SELECT round({mixed_sql(ROOT, 0)} / sqrt(-ln(1 - c)), 5) AS X1, round({mixed_sql(ROOT, 1)} / sqrt(-ln(1 - c)), 5) AS X2 FROM {normals_sql(2000, 42, ['z0', 'z1'], {'c': 'chi'})}")
def t_vectors(spark, d):
    """Two degrees of freedom, whose chi-square quantile is a logarithm."""
    return mvdist.r_mvt(spark, 2000, 2.0, 0.0, S2, seed=42).select(F.round("X1", 5).alias("X1"), F.round("X2", 5).alias("X2"))


@query(f"SELECT round(exp(0.1 + {mixed_sql(0.5 * ROOT, 0)}), 6) AS X1, round(exp(0.1 + {mixed_sql(0.5 * ROOT, 1)}), 6) AS X2 FROM {normals_sql(2000, 43, ['z0', 'z1'])}")
def lognormal_vectors(spark, d):
    return rounded(mvdist.r_mvlnorm(spark, 2000, 0.1, S2 / 4, seed=43), ["X1", "X2"])


DELTA = 3.0 / math.sqrt(10.0)


@query(f"SELECT round(0.5 + 2.0 * CASE WHEN z0 > 0 THEN 1 ELSE -1 END * ({DELTA!r} * z0 + {math.sqrt(1 - DELTA * DELTA)!r} * z1), 6) AS X1 FROM {normals_sql(2000, 44, ['z0', 'z1'])}")
def skew_normal(spark, d):
    return rounded(mvdist.r_mvskewnorm(spark, 2000, 0.5, 4.0, 3.0, seed=44), ["X1"])


@query(f"SELECT CASE WHEN c <= 0.3 THEN 1.0 ELSE 2.0 END AS component, round(CASE WHEN c <= 0.3 THEN z0 ELSE 9 + 2 * z0 END, 6) AS X1 FROM {normals_sql(2000, 45, ['z0'], {'c': 'component'})}")
def mixture(spark, d):
    return rounded(mvdist.r_mvmixture(spark, 2000, [3.0, 7.0], [[0.0], [9.0]], [[[1.0]], [[4.0]]], seed=45, return_component=True), ["component", "X1"])


R3 = mvdist.make_corr(3, "ar1", 0.5)
ROOT3 = matrix_root(R3)


@query(f"SELECT {', '.join(f'round({normal_sql(f'x{k}')}, 6) AS U{k + 1}' for k in range(3))} FROM (SELECT {', '.join(f'{mixed_sql(ROOT3, k)} AS x{k}' for k in range(3))} FROM {normals_sql(2000, 46, ['z0', 'z1', 'z2'])})")
def gaussian_copula(spark, d):
    return rounded(mvdist.r_copula(spark, 2000, "gaussian", 3, corr=R3, seed=46), ["U1", "U2", "U3"])


@query(f"""WITH x AS (SELECT i, {mixed_sql(np.linalg.cholesky(R3[:2, :2]), 0)} AS x0, {mixed_sql(np.linalg.cholesky(R3[:2, :2]), 1)} AS x1 FROM {normals_sql(4000, 47, ['copula|l_returnflag', 'copula|l_linestatus'])}), u AS (SELECT i, {normal_sql('x0')} AS u0, {normal_sql('x1')} AS u1 FROM x),
a AS (SELECT l_returnflag AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1),
ca AS (SELECT v, sum(p) OVER (ORDER BY v) AS hi, sum(p) OVER (ORDER BY v) - p AS lo, row_number() OVER (ORDER BY v DESC) AS back FROM a), cb AS (SELECT v, sum(p) OVER (ORDER BY v) AS hi, sum(p) OVER (ORDER BY v) - p AS lo, row_number() OVER (ORDER BY v DESC) AS back FROM b)
SELECT ca.v AS l_returnflag, cb.v AS l_linestatus FROM u JOIN ca ON u0 > ca.lo AND (u0 <= ca.hi OR ca.back = 1) JOIN cb ON u1 > cb.lo AND (u1 <= cb.hi OR cb.back = 1)""")
def generate_from_copula(spark, d):
    """Labels of a Gaussian copula with a given correlation."""
    model = synthesizer.fit(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), copula="independence")
    c = model.pooled.copula
    model.pooled.copula = synthesizer.Copula(c.names, R3[:2, :2], c.n_pair)
    return synthesizer.generate(model, spark, 4000, seed=47)


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal) AS a, row_number() OVER (ORDER BY c_custkey) AS b, count(*) OVER () AS n FROM customer), u AS (SELECT (a - 0.5) / n AS ua, (b - 0.5) / n AS ub FROM r), z AS (SELECT {quantile_sql('ua')} AS za, {quantile_sql('ub')} AS zb FROM u)
SELECT round(corr(za, zb), 5) AS r, count(*) AS n FROM z""")
def normal_score_correlation(spark, d):
    """The copula of two continuous columns: the correlation of their normal scores."""
    real = table(spark, d, "customer").select("c_acctbal", F.col("c_custkey").cast("double").alias("c_custkey"))
    model = synthesizer.fit(real, knots=1_000_000)
    return spark.createDataFrame([(round(float(model.correlation().loc["c_acctbal", "c_custkey"]), 5), int(model.n_pair().loc["c_acctbal", "c_custkey"]))], "r double, n long")


@query(f"SELECT p, round({quantile_sql('p')}, 9) AS z, round({normal_sql('4 * p - 2')}, 9) AS q FROM (SELECT unnest([1e-9, 0.001, 0.07, 0.3, 0.5, 0.8, 0.999]) AS p)")
def normal_functions(spark, d):
    p = spark.createDataFrame([(x,) for x in (1e-9, 0.001, 0.07, 0.3, 0.5, 0.8, 0.999)], "p double")
    return p.select("p", F.round(special.phi_inverse(F.col("p")), 9).alias("z"), F.round(special.phi(4 * F.col("p") - 2), 9).alias("q"))


# Conditional models ------------------------------------------------------------------------------

TARGET = "(l_extendedprice + CASE WHEN l_linestatus = 'O' THEN 50000.0 ELSE 0.0 END)"


def shifted(spark, d):
    return table(spark, d, "lineitem").select("l_linestatus", "l_linenumber", (F.col("l_extendedprice") + F.when(F.col("l_linestatus") == "O", 50000.0).otherwise(0.0)).alias("y"))


@query(f"SELECT l_linestatus, round(avg({TARGET}), 2) AS mean FROM lineitem GROUP BY 1")
def tree_means(spark, d):
    """Leaves of a tree on one binary label are its groups."""
    df = shifted(spark, d)
    return conditional.fit_tree(df, "y", ["l_linestatus"]).predict(df, ["l_linestatus"]).select("l_linestatus", F.round("_mean", 2).alias("mean")).distinct()


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(3.0 * p_size + 2, 2) AS mean FROM part")
def smooth_means(spark, d):
    """A smooth model of an exact line."""
    df = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("double").alias("x"), (3.0 * F.col("p_size") + 2).alias("y"))
    model = conditional.fit_smooth(df, "y", ["x"])
    return df.select("p_partkey", F.round(model.mean(df), 2).alias("mean"))


@query("SELECT l_linestatus, l_returnflag, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY l_linestatus), 2) AS p FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2")
def nominal_probabilities(spark, d):
    """A multinomial model on one binary label gives the shares of each group."""
    df = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag").filter("l_returnflag <> 'N'")
    m = conditional.fit_nominal(df, "l_returnflag", ["l_linestatus"])
    p = m.model.transform(m.encoder.assembled(df.distinct().select("l_linestatus").distinct(), ["l_linestatus"])).select("l_linestatus", vector_to_array("probability").alias("p"))
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("l_returnflag"), F.col("p")[i].alias("p")) for i, v in enumerate(m.labels)])).alias("x")
    return p.select("l_linestatus", pairs).select("l_linestatus", "x.l_returnflag", F.round("x.p", 2).alias("p")).filter("p > 0")


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT DISTINCT p_size AS raw, round(least(greatest(((SELECT count(*) FROM part b WHERE b.p_size < a.p_size) + (SELECT count(*) FROM part b WHERE b.p_size <= a.p_size)) / (2.0 * n), 0.5 / n), 1 - 0.5 / n), 6) AS u FROM part a, n")
def calibration_positions(spark, d):
    x = np.sort(table(spark, d, "part").select("p_size").toPandas()["p_size"].to_numpy(float))  # a reference sample, bounded in the fit
    raw = np.unique(x)
    return spark.createDataFrame([(int(a), float(u)) for a, u in zip(raw, conditional.calibrated_u(raw, x))], "raw int, u double").select("raw", r6("u").alias("u"))


@query("WITH n AS (SELECT ln(sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN l_quantity > 25 THEN 0.0 ELSE 1.0 END)) AS odds, l_linestatus FROM lineitem GROUP BY 2) SELECT round(max(odds) FILTER (l_linestatus = 'F'), 5) AS base, round(max(odds) FILTER (l_linestatus = 'O') - max(odds) FILTER (l_linestatus = 'F'), 5) AS slope FROM n")
def logistic_fit(spark, d):
    """The numpy logistic model of the classifier metrics, on the four cells with their counts as repeated rows."""
    n = table(spark, d, "lineitem").groupBy((F.col("l_linestatus") == "O").cast("double").alias("x"), (F.col("l_quantity") > 25).cast("double").alias("y")).count().toPandas()  # four rows
    X, y = np.column_stack([np.ones(n["count"].sum()), np.repeat(n.x, n["count"])]), np.repeat(n.y, n["count"]).to_numpy()
    w = features.logistic(X, y, 0.0)
    return spark.createDataFrame([(round(float(w[0]), 5), round(float(w[1]), 5))], "base double, slope double")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b, CAST(n_nationkey ** 2 AS DOUBLE) AS aa, CAST(n_nationkey * n_regionkey AS DOUBLE) AS ab, CAST(n_regionkey ** 2 AS DOUBLE) AS bb FROM nation")
def quadratic_terms(spark, d):
    x = table(spark, d, "nation").select("n_nationkey", "n_regionkey").toPandas().to_numpy(float)  # 25 rows
    return spark.createDataFrame([tuple(map(float, r)) for r in features.with_quadratics(x)], "a double, b double, aa double, ab double, bb double")


# Margins, plots and checks -----------------------------------------------------------------------


@query("WITH f AS (SELECT l_returnflag AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1) SELECT v AS label, round(sum(p) OVER (ORDER BY v) - p, 9) AS low, round(sum(p) OVER (ORDER BY v), 9) AS high FROM f")
def cell_bounds(spark, d):
    m = fit_marginals(table(spark, d, "lineitem").select("l_returnflag"), ["l_returnflag"])["l_returnflag"]
    e = m.cell_bounds()
    return spark.createDataFrame([(v, round(float(a), 9), round(float(b), 9)) for v, a, b in zip(m.values, e[:-1], e[1:])], "label string, low double, high double")


@query("WITH f AS (SELECT CAST(l_linenumber AS DOUBLE) AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1), c AS (SELECT v, sum(p) OVER (ORDER BY v) AS hi FROM f), m AS (SELECT sum(v * p) AS mean FROM f) SELECT round(max(mean), 6) AS mean, round(sqrt(sum(p * (v - mean) ** 2)), 6) AS sd, (SELECT min(v) FROM c WHERE hi >= 0.5 - 1e-12) AS median FROM f, m")
def margin_moments(spark, d):
    m = fit_marginals(table(spark, d, "lineitem").select("l_linenumber"), ["l_linenumber"])["l_linenumber"]
    return spark.createDataFrame([tuple(round(x, 6) for x in m.moments())], "mean double, sd double, median double")


@query("""WITH l AS (SELECT 'l_returnflag' AS variable, l_returnflag AS v, l_orderkey % 2 AS side FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_orderkey % 2 FROM lineitem),
p AS (SELECT variable, v, count(*) FILTER (side = 0) * 1.0 / sum(count(*) FILTER (side = 0)) OVER (PARTITION BY variable) AS a, count(*) FILTER (side = 1) * 1.0 / sum(count(*) FILTER (side = 1)) OVER (PARTITION BY variable) AS b FROM l GROUP BY variable, v) SELECT variable, 'tvd' AS metric, round(sum(abs(a - b)) / 2, 6) AS value FROM p GROUP BY variable""")
def comparison_bars(spark, d):
    a, b = halves(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey")
    return plotdata.comparison_bars(metrics.compare(a.drop("l_orderkey"), b.drop("l_orderkey"), metrics=("marginal",))).select("variable", "metric", r6("value").alias("value"))


RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


def rank_corr(side: int) -> str:
    return f"(SELECT corr(a, b) FROM (SELECT {RANK.format(c='p_size')} AS a, {RANK.format(c='p_retailprice')} AS b FROM part WHERE p_partkey % 2 = {side}))"


@query(f"WITH v AS (SELECT {rank_corr(0)} AS a, {rank_corr(1)} AS b) SELECT unnest(['p_size', 'p_retailprice']) AS row_var, unnest(['p_retailprice', 'p_size']) AS col_var, round(a, 6) AS real, round(b, 6) AS synthetic, round(b - a, 6) AS difference FROM v UNION ALL SELECT unnest(['p_size', 'p_retailprice']), unnest(['p_size', 'p_retailprice']), 1.0, 1.0, 0.0")
def association_tiles(spark, d):
    a, b = halves(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return plotdata.association_tiles(a.drop("p_partkey"), b.drop("p_partkey")).select("row_var", "col_var", *[r6(c).alias(c) for c in ("real", "synthetic", "difference")])


@query("""WITH x AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS source, p_retailprice AS v FROM part), e AS (SELECT min(v) AS a, max(v) AS b FROM x)
SELECT source, CAST(least(floor((v - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM x, e GROUP BY 1, 2""")
def distance_histogram(spark, d):
    x = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "real").otherwise("synthetic").alias("source"), F.col("p_retailprice").alias("distance"))
    return plotdata.distance_histogram(x, 20).select("source", "bin", r6("share").alias("share"))


@query(values([("12.3%", "p_size, p_retailprice", "p_partkey, p_size, p_retailprice", "not in both tables: nothing")], ["percent", "common", "picked", "absent"]))
def shown_columns(spark, d):
    a, b = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), table(spark, d, "part").select("p_retailprice", "p_size")
    try:
        metrics.common_columns(a, b, ["nothing"])
    except ValueError as e:
        absent = str(e)
    return spark.createDataFrame([(plotdata.percent(0.1234), ", ".join(metrics.common_columns(a, b)), ", ".join(plotdata.picked(a, a, numbers=True)), absent)], "percent string, common string, picked string, absent string")


CHECKS = [
    ("seed", "seed must be a whole number of at most 2147483647 in size"), ("count", "n must be a whole number, zero or more"), ("swap", "swap is out of range"), ("bounds", "bounds must be sign, range or none"), ("closeness", "closeness must lie in [0, 1]"),
    ("alpha", "alpha needs two or more positive values"), ("sigma", "sigma must be a finite symmetric matrix"), ("theta", "theta is out of range for clayton"), ("correlation", "the correlation matrix is not positive definite"), ("copula", "copula must be one of gaussian, t, independence"), ("formula", "a formula is a response, ~ and predictors joined by +, not 'y'"),
]


@query(values(CHECKS, ["what", "message"]))
def refused_settings(spark, d):
    few = spark.range(3)
    tries = {
        "seed": lambda: check_seed(2**31), "count": lambda: mvdist.r_mvnorm(spark, -1), "swap": lambda: synthesizer.Perturbation(swap={"a": 2.0}), "bounds": lambda: synthesizer.Perturbation(bounds="soft"), "closeness": lambda: synthesizer.Perturbation.closeness(1.5), "alpha": lambda: mvdist.r_dirichlet(spark, 5, [1.0, 0.0]),
        "sigma": lambda: mvdist.r_mvnorm(spark, 5, 0.0, [[1.0, 2.0], [0.0, 1.0]]), "theta": lambda: mvdist.r_copula(spark, 5, "clayton", 2, theta=-1.0), "correlation": lambda: mvdist.make_corr(3, "exchangeable", -0.9), "copula": lambda: synthesizer.fit(few, copula="vine"), "formula": lambda: metrics.formula_terms("y"),
    }
    rows = []
    for what, f in tries.items():
        try:
            f()
        except ValueError as e:
            rows.append((what, str(e)))
    return spark.createDataFrame(rows, "what string, message string")
