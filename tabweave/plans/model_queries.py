"""Queries of margins, fitting, generation, evaluation and generators, all by way of the library's own functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tabweave.functions import latent, linalg, special
from tabweave.functions.rng import uniform_block_sql as u_sql
from tabweave.operators import conditional, features, metrics, mvdist, plotdata, risk, synthesizer, timeseries
from tabweave.operators.marginals import fit_marginals
from tabweave.plans.registry import drawn_sql, halves, query, r6, table, values
from tabweave.sources import writers

# Margins -----------------------------------------------------------------------------------------

KNOTS = """s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders), g AS (SELECT k, n, CASE WHEN k = 1 THEN 1.0 WHEN k = 50 THEN n ELSE least(greatest((n + 1.0/3) * ((k - 0.5) / 50) + 1.0/3, 1.0), n) END AS h FROM (SELECT max(n) AS n FROM s), (SELECT unnest(range(1, 51)) AS k)),
q AS (SELECT CAST(g.k AS INTEGER) AS k, a.x + (g.h - floor(g.h)) * (b.x - a.x) AS knot FROM g JOIN s a ON a.r = CAST(floor(g.h) AS BIGINT) JOIN s b ON b.r = least(CAST(floor(g.h) AS BIGINT) + 1, g.n))"""


def price_margin(spark, d):
    return fit_marginals(table(spark, d, "orders"), ["o_totalprice"], knots=50)["o_totalprice"]


@query(f"WITH {KNOTS} SELECT k, round(knot, 4) AS knot FROM q")
def knots_type8(spark, d):
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(price_margin(spark, d).values)], "k int, knot double").select("k", F.round("knot", 4).alias("knot"))


@query(f"WITH {KNOTS}, u AS (SELECT unnest(range(1, 20)) / 20.0 AS u) SELECT u, round(a.knot + (u * 49 - floor(u * 49)) * (b.knot - a.knot), 4) AS x FROM u JOIN q a ON a.k = CAST(floor(u * 49) AS INTEGER) + 1 JOIN q b ON b.k = least(CAST(floor(u * 49) AS INTEGER) + 2, 50)")
def quantile_lookup(spark, d):
    u = np.arange(1, 20) / 20
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, price_margin(spark, d).quantile(u))], "u double, x double").select("u", F.round("x", 4).alias("x"))


@query("""WITH f AS (SELECT l_returnflag AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1), c AS (SELECT v, sum(p) OVER (ORDER BY v) AS hi FROM f), u AS (SELECT unnest(range(1, 40)) / 40.0 AS u)
SELECT u, (SELECT min(v) FROM c WHERE hi >= u) AS label FROM u""")
def category_lookup(spark, d):
    m = fit_marginals(table(spark, d, "lineitem").select("l_returnflag"), ["l_returnflag"])["l_returnflag"]
    u = np.arange(1, 40) / 40
    return spark.createDataFrame([(float(a), m.values[int(k)]) for a, k in zip(u, m.quantile(u))], "u double, label string")


@query("SELECT round(avg(CASE WHEN l.quality IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def missing_rate(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("quality")
    return metrics.marginal_metrics(j, j).select(r6("missing_real").alias("missing_rate"))


@query("SELECT l_returnflag AS label, row_number() OVER (ORDER BY round(avg(l_quantity), 10), count(*) DESC, l_returnflag) AS place FROM lineitem GROUP BY 1")
def category_order(spark, d):
    """Unordered labels along the mean of the one ordered column."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    margins = {"": fit_marginals(li, ["l_returnflag", "l_quantity"])}
    synthesizer.order_categories(li, margins)
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(margins[""]["l_returnflag"].values)], "label string, place long")


# Fit and generation ------------------------------------------------------------------------------


@query(f"SELECT a.v AS l_returnflag, b.v AS l_linestatus FROM {drawn_sql('l_returnflag', 'lineitem', 8000, 11)} a JOIN {drawn_sql('l_linestatus', 'lineitem', 8000, 11)} b ON a.i = b.i")
def generate_labels(spark, d):
    real = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return synthesizer.generate(synthesizer.fit(real, copula="independence"), spark, 8000, seed=11)


@query(f"SELECT CAST(a.v AS BIGINT) AS l_linenumber, b.v AS l_discount, CAST(NULL AS DOUBLE) AS nothing FROM {drawn_sql('l_linenumber', 'lineitem', 8000, 12, kind='BIGINT')} a JOIN {drawn_sql('l_discount', 'lineitem', 8000, 12, kind='DOUBLE')} b ON a.i = b.i")
def generate_numbers(spark, d):
    real = table(spark, d, "lineitem").select("l_linenumber", "l_discount", F.lit(None).cast("double").alias("nothing"))
    out = synthesizer.generate(synthesizer.fit(real, copula="independence"), spark, 8000, seed=12)
    return out.select(F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_discount", "nothing")


TYPED = "(SELECT p_size % 2 = 0 AS flag, DATE '2020-01-01' + CAST(p_size % 5 AS INTEGER) AS day, (['S','M','L'])[p_size % 3 + 1] AS level FROM part)"


@query(f"SELECT a.v AS flag, CAST(b.v AS DATE) - DATE '1970-01-01' AS day, (['S','M','L'])[c.v] AS level FROM {drawn_sql('flag', TYPED, 3000, 13, kind='BOOLEAN')} a JOIN {drawn_sql('day', TYPED, 3000, 13, kind='DATE')} b ON a.i = b.i JOIN {drawn_sql('code', '(SELECT p_size % 3 + 1 AS code FROM part)', 3000, 13, 'copula|level', 'BIGINT')} c ON a.i = c.i")
def generate_typed(spark, d):
    """Booleans, dates and ordered labels come back in their classes."""
    p = table(spark, d, "part")
    real = p.select((F.col("p_size") % 2 == 0).alias("flag"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_size") % 5).cast("int")).alias("day"), F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), (F.col("p_size") % 3 + 1).cast("int")).alias("level", metadata={"levels": ["S", "M", "L"], "ordered": True}))
    out = synthesizer.generate(synthesizer.fit(real, copula="independence"), spark, 3000, seed=13)
    return out.select("flag", F.unix_date("day").cast("long").alias("day"), F.col("level").alias("level", metadata={}))


GAPS = "(SELECT CASE WHEN p_size % 4 <> 0 THEN p_brand END AS brand FROM part)"


@query(f"SELECT CASE WHEN {u_sql(14, 'missing|brand', 'i')} >= (SELECT avg(CASE WHEN brand IS NULL THEN 1.0 ELSE 0.0 END) FROM {GAPS}) THEN v END AS brand FROM {drawn_sql('brand', GAPS, 4000, 14)}")
def generate_missing_independently(spark, d):
    real = table(spark, d, "part").select(F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("brand"))
    return synthesizer.generate(synthesizer.fit(real, copula="independence", missing="independent"), spark, 4000, seed=14)


@query(f"SELECT CASE WHEN {u_sql(15, 'copula|.missing_brand', 'i')} <= 1 - (SELECT avg(CASE WHEN brand IS NULL THEN 1.0 ELSE 0.0 END) FROM {GAPS}) THEN v END AS brand FROM {drawn_sql('brand', GAPS, 4000, 15)}")
def generate_missing_jointly(spark, d):
    """Gaps by the indicator's own margin (which a copula may join to other columns)."""
    real = table(spark, d, "part").select(F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("brand"))
    return synthesizer.generate(synthesizer.fit(real, copula="independence", missing="joint"), spark, 4000, seed=15)


SIZES = """z AS (SELECT o_orderstatus AS k, count(*) AS c FROM orders GROUP BY 1), e AS (SELECT k, c, 6000.0 * c / sum(c) OVER () AS x FROM z), f AS (SELECT *, floor(x + 1e-9) AS b, round(x - floor(x + 1e-9), 12) AS r, row_number() OVER (ORDER BY c DESC, k) AS o FROM e),
s AS (SELECT k, o, CAST(b + CASE WHEN row_number() OVER (ORDER BY r DESC, o) <= 6000 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS size FROM f), w AS (SELECT k, size, sum(size) OVER (ORDER BY o) - size AS first FROM s)"""


@query(f"""WITH {SIZES}, p AS (SELECT o_orderstatus AS k, o_orderpriority AS v, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p FROM orders GROUP BY 1, 2), c AS (SELECT k, v, sum(p) OVER w AS hi, sum(p) OVER w - p AS lo, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS back FROM p WINDOW w AS (PARTITION BY k ORDER BY v)),
i AS (SELECT i, {u_sql(16, 'copula|o_orderpriority', 'i')} AS u FROM range(6000) t(i)) SELECT w.k AS o_orderstatus, c.v AS o_orderpriority FROM i JOIN w ON i.i >= w.first AND i.i < w.first + w.size JOIN c ON c.k = w.k AND i.u > c.lo AND (i.u <= c.hi OR c.back = 1)""")
def generate_by_stratum(spark, d):
    real = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    return synthesizer.generate(synthesizer.fit(real, by=["o_orderstatus"], copula="independence"), spark, 6000, seed=16, stratum_sizes="proportional")


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, quality) AS place, 'quality=' || coalesce(CAST(quality AS VARCHAR), 'NA') AS stratum, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY quality")
def stratum_counts(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").select("quality", "lang")
    model = synthesizer.fit(j, by=["quality"], copula="independence")
    return spark.createDataFrame([(i + 1, name, s.n) for i, (name, s) in enumerate(zip(synthesizer.stratum_labels(model), model.strata))], "place long, stratum string, n long")


@query(f"SELECT 'syn' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') AS c_name, v AS c_mktsegment FROM {drawn_sql('c_mktsegment', 'customer', 2500, 17)}")
def generate_ids(spark, d):
    real = table(spark, d, "customer").select("c_name", "c_mktsegment")
    return synthesizer.generate(synthesizer.fit(real, ids=["c_name"], copula="independence"), spark, 2500, seed=17)


@query(f"SELECT 1 AS sim, v AS l_returnflag, count(*) AS n FROM {drawn_sql('l_returnflag', 'lineitem', 3000, 18)} GROUP BY v UNION ALL SELECT 2, v, count(*) FROM {drawn_sql('l_returnflag', 'lineitem', 3000, 19)} GROUP BY v")
def simulate_tables(spark, d):
    model = synthesizer.fit(table(spark, d, "lineitem").select("l_returnflag"), copula="independence")
    return synthesizer.simulate(model, spark, 2, seed=18, n=3000).groupBy("sim", "l_returnflag").agg(F.count("*").alias("n"))


def swapped_sql(column: str, source: str, n: int, seed: int, swap: float, temperature: float) -> str:
    a, b = drawn_sql(column, source, n, seed, temperature=temperature), drawn_sql(column, source, n, seed, f"swapped|{column}", temperature=temperature)
    return f"(SELECT a.i, CASE WHEN {u_sql(seed, f'swap|{column}', 'a.i')} < {swap} THEN b.v ELSE a.v END AS v FROM {a} a JOIN {b} b ON a.i = b.i)"


@query(f"SELECT v AS l_returnflag FROM {swapped_sql('l_returnflag', 'lineitem', 5000, 20, 0.3, 2.0)}")
def perturb_labels(spark, d):
    model = synthesizer.fit(table(spark, d, "lineitem").select("l_returnflag"), copula="independence")
    return synthesizer.generate(model, spark, 5000, seed=20, perturb=synthesizer.Perturbation(swap={"l_returnflag": 0.3}, temperature=2.0))


@query(f"""WITH f AS (SELECT CAST(l_linenumber AS DOUBLE) AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1), c AS (SELECT v, p, sum(p) OVER (ORDER BY v) AS hi FROM f), m AS (SELECT sum(v * p) AS mean FROM f),
t AS (SELECT sqrt(sum(f.p * (f.v - m.mean) ** 2)) AS sd, (SELECT min(v) FROM c WHERE hi >= 0.5 - 1e-12) AS med, (SELECT min(v) FROM f) AS low, (SELECT max(v) FROM f) AS high FROM f, m)
SELECT CAST(floor(least(greatest(med + 1.5 * (v - med) + 0.25 * sd, low), high) + {u_sql(21, 'round|l_linenumber', 'i')}) AS BIGINT) AS l_linenumber FROM {drawn_sql('l_linenumber', 'lineitem', 5000, 21, kind='DOUBLE')}, t""")
def perturb_values(spark, d):
    """Scale about the median, shift in deviations, bounds of the data, and rounding at random."""
    model = synthesizer.fit(table(spark, d, "lineitem").select("l_linenumber"), copula="independence")
    moved = synthesizer.Perturbation(scale=1.5, shift={"l_linenumber": 0.25}, bounds="range")
    return synthesizer.generate(model, spark, 5000, seed=21, perturb=moved).select(F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query(f"SELECT c_mktsegment, false AS synthetic FROM customer UNION ALL SELECT v, true FROM {drawn_sql('c_mktsegment', 'customer', 4000, 22)}")
def augment_label(spark, d):
    return synthesizer.augment(table(spark, d, "customer").select("c_mktsegment"), n=4000, label="synthetic", seed=22, copula="independence")


@query(values([("closeness 0.4", 0.9, 0.3, 1.6, 0.4), ("both", 1.5, 0.44, 3.0, 0.2)], ["what", "noise", "swap", "temperature", "dependence"]))
def perturbations(spark, d):
    a = synthesizer.Perturbation.closeness(0.4)
    b = synthesizer.Perturbation(noise=0.9, swap=0.2, temperature=1.5, dependence=0.4).combined(synthesizer.Perturbation(noise=1.2, swap=0.3, temperature=2.0, dependence=0.5), [])
    return spark.createDataFrame([(n, *(round(float(x), 9) for x in (p.noise, p.swap, p.temperature, p.dependence))) for n, p in (("closeness 0.4", a), ("both", b))], "what string, noise double, swap double, temperature double, dependence double")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) * 2 <= count(*) OVER () AS a, row_number() OVER (ORDER BY p_size, p_partkey) * 2 <= count(*) OVER () AS b FROM part)
SELECT round(sin(2 * pi() * (avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) / 2 - 0.25)), 3) AS r FROM r""")
def latent_correlation(spark, d):
    """Two halved columns: the latent correlation has a closed form."""
    from pyspark.sql import Window

    n = table(spark, d, "part").count()
    ranked = table(spark, d, "part").select((F.row_number().over(Window.orderBy("p_retailprice", "p_partkey")) * 2 <= n).alias("a"), (F.row_number().over(Window.orderBy("p_size", "p_partkey")) * 2 <= n).alias("b"))
    return spark.createDataFrame([(round(float(synthesizer.fit(ranked).correlation().loc["a", "b"]), 3),)], "r double")


@query("""WITH j AS (SELECT l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'quality' AS a, 'toxic' AS b, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS n FROM j UNION ALL SELECT 'quality', 'quality', count(quality) FROM j UNION ALL SELECT 'toxic', 'toxic', count(toxic) FROM j""")
def pair_counts(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("quality", "toxic")
    n = synthesizer.fit(j).n_pair()
    return spark.createDataFrame([(a, b, int(n.loc[a, b])) for a, b in (("quality", "toxic"), ("quality", "quality"), ("toxic", "toxic"))], "a string, b string, n long")


# Evaluation --------------------------------------------------------------------------------------

RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
ETA = """SELECT '{x}' AS a, '{g}' AS b, (SELECT sqrt(sum(n * (m - mu) ** 2) / max(sst)) FROM (SELECT {g} AS g, count(*) AS n, avg({x}_r) AS m FROM r GROUP BY 1), (SELECT avg({x}_r) AS mu, var_pop({x}_r) * count(*) AS sst FROM r)) AS value"""


@query(f"""WITH r AS (SELECT *, {RANK.format(c='p_size')} AS p_size_r, {RANK.format(c='p_retailprice')} AS p_retailprice_r FROM part),
c AS (SELECT p_brand AS x, p_type AS y, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS ra, sum(n) OVER (PARTITION BY y) AS cb, sum(n) OVER () AS t FROM c), s AS (SELECT sum(n * n * 1.0 / (ra * cb)) - 1 AS phi2, max(t) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k FROM m),
p AS (SELECT 'p_size' AS a, 'p_retailprice' AS b, corr(p_size_r, p_retailprice_r) AS value FROM r UNION ALL {ETA.format(x='p_size', g='p_brand')} UNION ALL {ETA.format(x='p_size', g='p_type')} UNION ALL {ETA.format(x='p_retailprice', g='p_brand')} UNION ALL {ETA.format(x='p_retailprice', g='p_type')}
UNION ALL SELECT 'p_brand', 'p_type', sqrt(greatest(0, phi2 - (k - 1) * (r - 1) * 1.0 / (n - 1)) / (least(r - (r - 1) ** 2 * 1.0 / (n - 1), k - (k - 1) ** 2 * 1.0 / (n - 1)) - 1)) FROM s)
SELECT a AS row_var, b AS col_var, round(value, 6) AS value FROM p UNION ALL SELECT b, a, round(value, 6) FROM p UNION ALL SELECT unnest(['p_size', 'p_retailprice', 'p_brand', 'p_type']), unnest(['p_size', 'p_retailprice', 'p_brand', 'p_type']), 1.0""")
def association_matrix(spark, d):
    return metrics.association_matrix(table(spark, d, "part").select("p_size", "p_retailprice", "p_brand", "p_type")).select("row_var", "col_var", r6("value").alias("value"))


QUANTILES = ", ".join(f"round(quantile_cont({x}, {p}), 6) AS {side}_q{round(p * 100)}" for side, x in (("syn", "s"), ("real", "o")) for p in (0.01, 0.05, 0.25, 0.5))


@query(f"""WITH z AS (SELECT max(p_size) FILTER (p_partkey % 2 = 0) - min(p_size) FILTER (p_partkey % 2 = 0) AS zs, max(p_retailprice) FILTER (p_partkey % 2 = 0) - min(p_retailprice) FILTER (p_partkey % 2 = 0) AS zp FROM part), r AS (SELECT * FROM part WHERE p_partkey % 2 = 0), s AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
ds AS (SELECT s.p_partkey, min((least(abs(s.p_size - r.p_size) / zs, 1) + least(abs(s.p_retailprice - r.p_retailprice) / zp, 1) + CASE WHEN s.p_brand = r.p_brand THEN 0 ELSE 1 END) / 3) AS d FROM s, r, z GROUP BY 1),
dn AS (SELECT s.p_partkey, min((least(abs(s.p_size - r.p_size) / zs, 1) + least(abs(s.p_retailprice - r.p_retailprice) / zp, 1) + CASE WHEN s.p_brand = r.p_brand THEN 0 ELSE 1 END) / 3) AS d FROM r s, r, z WHERE s.p_partkey <> r.p_partkey GROUP BY 1),
q AS (SELECT {QUANTILES.replace('round(', '(').replace(', 6)', ')')} FROM (SELECT d AS s, NULL AS o FROM ds UNION ALL SELECT NULL, d FROM dn))
SELECT {', '.join(f'round({side}_q{p}, 6) AS {side}_q{p}' for side in ('syn', 'real') for p in (1, 5, 25, 50))}, round((SELECT avg(CASE WHEN d < 1e-12 THEN 1.0 ELSE 0.0 END) FROM ds), 6) AS zero_distance, round((SELECT avg(CASE WHEN d < q.real_q5 THEN 1.0 ELSE 0.0 END) FROM ds, q), 6) AS close_share, round(syn_q50 / real_q50, 6) AS ratio FROM q""")
def nearest_record_distances(spark, d):
    a, b = halves(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand"), "p_partkey")
    x = risk.nearest_records(a.drop("p_partkey"), b.drop("p_partkey"), max_rows=1_000_000)
    return x.select(*[r6(c).alias(c) for c in (*[f"{side}_q{p}" for side in ("syn", "real") for p in (1, 5, 25, 50)], "zero_distance", "close_share", "ratio")])


def line_sql(side: int) -> str:
    return f"""SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base, sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2)) AS s, regr_sxx(y, x) AS sxx, avg(x) AS mx, count(*) AS n FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem WHERE l_orderkey % 2 = {side})"""


Z = special.norm_ppf(0.975)
OVERLAP = f"round(er, 4) AS estimate_real, round(es, 4) AS estimate_synthetic, round((es - er) / sr, 4) AS std_diff, round(((least(er + {Z} * sr, es + {Z} * ss) - greatest(er - {Z} * sr, es - {Z} * ss)) / (2 * {Z} * sr) + (least(er + {Z} * sr, es + {Z} * ss) - greatest(er - {Z} * sr, es - {Z} * ss)) / (2 * {Z} * ss)) / 2, 4) AS overlap"


@query(f"""WITH a AS ({line_sql(0)}), b AS ({line_sql(1)}), t AS (SELECT 'l_quantity' AS term, a.slope AS er, b.slope AS es, a.s / sqrt(a.sxx) AS sr, b.s / sqrt(b.sxx) AS ss FROM a, b
UNION ALL SELECT '(Intercept)', a.base, b.base, a.s * sqrt(1.0 / a.n + a.mx ** 2 / a.sxx), b.s * sqrt(1.0 / b.n + b.mx ** 2 / b.sxx) FROM a, b) SELECT term, {OVERLAP} FROM t""")
def confidence_interval_overlap(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return metrics.ci_overlap(a, b, "l_extendedprice ~ l_quantity").select("term", *[F.round(c, 4).alias(c) for c in ("estimate_real", "estimate_synthetic", "std_diff", "overlap")])


@query(f"""WITH n AS (SELECT l_orderkey % 2 AS side, l_linestatus = 'O' AS x, sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS y1, sum(CASE WHEN l_quantity > 25 THEN 0.0 ELSE 1.0 END) AS y0 FROM lineitem GROUP BY 1, 2),
m AS (SELECT side, ln(max(y1 / y0) FILTER (NOT x)) AS base, sqrt(max(1 / y1 + 1 / y0) FILTER (NOT x)) AS sb, ln(max(y1 / y0) FILTER (x)) - ln(max(y1 / y0) FILTER (NOT x)) AS slope, sqrt(sum(1 / y1 + 1 / y0)) AS sl FROM n GROUP BY side),
t AS (SELECT '(Intercept)' AS term, a.base AS er, b.base AS es, a.sb AS sr, b.sb AS ss FROM m a, m b WHERE a.side = 0 AND b.side = 1 UNION ALL SELECT 'l_linestatusO', a.slope, b.slope, a.sl, b.sl FROM m a, m b WHERE a.side = 0 AND b.side = 1) SELECT term, {OVERLAP} FROM t""")
def logistic_interval_overlap(spark, d):
    """A logistic model of one binary predictor has a closed form."""
    a, b = halves(table(spark, d, "lineitem").withColumn("many", F.col("l_quantity") > 25), "l_orderkey")
    return metrics.ci_overlap(a, b, "many ~ l_linestatus", family="binomial").select("term", *[F.round(c, 4).alias(c) for c in ("estimate_real", "estimate_synthetic", "std_diff", "overlap")])


@query("""WITH n AS (SELECT c_mktsegment AS g, count(*) FILTER (c_custkey % 2 = 0) * 1.0 AS a, count(*) FILTER (c_custkey % 2 = 1) * 1.0 AS b FROM customer GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb, count(*) AS k FROM n)
SELECT round(sum((a + b) * (b / (a + b) - tb / (ta + tb)) ** 2) / max(ta + tb), 6) AS pmse, round(max((k - 1) * (ta / (ta + tb)) ** 2 * (tb / (ta + tb)) / (ta + tb)), 6) AS null_expectation FROM n, t""")
def propensity_error(spark, d):
    """With one label as the only feature the propensity of a row is its label's share."""
    a, b = halves(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    p = metrics.pmse(a.drop("c_custkey"), b.drop("c_custkey"), max_rows=1_000_000)
    return spark.createDataFrame([(round(p.pmse, 6), round(p.null_expectation, 6))], "pmse double, null_expectation double")


@query("""WITH l AS (SELECT 'l_returnflag' AS variable, l_returnflag AS v, l_orderkey % 2 AS side FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_orderkey % 2 FROM lineitem),
p AS (SELECT variable, v, count(*) FILTER (side = 0) * 1.0 / sum(count(*) FILTER (side = 0)) OVER (PARTITION BY variable) AS a, count(*) FILTER (side = 1) * 1.0 / sum(count(*) FILTER (side = 1)) OVER (PARTITION BY variable) AS b FROM l GROUP BY variable, v),
t AS (SELECT variable, sum(abs(a - b)) / 2 AS d FROM p GROUP BY variable) SELECT 'mean marginal distance' AS metric, round(avg(d), 6) AS value, '0' AS ideal FROM t UNION ALL SELECT 'max marginal distance', round(max(d), 6), '0' FROM t
UNION ALL SELECT unnest(['mean |association difference|', 'pMSE ratio', 'discriminator AUC', 'exact copy rate', 'DCR ratio']), NULL, unnest(['0', '~1', '0.5', '0', '>= 1'])""")
def comparison_summary(spark, d):
    a, b = halves(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey")
    rows = metrics.compare(a.drop("l_orderkey"), b.drop("l_orderkey"), metrics=("marginal",)).summary()
    return spark.createDataFrame([(m, None if v is None else round(v, 6), i) for m, v, i in rows], "metric string, value double, ideal string")


@query("""WITH r AS (SELECT o_orderpriority AS k, o_orderstatus AS s, o_totalprice AS y FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT o_orderpriority AS k, o_orderstatus AS s, median(o_totalprice) AS guess FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2), b AS (SELECT median(y) AS base FROM r)
SELECT round(avg(CASE WHEN guess IS NULL THEN 0.0 ELSE 1.0 END), 6) AS match_rate, round(avg(CASE WHEN abs(guess - y) <= 0.1 * abs(y) THEN 1.0 ELSE 0.0 END) FILTER (guess IS NOT NULL), 6) AS cap, round(avg(CASE WHEN abs(base - y) <= 0.1 * abs(y) THEN 1.0 ELSE 0.0 END), 6) AS cap_baseline FROM r LEFT JOIN t USING (k, s), b""")
def attribute_risk_numeric(spark, d):
    a, b = halves(table(spark, d, "orders"), "o_orderkey")
    x = risk.attribute_risk(a, b, ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return x.select(*[r6(c).alias(c) for c in ("match_rate", "cap", "cap_baseline")])


@query("""WITH a AS (SELECT l_quantity, l_tax, l_shipdate, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_quantity, l_tax, l_shipdate, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL),
c AS (SELECT DISTINCT l_quantity, l_tax, l_shipdate, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0), g AS (SELECT l_quantity, l_tax, l_shipdate, mode(l_returnflag ORDER BY l_returnflag) AS guess FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL)
SELECT (SELECT count(*) FROM a WHERE n = 1) AS n_real_uniques, round((SELECT count(*) FILTER (b.n = 1) * 1.0 / count(*) FROM a LEFT JOIN b USING (l_quantity, l_tax, l_shipdate) WHERE a.n = 1), 6) AS replicated_uniques,
round((SELECT avg(CASE WHEN c.l_tax IS NULL THEN 0.0 ELSE 1.0 END) FROM (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1) s LEFT JOIN c USING (l_quantity, l_tax, l_shipdate, l_returnflag)), 6) AS exact_copies,
round((SELECT avg(CASE WHEN guess = l_returnflag THEN 1.0 ELSE 0.0 END) FROM (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0) r JOIN g USING (l_quantity, l_tax, l_shipdate)), 6) AS cap""")
def disclosure(spark, d):
    keep = ["l_quantity", "l_tax", "l_shipdate", "l_returnflag"]
    a, b = halves(table(spark, d, "lineitem").select("l_orderkey", *keep), "l_orderkey")
    r = risk.disclosure_risk(a.select(*keep), b.select(*keep), keep[:3], "l_returnflag")
    return spark.createDataFrame([(r.n_real_uniques, round(r.replicated_uniques, 6), round(r.exact_copies, 6), round(r.attributes["l_returnflag"]["cap"], 6))], "n_real_uniques long, replicated_uniques double, exact_copies double, cap double")


@query("SELECT least(700, count(*)) AS n, count(DISTINCT p_partkey) >= least(700, count(*)) AS enough FROM part")
def row_sample(spark, d):
    x = metrics.capped(table(spark, d, "part"), 700, 3)
    return x.agg(F.count("*").alias("n"), (F.countDistinct("p_partkey") == F.count("*")).alias("enough"))


@query("""WITH x AS (SELECT n_name, CAST(n_regionkey AS DOUBLE) AS v FROM nation) SELECT n_name, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) AS z FROM x""")
def feature_scaling(spark, d):
    frame = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("double").alias("v")).toPandas()  # 25 rows
    z = features.Features(frame[["v"]]).matrix(frame[["v"]])[:, 0]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(frame.n_name, z)], "n_name string, z double").select("n_name", r6("z").alias("z"))


# Series ------------------------------------------------------------------------------------------


def hourly(spark, d, key=()):
    return table(spark, d, "events").groupBy(*key, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS t, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT event_type, t, n AS y, lag(n, 1) OVER w AS lag1, lag(n, 2) OVER w AS lag2, lag(n, 3) OVER w AS lag3, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t)) SELECT event_type, t, y, lag1, lag2, lag3 FROM w WHERE r >= 4")
def ts_windows_by_key(spark, d):
    return timeseries.ts_windows(hourly(spark, d, ["event_type"]), "t", ["n"], 3, key=["event_type"], stretch=50)


HOURS = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS t, count(*) AS n FROM events GROUP BY 1"


@query(f"""WITH s AS ({HOURS}), i AS (SELECT row_number() OVER (ORDER BY t) AS pos, n FROM s), z AS (SELECT count(*) AS size, CAST(ceil(count(*) ** (1.0 / 3)) AS BIGINT) AS len FROM i), g AS (SELECT sim, id FROM range(1, 3) a(sim), range(0, 300) b(id)),
b AS (SELECT sim, id, size, CAST(floor(id / len) AS BIGINT) AS blk, len FROM g, z), x AS (SELECT sim, id, (CAST(floor(((CAST(('0x' || substr(md5(CAST(6 + sim AS VARCHAR) || '|start|' || CAST(blk AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) * size) AS BIGINT) + id - blk * len) % size + 1 AS pos FROM b)
SELECT CAST(0 AS BIGINT) AS sim, pos AS t, CAST(n AS DOUBLE) AS n FROM i UNION ALL SELECT x.sim, x.id + 1, CAST(i.n AS DOUBLE) FROM x JOIN i USING (pos)""")
def augment_series(spark, d):
    return timeseries.augment_series(hourly(spark, d), "t", ["n"], sims=2, n=300, method="block", seed=7)


@query(f"""WITH s AS ({HOURS}), i AS (SELECT t, row_number() OVER (ORDER BY t) AS p, CAST(n AS DOUBLE) AS n FROM s), g AS (SELECT t, p, CASE WHEN p % 5 < 3 AND p > 2 THEN n END AS v FROM i), a AS (SELECT t, p, v, max(CASE WHEN v IS NOT NULL THEN p END) OVER (ORDER BY p) AS p0, min(CASE WHEN v IS NOT NULL THEN p END) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM g)
SELECT a.t, round(CASE WHEN a.p0 IS NULL THEN y.v WHEN a.p1 IS NULL OR a.p0 = a.p1 THEN x.v ELSE x.v + (y.v - x.v) * (a.p - a.p0) / (a.p1 - a.p0) END, 6) AS v FROM a LEFT JOIN g x ON x.p = a.p0 LEFT JOIN g y ON y.p = a.p1""")
def interpolated_series(spark, d):
    rows = timeseries.numbered(hourly(spark, d), "t", [])
    gaps = rows.select("t", F.when((F.col("_at") % 5 < 3) & (F.col("_at") > 2), F.col("n").cast("double")).alias("v"))
    return timeseries.interpolated(gaps, "t", "v").select("t", r6("v").alias("v"))


@query(f"WITH s AS ({HOURS}) SELECT 'real' AS source, CAST(0 AS BIGINT) AS sim, t, 'n' AS series, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'synthetic', 1, t, 'n', n + 1.0 FROM s")
def series_lines(spark, d):
    h = hourly(spark, d)
    return plotdata.series_lines(h, h.select("t", (F.col("n") + 1).alias("n"), F.lit(1).alias("sim")), "t", ["n"])


# Generators and numbers --------------------------------------------------------------------------


def uniforms_sql(n: int, seed: int, d: int, more: str = "") -> str:
    return f"(SELECT i, {', '.join(f'{u_sql(seed, f'u{k}', 'i')} AS u{k}' for k in range(d))}, {u_sql(seed, 'v', 'i')} AS v, {u_sql(seed, 'e', 'i')} AS e FROM range({n}) t(i))"


def named(df, n: int):
    return df.select(*[F.round(f"U{k + 1}", 6).alias(f"U{k + 1}") for k in range(n)])


@query(f"SELECT {', '.join(f'round((1 - ln(u{k}) / -ln(1 - v)) ** (-1.0), 6) AS U{k + 1}' for k in range(3))} FROM {uniforms_sql(2000, 31, 3)}")
def clayton_copula(spark, d):
    """Clayton with theta 1, whose frailty is exponential."""
    return named(mvdist.r_copula(spark, 2000, "clayton", 3, theta=1.0, seed=31), 3)


@query(f"WITH f AS (SELECT *, sin(0.5 * v * pi()) / sin(v * pi()) ** 2.0 * (sin(0.5 * v * pi()) / -ln(e)) AS s FROM {uniforms_sql(2000, 32, 3)}) SELECT {', '.join(f'round(exp(-((-ln(u{k}) / s) ** 0.5)), 6) AS U{k + 1}' for k in range(3))} FROM f")
def gumbel_copula(spark, d):
    return named(mvdist.r_copula(spark, 2000, "gumbel", 3, theta=2.0, seed=32), 3)


@query(f"SELECT round(u0, 6) AS U1, round(-ln(1 + v * (exp(-4.0) - 1) / (exp(-4.0 * u0) + v * (1 - exp(-4.0 * u0)))) / 4.0, 6) AS U2 FROM {uniforms_sql(2000, 33, 2)}")
def frank_copula(spark, d):
    return named(mvdist.r_copula(spark, 2000, "frank", 2, theta=4.0, seed=33), 2)


@query(f"SELECT round(-ln(1 - u0) / 2.0, 6) AS wait, round(-1 + 4 * u1, 6) AS flat, round(3 * (-ln(1 - u2)) ** 0.5, 6) AS wear, round(ln(u3 / (1 - u3)), 6) AS odds, CASE WHEN u4 <= 0.2 THEN 'low' WHEN u4 <= 0.7 THEN 'mid' ELSE 'high' END AS kind, round(CASE WHEN u5 <= 0.5 THEN 1 + 2 * u5 * 2 ELSE 3 + (2 * u5 - 1) * 4 END, 6) AS seen FROM {uniforms_sql(2000, 34, 6)}")
def joint_margins(spark, d):
    margins = {"wait": {"dist": "exp", "rate": 2.0}, "flat": {"dist": "unif", "min": -1.0, "max": 3.0}, "wear": {"dist": "weibull", "shape": 2.0, "scale": 3.0}, "odds": "logis", "kind": mvdist.margin_categorical(["low", "mid", "high"], [0.2, 0.5, 0.3], ordered=True), "seen": mvdist.margin_empirical([3.0, 1.0, None, 7.0])}
    x = mvdist.r_mvdist(spark, 2000, margins, "independence", seed=34)
    return x.select(*[F.round(c, 6).alias(c) if c != "kind" else F.col(c).alias(c, metadata={}) for c in x.columns])


@query("""WITH p AS (SELECT p_partkey, p_size AS x, p_retailprice AS y FROM part ORDER BY p_partkey LIMIT 200), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) AS n FROM p a, p b WHERE a.p_partkey <> b.p_partkey) SELECT round(s / n, 9) AS tau FROM s""")
def kendall_tau(spark, d):
    x = table(spark, d, "part").orderBy("p_partkey").limit(200).select("p_size", "p_retailprice").toPandas().to_numpy(float)  # the statistic of a bounded sample, as in the fit
    return spark.createDataFrame([(round(float(latent.kendall_correlations(x)[0, 1]), 9),)], "tau double")


@query("SELECT r, round(0.25 + asin(r) / (2 * pi()), 6) AS p FROM (SELECT unnest([-0.9, -0.5, 0.0, 0.3, 0.8]) AS r)")
def bivariate_normal(spark, d):
    return spark.createDataFrame([(r, round(float(latent.bivariate_normal_cdf(0, 0, r)), 6)) for r in (-0.9, -0.5, 0.0, 0.3, 0.8)], "r double, p double")


@query(values([("normal 0.975", 1.959964), ("normal 0.01", -2.326348), ("normal cdf 1", 0.841345), ("t 0.975, 5", 2.570582), ("t cdf 2, 10", 0.963306), ("gamma 0.5, 2", 1.678347), ("chi-square cdf 3.841459, 1", 0.95)], ["what", "value"]))
def distribution_values(spark, d):
    found = {"normal 0.975": special.norm_ppf(0.975), "normal 0.01": special.norm_ppf(0.01), "normal cdf 1": special.norm_cdf(1.0), "t 0.975, 5": special.t_ppf(0.975, 5), "t cdf 2, 10": special.t_cdf(2.0, 10), "gamma 0.5, 2": special.gamma_ppf(0.5, 2.0), "chi-square cdf 3.841459, 1": special.gamma_cdf(3.841459 / 2, 0.5)}
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in found.items()], "what string, value double")


@query(values([("exchangeable", 0.5, 0.5), ("ar1", 0.5, 0.25), ("toeplitz", 0.4, 0.1), ("identity", 0.0, 0.0)], ["kind", "r12", "r13"]))
def correlation_matrices(spark, d):
    rho = {"exchangeable": 0.5, "ar1": 0.5, "toeplitz": [0.4, 0.1], "identity": 0.0}
    found = {k: mvdist.make_corr(3, k, v) for k, v in rho.items()}
    return spark.createDataFrame([(k, float(R[0, 1]), float(R[0, 2])) for k, R in found.items()], "kind string, r12 double, r13 double")


@query(values([(0.2, "max_determinant")], ["r12", "how"]))
def completed_correlation(spark, d):
    """The unknown entry that leaves the two columns independent given the third."""
    R = np.array([[1, 0, 0.5], [0, 1, 0.4], [0.5, 0.4, 1.0]])
    unknown = np.zeros((3, 3), bool)
    unknown[0, 1] = unknown[1, 0] = True
    W, how = linalg.complete_correlation(R, unknown)
    return spark.createDataFrame([(round(float(W[0, 1]), 6), how)], "r12 double, how string")


@query(values([(0.5, 0.0), (1.0, 1.25)], ["score", "of_point"]))
def draw_scores(spark, d):
    """Continuous ranked probability scores of two draws, and of one draw."""
    a = [float(conditional.crps(np.array([[0.0, 2.0]]), np.array([y]))[0]) for y in (1.0, 2.0 - 0.5 + 0.0)]
    b = [float(conditional.crps(np.array([[3.0]]), np.array([y]))[0]) for y in (3.0, 1.75)]
    return spark.createDataFrame([(a[0], b[0]), (math.fsum([a[1], 0.5]), b[1])], "score double, of_point double")


@query(values([("a b", "a_b"), ("1x", "v1x"), ("if", "if_"), ("str9", "str9_"), ("plain", "plain")], ["name", "stata"]))
def stata_names(spark, d):
    import warnings

    names = ["a b", "1x", "if", "str9", "plain"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return spark.createDataFrame(list(zip(names, writers.stata_names(names))), "name string, stata string")
