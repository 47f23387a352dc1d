"""Queries of the library's own operators, by name, with their DuckDB twins.

Every query reads its whole tables.  Real and "synthetic" sides without randomness
are the even and odd order keys.  Computed doubles are rounded to six places on
both sides, since the engines differ in the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.rng import uniform_md5, uniform_md5_sql
from tabweave.operators import metrics, mvdist, plotdata, ranks, risk, synthesizer, timeseries
from tabweave.operators.marginals import frequencies, profile
from tabweave.plans.registry import ORACLES, QUERIES, halves, query, r6, table
from tabweave.sources.readers import to_boolean, to_levels

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit orders, generate as many rows, compare the marginals."""
    real = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    return metrics.marginal_metrics(real, synthesizer.synthesize(real, seed=7))


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN upper(trim(CASE WHEN p_size % 3 = 0 THEN ' yes' WHEN p_size % 3 = 1 THEN 'f' ELSE 'maybe' END)) IN ('TRUE','T','1','YES') THEN true
 WHEN upper(trim(CASE WHEN p_size % 3 = 0 THEN ' yes' WHEN p_size % 3 = 1 THEN 'f' ELSE 'maybe' END)) IN ('FALSE','F','0','NO') THEN false END AS flag,
 CASE WHEN p_size % 5 BETWEEN 1 AND 3 THEN (['low','mid','high'])[CAST(p_size % 5 AS INTEGER)] END AS level FROM part""")
def coerce_types(spark, d):
    word = F.when(F.col("p_size") % 3 == 0, " yes").when(F.col("p_size") % 3 == 1, "f").otherwise("maybe")
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), to_boolean(word).alias("flag"), to_levels((F.col("p_size") % 5).cast("string"), ["low", "mid", "high"]).alias("level"))


@query("""WITH l AS (SELECT 'l_quantity' AS variable, CAST(l_quantity AS DOUBLE) AS x FROM lineitem UNION ALL SELECT 'l_discount', CAST(l_discount AS DOUBLE) FROM lineitem UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem)
SELECT variable, count(*) AS n, count(DISTINCT x) <= 20 AND (bool_and(x = round_even(x, 0)) OR count(DISTINCT x) <= count(x) / 2) AS is_discrete, bool_and(x = round_even(x, 0)) AS all_integer, min(x) AS low, max(x) AS high FROM l GROUP BY variable""")
def marginal_typing(spark, d):
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    df = table(spark, d, "lineitem").select(*cols)
    stats = profile(df, cols)
    few = frequencies(df, cols).groupBy("variable").agg(F.count("*").alias("k"))
    s = stats.join(few, "variable")
    return s.select("variable", "n", ((F.col("k") <= 20) & (F.col("all_integer") | (F.col("k") <= F.col("n_observed") / 2))).alias("is_discrete"), "all_integer", "low", "high")


@query("""WITH j AS (SELECT l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'quality' AS variable, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM j WHERE quality IS NOT NULL GROUP BY quality
UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM j WHERE toxic IS NOT NULL GROUP BY toxic""")
def frequency_table(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return frequencies(j.select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")), ["quality", "toxic"]).select("variable", F.col("text").alias("value"), "n")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / (count(*) OVER () + 1), 9) AS u FROM orders")
def pseudo_observations(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = o.agg(F.count("*").alias("n"))
    ranked = ranks.average_rank(o, "o_totalprice", "r").crossJoin(F.broadcast(n))  # one row
    return ranked.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.round(F.col("r") / (F.col("n") + 1), 9).alias("u"))


@query(f"""WITH f AS (SELECT l_discount AS v, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_discount), c AS (SELECT v, p, sum(p) OVER (ORDER BY v) - p AS below FROM f)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(c.below + c.p * {uniform_md5_sql(1, 'v', 'l_orderkey * 8 + l_linenumber')}, 6) AS u FROM lineitem JOIN c ON c.v = l_discount""")
def pseudo_observations_discrete(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    counts = li.groupBy("l_discount").agg(F.count("*").alias("n")).withColumn("_k", F.lit(0))
    total = counts.agg(F.sum("n").alias("size"))
    cells = ranks.running_totals(counts, "_k", "l_discount", ["n"]).crossJoin(F.broadcast(total)).select("l_discount", (F.col("n") / F.col("size")).alias("p"), ((F.col("n_upto") - F.col("n")) / F.col("size")).alias("below"))
    v = uniform_md5(1, "v", F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber").cast("long"))
    return li.join(cells, "l_discount").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), r6(F.col("below") + F.col("p") * v).alias("u"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value, CAST(l_orderkey % 2 AS INTEGER) AS side FROM lineitem" for c in NUMBERS)


@query(f"""WITH l AS ({LONG}), c AS (SELECT variable, value, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM l GROUP BY variable, value),
u AS (SELECT variable, sum(a) OVER w AS ua, sum(b) OVER w AS ub, sum(a) OVER (PARTITION BY variable) AS na, sum(b) OVER (PARTITION BY variable) AS nb FROM c WINDOW w AS (PARTITION BY variable ORDER BY value))
SELECT variable, round(max(abs(ua / na - ub / nb)), 6) AS ks FROM u GROUP BY variable""")
def ks_distance(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return metrics.ks(a, b, NUMBERS).select("variable", r6("ks").alias("ks"))


GRID = "[" + ", ".join(f"{k / 1000}" for k in range(1, 1000)) + "]"


@query(f"""WITH l AS ({LONG}), q AS (SELECT variable, side, quantile_cont(value, {GRID}) AS q, stddev_samp(value) AS sd FROM l GROUP BY variable, side)
SELECT a.variable, round(list_sum(list_transform(list_zip(a.q, b.q), lambda z: abs(z[1] - z[2]))) / 999 / a.sd, 6) AS wasserstein FROM q a JOIN q b ON a.variable = b.variable AND a.side = 0 AND b.side = 1""")
def wasserstein_distance(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return metrics.wasserstein(a, b, NUMBERS).select("variable", r6("wasserstein").alias("wasserstein"))


@query("""WITH l AS (SELECT 'l_returnflag' AS variable, l_returnflag AS v, l_orderkey % 2 AS side FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_orderkey % 2 FROM lineitem),
p AS (SELECT variable, v, count(*) FILTER (side = 0) * 1.0 / sum(count(*) FILTER (side = 0)) OVER (PARTITION BY variable) AS a, count(*) FILTER (side = 1) * 1.0 / sum(count(*) FILTER (side = 1)) OVER (PARTITION BY variable) AS b FROM l GROUP BY variable, v)
SELECT variable, round(sum(abs(a - b)) / 2, 6) AS tvd FROM p GROUP BY variable""")
def total_variation(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return metrics.total_variation(a, b, ["l_returnflag", "l_linestatus"]).select("variable", r6("tvd").alias("tvd"))


@query(f"""WITH l AS ({LONG}) SELECT variable, 'numeric' AS type, round(avg(value) FILTER (side = 0), 6) AS mean_real, round(avg(value) FILTER (side = 1), 6) AS mean_synthetic, round(stddev_samp(value) FILTER (side = 0), 6) AS sd_real, round(stddev_samp(value) FILTER (side = 1), 6) AS sd_synthetic, 0.0 AS missing_real FROM l GROUP BY variable
UNION ALL SELECT 'l_returnflag', 'categorical', NULL, NULL, NULL, NULL, 0.0""".replace("0.0 AS missing_real", "CAST(0 AS DOUBLE) AS missing_real").replace("NULL, 0.0", "NULL, CAST(0 AS DOUBLE)"))
def marginal_metrics(spark, d):
    a, b = halves(table(spark, d, "lineitem").select("l_orderkey", *NUMBERS, "l_returnflag"), "l_orderkey")
    m = metrics.marginal_metrics(a.drop("l_orderkey"), b.drop("l_orderkey"))
    return m.select("variable", "type", *[r6(c).alias(c) for c in ("mean_real", "mean_synthetic", "sd_real", "sd_synthetic", "missing_real")])


AVG_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(f"SELECT round(corr(a, b), 6) AS value FROM (SELECT {AVG_RANK.format(c='p_size')} AS a, {AVG_RANK.format(c='p_retailprice')} AS b FROM part)")
def spearman(spark, d):
    return metrics.spearman(table(spark, d, "part"), "p_size", "p_retailprice").select(r6("value").alias("value"))


CRAMER = """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb, sum(n) OVER () AS t FROM c),
s AS (SELECT sum(n * n * 1.0 / (ra * cb)) - 1 AS phi2, max(t) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM m)
SELECT round(CAST(sqrt(greatest(0, phi2 - (k - 1) * (r - 1) * 1.0 / (n - 1)) / (least(r - (r - 1) ** 2 * 1.0 / (n - 1), k - (k - 1) ** 2 * 1.0 / (n - 1)) - 1)) AS DOUBLE), 6) AS value FROM s"""


@query(CRAMER)
def cramers_v(spark, d):
    return metrics.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(r6("value").alias("value"))


@query(f"""WITH r AS (SELECT p_brand AS g, {AVG_RANK.format(c='p_size')} AS r FROM part), a AS (SELECT g, count(*) AS n, avg(r) AS m FROM r GROUP BY g), t AS (SELECT avg(r) AS mu, var_pop(r) * count(*) AS sst FROM r)
SELECT round(sqrt(sum(n * (m - mu) ** 2) / max(sst)), 6) AS value FROM a, t""")
def correlation_ratio(spark, d):
    return metrics.correlation_ratio(table(spark, d, "part"), "p_size", "p_brand").select(r6("value").alias("value"))


@query("""WITH j AS (SELECT CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'n_chars' AS a, 'quality' AS b, count(*) FILTER (quality IS NOT NULL) AS n_pair, round(covar_samp(n_chars, quality), 6) AS cov, round(corr(n_chars, quality), 6) AS corr FROM j
UNION ALL SELECT 'n_chars', 'toxic', count(*) FILTER (toxic IS NOT NULL), round(covar_samp(n_chars, toxic), 6), round(corr(n_chars, toxic), 6) FROM j
UNION ALL SELECT 'quality', 'toxic', count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL), round(covar_samp(quality, toxic), 6), round(corr(quality, toxic), 6) FROM j""")
def pairwise_moments(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return metrics.pairwise_moments(j, ["n_chars", "quality", "toxic"]).select("a", "b", "n_pair", r6("cov").alias("cov"), r6("corr").alias("corr"))


@query("""WITH j AS (SELECT l.toxic AS y, CAST(d.n_chars AS DOUBLE) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM j)
SELECT round(CAST((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS DOUBLE), 6) AS auc, n1 AS n_positive, n0 AS n_negative FROM r, (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM j) GROUP BY n1, n0""")
def auc_by_rank(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.auc(j, "toxic", "n_chars").select(r6("auc").alias("auc"), "n_positive", "n_negative")


KEYS = ["l_quantity", "l_discount", "l_tax", "l_shipdate"]
K = ", ".join(KEYS)


@query(f"""WITH a AS (SELECT {K}, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT {K}, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL)
SELECT count(*) FILTER (a.n = 1) AS n_real_uniques, round(count(*) FILTER (a.n = 1) * 1.0 / sum(a.n), 6) AS real_unique_rate, round(count(*) FILTER (a.n = 1 AND b.n = 1) * 1.0 / count(*) FILTER (a.n = 1), 6) AS replicated_uniques
FROM a LEFT JOIN b ON {' AND '.join(f'a.{k} IS NOT DISTINCT FROM b.{k}' for k in KEYS)}""")
def replicated_uniques(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return risk.replicated_uniques(a, b, KEYS).select("n_real_uniques", r6("real_unique_rate").alias("real_unique_rate"), r6("replicated_uniques").alias("replicated_uniques"))


@query("""WITH a AS (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT round(avg(CASE WHEN a.l_quantity IS NULL THEN 0.0 ELSE 1.0 END), 6) AS exact_copies FROM (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1) b LEFT JOIN a ON a.l_quantity = b.l_quantity AND a.l_discount = b.l_discount AND a.l_tax = b.l_tax""")
def exact_copies(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return risk.exact_copies(a, b, ["l_quantity", "l_discount", "l_tax"]).select(r6("exact_copies").alias("exact_copies"))


@query("""WITH r AS (SELECT o_orderpriority AS k, o_orderdate AS d, o_orderstatus AS y FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT o_orderpriority AS k, o_orderdate AS d, o_orderstatus AS y FROM orders WHERE o_orderkey % 2 = 1),
n AS (SELECT k, d, count(*) AS n FROM r GROUP BY k, d), g AS (SELECT k, d, mode(y ORDER BY y) AS guess FROM s GROUP BY k, d), b AS (SELECT mode(y ORDER BY y) AS base FROM r)
SELECT round(avg(CASE WHEN guess IS NULL THEN 0.0 ELSE 1.0 END), 6) AS match_rate, round(avg(CASE WHEN guess = y THEN 1.0 ELSE 0.0 END) FILTER (guess IS NOT NULL), 6) AS cap, round(avg(CASE WHEN guess = y THEN 1.0 ELSE 0.0 END) FILTER (guess IS NOT NULL AND n = 1), 6) AS cap_uniques, round(avg(CASE WHEN base = y THEN 1.0 ELSE 0.0 END), 6) AS cap_baseline
FROM r JOIN n USING (k, d) LEFT JOIN g USING (k, d), b""")
def attribute_risk(spark, d):
    a, b = halves(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus"), "o_orderkey")
    x = risk.attribute_risk(a, b, ["o_orderpriority", "o_orderdate"], "o_orderstatus")
    return x.select(*[r6(c).alias(c) for c in x.columns])


DAILY = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS t, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY 1"


def hourly(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("v"))


@query(f"WITH s AS ({DAILY}), w AS (SELECT t, n AS y, lag(n, 2) OVER (ORDER BY t) AS lag1, lag(n, 3) OVER (ORDER BY t) AS lag2, row_number() OVER (ORDER BY t) AS r FROM s) SELECT t, y, lag1, lag2 FROM w WHERE r >= 4")
def ts_windows(spark, d):
    return timeseries.ts_windows(hourly(spark, d), "t", ["n"], lags=2, horizon=2)


@query(f"""WITH s AS ({DAILY}), c AS (SELECT t, n - avg(n) OVER () AS d FROM s), k AS (SELECT unnest(range(1, 13)) AS lag), i AS (SELECT d, row_number() OVER (ORDER BY t) AS r FROM c)
SELECT CAST(k.lag AS INTEGER) AS lag, round(coalesce(sum(a.d * b.d), 0) / (SELECT sum(d * d) FROM i), 6) AS acf FROM k LEFT JOIN i a ON true LEFT JOIN i b ON b.r = a.r - k.lag GROUP BY k.lag""")
def autocorrelation(spark, d):
    return timeseries.acf(hourly(spark, d), "t", "n", 12).select("lag", r6("acf").alias("acf"))


@query(f"""WITH s AS ({DAILY}), i AS (SELECT row_number() OVER (ORDER BY t) AS pos, n FROM s), z AS (SELECT count(*) AS size, CAST(ceil(count(*) ** (1.0 / 3)) AS BIGINT) AS len FROM i), g AS (SELECT unnest(range(0, 500)) AS id),
b AS (SELECT id, size, CAST(floor(id / len) AS BIGINT) AS blk, len FROM g, z), x AS (SELECT id, (CAST(floor({uniform_md5_sql(5, 'start', 'blk')} * size) AS BIGINT) + id - blk * len) % size + 1 AS pos FROM b)
SELECT x.id + 1 AS t, i.n FROM x JOIN i USING (pos)""")
def block_bootstrap(spark, d):
    return timeseries.bootstrap(hourly(spark, d).select("t", "n"), "t", ["n"], 500, "block", seed=5)


@query(f"""WITH s AS ({DAILY}), i AS (SELECT row_number() OVER (ORDER BY t) AS pos, n FROM s), z AS (SELECT count(*) AS size FROM i), g AS (SELECT unnest(range(0, 500)) AS id),
f AS (SELECT id, size, max(CASE WHEN id = 0 OR {uniform_md5_sql(5, 'restart', 'id')} < 1.0 / 8 THEN id END) OVER (ORDER BY id) AS s FROM g, z), x AS (SELECT id, (CAST(floor({uniform_md5_sql(5, 'start', 's')} * size) AS BIGINT) + id - s) % size + 1 AS pos FROM f)
SELECT x.id + 1 AS t, i.n FROM x JOIN i USING (pos)""")
def stationary_bootstrap(spark, d):
    return timeseries.bootstrap(hourly(spark, d).select("t", "n"), "t", ["n"], 500, "stationary", 8, seed=5)


@query("""WITH c AS (SELECT n_regionkey AS k, count(*) AS c FROM nation GROUP BY 1), e AS (SELECT k, 17.0 * c / sum(c) OVER () AS x FROM c), f AS (SELECT k, floor(x + 1e-9) AS b, round(x - floor(x + 1e-9), 12) AS r FROM e), o AS (SELECT *, row_number() OVER (ORDER BY r DESC, k) AS i, 17 - sum(b) OVER () AS left_ FROM f)
SELECT CAST(k AS BIGINT) AS stratum, CAST(b + CASE WHEN i <= left_ THEN 1 ELSE 0 END AS BIGINT) AS size FROM o""")
def largest_remainder(spark, d):
    counts = table(spark, d, "nation").groupBy("n_regionkey").count().orderBy("n_regionkey").collect()  # strata, bounded
    sizes = synthesizer.largest_remainder(17, [r["count"] for r in counts])
    return spark.createDataFrame([(int(r["n_regionkey"]), int(s)) for r, s in zip(counts, sizes)], "stratum long, size long")


@query("""WITH c AS (SELECT p_brand AS level, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, level) AS r, count(*) OVER () AS k FROM c)
SELECT CASE WHEN k <= 20 OR r <= 19 THEN level ELSE '(other)' END AS level, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def level_lumping(spark, d):
    return plotdata.lumped_levels(table(spark, d, "part"), "p_brand")


@query("""WITH g AS (SELECT quantile_cont(l_extendedprice, [""" + ", ".join(f"{k / 100}" for k in range(1, 100)) + """]) FILTER (l_orderkey % 2 = 0) AS a, quantile_cont(l_extendedprice, [""" + ", ".join(f"{k / 100}" for k in range(1, 100)) + """]) FILTER (l_orderkey % 2 = 1) AS b FROM lineitem), k AS (SELECT unnest(range(1, 100)) AS k)
SELECT k / 100.0 AS p, round(a[k], 4) AS real, round(b[k], 4) AS synthetic FROM g, k""")
def qq_points(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return plotdata.qq_points(a, b, "l_extendedprice").select("p", F.round("real", 4).alias("real"), F.round("synthetic", 4).alias("synthetic"))


@query("""WITH e AS (SELECT CAST(min(o_totalprice) AS DOUBLE) AS a, CAST(max(o_totalprice) AS DOUBLE) AS b FROM orders)
SELECT CAST(least(floor((o_totalprice - a) / ((b - a) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def histogram(spark, d):
    return plotdata.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", "n")


@query("""WITH l AS (SELECT l_orderkey % 2 AS s, l_returnflag AS level FROM lineitem) SELECT 'l_returnflag' AS variable, CASE WHEN s = 0 THEN 'real' ELSE 'synthetic' END AS source, level, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY s), 6) AS share FROM l GROUP BY s, level""")
def category_shares(spark, d):
    a, b = halves(table(spark, d, "lineitem"), "l_orderkey")
    return plotdata.category_shares(a, b, ["l_returnflag"]).select("variable", "source", "level", r6("share").alias("share"))


@query("SELECT DISTINCT 'l_discount' AS variable, CAST(l_discount AS DOUBLE) AS value, round(cume_dist() OVER (ORDER BY l_discount), 6) AS ecdf FROM lineitem")
def ecdf(spark, d):
    return plotdata.ecdf(table(spark, d, "lineitem"), ["l_discount"]).select("variable", "value", r6("ecdf").alias("ecdf"))


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (ORDER BY {uniform_md5_sql(4, 'fold', 'doc_id')}, doc_id) % 5 AS INTEGER) AS fold FROM labels")
def folds(spark, d):
    u = uniform_md5(4, "fold", F.col("doc_id"))
    ranked = table(spark, d, "labels").select("doc_id", u.alias("u"))
    ranked = ranks.average_rank(ranked, "u", "r")  # values are distinct, so ranks are row numbers
    return ranked.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("r").cast("long") % 5).cast("int").alias("fold"))


@query()
def fit_summary(spark, d):
    real = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    return spark.createDataFrame(synthesizer.fit(real).summary())


@query()
def generate_rows(spark, d):
    real = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    return synthesizer.synthesize(real, seed=11)


@query()
def generate_strata(spark, d):
    real = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    return synthesizer.synthesize(real, seed=11, by=["o_orderstatus"], copula="t")


@query()
def series_paths(spark, d):
    model = timeseries.fit_series(hourly(spark, d), "t", ["n", "v"])
    return timeseries.generate_series(model, spark, 200, sims=4)


from tabweave.plans import file_queries, model_queries, normal_queries  # noqa: E402,F401  (they register theirs)

__all__ = ["ORACLES", "QUERIES", "flagship"]
