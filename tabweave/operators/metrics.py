"""Fidelity and utility of synthetic data against real data."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.rng import check_seed
from tabweave.operators.features import Features, logistic, stacked, with_quadratics
from tabweave.operators.ranks import average_rank, missing, quantile_grid, running_totals, unpivoted

NUMERIC = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(df: DataFrame, column: str) -> bool:
    """Numbers, dates and times; booleans and strings are categories."""
    return isinstance(df.schema[column].dataType, NUMERIC)


def as_number(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric-like columns as doubles (days of dates, seconds of times), NaN as NULL."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        x = F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(c)
        x = x.cast("double")
        out.append(F.when(~missing(x), x).alias(c))
    return df.select(*out)


def common_columns(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> list[str]:
    names = [c for c in real.columns if c in synthetic.columns]
    if columns is not None:
        absent = [c for c in columns if c not in names]
        if absent:
            raise ValueError(f"not in both tables: {', '.join(absent)}")
        names = list(columns)
    if not names:
        raise ValueError("the tables share no column")
    return names


def _sides(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    a, b = (unpivoted(as_number(df, columns), columns).filter("value is not null") for df in (real, synthetic))
    return a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))


def ks(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, ks): largest difference of the empirical distribution functions; NULL if a side is empty."""
    counts = _sides(real, synthetic, columns).groupBy("variable", "value").agg(F.count_if(F.expr("side = 0")).alias("a"), F.count_if(F.expr("side = 1")).alias("b"))
    sizes = counts.groupBy("variable").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    upto = running_totals(counts, "variable", "value", ["a", "b"]).join(sizes, "variable")
    gap = F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))
    return upto.groupBy("variable").agg(F.max(F.when((F.col("na") > 0) & (F.col("nb") > 0), gap)).alias("ks"))


def wasserstein(real: DataFrame, synthetic: DataFrame, columns: list[str], grid: int = 999) -> DataFrame:
    """(variable, wasserstein): mean distance of the quantiles at k / (grid + 1), over the real standard deviation."""
    sides = _sides(real, synthetic, columns).withColumn("at", F.concat_ws("|", "side", "variable"))
    q = quantile_grid(sides, "at", "value", grid)
    a, b = (q.filter(F.col("at").startswith(f"{side}|")).select(F.expr("substr(at, 3)").alias("variable"), "k", F.col("q").alias(name)) for side, name in ((0, "qa"), (1, "qb")))
    sd = sides.filter("side = 0").groupBy("variable").agg(F.stddev_samp("value").alias("sd"))
    mean = a.join(b, ["variable", "k"]).groupBy("variable").agg((F.sum(F.abs(F.col("qa") - F.col("qb"))) / grid).alias("d"))
    return mean.join(sd, "variable").select("variable", (F.col("d") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("wasserstein"))


def total_variation(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, tvd): half the summed differences of category shares; missing labels do not count."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = unpivoted(df, columns, kind="string").filter("value is not null").groupBy("variable", "value").count()
        size = counts.groupBy("variable").agg(F.sum("count").alias("size"))
        return counts.join(size, "variable").select("variable", "value", (F.col("count") / F.col("size")).alias(name))

    a, b = shares(real, "p"), shares(synthetic, "q")
    both = a.join(b, ["variable", "value"], "full_outer")
    out = both.groupBy("variable").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("d"), F.count("p").alias("a"), F.count("q").alias("b"))
    return out.select("variable", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("d")).alias("tvd"))


def marginal_metrics(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a variable: type (by the real column), ks, wasserstein, tvd, means, deviations, missing rates."""
    names = common_columns(real, synthetic, columns)
    numeric = [c for c in names if is_numeric(real, c)]
    other = [c for c in names if c not in numeric]

    def rates(df: DataFrame, side: str) -> DataFrame:
        parts = []
        if numeric:
            n = unpivoted(as_number(df, numeric), numeric)
            parts.append(n.groupBy("variable").agg(F.avg("value").alias(f"mean_{side}"), F.stddev_samp("value").alias(f"sd_{side}"), F.avg(F.col("value").isNull().cast("int")).alias(f"missing_{side}")))
        if other:
            s = unpivoted(df, other, kind="string")
            parts.append(s.groupBy("variable").agg(F.lit(None).cast("double").alias(f"mean_{side}"), F.lit(None).cast("double").alias(f"sd_{side}"), F.avg(F.col("value").isNull().cast("int")).alias(f"missing_{side}")))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    out = rates(real, "real").join(rates(synthetic, "synthetic"), "variable")
    nothing = real.sparkSession.createDataFrame([], "variable string, ks double, wasserstein double, tvd double")
    if numeric:
        out = out.join(ks(real, synthetic, numeric), "variable", "left").join(wasserstein(real, synthetic, numeric), "variable", "left")
    else:
        out = out.join(nothing.select("variable", "ks", "wasserstein"), "variable", "left")
    out = out.join(total_variation(real, synthetic, other) if other else nothing.select("variable", "tvd"), "variable", "left")
    kind = F.when(F.col("variable").isin(numeric), "numeric").otherwise("categorical") if numeric else F.lit("categorical")
    return out.select("variable", kind.alias("type"), "ks", "wasserstein", "tvd", "mean_real", "mean_synthetic", "sd_real", "sd_synthetic", "missing_real", "missing_synthetic")


# Association -------------------------------------------------------------------------------------


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(value): correlation of average ranks over jointly observed rows; NULL below 3 rows or for a constant."""
    pair = as_number(df, [a, b]).dropna().toDF("a", "b")
    ranked = average_rank(average_rank(pair, "a", "ra"), "b", "rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("r")).select(F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r")).alias("value"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(value): bias-corrected Cramer's V; 0 where a side has one label."""
    cells = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().groupBy("a", "b").count()
    rows, cols = cells.groupBy("a").agg(F.sum("count").alias("ra")), cells.groupBy("b").agg(F.sum("count").alias("cb"))
    n = cells.agg(F.sum("count").alias("n"))
    size = rows.agg(F.count("*").alias("r")).crossJoin(cols.agg(F.count("*").alias("k"))).crossJoin(n)  # one row each
    chi = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("count") * F.col("count") / (F.col("ra") * F.col("cb"))).alias("s"))
    x = size.crossJoin(chi)
    phi2 = F.greatest(F.lit(0.0), (F.col("s") - 1) - (F.col("k") - 1) * (F.col("r") - 1) / (F.col("n") - 1))
    rt, kt = F.col("r") - (F.col("r") - 1) ** 2 / (F.col("n") - 1), F.col("k") - (F.col("k") - 1) ** 2 / (F.col("n") - 1)
    den = F.least(rt, kt) - 1
    return x.select(F.when(F.col("n") < 3, None).when((F.col("r") < 2) | (F.col("k") < 2) | (den <= 0), 0.0).otherwise(F.sqrt(phi2 / den)).alias("value"))


def correlation_ratio(df: DataFrame, number: str, label: str) -> DataFrame:
    """(value): square root of the share of rank variance between labels; 0 for one label or a constant."""
    pair = df.select(as_number_column(df, number).alias("x"), F.col(label).cast("string").alias("g")).dropna()
    ranked = average_rank(pair, "x", "r")
    groups = ranked.groupBy("g").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.sum(F.col("r") * F.col("r")).alias("q"))
    t = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum("q").alias("q"), F.count("*").alias("k"))
    between, total = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.when(F.col("n") < 3, None).when((F.col("k") < 2) | (total <= 0), 0.0).otherwise(F.sqrt(F.greatest(between, F.lit(0.0)) / total)).alias("value"))


def as_number_column(df: DataFrame, c: str):
    kind = df.schema[c].dataType
    x = F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(c)
    x = x.cast("double")
    return F.when(~missing(x), x)


def association_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_var, col_var, value): Spearman, bias-corrected Cramer's V, or correlation ratio by the pair's types.

    Columns without gaps are ranked once, all in one plan, and their pairs are read off one aggregation of
    the ranked rows and one of labels; only a pair with a number that has gaps, whose ranks are those of the rows
    that hold both, is computed by itself."""
    names, spark = columns or df.columns, df.sparkSession
    numeric = [c for c in names if is_numeric(df, c)]
    gaps = df.agg(F.count("*").alias("_n"), *[F.count_if(as_number_column(df, c).isNull() if c in numeric else F.col(c).isNull()).alias(c) for c in names]).first().asDict()
    whole = [c for c in numeric if not gaps[c]]
    labels = [c for c in names if c not in numeric]
    parts = [spark.createDataFrame([(a, a, 1.0) for a in names], "row_var string, col_var string, value double")]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for a, b in pairs:  # pairs of which a number has gaps
        if a in numeric and b in numeric and not (a in whole and b in whole):
            parts.append(_both_ways(spearman(df, a, b), a, b))
        elif (a in numeric) != (b in numeric):
            number, label = (a, b) if a in numeric else (b, a)
            if number not in whole or gaps[label]:
                parts.append(_both_ways(correlation_ratio(df, number, label), a, b))
    if len(labels) > 1:
        parts.append(_label_pairs(df, labels))
    crossed = [(x, g) for x in whole for g in labels if not gaps[g]]
    if len(whole) > 1 or crossed:
        parts.append(_rank_pairs(df, whole, [g for g in labels if not gaps[g]], crossed, gaps["_n"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _both_ways(value: DataFrame, a: str, b: str) -> DataFrame:
    return value.select(F.explode(F.array(*[F.struct(F.lit(x).alias("row_var"), F.lit(y).alias("col_var"), F.col("value")) for x, y in ((a, b), (b, a))])).alias("p")).select("p.*")


def _mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("row_var"), F.col("b").alias("col_var"), "value"), F.struct(F.col("b").alias("row_var"), F.col("a").alias("col_var"), "value"))).alias("p")).select("p.*")


def _label_pairs(df: DataFrame, labels: list[str]) -> DataFrame:
    """Cramer's V of all pairs of labels from one grouped count."""
    texts = df.select(*[F.col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(labels)])
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_g{i}").alias("x"), F.col(f"_g{j + i + 1}").alias("y")) for i, a in enumerate(labels) for j, b in enumerate(labels[i + 1 :])]))
    cells = texts.select(both.alias("p")).select("p.*").filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("c"))
    rows = cells.groupBy("a", "b", "x").agg(F.sum("c").alias("rx"))
    cols = cells.groupBy("a", "b", "y").agg(F.sum("c").alias("cy"))
    total = cells.groupBy("a", "b").agg(F.sum("c").alias("n"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("k"))
    chi = cells.join(rows, ["a", "b", "x"]).join(cols, ["a", "b", "y"]).groupBy("a", "b").agg(F.sum(F.col("c") * F.col("c") / (F.col("rx") * F.col("cy"))).alias("s"))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi2 = F.greatest(F.lit(0.0), (F.col("s") - 1) - (k - 1) * (r - 1) / (n - 1))
    den = F.least(r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)) - 1
    return _mirrored(chi.join(total, ["a", "b"]).select("a", "b", F.when(n < 3, None).when((r < 2) | (k < 2) | (den <= 0), 0.0).otherwise(F.sqrt(phi2 / den)).alias("value")))


def _rank_pairs(df: DataFrame, numeric: list[str], labels: list[str], crossed: list[tuple[str, str]], n: int) -> DataFrame:
    """Spearman and correlation ratios of columns without gaps: every column is ranked once."""
    wide = df.select(F.monotonically_increasing_id().alias("_row"), *[as_number_column(df, c).alias(f"_x{i}") for i, c in enumerate(numeric)], *[F.col(g).cast("string").alias(f"_g{i}") for i, g in enumerate(labels)])
    long = wide.select("_row", F.explode(F.array(*[F.struct(F.lit(i).alias("_v"), F.col(f"_x{i}").alias("_x")) for i in range(len(numeric))])).alias("p"), *[f"_g{i}" for i in range(len(labels))]).select("_row", "p.*", *[f"_g{i}" for i in range(len(labels))])
    counts = long.groupBy("_v", "_x").agg(F.count("*").alias("c"))
    ranks = running_totals(counts, "_v", "_x", ["c"]).select("_v", "_x", (F.col("c_upto") - (F.col("c") - 1) / 2.0).alias("_r"))
    ranked = long.join(ranks, ["_v", "_x"])
    out = []
    if len(numeric) > 1:
        rows = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_v") == i, F.col("_r"))).alias(f"r{i}") for i in range(len(numeric))])
        cor = [F.struct(F.lit(numeric[i]).alias("a"), F.lit(numeric[j]).alias("b"), F.corr(f"r{i}", f"r{j}").alias("value")) for i in range(len(numeric)) for j in range(i + 1, len(numeric))]
        found = rows.agg(F.array(*cor).alias("p")).select(F.explode("p").alias("p")).select("p.*")
        out.append(_mirrored(found.select("a", "b", F.when((F.lit(n) >= 3) & ~F.isnan("value"), F.col("value")).alias("value"))))
    if crossed:
        cells = ranked.select("_v", "_r", F.explode(F.array(*[F.struct(F.lit(i).alias("_l"), F.col(f"_g{i}").alias("_g")) for i in range(len(labels))])).alias("p")).select("_v", "_r", "p.*")
        groups = cells.groupBy("_v", "_l", "_g").agg(F.count("*").alias("n"), F.avg("_r").alias("m"), F.sum(F.col("_r") * F.col("_r")).alias("q"))
        t = groups.groupBy("_v", "_l").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum("q").alias("q"), F.count("*").alias("k"))
        between, total = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.col("n")
        value = F.when(F.col("n") < 3, None).when((F.col("k") < 2) | (total <= 0), 0.0).otherwise(F.sqrt(F.greatest(between, F.lit(0.0)) / total))
        of = lambda c, items: F.element_at(F.array(*[F.lit(x) for x in items]), F.col(c) + 1)
        out.append(_mirrored(t.select(of("_v", numeric).alias("a"), of("_l", labels).alias("b"), value.alias("value"))))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def pairwise_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n_pair, cov, corr) over jointly observed rows, in one pass."""
    x = as_number(df, columns)
    aggs = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n_pair"), F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corr")))
    return x.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


# Classifier-based utility -----------------------------------------------------------------------


def auc(scores: DataFrame, label: str, score: str) -> DataFrame:
    """(auc, n_positive, n_negative) by average ranks; NULL with one class."""
    ranked = average_rank(scores.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s")).dropna(), "s", "r")
    t = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("r1"), F.count_if(F.expr("y = 1")).alias("n1"), F.count_if(F.expr("y = 0")).alias("n0"))
    value = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return t.select(F.when((F.col("n1") > 0) & (F.col("n0") > 0), value).alias("auc"), F.col("n1").alias("n_positive"), F.col("n0").alias("n_negative"))


def _auc_numpy(y: np.ndarray, s: np.ndarray) -> float:
    values, where, counts = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[where]
    n1 = y.sum()
    n0 = len(y) - n1
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


def capped(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of a row number and ``seed``: copies of a row are chosen one by one."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).orderBy("_h").limit(rows).drop("_h")


@dataclass(frozen=True)
class Pmse:
    pmse: float
    null_expectation: float
    ratio: float
    n: int


def pmse(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, max_rows: int = 10_000, seed: int = 1, model: str = "linear") -> Pmse:
    """Propensity mean squared error of a logistic model that tells the sides apart, on at most ``max_rows`` a side."""
    data, y = stacked(real, synthetic, common_columns(real, synthetic, columns), max_rows, check_seed(seed))
    X = Features(data).matrix(data)
    if model == "quadratic":
        X = with_quadratics(X)
    elif model != "linear":
        raise ValueError("model must be linear or quadratic")
    X1 = np.column_stack([np.ones(len(y)), X])
    p = 1 / (1 + np.exp(-np.clip(X1 @ logistic(X1, y, 0.0), -30, 30)))
    c, k = y.mean(), np.linalg.matrix_rank(X1)
    value, null = float(((p - c) ** 2).mean()), float((k - 1) * (1 - c) ** 2 * c / len(y))
    return Pmse(value, null, value / null if null else math.nan, len(y))


def discriminator_auc(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, folds: int = 5, max_rows: int = 10_000, seed: int = 1, model: str = "quadratic") -> float:
    """Out-of-fold AUC of a logistic discriminator; near one half means indistinguishable."""
    data, y = stacked(real, synthetic, common_columns(real, synthetic, columns), max_rows, check_seed(seed))
    fold = np.random.default_rng(seed).permutation(np.arange(len(y)) % folds)
    out = np.zeros(len(y))
    for k in range(folds):
        train, test = fold != k, fold == k
        prep = Features(data[train])
        A, B = prep.matrix(data[train]), prep.matrix(data[test])
        if model == "quadratic":
            A, B = with_quadratics(A), with_quadratics(B)
        w = logistic(np.column_stack([np.ones(len(A)), A]), y[train], 1.0 if model == "quadratic" else 0.0)
        out[test] = np.column_stack([np.ones(len(B)), B]) @ w
    return _auc_numpy(y, out)


def formula_terms(formula: str) -> tuple[str, list[str]]:
    """(response, predictors) of "y ~ a + b"."""
    left, sign, right = formula.partition("~")
    terms = [t.strip() for t in right.split("+") if t.strip() not in ("", "1")]
    if not sign or not left.strip() or any(not t.replace("_", "").replace(".", "").isalnum() for t in terms):
        raise ValueError(f"a formula is a response, ~ and predictors joined by +, not {formula!r}")
    return left.strip(), terms


def _design(df: DataFrame, levels: dict[str, list[str]], response: str, predictors: list[str]) -> DataFrame:
    cols = [F.lit(1.0).alias("(Intercept)")]
    for p in predictors:
        if p in levels:
            cols += [F.when(F.col(p).isNotNull(), (F.col(p).cast("string") == v).cast("double")).alias(p + v) for v in levels[p][1:]]
        else:
            cols.append(as_number_column(df, p).alias(p))
    y = F.col(response).cast("double") if df.schema[response].dataType.typeName() == "boolean" else as_number_column(df, response)
    return df.select(*cols, y.alias("_y")).dropna()


def fitted_model(x: DataFrame, family: str = "gaussian", steps: int = 25) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, estimates and standard errors of a linear (gaussian), logistic (binomial) or log-linear (poisson) model of
    ``_y`` on the other columns: one aggregation of weighted cross products a Newton step."""
    names = x.columns[:-1]
    d = len(names)

    def products(weight, target) -> tuple[np.ndarray, np.ndarray, float, float]:
        row = x.select(*[F.col(f"`{a}`").alias(f"x{i}") for i, a in enumerate(names)], weight.alias("_w"), target.alias("_t"))
        row = row.agg(*[F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)], *[F.sum(F.col("_w") * F.col(f"x{i}") * F.col("_t")).alias(f"t{i}") for i in range(d)], F.sum(F.col("_w") * F.col("_t") * F.col("_t")).alias("tt"), F.count("*").alias("n")).first()
        A = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                A[i, j] = A[j, i] = row[f"s{i}_{j}"] or 0.0
        return A, np.array([row[f"t{i}"] or 0.0 for i in range(d)]), row["tt"] or 0.0, row["n"]

    y = F.col("_y")
    if family == "gaussian":
        A, b, tt, n = products(F.lit(1.0), y)
        inv = np.linalg.pinv(A)
        beta = inv @ b
        return names, beta, np.sqrt(np.diag(inv) * max(tt - beta @ b, 0.0) / max(n - d, 1))
    if family not in ("binomial", "poisson"):
        raise ValueError("family must be gaussian, binomial or poisson")
    beta = None
    for _ in range(steps):
        if beta is None:  # start from the data, as usual for these models
            mu = (y + 0.5) / 2 if family == "binomial" else y + 0.1
            eta = F.log(mu / (1 - mu)) if family == "binomial" else F.log(mu)
        else:
            eta = F.lit(0.0)
            for i, a in enumerate(names):
                eta = eta + F.lit(float(beta[i])) * F.col(f"`{a}`")
            mu = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
        weight = mu * (1 - mu) if family == "binomial" else mu
        A, b, _, _ = products(weight, eta + (y - mu) / weight)
        inv = np.linalg.pinv(A)
        new = inv @ b
        done = beta is not None and np.abs(new - beta).max() < 1e-9 * (1 + np.abs(new).max())
        beta = new
        if done:
            break
    return names, beta, np.sqrt(np.diag(inv))


def ci_overlap(real: DataFrame, synthetic: DataFrame, response: str, predictors: list[str] | None = None, level: float = 0.95, family: str = "gaussian") -> DataFrame:
    """(term, estimates, confidence limits, std_diff, overlap) of one model fitted on both sides.

    ``response`` is a column, with ``predictors``, or a formula "y ~ a + b".  Labels become dummies of the levels of the
    real side without the first.  Limits use the normal quantile; terms that a side cannot estimate have nulls."""
    from tabweave.functions.special import norm_ppf

    if predictors is None:
        response, predictors = formula_terms(response)
    z = float(norm_ppf((1 + level) / 2))
    levels = {p: sorted(r[0] for r in real.select(F.col(p).cast("string")).dropna().distinct().limit(1001).collect()) for p in predictors if not is_numeric(real, p)}
    if any(len(v) > 1000 for v in levels.values()):
        raise ValueError("a predictor has over 1000 labels")
    (names, br, sr), (_, bs, ss) = (fitted_model(_design(df, levels, response, predictors), family) for df in (real, synthetic))
    rows = []
    for t, b, s, c, d in zip(names, br, sr, bs, ss):
        lr, ur, ls, us = b - z * s, b + z * s, c - z * d, c + z * d
        inner = min(ur, us) - max(lr, ls)
        rows.append((t, float(b), float(c), float(lr), float(ur), float(ls), float(us), float((c - b) / s) if s > 0 else None, float((inner / (ur - lr) + inner / (us - ls)) / 2) if s > 0 and d > 0 else None))
    return real.sparkSession.createDataFrame(rows, "term string, estimate_real double, estimate_synthetic double, lower_real double, upper_real double, lower_synthetic double, upper_synthetic double, std_diff double, overlap double")


@dataclass(frozen=True)
class Comparison:
    marginal: DataFrame | None
    association_difference: float | None
    pmse: Pmse | None
    auc: float | None
    dcr: DataFrame | None

    def summary(self) -> list[tuple[str, float | None, str]]:
        """(metric, value, ideal): distances of marginals, association, utility and privacy in seven rows."""
        mean = top = None
        if self.marginal is not None:
            distance = F.coalesce("ks", "tvd")
            mean, top = self.marginal.agg(F.avg(distance), F.max(distance)).first()
        d = self.dcr.first() if self.dcr is not None else None
        return [("mean marginal distance", mean, "0"), ("max marginal distance", top, "0"), ("mean |association difference|", self.association_difference, "0"), ("pMSE ratio", self.pmse.ratio if self.pmse else None, "~1"), ("discriminator AUC", self.auc, "0.5"), ("exact copy rate", d["exact_match"] if d else None, "0"), ("DCR ratio", d["ratio"] if d else None, ">= 1")]


def compare(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, metrics: tuple[str, ...] = ("marginal", "association", "utility", "privacy"), max_rows: int = 5000, seed: int = 1) -> Comparison:
    """All metrics; marginals on whole tables, the others on at most ``max_rows`` rows a side (nearest records 2000)."""
    from tabweave.operators.risk import nearest_records

    names = common_columns(real, synthetic, columns)
    a, b = capped(real.select(*names), max_rows, seed), capped(synthetic.select(*names), max_rows, seed)
    difference = None
    if "association" in metrics:
        both = association_matrix(a).withColumnRenamed("value", "x").join(association_matrix(b).withColumnRenamed("value", "y"), ["row_var", "col_var"]).filter("row_var < col_var")
        difference = both.agg(F.avg(F.abs(F.col("x") - F.col("y")))).first()[0]
    return Comparison(
        marginal_metrics(real, synthetic, names) if "marginal" in metrics else None,
        difference,
        pmse(a, b, names, max_rows, seed) if "utility" in metrics else None,
        discriminator_auc(a, b, names, max_rows=max_rows, seed=seed) if "utility" in metrics else None,
        nearest_records(real, synthetic, names, min(max_rows, 2000), seed) if "privacy" in metrics else None,
    )
