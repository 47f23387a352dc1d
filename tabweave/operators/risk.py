"""Disclosure risk and distances to the nearest record."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.metrics import as_number_column, capped, common_columns, is_numeric
from tabweave.operators.ranks import quantile_grid

EPSILON = 2.0**-52


def _same(a: DataFrame, b: DataFrame, columns: list[str], left: str = "_l", right: str = "_r") -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _normal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys with NaN as NULL and -0.0 as 0.0."""
    out = []
    for c in columns:
        if df.schema[c].dataType.typeName() in ("double", "float"):
            out.append(F.when(~F.isnan(c), F.col(c) + 0.0).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return _normal(df, keys).groupBy(*keys).count()


def replicated_uniques(real: DataFrame, synthetic: DataFrame, keys: list[str]) -> DataFrame:
    """(n_real_uniques, real_unique_rate, replicated_uniques)."""
    a, b = key_counts(real, keys).filter("count = 1").alias("_l"), key_counts(synthetic, keys).filter("count = 1").alias("_r")
    hit = a.join(b, _same(a, b, keys), "leftsemi").agg(F.count("*").alias("hit"))
    n = key_counts(real, keys).agg(F.count_if(F.expr("count = 1")).alias("n_real_uniques"), F.sum("count").alias("n"))
    return n.crossJoin(hit).select("n_real_uniques", (F.col("n_real_uniques") / F.col("n")).alias("real_unique_rate"), F.when(F.col("n_real_uniques") > 0, F.col("hit") / F.col("n_real_uniques")).otherwise(0.0).alias("replicated_uniques"))


def exact_copies(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(exact_copies): share of synthetic rows that equal a real row on all common columns but ``ignore``."""
    names = [c for c in common_columns(real, synthetic, columns) if c not in ignore]
    a, b = _normal(synthetic, names).groupBy(*names).count().alias("_l"), _normal(real, names).distinct().alias("_r")
    hit = a.join(b, _same(a, b, names), "leftsemi").agg(F.sum("count").alias("hit"))
    n = synthetic.agg(F.count("*").alias("n"))
    return n.crossJoin(hit).select((F.coalesce("hit", F.lit(0)) / F.col("n")).alias("exact_copies"))


def predictions(synthetic: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Median (numbers) or mode (labels, smallest on ties) of ``target`` per key.

    Medians are read off ranks, so no task holds all values of a key."""
    k = _normal(synthetic.select(*keys, target), [*keys, target])
    if not is_numeric(synthetic, target):
        counts = k.filter(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count("*").alias("n"))
        best = counts.groupBy(*keys).agg(F.max("n").alias("top"))
        a, b = counts.alias("_l"), best.alias("_r")
        tied = a.join(b, _same(a, b, keys) & (F.col("_l.n") == F.col("_r.top"))).select("_l.*")
        guess = tied.groupBy(*keys).agg(F.min(target).alias("guess"))
        a, b = k.select(*keys).distinct().alias("_l"), guess.alias("_r")
        return a.join(b, _same(a, b, keys), "left").select("_l.*", "guess")
    named = k.select(*keys, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"), as_number_column(k, target).alias("_x"))
    middle = quantile_grid(named, "_key", "_x", 1).select("_key", F.col("q").alias("guess"))
    return named.select(*keys, "_key").distinct().join(middle, "_key", "left").select(*keys, "guess")


def attribute_risk(real: DataFrame, synthetic: DataFrame, keys: list[str], target: str, tolerance: float = 0.1, abs_tolerance: float = 0.0) -> DataFrame:
    """(match_rate, cap, cap_uniques, cap_baseline): how well the synthetic majority per key predicts the target."""
    numeric = is_numeric(real, target)
    rows = _normal(real.select(*keys, target), [*keys, target])
    y = as_number_column(rows, target) if numeric else F.col(target)
    rows = rows.select(*keys, y.alias("y"))
    sizes = key_counts(real, keys).withColumnRenamed("count", "n")
    a, s = rows.alias("_l"), sizes.alias("_r")
    rows = a.join(s, _same(a, s, keys), "left").select("_l.*", "n")
    a, p = rows.alias("_l"), predictions(synthetic, keys, target).alias("_r")
    rows = a.join(p, _same(a, p, keys), "left").select("_l.*", "guess")

    def right(guess: Column) -> Column:
        if not numeric:
            return guess == F.col("y")
        return F.abs(guess - F.col("y")) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs("y"), F.lit(EPSILON)), F.lit(float(abs_tolerance)))

    if numeric:
        whole = quantile_grid(real.select(F.lit(0).alias("k0"), as_number_column(real, target).alias("t")), "k0", "t", 1).agg(F.max("q").alias("base"))
    else:
        whole = real.agg(F.mode(target, True).alias("base"))
    matched = F.col("guess").isNotNull() & F.col("y").isNotNull()
    return rows.crossJoin(whole).agg(
        F.avg(matched.cast("double")).alias("match_rate"),
        F.avg(F.when(matched, right(F.col("guess")).cast("double"))).alias("cap"),
        F.avg(F.when(matched & (F.col("n") == 1), right(F.col("guess")).cast("double"))).alias("cap_uniques"),
        F.avg(F.when(F.col("y").isNotNull(), right(F.col("base")).cast("double"))).alias("cap_baseline"),
    )


@dataclass(frozen=True)
class Disclosure:
    n_real_uniques: int
    real_unique_rate: float
    replicated_uniques: float
    exact_copies: float
    attributes: dict[str, dict[str, float | None]]


def disclosure_risk(real: DataFrame, synthetic: DataFrame, keys: list[str], target: list[str] | str = (), ignore: tuple[str, ...] = (), tolerance: float = 0.1, abs_tolerance: float = 0.0) -> Disclosure:
    """Unique keys, their replication, exact copies, and attribute disclosure for each target."""
    targets = [target] if isinstance(target, str) else list(target)
    absent = [c for c in (*keys, *targets, *ignore) if c not in real.columns or c not in synthetic.columns]
    if absent:
        raise ValueError(f"not in both tables: {', '.join(absent)}")
    if not keys or set(keys) & set(targets) or set(ignore) & {*keys, *targets}:
        raise ValueError("keys, targets and ignored columns must be disjoint, and keys not empty")
    if tolerance < 0 or abs_tolerance < 0:
        raise ValueError("tolerances must not be negative")
    u = replicated_uniques(real, synthetic, keys).first()
    return Disclosure(u[0], u[1], u[2], exact_copies(real, synthetic, ignore=tuple(ignore)).first()[0], {t: attribute_risk(real, synthetic, keys, t, tolerance, abs_tolerance).first().asDict() for t in targets})


def gower(a: np.ndarray, b: np.ndarray, numeric: np.ndarray, exclude: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distances and compared shares of all rows of a with all of b; numbers are scaled by the real range."""
    total, compared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        x, y = a[:, None, k], b[None, :, k]
        gx, gy = np.isnan(x), np.isnan(y)
        both = ~gx & ~gy
        with np.errstate(invalid="ignore"):
            d = np.where(both, np.minimum(np.abs(x - y), 1.0) if numeric[k] else (x != y).astype(float), 0.0)
        total += d if exclude else np.where(gx & gy, 0.0, np.where(gx | gy, 1.0, d))
        compared += both if exclude else 1.0
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(compared > 0, total / np.where(exclude, compared, a.shape[1]), np.nan), compared / a.shape[1]


def nearest(a: np.ndarray, b: np.ndarray, numeric: np.ndarray, exclude: bool, own: bool = False, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the nearest row of b, and the largest compared share among equally near ones; by blocks of rows."""
    best, share = np.full(len(a), np.nan), np.full(len(a), np.nan)
    for at in range(0, len(a), block):
        d, w = gower(a[at : at + block], b, numeric, exclude)
        if own:
            d[np.arange(len(d)), at + np.arange(len(d))] = np.nan
        d = np.where(np.isnan(d), np.inf, d)
        low = d.min(axis=1) if d.shape[1] else np.full(len(d), np.inf)
        near = d <= low[:, None] + 1e-15
        best[at : at + block] = np.where(np.isfinite(low), low, np.nan)
        share[at : at + block] = np.where(np.isfinite(low), np.where(near, w, 0).max(axis=1, initial=0), np.nan)
    return best, share


def nearest_records(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, max_rows: int = 2000, seed: int = 1, close_quantile: float = 0.05, na: str = "category") -> DataFrame:
    """Distance to the closest record: quantiles for synthetic-to-real and real-to-real, and rates.

    At most ``max_rows`` rows of each side are asked for (chosen one by one, copies too); each is compared with all real
    rows, where these lie: a task keeps the two nearest of its rows for each question, and these are merged.
    A real row's own distance is the second of its two nearest, itself being one."""
    if na not in ("category", "exclude"):
        raise ValueError("na must be category or exclude")
    names = common_columns(real, synthetic, columns)
    numeric = np.array([is_numeric(real, c) for c in names])
    span = real.agg(*[(F.max(as_number_column(real, c)) - F.min(as_number_column(real, c))).alias(f"r{i}") for i, c in enumerate(names) if numeric[i]]).first().asDict() if numeric.any() else {}
    scale = [float(span.get(f"r{i}") or 1.0) for i in range(len(names))]
    plain = lambda df: df.select(*[as_number_column(df, c).alias(f"c{i}") if numeric[i] else F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    asked = [capped(plain(df), max_rows, seed).toArrow().to_pydict() for df in (real, synthetic)]  # at most ``max_rows`` rows a side
    codes = [None if numeric[i] else {v: k for k, v in enumerate(sorted({*asked[0][f"c{i}"], *asked[1][f"c{i}"]} - {None}))} for i in range(len(names))]
    exclude = na == "exclude"

    def matrix(columns_: dict) -> np.ndarray:  # labels that no question holds differ from all of them alike
        out = [[np.nan if v is None else v / scale[i] if numeric[i] else float(codes[i].get(v, -1)) for v in columns_[f"c{i}"]] for i in range(len(names))]
        return np.array(out, float).reshape(len(names), -1).T

    A, B = (matrix(x) for x in asked)
    Q = np.vstack([A, B])

    def run(batches):
        best, share = np.full((len(Q), 2), np.inf), np.zeros((len(Q), 2))
        for b in batches:
            rows = matrix(b.to_pydict())
            for at in range(0, len(rows), 512):
                for q in range(0, len(Q), 512):
                    two_nearest(Q[q : q + 512], rows[at : at + 512], numeric, exclude, best[q : q + 512], share[q : q + 512])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(Q))), *[pa.array(x) for x in (best[:, 0], best[:, 1], share[:, 0], share[:, 1])]], names=["q", "d0", "d1", "w0", "w1"])

    found = plain(real).mapInArrow(run, "q long, d0 double, d1 double, w0 double, w1 double")
    near = found.select("q", F.explode(F.array(F.struct(F.col("d0").alias("d"), (-F.col("w0")).alias("w")), F.struct(F.col("d1").alias("d"), (-F.col("w1")).alias("w")))).alias("p"))
    merged = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("p")), 1, 2).alias("p")).orderBy("q").collect()  # two rows a task and question, then one a question
    D = np.array([[x["d"] for x in r["p"]] + [np.inf] * (2 - len(r["p"])) for r in merged]).reshape(-1, 2)
    W = np.array([[-x["w"] for x in r["p"]] + [0.0] * (2 - len(r["p"])) for r in merged]).reshape(-1, 2)
    D[~np.isfinite(D)] = np.nan
    own, own_share, d, share = D[: len(A), 1], W[: len(A), 1], D[len(A) :, 0], np.where(np.isnan(D[len(A) :, 0]), np.nan, W[len(A) :, 0])
    q = lambda x, p: float(np.nanquantile(x, p)) if np.isfinite(x).any() else None
    cut, median = q(own, close_quantile), q(own, 0.5)
    mean = lambda x: float(np.mean(x)) if len(x) else None
    row = (*[q(d, p) for p in (0.01, 0.05, 0.25, 0.5)], *[q(own, p) for p in (0.01, 0.05, 0.25, 0.5)], mean((d < 1e-12) & (share >= 1)), mean(d < 1e-12), mean(share[np.isfinite(share)]), mean(d < cut) if cut is not None else None, mean((own < 1e-12) & (own_share >= 1)), q(d, 0.5) / median if median else None)
    names_out = [*[f"syn_q{p}" for p in (1, 5, 25, 50)], *[f"real_q{p}" for p in (1, 5, 25, 50)], "exact_match", "zero_distance", "compared_share", "close_share", "real_duplicate_rate", "ratio"]
    return real.sparkSession.createDataFrame([row], ", ".join(f"{n} double" for n in names_out))


def two_nearest(questions: np.ndarray, rows: np.ndarray, numeric: np.ndarray, exclude: bool, best: np.ndarray, share: np.ndarray) -> None:
    """Merge the distances of ``questions`` to ``rows`` into the two least so far and their compared shares, in place;
    of equally near rows those with larger shares count."""
    d, w = gower(questions, rows, numeric, exclude)
    d = np.hstack([best, np.where(np.isnan(d), np.inf, d)])
    w = np.hstack([share, w])
    low = np.partition(d, 1, axis=1)[:, :2]
    for k in range(2):
        share[:, k] = np.where(d <= low[:, k : k + 1] + 1e-15, w, 0.0).max(axis=1)
    best[:] = low
