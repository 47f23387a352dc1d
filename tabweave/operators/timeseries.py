"""Series: lag windows, autocorrelation, bootstraps and vector autoregressions."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions.rng import check_seed, uniform_hash, uniform_md5
from tabweave.functions.special import norm_cdf, norm_ppf
from tabweave.operators.ranks import running_totals


#: Rows of a series that one task holds while it looks back.
STRETCH = 100_000


def numbered(series: DataFrame, time: str, key: list[str], out: str = "_at") -> DataFrame:
    """``series`` with the number of each row, from 1, by time within its key: ranges of time are counted apart, so that no
    task sorts a whole series."""
    k = F.to_json(F.struct(*key)) if key else F.lit("")
    rows = series.withColumn("_key", k).withColumn("_one", F.lit(1))
    return running_totals(rows, "_key", time, ["_one"]).withColumnRenamed("_one_upto", out).drop("_one")


def looking_back(rows: DataFrame, at: str, back: int, columns: list[Callable[[Window], Column]], stretch: int | None = None) -> DataFrame:
    """``rows`` (numbered by ``at`` within ``_key``) with columns that see up to ``back`` earlier rows.

    A series is cut into stretches; each also gets the last ``back`` rows before it, which are left out of the result."""
    size = max(stretch or STRETCH, back)
    own = F.floor((F.col(at) - 1) / size)
    twice = F.when((F.col(at) - 1) % size >= size - back, F.array(own, own + 1)).otherwise(F.array(own))
    cut = rows.withColumn("_own", own).withColumn("_part", F.explode(twice))
    w = Window.partitionBy("_key", "_part").orderBy(at)
    return cut.select("*", *[c(w) for c in columns]).filter("_own = _part").drop("_own", "_part")


def ts_windows(series: DataFrame, time: str, values: list[str], lags: int, horizon: int = 1, target: str | None = None, key: list[str] | None = None, stretch: int | None = None) -> DataFrame:
    """Rows (key..., time, y, lags) for supervised learning; never across series.

    ``y`` is the target at a time, ``lag_k`` a value horizon + k - 1 steps before; one value
    column gives ``lagk``, several give ``<name>_lagk``."""
    if lags < 1 or horizon < 1:
        raise ValueError("lags and horizon must be at least 1")
    key, target = key or [], target or values[0]
    names = [(v, k, f"lag{k}" if len(values) == 1 else f"{v}_lag{k}") for v in values for k in range(1, lags + 1)]
    rows = numbered(series, time, key)
    laid = looking_back(rows, "_at", lags + horizon - 1, [lambda w, v=v, k=k, n=n: F.lag(v, horizon + k - 1).over(w).alias(n) for v, k, n in names], stretch)
    return laid.filter(F.col("_at") >= lags + horizon).select(*key, time, F.col(target).alias("y"), *[n for _, _, n in names])


def interpolated(series: DataFrame, time: str, value: str, key: list[str] | None = None) -> DataFrame:
    """Gaps filled on the line between neighbours; ends hold the nearest value."""
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy(time)
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(value).isNotNull(), F.row_number().over(w))
    a = series.withColumn("_i", F.row_number().over(w)).withColumn("_p", place)
    a = a.withColumn("_p0", F.last("_p", True).over(past)).withColumn("_v0", F.last(value, True).over(past)).withColumn("_p1", F.first("_p", True).over(ahead)).withColumn("_v1", F.first(value, True).over(ahead))
    line = F.when(F.col("_p0").isNull(), F.col("_v1")).when(F.col("_p1").isNull() | (F.col("_p0") == F.col("_p1")), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_p0")) / (F.col("_p1") - F.col("_p0")))
    return a.withColumn(value, line).drop("_i", "_p", "_p0", "_v0", "_p1", "_v1")


def acf(series: DataFrame, time: str, value: str, lag_max: int = 24, key: list[str] | None = None, stretch: int | None = None) -> DataFrame:
    """(key..., lag, acf): autocovariance over the length of the series, at lags 1 to ``lag_max``."""
    key = key or []
    seen = series.filter(F.col(value).isNotNull()).select(*key, time, value)
    rows = numbered(seen, time, key)
    middle = rows.groupBy("_key").agg(F.avg(value).alias("_mean"))
    rows = rows.join(F.broadcast(middle) if not key else middle, "_key").withColumn("d", F.col(value) - F.col("_mean"))
    laid = looking_back(rows, "_at", lag_max, [lambda w, k=k: F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lag_max + 1)], stretch)
    total = laid.groupBy(*key).agg(F.sum(F.col("d") * F.col("d")).alias("s0"), *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lag_max + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.coalesce(f"s{k}", F.lit(0.0)) / F.col("s0")).alias("acf")) for k in range(1, lag_max + 1)])
    return total.select(*key, F.explode(pairs).alias("p")).select(*key, "p.*")


def _uniform(rng: str):
    return uniform_md5 if rng == "md5" else uniform_hash


def bootstrap(series: DataFrame, time: str, values: list[str], n: int, method: str = "block", block_length: int | None = None, seed: int = 1, rng: str = "md5", length: int | None = None) -> DataFrame:
    """(t, values...): ``n`` steps resampled from one series by circular blocks, stationary blocks or single rows.

    The series is numbered 1..N by time; a new row is a start plus an offset, modulo N, joined back by number."""
    check_seed(seed)
    size = length or series.count()
    L = block_length or math.ceil(size ** (1 / 3))
    source = numbered(series.select(time, *values), time, []).select("_at", *values)
    u, ids = _uniform(rng), series.sparkSession.range(int(n))

    def start(row: Column) -> Column:
        return F.floor(u(seed, "start", row) * size)

    if method == "iid":
        drawn = ids.select(F.col("id"), (start(F.col("id")) + 1).alias("_at"))
    elif method == "block":
        b = F.floor(F.col("id") / L)
        drawn = ids.select("id", (F.pmod(start(b) + F.col("id") - b * L, F.lit(size)) + 1).alias("_at"))
    elif method == "stationary":
        flag = (F.col("id") == 0) | (u(seed, "restart", F.col("id")) < F.lit(1.0 / L))
        marked = ids.select("id", F.floor(F.col("id") / STRETCH).alias("_part"), F.when(flag, F.col("id")).alias("_start"))
        ends = marked.groupBy("_part").agg(F.max("_start").alias("_last"))  # one row a stretch
        before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("_part", F.max("_last").over(before).alias("_before"))
        run = Window.partitionBy("_part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        first = marked.join(ends, "_part").select("id", F.coalesce(F.max("_start").over(run), "_before").alias("s"))
        drawn = first.select("id", (F.pmod(start(F.col("s")) + F.col("id") - F.col("s"), F.lit(size)) + 1).alias("_at"))
    else:
        raise ValueError("method must be block, stationary or iid")
    return drawn.join(source, "_at").select((F.col("id") + 1).alias("t"), *values)


METHODS = ("copula_var", "block", "stationary", "iid")


@dataclass
class ResampledSeries:
    """A series that is resampled: by blocks, or (``iid``) as independent rows of a copula model of its columns."""

    names: list[str]
    method: str
    series: DataFrame
    time: str
    size: int
    block_length: int | None
    cross: object = None
    start: float = 1.0
    frequency: float = 1.0

    def generate(self, spark: SparkSession, n: int, sims: int = 1, seed: int = 1) -> DataFrame:
        out = None
        for sim in range(sims):
            if self.method == "iid":
                from tabweave.operators.synthesizer import generate

                drawn = numbered(generate(self.cross, spark, n, seed + sim).withColumn("_id", F.monotonically_increasing_id()), "_id", []).select(F.col("_at").cast("long").alias("t"), *self.names)
            else:
                drawn = bootstrap(self.series, self.time, self.names, n, self.method, self.block_length, seed + sim, length=self.size)
            one = drawn.select(F.lit(sim + 1).cast("long").alias("sim"), "t", *self.names)
            out = one if out is None else out.unionByName(one)
        return out


@dataclass
class SeriesModel:
    """A vector autoregression of normal scores with its marginal quantiles."""

    names: list[str]
    order: int
    coefficients: np.ndarray  # order x d x d
    residuals: np.ndarray
    history: np.ndarray
    values: np.ndarray  # sorted, a column a series
    scale: np.ndarray
    burn_in: int = 100
    start: float = 1.0
    frequency: float = 1.0


def fit_series(series: DataFrame, time: str, values: list[str], max_lag: int = 10, order: int | None = None, burn_in: int = 100, max_points: int = 1_000_000, method: str = "copula_var", block_length: int | None = None, start: float = 1.0, frequency: float = 1.0, **settings) -> SeriesModel | ResampledSeries:
    """A model of one series by ``method``: ``copula_var`` (Yule-Walker on the driver, at most ``max_points`` points, order
    by AIC), ``block`` and ``stationary`` (resampling, any length) or ``iid`` (a copula model of the columns, with
    ``settings`` of synthesizer.fit).  ``start`` and ``frequency`` are kept for ``dated``."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if method != "copula_var" and (order is not None or max_lag != 10 or burn_in != 100):
        warnings.warn(f"order, max_lag and burn_in are not used by method {method}", stacklevel=2)
    if block_length is not None and method not in ("block", "stationary"):
        warnings.warn(f"block_length is not used by method {method}", stacklevel=2)
    if settings and method != "iid":
        raise TypeError(f"unknown settings: {', '.join(settings)}")
    if method != "copula_var":
        gaps = series.agg(F.count("*"), *[F.count_if(F.col(v).isNull()) for v in values]).first()
        if gaps[0] < 10:
            raise ValueError("a series needs at least ten points")
        if any(gaps[1:]):
            warnings.warn("missing points were interpolated", stacklevel=2)
            for v, k in zip(values, gaps[1:]):
                series = interpolated(series, time, v) if k else series
        cross = None
        if method == "iid":
            from tabweave.operators.synthesizer import fit

            cross = fit(series.select(*values), **settings)
        length = max(1, math.ceil(gaps[0] ** (1 / 3))) if block_length is None else min(block_length, gaps[0])
        return ResampledSeries(values, method, series.select(time, *values), time, gaps[0], None if method == "iid" else length, cross, start, frequency)
    rows = series.select(time, *[F.col(v).cast("double").alias(v) for v in values]).orderBy(time).limit(max_points + 1).toPandas()
    if len(rows) > max_points:
        raise ValueError("the series is longer than max_points")
    X = rows[values].to_numpy(float)
    n, d = X.shape
    if n < 10:
        raise ValueError("a series needs at least ten points")
    if np.isnan(X).any():
        warnings.warn("missing points were interpolated", stacklevel=2)
        X = pd.DataFrame(X).interpolate(limit_direction="both").to_numpy()
    Z = norm_ppf(np.column_stack([pd.Series(X[:, k]).rank().to_numpy() for k in range(d)]) / (n + 1))
    C = Z - Z.mean(axis=0)
    top = order if order is not None else max(0, min(max_lag, n // (2 * d + 2), n - 2))
    if order is not None and order * d >= n - order:
        raise ValueError("order is too large for the series")
    G = [C[h:].T @ C[: n - h] / n for h in range(top + 1)]
    best = None
    for p in range(order if order is not None else 0, top + 1):
        A = np.zeros((0, d, d))
        S = G[0]
        if p:
            T = np.block([[G[j - i] if j >= i else G[i - j].T for j in range(p)] for i in range(p)])
            flat = np.linalg.lstsq(T.T, np.hstack(G[1 : p + 1]).T, rcond=None)[0].T
            A = np.stack([flat[:, k * d : (k + 1) * d] for k in range(p)])
            S = G[0] - sum(A[k] @ G[k + 1].T for k in range(p))
        aic = n * np.linalg.slogdet(S + 1e-12 * np.eye(d))[1] + 2 * p * d * d
        if best is None or aic < best[0]:
            best = (aic, p, A)
    _, p, A = best
    E = C[p:] - sum((C[p - k - 1 : n - k - 1] @ A[k].T for k in range(p)), np.zeros((n - p, d)))
    model = SeriesModel(values, p, A, E - E.mean(axis=0), C, np.sort(X, axis=0), np.ones(d), burn_in, start, frequency)
    model.scale = np.maximum(_path(model, 5000, np.random.default_rng(20260101)).std(axis=0), 1e-12)
    return model


def _path(m: SeriesModel, n: int, rng: np.random.Generator) -> np.ndarray:
    p, total = m.order, n + m.burn_in
    E = m.residuals[rng.integers(0, len(m.residuals), total)]
    if not p:
        return E[m.burn_in :]
    s = int(rng.integers(0, len(m.history) - p + 1))
    Z = np.vstack([m.history[s : s + p], np.zeros((total, len(m.names)))])
    for t in range(total):
        Z[p + t] = E[t] + sum(m.coefficients[k] @ Z[p + t - k - 1] for k in range(p))
    return Z[p + m.burn_in :]


def dated(paths: DataFrame, model: SeriesModel | ResampledSeries) -> DataFrame:
    """``paths`` with the time of each step: the model's start and one step a ``1 / frequency``."""
    return paths.withColumn("time", F.lit(float(model.start)) + (F.col("t") - 1) / F.lit(float(model.frequency)))


def augment_series(series: DataFrame, time: str, values: list[str], sims: int = 20, n: int | None = None, keep_real: bool = True, seed: int = 1, **settings) -> DataFrame:
    """(sim, t, values...): the real series as sim 0, and ``sims`` simulated ones of its length (or ``n``)."""
    if "closeness" in settings or "perturb" in settings or "label" in settings:
        warnings.warn("closeness, perturb and label apply to tables only and were ignored", stacklevel=2)
        settings = {k: v for k, v in settings.items() if k not in ("closeness", "perturb", "label")}
    model = fit_series(series, time, values, **settings)
    new = generate_series(model, series.sparkSession, n or series.count(), sims, seed)
    real = numbered(series.select(time, *values), time, []).select(F.lit(0).cast("long").alias("sim"), F.col("_at").cast("long").alias("t"), *[F.col(v).cast("double").alias(v) for v in values])
    return real.unionByName(new.select("sim", "t", *[F.col(v).cast("double").alias(v) for v in values])) if keep_real else new


def generate_series(model: SeriesModel | ResampledSeries, spark: SparkSession, n: int, sims: int = 1, seed: int = 1) -> DataFrame:
    """(sim, t, values...): one path a task, any length."""
    check_seed(seed)
    if n < 1:
        raise ValueError("n must be a positive whole number")
    if isinstance(model, ResampledSeries):
        return model.generate(spark, n, sims, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sim in f["id"]:
                U = norm_cdf(_path(model, n, np.random.default_rng([abs(seed), int(sim)])) / model.scale)
                X = {c: np.interp(U[:, k] * (len(model.values) - 1), np.arange(len(model.values)), model.values[:, k]) for k, c in enumerate(model.names)}
                yield pd.DataFrame({"sim": int(sim) + 1, "t": np.arange(1, n + 1), **X})

    return spark.range(0, sims, 1, min(sims, 200)).mapInPandas(run, "sim long, t long, " + ", ".join(f"`{c}` double" for c in model.names))
