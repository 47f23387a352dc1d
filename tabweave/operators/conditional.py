"""One column drawn from a model given the others: trees, smooth ridge regressions, multinomial logits.

Trees are Spark ML regressions whose leaves carry their residuals; smooth models
are penalised spline regressions from one Gram aggregate.  There are no surrogate
splits: a gap takes the training median, with a flag of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rng import uniform_hash
from tabweave.operators.metrics import as_number_column, is_numeric

MAX_LEVELS = 30


class Encoder:
    """Predictors as numbers: medians with a flag, and dummies of at most MAX_LEVELS labels."""

    def __init__(self, df: DataFrame, predictors: list[str]):
        self.plan: list[tuple[str, str, object]] = []
        numeric = [p for p in predictors if is_numeric(df, p)]
        if numeric:
            r = df.agg(*[F.percentile_approx(as_number_column(df, p), 0.5, 10_000).alias(f"m{i}") for i, p in enumerate(numeric)], *[F.count_if(as_number_column(df, p).isNull()).alias(f"n{i}") for i, p in enumerate(numeric)]).first()
            for i, p in enumerate(numeric):
                self.plan.append((p, "number", float(r[f"m{i}"] or 0.0)))
                if r[f"n{i}"]:
                    self.plan.append((p, "flag", None))
        for p in predictors:
            if p not in numeric:
                levels = [x[0] for x in df.select(F.coalesce(F.col(p).cast("string"), F.lit("MISSING"))).distinct().limit(MAX_LEVELS + 1).collect()]
                if len(levels) > MAX_LEVELS:
                    raise ValueError(f"{p} has more than {MAX_LEVELS} labels")
                for v in sorted(levels)[1:]:
                    self.plan.append((p, "label", v))

    def columns(self, df: DataFrame):
        out = []
        for i, (p, kind, how) in enumerate(self.plan):
            if kind == "number":
                x = F.coalesce(as_number_column(df, p), F.lit(how))
            elif kind == "flag":
                x = as_number_column(df, p).isNull().cast("double")
            else:
                x = (F.coalesce(F.col(p).cast("string"), F.lit("MISSING")) == how).cast("double")
            out.append(x.alias(f"_f{i}"))
        return out

    def assembled(self, df: DataFrame, keep: list[str]) -> DataFrame:
        x = df.select(*keep, *self.columns(df))
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(self.plan))], outputCol="_x").transform(x).select(*keep, "_x")


RESIDUALS, CALIBRATIONS = ("leaf", "global", "none"), ("quantile", "none")
#: Quantiles that stand for the residuals of a leaf, and rows of the sample that a calibration is read off.
POOL, REFERENCE = 500, 20_000


def _pools(fitted: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _pool): residuals as at most POOL sorted quantiles with mean 0; no task holds all residuals of a leaf."""
    grid = F.array(*[F.lit((i + 0.5) / POOL) for i in range(POOL)])
    pools = fitted.groupBy(*by).agg(F.percentile_approx("residual", grid, F.lit(20 * POOL)).alias("_pool"))
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)
    return pools.withColumn("_mean_of", mean(F.col("_pool"))).withColumn("_pool", F.expr("transform(_pool, x -> x - _mean_of)")).drop("_mean_of")


@dataclass
class TreeModel:
    encoder: Encoder
    tree: object
    pools: DataFrame  # (_leaf, _pool), a row a leaf
    whole: list[float]  # the pool of all leaves
    target: str

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return self.tree.transform(self.encoder.assembled(df, keep)).withColumnRenamed("prediction", "_mean").drop("_x")

    def distribution(self, df: DataFrame, keep: list[str], residual: str = "leaf") -> DataFrame:
        """keep..., _mean, _pool: the fitted mean and the residuals that a draw picks from."""
        p = self.predict(df, keep)
        if residual == "leaf":
            return p.join(F.broadcast(self.pools), "_leaf")  # at most 2^maxdepth rows of POOL numbers
        return p.withColumn("_pool", F.lit(self.whole if residual == "global" else [0.0]))

    def draw(self, df: DataFrame, row_id: str, seed: int, residual: str = "leaf") -> DataFrame:
        """(row_id, draw): leaf mean plus a residual of the leaf, or of all leaves, picked by hash."""
        at = F.floor(uniform_hash(seed, "residual", F.col(row_id)) * F.size("_pool")).cast("int") + 1
        return self.distribution(df, [row_id], residual).select(row_id, (F.col("_mean") + F.element_at("_pool", at)).alias("draw"))


def fit_tree(df: DataFrame, target: str, predictors: list[str], minbucket: int = 20, cp: float = 0.001, maxdepth: int = 10) -> TreeModel:
    """Regression tree; ``cp`` is the least share of the target's variance that a split must explain."""
    enc = Encoder(df, predictors)
    y = df.withColumn("_y", as_number_column(df, target)).filter("_y is not null")
    stats = y.agg(F.count("*"), F.var_pop("_y")).first()
    if stats[0] < max(10, 2 * minbucket):
        raise ValueError("too few observed responses")
    data = enc.assembled(y, ["_y"])
    tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", leafCol="_leaf", minInstancesPerNode=minbucket, maxDepth=maxdepth, minInfoGain=float(cp * (stats[1] or 0.0)), seed=1).fit(data)
    fitted = tree.transform(data).select("_leaf", (F.col("_y") - F.col("prediction")).alias("residual"))
    pools = _pools(fitted, ["_leaf"]).toArrow()  # a row a leaf
    return TreeModel(enc, tree, df.sparkSession.createDataFrame(pools), list(_pools(fitted, []).first()["_pool"]), target)


@dataclass
class SmoothModel:
    encoder: Encoder
    knots: list[np.ndarray | None]
    beta: np.ndarray
    means: np.ndarray
    residuals: np.ndarray
    local: int

    def mean(self, df: DataFrame):
        x = F.lit(float(self.beta[0]))
        for k, b in enumerate(_basis(df, self.encoder, self.knots)):
            x = x + F.lit(float(self.beta[k + 1])) * b
        return x

    def local_pools(self, mean: np.ndarray, residual: str) -> np.ndarray:
        """For each mean the residuals that a draw picks from: those of the nearest training means, centred, or of all."""
        if residual == "none":
            return np.zeros((len(mean), 1))
        if residual == "global":
            return np.broadcast_to(np.quantile(self.residuals, (np.arange(POOL) + 0.5) / POOL) - self.residuals.mean(), (len(mean), POOL))
        local = min(self.local, len(self.means))
        lo = np.clip(np.searchsorted(self.means, mean) - local // 2, 0, len(self.means) - local)
        near = self.residuals[lo[:, None] + np.arange(local)]
        return near - near.mean(axis=1, keepdims=True)

    def draw(self, df: DataFrame, row_id: str, seed: int, residual: str = "leaf") -> DataFrame:
        """(row_id, draw): fitted mean plus a residual of one of the nearest training means, or of any."""

        @F.pandas_udf("double")
        def pick(mean: pd.Series, u: pd.Series) -> pd.Series:
            pools = self.local_pools(mean.to_numpy(float), residual)
            at = np.minimum((u.to_numpy() * pools.shape[1]).astype(int), pools.shape[1] - 1)
            return pd.Series(mean.to_numpy(float) + pools[np.arange(len(at)), at])

        return df.select(row_id, pick(self.mean(df), uniform_hash(seed, "residual", F.col(row_id))).alias("draw"))


def _basis(df: DataFrame, enc: Encoder, knots: list[np.ndarray | None]):
    """Each number with its cubic truncated powers at the knots; other features as they are."""
    out = []
    for (p, kind, how), k, x in zip(enc.plan, knots, enc.columns(df)):
        out.append(x)
        if k is not None:
            lo, span = float(k[0]), float(k[-1] - k[0]) or 1.0
            s = (x - lo) / span
            out += [F.pow(F.greatest(s - float((c - lo) / span), F.lit(0.0)), 3) for c in k[:-1]]
    return out


def fit_smooth(df: DataFrame, target: str, predictors: list[str], k: int = 10, local: int = 30, pool: int = 20_000, ridges: tuple[float, ...] = (1e-6, 1e-4, 1e-2, 1.0)) -> SmoothModel:
    """Penalised spline regression: knots at quantiles, ridge on the curved terms chosen by GCV, one Gram aggregate."""
    if not 4 <= k <= 50:
        raise ValueError("k must lie between 4 and 50")
    enc = Encoder(df, predictors)
    knots: list[np.ndarray | None] = []
    for p, kind, _ in enc.plan:
        if kind != "number":
            knots.append(None)
            continue
        q = df.agg(F.percentile_approx(as_number_column(df, p), [i / (k - 2) for i in range(k - 1)], 10_000)).first()[0]
        q = np.unique(np.asarray(q or [0.0], float))
        knots.append(q if len(q) >= 4 else None)
    basis = _basis(df, enc, knots)
    y = as_number_column(df, target)
    names = [f"b{i}" for i in range(len(basis))]
    x = df.select(F.lit(1.0).alias("one"), *[b.alias(n) for b, n in zip(basis, names)], y.alias("y")).filter("y is not null")
    cols = ["one", *names, "y"]
    row = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    G = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            G[i, j] = G[j, i] = row[f"s{i}_{j}"] or 0.0
    n, A, b = G[0, 0], G[:-1, :-1], G[:-1, -1]
    curved = [0.0]
    for kn in knots:
        curved += [0.0] + ([1.0] * (len(kn) - 1) if kn is not None else [])
    best = None
    for r in ridges:
        inv = np.linalg.pinv(A + r * n * np.diag(curved) + 1e-9 * n * np.eye(len(A)))
        beta = inv @ b
        rss, edf = max(G[-1, -1] - 2 * beta @ b + beta @ A @ beta, 0.0), float(np.trace(inv @ A))
        score = n * rss / max(n - edf, 1.0) ** 2
        if best is None or score < best[0]:
            best = (score, beta)
    model = SmoothModel(enc, knots, best[1], np.zeros(1), np.zeros(1), local)
    some = df.select(model.mean(df).alias("m"), y.alias("y")).filter("y is not null").withColumn("h", F.xxhash64("m", "y")).orderBy("h").limit(pool).toPandas().sort_values("m")
    model.means, model.residuals = some.m.to_numpy(float), (some.y - some.m).to_numpy(float)
    return model


def crps(draws: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Continuous ranked probability score of m draws a row: mean |X - y| - half mean |X - X'|."""
    X = np.sort(draws, axis=1)
    m = X.shape[1]
    return np.abs(X - y[:, None]).mean(axis=1) - (X * (2 * np.arange(1, m + 1) - m - 1)).sum(axis=1) / m**2


def select_engine(df: DataFrame, target: str, predictors: list[str], row_id: str, folds: int = 5, rule: str = "one_se", seed: int = 1, max_rows: int = 5000, score: str = "crps", gam: dict | None = None, cart: dict | None = None) -> tuple[str, dict[str, float]]:
    """Cross-validated score of the tree and the smooth model: ``crps`` of their draws or ``mse`` of their means, on at most
    ``max_rows`` rows.  ``one_se`` prefers the smooth model within one standard error; an engine that cannot be
    fitted in a fold is out, and if none can, the tree is named."""
    from tabweave.operators.metrics import capped

    if score not in ("crps", "mse") or rule not in ("one_se", "min"):
        raise ValueError("score must be crps or mse, and rule one_se or min")
    some = capped(df, max_rows, seed).withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(folds))).persist()
    scores: dict[str, list[float]] = {"smooth": [], "tree": []}
    try:
        for k in range(folds):
            train, test = some.filter(F.col("_fold") != k), some.filter(F.col("_fold") == k)
            seen = test.withColumn("_t", as_number_column(test, target)).filter("_t is not null")
            for name in list(scores):
                try:
                    if name == "tree":
                        x = fit_tree(train, target, predictors, **(cart or {})).distribution(seen, ["_t"]).toPandas()
                        mean, pools = x["_mean"].to_numpy(float), list(x["_pool"])
                    else:
                        model = fit_smooth(train, target, predictors, **(gam or {}))
                        x = seen.select("_t", model.mean(seen).alias("_mean")).toPandas()
                        mean = x["_mean"].to_numpy(float)
                        pools = list(model.local_pools(mean, "leaf"))
                    y = x["_t"].to_numpy(float)
                    loss = (y - mean) ** 2 if score == "mse" else np.array([crps(m + np.asarray(p, float)[None, :], v[None])[0] for m, p, v in zip(mean, pools, y)])
                    scores[name].append(float(loss.mean()))
                except ValueError:
                    del scores[name]
            if not scores:
                return "tree", {}
    finally:
        some.unpersist()
    means = {k: float(np.mean(v)) for k, v in scores.items()}
    least = min(means, key=means.get)
    if rule == "one_se" and "smooth" in means and means["smooth"] <= means[least] + np.std(scores[least], ddof=1) / np.sqrt(folds) + 1e-12:
        return "smooth", means
    return least, means


@dataclass
class Conditional:
    """One column drawn given the others: the engine's mean, a residual, and a calibration to the column's own margin."""

    target: str
    model: object
    engine: str
    residual: str = "leaf"
    reference: np.ndarray | None = None
    marginal: object = None
    scores: dict | None = None

    def draw(self, df: DataFrame, row_id: str, seed: int) -> DataFrame:
        """(row_id, draw)."""
        if self.engine == "nominal":
            return self.model.draw(df, row_id, seed)
        raw = self.model.draw(df, row_id, seed, self.residual)
        if self.reference is None:
            return raw
        reference, marginal = self.reference, self.marginal

        @F.pandas_udf("double")
        def calibrated(x: pd.Series) -> pd.Series:
            return pd.Series(marginal.quantile(calibrated_u(x.to_numpy(float), reference)))

        return raw.select(row_id, calibrated("draw").alias("draw"))


def calibrated_u(raw: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Middle of the empirical distribution function of the sorted ``reference`` at each value, inside (0, 1)."""
    n = len(reference)
    u = (np.searchsorted(reference, raw, "left") + np.searchsorted(reference, raw, "right")) / (2 * n)
    return np.clip(u, 0.5 / n, 1 - 0.5 / n)


def fit_conditional(df: DataFrame, target: str, predictors: list[str], marginal, engine: str = "cart", residual: str = "leaf", calibration: str = "quantile", cart: dict | None = None, gam: dict | None = None, cv: dict | None = None, seed: int = 20260101) -> Conditional:
    """A conditional model of a number; ``engine`` is cart, gam or auto, which takes the better of both by cross-validation
    and the other one where that cannot be fitted."""
    if engine not in ("cart", "gam", "auto") or residual not in RESIDUALS or calibration not in CALIBRATIONS:
        raise ValueError(f"engine must be cart, gam or auto, residual one of {', '.join(RESIDUALS)}, calibration one of {', '.join(CALIBRATIONS)}")
    rows, scores = df.withColumn("_row", F.monotonically_increasing_id()), None
    if engine == "auto":
        name, scores = select_engine(rows, target, predictors, "_row", gam=gam, cart=cart, **(cv or {}))
        order = ["gam", "cart"] if name == "smooth" else ["cart", "gam"]
    else:
        order = [engine]
    for k, name in enumerate(order):
        try:
            model = fit_tree(df, target, predictors, **(cart or {})) if name == "cart" else fit_smooth(df, target, predictors, **(gam or {}))
            break
        except ValueError:
            if k == len(order) - 1:
                raise
    out = Conditional(target, model, name, residual, None, marginal, scores)
    if calibration == "quantile":
        from tabweave.operators.metrics import capped

        drawn = out.draw(capped(rows, REFERENCE, seed), "_row", seed).select("draw").toPandas()  # at most REFERENCE rows
        out.reference = np.sort(drawn["draw"].to_numpy(float))
    return out


@dataclass
class NominalModel:
    encoder: Encoder
    model: object
    labels: list[str]

    def draw(self, df: DataFrame, row_id: str, seed: int) -> DataFrame:
        """(row_id, draw): label by inverse distribution function of the row's probabilities."""
        p = self.model.transform(self.encoder.assembled(df, [row_id])).select(row_id, vector_to_array("probability").alias("p"))
        u = uniform_hash(seed, "nominal", F.col(row_id))
        cum = F.transform("p", lambda x, i: F.aggregate(F.slice("p", 1, i + 1), F.lit(0.0), lambda s, v: s + v))
        cell = F.least(F.size(F.filter(cum, lambda c: c < u)) + 1, F.lit(len(self.labels)))
        return p.select(row_id, F.element_at(F.array(*[F.lit(v) for v in self.labels]), cell).alias("draw"))


def fit_nominal(df: DataFrame, target: str, predictors: list[str], decay: float = 1e-4, maxit: int = 100) -> NominalModel:
    """Multinomial logit of 2 to 20 classes on at least 40 observed rows."""
    enc = Encoder(df, predictors)
    seen = df.filter(F.col(target).isNotNull())
    counts = seen.groupBy(F.col(target).cast("string").alias("v")).count().limit(21).collect()
    labels, n = sorted(r["v"] for r in counts), sum(r["count"] for r in counts)
    if not 2 <= len(labels) <= 20 or n < 40:
        raise ValueError("a nominal target needs 2 to 20 classes and 40 observed rows")
    data = enc.assembled(seen.withColumn("_y", F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(target).cast("string")).cast("double") - 1), ["_y"])
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=decay / n, maxIter=maxit).fit(data)
    return NominalModel(enc, model, labels)
