"""Fit a copula model of a table and generate new rows from it.

Fitting makes a fixed number of aggregations over the table: profiles, frequency
tables, knots, and one pass that turns rows into normal scores and adds up their
cross products and contingency tables inside each task.  Strata share these passes.
Only moments and one correlation a pair reach the driver.  Generation is one narrow stage: row numbers become uniforms by a
counter-based generator, so partitions never change a value.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions import latent, linalg
from tabweave.functions.rng import check_seed, uniform_block, uniform_hash
from tabweave.functions.special import gamma_ppf, norm_cdf, norm_ppf, t_cdf, t_ppf
from tabweave.operators.marginals import CATEGORICAL, Marginal, fit_marginals, numeric_column, value_class

DF_GRID = (2, 3, 4, 5, 6, 8, 10, 15, 20, 30, 50, 100)
BINS = 500
CLIP = 1e-10


@dataclass(frozen=True)
class Perturbation:
    """How far draws move from the fitted model; scalars apply to all columns, dicts to the named ones."""

    noise: float | dict = 0.0
    swap: float | dict = 0.0
    shift: float | dict = 0.0
    scale: float | dict = 1.0
    temperature: float | dict = 1.0
    dependence: float = 1.0
    bounds: str = "sign"

    def __post_init__(self):
        for name, low, high in (("noise", 0, math.inf), ("swap", 0, 1), ("shift", -math.inf, math.inf), ("scale", 0, math.inf), ("temperature", 1e-12, math.inf)):
            for v in (getattr(self, name).values() if isinstance(getattr(self, name), dict) else [getattr(self, name)]):
                if not (isinstance(v, (int, float)) and math.isfinite(v) and low <= v <= high):
                    raise ValueError(f"{name} is out of range")
        if not 0 <= self.dependence <= 2:
            raise ValueError("dependence must lie between 0 and 2")
        if self.bounds not in ("sign", "range", "none"):
            raise ValueError("bounds must be sign, range or none")

    def of(self, name: str, column: str) -> float:
        v = getattr(self, name)
        return float(v.get(column, 1.0 if name in ("scale", "temperature") else 0.0)) if isinstance(v, dict) else float(v)

    @staticmethod
    def closeness(c: float) -> Perturbation:
        """1 draws from the fitted model; towards 0 noise, swaps, flattening and independence grow."""
        if not 0 <= c <= 1:
            raise ValueError("closeness must lie in [0, 1]")
        d = 1.0 - c
        return Perturbation(noise=1.5 * d, swap=0.5 * d, temperature=1 + d, dependence=c)

    def combined(self, other: Perturbation, columns: list[str]) -> Perturbation:
        """Both at once: noise adds in quadrature, swaps as independent events, temperatures and dependence multiply."""
        def each(name, f):
            a, b = getattr(self, name), getattr(other, name)
            return f(a, b) if not (isinstance(a, dict) or isinstance(b, dict)) else {c: f(self.of(name, c), other.of(name, c)) for c in columns}

        return Perturbation(each("noise", math.hypot), each("swap", lambda a, b: 1 - (1 - a) * (1 - b)), other.shift, other.scale, each("temperature", lambda a, b: a * b), min(2.0, self.dependence * other.dependence), other.bounds)


@dataclass
class Copula:
    names: list[str]
    R: np.ndarray
    n_pair: np.ndarray
    family: str = "gaussian"
    df: float = math.inf
    completion: str = "none"
    unidentified: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Stratum:
    key: tuple
    n: int
    marginals: dict[str, Marginal]
    copula: Copula
    pooled: bool = False
    conditional: object = None


@dataclass
class Synthesizer:
    schema: T.StructType
    columns: list[str]
    by: list[str]
    ids: list[str]
    pooled: Stratum
    strata: list[Stratum]
    missing: str
    n_train: int

    def stratum(self, key: tuple | None = None) -> Stratum:
        if key is None:
            return self.pooled
        found = next((x for x in self.strata if x.key == tuple(key)), None)
        if found is None:
            raise ValueError(f"unknown stratum {key!r}; there are {', '.join(stratum_labels(self))}")
        return found

    def n_pair(self, stratum: tuple | None = None) -> pd.DataFrame:
        """Rows in which both columns of a pair are observed."""
        c = self.stratum(stratum).copula
        return pd.DataFrame(c.n_pair.astype(int), c.names, c.names)

    def correlation(self, stratum: tuple | None = None, include_missing: bool = False) -> pd.DataFrame:
        s = self.stratum(stratum)
        keep = [i for i, n in enumerate(s.copula.names) if include_missing or not n.startswith(".missing_")]
        names = [s.copula.names[i] for i in keep]
        return pd.DataFrame(s.copula.R[np.ix_(keep, keep)], names, names)

    def summary(self) -> pd.DataFrame:
        rows = []
        for c in self.columns:
            m = self.pooled.marginals[c]
            rows.append((c, m.value_class, m.type, len(m.values), m.na_rate))
        return pd.DataFrame(rows, columns=["variable", "class", "model", "support", "missing"])


def order_categories(df: DataFrame, strata: dict[str, dict[str, Marginal]], by: str | None = None) -> None:
    """Order unordered labels along the main direction of their mean scores on the ordered columns, in every stratum.

    One aggregation gives all means of all label columns; ties fall back to probability and label."""
    every = [m for margins in strata.values() for m in margins.values()]
    refs = {m.name: m for m in every if m.type in ("continuous", "discrete") or m.type == "categorical" and m.value_class in ("ordered", "boolean")}
    todo = sorted({m.name for m in every if m.type == "categorical" and m.value_class in ("string", "factor") and len(m.values) > 1})
    if not refs or not todo:
        return
    names = list(refs)
    score = [(numeric_column(df, c) if r.value_class not in CATEGORICAL else F.array_position(F.array(*[F.lit(v) for v in r.values]), F.col(c).cast("string")).cast("double")).alias(f"_r{i}") for i, (c, r) in enumerate(refs.items())]
    scored = df.select((F.col(by) if by else F.lit("")).alias("_s"), *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(todo)], *score)
    aggs = [F.avg(f"_r{i}").alias(f"m{i}") for i in range(len(names))]
    whole = {r["_s"]: r for r in scored.groupBy("_s").agg(*aggs, *[F.stddev_samp(f"_r{i}").alias(f"s{i}") for i in range(len(names))]).collect()}  # a row a stratum
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_c{i}").alias("text")) for i, c in enumerate(todo)])).alias("p")
    long = scored.select("_s", pairs, *[f"_r{i}" for i in range(len(names))]).select("_s", "p.*", *[f"_r{i}" for i in range(len(names))])
    means = {(r["_s"], r["variable"], r["text"]): r for r in long.filter("text is not null").groupBy("_s", "variable", "text").agg(*aggs).collect()}  # a row a label
    for key, margins in strata.items():
        for m in margins.values():
            if m.name not in todo or m.type != "categorical" or len(m.values) < 2:
                continue
            at = [i for i, c in enumerate(names) if c != m.name and margins[c].type != "empty"]
            number = lambda row, c: np.nan if row is None or row[c] is None else float(row[c])
            M = np.array([[number(means.get((key, m.name, v)), f"m{i}") for i in at] for v in m.values], float).reshape(len(m.values), -1)
            middle, sd = (np.array([number(whole[key], f"{k}{i}") for i in at], float) for k in "ms")
            M = (M - middle) / np.where(sd > 0, sd, np.nan)
            M = M[:, ~np.isnan(M).any(axis=0)]
            if not M.shape[1]:
                continue
            M = M - m.probs @ M / m.probs.sum()
            v = np.linalg.svd(np.sqrt(m.probs)[:, None] * M, full_matrices=False)[2][0]
            lead = v[np.flatnonzero(np.abs(v) > 1e-12)[:1]]
            place = M @ v * (np.sign(lead[0]) if len(lead) else 1.0)
            order = sorted(range(len(m.values)), key=lambda i: (round(place[i], 10), -m.probs[i], m.values[i]))
            m.values, m.probs = [m.values[i] for i in order], m.probs[order]


def _scores(m: Marginal, x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-observations in (0, 1) (cell middles for tables) and cell numbers of tables."""
    u, cell = np.full(len(x), np.nan), np.full(len(x), -1)
    if m.type == "continuous":
        k = m.knots
        mid = (np.searchsorted(k, x[seen], "left") + np.searchsorted(k, x[seen], "right")) / 2
        lo = np.clip(np.searchsorted(k, x[seen], "right") - 1, 0, max(len(k) - 2, 0))
        gap = (k[np.minimum(lo + 1, len(k) - 1)] - k[lo])
        with np.errstate(invalid="ignore", divide="ignore"):
            inside = np.where(gap > 0, (x[seen] - k[lo]) / gap, 0.0)
        exact = np.searchsorted(k, x[seen], "right") - np.searchsorted(k, x[seen], "left") > 1
        place = np.where(exact, mid, lo + np.clip(inside, 0, 1) + 0.5)
        u[seen] = np.clip(place / len(k), 0.5 / len(k), 1 - 0.5 / len(k))
    elif m.type != "empty":
        edges = m.cell_bounds()
        cell[seen] = np.clip(np.searchsorted(m.knots, x[seen]) if m.type == "discrete" else x[seen].astype(int), 0, len(m.probs) - 1)
        u[seen] = np.clip((edges[cell[seen]] + edges[cell[seen] + 1]) / 2, CLIP, 1 - CLIP)
    return u, cell


class _Layout:
    """The latent columns of a stratum: its margins that are not empty, then indicators of gaps."""

    def __init__(self, margins: dict[str, Marginal], missing: str):
        self.cols = [m for m in margins.values() if m.type != "empty"]
        self.flags = [m for m in self.cols if missing == "joint" and 0 < m.na_rate < 1]
        self.names = [m.name for m in self.cols] + [f".missing_{m.name}" for m in self.flags]
        self.smooth = np.array([m.type == "continuous" for m in self.cols] + [False] * len(self.flags), bool)
        self.probs = [m.probs for m in self.cols] + [np.array([1 - m.na_rate, m.na_rate]) for m in self.flags]
        self.where = {m.name: i for i, m in enumerate(self.cols)}
        self.codes = [{v: k for k, v in enumerate(m.values)} if m.value_class in CATEGORICAL else None for m in self.cols]

    def numbers(self, i: int, column: pa.Array) -> np.ndarray:
        """A column's values as numbers (of labels their place in the margin), NaN for gaps."""
        if self.codes[i] is None:
            return column.to_numpy(zero_copy_only=False).astype(float)
        return np.array([np.nan if v is None else self.codes[i].get(v, np.nan) for v in column.to_pylist()], float)


def _pulled(df: DataFrame, columns: list[str], by: str | None) -> DataFrame:
    """Stratum, and the columns as numbers or text."""
    plain = [numeric_column(df, c) if value_class(df.schema[c]) not in CATEGORICAL else F.col(c).cast("string") for c in columns]
    return df.select((F.col(by) if by else F.lit("")).alias("_s"), *[x.alias(f"c{i}") for i, x in enumerate(plain)])


def fit_copulas(df: DataFrame, strata: dict[str, dict[str, Marginal]], family: str = "gaussian", missing: str = "joint", pd_method: str = "auto", min_pair: int = 3, by: str | None = None) -> dict[str, Copula]:
    """Latent correlations of all strata from one pass over ``df``.

    Pairs of continuous margins: pairwise covariance of normal scores over the deviations of all observed scores
    (gaussian), or Kendall's tau of a bounded sample with the same correction for the restricted range (t).
    Pairs with a table: polyserial over bins of the score, or polychoric, by maximum likelihood,
    each pair in a task of its own.  Then own indicators and degenerate margins are zero, unidentified pairs
    are completed, and the matrix is repaired to be positive definite."""
    columns = list(next(iter(strata.values())))
    layouts = {key: _Layout(margins, missing) for key, margins in strata.items()}
    if family == "independence":
        return {k: Copula(x.names, np.eye(len(x.names)), np.zeros((len(x.names),) * 2), family) for k, x in layouts.items()}
    place = {c: i + 1 for i, c in enumerate(columns)}
    schema = pa.schema([("s", pa.string()), ("kind", pa.string()), *[(k, pa.int32()) for k in "ijab"], ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments: dict[tuple[str, str], np.ndarray] = {}
        for b in batches:
            strata_of = np.array(b[0].to_pylist(), object)
            for key in sorted(set(strata_of) & set(layouts)):
                x, rows = layouts[key], pa.array(np.flatnonzero(strata_of == key))
                n, nc, d = len(rows), len(x.cols), len(x.names)
                Z, C, seen = np.zeros((n, d)), np.full((n, d), -1), np.zeros((n, d), bool)
                for i, m in enumerate(x.cols):
                    v = x.numbers(i, b[place[m.name]].take(rows))
                    seen[:, i] = ~np.isnan(v)
                    u, C[:, i] = _scores(m, v, seen[:, i])
                    Z[:, i] = np.where(seen[:, i], norm_ppf(np.where(seen[:, i], u, 0.5)), 0.0)
                for k, m in enumerate(x.flags):
                    C[:, nc + k], seen[:, nc + k] = (~seen[:, x.where[m.name]]).astype(int), True
                S = seen.astype(float)
                for kind, A in (("n", S.T @ S), ("z", Z.T @ S), ("q", (Z * Z).T @ S), ("p", Z.T @ Z)):
                    moments[key, kind] = moments.get((key, kind), 0.0) + A
                bins = np.clip((norm_cdf(Z) * BINS).astype(int), 0, BINS - 1)
                part = [bins[:, i] if x.smooth[i] else C[:, i] for i in range(d)]
                for i in range(d):
                    for j in range(i + 1, d):
                        both = seen[:, i] & seen[:, j]
                        if x.smooth[i] and x.smooth[j] or not both.any():
                            continue
                        cell, count = np.unique(part[i][both].astype(np.int64) << 32 | part[j][both], return_counts=True)
                        k = len(cell)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * k), pa.array(["t"] * k), pa.array(np.full(k, i, np.int32)), pa.array(np.full(k, j, np.int32)), pa.array((cell >> 32).astype(np.int32)), pa.array((cell & 0xFFFFFFFF).astype(np.int32)), pa.array(count.astype(float))], schema=schema)
        for (key, kind), A in moments.items():
            i, j = (g.ravel().astype(np.int32) for g in np.indices(A.shape))
            zero = np.zeros(len(i), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(i)), pa.array([kind] * len(i)), pa.array(i), pa.array(j), pa.array(zero), pa.array(zero), pa.array(A.ravel())], schema=schema)

    def latent_pair(frame: pd.DataFrame) -> pd.DataFrame:
        key, i, j = frame.s.iloc[0], int(frame.i.iloc[0]), int(frame.j.iloc[0])
        if frame.kind.iloc[0] != "t":
            return frame[["s", "kind", "i", "j", "v"]]
        return pd.DataFrame({"s": [key], "kind": ["r"], "i": [i], "j": [j], "v": [_latent(layouts[key], i, j, frame)]})

    pulled = _pulled(df, columns, by)
    sums = pulled.mapInArrow(run, "s string, kind string, i int, j int, a int, b int, v double").groupBy("s", "kind", "i", "j", "a", "b").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("s", "kind", "i", "j").applyInPandas(latent_pair, "s string, kind string, i int, j int, v double").toPandas()  # five numbers a pair of columns
    sample = _sample(pulled, rows) if family == "t" else {}
    out = {}
    for key, x in layouts.items():
        d = len(x.names)
        if d < 2:
            out[key] = Copula(x.names, np.eye(d), np.zeros((d, d)), "independence")
            continue
        part = {k: np.zeros((d, d)) for k in "nzqp"} | {"r": np.full((d, d), np.nan)}
        for kind, g in rows[rows.s == key].groupby("kind"):
            part[kind][g.i, g.j] = g.v
        n, z, q, p, ml = (part[k] for k in "nzqpr")
        with np.errstate(invalid="ignore", divide="ignore"):
            own_n, own_m = np.diag(n), np.diag(z) / np.diag(n)
            sd = np.sqrt(np.maximum(np.diag(q) / own_n - own_m**2, 0))
            R = (p / n - (z / n) * (z.T / n)) / np.outer(sd, sd)
            if family == "t":
                within = np.sqrt(np.maximum(q / n - (z / n) ** 2, 0)) / sd[:, None]  # deviation on joint rows over that on own rows
                R = _kendall(pulled, key, x, sample.get(key), n, place) * np.nan_to_num(within * within.T, nan=1.0, posinf=1.0)
        ml = np.where(np.isnan(ml), ml.T, ml)
        table = ~(x.smooth[:, None] & x.smooth[None, :])
        R = np.where(table, ml, R)
        dull = np.array([not x.smooth[k] and (x.probs[k] > 0).sum() < 2 for k in range(d)])
        own = np.array([[b == f".missing_{a}" or a == f".missing_{b}" for b in x.names] for a in x.names])
        fixed = own | dull[:, None] | dull[None, :]
        unknown = ((n < min_pair) | ~np.isfinite(R)) & ~fixed
        np.fill_diagonal(unknown, False)
        R = np.clip(np.where(fixed | unknown, 0.0, np.nan_to_num(R)), -1, 1)
        np.fill_diagonal(R, 1.0)
        R, how = linalg.complete_correlation((R + R.T) / 2, unknown)
        R = linalg.make_pd(R, pd_method)
        lost = [(x.names[i], x.names[j]) for i in range(d) for j in range(i + 1, d) if unknown[i, j]]
        out[key] = Copula(x.names, R, n, family, math.inf, how, lost)
        if family == "t":
            nc = len(x.cols)
            out[key].df = _t_df(x, sample.get(key), R[:nc, :nc])
    return out


def _latent(x: _Layout, i: int, j: int, cells: pd.DataFrame) -> float:
    """Correlation behind the counted cells (columns a, b, v) of a pair with at least one table."""
    if x.smooth[i] or x.smooth[j]:
        score, label, k = (cells.a, cells.b, j) if x.smooth[i] else (cells.b, cells.a, i)
        bins, inv = np.unique(score, return_inverse=True)
        counts = np.zeros((len(bins), len(x.probs[k])))
        np.add.at(counts, (inv, label.to_numpy()), cells.v.to_numpy())
        return float(latent.polyserial(norm_ppf((bins + 0.5) / BINS), counts, latent.thresholds(x.probs[k])))
    counts = np.zeros((len(x.probs[i]), len(x.probs[j])))
    np.add.at(counts, (cells.a.to_numpy(), cells.b.to_numpy()), cells.v.to_numpy())
    return float(latent.polychoric(counts, latent.thresholds(x.probs[i]), latent.thresholds(x.probs[j])))


#: Rows of a stratum that Kendall's tau and the degrees of freedom are computed from, and joint rows that a pair should have.
TAU_ROWS, DF_ROWS, TAU_LEAST = 2000, 5000, 500


def _sample(pulled: DataFrame, rows: pd.DataFrame) -> dict[str, pd.DataFrame]:
    """About DF_ROWS rows of each stratum, chosen one by one by the hash of a row number."""
    n = {s: g.v.max() for s, g in rows[rows.kind == "n"].groupby("s")}
    small = pulled.sparkSession.createDataFrame([(s, float(min(1.0, 1.1 * DF_ROWS / max(v, 1.0)))) for s, v in n.items()], "_s string, _share double")
    drawn = pulled.withColumn("_u", uniform_hash(1, "sample", F.monotonically_increasing_id())).join(F.broadcast(small), "_s").filter("_u < _share")
    return {s: g for s, g in drawn.drop("_u", "_share").toPandas().groupby("_s")}


def _uniforms(x: _Layout, frame: pd.DataFrame, place: dict[str, int] | None = None) -> np.ndarray:
    """Pseudo-observations of sampled rows; of tables by the distributional transform, with a random place in the cell."""
    rng, out = np.random.default_rng(5), []
    for i, m in enumerate(x.cols):
        v = x.numbers(i, pa.Array.from_pandas(frame[f"c{place[m.name] - 1}"]))
        u, cell = _scores(m, v, ~np.isnan(v))
        if m.type != "continuous":
            edges = m.cell_bounds()
            u = np.where(cell >= 0, np.clip(edges[cell] + rng.random(len(v)) * (edges[cell + 1] - edges[cell]), CLIP, 1 - CLIP), np.nan)
        out.append(u)
    return np.column_stack(out) if out else np.zeros((len(frame), 0))


def _kendall(pulled: DataFrame, key: str, x: _Layout, frame: pd.DataFrame | None, n: np.ndarray, place: dict[str, int]) -> np.ndarray:
    """sin(pi / 2 tau) of the margins; a pair that the common sample leaves with few joint rows gets a sample of its own."""
    d, nc = len(x.names), len(x.cols)
    R = np.full((d, d), np.nan)
    if frame is None:
        return R
    x.sampled = _uniforms(x, frame, place)
    U = x.sampled[:TAU_ROWS]
    tau, seen = latent.kendall_correlations(U), np.isfinite(U).astype(float)
    joint = seen.T @ seen
    for i in range(nc):
        for j in range(i + 1, nc):
            if x.smooth[i] and x.smooth[j] and joint[i, j] < min(n[i, j], TAU_LEAST):
                a, b = (f"c{place[x.cols[k].name] - 1}" for k in (i, j))
                own = pulled.filter((F.col("_s") == key) & F.col(a).isNotNull() & F.col(b).isNotNull()).limit(TAU_ROWS).toPandas()
                tau[i, j] = tau[j, i] = latent.kendall_correlations(_uniforms(x, own, place)[:, [i, j]])[0, 1]
    R[:nc, :nc] = np.sin(np.pi / 2 * tau)
    return R


def _t_df(x: _Layout, frame: pd.DataFrame | None, R: np.ndarray) -> float:
    """Degrees of freedom by profile likelihood on the complete rows of the sample; 10 with a warning if there are under ten."""
    U = x.sampled[np.isfinite(x.sampled).all(axis=1)][:DF_ROWS] if frame is not None else np.zeros((0, 0))
    if len(U) < 10:
        warnings.warn("too few complete rows to estimate the degrees of freedom; 10 is used", stacklevel=3)
        return 10.0
    U = np.clip(U, CLIP, 1 - CLIP)
    L, d = np.linalg.cholesky(R), len(x.cols)
    best = (-math.inf, 10.0)
    for v in DF_GRID:
        X = t_ppf(U, v)
        q = (np.linalg.solve(L, X.T) ** 2).sum(axis=0)
        ll = len(X) * (math.lgamma((v + d) / 2) + (d - 1) * math.lgamma(v / 2) - d * math.lgamma((v + 1) / 2) - np.log(np.diag(L)).sum()) - (v + d) / 2 * np.log1p(q / v).sum() + (v + 1) / 2 * np.log1p(X * X / v).sum()
        best = max(best, (float(ll), float(v)))
    return best[1]


def fit(df: DataFrame, copula: str = "gaussian", by: list[str] | None = None, ids: list[str] | None = None, min_stratum_size: int = 20, missing: str = "joint", interpolation: str = "linear", discrete_threshold: int = 20, knots: int | None = None, pd_method: str = "auto", max_strata: int = 1000, nonlinear_target: str | None = None, nominal_target: str | None = None, **conditional) -> Synthesizer:
    """Fit a table (or a vector or matrix, see ``as_table``).  Strata (``by``) smaller than ``min_stratum_size`` use the pooled model.

    ``nonlinear_target`` names one column of numbers that is drawn from a conditional model of the other columns
    instead of the copula; ``conditional`` holds its settings: engine (cart, gam, auto), residual (leaf, global,
    none), calibration (quantile, none), and dicts cart, gam and cv.  ``nominal_target`` does the same for one label
    column by a multinomial model (settings decay and maxit).  Strata fit their own conditional models; where one
    cannot be fitted, the copula draws the column, with a warning."""
    df = as_table(df)
    for value, allowed, name in ((copula, ("gaussian", "t", "independence"), "copula"), (missing, ("joint", "independent", "drop"), "missing"), (interpolation, ("linear", "spline"), "interpolation"), (pd_method, ("auto", "higham", "eigen", "none"), "pd_method")):
        if value not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    if knots is not None and knots < 2:
        raise ValueError("knots must be at least 2")
    by, ids = by or [], ids or []
    absent = [c for c in (*by, *ids) if c not in df.columns]
    if absent or set(by) & set(ids):
        raise ValueError(f"by and ids must be disjoint columns of the table; missing: {', '.join(absent) or 'none'}")
    columns = [c for c in df.columns if c not in by and c not in ids]
    if not columns:
        raise ValueError("no column is left to model")

    target = _conditional_target(df, columns, nonlinear_target, nominal_target, conditional)
    n = df.count()
    if n < 2:
        raise ValueError("at least two rows are needed")
    margins = {"": fit_marginals(df, columns, discrete_threshold, knots, interpolation)}
    order_categories(df, margins)
    pooled = Stratum((), n, margins[""], fit_copulas(df, margins, copula, missing, pd_method)[""])
    if pooled.copula.unidentified:
        warnings.warn("pairs never observed together were completed: " + ", ".join(f"{a}~{b}" for a, b in pooled.copula.unidentified), stacklevel=2)
    strata = []
    if by:
        name = "_stratum"
        while name in df.columns:
            name += "_"
        cut = df.withColumn(name, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
        counts = cut.groupBy(*by, name).count().orderBy(F.desc("count"), *by).limit(max_strata + 1).collect()
        if len(counts) > max_strata:
            raise ValueError(f"more than {max_strata} strata")
        large = [r for r in counts if r["count"] >= min_stratum_size]
        own, copulas = {}, {}
        if large:
            part = cut.join(F.broadcast(df.sparkSession.createDataFrame([(r[name],) for r in large], f"`{name}` string")), name, "left_semi")
            own = fit_marginals(part, columns, discrete_threshold, knots, interpolation, by=name)
            order_categories(part, own, name)
            copulas = fit_copulas(part, own, copula, missing, pd_method, by=name)
        for r in counts:
            key = tuple(r[c] for c in by)
            if r[name] in own:
                strata.append(Stratum(key, r["count"], own[r[name]], copulas[r[name]]))
            else:
                strata.append(replace(pooled, key=key, n=r["count"], pooled=True))
    if target:
        if nonlinear_target and pooled.marginals[target].type != "continuous":
            raise ValueError(f"{target} must have a continuous margin")
        pooled.conditional = _fit_conditional(df, target, columns, pooled, nominal_target is not None, conditional)
        lacking = []
        for i, s in enumerate(strata):
            if s.pooled:
                strata[i] = replace(s, conditional=pooled.conditional)
                continue
            try:
                s.conditional = _fit_conditional(df.filter(_of_stratum(by, s.key)), target, columns, s, nominal_target is not None, conditional)
            except ValueError:
                lacking.append(str(s.key))
        if lacking:
            warnings.warn(f"the copula draws {target} in strata without a conditional model: {', '.join(lacking)}", stacklevel=2)
    return Synthesizer(df.schema, columns, by, ids, pooled, strata, missing, n)


def as_table(data, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame as it is; a pandas frame or a matrix by columns (V1, V2, ...); a vector as column x."""
    if isinstance(data, DataFrame):
        return data
    spark = spark or SparkSession.getActiveSession()
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    x = np.asarray(data)
    if x.ndim not in (1, 2):
        raise TypeError("a table, matrix or vector is needed")
    names = ["x"] if x.ndim == 1 else [f"V{k + 1}" for k in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(x.reshape(len(x), -1), columns=names))


def _of_stratum(by: list[str], key: tuple):
    match = F.lit(True)
    for c, v in zip(by, key):
        match = match & F.col(c).eqNullSafe(F.lit(v))
    return match


def _conditional_target(df: DataFrame, columns: list[str], number: str | None, label: str | None, settings: dict) -> str | None:
    target = number or label
    if number and label:
        raise ValueError("nonlinear_target and nominal_target exclude each other")
    if not target:
        if settings:
            raise TypeError(f"unknown settings: {', '.join(settings)}")
        return None
    if target not in columns or len(columns) < 2:
        raise ValueError(f"{target} must be a modelled column beside others")
    kind = value_class(df.schema[target])
    if number and kind != "double" or label and kind not in ("string", "factor", "boolean"):
        raise ValueError(f"{target} must be {'a column of doubles' if number else 'an unordered label'}")
    unknown = set(settings) - ({"engine", "residual", "calibration", "cart", "gam", "cv"} if number else {"decay", "maxit"})
    if unknown:
        raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
    return target


def _fit_conditional(df: DataFrame, target: str, columns: list[str], s: Stratum, nominal: bool, settings: dict):
    from tabweave.operators.conditional import Conditional, fit_conditional, fit_nominal

    predictors = [c for c in columns if c != target and s.marginals[c].type != "empty"]
    if nominal:
        return Conditional(target, fit_nominal(df, target, predictors, **settings), "nominal")
    return fit_conditional(df, target, predictors, s.marginals[target], **settings)


def stratum_labels(model: Synthesizer) -> list[str]:
    """Names of the strata, as "column=value" joined by commas; the pooled model is "(pooled)"."""
    return [", ".join(f"{c}={'NA' if v is None else v}" for c, v in zip(model.by, s.key)) for s in model.strata] or ["(pooled)"]


def largest_remainder(n: int, shares: np.ndarray) -> np.ndarray:
    """Whole numbers that add up to n, in proportion; ties go to the earlier."""
    exact = n * np.asarray(shares, float) / np.sum(shares)
    out = np.floor(exact + 1e-9).astype(int)
    order = sorted(range(len(out)), key=lambda i: (-round(exact[i] - out[i], 12), i))
    for i in order[: n - int(out.sum())]:
        out[i] += 1
    return out


def perturbed(m: Marginal, u: np.ndarray, p: Perturbation, seed: int, rows: np.ndarray) -> np.ndarray:
    """Values at u: temperature, quantile, swap, then for numbers noise, scale, shift, bounds, rounding."""
    c = m.name
    noise, swap, shift, scale, temp = (p.of(k, c) for k in ("noise", "swap", "shift", "scale", "temperature"))
    v = m.quantile(u, temp)
    if swap:
        other = m.quantile(uniform_block(seed, f"swapped|{c}", rows), temp)
        v = np.where(uniform_block(seed, f"swap|{c}", rows) < swap, other, v)
    if m.type in ("categorical", "empty") or not (noise or shift or scale != 1):
        return v
    mean, sd, median = m.moments()
    if noise:
        v = mean + (v - mean + noise * sd * norm_ppf(uniform_block(seed, f"noise|{c}", rows))) / math.sqrt(1 + noise * noise)
    v = median + scale * (v - median) + shift * sd
    low, high = m.knots.min(), m.knots.max()
    if p.bounds == "range":
        v = np.clip(v, low, high)
    elif p.bounds == "sign":
        v = np.maximum(v, 0) if low >= 0 else np.minimum(v, 0) if high <= 0 else v
    return np.floor(v + uniform_block(seed, f"round|{c}", rows)) if m.integer_valued else v


def _block(model: Synthesizer, s: Stratum, rows: np.ndarray, seed: int, p: Perturbation) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values and missing marks of every column for row numbers of one stratum."""
    cop, d, n = s.copula, len(s.copula.names), len(rows)
    U = np.column_stack([uniform_block(seed, f"copula|{name}", rows) for name in cop.names]) if d else np.zeros((n, 0))
    if cop.family != "independence" and d > 1:
        lam = p.dependence
        R = cop.R if lam == 1 else (1 - lam) * np.eye(d) + lam * cop.R
        if lam > 1:
            R = linalg.make_pd(np.clip(R, -0.999, 0.999) + np.diag(1 - np.clip(np.diag(R), -0.999, 0.999)), "higham", 1e-4)
        Z = norm_ppf(U) @ np.linalg.cholesky(R).T
        if cop.family == "t" and math.isfinite(cop.df):
            chi = 2 * gamma_ppf(uniform_block(seed, "chi", rows), cop.df / 2)
            U = t_cdf(Z / np.sqrt(chi / cop.df)[:, None], cop.df)
        else:
            U = norm_cdf(Z)
    at = {name: i for i, name in enumerate(cop.names)}
    out = {}
    for c in model.columns:
        m = s.marginals[c]
        if m.type == "empty":
            out[c] = (np.zeros(n), np.ones(n, bool))
            continue
        v = perturbed(m, U[:, at[c]], p, seed, rows)
        gone = np.zeros(n, bool)
        if model.missing == "joint" and f".missing_{c}" in at:
            gone = U[:, at[f".missing_{c}"]] > 1 - m.na_rate
        elif model.missing == "independent" and m.na_rate > 0:
            gone = uniform_block(seed, f"missing|{c}", rows) < m.na_rate
        out[c] = (v, gone)
    return out


def generate(model: Synthesizer, spark: SparkSession, n: int | None = None, seed: int = 1, closeness: float = 1.0, perturb: Perturbation | None = None, stratum_sizes: str = "multinomial", partitions: int | None = None) -> DataFrame:
    """``n`` new rows with the columns and types of the training table, as a lazy plan without a shuffle."""
    n = model.n_train if n is None else n
    if isinstance(n, bool) or n != int(n) or n < 0:
        raise ValueError("n must be a whole number, zero or more")
    check_seed(seed)
    if perturb is not None:
        for name in ("noise", "swap", "shift", "scale", "temperature"):
            v = getattr(perturb, name)
            bad = [c for c in v if c not in model.columns] if isinstance(v, dict) else []
            if bad:
                why = [f"{c} ({'stratum column' if c in model.by else 'identifier' if c in model.ids else 'unknown'})" for c in bad]
                raise ValueError(f"{name} names columns that are not modelled: {', '.join(why)}")
    conditional = any(s.conditional for s in (model.pooled, *model.strata))
    if conditional and (closeness != 1 or perturb is not None):
        raise ValueError("conditional models need closeness 1 and no perturbation")
    p = Perturbation.closeness(closeness)
    p = p.combined(perturb, model.columns) if perturb is not None else p
    parts = model.strata or [model.pooled]
    shares = np.array([s.n for s in parts], float)
    if stratum_sizes == "multinomial":
        sizes = np.random.default_rng(abs(seed)).multinomial(int(n), shares / shares.sum())
    elif stratum_sizes == "proportional":
        sizes = largest_remainder(int(n), shares)
    else:
        raise ValueError("stratum_sizes must be multinomial or proportional")
    ends = np.cumsum(sizes)
    names = [*model.by, *model.columns]
    raw = T.StructType([T.StructField("_id", T.LongType()), *[T.StructField(c, T.StringType() if c in model.by or model.pooled.marginals[c].type == "categorical" else T.DoubleType()) for c in names]])
    bare = replace(model, pooled=replace(model.pooled, conditional=None), strata=[])  # what tasks need
    parts = [replace(s, conditional=None) for s in parts]
    keys = [[None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in s.key] for s in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b["id"].to_numpy()
            which = np.searchsorted(ends, every, side="right")
            for k in np.unique(which):
                rows, s = every[which == k], parts[k]
                values = _block(bare, s, rows, seed, p)
                arrays = [pa.array(rows)]
                for i, c in enumerate(names):
                    if c in bare.by:
                        arrays.append(pa.array([keys[k][i]] * len(rows), pa.string()))
                        continue
                    v, gone = values[c]
                    m = s.marginals[c]
                    if bare.pooled.marginals[c].type == "categorical":
                        labels = np.array([*m.values, None] if m.values else [None], object)[v.astype(int) if m.values else np.zeros(len(rows), int)]
                        arrays.append(pa.array(labels, pa.string(), mask=gone))
                    else:
                        arrays.append(pa.array(v, pa.float64(), mask=gone | np.isnan(v)))
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", *names])

    ids = spark.range(0, int(n), 1, partitions) if partitions else spark.range(int(n))
    drawn = ids.mapInArrow(run, raw)
    width = len(str(max(int(n), 1)))
    out = []
    for f in model.schema:
        if f.name in model.ids:
            x = F.format_string(f"syn%0{width}d", F.col("_id") + 1) if isinstance(f.dataType, T.StringType) else (F.col("_id") + 1).cast(f.dataType if isinstance(f.dataType, T.NumericType) else "int")
        else:
            x = F.col(f.name)
            if isinstance(f.dataType, T.DateType) and f.name in model.columns:
                x = F.date_from_unix_date(F.rint(x).cast("int"))
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and f.name in model.columns:
                x = F.timestamp_micros(F.rint(x * 1e6).cast("long")).cast(f.dataType)
            elif isinstance(f.dataType, T.IntegralType) and f.name in model.columns:
                x = F.rint(x).cast(f.dataType)
            elif not isinstance(f.dataType, T.StringType):
                x = x.cast(f.dataType)
        out.append(x.alias(f.name, metadata=f.metadata or {}))
    return _conditionally(model, drawn.select("_id", *out), seed) if conditional else drawn.select(*out)


def _conditionally(model: Synthesizer, rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with ``_id``) where the conditional models have drawn their column; gaps stay where the copula put them."""
    target = next(s.conditional.target for s in (model.pooled, *model.strata) if s.conditional)
    field = model.schema[target]
    parts, rest = [], F.lit(True)
    shared = [s for s in model.strata if s.conditional is model.pooled.conditional] if model.strata else [model.pooled]
    for s in [*(x for x in model.strata if x.conditional and x.conditional is not model.pooled.conditional), *shared[:1]]:
        those = shared if s in shared else [s]
        match = F.lit(False) if model.strata else F.lit(True)
        for x in those if model.strata else []:
            match = match | _of_stratum(model.by, x.key)
        part, rest = rows.filter(match), rest & ~match
        drawn = s.conditional.draw(part, "_id", seed)
        parts.append(part.join(drawn, "_id").withColumn(target, F.when(F.col(target).isNotNull(), F.col("draw").cast(field.dataType)).alias(target, metadata=field.metadata or {})))
    if model.strata and any(s.conditional is None for s in model.strata):
        parts.append(rows.filter(rest).withColumn("draw", F.lit(None).cast("double")))
    out = parts[0].select(*model.schema.names)
    for x in parts[1:]:
        out = out.unionByName(x.select(*model.schema.names))
    return out


def synthesize(df: DataFrame, n: int | None = None, seed: int = 1, closeness: float = 1.0, perturb: Perturbation | None = None, file: str | None = None, format: str | None = None, **settings) -> DataFrame:
    """Fit and generate; with ``file`` the rows are written there, in the format of its extension or ``format``."""
    df = as_table(df)
    out = generate(fit(df, **settings), df.sparkSession, n, seed, closeness, perturb)
    if file:
        from tabweave.sources.writers import write_data

        write_data(out, file, format)
    return out


def simulate(model: Synthesizer, spark: SparkSession, draws: int = 1, seed: int = 1, **settings) -> DataFrame:
    """``draws`` independent tables below each other, numbered by ``sim``."""
    out = None
    for k in range(draws):
        one = generate(model, spark, seed=seed + k, **settings).withColumn("sim", F.lit(k + 1))
        out = one if out is None else out.unionByName(one)
    return out


def augment(df: DataFrame, n: int | None = None, keep_real: bool = True, label: str | None = None, seed: int = 1, **settings) -> DataFrame:
    """Real rows, then ``n`` synthetic ones (ten times the real rows unless given), told apart by ``label``."""
    size = df.count() if n is None else None
    new = synthesize(df, 10 * size if n is None else n, seed, **settings)
    if label:
        df, new = df.withColumn(label, F.lit(False)), new.withColumn(label, F.lit(True))
    return df.unionByName(new) if keep_real else new


@dataclass
class Calibration:
    closeness: float
    value: float
    target: float
    path: list[tuple[float, float]]
    attainable: bool


def calibrate(model: Synthesizer, real: DataFrame, target: float, metric, n: int | None = None, grid: tuple[float, ...] = tuple(i / 10 for i in range(11)), refine: int = 4, max_rows: int = 2000, seed: int = 1) -> Calibration:
    """Closeness whose ``metric(real, synthetic)`` is nearest to ``target``: a grid with common
    random numbers, bisection of the first sign change, one interpolation, best of the path."""
    grid = tuple(sorted(set(grid)))
    if len(grid) < 2 or grid[0] < 0 or grid[-1] > 1:
        raise ValueError("grid needs two or more values in [0, 1]")
    from tabweave.operators.metrics import capped

    spark = real.sparkSession
    sample = capped(real, max_rows, seed)
    path: list[tuple[float, float]] = []

    def at(c: float) -> float:
        value = float(metric(sample, generate(model, spark, n or max_rows, seed, c)))
        path.append((c, value))
        return value

    gaps = [(c, at(c) - target) for c in grid]
    pair = next((((a, fa), (b, fb)) for (a, fa), (b, fb) in zip(gaps, gaps[1:]) if fa * fb <= 0), None)
    if pair is None:
        warnings.warn("the target lies outside the attainable range", stacklevel=2)
    else:
        (a, fa), (b, fb) = pair
        for _ in range(refine):
            m = (a + b) / 2
            fm = at(m) - target
            (a, fa), (b, fb) = ((a, fa), (m, fm)) if fa * fm <= 0 else ((m, fm), (b, fb))
        if fa != fb:
            at(a - fa * (b - a) / (fb - fa))
    best = min(path, key=lambda x: abs(x[1] - target))
    return Calibration(best[0], best[1], target, path, pair is not None)
