"""Per-column empirical models: typing, frequency tables, knots, quantile functions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.operators.ranks import quantile_grid

UNSUPPORTED = (T.StructType, T.MapType, T.ArrayType, T.BinaryType)


def value_class(field_: T.StructField) -> str:
    """ordered, factor, timestamp, date, interval, boolean, string, integer or double."""
    kind, meta = field_.dataType, field_.metadata or {}
    if isinstance(kind, UNSUPPORTED) or kind.typeName() == "variant":
        raise TypeError(f"Unsupported column class: {field_.name} is {kind.simpleString()}")
    if "levels" in meta:
        return "ordered" if meta.get("ordered") else "factor"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "interval"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "integer" if isinstance(kind, T.IntegralType) else "double"


CATEGORICAL = frozenset(("ordered", "factor", "string", "boolean"))


@dataclass
class Marginal:
    """type: continuous (sorted knots), discrete or categorical (values with probabilities), empty."""

    name: str
    type: str
    value_class: str
    na_rate: float
    values: list = field(default_factory=list)
    probs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    integer_valued: bool = False
    interpolation: str = "linear"

    @property
    def knots(self) -> np.ndarray:
        return np.asarray(self.values, float)

    def moments(self) -> tuple[float, float, float]:
        """Mean, standard deviation and median of the stored model."""
        if self.type == "continuous":
            k = self.knots
            return float(k.mean()), float(k.std(ddof=1)) if len(k) > 1 else 0.0, float(np.median(k))
        v, p = self.knots, self.probs
        m = float(v @ p)
        return m, float(np.sqrt(max(0.0, (v - m) ** 2 @ p))), float(v[np.searchsorted(np.cumsum(p), 0.5 - 1e-12)])

    def quantile(self, u: np.ndarray, temperature: float = 1.0) -> np.ndarray:
        """Values at u: linear (type 7) or monotone cubic between knots; left-open cells of tables (as indices for labels)."""
        u = np.asarray(u, float)
        if self.type == "empty":
            return np.full(u.shape, np.nan)
        if self.type == "continuous":
            k = self.knots
            if len(k) == 1:
                out = np.full(u.shape, k[0])
            elif self.interpolation == "spline":
                out = monotone_cubic(np.arange(len(k), dtype=float), k, u * (len(k) - 1))
            else:
                out = np.interp(u * (len(k) - 1), np.arange(len(k)), k)
            out = np.clip(out, k[0], k[-1])
            return np.rint(out) if self.integer_valued else out
        p = self.probs ** (1.0 / temperature)
        cell = np.minimum(np.searchsorted(np.cumsum(p / p.sum()), u, side="left"), len(p) - 1)
        return cell.astype(float) if self.type == "categorical" else self.knots[cell]

    def cell_bounds(self) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(self.probs)])


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic Hermite interpolation with slopes limited so that monotone data stay monotone."""
    d = np.diff(y) / np.diff(x)
    m = np.concatenate([[d[0]], np.where(d[:-1] * d[1:] > 0, 2 * d[:-1] * d[1:] / np.where(d[:-1] + d[1:] == 0, 1, d[:-1] + d[1:]), 0.0), [d[-1]]])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (at - x[i]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h * m[i + 1]


def numeric_column(df: DataFrame, c: str):
    """A numeric-like column as double: days, seconds, NaN as NULL."""
    cls, kind = value_class(df.schema[c]), df.schema[c].dataType
    if cls == "timestamp":
        return F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    if cls == "date":
        return F.unix_date(c).cast("double")
    if cls == "interval":
        return F.col(c).cast("bigint").cast("double")
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x


def profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., variable, n, n_observed, n_distinct (approximate), all_integer, low, high), in one scan."""
    by = by or []
    rows = []
    for c in columns:
        number = value_class(df.schema[c]) not in CATEGORICAL
        x = numeric_column(df, c) if number else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("variable"), (x.cast("string") if number else F.col(c).cast("string")).alias("text"), x.alias("x")))
    long = df.select(*by, F.explode(F.array(*rows)).alias("p")).select(*by, "p.*")
    return long.groupBy(*by, "variable").agg(F.count("*").alias("n"), F.count("text").alias("n_observed"), F.approx_count_distinct("text").alias("n_distinct"), F.coalesce(F.bool_and(F.col("x") == F.rint("x")), F.lit(True)).alias("all_integer"), F.min("x").alias("low"), F.max("x").alias("high"))


def frequencies(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., variable, text, n): counts of the observed values of several columns, in one aggregation."""
    by = by or []
    rows = [F.struct(F.lit(c).alias("variable"), (numeric_column(df, c) if value_class(df.schema[c]) not in CATEGORICAL else F.col(c)).cast("string").alias("text")) for c in columns]
    return df.select(*by, F.explode(F.array(*rows)).alias("p")).select(*by, "p.*").filter("text is not null").groupBy(*by, "variable", "text").agg(F.count("*").alias("n"))


def fit_marginals(df: DataFrame, columns: list[str], discrete_threshold: int = 20, knots: int | None = None, interpolation: str = "linear", max_levels: int = 10_000, by: str | None = None) -> dict:
    """Marginals of all columns: four aggregations over the table, whatever the number of columns and strata.

    Columns of numbers are discrete if they hold at most ``discrete_threshold`` values and are
    whole or repeat (at most half as many values as rows).  Others keep all values if these are no more than
    ``knots`` (1000 unless given), else type-8 quantiles.  Categories beyond ``max_levels`` raise, because a
    model of them would not be a summary.  ``by`` names a text column of strata: then a dict by stratum."""
    key = [by] if by else []
    classes = {c: value_class(df.schema[c]) for c in columns}
    stats = {(r[by] if by else "", r["variable"]): r for r in profile(df, columns, key).collect()}  # a row a stratum and column
    labels = {c for c in columns if classes[c] in CATEGORICAL}
    few = [at for at, s in stats.items() if at[1] in labels or s["n_distinct"] <= 2 * discrete_threshold + 10]
    for at in few:
        if at[1] in labels and stats[at]["n_distinct"] > max_levels * 1.2:
            raise ValueError(f"{at[1]} has about {stats[at]['n_distinct']} categories; at most {max_levels} are supported (is it an identifier?)")
    tables: dict[tuple, dict[str, int]] = {at: {} for at in few}
    if few:
        counts = _only(frequencies(df, sorted({c for _, c in few}), key), few, by)
        for r in counts.collect():  # bounded by max_levels a stratum and column
            tables[r[by] if by else "", r["variable"]][r["text"]] = r["n"]
    out: dict[tuple, Marginal] = {}
    smooth = []
    for at, s in stats.items():
        c, cls = at[1], classes[at[1]]
        seen, na = s["n_observed"], 1 - s["n_observed"] / s["n"] if s["n"] else 1.0
        if not seen:
            out[at] = Marginal(c, "empty", cls, 1.0)
        elif cls in CATEGORICAL:
            meta = df.schema[c].metadata or {}
            levels = meta.get("levels") if cls == "ordered" else ["false", "true"] if cls == "boolean" else [v for v in meta["levels"] if v in tables[at]] if cls == "factor" else sorted(tables[at], key=lambda v: v.encode())
            out[at] = Marginal(c, "categorical", cls, na, list(levels), np.array([tables[at].get(v, 0) for v in levels], float) / seen)
        elif at in tables and len(tables[at]) <= discrete_threshold and (s["all_integer"] or len(tables[at]) <= seen / 2):
            items = sorted((float(v), n) for v, n in tables[at].items())
            out[at] = Marginal(c, "discrete", cls, na, [v for v, _ in items], np.array([n for _, n in items], float) / seen, s["all_integer"])
        else:
            smooth.append(at)
    if smooth:
        k = knots or 1000
        wanted = sorted({c for _, c in smooth})
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), numeric_column(df, c).alias("x")) for c in wanted])).alias("p")
        long = df.select(*key, pairs).select(*key, "p.*").filter("x is not null")
        whole, cut = ([at for at in smooth if (stats[at]["n_observed"] <= k) == small] for small in (True, False))
        held: dict[tuple, list] = {at: [] for at in smooth}
        if whole:
            for r in _only(long, whole, by).groupBy(*key, "variable", "x").count().collect():  # at most ``k`` values each
                held[r[by] if by else "", r["variable"]] += [r["x"]] * r["count"]
        if cut:
            named = _only(long, cut, by).select(F.concat(F.col(by) if by else F.lit(""), F.lit("\x00"), "variable").alias("at"), "x")
            for r in quantile_grid(named, "at", "x", k, 8).collect():  # ``k`` rows each
                held[tuple(r["at"].rsplit("\x00", 1))].append(r["q"])
        for at in smooth:
            s = stats[at]
            out[at] = Marginal(at[1], "continuous", classes[at[1]], 1 - s["n_observed"] / s["n"], sorted(held[at]), integer_valued=bool(s["all_integer"]), interpolation=interpolation)
    strata = sorted({s for s, _ in stats})
    found = {s: {c: out[s, c] for c in columns if (s, c) in out} for s in strata}
    return found if by else {c: out.get(("", c)) or Marginal(c, "empty", classes[c], 1.0) for c in columns}


def _only(rows: DataFrame, wanted: list[tuple], by: str | None) -> DataFrame:
    """Rows of the wanted (stratum, variable) pairs, a small table."""
    if not by:
        return rows.filter(F.col("variable").isin([c for _, c in wanted]))
    small = rows.sparkSession.createDataFrame(wanted, f"`{by}` string, variable string")
    return rows.join(F.broadcast(small), [by, "variable"], "left_semi")
