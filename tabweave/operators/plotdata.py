"""Tables behind plots; drawing is left to the caller."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.metrics import as_number, as_number_column, association_matrix, capped, common_columns, is_numeric
from tabweave.operators.ranks import quantile_grid, running_totals, unpivoted


def lumped_levels(df: DataFrame, column: str, keep: int = 19, limit: int = 20) -> DataFrame:
    """(level, n): beyond ``limit`` labels the ``keep`` most frequent and "(other)"; missing is "(missing)"."""
    counts = df.select(F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "level").limit(limit + 1)  # small whatever the table
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "level")))
    many = F.max("r").over(Window.partitionBy(F.lit(0))) > limit
    kept = ranked.withColumn("many", many).filter(~F.col("many") | (F.col("r") <= keep)).select("level", F.lit(True).alias("kept"))
    return counts.join(F.broadcast(kept), "level", "left").groupBy(F.when(F.col("kept"), F.col("level")).otherwise("(other)").alias("level")).agg(F.sum("n").alias("n"))


def category_shares(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, source, level, share)."""
    both = unpivoted(real, columns, value="level", kind="string").withColumn("source", F.lit("real")).unionByName(unpivoted(synthetic, columns, value="level", kind="string").withColumn("source", F.lit("synthetic")))
    counts = both.groupBy("variable", "source", "level").agg(F.count("*").alias("n"))
    return counts.select("variable", "source", "level", (F.col("n") / F.sum("n").over(Window.partitionBy("variable", "source"))).alias("share"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal width between the minimum and maximum."""
    x = df.select(as_number_column(df, column).alias("x")).filter("x is not null")
    edge = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    w = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor((F.col("x") - F.col("a")) / F.when(w > 0, w).otherwise(1.0)), F.lit(bins - 1)).cast("int")
    return x.crossJoin(F.broadcast(edge)).groupBy(at.alias("bin"), "a", "b").agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * w).alias("low"), (F.col("a") + (F.col("bin") + 1) * w).alias("high"), "n")


def ecdf(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value, ecdf)."""
    counts = unpivoted(as_number(df, columns), columns).filter("value is not null").groupBy("variable", "value").agg(F.count("*").alias("n"))
    size = counts.groupBy("variable").agg(F.sum("n").alias("size"))
    return running_totals(counts, "variable", "value", ["n"]).join(size, "variable").select("variable", "value", (F.col("n_upto") / F.col("size")).alias("ecdf"))


def qq_points(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(p, real, synthetic) at p = 0.01 to 0.99."""
    sides = [df.select(F.lit(k).alias("side"), as_number_column(df, column).alias("x")) for k, df in enumerate((real, synthetic))]
    q = quantile_grid(sides[0].unionByName(sides[1]), "side", "x", 99)
    return q.groupBy("k").agg(F.max(F.when(F.col("side") == 0, F.col("q"))).alias("real"), F.max(F.when(F.col("side") == 1, F.col("q"))).alias("synthetic")).select((F.col("k") / 100.0).alias("p"), "real", "synthetic")


def picked(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, most: int | None = None, numbers: bool | None = None) -> list[str]:
    """Columns to show: all common ones, or the named, of one kind if ``numbers`` is given; more than ``most`` raise if
    they are named and are cut to the first with a warning otherwise."""
    names = [c for c in common_columns(real, synthetic, columns) if numbers is None or is_numeric(real, c) == numbers]
    if most is not None and len(names) > most:
        if columns is not None:
            raise ValueError(f"at most {most} variables can be shown")
        warnings.warn(f"only the first {most} of {len(names)} variables are shown", stacklevel=2)
    return names[:most]


def pair_points(df: DataFrame, columns: list[str] | None = None, points: int = 1500, seed: int = 1, most: int = 5) -> DataFrame:
    """At most ``points`` rows of at most ``most`` columns, chosen by hash of the row."""
    return capped(df.select(*picked(df, df, columns, most)), points, seed)


def series_lines(real: DataFrame, synthetic: DataFrame, time: str, columns: list[str], sim: str | None = "sim") -> DataFrame:
    """(source, sim, t, series, value): the real series and each simulated one, in long form."""
    def long(df: DataFrame, source: str) -> DataFrame:
        run = F.col(sim).cast("long") if sim and sim in df.columns else F.lit(0).cast("long")
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")
        return df.select(F.lit(source).alias("source"), run.alias("sim"), F.col(time).alias("t"), pairs).select("source", "sim", "t", "p.*")

    return long(real, "real").unionByName(long(synthetic, "synthetic"))


def distance_histogram(distances: DataFrame, bins: int = 30) -> DataFrame:
    """(source, bin, low, high, share) of nearest-record distances, rows (source, distance), on common bins."""
    seen = distances.filter("distance is not null")
    edge = seen.agg(F.min("distance").alias("a"), F.max("distance").alias("b"))
    w = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor((F.col("distance") - F.col("a")) / F.when(w > 0, w).otherwise(1.0)), F.lit(bins - 1)).cast("int")
    counts = seen.crossJoin(F.broadcast(edge)).groupBy("source", at.alias("bin"), "a", "b").agg(F.count("*").alias("n"))  # one row of edges
    total = seen.groupBy("source").agg(F.count("*").alias("size"))
    return counts.join(total, "source").select("source", "bin", (F.col("a") + F.col("bin") * w).alias("low"), (F.col("a") + (F.col("bin") + 1) * w).alias("high"), (F.col("n") / F.col("size")).alias("share"))


def association_tiles(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_var, col_var, real, synthetic, difference)."""
    names = picked(real, synthetic, columns)
    a, b = (association_matrix(df, names).withColumnRenamed("value", name) for df, name in ((real, "real"), (synthetic, "synthetic")))
    return a.join(b, ["row_var", "col_var"]).withColumn("difference", F.col("synthetic") - F.col("real"))


def calibration_path(calibration) -> list[tuple[float, float, bool]]:
    """(closeness, value, chosen) by closeness, for a line with the chosen point marked."""
    return [(c, v, c == calibration.closeness and v == calibration.value) for c, v in sorted(calibration.path)]


def comparison_bars(comparison) -> DataFrame:
    """(variable, metric, value) of the marginal distances of a comparison."""
    m = comparison.marginal
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("ks", "wasserstein", "tvd")])).alias("p")
    return m.select("variable", pairs).select("variable", "p.*").filter("value is not null")


def percent(x: float, digits: int = 1) -> str:
    return f"{100 * x:.{digits}f}%"
