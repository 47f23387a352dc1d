"""Running totals, ranks and quantiles that no single task computes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def running_totals(counts: DataFrame, key: str, value: str, sums: list[str], cuts: int = CUTS) -> DataFrame:
    """``counts`` with ``<sum>_upto`` columns: totals over rows of the same key with a value not above.

    Rows are one per (key, value).  Values are dealt to ``cuts`` ranges by approximate
    quantiles; ranges are summed in a small table, rows only inside their range, so one
    large key is spread over many tasks."""
    grid = F.array(*[F.lit(k / cuts) for k in range(1, cuts)])
    edges = counts.groupBy(key).agg(F.percentile_approx(value, grid, F.lit(1000)).alias("_cuts"))

    def below(low: int, high: int) -> Column:  # number of cuts under the value, by halving
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("_cuts")[mid] < F.col(value), below(mid + 1, high)).otherwise(below(low, mid))

    dealt = counts.join(edges, key).withColumn("_range", below(0, cuts - 1)).drop("_cuts")
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(key, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inside = Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(s).over(inside).alias(f"_w_{s}") for s in sums]).join(totals, [key, "_range"])
    return out.select(*counts.columns, *[(F.col(f"_w_{s}") + F.col(f"_b_{s}")).alias(f"{s}_upto") for s in sums])


def unpivoted(df: DataFrame, columns: list[str], name: str = "variable", value: str = "value", kind: str = "double") -> DataFrame:
    """Long form (variable, value) of several columns in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns])
    return df.select(F.explode(pairs).alias("_p")).select(f"_p.{name}", f"_p.{value}")


def missing(c: Column) -> Column:
    """NULL or NaN (numeric columns)."""
    return c.isNull() | F.isnan(c)


def average_rank(df: DataFrame, column: str, out: str, key: str | None = None) -> DataFrame:
    """``df`` with the average rank of ``column`` (within ``key``); ties share their mean rank."""
    k = key or "_all"
    base = df if key else df.withColumn("_all", F.lit(0))
    counts = base.filter(F.col(column).isNotNull()).groupBy(k, column).agg(F.count("*").alias("n"))
    ranks = running_totals(counts, k, column, ["n"]).select(k, column, (F.col("n_upto") - (F.col("n") - 1) / 2.0).alias(out))
    return base.join(ranks, [k, column], "left").select(*df.columns, out)


def quantile_grid(long: DataFrame, key: str, value: str, count: int, kind: int = 7) -> DataFrame:
    """(key, k, q): quantiles of the non-null values of each key on an even grid of ``count`` points.

    kind 7: p = k / (count + 1), place 1 + p (n - 1).  kind 8: p = (k - 0.5) / count, place
    (n + 1/3) p + 1/3, the ends at the minimum and maximum.  A distinct value knows the ranks it
    covers, and from them, by arithmetic, the few grid points it serves; nothing is joined to the grid."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(key).agg(F.sum("c").alias("n"))
    rows = running_totals(counts, key, value, ["c"]).join(sizes, key)
    rows = rows.select(key, value, "n", (F.col("c_upto") - F.col("c") + 1).alias("a"), F.col("c_upto").alias("b"))
    n = F.col("n")

    def place(k):
        if kind == 7:
            return 1 + k * (n - 1) / (count + 1)
        h = (n + 1 / 3) * ((k - 0.5) / count) + 1 / 3
        return F.when(k == 1, 1.0).when(k == count, n.cast("double")).otherwise(F.least(F.greatest(h, F.lit(1.0)), n.cast("double")))

    def point(rank):
        return (rank - 1) / F.greatest(n - 1, F.lit(1)) * (count + 1) if kind == 7 else (rank - 1 / 3) / (n + 1 / 3) * count + 0.5

    first = F.when(F.col("a") <= 2, 1).otherwise(F.greatest(F.floor(point(F.col("a") - 1)) - 1, F.lit(1)))
    last = F.when(F.col("b") >= n, count).otherwise(F.least(F.ceil(point(F.col("b") + 1)) + 1, F.lit(count)))
    near = rows.withColumn("k", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))).withColumn("h", place(F.col("k")))
    near = near.withColumn("lo", F.floor("h")).withColumn("hi", F.least(F.floor("h") + 1, n))
    low, high = F.col("lo").between(F.col("a"), F.col("b")), F.col("hi").between(F.col("a"), F.col("b"))
    both = near.filter(low | high).groupBy(key, "k").agg(F.max(F.when(low, F.col(value))).alias("x"), F.max(F.when(high, F.col(value))).alias("y"), F.max(F.col("h") - F.col("lo")).alias("f"))
    return both.select(key, "k", (F.col("x") + F.col("f") * (F.col("y") - F.col("x"))).alias("q"))


def quantile_knots(df: DataFrame, columns: list[str], knots: int) -> DataFrame:
    """(variable, k, knot): type-8 quantiles at (k - 0.5) / knots, ends at the minimum and maximum."""
    long = unpivoted(df, columns).filter(~missing(F.col("value")))
    return quantile_grid(long, "variable", "value", knots, 8).withColumnRenamed("q", "knot")
