"""Where queries and their DuckDB twins are registered, and what all of them use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.rng import uniform_block_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(key) % 2 == 0), df.filter(F.col(key) % 2 == 1)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def values(rows: list[tuple], names: list[str]) -> str:
    """A constant SQL table."""
    def cell(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def drawn_sql(column: str, source: str, n: int, seed: int, tag: str | None = None, kind: str = "VARCHAR", temperature: float = 1.0) -> str:
    """Values that independent generation draws for rows 0 to n - 1 of one column: cells of the cumulated shares."""
    u = uniform_block_sql(seed, tag or f"copula|{column}", "i")
    return f"""(WITH f AS (SELECT {column} AS v, (count(*) * 1.0 / sum(count(*)) OVER ()) ** (1.0 / {temperature}) AS w FROM {source} WHERE {column} IS NOT NULL GROUP BY 1), g AS (SELECT v, w / sum(w) OVER () AS p FROM f), c AS (SELECT v, sum(p) OVER (ORDER BY v) AS hi, sum(p) OVER (ORDER BY v) - p AS lo, row_number() OVER (ORDER BY v DESC) AS back FROM g),
 u AS (SELECT i, {u} AS u FROM range({n}) t(i)) SELECT u.i, CAST(c.v AS {kind}) AS v FROM u JOIN c ON u.u > c.lo AND (u.u <= c.hi OR c.back = 1))"""
