"""Connected components of an edge table, without any driver-side collection.

Large-star and small-star steps alternate until the edges form stars around the
smallest vertex of every component.  Each step is one aggregation (combined on
the map side, so a hub costs one row per task) and one join (to whose edges a hot
hub's row is sent, so that they never meet in one task).  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.hot import hot_keys, join_on_hot
from tabweave.llm.scratch import Scratch


def _large_star(edges: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """``n``: number of edges."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), name)
    return join_on_hot(both, low.select("u", "m"), ["u"], hot_keys(low, "n", 2 * n)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """``n``: bound of the number of edges."""
    low = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
    moved = join_on_hot(edges, low.select("u", "m"), ["u"], hot_keys(low, "n", n)).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Return (node, component) for every vertex that is not its component's smallest.

    ``edges``: two columns u, v of one orderable type.  Nulls and loops are ignored,
    direction and repetition do not matter.  An empty table gives an empty table.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    now, last, turn = scratch.write(now, f"{name}0"), None, 0
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == last or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        turn, last = turn + 1, seen
        large = scratch.write(_large_star(now, seen[0], scratch, f"{name}{turn}low"), f"{name}{turn}large")
        after = scratch.write(_small_star(large, 2 * seen[0], scratch, f"{name}{turn}least"), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}", f"{name}{turn}low", f"{name}{turn}large", f"{name}{turn}least")
        now = after
