"""Generation over a stream of row numbers: rows depend on (seed, number) alone, so batches join seamlessly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.rng import uniform_hash
from tabweave.functions.special import phi_inverse


def normal_stream(spark: SparkSession, columns: int, seed: int = 1, rows_per_second: int = 100) -> DataFrame:
    """An endless stream (value, z1, z2, ...) of standard normal rows."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select("value", *[phi_inverse(uniform_hash(seed, f"z{k}", F.col("value"))).alias(f"z{k + 1}") for k in range(columns)])
