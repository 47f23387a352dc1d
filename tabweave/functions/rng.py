"""Uniform numbers that depend only on (seed, purpose, row), never on partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEED = 2**31 - 1


def check_seed(seed: int) -> int:
    if isinstance(seed, bool) or not isinstance(seed, (int, np.integer)) or abs(int(seed)) > MAX_SEED:
        raise ValueError(f"seed must be a whole number of at most {MAX_SEED} in size")
    return int(seed)


def uniform_md5(seed: int, tag: str, row: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5; DuckDB computes the same value (see ``uniform_md5_sql``)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), row.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def uniform_md5_sql(seed: int, tag: str, row: str) -> str:
    return f"((CAST(('0x' || substr(md5('{seed}|{tag}|' || CAST({row} AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


def uniform_hash(seed: int, tag: str, row: Column) -> Column:
    """In (0, 1), from a 64-bit hash: cheaper, without a DuckDB twin."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tag), row), 12).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def uniform_block(seed: int, tag: str, rows: np.ndarray) -> np.ndarray:
    """The same idea in numpy: two rounds of a 64-bit mixer over row numbers."""
    key = np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}|{tag}".encode(), digest_size=8).digest(), "little"))
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key
        for _ in range(2):
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            x += key
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def uniform_block_sql(seed: int, tag: str, row: str) -> str:
    """``uniform_block`` for DuckDB: the mixer on 128-bit integers, modulo 2 to the 64."""
    key = int.from_bytes(hashlib.blake2b(f"{seed}|{tag}".encode(), digest_size=8).digest(), "little")
    big = lambda k: f"{k}::UHUGEINT"
    x = f"((({row})::UHUGEINT * {big(0x9E3779B97F4A7C15)} + {big(key)}) % {big(1 << 64)})"
    for _ in range(2):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = f"((xor({x}, ({x} >> {shift})) * {big(factor)}) % {big(1 << 64)})"
        x = f"((xor({x}, ({x} >> 31)) + {big(key)}) % {big(1 << 64)})"
    return f"((({x} >> 12)::DOUBLE + 0.5) / 4503599627370496.0)"
