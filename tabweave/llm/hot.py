"""Joins of rows with a table of one row (or a few) per key, where a few keys may hold most rows.

A key is hot if it holds more than one in HOT_KEYS of all rows, so there are always
fewer than HOT_KEYS hot keys: their side of the join is small whatever the input, and
is sent to the rows.  The rows of all other keys are joined by a shuffle, where no key
brings more than that share to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most hot keys, and the rows that a key must exceed to be one.
HOT_KEYS, HOT_ROWS = 4096, 500


def hot_keys(counts: DataFrame, n: str, total: int) -> DataFrame:
    """The rows of ``counts`` (one a key, column ``n`` its number of rows out of ``total``) of hot keys: fewer than HOT_KEYS."""
    return counts.filter(F.col(n) > max(HOT_ROWS, total / HOT_KEYS))


def join_on_hot(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` and ``side``, which holds one row (or a few) per key; ``hot`` holds the hot keys.

    Rows with a null key join nothing.  An empty ``hot`` leaves the plain join."""
    mark = F.broadcast(hot.select(*keys))
    few = F.broadcast(side.join(mark, keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(mark, keys, "left_anti").join(side, keys))
