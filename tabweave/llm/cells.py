"""All pairs inside the cells of a grid, with bounded memory for hot cells.

A cell with more than ``block`` rows is cut into blocks; each pair of its blocks
becomes a group of its own, so no task ever holds more than two blocks of a cell
and a hot cell's pairs are spread over many tasks.  Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.hot import hot_keys
from tabweave.llm.scratch import Scratch


def in_blocks(rows: DataFrame, cell: list[str], member: Column, block: int, total: int, scratch: Scratch) -> DataFrame:
    """``rows`` with columns ``_i``, ``_j`` and ``_own``: the pair of blocks a row is sent to, and its own block.

    Rows of a cell with at most ``block`` rows go to (0, 0) once.  Others go once to
    each pair that holds their own block.  ``member`` deals the rows to blocks, ``total`` is
    the number of rows: cells with a share of it are few, and their rows learn the number of
    blocks where they lie."""
    large = scratch.write(rows.groupBy(*cell).agg(F.count("*").alias("_n")).filter(F.col("_n") > block).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")), "large_cells")
    top = F.broadcast(hot_keys(large, "_n", total).select(*cell, "_blocks"))
    rest = rows.join(top.select(*cell), cell, "left_anti").join(large.drop("_n"), cell, "left")
    dealt = rows.join(top, cell).unionByName(rest).withColumn("_own", F.coalesce(F.pmod(F.xxhash64(member), F.col("_blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks"), F.lit(1)) - 1))
    return dealt.withColumn("_other", other).withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_blocks", "_other")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``keys``: tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for k in keys:
            column = b[k].to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # of the batch's last group
        if held and any(held[-1][k][held[-1].num_rows - 1] != b[k][0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, b.slice(0, start)])
            held = []
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups of a table sorted by ``keys``, and its length."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table[k].to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def pairs_in_groups(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a < b) inside each group, by growing distance b - a."""
    size = np.diff(starts)
    end_of = np.repeat(starts[1:], size)
    at = np.arange(starts[-1])
    step = 1
    while True:
        at = at[at + step < end_of[at]]
        if not len(at):
            return
        yield at, at + step
        step += 1


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index linked to each of n vertices by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    while (root[root] != root).any():
        root = root[root]
    return root


def sorted_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``run`` to tables of whole groups: one shuffle by ``keys``, one sort, streaming."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            yield from run(table)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(over, schema)
