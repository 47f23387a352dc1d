"""SimHash fingerprints and near-duplicate groups of documents.

Fingerprint: per shingle an XXH64; bit k is set if over half of the shingles'
hashes set it.  Candidates: the segment-popcount embedding maps a fingerprint to
the bit counts of its 32 two-bit segments.  The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints.  The 32 axes
are dealt to GROUPS groups; points within Manhattan distance r differ in at most
r groups, so they share the grid cell of some choice of GROUPS - r groups.  Pairs
within a cell are kept if the Manhattan bound holds, then verified exactly.

The counts 0, 1, 2 are coded in unary inside each segment (00, 01, 11), so that
the Manhattan distance of two embeddings is a popcount of an exclusive or.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows, utf8
from tabweave.llm.cells import bounds, forest, in_blocks, pairs_in_groups, sorted_groups
from tabweave.llm.graph import components
from tabweave.llm.hot import hot_keys, join_on_hot
from tabweave.llm.scratch import Scratch

WIDTH, SEED, DISTANCE = 3, 42, 3
SEGMENTS, GROUPS = 32, 6
LOW_BITS = 0x5555555555555555
#: Rows of one cell that a task compares at once.
BLOCK = 4096
CHUNK = 1 << 16


def fingerprint(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text; no words give 0."""
    words = data.lower().split()  # bytes: A-Z only, and white space x20, x09-x0D only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = (starts[: n - width + 1], ends[width - 1 :]) if n > width else (starts[:1], ends[-1:])
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id and its fingerprint as a signed long.  Null text counts as empty (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x, width, seed) for x in utf8(b["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def unary(fp: Column) -> Column:
    """The popcount embedding in unary code, two bits a segment."""
    high = F.shiftrightunsigned(fp, 1)
    mask = F.lit(LOW_BITS)
    return fp.bitwiseOR(high).bitwiseAND(mask).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(mask), 1))


def masks(distance: int = DISTANCE, groups: int = GROUPS) -> list[int]:
    """For each choice of groups - distance groups of axes, the mask of their bits (signed)."""
    axes = np.array_split(np.arange(SEGMENTS), groups)
    of_group = [sum(3 << (2 * int(a)) for a in part) for part in axes]
    chosen = [sum(of_group[g] for g in c) for c in combinations(range(groups), groups - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]


def _links(distance: int):
    one, low = np.uint64(1), np.uint64(LOW_BITS)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = bounds(table, ["cell", "_i", "_j"])
        fp = table["fp"].to_numpy().view(np.uint64)
        own, diagonal = table["_own"].to_numpy(), (table["_i"].to_numpy() == table["_j"].to_numpy())
        code = ((fp | (fp >> one)) & low) | (((fp & (fp >> one)) & low) << one)
        found = []
        for a, b in pairs_in_groups(starts):
            near = (np.bitwise_count(code[a] ^ code[b]) <= distance) & (diagonal[a] | (own[a] != own[b]))
            a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            found.append((a[near], b[near]))
        if not found:
            return
        root = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), len(fp))
        at = np.flatnonzero(root != np.arange(len(fp)))
        nodes = table["node"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], names=["u", "v"])

    return run


def links(prints: DataFrame, scratch: Scratch, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between nodes that span the groups of fingerprints within ``distance``.

    ``prints``: distinct fingerprints ``fp`` with a node id ``node`` each.
    """
    code = F.struct(*[F.xxhash64(F.lit(i), unary(F.col("fp")).bitwiseAND(F.lit(m))).alias(f"c{i}") for i, m in enumerate(masks(distance))])
    cells = prints.select("node", "fp", F.explode(F.array(*[code[f"c{i}"] for i in range(len(masks(distance)))])).alias("cell"))
    dealt = in_blocks(cells, ["cell"], F.col("fp"), block, prints.count() * len(masks(distance)), scratch)
    return sorted_groups(dealt.select("cell", "_i", "_j", "_own", "node", "fp"), ["cell", "_i", "_j"], _links(distance), "u long, v long")


def groups(docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH, seed: int = SEED, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links.  Only doc_id and text
    are read.  Null text counts as empty: fingerprint zero, which links like any
    other.  Rows that repeat a doc_id are one vertex each by their own text but share
    that id.  A null doc_id is no vertex: its row keeps its fingerprint and gets the
    component of equal and near fingerprints, null if it has only null ids.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs, width, seed), "fingerprints")
    classes = scratch.write(own.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    found = components(links(classes.filter("node is not null"), scratch, distance, block), scratch)
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return join_on_hot(own, named, ["fp"], hot_keys(classes, "n", own.count())).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    Rows without a doc_id all stay, and so do all rows that repeat a kept doc_id."""
    kept = groups(docs, **settings).filter("doc_id = component_id").select(F.col("doc_id")).distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null")).select(*docs.columns)
