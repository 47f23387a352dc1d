"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the concatenation of random hashes, the signs of its
projections, taken about the mean of its label, on random directions.  Vectors are ordered
by label, pass and key, and each is compared in double precision with its neighbours in
that order.  The window is the run of rows that agree in the leading hashes; their number
and that of the passes follow from the label's size and spread, such that a run has about
WINDOW rows and a pair at the threshold shares some window but for a chance of MISS.
Runs that stay longer (dense labels, groups of near copies) are not cut: they are dealt
into blocks and compared block by block, so memory is that of two blocks.  A label of at
most WINDOW vectors is one run, compared whole.

A pair counts in the first pass where it shares a window, which its two keys tell without
any exchange of pairs.  Each run adds up its rows' links and reduces them to a forest;
these are united across runs and passes into components.  Equal vectors are one class
with a weight, so copies are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows
from tabweave.llm.cells import bounds, forest, in_blocks, sorted_groups
from tabweave.llm.graph import components
from tabweave.llm.hot import hot_keys, join_on_hot
from tabweave.llm.scratch import Scratch

#: Rows that a window has on average, the chance that all passes miss a pair at the threshold, and the most passes.
WINDOW, MISS, MOST = 256, 1e-4, 48
#: Rows a block of a long run has on average, and rows of a block compared at once with another block.
BLOCK, TILE = 2048, 512
SEED = 20
VECTORS = pa.schema([("vec_id", pa.int64()), ("grp", pa.string()), ("digest", pa.binary()), ("unit", pa.list_(pa.float64()))])


def unit(vector) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or holds
    a null or non-finite component."""
    if vector is None or not len(vector) or None in vector:
        return None
    x = np.asarray(vector, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0 or np.isnan(x).any():
        return None
    x = x / top
    return x / np.sqrt(x @ x) + 0.0


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, grp (label and dimension; null if the row can't link), digest, unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(VECTORS)
        for b in batches:
            for vec_id, vector, label in zip(b["vec_id"].to_pylist(), b["embedding"].to_pylist(), b["label"].to_pylist()):
                x = unit(vector) if label is not None else None
                if x is None:
                    yield from out.add((vec_id, None, None, None))
                    continue
                d = len(x)
                yield from out.add((vec_id, f"{d}|{label}", hashlib.blake2b(x.tobytes(), digest_size=16).digest(), x), 16 * d)
        yield from out.flush()

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).mapInArrow(run, "vec_id long, grp string, digest binary, unit array<double>")


def plan(n: int, spread: float, threshold: float = 0.98, window: int = WINDOW, miss: float = MISS, most: int = MOST) -> tuple[int, int]:
    """(leading hashes, passes) for a label of ``n`` vectors at root mean square distance ``spread`` from their mean.

    Two unit vectors at the threshold lie sqrt(2 - 2 threshold) apart; seen from the mean, at the distance ``spread``,
    that is an angle at most, and a random direction separates them with its share of a half turn.  Of all numbers of
    hashes that need at most ``most`` passes the one with the least comparisons is taken; 0 hashes need one pass."""
    angle = 2 * math.asin(min(1.0, math.sqrt(max(2 - 2 * threshold, 0.0)) / (2 * max(spread, 1e-9))))
    agree = 1 - angle / math.pi
    best = (n, 0, 1)
    for hashes in range(1, 63):
        if n >> (hashes - 1) <= window or agree**hashes < 1e-6:
            break
        passes = math.ceil(math.log(miss) / math.log1p(-(agree**hashes)))
        if passes <= most:
            best = min(best, (passes * max(n >> hashes, window), hashes, passes))
    return best[1:]


def directions(d: int, passes: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """Random directions by dimension, pass and hash; those of a pass do not depend on how many follow."""
    return np.stack([np.random.default_rng([seed, d, k]).standard_normal((hashes, d)) for k in range(passes)])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading hashes of every pass, one long a pass, for rows with columns unit, centre, hashes and passes."""
    known: dict[tuple[int, int, int], np.ndarray] = {}
    for b in batches:
        keys: list = [None] * b.num_rows
        hashes, passes = b["hashes"].to_numpy(), b["passes"].to_numpy()
        units, centres = b["unit"], b["centre"]
        width = np.diff(units.offsets.to_numpy())
        for d, h, p in set(zip(width.tolist(), hashes.tolist(), passes.tolist())):
            at = np.flatnonzero((width == d) & (hashes == h) & (passes == p))
            take = pa.array(at)
            X = units.take(take).flatten().to_numpy().reshape(-1, d) - centres.take(take).flatten().to_numpy().reshape(-1, d)
            if h and (d, h, p) not in known:
                known[d, h, p] = directions(d, p, h)
            bits = (X @ known[d, h, p].reshape(-1, d).T >= 0).reshape(len(at), p, h) if h else np.zeros((len(at), p, 0), bool)
            packed = bits @ (1 << np.arange(h, dtype=np.int64)) if h else np.zeros((len(at), p), np.int64)
            for i, row in zip(at.tolist(), packed):
                keys[i] = row
        yield pa.RecordBatch.from_arrays([b["grp"], b["node"], b["weight"], units, pa.array(keys, pa.list_(pa.int64()))], names=["grp", "node", "weight", "unit", "keys"])


def centres(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Per grp: number of classes, their mean vector, and the root mean square distance from it.  Sums are added up inside
    each task first, so a label that holds most rows is no bottleneck."""
    schema = pa.schema([("grp", pa.string()), ("k", pa.int32()), ("v", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for b in batches:
            grp = np.array(b["grp"].to_pylist(), object)
            width = np.diff(b["unit"].offsets.to_numpy())
            for g in set(grp):
                at = np.flatnonzero(grp == g)
                total = b["unit"].take(pa.array(at)).flatten().to_numpy().reshape(len(at), width[at[0]]).sum(axis=0)
                for k, v in enumerate(total.tolist()):
                    yield from out.add((g, k, v, len(at) if k == 0 else 0))
        yield from out.flush()

    sums = classes.select("grp", "unit").mapInArrow(run, "grp string, k int, v double, n long").groupBy("grp", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = sums.groupBy("grp").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "v"))).alias("sums"))  # one entry a dimension
    whole = whole.select("grp", "n", F.transform("sums", lambda x: x["v"] / F.col("n")).alias("centre"))
    return scratch.write(whole.withColumn("spread", F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x)))), "centres")


def _links(threshold: float):
    """Per row of a pair of blocks of a run: node, linked (rows that link with it there and shared no window in an earlier
    pass, copies counted; on the diagonal of the first pass its own too) and low (the smallest node that links of this
    pair of blocks connect it with)."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = bounds(table, ["grp", "turn", "key", "_i", "_j"])
        node, weight, own, turn = (table[c].to_numpy() for c in ("node", "weight", "_own", "turn"))
        diagonal = table["_i"].to_numpy() == table["_j"].to_numpy()
        units, keys = table["unit"].combine_chunks(), table["keys"].combine_chunks()
        flat, at = units.flatten().to_numpy(), units.offsets.to_numpy() - units.offsets.to_numpy()[0]
        flat_keys, key_at = keys.flatten().to_numpy(), keys.offsets.to_numpy() - keys.offsets.to_numpy()[0]
        total, low = np.where(diagonal & (turn == 0), weight, 0), node.copy()
        for a, b in zip(starts[:-1], starts[1:]):
            X, n, k = flat[at[a] : at[b]].reshape(b - a, -1), b - a, int(turn[a])  # one label has one dimension
            earlier = flat_keys[key_at[a] : key_at[b]].reshape(n, -1)[:, :k]
            one = np.arange(n) if diagonal[a] else np.flatnonzero(own[a:b] == own[a])
            other = one if diagonal[a] else np.flatnonzero(own[a:b] != own[a])
            root, w = np.arange(n), weight[a:b]
            Y = X[other]
            for t in range(0, len(one), TILE):
                skip = t if diagonal[a] else 0
                linked = X[one[t : t + TILE]] @ Y[skip:].T >= threshold
                if diagonal[a]:
                    linked = np.triu(linked, 1)
                u, v = np.nonzero(linked)
                u, v = one[t + u], other[skip + v]
                if k:  # pairs that met before have been counted
                    new = np.ones(len(u), bool)
                    for j in range(k):
                        new &= earlier[u, j] != earlier[v, j]
                    u, v = u[new], v[new]
                total[a:b] += (np.bincount(u, w[v], n) + np.bincount(v, w[u], n)).astype(np.int64)
                root = forest(root[u], root[v], n)[root]
            least = node[a:b].copy()
            np.minimum.at(least, root, node[a:b])
            low[a:b] = least[root]
        told = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(total[told]), pa.array(low[told])], names=["node", "linked", "low"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, window: int = WINDOW, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Per vector row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their dimensions are equal
    and their cosine reaches ``threshold``.  Every link found is exact; of those at the threshold
    itself about MISS are missed in labels of more than ``window`` vectors, of closer ones fewer.
    A null vector, a zero vector, one with a null or non-finite component, or a row with a null id
    links with nothing: n_links 0, its own id as component_id, kept true.  Only vec_id, embedding and label are
    read.  Equal vectors link with each other; an empty table gives an empty table;
    rows that repeat a vec_id are one vertex of the components, a row and a result each.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "vectors")
    own = scratch.write(prepared(vectors), "vectors")
    classes = scratch.write(own.filter("grp is not null and vec_id is not null").groupBy("grp", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("unit").alias("unit")), "classes")
    middle = centres(classes, scratch)
    steps = F.udf(lambda n, spread: plan(n, spread, threshold, window), "hashes int, passes int")  # once a label
    label = scratch.write(middle.withColumn("plan", steps("n", "spread")).select("grp", "n", "centre", "plan.*"), "labels")
    keyed = join_on_hot(classes.select("grp", "node", "weight", "unit"), label, ["grp"], hot_keys(label, "n", classes.count()))
    keyed = keyed.select("grp", "node", "weight", "unit", "centre", "hashes", "passes").mapInArrow(_keys, "grp string, node long, weight long, unit array<double>, keys array<long>")
    runs = keyed.select("grp", "node", "weight", "unit", "keys", F.posexplode("keys").alias("turn", "key"))
    order = ["grp", "turn", "key"]
    pairs = in_blocks(runs, order, F.col("node"), block, label.agg(F.coalesce(F.sum(F.col("n") * F.col("passes")), F.lit(0))).first()[0], scratch).select(*order, "_i", "_j", "_own", "node", "weight", "unit", "keys")
    links = scratch.write(sorted_groups(pairs, [*order, "_i", "_j"], _links(threshold), "node long, linked long, low long"), "links")
    found = components(links.filter("low < node").select(F.col("node").alias("u"), F.col("low").alias("v")), scratch)
    members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    result = classes.select("grp", "digest", "node", "weight").join(members, "node", "left").join(linked, "node", "left").select("grp", "digest", F.coalesce("component", "node").alias("component_id"), (F.coalesce("linked", "weight") - 1).alias("n_links"))
    linkable = own.select("vec_id", "grp", "digest").filter("grp is not null and vec_id is not null")
    linkable = join_on_hot(linkable, result, ["grp", "digest"], hot_keys(classes, "weight", linkable.count()))
    alone = own.filter("grp is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linkable.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
