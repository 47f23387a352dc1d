"""Packing token sequences by cutting-stock column generation.

Every document is cut into full sequences and a remainder.  The histogram of
remainder lengths (at most CAPACITY rows, whatever the input) goes to the driver,
where a linear program over patterns - multisets of lengths that fit one sequence
- is solved by column generation: its duals price new patterns by an unbounded
knapsack.  Whole multiples of the patterns are kept, what rounding leaves over is
packed best-fit, and the resulting slots are dealt to the documents of each
length by rank.  Ranks are counted in buckets of bounded size, so a length that a
third of all documents share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows, strings
from tabweave.llm.scratch import Scratch

CAPACITY = 1024
#: Documents of one length that one ranking bucket holds on average.
BUCKET = 500
#: Relative gap to the linear program's lower bound at which column generation stops, and its most rounds.
GAP, ROUNDS = 0.002, 4000
#: Rounds between new inverses of the basis, and the least pivot.
REFRESH, PIVOT = 100, 1e-7
#: Error of a solved pattern at which the inverse is computed anew.
DRIFT = 1e-7
#: Fixed value: the special token of the vocabulary; the library parses it inside texts by default.
SPECIAL = {"<|endoftext|>": 50256}


#: Texts within Latin-1 on which two libraries must agree: every character alone, doubled, between letters, digits and spaces.
PROBES = tuple(f(c) for c in map(chr, range(256)) for f in (lambda c: c, lambda c: c + c, lambda c: f"ab{c}cd{c} 12{c}3 {c}\n{c}x")) + ("it's WE'LL don't 'Re", "  two   spaces \t\n\r\n end ", *SPECIAL, f"a{next(iter(SPECIAL))} b", "x" * 300, "1234567890" * 20, "")


class Encoder:
    """Ids of the byte-level BPE vocabulary ``path`` (.json, library tokenizers).

    If ``ranks`` names the same vocabulary for tiktoken, texts within Latin-1 go
    through that library, which gives the same ids several times faster; other texts, where the
    libraries' Unicode tables could differ, always go through tokenizers.  The rule is held against
    tokenizers on ``PROBES`` whenever an encoder is made, and dropped if any ids differ.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=SPECIAL)
            if all(fast.encode(t, allowed_special="all") == self.slow.encode(t, add_special_tokens=False).ids for t in PROBES):
                self.fast = fast

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                text.encode("latin-1")
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
            except UnicodeEncodeError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks, pattern)


CUT = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])


def cut(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, doc_tokens (with the id 0 that ends each document) and the CRC-32 of each piece of
    ``capacity`` ids, the remainder last.  Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(path, ranks, pattern), Rows(CUT)
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), strings(b["text"])):
                ids = np.append(enc.ids(text), np.zeros(1, "<u4")).astype("<u4")
                crcs = [zlib.crc32(ids[a : a + capacity].tobytes()) for a in range(0, len(ids), capacity)]
                yield from out.add((doc_id, len(ids), crcs), 32 + 8 * len(crcs))
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within ``capacity``, as counts by size (unbounded knapsack by dynamic programming)."""
    useful = values > 1e-12
    s, v = sizes[useful], values[useful]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            total = best[c - s[: upto[c]]] + v[: upto[c]]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], took[c] = total[k], k
    counts, c, where = np.zeros(len(sizes), np.int64), capacity, np.flatnonzero(useful)
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[where[took[c]]] += 1
            c -= int(s[took[c]])
    return float(best[capacity]), counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: the largest size left is filled up greedily with the largest that still
    fit, as often as the scarcest of them lasts.  Each pattern uses up a size that no later one
    holds, so the patterns are independent; sizes used up together get a pattern of their own."""
    n, rest = len(sizes), demand.astype(float).copy()
    basis, x = np.zeros((n, n), np.int64), np.zeros(n)
    while (rest > 0).any():
        counts, room = np.zeros(n, np.int64), capacity
        for k in np.flatnonzero(rest > 0)[::-1]:
            if sizes[k] <= room:
                counts[k] = room // sizes[k]
                room -= int(counts[k] * sizes[k])
        held = np.flatnonzero(counts)
        ratio = rest[held] / counts[held]
        times = ratio.min()
        rest[held] -= times * counts[held]
        over = held[ratio <= times * (1 + 1e-12)]
        rest[over] = 0.0
        rest[rest < 1e-9] = 0.0
        basis[:, over[0]], x[over[0]] = counts, times
        for k in over[1:]:
            basis[k, k] = capacity // sizes[k]
    for k in np.flatnonzero(~basis.any(axis=0)):
        basis[k, k] = capacity // sizes[k]
    return basis, x


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts by size) and how often the linear program uses each.

    Revised simplex with an explicit basis inverse; sizes are ascending, distinct, at
    most ``capacity``.  It starts from a greedy packing and stops when no pattern prices
    in, or when the bound z / (best pattern's value) is within ``gap`` of z.  Of nearly equal
    ratios the one with the largest pivot leaves; the inverse is computed anew every REFRESH
    rounds, and whenever it no longer solves for the new pattern, so that the basis stays regular."""
    basis, x = first_basis(sizes, demand, capacity)  # column p: counts of pattern p
    inverse, fresh = np.linalg.inv(basis.astype(float)), True
    bound = float(sizes @ demand) / capacity  # no sequence holds more than ``capacity``
    for turn in range(rounds):
        duals = inverse.sum(axis=0)
        value, counts = knapsack(sizes, duals, capacity)
        direction = inverse @ counts
        if not fresh and (turn % REFRESH == 0 or np.abs(basis @ direction - counts).max() > DRIFT):
            inverse, fresh = np.linalg.inv(basis.astype(float)), True
            x = np.maximum(inverse @ demand, 0.0)
            continue
        total = float(x.sum())
        if fresh:  # the bound holds for exact duals
            bound = max(bound, total / max(value, 1.0))
        if value <= 1 + 1e-9 or total <= bound * (1 + gap):
            break
        usable = direction > PIVOT
        if not usable.any():
            break
        ratio = np.where(usable, x / np.where(usable, direction, 1.0), np.inf)
        tied = np.flatnonzero(ratio <= ratio.min() * (1 + 1e-9) + 1e-9)
        out = int(tied[direction[tied].argmax()])
        step = ratio[out]
        x = np.maximum(x - step * direction, 0.0)
        x[out] = step
        basis[:, out] = counts
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        fresh = False
    return basis.T.copy(), x


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of sizes) for what is left over, largest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room: bin numbers
    for size in sizes[::-1].tolist():
        for _ in range(int(counts[np.searchsorted(sizes, size)])):
            room = next((r for r in range(size, capacity + 1) if open_[r]), None)
            if room is None:
                bins.append([])
                b, room = len(bins) - 1, capacity
            else:
                b = open_[room].pop()
            bins[b].append(size)
            open_[room - size].append(b)
    return bins


def slots(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, last rank + 1, first sequence, offset) that cover each length's
    ranks 0..count - 1 once, and the number of sequences.  The k-th document of a slot lies in
    the k-th sequence from the slot's first."""
    if not histogram:
        return [], 0
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    patterns, x = column_generation(sizes, demand.astype(float), capacity)
    left, used, out, sequence = demand.copy(), np.zeros(len(sizes), np.int64), [], 0

    def place(counts: np.ndarray, times: int) -> None:
        nonlocal sequence
        offset = 0
        for k in np.flatnonzero(counts)[::-1]:
            for _ in range(int(counts[k])):
                out.append((int(sizes[k]), int(used[k]), int(used[k]) + times, sequence, offset))
                used[k] += times
                offset += int(sizes[k])
        sequence += times

    for k in np.argsort(-x, kind="stable"):
        times = int(np.floor(x[k] + 1e-6))
        if times and patterns[k].any():
            times = min([times, *(left[patterns[k] > 0] // patterns[k][patterns[k] > 0]).tolist()])
            if times:
                left -= times * patterns[k]
                place(patterns[k], times)
    for bin_ in best_fit(sizes, left, capacity):
        place(np.bincount(np.searchsorted(sizes, bin_), minlength=len(sizes)), 1)
    return out, sequence


def _starts(buckets: DataFrame) -> DataFrame:
    """(rest, bucket, n_before, f_before): sums of n and f over the earlier buckets of a length, first of every
    BUCKET buckets and then over these groups, so that no task ranks all buckets of a hot length."""
    grouped = buckets.withColumn("many", F.floor(F.col("bucket") / BUCKET))
    inside = Window.partitionBy("rest", "many").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("rest").orderBy("many").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("rest", "many").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).select("rest", "many", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(over), F.lit(0)).alias("f0"))
    own = grouped.select("rest", "many", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"), F.coalesce(F.sum("f").over(inside), F.lit(0)).alias("f1"))
    return own.join(sums, ["rest", "many"]).select("rest", "bucket", (F.col("n0") + F.col("n1")).alias("n_before"), (F.col("f0") + F.col("f1")).alias("f_before"))


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, bucket: int = BUCKET, scratch: Scratch | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Full pieces are sequences of their own; remainders share sequences.  Only doc_id
    and text are read.  Null text counts as empty: one piece, the closing id alone.  Rows
    that repeat a doc_id, or have none, are documents of their own; an empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    rest = (F.col("doc_tokens") % capacity).cast("int")
    whole = cut(docs, path, ranks, pattern, capacity).withColumn("row", F.monotonically_increasing_id())  # fixed once written
    tokens = scratch.write(whole.withColumn("rest", rest).withColumn("full", F.floor(F.col("doc_tokens") / capacity)), "tokens")
    found = tokens.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()  # at most ``capacity`` rows
    plan, sequences = slots({r["rest"]: r["n"] for r in found if r["rest"]}, capacity)
    lengths, first_full = [], sequences
    for r in sorted(found, key=lambda r: r["rest"]):
        lengths.append((r["rest"], -(-r["n"] // bucket), first_full))
        first_full += r["full"]
    of_length = F.broadcast(spark.createDataFrame(lengths, "rest int, buckets int, first_full long"))  # at most ``capacity`` rows
    dealt = tokens.join(of_length, "rest").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")).cast("int"))
    starts = _starts(dealt.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("f")))
    within = Window.partitionBy("rest", "bucket").orderBy("row")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).withColumn("f", F.coalesce(F.sum("full").over(before), F.lit(0)))
    ranked = scratch.write(ranked.join(starts, ["rest", "bucket"]).select("doc_id", "doc_tokens", "crcs", "rest", "full", (F.col("rank") + F.col("n_before")).alias("rank"), (F.col("first_full") + F.col("f_before") + F.col("f")).alias("first_full")), "ranked")
    scratch.drop("tokens")
    whole = ranked.filter("full > 0").select("doc_id", "doc_tokens", "first_full", F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("k", "crc"))
    whole = whole.select("doc_id", (F.col("k").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first_full") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = F.broadcast(spark.createDataFrame(plan, "rest int, low long, high long, sequence long, offset long"))  # at most one row a pattern and item
    shared = ranked.filter("rest > 0").join(table, "rest").filter("low <= rank and rank < high")
    shared = shared.select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
    return whole.unionByName(shared)
