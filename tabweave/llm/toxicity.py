"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and unlabelled texts.  With class prior p, the
risk of a linear scorer g under the logistic loss l is

    p E_toxic[l(g)] + max(0, E_unlabelled[l(-g)] - p E_toxic[l(-g)]),

where the subtraction removes the toxic share hidden in the unlabelled texts.  Features
are the distinct words of the whole text and the beginnings of longer ones.

Only the confirmed toxic texts are a bounded sample (POSITIVES).  Every text outside the
held-out fold is an unlabelled one: one pass counts in how many of them each word of the
toxic sample occurs, a second one reduces each to the words that the model uses, equal
reductions being added up, and each step of the descent is one aggregation over these.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows, strings
from tabweave.llm.cells import forest
from tabweave.llm.scratch import Scratch

#: Bound of the sample of texts labelled toxic that a model is fitted on.
POSITIVES = 4000
#: Distinct toxic texts of the sample that a word must occur in.
LEAST_DOCS = 3
WORD = re.compile(r"\w+")
#: Tokens that a task keeps the features of, and the longest such token.
REMEMBER, LONGEST = 500_000, 64
PRIOR_MARGIN = 1.07
#: Bins of the MinHash signature by which near copies in the toxic sample are found, and the similarity they reach.
BINS, SIMILAR = 64, 0.8
#: Lengths of word beginnings that are features of their own.
PREFIXES = (4, 5, 6, 7, 8)
#: Ridge of the weights, and the width of the smoothed clamp as a share of the prior.
RIDGE, SOFT = 1e-5, 0.02
#: Most tasks that send the driver a sum of gradients each.
TASKS = 512
#: Distinct reductions that a task adds up before it hands them on, and the grid of scores when the threshold is set.
HELD, GRID = 100_000, 1000


def features(token: str) -> set[str]:
    """Lower-cased words of a token, and the beginnings of longer ones, marked by ~."""
    words = set(WORD.findall(token.lower()))
    return words | {w[:n] + "~" for n in PREFIXES for w in words if len(w) > n}


def words_of(text: str) -> set[str]:
    """Features of a text: no word crosses white space, so they are those of its tokens."""
    return set().union(*map(features, set(text.split())))


class Lookup:
    """Positions in ``known`` of the features that a text has."""

    def __init__(self, known: list[str]):
        self.at, self.memo = {w: i for i, w in enumerate(known)}, {}
        self.begin = {w.removesuffix("~")[: PREFIXES[0]] for w in known}

    def token(self, token: str) -> tuple[int, ...]:
        low, found = token.lower(), []
        for w in (low,) if low.isalnum() else WORD.findall(low):
            if w[: PREFIXES[0]] in self.begin:  # no feature of other words is known
                found += [i for f in (w, *[w[:n] + "~" for n in PREFIXES if len(w) > n]) if (i := self.at.get(f)) is not None]
        if len(token) <= LONGEST:
            if len(self.memo) >= REMEMBER:
                self.memo.clear()
            self.memo[token] = found = tuple(found)
        return found

    def text(self, text: str) -> list[int]:
        memo, out = self.memo, set()
        for token in set(text.split()):
            found = memo.get(token)
            if found is None:
                found = self.token(token)
            if found:
                out.update(found)
        return sorted(out)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # by feature
    bias: float

    def score(self, total: float) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -30.0, 30.0)))


def in_fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def _encoded(texts: DataFrame) -> DataFrame:
    """Features and MinHash signature (least CRC-32 of each bin, over all features) of each text, numbered."""
    schema = pa.schema([("words", pa.list_(pa.string())), ("signature", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for b in batches:
            for text in strings(b["text"]):
                words = sorted(words_of(text))
                codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)
                least = np.full(BINS, 1 << 32)
                np.minimum.at(least, codes % BINS, codes // BINS)
                yield from out.add((words, least), 16 * len(words) + 8 * BINS)
        yield from out.flush()

    return texts.mapInArrow(run, "words array<string>, signature array<long>").withColumn("i", F.monotonically_increasing_id())


def near_copies(signatures: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """For each signature the smallest index that links of estimated similarity ``similar`` or more reach
    (the sample is bounded, so all pairs of it are)."""
    n, found = len(signatures), []
    for a in range(0, n, 256):
        same = np.zeros((min(256, n - a), n - a), np.int16)
        for k in range(signatures.shape[1]):
            same += signatures[a : a + 256, k, None] == signatures[None, a:, k]
        u, v = np.nonzero(same >= similar * signatures.shape[1])
        found.append((a + u, a + v))
    return forest(np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found]), n) if found else np.zeros(0, np.int64)


def evidence(a: np.ndarray, b: np.ndarray, n_toxic: int, n_all: int) -> np.ndarray:
    """For words in ``a`` of the toxic and ``b`` of all texts: the log-likelihood ratio of the two rates
    where the toxic one is higher, else 0."""
    due = (a + b) * (n_toxic / (n_toxic + n_all))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (a * np.log(a / due) + np.where(b > 0, b * np.log(b / (a + b - due)), 0.0))
    return np.where(a > due, ratio, 0.0)


def _counted(texts: DataFrame, known: list[str]) -> tuple[np.ndarray, int]:
    """In how many texts each of the features ``known`` occurs, and the number of texts; added up inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(known), np.zeros(len(known) + 1, np.int64)
        for b in batches:
            for text in strings(b["text"]):
                total[lookup.text(text)] += 1
            total[-1] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    total = np.zeros(len(known) + 1, np.int64)
    for r in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most one row a feature
        total[r["at"]] = r["n"]
    return total[:-1], int(total[-1])


def reduced(texts: DataFrame, known: list[str]) -> DataFrame:
    """(at, n): the distinct lists of positions in ``known`` that texts hold, and the number of texts with each."""
    schema = pa.schema([("at", pa.list_(pa.int32())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, held = Lookup(known), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.int32())), pa.array(list(held.values()), pa.int64())], schema=schema)

        for b in batches:
            held.update(tuple(lookup.text(text)) for text in strings(b["text"]))
            if len(held) >= HELD:
                yield told()
                held.clear()
        yield told()

    return texts.mapInArrow(run, "at array<int>, n long").groupBy("at").agg(F.sum("n").alias("n"))


def loss_sums(rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of weight * log(1 + exp(g)) over texts with g = w[cols] summed by row + w[-1], and its gradient."""
    g = np.bincount(rows, w[cols], len(weight)) + w[-1]
    slope = weight / (1 + np.exp(-np.clip(g, -500, 500)))
    return float((weight * np.logaddexp(0, g)).sum()), np.append(np.bincount(cols, slope[rows], len(w) - 1), slope.sum())


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)


def unlabelled_sums(patterns: DataFrame, total: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss of calling the unlabelled texts toxic, and its gradient, as one aggregation of partial sums."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(w) + 1)
            for b in batches:
                value, grad = loss_sums(*_flat(b["at"]), b["n"].to_numpy().astype(float), w)
                sums += np.append(grad, value)
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["v"])

        parts = [r["v"] for r in patterns.coalesce(TASKS).mapInArrow(run, "v array<double>").collect()]  # at most TASKS rows
        out = np.array([math.fsum(x) for x in zip(*parts)])  # whatever the order of tasks
        return out[-1] / total, out[:-1] / total

    return at


def risk(toxic: tuple[np.ndarray, np.ndarray, np.ndarray], unlabelled: Callable, prior: float, ridge: float = RIDGE, soft: float = SOFT) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """w -> (risk, gradient), with a ridge on all but the bias.

    ``toxic``: rows, columns and weights (of sum 1) of the toxic texts.  max(0, x) is smoothed to
    s log(1 + exp(x / s)), s being ``soft`` times the prior, so that the gradient has no jump."""
    rows, cols, share = toxic
    s = soft * prior

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        calm, grad_u = unlabelled(w)
        as_toxic, grad_t = loss_sums(rows, cols, share, w)  # l(-g) of the toxic texts
        as_clean, grad_c = loss_sums(rows, cols, share, -w)  # l(g)
        clean = (calm - prior * as_toxic) / s
        shrink = np.append(w[:-1], 0.0)
        value = prior * as_clean + s * float(np.logaddexp(0, clean)) + ridge / 2 * float(shrink @ shrink)
        return value, (grad_u - prior * grad_t) / (1 + math.exp(min(-clean, 500.0))) - prior * grad_c + ridge * shrink

    return at


def descend(at: Callable, w: np.ndarray, scale: np.ndarray, steps: int = 30, memory: int = 6, tolerance: float = 1e-3) -> np.ndarray:
    """Limited-memory BFGS from ``w`` with first inverse Hessian ``scale``; a step that does not lower
    the risk enough is shortened by quadratic interpolation, and the descent ends where no step is left."""
    value, grad = at(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, sides = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            sides.append(a)
            q -= a * y
        q *= scale
        for (s, y), a in zip(pairs, reversed(sides)):
            q += s * (a - (y @ q) / (s @ y))
        slope, t = -float(grad @ q), 1.0
        if slope >= 0:
            break
        top = np.abs(q).max()
        t = min(1.0, 4.0 / top)
        while True:
            new = at(w - t * q)
            if new[0] <= value + 1e-4 * t * slope:
                break
            fall = new[0] - value - t * slope
            t *= min(max(-t * slope / (2 * fall), 0.1), 0.5) if fall > 0 else 0.5
            if t < 1e-4:
                return w
        s, y = -t * q, new[1] - grad
        if s @ y > 1e-14:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        done = value - new[0] < tolerance * abs(value)
        w, value, grad = w + s, *new
        if done:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, least: int = LEAST_DOCS) -> Model:
    """A model from ``labels`` (doc_id, toxic) outside the held-out fold and all texts outside it.

    The prior is the toxic share of the labelled rows, PRIOR_MARGIN and 1.5 standard errors above
    what was counted: with too small a prior, sampling noise makes words that only toxic texts hold
    look partly clean, while the clamp keeps too large a one in check.  A word is used if it
    occurs in ``least`` distinct toxic texts of the sample (near copies are one) and its evidence
    exceeds what the best of as many words would reach by chance.  The driver gets word counts and
    positions of the bounded toxic sample, and per step one number a used word."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(in_fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share, n = known.agg(F.avg("toxic"), F.count("*")).first()
    if not share:
        return Model({}, -30.0)
    prior = min(share * PRIOR_MARGIN + 1.5 * math.sqrt(share * (1 - share) / n), 0.9)
    scratch = Scratch(docs.sparkSession, "toxicity")
    try:
        chosen = known.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
        sample = scratch.write(_encoded(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text")), "sample")
        drawn = sample.select("i", "signature").toArrow()  # at most a row for each text of the bounded sample
        group = near_copies(np.array(drawn["signature"].to_pylist(), np.int64).reshape(-1, BINS))
        grouped = docs.sparkSession.createDataFrame(pa.table({"i": drawn["i"], "copies": pa.array(group.astype(np.int64))}))
        words = sample.select("i", F.explode("words").alias("word")).join(F.broadcast(grouped), "i").groupBy("word").agg(F.countDistinct("copies").alias("a"))
        words = words.filter(F.col("a") >= least).orderBy("word").toArrow()  # words of the bounded sample
        known, a = words["word"].to_pylist(), words["a"].to_numpy().astype(float)
        texts = docs.filter("doc_id is not null").filter(in_fold() != 0).select("text")
        b, total = _counted(texts, known)
        used = np.flatnonzero(evidence(a, b.astype(float), len(np.unique(group)), total) > 2 * math.log(len(known) + 1))
        use, often = [known[i] for i in used], b[used] / max(total, 1)
        start = math.log(prior / (1 - prior)) if prior < 0.5 else -1e-6
        if not use:
            return Model({}, start)
        rows, cols = _flat(sample.select(F.array_intersect("words", F.lit(use)).alias("words")).toArrow()["words"])
        at_use = {w: i for i, w in enumerate(use)}
        toxic = rows, np.array([at_use[w] for w in cols], np.int64), np.full(len(group), 1 / len(group))
        patterns = scratch.write(reduced(texts, use), "patterns")
        at = risk(toxic, unlabelled_sums(patterns, total), prior)
        calm = max(prior * (1 - prior), 0.02)
        w = descend(at, np.append(np.zeros(len(use)), start), 1 / (calm * np.append(often, 1.0) + 1e-4))
        return Model(dict(zip(use, map(float, w))), threshold(patterns, toxic, w, share, total))
    finally:
        scratch.drop()


def threshold(patterns: DataFrame, toxic: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, share: float, total: int) -> float:
    """The bias at which the same risk, of errors instead of losses and with the counted ``share`` as prior, is least
    (the fitted bias belongs to the prior with its margin, and would call too many texts toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(on_grid(*_flat(b["at"]), w, b.num_rows)), b["n"]], names=["g", "n"])

    found = patterns.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()  # at most 60 * GRID + 1 rows
    g, n = np.array([r["g"] for r in found]), np.array([r["n"] for r in found], float)
    rows, cols, weight = toxic
    of_toxic = on_grid(rows, cols, w, len(weight))
    missed = np.array([weight[of_toxic < x].sum() for x in g])
    called = np.cumsum(n[::-1])[::-1] / total
    errors = share * missed + np.maximum(called - share * (1 - missed), 0.0)
    k = int(np.flatnonzero(errors <= errors.min() + 1e-12)[-1])
    return -float((g[k] + g[max(k - 1, 0)]) / 2 / GRID)


def on_grid(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.rint(np.clip(np.bincount(rows, w[cols], n), -30, 30) * GRID).astype(np.int64)


def scorer(model: Model):
    """Arrow UDF: score of each text; a null text scores as the empty one."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = sorted(model.weights)
        lookup, weights = Lookup(known), np.array([model.weights[w] for w in known])
        for texts in batches:
            totals = [weights[at].sum() if (at := lookup.text(text)) else 0.0 for text in strings(texts)]
            yield pa.array(model.score(np.array(totals, np.float64)) if totals else [], pa.float64())

    return score


def scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted (score >= 0.5).

    Only doc_id and text are read of ``docs``, doc_id and toxic of ``labels``.  Null
    text scores as empty; a null doc_id is not held out and no training text; repeated
    rows are a text each; an empty ``docs`` gives an empty table; empty ``labels``, or
    none that is toxic, give score 0.0 to all (about 1e-13).
    """
    model = model or fit(docs, labels)
    scored = docs.select("doc_id", F.coalesce(in_fold() == 0, F.lit(False)).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; columns unchanged."""
    return docs.filter(scorer(fit(docs, labels))(F.col("text")) < threshold)
