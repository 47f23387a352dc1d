"""Personal data by patterns, and by contexts bootstrapped from what the patterns find.

One pass over the texts finds the base spans of four kinds, and notes the words
around each span and around every other identifier-like piece of text.  Base spans are
seeds; the words around them are lexical patterns.  Over the graph of patterns
and instances, Spark then alternates: a pattern's confidence in a kind is the
smoothed mean of its instances' scores, an instance's score is the noisy-or of
its confident patterns.  Instances learned in one round support further patterns in
the next, so a context that holds no seed at all can become confident.  What a
high-confidence pattern extracts are new spans, of kind ``context``.

All pattern searches are linear in the text: runs are entered once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows, strings
from tabweave.llm.hot import hot_keys, join_on_hot
from tabweave.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no run of characters is scanned twice.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMERIC = re.compile(r"[0-9][0-9.\x20-]*+")
TOKEN_LEFT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_./-")
TOKEN_RIGHT = re.compile(r"[A-Za-z0-9_./-]*+")
GROUP = re.compile(r"[0-9]++")
LABELLED = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]*+[:=#]\x20?+([A-Za-z0-9_./-]++)")
#: Signs that join the groups of one identifier, as in "(555) 123-4567" or "4111 1111 1111 1112".
JOINS = frozenset((" ", "-", ") ", " (", ")-", "-(", ")", "("))
#: Least length of an identifier-like piece, and how much text around a span is read for its context.
TOKEN_LENGTH, AROUND = 6, 80
#: Most rounds (they end earlier where nothing changes), and what a pattern must reach: confidence in one kind, and
#: distinct instances, seeds or learned, behind it.
ROUNDS, CONFIDENCE, SUPPORT, SMOOTHING = 8, 0.8, 8, 1.0

DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _in_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of e-mail addresses: each @ is reached from the left end of its local part."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Sorted (start, kind, end) of base spans."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for a, b in [m.span() for m in NUMERIC.finditer(text)]:
        if b - a >= 7:
            for m in IP.finditer(text, a, b):
                if all(map(_in_byte, m[0].split("."))):
                    out.append((m.start(), 1, m.end()))
        if b - a >= 12:
            for m in CARD.finditer(text, a, b):
                digits = m[0].translate(DIGITS)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(m[0].translate(DIGITS)) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def pieces(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Identifier-like pieces of text[begin:end]: runs of letters, digits and _ . / - with a digit, joined over
    spaces, hyphens and brackets to further such runs, without trailing punctuation; and what follows a label."""
    runs: list[list[int]] = []
    last = begin
    for m in GROUP.finditer(text, begin, end):
        a = m.start()
        if a < last:
            continue
        start = a
        while start > last and text[start - 1] in TOKEN_LEFT:
            start -= 1
        stop = last = TOKEN_RIGHT.match(text, a, end).end()
        while stop > a and text[stop - 1] in "._/-":
            stop -= 1
        if runs and text[runs[-1][1] : start] in JOINS:
            runs[-1][1] = stop
        else:
            runs.append([start, stop])
    for run in runs:
        if run[0] > begin and text[run[0] - 1] == "(" and text.find(")", *run) >= 0:
            run[0] -= 1
    k = 0
    for m in LABELLED.finditer(text, begin, end):  # values without a digit
        start, stop = m.span(1)
        while stop > start and text[stop - 1] in "._/-":
            stop -= 1
        while k < len(runs) and runs[k][1] <= start:
            yield from _long(runs[k])
            k += 1
        if k == len(runs) or runs[k][0] >= stop:
            yield from _long((start, stop))
    for run in runs[k:]:
        yield from _long(run)


def _long(run) -> Iterator[tuple[int, int]]:
    if run[1] - run[0] >= TOKEN_LENGTH:
        yield tuple(run)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the two words before it, the word before with the word after, and a label that ends in : = or #."""
    left = re.sub(r"[0-9]", "0", text[max(0, start - AROUND) : start].lower()).split()
    right = re.sub(r"[0-9]", "0", text[end : end + AROUND].lower()).split()
    one = left[-1] if left else "^"
    out = [f"{left[-2] if len(left) > 1 else '^'} {one} _", f"{one} _ {right[0] if right else '$'}"]
    if one[-1] in ":=#":
        out.append(f"{one}_")
    return out


FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("seen", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))),
        ("row", pa.int64()),
    ]
)
FOUND_DDL = "doc_id long, base array<struct<start:bigint,kind:int,end:bigint>>, seen array<struct<start:bigint,end:bigint,kind:int,instance:string,patterns:array<string>>>, row long"


def found(docs: DataFrame) -> DataFrame:
    """Per document its base spans and its pattern instances (kind null for pieces that are no seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, row = Rows(FOUND), TaskContext.get().partitionId() << 40
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), strings(b["text"])):
                base = base_spans(text)
                seen = [{"start": a, "end": e, "kind": k, "instance": text[a:e].lower(), "patterns": contexts(text, a, e)} for a, k, e in base]
                at = 0
                for gap in [*base, (len(text), 0, len(text))]:
                    for a, e in pieces(text, at, gap[0]):
                        seen.append({"start": a, "end": e, "kind": None, "instance": text[a:e].lower(), "patterns": contexts(text, a, e)})
                    at = max(at, gap[2])
                row += 1
                yield from out.add((doc_id, [{"start": a, "kind": k, "end": e} for a, k, e in base], seen, row), 100 + 250 * len(seen))
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND_DDL)


def confident_patterns(seen: DataFrame, scratch: Scratch, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, score, rows) of patterns whose confidence in one kind is at least ``confidence``; ``rows`` is
    how often the pattern occurs.

    ``seen``: rows (pattern, instance, kind).  Repeated extractions of an instance count once.  A pattern
    with fewer instances than ``support`` can never be confident and is left out of the graph; patterns
    and instances of very many edges meet these by a broadcast of a bounded number of rows."""
    edges = scratch.write(seen.groupBy("pattern", F.xxhash64("instance").alias("instance")).agg(F.max("kind").alias("kind"), F.count("*").alias("rows")), "edges")
    sizes = scratch.write(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).filter(F.col("n") >= support), "sizes")
    graph = scratch.write(join_on_hot(edges.drop("rows"), sizes.select("pattern", "n"), ["pattern"], hot_keys(sizes, "n", edges.count())), "graph")
    scratch.drop("edges")
    new, total = graph.filter("kind is null"), graph.count()
    busy_pattern = scratch.write(hot_keys(sizes, "n", total).select("pattern"), "busy_pattern")
    busy_instance = scratch.write(hot_keys(new.groupBy("instance").agg(F.count("*").alias("n")), "n", total).select("instance"), "busy_instance")
    seeds = graph.filter("kind is not null").select("pattern", "n", "kind", F.lit(1.0).alias("score"))
    good, last = None, None
    for turn in range(max(rounds, 1)):
        scores = seeds
        if good is not None:  # pieces that confident patterns extract count with their own score
            told = good.select("pattern", F.col("kind").alias("learned"), "score")
            learned = join_on_hot(new.select("pattern", "instance"), told, ["pattern"], busy_pattern)
            learned = learned.groupBy("instance", "learned").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("score"))
            more = join_on_hot(new.select("pattern", "n", "instance"), learned, ["instance"], busy_instance)
            scores = scores.unionByName(more.select("pattern", "n", F.col("learned").alias("kind"), "score"))
        ranked = scores.groupBy("pattern", "n", "kind").agg(F.sum("score").alias("total"), F.count("*").alias("behind")).filter(F.col("behind") >= support)
        before, good = good, scratch.write(ranked.select("pattern", "kind", (F.col("total") / (F.col("n") + SMOOTHING)).alias("score")).filter(F.col("score") >= confidence), f"good{turn}")
        if before is not None:
            scratch.drop(f"good{turn - 1}")
        seen_now = good.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "kind"))).first()
        if seen_now == last or not seen_now[0]:
            break
        last = seen_now
    return good.join(sizes.select("pattern", "rows"), "pattern")


def find(docs: DataFrame, scratch: Scratch | None = None, **settings) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context.

    The counts and base_sha256 are of base spans; spans holds these and the learned
    ones (kind ``context``, never overlapping a base span).  Null text counts as empty:
    no spans, the digest of the empty string.  Only doc_id and text are read; rows
    are told apart by a row number, so repeated or null ids give a row each; an empty
    table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "private")
    table = scratch.write(found(docs), "found")
    seen = table.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    good = scratch.write(confident_patterns(seen.select(F.explode("patterns").alias("pattern"), "instance", "kind"), scratch, **settings), "good")
    scratch.drop("graph")
    fresh = seen.filter("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    fresh = join_on_hot(fresh, good.select("pattern").distinct(), ["pattern"], hot_keys(good.groupBy("pattern").agg(F.max("rows").alias("rows")), "rows", 0 if (n := good.agg(F.sum("rows")).first()[0]) is None else n))
    fresh = fresh.select("row", "start", "end").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end"))).alias("extra"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    both = table.select("row", "doc_id", "base").join(fresh, "row", "left").withColumn("extra", F.coalesce("extra", none))
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return both.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_context"))


def _count(spans: str, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _written(spans):
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
