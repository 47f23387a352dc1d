"""Secrets in whole texts, with Spark SQL functions only.

Three base kinds are regular expressions.  A fourth, ``entropy``, scans every
other long token: for the token's character class, a window slides over it while
the counts of its characters, and with them the Shannon entropy, are updated by
the one character that enters and the one that leaves.  A token whose best window
reaches the class's threshold is a secret unless an allow-list pattern covers it.

All work is per row (no shuffle, no Python), so one long or hot text costs one
task its own length.  Positions count code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, each with pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Tokens that the entropy scan looks at, and the character classes it tells apart: pattern of the whole token,
#: window, and the bits that the best window must reach.  A class needs a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = (
    ("hex", r"^[0-9A-F-]+$", 16, 2.9),
    ("upper", r"^[0-9A-Z]+$", 20, 3.6),
    ("base64", r"^[0-9A-Za-z+/_=-]+$", 20, 3.6),
)

#: Tokens that are never reported by entropy: no digit or no letter, UUIDs, long repeats, words joined by separators,
#: published example keys, content digests, alphabets in order.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(.)\1{5}",
    r"^(?:[A-Za-z]+|[0-9]{1,8})(?:[/_=+-]+(?:[A-Za-z]+[0-9]?|[0-9]{1,8}))+$",
    r"EXAMPLE",
    r"^sha(?:1|256|384|512)-",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
)

#: Whole tokens that lie inside a base span in any case.
COVERED = r"^(?:[0-9a-f]+|AKIA[A-Z0-9]+)$"

SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
#: Elements that a running fold takes at once, and characters of a long token that one fold takes.
BLOCK, STRETCH = 64, 400


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often it is used (also inside folds)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """Outputs of a fold over an array: ``step(state, item)`` gives the next state, whether there is an output, and it.

    Outputs are collected block by block, so that no step copies all that were collected before."""
    none = F.array().cast(kind)

    def inner(acc: Column, item: Column) -> Column:
        new, told, out = step(acc["state"], item)
        return F.struct(new.alias("state"), F.when(told, F.array_append(acc["out"], out)).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    def over(whole: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda i: F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))
        folded = F.aggregate(blocks, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(whole) > 0, folded).otherwise(none)

    return let(items, over)


def spans_of(text: Column, pattern: str, rank: int, measured: Callable[[Column], Column], least: int) -> Column:
    """Spans of the matches of ``pattern`` where the length of ``measured(matches)`` is ``least`` or more: the pieces
    between matches and the matches alternate, so running sums of their lengths are the positions."""

    def found(matches: Column) -> Column:
        sized = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
        lengths = F.zip_with(sized, measured(matches), lambda x, m: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(m).alias("measured")))
        return F.filter(lengths, lambda x: x["size"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        begin = at + x["gap"]
        end = begin + x["size"]
        return end, x["measured"] >= least, F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))

    spans = running(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found), F.lit(0).cast("bigint"), step, SPAN)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def best_entropy(token: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits, of any ``window`` successive characters of ``token``; 0 for a shorter one.

    The sum of count * log2(count) over the characters of the window changes by the count of the character
    that enters and of the one that leaves; these two counts are all that a step looks up.  A long token is
    read in stretches that overlap by a window."""

    def weight(count: Column) -> Column:  # count * log2(count)
        return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))

    def stretch(part: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            return let(
                F.struct(F.substr(part, i, F.lit(1)).alias("enter"), F.when(i > window, F.substr(part, i - window, F.lit(1))).otherwise("").alias("leave"), F.substr(part, F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window))).alias("held")),
                lambda c: let(F.struct((F.length(c["held"]) - F.length(F.replace(c["held"], c["enter"], F.lit("")))).alias("a"), F.when(c["leave"] != "", F.length(c["held"]) - F.length(F.replace(c["held"], c["leave"], F.lit("")))).otherwise(0).alias("r")), lambda n: moved(acc, i, c, n)),
            )

        def moved(acc: Column, i: Column, c: Column, n: Column) -> Column:
            grown = F.when(c["enter"] == c["leave"], acc["sum"]).otherwise(acc["sum"] + weight(n["a"] + 1) - weight(n["a"]) + F.when(n["r"] > 0, weight(n["r"] - 1) - weight(n["r"])).otherwise(F.lit(0.0)))
            return F.struct(grown.alias("sum"), F.when(i >= window, F.least(acc["least"], grown)).otherwise(acc["least"]).alias("least"))

        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
        return F.aggregate(F.sequence(F.lit(1), F.length(part)), zero, step, lambda acc: acc["least"])

    def over(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(whole) - window) / STRETCH).cast("int"))
        parts = F.transform(starts, lambda k: F.substr(whole, k * STRETCH + 1, F.lit(STRETCH + window - 1)))
        least = F.array_min(F.transform(parts, stretch))
        return F.when(F.length(whole) >= window, F.lit(math.log2(window)) - least / F.lit(float(window))).otherwise(F.lit(0.0))

    return let(token, over)


def high_entropy(token: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Whether the token's first matching character class reaches its threshold and no allow-list pattern covers it."""
    reached = F.lit(False)
    for _, pattern, window, least in reversed(CLASSES):
        reached = F.when(token.rlike(pattern), best_entropy(token, window) >= least).otherwise(reached)
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | token.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(reached)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*(b[0] for b in BASE), "entropy")])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def with_spans(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW, found: str = "_found") -> DataFrame:
    """``docs`` with a column of two arrays, base and all, of (start, rank, end) sorted by start and then kind:
    base spans, and these with the entropy spans that do not lie inside one of them.

    A null or empty text has none.  Rows are independent, so ties and repeated rows
    simply repeat.  Choose another name where ``docs`` has a column ``_found``.
    """

    def spans(whole: Column) -> Column:
        parts = [spans_of(whole, pattern, rank, (lambda m, p=pattern, g=group: F.transform(m, lambda x: F.regexp_extract(x, p, g))) if group else (lambda m: m), least) for rank, (_, pattern, group, least) in enumerate(BASE)]
        marked = lambda m: F.transform(m, lambda t: F.when(~t.rlike(COVERED) & high_entropy(t, allow), F.lit("x")).otherwise(""))
        return F.struct(F.array_sort(F.concat(*parts)).alias("base"), spans_of(whole, TOKEN, len(BASE), marked, 1).alias("extra"))

    def step(reach: Column, s: Column) -> tuple[Column, Column, Column]:  # ``reach``: the largest end of a base span so far
        own = s["rank"] < len(BASE)
        return F.when(own, F.greatest(reach, s["end"])).otherwise(reach), own | (s["end"] > reach), s

    def merged(p: Column) -> Column:
        both = F.when(F.size(p["extra"]) > 0, running(F.array_sort(F.concat(p["base"], p["extra"])), F.lit(-1).cast("bigint"), step, SPAN)).otherwise(p["base"])
        return F.struct(p["base"].alias("base"), both.alias("all"))

    return docs.withColumn(found, let(let(F.coalesce(F.col(text), F.lit("")), spans), merged))


def count_of(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Reads doc_id and text only.  Null text counts as empty (no spans, the digest of
    the empty string); null doc_id stays null; an empty table gives an empty table.
    """
    found = with_spans(docs.select("doc_id", "text"), allow=allow)
    counts = [count_of("_found.base", rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)]
    extra = (F.size("_found.all") - F.size("_found.base")).cast("long")
    return found.select("doc_id", *counts, F.sha2(written(F.col("_found.base")), 256).alias("base_sha256"), written(F.col("_found.all")).alias("spans"), extra.alias("n_entropy"))


def redact(docs: DataFrame, mask: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with the same columns, where every span of ``text`` is replaced by ``mask``
    (spans that overlap by one mask) and ``n_chars`` counts the new text; rows without
    spans stay as they are, nulls included."""
    name = next(c for i in range(len(docs.columns) + 1) if (c := f"_found{i}") not in docs.columns)
    found = with_spans(docs, allow=allow, found=name)

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:  # the pieces of text to keep
        return F.greatest(at, s["end"]), s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end"))

    def cut(text: Column, spans: Column) -> Column:
        gaps = running(spans, F.lit(0).cast("bigint"), step, "array<struct<start:bigint,end:bigint>>")
        return F.concat(F.transform(gaps, lambda g: F.substr(text, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))), F.array(F.substr(text, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), F.length(text))))

    text, hit = F.col("text"), F.size(F.col(name)["all"]) > 0
    out = found.withColumn("text", F.when(hit, F.array_join(cut(text, F.col(name)["all"]), mask)).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
