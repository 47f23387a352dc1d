"""SentencePiece BPE models: encoding and decoding by vectorised merge rounds.

A text is cut where no piece can cross: before a run of spaces, and around
characters that no longer piece contains.  Distinct chunks are encoded together:
all their symbols lie in one flat array.  A round finds each chunk's pair of
least rank by a segmented minimum and merges its occurrences from left to right
in all chunks at once; arrays are compacted, and finished chunks leave, until no
pair remains.  A merge of several occurrences is kept only if it makes no pair
of equal or lesser rank (which the sequential order would merge first);
otherwise that chunk merges its leftmost occurrence alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows, strings

SPACE = "▁"
NONE = np.int64(1) << 60
#: Distinct chunks after which a worker starts a new memory (keeping the last one for look-ups), and chunks encoded in one go.
REMEMBER, TOGETHER = 300_000, 50_000


class PieceBpe:
    """Tables of one model file: symbols, and ranks and results of all mergeable pairs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_: list[bytes] = [p.replace(SPACE, " ").encode() for p in pieces]
        self.byte_id = np.zeros(256, np.int64)
        plain: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_[i] = bytes([int(p[3:5], 16)])
            elif model.is_control(i):
                self.bytes_[i] = b""
            elif not (model.is_unknown(i) or model.is_unused(i)):
                plain[p] = i
        if not self.byte_id.any():
            raise ValueError("a model with byte fallback is needed")
        self.symbol = dict(plain)  # characters without a piece of their own get ids past the vocabulary
        for p in plain:
            for c in p:
                self.symbol.setdefault(c, size + len(self.symbol))
        self.size = size
        scores = {p: model.get_score(i) for p, i in plain.items()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found: dict[int, tuple[int, int]] = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                left, right = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = (rank_of[scores[p]], i)
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()], np.int64)
        self.results = np.array([found[k][1] for k in self.keys.tolist()], np.int64)
        self.of_point = np.full(0x110000, -1, np.int64)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.decimal = [str(i) for i in range(size)]
        joined = {c for p in plain if len(p) > 1 for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in plain)
        if inner:
            raise ValueError("pieces that span words are not supported")
        # Characters of longer pieces stay together; each other character is a chunk.
        spared = re.escape("".join(sorted(joined - {SPACE})))
        self.chunk = re.compile(f"{SPACE}*[{spared}]+|{SPACE}+|[^{spared}{SPACE}]")

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the pair can't merge) and merged symbol of symbol pairs."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.results[at]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each chunk's ids start (and the total last).
        Chunks are non-empty strings in which spaces are U+2581."""
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        sym, owner, source = self.of_point[points], np.repeat(np.arange(len(chunks)), length), np.arange(len(points))
        rank, made = self._pairs(sym, owner, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            if (least == NONE).any():
                over = np.repeat(least == NONE, np.diff(np.append(first, len(sym))))
                done.append((owner[over], sym[over], source[over]))
                stay = ~over
                sym, owner, source, rank, made = sym[stay], owner[stay], source[stay], rank[stay], made[stay]
                if not len(sym):
                    break
                first, least = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), least[least != NONE]
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sym))))
            at = np.flatnonzero(rank == least[group])
            # leftmost first, no symbol twice: of touching occurrences every other one
            touching = np.append(False, at[1:] == at[:-1] + 1)
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(touching, 0, place))) % 2 == 0]
            many = np.bincount(group[at], minlength=len(first)) > 1
            if many.any():
                at = self._safe(sym, owner, group, made, at, least, many)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1  # where the merged symbols are after compaction
            sym, owner, source, rank, made = sym[keep], owner[keep], source[keep], rank[keep], made[keep]
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near], made[near] = self._pairs(sym, owner, near)
        return self._gather(done, points, len(chunks))

    def _pairs(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at ``at`` (NONE at a chunk's end)."""
        after = np.minimum(at + 1, len(sym) - 1)
        left, right = sym[at], sym[after]
        rank, made = self.pair(left, right)
        return np.where((after > at) & (owner[at] == owner[after]) & (left >= 0) & (right >= 0), rank, NONE), made

    def _safe(self, sym, owner, group, made, at, least, many):
        """Of groups that would merge several occurrences, those where a new pair could come first keep only their first."""
        many_at = at[many[group[at]]]
        new = sym.copy()
        new[at] = made[at]
        gone = np.zeros(len(sym) + 1, bool)
        gone[at + 1] = True
        before = np.maximum(many_at - 1, 0)
        before = np.where(gone[before], np.maximum(before - 1, 0), before)
        after = np.minimum(many_at + 2, len(sym) - 1)
        merged = made[many_at]
        low = np.full(len(many_at), NONE)
        for left, right, valid in (
            (new[before], merged, (before < many_at) & (owner[before] == owner[many_at])),
            (sym[before], merged, (before < many_at) & (owner[before] == owner[many_at])),
            (merged, new[after], (after > many_at + 1) & (owner[after] == owner[many_at])),
            (merged, sym[after], (after > many_at + 1) & (owner[after] == owner[many_at])),
        ):
            rank, _ = self.pair(left, right)
            low = np.minimum(low, np.where(valid & (left >= 0) & (right >= 0), rank, NONE))
        risky = np.zeros(len(least), bool)
        risky[group[many_at[low <= least[group[many_at]]]]] = True
        lead = np.append(True, group[at][1:] != group[at][:-1])
        return at[lead | ~risky[group[at]]]

    def _gather(self, done, points, n) -> tuple[np.ndarray, np.ndarray]:
        owner, sym, source = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(source, kind="stable")
        owner, sym, source = owner[order], sym[order], source[order]
        strange = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(strange):  # byte fallback
            parts = [self.byte_id[np.frombuffer(chr(points[source[i]]).encode(), np.uint8)] for i in strange]
            width = np.ones(len(sym), np.int64)
            width[strange] = [len(p) for p in parts]
            starts = np.cumsum(width) - width
            wide = np.repeat(sym, width)
            for i, p in zip(strange, parts):
                wide[starts[i] : starts[i] + len(p)] = p
            owner, sym = np.repeat(owner, width), wide
        return sym, np.searchsorted(owner, np.arange(n + 1))

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.bytes_[i] for i in ids])


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceBpe:
    return PieceBpe(path)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec per worker process and model: what a task learns serves the next."""
    return Codec(path)


class Codec:
    """Encodes and decodes texts; remembers the REMEMBER chunks met last, or twice that.

    For each chunk it keeps the number of ids, the ids in decimal, and the bytes that
    the decoder gives for those ids."""

    def __init__(self, path: str):
        self.model, self.memo, self.older = loaded(path), {}, {}

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Chunks of each text; ``memo`` holds them all until the next call."""
        cut = [self.model.chunks(t) for t in texts]
        if len(self.memo) > REMEMBER:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        for c in {c for part in cut for c in part}.difference(memo):
            if c in older:
                memo[c] = older[c]
            else:
                new.append(c)
        new.sort(key=len)  # alike lengths finish in alike rounds
        decimal, bytes_ = self.model.decimal, self.model.bytes_
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            ids, starts = self.model.encode_chunks(some)
            ids, starts = ids.tolist(), starts.tolist()
            for chunk, a, b in zip(some, starts, starts[1:]):
                own = ids[a:b]
                memo[chunk] = (b - a, ",".join([decimal[i] for i in own]), b"".join([bytes_[i] for i in own]))
        return cut

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(x) for c in part for x in self.memo[c][1].split(",")] for part in self.learn(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts before it."""
        data = self.model.decode_bytes(ids)
        return data.removeprefix(b" ").decode("utf-8", "replace")


def piece_ids(docs: DataFrame, path: str, batch_chars: int = 1 << 22) -> DataFrame:
    """Per document row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 (the text decoded from those ids, UTF-8).

    Null text counts as empty: no ids, digests of the empty string.  Reads doc_id and
    text only; null ids stay null; no shuffle, so repeated rows and hot texts cost
    what they hold; an empty table gives an empty table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, out = codec_of(path), Rows(schema)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        held: list[tuple[int, str]] = []

        def done() -> Iterator[pa.RecordBatch]:
            for (doc_id, _), part in zip(held, codec.learn([t for _, t in held])):
                found = [codec.memo[c] for c in part]
                ids = ",".join([f[1] for f in found])
                text = b"".join([f[2] for f in found]).removeprefix(b" ")
                yield from out.add((doc_id, sum([f[0] for f in found]), sha(ids.encode()), sha(text)), 200)
            held.clear()

        size = 0
        for b in batches:
            for row in zip(b["doc_id"].to_pylist(), strings(b["text"])):
                held.append(row)
                size += len(row[1])
                if size >= batch_chars:
                    yield from done()
                    size = 0
        yield from done()
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
