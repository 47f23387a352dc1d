"""ISO media containers: lossless storage of bytes as 8-bit samples, and a reader
that indexes any such file by its box structure and sample tables alone.

``encode`` writes one mono track of unsigned 8-bit PCM ('raw ') whose access units
are 64-byte frames; every SYNC-th frame is marked as a sync sample.  ``index``
walks nested boxes, decodes stts, stsc, stsz or stz2, stco or co64 and stss, and the runs
of fragments (trex, tfhd, trun), and returns codec, duration and the byte ranges of
samples and sync samples without touching the payload.  ``payload`` then reads those ranges back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows, utf8

FRAME = 64
SYNC = 16
FRAMES_PER_CHUNK = 256
RATE = 8000
# Boxes that hold boxes, and the unity matrix of a track header.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"moof", b"traf", b"mvex"))
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I", size), kind, *parts))
    return b"".join((struct.pack(">I", 1), kind, struct.pack(">Q", size + 8), *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of FRAME."""
    return data + bytes(-len(data) % FRAME if data else FRAME)


def encode(payload: bytes) -> bytes:
    """A whole media file around ``payload`` (a positive multiple of FRAME bytes); no clock or chance enters."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError("payload must be a positive multiple of 64 bytes")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    chunks = -(-frames // FRAMES_PER_CHUNK)
    rest = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, rest, 1)] * (chunks == 1 or rest != FRAMES_PER_CHUNK)

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * FRAMES_PER_CHUNK * FRAME
        wide = int(offsets[-1]) >= 1 << 32
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"stss", struct.pack(">I", -(-frames // SYNC)), np.arange(1, frames + 1, SYNC).astype(">u4").tobytes()),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        time = struct.pack(">QQIQ", 0, 0, RATE, frames * FRAME)
        mdia = box(
            b"mdia",
            full(b"mdhd", time, struct.pack(">HH", 0x55C4, 0), version=1),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl),
        )
        head = full(b"mvhd", time, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        track = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, frames * FRAME), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        return box(b"moov", head, box(b"trak", track, mdia))

    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(0))
    head = moov(len(ftyp) + size + lead)
    if len(head) != size:  # offsets beyond 4 GiB need the wide table, which moves them
        head = moov(len(ftyp) + len(head) + lead)
    return b"".join((ftyp, head, box(b"mdat", payload)))


@dataclass
class Track:
    """What the tables of one track say; ``offset`` and ``size`` are one entry a sample."""

    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, size) of every sync sample."""
        return list(zip(self.offset[self.sync].tolist(), self.size[self.sync].tolist()))


def walk(data: bytes, begin: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box kinds, start, end of the box's content), in file order, nested boxes after
    their parent.  A box that runs past its parent ends the walk of that parent."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), begin, len(data) if end is None else end)]
    while open_:
        path, at, stop = open_.pop()
        if at + 8 > stop:
            continue
        size, kind, head = struct.unpack_from(">I", data, at)[0], bytes(data[at + 4 : at + 8]), 8
        if size == 1 and at + 16 <= stop:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        if size < head or at + size > stop:
            continue
        here = (*path, kind)
        yield here, at + head, at + size
        open_.append((path, at + size, stop))
        if kind in CONTAINERS and len(here) < 32:
            open_.append((here, at + head, at + size))


def _table(data: bytes, at: int, kind: str, width: int) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, kind, n * width, at + 8).reshape(n, width).astype(np.int64)


def index(data: bytes) -> list[Track]:
    """Tracks of a media file, fragments included.  Empty or foreign bytes give no tracks; a track whose
    tables are cut off or contradict each other raises ValueError."""
    tracks: list[Track] = []
    tables: list[dict] = []
    by_id: dict[int, tuple[Track, dict]] = {}
    fragment: dict = {}
    try:
        for path, at, end in walk(data):
            kind = path[-1]
            if kind == b"trak":
                tracks.append(Track())
                tables.append({})
            elif kind == b"tkhd" and tracks:
                by_id[struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]] = tracks[-1], tables[-1]
            elif kind == b"moof":
                if tables:
                    _finish(data, tracks, tables)
                fragment = {"moof": at - 8}
            elif kind == b"trex":
                track_id, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
                by_id[track_id][1]["trex"] = duration, size, flags
            elif kind == b"tfhd":
                fragment = {"moof": fragment["moof"], "tfhd": at}
            elif kind == b"trun":
                _run(data, at, fragment, by_id)
            elif tracks and b"moof" not in path and kind in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss"):
                tables[-1][kind] = (at, end)
        _finish(data, tracks, tables)
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError(f"broken sample tables: {e!r}") from e
    for track in tracks:
        if len(track.size) and ((track.offset + track.size).max() > len(data) or (track.offset < 0).any()):
            raise ValueError("samples beyond the file")
    return tracks


def _finish(data: bytes, tracks: list[Track], tables: list[dict]) -> None:
    """Decode the tables of the tracks that have not been decoded."""
    for track, own in zip(tracks, tables):
        if "done" not in own:
            own["done"] = True
            _decode(data, track, own)


def _run(data: bytes, at: int, fragment: dict, by_id: dict) -> None:
    """Add the samples of one run of a fragment to its track."""
    head = fragment["tfhd"]
    flags, track_id = struct.unpack_from(">II", data, head)
    track, own = by_id[track_id]
    duration, size, mark = own.get("trex", (0, 0, 0))
    p, base = head + 8, fragment["moof"]
    if flags & 1:
        base, p = struct.unpack_from(">Q", data, p)[0], p + 8
    p += 4 if flags & 2 else 0
    if flags & 8:
        duration, p = struct.unpack_from(">I", data, p)[0], p + 4
    if flags & 16:
        size, p = struct.unpack_from(">I", data, p)[0], p + 4
    if flags & 32:
        mark = struct.unpack_from(">I", data, p)[0]
    flags, n = struct.unpack_from(">II", data, at)
    p = at + 8
    start = fragment.get("next", base)
    if flags & 1:
        start, p = base + struct.unpack_from(">i", data, p)[0], p + 4
    marks, sizes, lengths = np.full(n, mark), np.full(n, size, np.int64), np.full(n, duration, np.int64)
    if flags & 4:
        if n:
            marks[0] = struct.unpack_from(">I", data, p)[0]
        p += 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    rows = np.frombuffer(data, ">u4", n * len(fields), p).reshape(n, len(fields)).astype(np.int64) if fields and n else np.zeros((n, 0), np.int64)
    for k, f in enumerate(fields):
        if f == 0x100:
            lengths = rows[:, k]
        elif f == 0x200:
            sizes = rows[:, k]
        elif f == 0x400:
            marks = rows[:, k]
    fragment["next"] = start + int(sizes.sum())
    track.sync = np.append(track.sync, len(track.size) + np.flatnonzero((marks & 0x10000) == 0))
    track.offset = np.append(track.offset, start + np.cumsum(sizes) - sizes)
    track.size = np.append(track.size, sizes)
    if not own.get("fixed", True):
        track.duration += int(lengths.sum())


def _decode(data: bytes, track: Track, own: dict) -> None:
    at = own[b"mdhd"][0]
    track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    track.handler = data[own[b"hdlr"][0] + 8 : own[b"hdlr"][0] + 12].decode("latin-1")
    track.codec = data[own[b"stsd"][0] + 12 : own[b"stsd"][0] + 16].decode("latin-1")
    own["fixed"] = bool(track.duration)  # a file of fragments may leave its duration open
    if b"stz2" in own:
        at = own[b"stz2"][0]
        width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if width == 4:
            halves = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            track.size = np.stack([halves >> 4, halves & 15], 1).ravel()[:n].astype(np.int64)
        else:
            track.size = np.frombuffer(data, {8: ">u1", 16: ">u2"}[width], n, at + 12).astype(np.int64)
    else:
        fixed, n = struct.unpack_from(">II", data, own[b"stsz"][0] + 4)
        track.size = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, own[b"stsz"][0] + 12).astype(np.int64)
    offsets = _table(data, own[b"co64"][0], ">u8", 1)[:, 0] if b"co64" in own else _table(data, own[b"stco"][0], ">u4", 1)[:, 0]
    runs = _table(data, own[b"stsc"][0], ">u4", 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(offsets) + 1)))
    if len(per_chunk) != len(offsets) or per_chunk.sum() != n or _table(data, own[b"stts"][0], ">u4", 2)[:, 0].sum() != n:
        raise ValueError("sample tables disagree")
    before = np.cumsum(track.size) - track.size
    first = np.cumsum(per_chunk) - per_chunk
    chunk = np.repeat(np.arange(len(offsets)), per_chunk)
    track.offset = offsets[chunk] + before - before[first][chunk]
    track.sync = _table(data, own[b"stss"][0], ">u4", 1)[:, 0] - 1 if b"stss" in own else np.arange(n)


def payload(data: bytes, track: Track) -> bytes:
    """The track's samples in order; neighbouring ranges are read at once."""
    if not len(track.offset):
        return b""
    ends = track.offset + track.size
    cut = np.flatnonzero(track.offset[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(track.offset[np.append(0, cut)].tolist(), ends[np.append(cut - 1, len(ends) - 1)].tolist()))


def feature(track: Track) -> str:
    """Codec, duration, sample count and sync byte ranges (their number, first and last, and a CRC over all)."""
    marks = track.ranges()
    crc = zlib.crc32(",".join(f"{a}+{n}" for a, n in marks).encode())
    return f"codec={track.codec.strip()};seconds={track.seconds:.6f};samples={len(track.size)};sync={len(marks)};first={marks[0][0]}+{marks[0][1]};last={marks[-1][0]}+{marks[-1][1]};ranges={crc:08x}" if marks else f"codec={track.codec.strip()};seconds={track.seconds:.6f};samples=0;sync=0"


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as one media file.  Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(STORED)
        for b in batches:
            for doc_id, data in zip(b["doc_id"].to_pylist(), utf8(b["text"])):
                yield from out.add((doc_id, len(data), encode(pad(data))), len(data))
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


INDEX = "media_bytes long, media_sha256 string, codec string, seconds double, n_samples long, sync array<struct<offset:bigint,size:bigint>>, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"


def read_back(media: DataFrame) -> DataFrame:
    """For each stored file the columns of INDEX after doc_id and n_bytes.  A null file gives nulls; a broken one gives
    its size and digest, nulls, and the reason as ``error``."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for b in batches:
            for doc_id, n, data in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist()):
                if data is None:
                    yield from out.add((doc_id, n, *[None] * len(names)))
                    continue
                head = (doc_id, n, len(data), hashlib.sha256(data).hexdigest())
                try:
                    found = index(data)
                except ValueError as e:
                    yield from out.add((*head, *[None] * (len(names) - 3), str(e)))
                    continue
                track = found[0] if found else Track()
                back = payload(data, track)
                sync = [{"offset": a, "size": k} for a, k in track.ranges()]
                yield from out.add((*head, track.codec.strip(), track.seconds, len(track.size), sync, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), feature(track), None), 400 + 16 * len(sync))
        yield from out.flush()

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, {INDEX}")


def media_columns(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, codec, seconds, n_samples, sync (byte ranges of the sync samples), error.  Equal texts
    give equal values; a null text is the empty text (64 zero bytes); null ids stay null; only doc_id and text
    are read; an empty table gives an empty table."""
    return read_back(store(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "n_samples", "sync", "error")
