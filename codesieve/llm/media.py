"""Media columns from ISO base media containers.

``read_media`` walks the nested boxes, decodes the sample tables and stores codec, size, duration and the
byte ranges of the keyframes of every track with samples; payloads are never decoded. ``wrap_payload`` writes such a container around
bytes: a track of raw 8-bit grey frames of 8 x 8 samples, 64 bytes each, a keyframe every ``GROUP`` frames.

Edge cases: a null text is an empty one, whose payload is one frame of zeros; a null, cut-off or foreign
container has no tracks, and null digests; so has one whose tables say what its bytes cannot hold (counts,
places, nesting beyond ``DEPTH``), which are checked before any memory is taken for them; sizes are null for
tracks without pictures; samples of movie fragments are not in the tables and not read; equal bytes give equal
results; empty tables give empty results; other columns are not read. Rows are independent; a container is
held whole by one task only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import released, slices

FRAME, GROUP, CHUNK_FRAMES, RATE = 64, 32, 256, 25

# The boxes of the format that hold other boxes, how deep they may nest here, and its unity matrix.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"))
DEPTH = 16
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def wrap_payload(payload: bytes) -> bytes:
    """A container whose one video track stores ``payload`` (a positive multiple of 64 bytes) as it is."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    rest = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1), (chunks, rest, 1)] if chunks > 1 and rest != CHUNK_FRAMES else [(1, min(frames, CHUNK_FRAMES), 1)]
    keys = np.arange(1, frames + 1, GROUP, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def moov(offsets: np.ndarray, wide: bool) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *x) for x in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3), media)
        header = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", header, track)

    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp41")
    at = np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK_FRAMES * FRAME)
    wide = len(payload) > 0xF0000000
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    start = len(head) + len(moov(at, wide)) + len(data)
    return b"".join((head, moov(at + np.uint64(start), wide), data, payload))


def walk(data: memoryview, lo: int, hi: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of every box's body between ``lo`` and ``hi``, containers before what they hold."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(lo, hi, ())]
    while todo:
        lo, hi, path = todo.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1 and lo + 16 <= hi:
            size, body = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end > hi or end < body:
            raise ValueError("a box reaches beyond what holds it")
        todo.append((end, hi, path))
        yield (*path, kind), body, end
        if kind in CONTAINERS:
            if len(path) == DEPTH:
                raise ValueError("boxes nest too deep")
            todo.append((body, end, (*path, kind)))


class Track:
    """A track's sample tables."""

    def __init__(self, data: memoryview, found: dict[bytes, tuple[int, int]]):
        def numbers(kind: bytes, skip: int, n: int, form: str = ">u4") -> np.ndarray:
            lo, hi = found[kind]
            if n * np.dtype(form).itemsize > hi - lo - skip:
                raise ValueError("a table is longer than its box")
            return np.frombuffer(data, form, n, lo + skip).astype(np.int64)

        def count(kind: bytes, skip: int = 4) -> int:
            return int(numbers(kind, skip, 1)[0])

        entry = found[b"stsd"][0] + 8
        self.codec = bytes(data[entry + 4 : entry + 8]).decode("latin-1")
        pictures = b"hdlr" not in found or data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12] == b"vide"
        self.width, self.height = struct.unpack_from(">HH", data, entry + 32) if pictures else (None, None)
        self.timescale = count(b"mdhd", 20 if data[found[b"mdhd"][0]] == 1 else 12)
        times = numbers(b"stts", 8, 2 * count(b"stts")).reshape(-1, 2)
        self.duration = sum(a * b for a, b in times.tolist())
        self.sizes = self._sizes(data, found, numbers, count)
        n = len(self.sizes)
        kind, form = (b"co64", ">u8") if b"co64" in found else (b"stco", ">u4")
        chunks = numbers(kind, 8, count(kind), form)
        runs = numbers(b"stsc", 8, 3 * count(b"stsc")).reshape(-1, 3)
        each = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if (each < 0).any() or (len(runs) and runs[0, 0] != 1) or sum(a * b for a, b in zip(each.tolist(), runs[:, 1].tolist(), strict=True)) != n:
            raise ValueError("the chunks do not hold the samples")
        per_chunk = np.repeat(runs[:, 1], each)
        chunk = np.repeat(np.arange(len(chunks)), per_chunk)
        before = np.cumsum(self.sizes) - self.sizes
        first = np.minimum(np.cumsum(per_chunk) - per_chunk, max(0, n - 1))  # a chunk may be empty
        self.offsets = chunks[chunk] + before - before[first][chunk] if n else np.zeros(0, np.int64)
        self.keys = numbers(b"stss", 8, count(b"stss")) - 1 if b"stss" in found else np.arange(n)
        if n and (self.offsets.min() < 0 or (self.offsets + self.sizes).max() > len(data)) or len(self.keys) and (self.keys.min() < 0 or self.keys.max() >= n):
            raise ValueError("samples lie outside the file")

    @staticmethod
    def _sizes(data: memoryview, found: dict[bytes, tuple[int, int]], numbers, count) -> np.ndarray:
        if b"stsz" in found:
            same, n = count(b"stsz"), count(b"stsz", 8)
            if same and same * n > len(data):
                raise ValueError("the samples are larger than the file")
            return np.full(n, same, np.int64) if same else numbers(b"stsz", 12, n)
        n, bits = count(b"stz2", 8), data[found[b"stz2"][0] + 7]
        if bits == 4:
            pairs = numbers(b"stz2", 12, (n + 1) // 2, "u1")
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        return numbers(b"stz2", 12, n, {8: "u1", 16: ">u2"}[bits])

    def payload(self, media: bytes) -> bytes:
        """The bytes of all samples, neighbours read as one range."""
        ends = self.offsets + self.sizes
        first = np.flatnonzero(np.append(True, self.offsets[1:] != ends[:-1]))
        last = np.append(first[1:] - 1, len(ends) - 1)
        return b"".join(media[a:b] for a, b in zip(self.offsets[first].tolist(), ends[last].tolist(), strict=True))


#: What tables of foreign bytes raise.
FAULTS = (TypeError, ValueError, KeyError, IndexError, OverflowError, struct.error)


def tracks(media: bytes | None) -> list[Track]:
    """The tracks with samples, in order; none if the container can't be read."""
    try:
        data = memoryview(media)
        found: list[dict[bytes, tuple[int, int]]] = []
        for path, lo, hi in walk(data, 0, len(data)):
            if path[-1] == b"trak":
                found.append({})
            elif found and b"trak" in path:
                found[-1][path[-1]] = (lo, hi)
        return [t for t in (Track(data, x) for x in found if b"stbl" in x) if len(t.sizes)]
    except FAULTS:
        return []


_COLUMNS = "codec string, width int, height int, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>"


def read_media(rows: DataFrame, media_column: str = "media", into: str = "tracks") -> DataFrame:
    """Add an array of tracks: codec, width, height, timescale, duration, n_samples and keyframe byte ranges."""
    names = [x.split()[0] for x in _COLUMNS.split(", ")]
    columns = ",".join(x.replace(" ", ":", 1) for x in _COLUMNS.split(", "))

    @F.pandas_udf(f"array<struct<{columns}>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for media in batch:
                values = ((t.codec, t.width, t.height, t.timescale, t.duration, len(t.sizes), [{"offset": a, "length": b} for a, b in zip(t.offsets[t.keys].tolist(), t.sizes[t.keys].tolist(), strict=True)]) for t in tracks(media))
                out.append([dict(zip(names, x, strict=True)) for x in values])
            yield pd.Series(out, dtype=object)

    return rows.withColumn(into, read(media_column))


def text_to_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as UTF-8, padded with zeros to frames, in a container."""

    raw = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    source = docs.select(id_column, raw.alias("_raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                media = [wrap_payload(x + bytes((-len(x)) % FRAME if x else FRAME)) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=[id_column, "n_bytes", "media"])

    return source.mapInArrow(released(run), f"{id_column} {source.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def media_digests(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests of stored media: what is read back by the sample tables, and the keyframes as a feature."""

    source = rows.select(id_column, "n_bytes", "media")
    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for media in part.column(2).to_pylist():
                    found = tracks(media)
                    if not found:
                        out.append((None,) * 6)
                        continue
                    t = found[0]
                    payload = t.payload(media)
                    ranges = np.stack([t.offsets[t.keys], t.sizes[t.keys]], 1)
                    feature = f"codec={t.codec.strip()};size={t.width}x{t.height};duration={t.duration}/{t.timescale};samples={len(t.sizes)};keyframes={len(t.keys)};"
                    if len(ranges):
                        feature += f"first={ranges[0][0]}+{ranges[0][1]};last={ranges[-1][0]}+{ranges[-1][1]};ranges={zlib.crc32(ranges.tobytes()):08x}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *arrays], names=[id_column, "n_bytes", *(x.split()[0] for x in columns.split(", "))])

    return source.mapInArrow(released(run), f"{id_column} {source.schema[0].dataType.simpleString()}, n_bytes long, {columns}")
