"""What the operators of this subpackage share: tables, checkpoints and whole-batch byte work.

The byte helpers treat the texts of an Arrow batch as one buffer, so that splitting into words and
hashing them are a few numpy passes and never a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from codesieve.sources.corpus import shared_folder, spread

#: Texts worked on together: bounds the memory of the numpy passes. A longer text is worked on alone.
BLOCK_BYTES = 1 << 19
#: The same where a block's work has a fixed cost.
LARGE_BLOCK_BYTES = 1 << 20

#: Rows that Spark hands to a Python worker at once: whole texts are long rows.
ARROW_ROWS = 2000

SPACES = frozenset(b" \t\n\x0b\x0c\r")

_RATIO = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RATIO, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_ROWS`` rows, for less memory beside the heap and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if not 0 < rows <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, through Spark's reader only, so that any store that Spark reads will do."""
    short_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there, safe from lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def trim() -> None:
    """Give back to the system what Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's C library can
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back what memory its batches took: Spark keeps Python workers for later tasks."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _Powers.up = _Powers.down = np.ones(1, np.uint64)
        trim()

    return out


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every bit (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(chars) -> np.ndarray:
    """A table of 256 flags, true at the bytes that part words."""
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


class _Powers:
    """Powers of the hash's ratio and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, ratio in (("up", _RATIO), ("down", _INVERSE)):
                powers = np.full(n, ratio, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))
        return cls.up, cls.down


class Words:
    """The words of several texts: ``starts`` and ``ends`` in ``data``; ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~parts[data]
        before, after = inside[:-2].copy(), inside[2:].copy()
        edges = offsets[:-1][offsets[:-1] < n]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        inside = inside[1:-1]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the weighed bytes, and the powers that take a word's place out of its sum."""
        up, down = _Powers.upto(len(self.data) + 1)
        sums = self.data.astype(np.uint64)
        sums += np.uint64(1)
        sums *= up[: len(sums)]
        return np.cumsum(sums, out=sums), down

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        sums, down = self._sums()
        before = np.where(self.starts > 0, sums[self.starts - 1], 0).astype(np.uint64) if len(self.starts) else np.zeros(0, np.uint64)
        return mix((sums[self.ends - 1] - before) * down[self.starts])

    def prefixes(self, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size the words that are longer, and the hashes of their first bytes."""
        sums, down = self._sums()
        out = []
        for size in sizes:
            longer = np.flatnonzero(self.ends - self.starts > size)
            at = self.starts[longer]
            before = np.where(at > 0, sums[at - 1], 0).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
            out.append((longer, mix((sums[at + size - 1] - before) * down[at] + np.uint64(size))))
        return out

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words within one text, and the index of each run's first word."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        out = hashes[:n].copy()
        for k in range(1, size):
            out *= _STEP
            out += hashes[k : n + k]
        return mix(out[at]), at


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow column of texts (null: empty) into blocks: first row, end row, bytes and offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, limit: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a few rows and of so many bytes in a column (a longer one stands alone), so that only those are Python objects at a time."""
    bounds = np.append(0, np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)))
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column of rows with the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
