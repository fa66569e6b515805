"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over all documents counts in how many of them each ``SEED``-word run of the test items occurs. The
rarest share of an item's runs are its seeds. A second pass joins documents and items on their seeds and
aligns each item with the passage around them; a passage with a seed whose local alignment reaches
``LEAST_SCORE`` of the item's own best score is a leak, word for word, edited or paraphrased. The passage
reaches as far from its seeds as the score lets gaps add up, and all leaks apart from each other are found.

Bounds: items go to the tasks in shards of at most ``SHARD_WORDS`` words, one shard after the other, so the
broadcast stays bounded whatever the benchmark's size. Texts are never shuffled; a document's candidates
stay within its task, so passages that very many documents share meet no hot key.

Edge cases: a null text is an empty one and has no leaks; an item with fewer words than a seed can't leak;
null item texts are left out; repeated items are found each; repeated rows give repeated results; empty
tables give empty results; columns of other names pass through ``with_leaks`` unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import Words, blocks, released, separators

SEED, RARE_SHARE, LEAST_SCORE = 3, 0.75, 0.55
MATCH, MISMATCH, GAP = 2, -1, -1
SHARD_WORDS = 2_000_000

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_PARTS = separators(frozenset(range(256)) - _WORD_BYTES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAK = "array<struct<item:string,score:double,first_word:long,last_word:long,start:long,end:long>>"
_LEAK_TYPE = pa.list_(pa.struct([("item", pa.string()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


class Items:
    """The words and seed runs of some test items."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        raw = [x.encode() for x in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        words = Words(_LOWER[data], np.cumsum([0, *map(len, raw)]), _PARTS)
        hashes = words.hashes()
        self.words = np.split(hashes, words.first[1:-1])
        grams, at = words.grams(hashes, SEED)
        self.grams, place = np.unique(grams, return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.item, self.offset = words.text[at][order], (at - words.first[words.text[at]])[order]
        self.bounds = np.searchsorted(place[order], np.arange(len(self.grams) + 1))
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of a block at which a run of the items starts, and the number of the run."""
        grams, at = words.grams(hashes, SEED)
        some = np.flatnonzero(self.flags[(grams >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, grams[some]), len(self.grams) - 1)
        same = self.grams[place] == grams[some]
        return at[some[same]], place[same]

    def keep(self, rare: np.ndarray) -> None:
        """Drop all occurrences that aren't seeds; ``rare`` has a flag for each."""
        run = np.repeat(np.arange(len(self.grams)), np.diff(self.bounds))[rare]
        self.item, self.offset = self.item[rare], self.offset[rare]
        used = np.unique(run)
        self.grams, self.bounds = self.grams[used], np.append(np.searchsorted(run, used), len(run))
        self.flags[:] = False
        self.flags[(self.grams >> np.uint64(44)).astype(np.int64)] = True


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the place after its last word in the passage."""
    steps = -GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        new = np.maximum(np.maximum.accumulate(new + steps) - steps, 0)
        top = int(new.argmax())
        if new[top] > best:
            best, end = int(new[top]), top
        row = new
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Share of the item's best possible score, and the aligned words of the passage (end exclusive)."""
    best, end = _best(item, passage)
    if not best:
        return 0.0, 0, 0
    _, back = _best(item[::-1], passage[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def passages(item: np.ndarray, passage: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """Alignments that reach the score, in order: the best one, then those in what lies before and after it."""
    out, todo = [], [(0, len(passage))]
    while todo:
        a, b = todo.pop()
        if np.isin(item, passage[a:b]).sum() < math.ceil(least * len(item) - 1e-9):
            continue
        score, first, last = align(item, passage[a:b])
        if score >= least:
            out.append((score, a + first, a + last))
            todo += [(a, a + first), (a + last, b)]
    return sorted(out, key=lambda x: x[1])


def _leaks(items: Items, words: Words, hashes: np.ndarray, least: float) -> dict[int, list[dict]]:
    """The leaks in a block of texts, by text."""
    at, run = items.hits(words, hashes)
    counts = items.bounds[run + 1] - items.bounds[run]
    seed = np.repeat(items.bounds[run] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    at = np.repeat(at, counts)
    text, item, begin = words.text[at], items.item[seed], at - items.offset[seed]
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    out: dict[int, list[dict]] = {}
    lo = 0
    while lo < len(text):
        t, i = int(text[lo]), int(item[lo])
        wanted = items.words[i]
        slack = int(MATCH * len(wanted) * (1 - least) / -GAP + 1e-9)  # all gaps that an alignment of this score can have
        hi = lo + 1
        while hi < len(text) and text[hi] == t and item[hi] == i and begin[hi] - begin[hi - 1] <= len(wanted) + 2 * slack:  # their passages touch
            hi += 1
        a = max(int(words.first[t]), int(begin[lo]) - slack)
        b = min(int(words.first[t + 1]), int(begin[hi - 1]) + len(wanted) + slack)
        for score, first, last in passages(wanted, hashes[a:b], least):
            base, last = int(words.first[t]), last - 1
            raw = words.data[words.offsets[t] :]
            start, end = int(words.starts[a + first] - words.offsets[t]), int(words.ends[a + last] - words.offsets[t])
            chars = lambda n, raw=raw: len(raw[:n].tobytes().decode())
            out.setdefault(t, []).append({"item": items.ids[i], "score": score, "first_word": a + first - base, "last_word": a + last - base, "start": chars(start), "end": chars(end)})
        lo = hi
    return out


def _frequencies(texts: DataFrame, items: Items) -> np.ndarray:
    """In how many texts each run occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.grams), np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                words = Words(_LOWER[data], offsets, _PARTS)
                at, found = items.hits(words, words.hashes())
                pairs = np.unique(words.text[at] * len(total) + found)
                total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["run", "n"])

    rows = texts.mapInArrow(released(run), "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each run of the shard
    out = np.zeros(len(items.grams), np.int64)
    out[rows.column("run").to_numpy()] = rows.column("n").to_numpy()
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", into: str = "leaks", item_id: str = "item_id", item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a column of their leaks: item, score, words and code points (end exclusive)."""
    known = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    shards = size // SHARD_WORDS + 1
    names = docs.columns
    out = docs.withColumn(into, F.array().cast(_LEAK))
    texts = docs.select(F.coalesce(text_column, F.lit("")).alias("t"))
    for shard in range(shards):
        part = known if shards == 1 else known.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard)
        rows = sorted((r.id or "", r.text) for r in part.collect())
        items = Items([r[0] for r in rows], [r[1] for r in rows])
        if not len(items.grams):
            continue
        often = np.repeat(_frequencies(texts, items), np.diff(items.bounds))
        order = np.lexsort((items.offset, often, items.item))
        begin = np.searchsorted(items.item[order], np.arange(len(rows) + 1))
        rank = np.arange(len(order)) - begin[items.item[order]]
        rare = np.zeros(len(order), bool)
        rare[order] = rank < np.ceil(RARE_SHARE * np.diff(begin))[items.item[order]]
        items.keep(rare)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.column(len(names)).to_pylist()
                for lo, _, data, offsets in blocks(batch.column(names.index(text_column))):
                    words = Words(_LOWER[data], offsets, _PARTS)
                    for t, found in _leaks(items, words, words.hashes(), least).items():
                        before[lo + t] = before[lo + t] + found
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(before, _LEAK_TYPE)], names=[*names, into])

        out = out.mapInArrow(released(run), out.schema)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id") -> DataFrame:
    """(id, item id, score, first_word, last_word, start, end): one row for each leaked passage."""
    kind = benchmark.schema[item_id].dataType
    rows = with_leaks(docs.select(id_column, text_column), benchmark, text_column, "leaks", item_id)
    return rows.select(id_column, F.explode("leaks").alias("x")).select(id_column, F.col("x.item").cast(kind).alias(item_id), "x.score", "x.first_word", "x.last_word", "x.start", "x.end")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents without any leak."""
    return with_leaks(docs, benchmark, text_column, "_leaks").where(F.size("_leaks") == 0).drop("_leaks")
