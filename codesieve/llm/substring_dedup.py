"""Substring dedup over a whole corpus, and against a bounded reference.

``strip_reference`` is the method by name: suffix automata of bounded reference shards are broadcast, the
documents stream through them for matching statistics, and maximal spans that reach the threshold go.

``repeated_windows`` is what ``dedup_windows`` needs when the reference is the corpus itself (every document
with a smaller id): its automata can neither be broadcast within a bound nor be streamed past every
document in time that grows with the input. Windows meet by key instead, in two rounds:

1. Of each window of ``WINDOW`` words the smallest hash among its ``GRAM``-word runs is its minimizer.
   Equal windows have equal minimizers, and only about one in five windows starts a new one. Each input
   split sends every distinct minimizer once; a minimizer that two documents have is shared.
2. Documents with shared minimizers hash the windows these stand for. Each partition of documents sends
   every distinct window once, with its smallest id; a window is repeated in all documents but the one
   with the smallest id.

Every split pre-aggregates, so a passage that a third of all documents have is one entry for each split, or for
each ``MAX_ENTRIES`` of its entries. Entries travel as arrays bucketed by key. Partitions are as many as the texts
need for ``PART_BYTES`` each, and a task holds one of its buckets at a time, whatever the input.

Edge cases: a null text has no words; a text shorter than a window has nothing removed; equal windows
within one document alone remove nothing; rows with a null id take no part and lose nothing; rows with the
same id are one document for the comparison; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import SPACES, Words, blocks, list_array, mix, partitions, released, separators

WINDOW, GRAM = 13, 5
#: Reference words in an automaton, and words of a reference that may be broadcast.
SHARD_WORDS, MAX_REFERENCE_WORDS = 200_000, 4_000_000

#: Bytes of texts for which there is a partition, its buckets, and entries that a task gathers before it sends them.
PART_BYTES, BUCKETS, MAX_ENTRIES = 1 << 23, 4, 1 << 22

_PARTS = separators(SPACES)
#: In place of a place: an entry that its split knows to be shared, and one that needs no answer.
SHARED, KNOWN = -1, -2
_ENTRY = "bucket int, keys array<bigint>, docs array<bigint>, places array<int>"


def _windows(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and minimizers of all windows of a block of texts."""
    grams, at = words.grams(hashes, GRAM)
    span = WINDOW - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = grams[:n].copy()
    for k in range(1, span):
        np.minimum(low, grams[k : n + k], out=low)
    inside = at[span - 1 :] - at[:n] == span - 1  # grams of one text are neighbours
    inside &= words.text[at[:n]] == words.text[at[span - 1 :]]
    return at[:n][inside], low[inside]


def _bucketed(spread: np.ndarray, keys: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries as one row for each bucket; what ``spread`` has equal comes to one bucket."""
    bucket = (mix(spread.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, counts = np.unique(bucket, return_counts=True)
    arrays = [pa.array(used.astype(np.int32)), *(list_array(x[order], counts) for x in (keys.view(np.int64), docs.astype(np.int64), places.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "keys", "docs", "places"])


def _bucketwise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries of one bucket after the other, each by key and then by document."""
    own, parts = None, []

    def entries() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, docs, places = (np.concatenate([x[k].to_numpy(zero_copy_only=False) for x in parts]) for k in range(3))
        order = np.lexsort((places, docs, keys))
        return keys[order], docs[order], places[order]

    for batch in batches:
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != own and parts:
                yield entries()
                parts = []
            own = bucket
            parts.append([batch.column(k)[i].values for k in (1, 2, 3)])
    if parts:
        yield entries()


def _dealt(sent: DataFrame, parts: int) -> DataFrame:
    """Entries by bucket: Spark sorts them, with disk where memory ends."""
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _group(keys: np.ndarray) -> np.ndarray:
    """For sorted keys the index at which each one's group begins."""
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _answered(answers: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Answers (documents, values) of one bucket after the other as entries, bucketed by document, ``MAX_ENTRIES`` or so at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        docs, values = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return _bucketed(docs, values, docs, np.zeros(len(docs)), buckets)

    for answer in answers:
        held.append(answer)
        if sum(len(docs) for docs, _ in held) >= MAX_ENTRIES:
            yield sent()
    if any(len(docs) for docs, _ in held):
        yield sent()


def _by_document(sent: DataFrame, name: str, parts: int) -> DataFrame:
    """(id, values): one row for each document of what ``sent`` has for it, bucketed by document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, docs, _ in _bucketwise(batches):
            order = np.argsort(docs, kind="stable")
            ids, counts = np.unique(docs[order], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), list_array(values[order], counts)], names=["id", name])

    return _dealt(sent, parts).mapInArrow(released(gather), f"id bigint, {name} array<bigint>")


def shared_minimizers(docs: DataFrame, parts: int) -> DataFrame:
    """(id, minimizers): for each document those that another document has too."""
    buckets = parts * BUCKETS

    def asked(keys: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, doc = np.concatenate(keys), np.concatenate(ids).astype(np.int64)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
        key, doc = key[once], doc[once]
        begin = _group(key)
        first = begin == np.arange(len(key))
        several = np.isin(begin, begin[~first], kind="table") if len(key) else first
        yield _bucketed(key[first], key[first], doc[first], np.where(several[first], SHARED, 0), buckets)
        known = several & ~first  # these need no answer: they go straight to the rows of their documents
        if known.any():
            yield _bucketed(doc[known], key[known], doc[known], np.full(known.sum(), KNOWN), buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, _PARTS)
                at, low = _windows(words, words.hashes())
                text = words.text[at]
                new = np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1])) if len(low) else np.zeros(0, bool)
                keys.append(low[new])
                ids.append(own[lo + text[new]])
                held += len(keys[-1])
                if held >= MAX_ENTRIES:
                    yield from asked(keys, ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield from asked(keys, ids)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for keys, ids, marks in _bucketwise(batches):
            known = marks == KNOWN
            asking, doc, mark = keys[~known], ids[~known], marks[~known]
            begin = _group(asking)
            shared = np.zeros(len(asking), bool)
            if len(asking):
                differs = (doc != doc[begin]) | (mark == SHARED)
                shared = np.isin(begin, begin[differs], kind="table")
            yield np.concatenate([doc[shared], ids[known]]), np.concatenate([asking[shared], keys[known]])

    sent = docs.mapInArrow(released(send), _ENTRY)
    return _by_document(_dealt(sent, parts).mapInArrow(released(lambda batches: _answered(meet(batches), buckets)), _ENTRY), "minimizers", parts)


def repeated_windows(docs: DataFrame, candidates: DataFrame, parts: int) -> DataFrame:
    """(id, starts): first words of the windows of a document that also start in one with a smaller id."""
    buckets = parts * BUCKETS

    def asked(entries: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, doc, place, spread = (np.concatenate(x) for x in zip(*entries, strict=True))
        doc = doc.astype(np.int64)
        order = np.lexsort((place, doc, key))
        key, doc, place, spread = key[order], doc[order], place[order], spread[order]
        smallest = doc == doc[_group(key)] if len(key) else np.zeros(0, bool)
        # all of a window's places in these entries' smallest document need an answer
        yield _bucketed(spread[smallest], key[smallest], doc[smallest], place[smallest], buckets)
        doc, place = doc[~smallest], place[~smallest]
        if len(doc):  # these are repeated: they go as runs of places, below zero, to the rows of their documents
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            first, last = _runs(doc, place)
            yield _bucketed(doc[first], (place[last] - place[first]).astype(np.uint64), doc[first], -1 - place[first], buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, held = [], 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = batch.column(2)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, _PARTS)
                hashes = words.hashes()
                at, low = _windows(words, hashes)
                some = wanted[lo:hi]
                key = mix(some.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) ^ np.repeat(np.arange(hi - lo, dtype=np.uint64), some.value_lengths().to_numpy(zero_copy_only=False))
                kept = np.isin(mix(low) ^ words.text[at].astype(np.uint64), key)
                at = at[kept]
                window, start = words.grams(hashes, WINDOW)
                entries.append((window[np.searchsorted(start, at)], own[lo + words.text[at]], at - words.first[words.text[at]], low[kept]))
                held += len(at)
                if held >= MAX_ENTRIES:
                    yield from asked(entries)
                    entries, held = [], 0
        if entries:
            yield from asked(entries)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for keys, ids, places in _bucketwise(batches):
            known = places < 0
            key, doc, place = keys[~known], ids[~known], places[~known]
            repeated = doc != doc[_group(key)] if len(key) else np.zeros(0, bool)
            doc, place = doc[repeated], place[repeated]
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            first, last = _runs(doc, place)
            start = np.concatenate([place[first], -1 - places[known]]).astype(np.int64)
            end = np.concatenate([place[last], -1 - places[known] + keys[known]]).astype(np.int64)
            yield np.concatenate([doc[first], ids[known]]), (start << 32) | end

    sent = docs.join(candidates, "id").select("id", "text", "minimizers").mapInArrow(released(send), _ENTRY)
    return _by_document(_dealt(sent, parts).mapInArrow(released(lambda batches: _answered(meet(batches), buckets)), _ENTRY), "runs", parts)


def _runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring places, of entries by document and place."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)))
    return first, np.append(first[1:], len(doc)) - 1


def dedup_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): every document without the words that windows of smaller ids cover.

    ``kept`` are the words that stay, joined by one space.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    known = rows.where("id IS NOT NULL")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(partitions(docs.sparkSession), -(-size // PART_BYTES))
    placed = known.repartition(parts, "id")  # one exchange of the texts for both joins
    repeats = repeated_windows(placed, shared_minimizers(known, parts), parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                n_words.append(len(words))
                if runs:
                    gone = np.zeros(len(words) + 1, np.int32)
                    runs = np.array(runs, np.int64)
                    np.add.at(gone, runs >> 32, 1)
                    np.add.at(gone, np.minimum((runs & 0xFFFFFFFF) + WINDOW, len(words)), -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    whole = rows.where("id IS NULL").select("id", "text", F.lit(None).cast("array<bigint>").alias("runs"))
    out = placed.join(repeats, "id", "left").select("id", "text", "runs").unionByName(whole).mapInArrow(released(cut), "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_column)


def digest_kept(kept: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The kept words as a hash."""
    return kept.select(id_column, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


class SuffixAutomaton:
    """The suffix automaton of a sequence of words, for matching statistics."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for word in text:
                last = self._add(last, word)

    def _add(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _state(self, moves: dict[bytes, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest match with the reference that ends there."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            out.append(length)
        return out


def strip_reference(docs: DataFrame, reference: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): the documents without spans of ``threshold`` words of the reference.

    The reference is broadcast in shards of whole texts; one above ``MAX_REFERENCE_WORDS`` words is refused.
    """
    words = F.size(F.filter(F.split(F.coalesce(text_column, F.lit("")), r"[\x20\t-\r]+"), lambda w: w != ""))
    total = reference.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    if total > MAX_REFERENCE_WORDS:
        raise ValueError("the reference is too large to broadcast; use dedup_windows on its union with the documents")
    texts = [row[0].encode().split() for row in reference.where(F.col(text_column).isNotNull()).select(text_column).toLocalIterator()]
    shards, size = [[]], 0
    for text in texts:
        if size + len(text) > SHARD_WORDS and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(text)
        size += len(text)
    shared = docs.sparkSession.sparkContext.broadcast(shards)
    source = docs.select(id_column, F.coalesce(text_column, F.lit("")).alias("_text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [SuffixAutomaton(x) for x in shared.value if x]
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.encode().split()
                gone = [False] * len(words)
                for automaton in automata:
                    for end, length in enumerate(automaton.statistics(words)):
                        if length >= threshold:
                            gone[end + 1 - length : end + 1] = [True] * length
                stay = [w for w, g in zip(words, gone, strict=True) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[id_column, "n_words", "n_removed", "kept"])

    return source.mapInArrow(released(run), f"{id_column} {kind}, n_words bigint, n_removed bigint, kept string")
