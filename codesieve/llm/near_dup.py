"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document's elements are its distinct runs of five words, weighted by 1 + ln(count), ``HEAVIEST`` at most. ProbMinHash
lets each element arrive as a Poisson process of its weight's rate, each arrival at a random register; a register
keeps its first arrival, and elements stop as soon as their next arrival is later than all registers'. Two
documents agree in a register with the probability Jaccard similarity of their weighted elements.

The measure that links are verified by is the similarity of the sets of elements. Bounded weights keep the sampled
measure near it: of sets with similarity 0.8 the probability Jaccard similarity is 0.8 without repeats and never below
0.64 (half of the shared elements repeated in one document only, the others in the other, and all that differ
repeated), so their documents share a band with a chance of 0.9999 as a rule and 0.94 at least.

Equal texts are one representative from here on. Registers are hashed in bands; all (band, representative)
rows are sorted over ranges of both, so that a band of any size is spread over many tasks, and each
representative is linked to the first one of its band in its range, ranges by their seams. Connected
components of these links are candidate clusters. Links of Jaccard similarity ``LEAST`` or more of the sets
of elements make the classes; they are found exactly, in blocks of at most ``BLOCK`` documents and
``BLOCK_CHARS`` characters, one group each, of which only spanning links leave the tasks:

1. Each block compares all its pairs, and its documents with ``HUBS`` documents of its cluster.
2. In clusters of several blocks, documents that are not yet in the largest class of their cluster are
   compared with all others of it. So a cluster of near copies takes time in proportion to its size.

Edge cases: a null text is an empty one; texts of fewer than five words have their whole words as one
element; equal texts are one class, empty ones too, and an empty text is in no class with others; a row
with a null id has a null class and is kept. A class belongs to a row's text: rows that repeat an id with
other texts may be in other classes (texts with the same smallest id share one), and ``keep_one_of_each``
keeps the row of each class whose id is its smallest, once. Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import LARGE_BLOCK_BYTES, Words, blocks, checkpointed, list_array, mix, partitions, released, separators
from codesieve.llm.components import by_key, components

SHINGLE, LEAST = 5, 0.8
#: Of pairs at the least similarity 1 in 30,000 shares no band, or 1 in 18 at worst, where repeats differ.
BANDS, ROWS = 26, 5
#: The largest weight of an element.
HEAVIEST = 1.5
BLOCK, BLOCK_CHARS, HUBS = 512, 4_000_000, 4

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_PARTS = separators(frozenset(range(256)) - _WORD_BYTES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROUND, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of a block of texts, by text and element."""
    words = Words(_LOWER[data], offsets, _PARTS)
    hashes = words.hashes()
    grams, at = words.grams(hashes, SHINGLE)
    text = words.text[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        whole = np.array([mix(np.bitwise_xor.reduce(mix(hashes[words.first[i] : words.first[i + 1]] + _ROUND * np.arange(1, words.counts[i] + 1, dtype=np.uint64)), keepdims=True))[0] for i in short.tolist()], np.uint64)
        grams, text = np.concatenate([grams, whole]), np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return text[first], grams[first], np.diff(np.append(first, len(grams)))


def prob_min_hash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The element that arrives first at each register, for each of ``n`` texts; 0 for texts without elements."""
    arrival = np.full(n * registers, np.inf)
    signature = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(element))
    k = 0
    while len(element):
        k += 1
        draw = mix(element + np.uint64((int(_ROUND) * k) & (2**64 - 1)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        place = text * registers + (mix(draw ^ _PLACE) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, place, time)
        first = arrival[place] == time
        signature[place[first]] = element[first]
        latest = arrival.reshape(n, registers).max(1)
        on = time < latest[text]
        text, element, weight, time = text[on], element[on], weight[on], time[on]
    return signature.reshape(n, registers)


def sketches(docs: DataFrame) -> DataFrame:
    """(id, key, chars, bands) of (id, text): a digest of the text itself, its length and the hashes of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(3), LARGE_BLOCK_BYTES):
                text, element, count = elements(data, offsets)
                signature = prob_min_hash(text, element, np.minimum(1 + np.log(count), HEAVIEST), hi - lo, BANDS * ROWS).reshape(hi - lo, BANDS, ROWS)
                bands = np.broadcast_to(salt, (hi - lo, BANDS))
                for r in range(ROWS):
                    bands = mix(bands * _ROUND + signature[:, :, r])
                filled = np.zeros(hi - lo, bool)
                filled[text] = True
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in range(3)), list_array(bands[filled].ravel().view(np.int64), filled * BANDS)], names=["id", "key", "chars", "bands"])

    return docs.select("id", text_key("text").alias("key"), F.length("text").cast("long").alias("chars"), "text").mapInArrow(released(run), "id bigint, key binary, chars bigint, bands array<bigint>")


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def band_links(reps: DataFrame) -> DataFrame:
    """(u, v): every representative and the first one of its band in the same range, and the links of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead = None, None  # the band at hand and its first representative here
        for batch in batches:
            band, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(band):
                continue
            new = np.append(last is None or band[0] != last, band[1:] != band[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
            leads = np.where(first < 0, -1 if lead is None else lead, rep[first])
            linked = ~new & (rep != leads)
            if last is None:
                yield pa.RecordBatch.from_arrays([pa.array(rep[:1]), pa.nulls(1, pa.int64()), pa.array(band[:1])], names=["u", "v", "band"])
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(leads[linked]), pa.nulls(int(linked.sum()), pa.int64())], names=["u", "v", "band"])
            last, lead = band[-1], leads[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lead], pa.int64()), pa.nulls(1, pa.int64()), pa.array([last], pa.int64())], names=["u", "v", "band"])

    bands = reps.select(F.explode("bands").alias("band"), "rep")
    found = checkpointed(bands.repartitionByRange(partitions(reps.sparkSession), "band", "rep").sortWithinPartitions("band", "rep").mapInArrow(released(run), "u bigint, v bigint, band bigint"))
    seams = found.where("v IS NULL").groupBy("band").agg(F.min("u").alias("v"), F.collect_set("u").alias("us"))  # two rows of each range
    return found.where("v IS NOT NULL").select("u", "v").unionByName(seams.select(F.explode("us").alias("u"), "v").where("u <> v")).distinct()


def _spanning(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of similarity ``LEAST`` among sets of elements."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    sizes = np.bincount(owner, minlength=n)
    used, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often[place] > 1
    number = np.cumsum(often > 1) - 1
    width = (int((often > 1).sum()) + 63) // 64
    bits = np.zeros((n, width), np.uint64)
    spot = number[place[common]]
    np.bitwise_or.at(bits, (owner[common], spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
    root = np.arange(n)
    apart = n
    for a in range(n - 1):
        if apart == 1:
            break
        both = np.bitwise_count(bits[a] & bits[a + 1 :]).sum(1, dtype=np.int64)
        for b in (a + 1 + np.flatnonzero(both >= LEAST * (sizes[a] + sizes[a + 1 :] - both) - 1e-9)).tolist():
            x, y = root[a], root[b]
            if x != y:
                root[root == max(x, y)] = min(x, y)
                apart -= 1
    least = {}
    for i in range(n):
        least[root[i]] = min(least.get(root[i], ids[i]), ids[i])
    return [(int(ids[i]), int(least[root[i]])) for i in range(n) if ids[i] != least[root[i]]]


def _compared(texts: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """(u, v): links that span the pairs of similarity ``LEAST`` in each group of ``places`` (node, key, root, i, j); ``texts`` has (id, key, text)."""
    placed = texts.join(places.withColumnRenamed("node", "id"), ["id", "key"]).select("root", "i", "j", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        ids: list[int] = []
        sets: list[np.ndarray] = []
        u: list[int] = []
        v: list[int] = []

        def close() -> None:
            if len(set(ids)) > 1:
                for x, y in _spanning(np.array(ids), sets):
                    u.append(x)
                    v.append(y)
            ids.clear()
            sets.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            own = batch.column(3).to_pylist()
            for lo, hi, data, offsets in blocks(batch.column(4)):
                text, element, _ = elements(data, offsets)
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
                for t in range(hi - lo):
                    if keys[lo + t] != group:
                        close()
                        group = keys[lo + t]
                    ids.append(own[lo + t])
                    sets.append(element[bounds[t] : bounds[t + 1]])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return placed.repartition(buckets, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(released(run), "u bigint, v bigint")


def _blocks_of(chars: str) -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(chars) / BLOCK_CHARS), F.lit(1)).cast("int")


def verified_links(docs: DataFrame, members: DataFrame, buckets: int) -> DataFrame:
    """(u, v): links that span all pairs of similarity ``LEAST`` or more within each cluster of ``members`` (node, key, chars, root)."""
    sizes = members.groupBy("root").agg(_blocks_of("chars").alias("cut"))
    placed = checkpointed(by_key(members, sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")))
    # The texts of members, few of all, are written once for all comparisons.
    texts = checkpointed(docs.select("id", text_key("text").alias("key"), "text").join(members.select(F.col("node").alias("id"), "key"), ["id", "key"]))
    single = placed.select("node", "key", "root", F.col("own").alias("i"), F.col("own").alias("j"))
    several = placed.where("cut > 1")
    if several.isEmpty():
        return _compared(texts, single, buckets)
    order = F.xxhash64("node", F.lit(1))
    hubs = several.groupBy("root", F.pmod(order, F.lit(HUBS)).alias("slot")).agg(F.min_by(F.struct("node", "key", "cut", "own"), order).alias("hub")).select("root", "hub.*")
    every = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    hubs = hubs.withColumn("i", every).where("i <> own").select("node", "key", "root", "i", F.col("i").alias("j"))
    found = checkpointed(_compared(texts, single.unionByName(hubs), buckets))
    classes = components(found)
    judged = several.join(classes.select("node", F.col("root").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    largest = judged.groupBy("root", "class").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("main"))
    judged = checkpointed(by_key(judged, largest, "root"))
    loose = judged.where("class <> main")
    chunks = loose.groupBy("root").agg(_blocks_of("chars").alias("chunks"))
    loose = by_key(loose, chunks, "root")
    pieces = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    asked = by_key(judged, chunks, "root").withColumn("j", pieces).select("node", "key", "root", F.col("own").alias("i"), "j")
    asking = loose.withColumn("i", every).select("node", "key", "root", "i", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int").alias("j"))
    return found.unionByName(_compared(texts, asked.unionByName(asking), buckets))


def _classes(rows: DataFrame) -> DataFrame:
    """(id, key, class_id) of the rows (id, text) with an id."""
    sketched = checkpointed(sketches(rows))
    reps = sketched.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("chars").alias("chars"), F.count("*").alias("n"))
    clusters = components(band_links(reps))
    members = reps.select(F.col("rep").alias("node"), "key", "chars").join(clusters, "node")
    links = components(verified_links(rows, members, partitions(rows.sparkSession)))
    copied = reps.where("n > 1").select(F.concat("key", F.lit(b"-")).alias("k"), "rep")  # few texts have copies: the others stand for themselves
    named = sketched.select("id", "key", F.concat("key", F.lit(b"-")).alias("k")).join(copied, "k", "left").select("id", "key", F.coalesce("rep", "id").alias("rep"))
    return named.join(links, F.col("rep") == F.col("node"), "left").select("id", "key", F.coalesce("root", "rep").alias("class_id"))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))


def duplicate_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, class_id): the smallest id of each document's class."""
    rows = _rows(docs, id_column, text_column)
    unknown = rows.where("id IS NULL").select("id", F.col("id").alias("class_id"))
    return _classes(rows.where("id IS NOT NULL")).select("id", "class_id").unionByName(unknown).withColumnRenamed("id", id_column)


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without those that have one of a smaller id in their class; of equal rows one stays."""
    classes = checkpointed(_classes(_rows(docs, id_column, text_column).where("id IS NOT NULL")))
    own, key = F.col(id_column).cast("long").alias("_id"), text_key(text_column).alias("_key")
    keyed = docs.select("*", own, key)
    gone = classes.where("id <> class_id").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    again = classes.where("id = class_id").groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return keyed.join(gone, ["_id", "_key"], "left_anti").select(docs.columns)
    once = keyed.join(again, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return keyed.join(gone.unionByName(again), ["_id", "_key"], "left_anti").unionByName(once).select(docs.columns)
