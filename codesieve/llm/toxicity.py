"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and word
beginnings (for compounds); features that are clearly commoner in bad documents are chosen first. The
document's is the noisy-or of its sentences, 1 - prod(1 - p); a sentence without any such feature has p = 0, so that long
documents gather no score from their length. The weights are trained from document labels
only, by gradient descent on the noisy-or likelihood; a sentence's own score then shows which ones offend.

Bounds: the model is fitted on at most ``MAX_TRAINING`` labelled rows (those with the smallest hashes of
their ids), of which the driver gets chosen features only (at most ``MAX_FEATURES``); it has ``2 ** FEATURE_BITS`` weights whatever the
input. Scoring is one pass without a shuffle, over whole texts.

Edge cases: a null text is an empty one; a text without words scores 0; a null id is never held out and
never used for training; repeated labels of an id count once, the highest; null labels are ignored; without
labels of both kinds every score is 0; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import Words, blocks, list_array, released, separators, trim

MAX_TRAINING = 12_000
FEATURE_BITS = 20
#: A feature must occur in so many bad documents, so many standard deviations more often than by chance.
LEAST_BAD, LEAST_LIFT, MAX_FEATURES = 4, 4.0, 50_000
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
STEPS, RATE, DECAY, START = 150, 0.1, 1e-5, -3.0

_WORD_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789'") | frozenset(range(128, 256))
_PARTS = separators(frozenset(range(256)) - _WORD_BYTES)
_STOPS = separators(b".!?\n")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(id_column: str) -> Column:
    """Whether a document is kept from training: its id's checksum modulo 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Bags:
    """Sentences of a block of texts, and the features of their words: the word and its beginnings, hashed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(_LOWER[data], offsets, _PARTS)
        whole = self.words.hashes()
        parts = [(np.arange(len(whole)), whole), *self.words.prefixes(PREFIXES)]
        self.features = [(at, (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)) for at, h in parts]
        stops = np.flatnonzero(_STOPS[data])
        place = np.searchsorted(stops, self.words.starts)
        new = np.append(True, (place[1:] != place[:-1]) | (self.words.text[1:] != self.words.text[:-1])) if len(place) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.text = self.words.text[self.first]
        self.sentence = np.cumsum(new) - 1

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """The score of each sentence before the logistic function; without any evidence it is minus infinity."""
        word = np.zeros(len(self.words.starts))
        for at, feature in self.features:
            word[at] += weights[feature]
        evidence = np.add.reduceat(word, self.first) if len(self.first) else np.zeros(0)
        return np.where(evidence > 0, bias + evidence, -np.inf)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _features(sample: DataFrame) -> np.ndarray:
    """The features that are clearly commoner in bad documents, counted over the sample by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in blocks(batch.column(0)):
                bags = Bags(data, offsets)
                pairs = np.unique(np.concatenate([(bags.words.text[at] << FEATURE_BITS) | f for at, f in bags.features]))
                feature, bad = pairs & ((1 << FEATURE_BITS) - 1), label[lo:hi][pairs >> FEATURE_BITS]
                used, at = np.unique(feature, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.bincount(at, bad, len(used)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(used)).astype(np.int64))], names=["feature", "bad", "n"])

    total, bad = sample.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    share = (bad or 0) / max(1, total)
    counts = sample.select("_text", F.col("_label").cast("int")).mapInArrow(released(run), "feature int, bad long, n long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    lift = (F.col("bad") - share * F.col("n")) / F.sqrt(F.lit(max(1e-9, share)) * F.col("n"))
    found = counts.where((F.col("bad") >= LEAST_BAD) & (lift >= LEAST_LIFT)).orderBy(lift.desc(), "feature").limit(MAX_FEATURES)
    return np.sort(found.select("feature").toArrow().column(0).to_numpy().astype(np.int64))


def _bags(sample: DataFrame, used: np.ndarray, id_column: str) -> pa.Table:
    """For each sampled document its number of sentences, and (sentence, feature) of the used features."""
    schema = "id string, label int, sentences int, sentence array<int>, feature array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << FEATURE_BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                bags = Bags(data, offsets)
                at = np.concatenate([x[0] for x in bags.features])
                feature = place[np.concatenate([x[1] for x in bags.features])]
                kept = feature >= 0
                at, feature = at[kept], feature[kept]
                order = np.argsort(at, kind="stable")
                at, feature = at[order], feature[order]
                bounds = np.searchsorted(bags.words.text[at], np.arange(hi - lo + 1))
                begin = np.searchsorted(bags.text, np.arange(hi - lo + 1))
                local = bags.sentence[at] - begin[bags.words.text[at]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(np.diff(begin).astype(np.int32)), list_array(local.astype(np.int32), np.diff(bounds)), list_array(feature, np.diff(bounds))],
                    names=["id", "label", "sentences", "sentence", "feature"],
                )

    return sample.select(F.col(id_column).cast("string").alias("id"), F.col("_label").cast("int"), "_text").mapInArrow(released(run), schema).toArrow().sort_by("id")


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = MAX_TRAINING) -> np.ndarray:
    """Weights of the features and, last, the bias."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column)).agg(F.max(label_column).alias("_label")).orderBy(F.xxhash64(id_column), id_column).limit(max_rows)
    sample = docs.select(F.col(id_column), F.coalesce(text_column, F.lit("")).alias("_text")).join(F.broadcast(known), id_column)
    weights = np.zeros((1 << FEATURE_BITS) + 1)
    weights[-1] = -40.0
    used = _features(sample)
    if not len(used):
        return weights
    rows = _bags(sample, used, id_column)
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    label = rows.column("label").to_numpy().astype(bool)
    n = rows.column("sentences").to_numpy().astype(np.int64)
    if not label.any() or label.all():
        return weights
    held = rows.column("feature").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    place, sentence = np.unique(flat("sentence") + np.repeat(np.cumsum(n) - n, held), return_inverse=True)  # sentences with evidence
    feature, doc = flat("feature"), np.searchsorted(np.cumsum(n), place, "right")
    w, bias = np.zeros(len(used)), START
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, w[feature], len(doc))
        total = np.bincount(doc, _softplus(z), len(label))
        pull = np.where(label, -np.exp(-total) / np.maximum(1e-9, -np.expm1(-total)), 1.0)
        slope = pull[doc] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(feature, slope[sentence], len(used)), slope.sum()) / len(label)
        gradient[:-1] += DECAY * w
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w = np.maximum(0, w - move[:-1])  # a feature can only speak against a sentence
        bias -= move[-1]
    weights[used] = w
    weights[-1] = bias
    del rows, held, place, sentence, feature, doc, slope, z
    trim()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, predicted, n_sentences, offending): ``offending`` are the places of sentences that reach 0.5, as code points."""
    source = docs.select(id_column, F.coalesce(text_column, F.lit("")).alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    table, bias = weights[:-1].astype(np.float32), float(weights[-1])
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            scores, counts, places = [], [], []
            for lo, hi, data, offsets in blocks(batch.column(1)):
                bags = Bags(data, offsets)
                z = bags.logits(table, bias)
                scores.append(-np.expm1(-np.bincount(bags.text, _softplus(z), hi - lo)))
                counts.append(np.bincount(bags.text, minlength=hi - lo))
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                ends = np.append(bags.first[1:], len(bags.words.starts)) - 1
                for s in np.flatnonzero(z >= 0).tolist():
                    i = int(bags.text[s])
                    a, b = int(bags.words.starts[bags.first[s]]), int(bags.words.ends[ends[s]])
                    start = len(data[offsets[i] : a].tobytes().decode())
                    found[i].append({"start": start, "end": start + len(data[a:b].tobytes().decode())})
                places += found
            value = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[id_column, "score", "predicted", "n_sentences", "offending"],
            )

    return source.mapInArrow(released(run), f"{id_column} {kind}, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long>>")


def drop_toxic(docs: DataFrame, weights: np.ndarray, text_column: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents whose score stays below ``limit``, with all their columns. Needs no shuffle."""
    source = docs.withColumn("_scored", F.coalesce(text_column, F.lit("")))
    table, bias = weights[:-1].astype(np.float32), float(weights[-1])
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                bags = Bags(data, offsets)
                scores = -np.expm1(-np.bincount(bags.text, _softplus(bags.logits(table, bias)), hi - lo))
                yield batch.slice(lo, hi - lo).select(list(range(batch.num_columns - 1))).filter(pa.array(scores < limit))

    return source.mapInArrow(released(run), docs.schema)
