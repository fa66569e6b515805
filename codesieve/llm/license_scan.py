"""License scans: an exact set-similarity join of text blocks and license templates.

A template's blocks are all runs of consecutive words that are longer than it by the threshold's share, so
that line breaks, comment marks and some words between make no difference. Tokens are ordered by the number of
documents that have them, rarest first. A block can only reach the containment threshold of a template if it
has a token of the template's prefix (prefix filter), enough of the template's tokens (length filter) and no
more than those before its first one are missing (positional filter); candidates come from one inverted index of
all prefixes, and what is left is verified exactly, in one walk over the template's words near those of its prefix. Templates are a parameter of bounded size
(``MAX_TEMPLATE_TOKENS``), so they go to the tasks and texts are never shuffled.

Base phrases are exact runs of words and are found beside the join, which adds labels of its own.

Edge cases: a null text is an empty one (no words, null places, no labels, score 0); a text
shorter than a block is one; repeated rows give repeated results; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import Words, blocks, released, separators

THRESHOLD = 0.8
MAX_TEMPLATE_TOKENS = 1 << 16

# Phrases that must be labelled, and public license notices by label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_PARTS = separators(frozenset(range(256)) - _WORD_BYTES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: str) -> list[str]:
    """The words of a short text, in the same way as those of the documents."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(_LOWER[data], np.array([0, len(data)]), _PARTS)
    return [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]


class Vocabulary:
    """The words that matter, found by their hashes."""

    def __init__(self, names: list[str]):
        raw = " ".join(names).encode()
        data = np.frombuffer(raw, np.uint8)
        hashes = Words(data, np.array([0, len(data)]), separators(b" ")).hashes() if names else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order

    def ids_of(self, words: Words) -> np.ndarray:
        """For each word its number in the vocabulary, or -1."""
        if not len(self.hashes):
            return np.full(len(words.starts), -1)
        wanted = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, self.ids[at], -1)


def token_frequencies(docs: DataFrame, names: list[str], text_column: str = "text") -> dict[str, int]:
    """In how many documents each of the names occurs."""
    vocabulary = Vocabulary(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                words = Words(_LOWER[data], offsets, _PARTS)
                ids = vocabulary.ids_of(words)
                at = np.flatnonzero(ids >= 0)
                pairs = np.unique(words.text[at] * len(names) + ids[at])
                total += np.bincount(pairs % len(names), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(total)], names=["token", "n"])

    counts = docs.select(F.coalesce(text_column, F.lit("")).alias("t")).mapInArrow(released(run), "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {names[row.token]: row.n for row in counts.collect()}  # one row for each template token


class Template:
    """A template's tokens in the global order, with the number that must be met and the length of its blocks."""

    def __init__(self, label: str, words: list[str], rank: dict[str, int], threshold: float):
        self.label, self.width = label, math.ceil(len(words) / threshold - 1e-9)
        self.ranks = np.array(sorted({rank[w] for w in words}))
        self.tokens, self.least = len(self.ranks), max(1, math.ceil(threshold * len(self.ranks) - 1e-9))

    @property
    def prefix(self) -> np.ndarray:
        """The rarest tokens: a block with enough of the template's tokens has one of these."""
        return self.ranks[: self.tokens - self.least + 1]

    def matches(self, text: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, float]]:
        """(text, containment) of the best block of each text that reaches the threshold, from words near the prefix in reading order."""
        place = np.minimum(np.searchsorted(self.ranks, ids), self.tokens - 1)
        own = np.flatnonzero(self.ranks[place] == ids)
        text, at, place = text[own], at[own], place[own]
        spot = at + text * self.width  # blocks do not reach from text to text
        cuts = np.flatnonzero((np.diff(spot) >= self.width) | (np.diff(text) > 0)) + 1
        begin, end = np.append(0, cuts), np.append(cuts, len(spot))
        best: dict[int, int] = {}
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a < self.least:
                continue
            places = place[a:b].tolist()
            if len(set(places)) < self.least:
                continue
            spots, counts, lo, most = spot[a:b].tolist(), [0] * self.tokens, 0, 0
            distinct = 0
            for hi, p in enumerate(places):
                distinct += not counts[p]
                counts[p] += 1
                while spots[hi] - spots[lo] >= self.width:
                    counts[places[lo]] -= 1
                    distinct -= not counts[places[lo]]
                    lo += 1
                most = max(most, distinct)
            if most >= self.least:
                best[int(text[a])] = max(most, best.get(int(text[a]), 0))
        for t, most in best.items():
            yield t, most / self.tokens


class Index:
    """An inverted index of all templates' prefixes: which templates a token can begin a match of.

    A text meets only the templates that it has a prefix token of, and of those only the words within a block's
    length of such a token, so neither time nor memory grows with templates times tokens.
    """

    def __init__(self, templates: list[Template], size: int):
        self.templates = templates
        tokens = np.concatenate([np.zeros(0, np.int64), *(t.prefix for t in templates)])
        owner = np.repeat(np.arange(len(templates)), [len(t.prefix) for t in templates])
        self.owner = owner[np.argsort(tokens, kind="stable")]
        self.start = np.append(0, np.cumsum(np.bincount(tokens, minlength=size)))

    def matches(self, text: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(text, label, containment) of every template that reaches the threshold in a text; words are given in reading order."""
        counts = self.start[ids + 1] - self.start[ids]
        head = np.repeat(np.arange(len(ids)), counts)
        owner = self.owner[np.arange(len(head)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.start[ids], counts)]
        order = np.argsort(owner, kind="stable")
        head, owner = head[order], owner[order]
        for group in np.split(np.arange(len(head)), np.flatnonzero(np.diff(owner)) + 1) if len(head) else ():
            template, own = self.templates[owner[group[0]]], head[group]
            first = np.maximum(np.searchsorted(at, at[own] - template.width + 1), np.searchsorted(text, text[own]))
            last = np.minimum(np.searchsorted(at, at[own] + template.width), np.searchsorted(text, text[own], "right"))
            first = np.maximum(first, np.append(0, last[:-1]))  # each word once
            sizes = np.maximum(last - first, 0)
            near = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
            for t, share in template.matches(text[near], at[near], ids[near]):
                yield t, template.label, share


def ordered_tokens(templates: list[tuple[str, str]], frequency: dict[str, int]) -> list[str]:
    """All tokens of the templates in the global order."""
    return sorted({w for _, text in templates for w in words_of(text)}, key=lambda w: (frequency.get(w, 0), w))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    ``score`` is the highest containment of a template in a block that reaches the threshold, 1 if a base
    phrase occurs, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    known = sorted({w for _, text in templates for w in words_of(text)})
    if len(known) > MAX_TEMPLATE_TOKENS:
        raise ValueError("too many template tokens to hand to every task")
    order = ordered_tokens(templates, token_frequencies(docs, known, text_column))
    runs = [(p.split(" "), label) for p, label in sorted(phrases.items())]
    names = order + sorted({w for run, _ in runs for w in run} - set(order))
    number = {w: i for i, w in enumerate(names)}
    runs = [([number[w] for w in run], label) for run, label in runs]
    vocabulary = Vocabulary(names)
    index = Index([Template(label, words, number, threshold) for label, words in ((label, words_of(text)) for label, text in templates) if words], len(names))
    source = docs.select(id_column, F.coalesce(text_column, F.lit("")).alias("_text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for lo, hi, data, offsets in blocks(batch.column(1)):
                words = Words(_LOWER[data], offsets, _PARTS)
                ids = vocabulary.ids_of(words)
                base: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in runs:
                    n = max(0, len(ids) - len(phrase) + 1)
                    fits = words.text[:n] == words.text[len(phrase) - 1 :]
                    for k, w in enumerate(phrase):
                        fits &= ids[k : n + k] == w
                    for at in np.flatnonzero(fits).tolist():
                        i = int(words.text[at])
                        base.setdefault(i, []).append((at - int(words.first[i]), label))
                hits = np.flatnonzero(ids >= 0)
                found: dict[int, list[tuple[str, float]]] = {}
                for t, label, share in index.matches(words.text[hits], hits, ids[hits]):
                    found.setdefault(t, []).append((label, share))
                out["n_words"] += words.counts.tolist()
                for i in range(hi - lo):
                    own, more = base.get(i, ()), found.get(i, ())
                    places, labels = [p for p, _ in own], {label for _, label in own}
                    out["n_base"].append(len(places))
                    out["first_word"].append(min(places) if places else None)
                    out["last_word"].append(max(places) if places else None)
                    out["base_labels"].append(",".join(sorted(labels)))
                    out["labels"].append(",".join(sorted(labels | {label for label, _ in more})))
                    out["score"].append(1.0 if places else max((s for _, s in more), default=0.0))
            types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=[id_column, *out])

    return source.mapInArrow(released(run), f"{id_column} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
