"""URL filters on a sorted digest array.

Rules (host, path prefix, verdict) are kept in one file: 64-bit xxhash keys in ascending order, then the
full strings. Spark ships the file to the executors, which memory-map it. For a batch of URLs all
(host suffix, path prefix) candidates whose shape occurs among the rules are hashed and looked up by one
vectorised binary search; a hit counts only if the stored string is the same, so collisions do no harm.

Bound: a rule table above ``MAX_RULE_BYTES`` is refused for shipping and joined instead
(``judge_by_join``), which shuffles candidates but keeps no table on the driver.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; of equal rules
the blocking one holds; repeated rows give repeated results; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.components import by_key

MAX_RULE_BYTES, MAX_SHAPES = 1 << 28, 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple:
    """Columns for a URL's host (A-Z lower-cased) and path, empty where there is none."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER), F.regexp_extract(text, parts, 2)


class DigestIndex:
    """Sorted keys and their strings in one memory-mapped file."""

    def __init__(self, path: str):
        n, shapes = (int(x) for x in np.fromfile(path, np.uint64, 2))
        at = 16
        self.digests = np.memmap(path, np.uint64, "r", at, (n,)) if n else np.zeros(0, np.uint64)
        at += 8 * n
        self.bounds = np.memmap(path, np.uint64, "r", at, (n + 1,))
        at += 8 * (n + 1)
        self.allowed = np.memmap(path, np.uint8, "r", at, (n,)) if n else np.zeros(0, np.uint8)
        at += n + (-n) % 8
        self.shapes = [tuple(x) for x in np.fromfile(path, np.int64, 2 * shapes, offset=at).reshape(-1, 2).tolist()]
        at += 16 * shapes
        size = os.path.getsize(path) - at
        self.strings = np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]], path: str) -> None:
        kept: dict[str, tuple[str, str, int]] = {}
        for host, prefix, verdict in rules:
            key = host + prefix
            kept[key] = (host, prefix, int(verdict == "allow") & kept.get(key, ("", "", 1))[2])
        rows = sorted((xxhash.xxh64_intdigest(key), key.encode(), allowed) for key, (_, _, allowed) in kept.items())
        shapes = sorted({(host.count("."), len(prefix)) for host, prefix, _ in kept.values()})
        if sum(len(x[1]) + 17 for x in rows) > MAX_RULE_BYTES:
            raise ValueError("the rules are too large to ship; use judge_by_join")
        with open(path, "wb") as out:
            out.write(np.array([len(rows), len(shapes)], np.uint64).tobytes())
            out.write(np.array([x[0] for x in rows], np.uint64).tobytes())
            out.write(np.cumsum([0, *(len(x[1]) for x in rows)]).astype(np.uint64).tobytes())
            out.write(bytes(x[2] for x in rows) + b"\0" * ((-len(rows)) % 8))
            out.write(np.array(shapes, np.int64).tobytes())
            out.write(b"".join(x[1] for x in rows))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, -1 where it isn't stored."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        found = np.full(len(keys), -1, np.int64)
        near = np.flatnonzero(at < len(self.digests))
        for i in near[self.digests[at[near]] == wanted[near]].tolist():
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:
                if self.strings[int(self.bounds[j]) : int(self.bounds[j + 1])].tobytes() == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """For each URL the longest rule that fits and its verdict."""
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            labels = host.split(".")
            for dots, n in self.shapes:
                if dots < len(labels) and n <= len(path):
                    keys.append((".".join(labels[len(labels) - dots - 1 :]) + path[:n]).encode())
                    owner.append(i)
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        for k, j in enumerate(self.find(keys).tolist() if keys else ()):
            if j >= 0 and len(key := keys[k].decode()) > len(out[owner[k]][0] or ""):
                out[owner[k]] = (key, "allow" if self.allowed[j] else "block")
        return out


@lru_cache(8)
def _index(name: str) -> DigestIndex:
    return DigestIndex(SparkFiles.get(name))


def ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Build the index and hand it to Spark for the executors; the name of the file there."""
    rules = sorted(set(rules))
    name = f"url-rules-{hashlib.sha256(repr(rules).encode()).hexdigest()[:20]}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    if not any(str(x).endswith(name) for x in spark.sparkContext.listFiles):
        DigestIndex.build(rules, path)
        spark.sparkContext.addFile(path)
    return name


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], listed: Iterable[tuple[str, str, str]] = (), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every URL.

    ``rules`` decide first; where none fits, the method's own list ``listed`` decides, and what it does not
    hold is allowed. Needs no shuffle.
    """
    spark = pages.sparkSession
    first, second = ship(spark, rules), ship(spark, listed)

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in batches:
            own = _index(first).longest(host.tolist(), path.tolist())
            other = _index(second).longest(host.tolist(), path.tolist())
            yield pd.DataFrame({"rule": [rule for rule, _ in own], "verdict": [a or b or "allow" for (_, a), (_, b) in zip(own, other, strict=True)]}, dtype=object)

    host, path = host_and_path(url_column)
    return pages.select(id_column, host.alias("host"), path.alias("path")).withColumn("j", judged("host", "path")).select(id_column, "host", "path", "j.rule", "j.verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """The same decision for a rule table (host, prefix, verdict) of any size, by an equi-join on candidates.

    A URL has one candidate for each shape (labels of the host, length of the prefix) that rules have; more than
    ``MAX_SHAPES`` shapes are refused. Keys that very many URLs share are split by the join.
    """
    host, path = host_and_path(url_column)
    labels = F.size(F.split("host", r"\."))
    shapes = rules.select(labels.alias("labels"), F.length("prefix").alias("n")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError("the rules have too many shapes")
    rules = rules.groupBy(F.concat("host", "prefix").alias("key")).agg(F.min_by("verdict", F.col("verdict") == "allow").alias("verdict"))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), id_column, host.alias("host"), path.alias("path"))
    table = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r.n).alias("n")) for r in shapes]).cast("array<struct<labels:int,n:int>>")
    tail = lambda s: F.array_join(F.slice(F.split("host", r"\."), labels - s["labels"] + 1, s["labels"]), ".")
    fitting = F.filter(table, lambda s: (s["labels"] <= labels) & (s["n"] <= F.length("path")))
    keys = urls.where("host <> ''").select("row", F.explode(F.transform(fitting, lambda s: F.concat(tail(s), F.substring("path", F.lit(1), s["n"])))).alias("key"))
    best = by_key(keys, rules, "key").groupBy("row").agg(F.max_by(F.struct("key", "verdict"), F.length("key")).alias("best"))
    return urls.join(best, "row", "left").select(id_column, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
