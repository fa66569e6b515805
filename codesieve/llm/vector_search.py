"""Nearest neighbours by cosine: inverted lists, searched by an adaptive scan of rotated dimensions in blocks of columns.

Unit vectors are rotated at random once, so that any first columns are a fair sample of all. Candidates belong to
the list of their nearest centre, in blocks of at most about ``BLOCK`` vectors kept column by column. A query meets
a block a few columns at a time. For two vectors of cosine c, the first k of d columns have a squared distance of
|q|^2 + |x|^2 - 2 c |q| |x|, lengths of the pieces, where c is met with a standard deviation of (1 - c^2) sqrt((1 -
k / d) / k); a candidate is abandoned as soon as its partial distance rejects the hypothesis that it reaches the
query's threshold, at ``DEVIATIONS`` of these. What survives all columns is scored on the original vectors in
double precision.

A query probes in two rounds. First its ``FIRST`` nearest lists, which give the threshold: the cosine of its K-th
nearest so far. Then as many more lists as needed: a list's size and the spread of its members about its centre
give the number of members expected beyond the threshold; lists are left out while those left out hold fewer than
``MISSED`` such members together. So a query in a tight group probes few lists, one in empty space many.

The centres are fitted on at most ``PER_CENTRE`` vectors for each of at most ``MAX_CENTRES`` centres (those with the
smallest hashes of id and vector); every vector is indexed. Of equal vectors only the K + 1 smallest ids are
candidates, for no query can need more. Queries of a list beyond ``QUERIES`` meet copies of its blocks, so no task
holds more than a block of candidates and a batch of queries.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length is not the table's commonest (ties: the smaller); a query's own id is never its neighbour; repeated rows are
one; an id with several vectors is as many candidates, and asks with the smallest of them; ties go to the smaller
id; a table of one vector gives no rows, as does an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesieve.llm.common import checkpointed, partitions, released

NEAREST, QUERY_STEP = 5, 50
#: The index: candidates in a block, mean members of a list at least, bounds of the centres and of the sample they are fitted on, rounds of fitting.
BLOCK, LEAST_MEMBERS, MAX_CENTRES, PER_CENTRE, ROUNDS = 2048, 64, 2048, 40, 8
#: Columns looked at at a time, and the standard deviations beyond which a candidate is abandoned.
COLUMNS, DEVIATIONS = 16, 2.5
#: Lists probed first, and the members beyond the threshold that lists left out may be expected to hold.
FIRST, MISSED = 8, 0.15
#: Queries of a list that share a copy of its blocks, and queries scanned together.
QUERIES, TOGETHER = 65_536, 128
#: Rounding of single precision that a test allows for.
SLACK = 1e-5

_SEED = 20


def vectors_of(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the distinct rows that take part, of the commonest length."""
    v = F.col(vector_column).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(F.coalesce(whole, F.lit(False)) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two to lengths that cannot overflow, and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x
    return x, np.sqrt((x * x).sum(1))


class Index:
    """A rotation and the centres of the lists, fitted on a sample; sent to all tasks."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(_SEED)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        x, length = _unit(sample)
        x = (x / length[:, None]).astype(np.float32) @ self.rotation
        self.centres = x[:lists].copy()
        for _ in range(ROUNDS):
            near, _ = self.nearest(x)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, x)
            size = np.sqrt((sums * sums).sum(1))
            self.centres[size > 0] = sums[size > 0] / size[size > 0, None]

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        x, length = _unit(vectors)
        return (x / length[:, None]).astype(np.float32) @ self.rotation

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each rotated vector and its cosine, a few at a time."""
        place, cosine = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
        for lo in range(0, len(x), 4096):
            sims = x[lo : lo + 4096] @ self.centres.T
            place[lo : lo + 4096] = sims.argmax(1)
            cosine[lo : lo + 4096] = sims.max(1)
        return place, cosine


def fit(vectors: DataFrame) -> Index | None:
    """The index of (id, v), from a bounded sample; None without vectors."""
    n = vectors.count()
    lists = max(1, min(MAX_CENTRES, int(2 * math.sqrt(n)), n // LEAST_MEMBERS))
    sample = vectors.orderBy(F.xxhash64("id", "v")).limit(lists * PER_CENTRE).select("v").toArrow()
    return Index(_matrix(sample.column(0)), lists) if n else None


def assigned(vectors: DataFrame, index: Index) -> DataFrame:
    """(id, v, list, cosine): every vector with its nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, cosine = shared.value.nearest(shared.value.rotated(_matrix(batch.column(1)))) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place.astype(np.int32)), pa.array(cosine.astype(np.float64))], names=["id", "v", "list", "cosine"])

    return vectors.mapInArrow(released(run), f"id bigint, v {vectors.schema['v'].dataType.simpleString()}, list int, cosine double")


class Lists:
    """What is known of each list: members, mean and variance of their cosines with the centre."""

    def __init__(self, members: DataFrame, n: int):
        self.size, self.mean, self.var = np.zeros(n), np.zeros(n), np.zeros(n)
        for place, size, mean, var in members.groupBy("list").agg(F.count("*"), F.avg("cosine"), F.var_pop("cosine")).collect():
            self.size[place], self.mean[place], self.var[place] = size, min(1.0, mean), max(0.0, var)

    def expected(self, cosines: np.ndarray, least: np.ndarray, dimensions: int) -> np.ndarray:
        """Members expected at a cosine of ``least`` or more with queries of these cosines with the centres."""
        mean = cosines * self.mean
        spread = np.sqrt(cosines**2 * self.var + np.maximum(0, 1 - self.mean**2 - self.var) * np.maximum(0, 1 - cosines**2) / max(1, dimensions - 1)) + 1e-9
        return self.size * 0.5 * _erfc((least[:, None] - mean) / (spread * math.sqrt(2)))


def _erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function, to seven digits (a rational form in Abramowitz and Stegun, 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-np.minimum(x * x, 700))
    return np.where(x >= 0, tail, 2 - tail)


def probes(queries: DataFrame, index: Index, lists: Lists) -> DataFrame:
    """(id, v, least, list) for each list that a query probes, of (id, v, least): the first ones where ``least`` is null, else the others needed."""
    shared = queries.sparkSession.sparkContext.broadcast((index, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lists = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                x = index.rotated(_matrix(some.column(1)))
                cosines = np.clip((x @ index.centres.T).astype(np.float64), -1, 1)
                first = np.zeros(cosines.shape, bool)
                np.put_along_axis(first, np.argsort(-np.where(lists.size > 0, cosines, -2), axis=1, kind="stable")[:, :FIRST], True, 1)
                if some.column(2).null_count == some.num_rows:
                    chosen = first
                else:
                    least = some.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)
                    hits = np.where(first, 0, lists.expected(cosines, least, x.shape[1]))
                    order = np.argsort(hits, axis=1, kind="stable")
                    left_out = np.cumsum(np.take_along_axis(hits, order, 1), axis=1) < MISSED
                    chosen = np.zeros(cosines.shape, bool)
                    np.put_along_axis(chosen, order, ~left_out, 1)
                    chosen &= ~first
                row, place = np.nonzero(chosen & (lists.size > 0))
                for a in range(0, len(row), BLOCK):
                    yield pa.RecordBatch.from_arrays([*(some.column(k).take(pa.array(row[a : a + BLOCK])) for k in range(3)), pa.array(place[a : a + BLOCK].astype(np.int32))], names=["id", "v", "least", "list"])

    return queries.select("id", "v", "least").mapInArrow(released(run), f"id bigint, v {queries.schema['v'].dataType.simpleString()}, least double, list int")


class Block:
    """A block of candidates: rotated, column by column, with the lengths of their pieces up to each step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, index: Index):
        self.ids = ids
        self.vectors, self.lengths = _unit(vectors)
        self.columns = np.ascontiguousarray(index.rotated(vectors).T)
        self.pieces = _pieces(self.columns.T)

    def search(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, candidate's place, cosine) of each query's nearest that reach its threshold."""
        plain, lengths = _unit(vectors)
        x = index.rotated(vectors)
        pieces, d = _pieces(x), x.shape[1]
        if (least < -1).any() and len(self.ids) > NEAREST:  # no threshold yet: that of this block
            inner = np.where(ids[:, None] == self.ids[None, :], np.float32(-2), x @ self.columns)
            least = np.maximum(least, np.partition(inner, -NEAREST, axis=1)[:, -NEAREST] - SLACK)
        row, place = np.nonzero(ids[:, None] != self.ids[None, :])
        inner = np.zeros(len(row), np.float32)
        for step, lo in enumerate(range(0, d, COLUMNS)):
            hi = min(d, lo + COLUMNS)
            inner = (x[:, lo:hi] @ self.columns[lo:hi])[row, place] if not lo else inner + np.einsum("ij,ji->i", x[row, lo:hi], self.columns[lo:hi, place])
            reached = least - DEVIATIONS * (1 - np.minimum(1, least**2)) * math.sqrt((1 - hi / d) / hi)
            # The partial squared distance is that of both pieces less twice this product.
            on = inner >= pieces[row, step] * self.pieces[place, step] * reached[row] - SLACK
            row, place, inner = row[on], place[on], inner[on]
        cosine = (plain[row] * self.vectors[place]).sum(1) / (lengths[row] * self.lengths[place])
        on = cosine >= least[row]
        return row[on], place[on], cosine[on]


def _pieces(x: np.ndarray) -> np.ndarray:
    """The length of each rotated vector's first columns, up to each step."""
    return np.sqrt(np.add.reduceat(x**2, np.arange(0, x.shape[1], COLUMNS), axis=1).cumsum(1))


def _best(row: np.ndarray, cosine: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where the ``NEAREST`` best of each row stand, ties to the smaller id."""
    order = np.lexsort((ids, -cosine, row))
    row = row[order]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return order[rank < NEAREST]


def scan(members: DataFrame, asked: DataFrame, index: Index, lists: Lists) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each query (id, v, least, list) in each block of its list."""
    blocks = F.array(*[F.lit(int(max(1, math.ceil(n / BLOCK)))) for n in lists.size])
    counted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    copies = F.array(*[F.lit(math.ceil(counted.get(k, 0) / QUERIES)) for k in range(len(lists.size))])
    pick = lambda numbers: F.get(numbers, F.col("list"))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    sequence = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    # Candidates are dealt over a list's blocks and copied for its groups of queries; queries meet all blocks of their list.
    held = members.select("list", deal(pick(blocks)).alias("block"), sequence(pick(copies)).alias("part"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("least"))
    asking = asked.select("list", sequence(pick(blocks)).alias("block"), deal(pick(copies)).alias("part"), F.lit(1).alias("kind"), "id", "v", "least")
    shared = members.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], 1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                some, (*at, kind) = batch.slice(lo, hi - lo), keys[lo].tolist()
                if at != key:
                    key, block = at, None
                    ids.clear()
                    vectors.clear()
                own, v = some.column(4).to_numpy(zero_copy_only=False), _matrix(some.column(5))
                if not kind:
                    ids.append(own)
                    vectors.append(v)
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(vectors), shared.value)
                    ids.clear()
                    vectors.clear()
                if block is None:
                    continue
                least = some.column(6).fill_null(-2.0).to_numpy(zero_copy_only=False)
                for a in range(0, len(own), TOGETHER):
                    row, place, cosine = block.search(own[a : a + TOGETHER], v[a : a + TOGETHER], least[a : a + TOGETHER], shared.value)
                    best = _best(row, cosine, block.ids[place])
                    yield pa.RecordBatch.from_arrays([pa.array(own[a : a + TOGETHER][row[best]]), pa.array(block.ids[place[best]]), pa.array(cosine[best])], names=["query_id", "vec_id", "score"])

    both = held.unionByName(asking).repartition(partitions(members.sparkSession), "list", "block", "part")
    return both.sortWithinPartitions("list", "block", "part", "kind").mapInArrow(released(run), "query_id bigint, vec_id bigint, score double")


def _ranked(found: DataFrame) -> DataFrame:
    """The ``NEAREST`` best of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEAREST)


def search(table: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest other rows of the rows for which ``is_query``, a condition on ``id``."""
    vectors = checkpointed(vectors_of(table, id_column, vector_column))
    index = fit(vectors)
    if index is None:
        return vectors.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    equal = Window.partitionBy("v").orderBy("id")
    members = checkpointed(assigned(vectors.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= NEAREST + 1).select("id", "v"), index))
    lists = Lists(members, len(index.centres))
    queries = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    first = checkpointed(scan(members, probes(queries.withColumn("least", F.lit(None).cast("double")), index, lists), index, lists))
    least = _ranked(first).groupBy("query_id").agg(F.when(F.count("*") == NEAREST, F.min("score")).otherwise(-2.0).alias("least"))
    known = checkpointed(queries.join(least, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("least")))
    asked = checkpointed(probes(known, index, lists))
    second = scan(members, asked, index, lists)
    return _ranked(first.unionByName(second)).select("query_id", "rank", "vec_id", "score")
