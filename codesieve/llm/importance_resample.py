"""Importance resampling towards a target's distribution of hashed word runs.

Runs of one and two words are hashed into ``BUCKETS`` buckets. Counts of the buckets over the corpus and over the
target give each bucket's gain, a bounded array; a document's weight is the floored mean of its runs' gains, read
from that array, and its score is the weight plus a Gumbel draw made of its id. The highest scores among documents
of at least ``LEAST_WORDS`` words are drawn, so a draw without replacement in proportion to exp(weight / 1000).

The k-th key is found exactly by distributed radix selection: the composite key (score downwards, id upwards, null
ids last, then the row's number of runs and its place in the written scores, which make it unique) is cut into digits
of ``DIGIT_BITS`` bits from the top; each round counts the rows of the open prefix by their next digit, of which the
driver gets no more than 2 ** ``DIGIT_BITS`` counts, until the rows up to a digit are as many as are to be drawn.
Only rows up to that key are sorted, over ranges, and ranked by their place in a range and the sizes of those before.

Edge cases: a null text is an empty one, with no words, weight 0 and no draw; a null id is hashed as an empty one and
comes last in ties; repeated rows are drawn one by one, in ranks that follow each other; an empty corpus gives an
empty result, an empty target gains of the corpus alone; other columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import checkpointed

#: What the runs are, how many buckets they fall into, and who may be drawn.
LONGEST_RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: The driver gets so many counts at a round at most.
DIGIT_BITS = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """A text's words, A to Z in lower case; null: none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def buckets_of(words: Column) -> Column:
    """The buckets of all runs of up to ``LONGEST_RUN`` words."""
    run = lambda size: F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))),
        lambda word, at: (F.crc32(word if size == 1 else F.concat_ws(" ", word, *[F.get(words, at + k) for k in range(1, size)])) % BUCKETS).cast("int"),
    )
    return F.concat(*[run(size) for size in range(1, LONGEST_RUN + 1)])


def bucket_counts(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """(bucket, n) over all runs of all texts."""
    words = texts.select(words_of(text_column).alias("words"))
    return words.select(F.explode(buckets_of(F.col("words"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_column: str = "text") -> DataFrame:
    """One row (gains): an array with each bucket's gain, in thousandths."""
    zero = F.lit(0).cast("long")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), zero.alias("s"), zero.alias("t"))
    own = bucket_counts(docs, text_column).select("bucket", F.col("n").alias("s"), zero.alias("t"))
    theirs = bucket_counts(target, text_column).select("bucket", zero.alias("s"), F.col("n").alias("t"))
    counts = own.unionByName(theirs).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("n"))
    gain = lambda n: F.floor(1000 * F.log((n["t"] + 1).cast("double") * (F.col("all_s") + BUCKETS) / ((n["s"] + 1).cast("double") * (F.col("all_t") + BUCKETS))))
    return found.select(F.transform("n", gain).alias("gains"))


def scores(docs: DataFrame, gain: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document. ``gain`` is one array of ``BUCKETS`` numbers, broadcast."""
    rows = docs.select(id_column, words_of(text_column).alias("_words")).select(id_column, F.size("_words").alias("n_words"), buckets_of(F.col("_words")).alias("_buckets"))
    both = rows.join(F.broadcast(gain))
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda s, b: s + F.get("gains", b))
    n = F.size("_buckets").cast("long")
    seed = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    weighed = both.select(id_column, "n_words", n.alias("n_features"), F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long").alias("weight"))
    return weighed.withColumn("score", F.col("weight") + gumbel)


def _last_key(rows: DataFrame, keys: list[str], k: int) -> dict[str, int] | None:
    """The inclusive bounds of the first ``k`` rows by ``keys``, none of them null: a row is drawn if it is below at the first key on which it differs."""
    bounds: dict[str, int] = {}
    left, open_rows = k, rows
    for key in keys:
        least, most, n = open_rows.agg(F.min(key), F.max(key), F.count("*")).first()
        if n == left:
            break
        bounds[key] = most
        if least == most:
            continue
        base, shift = least, max(0, (most - least).bit_length() - DIGIT_BITS)
        while True:
            digit = F.shiftright(F.col(key) - F.lit(base), shift)
            for d, c in sorted(tuple(r) for r in open_rows.groupBy(digit.alias("digit")).count().collect()):
                if left <= c:
                    break
                left -= c
            low, high = base + (d << shift), base + ((d + 1) << shift) - 1
            open_rows = open_rows.where(F.col(key).between(low, high))
            bounds[key] = high
            if left == c or not shift:
                break
            base, shift = low, max(0, shift - DIGIT_BITS)
        if left == c:
            break
    return bounds


def draw(scored: DataFrame, percent: int = PERCENT, id_column: str = "doc_id") -> DataFrame:
    """``scored`` (id, n_words, n_features, weight, score) with ``rank``: 1, 2, ... of those drawn, else null."""
    # The last key is a row's place in the written table: its partition and its number there.
    placed = checkpointed(scored).select("*", F.monotonically_increasing_id().alias("_place"), F.col(id_column).isNull().cast("long").alias("_unnamed"), F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("_id"), (-F.col("score")).alias("_down"))
    able = placed.where(F.col("n_words") >= LEAST_WORDS)
    k = percent * able.count() // 100
    columns = [id_column, "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return placed.select(*columns, unranked)
    keys = ["_down", "_unnamed", "_id", "n_features", "_place"]
    bounds = _last_key(able, keys, k)
    inside, equal = F.lit(False), F.lit(True)
    for key, high in bounds.items():
        inside, equal = inside | (equal & (F.col(key) < high)), equal & (F.col(key) == high)
    chosen = (F.col("n_words") >= LEAST_WORDS) & (inside | equal)
    ranges = checkpointed(placed.where(chosen).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns))
    part = F.spark_partition_id()
    before, total = {}, 0
    for p, n in sorted(tuple(r) for r in ranges.groupBy(part.alias("part")).count().collect()):
        before[p] = total
        total += n
    starts = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranked = ranges.select(*columns, (starts[part] + at + 1).cast("long").alias("rank"))
    return ranked.unionByName(placed.where(~chosen).select(*columns, unranked))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn."""
    return draw(scores(docs, checkpointed(gains(docs, target, text_column)), id_column, text_column), percent, id_column)
