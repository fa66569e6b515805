"""Audit of how quality filters interact: what each removes in every order, alone, and on average over all orders.

A document's failures are the bits of a mask. Documents are counted for each (part, mask, labels) first, so that
what follows depends on the number of parts only, never on that of documents. Cells are then unpivoted against
the steps of all orders (long form); a running bit-or over the steps before one tells whether a document was
removed earlier; conditional sums give the counts of a step, and totals over a filter's rows of all orders its
Shapley value (times the number of orders).

One filter is of a whole table: a document fails ``copied`` if a row with a smaller id has its text. Texts meet by
a SHA-256 digest, pre-aggregated by digest and id, so that neither texts nor a group of copies meet in one task.

Edge cases: a null text is an empty one (and equal to other empty texts); a null part is the empty string; a row
with a null id has no smaller one before it and is none for others, and has no labels; rows that repeat an id count
one by one and are not copies of each other; a label row counts once for an id however often it is repeated; an
empty table gives an empty result; other columns are not read. Texts are judged whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesieve.llm.components import by_key

# The filters' names and what fails them.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
WORD_PARTS, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"

METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> Column:
    """The mask of the filters that look at a text alone: A to D are its four lowest bits."""
    words = F.array_remove(F.split(text, WORD_PARTS), "")

    def mask(x: Column) -> Column:
        n, characters = F.size(x["words"]).cast("long"), F.length(text).cast("long")
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
        failing = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(x["words"])).cast("long") < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * characters, text.rlike(SYMBOLS)]
        return sum((f.cast("int") * (1 << k) for k, f in enumerate(failing)), F.lit(0))

    return F.element_at(F.transform(F.array(F.struct(words.alias("words"))), mask), 1)


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): the number of documents by part, failures and labels; bit 4 is ``copied``."""
    text = F.coalesce(text_column, F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))
    marked = labels.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("id IS NOT NULL AND (good = 1 OR toxic = 1)")
    one = ["key", "part", "mask", "id"]
    same = rows.groupBy(*one).agg(F.count("*").alias("n"))
    labelled = by_key(same, marked, "id", "left").select(*one, "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kinds = labelled.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("named"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("key"))  # a text has a row for each part and labels here
    judged = kinds.withColumn("first", first).withColumn("copies", F.col("named") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n"))))
    return judged.select("part", "good", "toxic", both.alias("cell")).where("cell.n > 0").groupBy("part", F.col("cell.mask").alias("mask"), "good", "toxic").agg(F.sum("cell.n").alias("n"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, metrics ...) of ``cells``: a row for each part, order of the filters and step, zeros included."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)]))
    bits = F.create_map(*[F.lit(x) for k, name in enumerate(filters) for x in (name, 1 << k)])
    long = counts.withColumn("filter_order", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).withColumn("bit", bits[F.col("filter")])
    cell = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("at")
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    earlier = F.coalesce(F.bit_or(failed).over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = long.withColumn("fails", failed != 0).withColumn("gone", earlier != 0)
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))
    fails, gone, here = F.col("fails"), F.col("gone"), F.col("fails") & ~F.col("gone")
    steps = told.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & (F.col("good") == 1)).alias("good_lost"),
        total(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.withColumn("shapley", shapley).select("part", "filter_order", "step", *METRICS)


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The audit of the five filters over documents with labels (id, quality, toxic)."""
    return audit(cells(docs, labels, part, id_column, text_column))
