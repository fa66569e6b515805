"""Connected components of a graph of links, as alternating star contractions in Spark.

Links stay distributed; only two numbers a round come to the driver, to see whether anything changed. A
node with very many links is reduced by partial aggregation, and its join is split by adaptive execution.

Edge cases: links of a node with itself and repeated links count for nothing; nodes without links are in no
row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import checkpointed

MAX_ROUNDS = 60


def by_key(rows: DataFrame, sums: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``sums``, one row for each ``key``, where there is one; all rows if ``how`` is left.

    The join deals both sides anew by a hash of the key: Spark splits a hot key's partition of an exchange,
    but not of an aggregate that is already dealt by the key.
    """
    dealt = F.xxhash64(key)
    return rows.withColumn("_dealt", dealt).join(sums.withColumn("_dealt", dealt), ["_dealt", key], how).drop("_dealt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return by_key(both.where("v > u"), least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = by_key(edges, least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, roots included. ``links`` has columns u, v."""
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        edges = checkpointed(_small_star(_large_star(edges)))
        row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(row) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(row)
    raise RuntimeError("the components did not settle")
