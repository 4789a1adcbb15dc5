"""Spark-side helpers: bounded bit sets, bucket counts, component forests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.arrays import Bits
from panelcast.sources.tables import materialise

#: The largest bit set that is sent to every executor: 2**28 bits are 32 MB.  With more entries
#: than fit, it says yes more often and filters less; no result depends on it.
MOST_BITS = 28
#: Words for each bucket of packed hashes, and the fewest buckets.
BUCKET_WORDS, LEAST_BUCKETS = 1_000_000, 64
#: Rows of an Arrow batch in the pipeline.
BATCH_ROWS = 1000


def bit_set(values: DataFrame, n: int) -> Bits:
    """Bits of a column of longs, *n* of them: 16 for each, within MOST_BITS."""
    power = min(max(18, int(n * 16).bit_length()), MOST_BITS)
    x = F.col(values.columns[0]).bitwiseAND(F.lit((1 << power) - 1))
    parts = (
        values.select(x.alias("x"))
        .groupBy(F.shiftright("x", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(F.lit(32767))).alias("bits"))
    )
    body = np.zeros(1 << (power - 3), np.uint8)
    for part, bits in parts.collect():  # 2**(power - 15) rows of 4 KB: 32 MB at most, in one job
        body[part * 4096 : part * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return Bits(body)


def bucket_bits(docs: DataFrame, text: str = "text") -> int:
    """Binary logarithm of the number of buckets for the hashes of all words of *docs*."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BUCKETS, int(size / 6 / BUCKET_WORDS)).bit_length()


def forest(links: DataFrame, known: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(a, b): every node of *links* (a, b: longs) with the least node of its component, itself left out.

    *known* is an earlier result; its links hold as well and are not looked for again.  With *rounds*,
    it stops after so many: then b is some lesser node of the same component and a may have several.

    Large-star and small-star rounds.  Each is an aggregate and a join and is written to the shared
    folder, so the lineage stays short; the number of rounds grows with the logarithm of the size.
    A node with very many links is a skewed join key, which the adaptive planner splits.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise((links if known is None else links.union(known.select("a", "b"))).distinct())
    while rounds != 0 and not _settled(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.union(least.select("a", "m")).where("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.union(least.select("a", "m")).where("a <> b").distinct())
        rounds = rounds and rounds - 1
    return edges


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one lesser node, and that one has none."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    found = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0] == 0


def rooted(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of a finished forest, the roots included."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands at most BATCH_ROWS rows at once to Python: what a batch of long texts needs
    beside the heap, once in the executor and once in each of its Python workers, shrinks with it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def share(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)
