"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import BROADCAST_ROWS, joined, written


def _stars(edges: DataFrame, few: bool) -> DataFrame:
    """One large-star and one small-star step; edges have a > b. The least neighbours of few edges are broadcast."""

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(least), "a") if few else joined(rows, written(least), "a")

    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # Large star: each larger neighbour of a node is tied to the least of its neighbourhood.
    large = with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    # Small star: a node and its smaller neighbours are tied to the least of them.
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = with_least(large, low).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the least node of node's component.

    Each round is written to the shared folder; it ends when a round changes nothing. The rounds grow
    with the logarithm of the longest path. The many edges of a hub are dealt over tasks. Nulls and loops are ignored; lone nodes don't appear.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(now), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        now, seen = written(_stars(now, 2 * mark[0] <= BROADCAST_ROWS)), mark
