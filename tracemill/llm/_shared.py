"""Helpers that the operators share: intermediate tables, free names and training folds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import scratch


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir."""
    return scratch.scratch_dir(spark, "tracemill")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return scratch.written(df, "tracemill")


def free_name(columns: Iterable[str], name: str) -> str:
    """name, with as many signs more as it takes to be none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id belongs to no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


BROADCAST_ROWS = 500_000  # of narrow rows; more are joined by shuffles
HOT_ROWS = 50_000  # rows of a key that go to one task


def joined(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined (inner, left or left_anti) with a written table of distinct keys.

    The table is broadcast if it has at most so many rows, and rows aren't shuffled then. Beyond that rows of a key, or
    of the null key, are dealt over as many tasks as they need at HOT_ROWS each; hot keys, which are broadcast for
    that, are at most one in HOT_ROWS rows.
    """
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key, how)
    salts = F.ceil(F.col("count") / HOT_ROWS).cast("long").alias("__salts")
    hot = written(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > HOT_ROWS).select(key, salts))
    count = F.when(F.col(key).isNull(), F.lit(1 << 16)).otherwise(F.coalesce("__salts", F.lit(1))).cast("long")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), count)).drop("__salts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)).cast("long") - 1))
    spread = table.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left").withColumn("__salt", copies).drop("__salts")
    return dealt.join(spread, [key, "__salt"], how).drop("__salt")
