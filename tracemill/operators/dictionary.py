"""Names and types of traces as numbers, in order of first sight, as a trace file's header has them.

A dictionary is made by one aggregation, and numbered by range partitions whose rows are counted, so a trace with any
number of names is shared by many tasks. Encoded points hold indices in place of names and types.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.scratch import written

GROUP = 200_000  # rows that a task sorts, about
SENT = 200_000  # entries of dictionaries that are broadcast; more are joined by trace
VALUES = ("pos", "num", "dbl", "blob", "buffer_size")  # what an encoded variable keeps


def ranked(rows: DataFrame, by: str, order: list[str], group: int = 0) -> DataFrame:
    """rows with index, the place of each among those of the same value of by, in order. No task ranks the rows of one value alone."""
    keys, rows = [by, *order], written(rows)  # it is counted, sampled and sorted
    sorted_ = rows.repartitionByRange(max(1, math.ceil(rows.count() / (group or GROUP))), *keys).sortWithinPartitions(*keys)
    placed = written(sorted_.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    counts = placed.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(F.broadcast(counts.select("__part", (before - F.col("__first")).alias("__shift"))), "__part")  # a row for each partition
    placed = placed.withColumn("__place", F.col("__at") + F.col("__shift"))
    starts = placed.groupBy(by).agg(F.min("__place").alias("__start"))
    return written(placed.join(starts, by).select(*rows.columns, (F.col("__place") - F.col("__start")).cast("int").alias("index")))


def first_seen(points: DataFrame, *keys: Column) -> DataFrame:
    """trace_id, keys (of a variable v), first: the least counter and position of each in a trace.

    The least of structs would be found by sorting all variables; the least counter of each position is found by hashing, and leaves few.
    """
    each = points.select("trace_id", F.coalesce("counter", F.lit(-1 << 63)).alias("counter"), F.explode("vars").alias("v"))  # null is before all
    least = each.groupBy("trace_id", *keys, F.col("v.pos").alias("__pos")).agg(F.min("counter").alias("__counter"))
    names_ = [c for c in least.columns if c not in ("trace_id", "__pos", "__counter")]
    return least.groupBy("trace_id", *names_).agg(F.min(F.struct(F.col("__counter").alias("counter"), F.col("__pos").alias("pos"))).alias("first"))


def names(points: DataFrame, group: int = 0) -> DataFrame:
    """trace_id, index, name: the names of each trace in order of first sight."""
    seen = first_seen(points, F.col("v.name").alias("name"))
    return ranked(seen, "trace_id", ["first", "name"], group).select("trace_id", "index", "name")


def types(points: DataFrame, group: int = 0) -> DataFrame:
    """trace_id, index, type, format, size: the types of each trace, told apart by all three, in order of first sight."""
    seen = first_seen(points, *(F.col(f"v.{c}").alias(c) for c in ("type", "format", "size")))
    return ranked(seen, "trace_id", ["first", "type", "format", "size"], group).select("trace_id", "index", "type", "format", "size")


def _joined(points: DataFrame, table: DataFrame, entries: int) -> DataFrame:
    """points with the columns of table, a row for each trace with its dictionary."""
    return points.join(F.broadcast(table) if entries <= SENT else table, "trace_id", "left")


def _key(v: Column) -> Column:
    """A type as text: its parts, each with its length."""
    part = lambda x: F.when(x.isNull(), "-").otherwise(F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")))
    return F.concat(part(v["type"]), part(v["format"]), part(v["size"]))


def encoded(points: DataFrame, names_: DataFrame, types_: DataFrame) -> DataFrame:
    """points whose variables have name_idx and type_idx in place of name, type, format and size."""
    text = lambda x: F.when(x.isNull(), "-").otherwise(F.concat(F.lit("+"), x))  # noqa: E731  a null name is one, too
    by_name = names_.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct(text(F.col("name")), "index"))).alias("__names"))
    by_type = types_.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct(_key({c: F.col(c) for c in ("type", "format", "size")}), "index"))).alias("__types"))
    rows = _joined(_joined(points, by_name, names_.count()), by_type, types_.count())
    short = F.transform("vars", lambda v: F.struct(F.try_element_at("__names", text(v["name"])).alias("name_idx"), F.try_element_at("__types", _key(v)).alias("type_idx"), *(v[c].alias(c) for c in VALUES)))
    return rows.withColumn("vars", short).select(*points.columns)


def decoded(points: DataFrame, names_: DataFrame, types_: DataFrame) -> DataFrame:
    """The inverse of encoded()."""
    listed = lambda t, *c: t.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("index", *c))).alias("l"))
    by_name, by_type = listed(names_, "name").withColumnRenamed("l", "__names"), listed(types_, "type", "format", "size").withColumnRenamed("l", "__types")
    rows = _joined(_joined(points, by_name, names_.count()), by_type, types_.count())

    def whole(v: Column) -> Column:
        t = F.get("__types", v["type_idx"])
        return F.struct(v["pos"].alias("pos"), F.get("__names", v["name_idx"])["name"].alias("name"), *(t[c].alias(c) for c in ("type", "format", "size")), *(v[c].alias(c) for c in VALUES[1:]))

    return rows.withColumn("vars", F.transform("vars", whole)).select(*points.columns)
