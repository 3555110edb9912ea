"""Tables as traces."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.plans import schema as S
from tracemill.scratch import written

#: Codes of event types as file ids.
EVENT_FILES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def variable(pos: int, name: str, type_name: str, format_: str, size: int, value: Column) -> Column:
    """A struct VAR."""
    float_ = format_ == "FLOAT"
    return F.struct(
        F.lit(pos).alias("pos"),
        F.lit(name).alias("name"),
        F.lit(type_name).alias("type"),
        F.lit(format_).alias("format"),
        F.lit(size).alias("size"),
        (F.lit(None) if float_ or format_ == "BLOB" else value).cast(S.NUM).alias("num"),
        (value if float_ else F.lit(None)).cast("double").alias("dbl"),
        (value if format_ == "BLOB" else F.lit(None)).cast("binary").alias("blob"),
        F.lit(None).cast(S.NUM).alias("buffer_size"),
    )


def events_as_points(events: DataFrame, held: Column | None = None) -> DataFrame:
    """A trace per user, a point per event: the table's columns as variables of several types, or held, an array of VAR, in their place.

    A sign-up allocates 64 + k bytes at 4096 * (event_id % 4), an error frees what is there.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    file_ = F.coalesce(*(F.when(F.col("event_type") == t, n) for t, n in EVENT_FILES.items()), F.lit(0))
    address = 4096 * (F.col("event_id") % 4)
    big = F.col("event_id").cast(S.NUM)
    alloc = lambda size: F.array(F.struct(address.cast(S.NUM).alias("address"), size.cast(S.NUM).alias("size")))
    sizes = F.when(F.col("event_type") == "signup", alloc(64 + k)).when(F.col("event_type") == "error", alloc(F.lit(0))).otherwise(F.array().cast(S.POINTS["sizes"].dataType))
    return events.select(
        F.col("user_id").alias("trace_id"),
        F.col("event_id").alias("counter"),
        S.encode_statement(file_, F.col("event_id") % 16).alias("statement"),
        sizes.alias("sizes"),
        (F.array(
            variable(0, "k", "int", "SIGNED", 4, k),
            variable(1, "nk", "int", "SIGNED", 4, -k),
            variable(2, "value", "double", "FLOAT", 8, F.col("value")),
            variable(3, "v2", "double", "FLOAT", 8, F.col("value") * 2),
            variable(4, "uid", "unsigned int", "UNSIGNED", 4, F.col("user_id")),
            variable(5, "big", "int64_t", "SIGNED", 8, F.lit(Decimal((1 << 63) - 1)).cast(S.NUM) - big),
            variable(6, "ubig", "uint64_t", "UNSIGNED", 8, F.lit(Decimal((1 << 64) - 1)).cast(S.NUM) - big),
            variable(7, "p", "*void", "POINTER", 8, address + k),
        ) if held is None else held).alias("vars"),
        F.array(F.col("event_id") * 100).alias("aux"),
    )


def users_as_points(events: DataFrame) -> DataFrame:
    """A trace of one wide point per user: an integer and a float variable for each event, in order of event_id."""
    k = F.get_json_object("props", "$.k").cast("int")
    listed = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", k.alias("k"), "value"))).alias("e"))

    def pair(e: Column, i: Column) -> Column:
        both = (variable(0, "k", "int", "SIGNED", 4, e["k"]), variable(0, "value", "double", "FLOAT", 8, e["value"]))
        return F.array(*(v.withField("pos", (2 * i + j).cast("int")).withField("name", e["event_type"]) for j, v in enumerate(both)))

    one = F.lit(1).cast("long")
    none = F.array()
    return listed.select(F.col("user_id").alias("trace_id"), one.alias("counter"), S.encode_statement(one, one).alias("statement"), none.cast(S.POINTS["sizes"].dataType).alias("sizes"), F.flatten(F.transform("e", pair)).alias("vars"), none.cast("array<long>").alias("aux"))


def inferred_formats(values: DataFrame) -> DataFrame:
    """values: type, num -> type and format of integers given without one: SIGNED if any value of the type is negative."""
    return values.groupBy("type").agg(F.when(F.bool_or(F.col("num") < 0), "SIGNED").otherwise("UNSIGNED").alias("format"))


WIDTHS = (1, 2, 4, 8)  # bytes of integers
SENT = 500_000  # traces whose formats are broadcast; those of more are joined


def formats_by_type(points: DataFrame) -> DataFrame:
    """trace_id, type, format, size for the variables without a format, by all values of a type in a trace.

    The widest kind of value wins: text, then floats, then integers, which are SIGNED if one is negative, in as few bytes
    as hold all. It is one aggregation, of which each task sends on a row for each type of a trace.
    """
    each = points.select("trace_id", F.explode("vars").alias("v")).where("v.format is null and v.type is not null")
    kinds = each.groupBy("trace_id", F.col("v.type").alias("type")).agg(F.bool_or(F.col("v.blob").isNotNull()).alias("text"), F.bool_or(F.col("v.dbl").isNotNull()).alias("float"), F.min("v.num").alias("low"), F.max("v.num").alias("high"))
    whole = lambda x: F.lit(Decimal(x)).cast(S.NUM)
    signed = F.coalesce(*(F.when((F.col("low") >= whole(-(1 << 8 * w - 1))) & (F.col("high") < whole(1 << 8 * w - 1)), w) for w in WIDTHS), F.lit(8))
    unsigned = F.coalesce(*(F.when(F.col("high") < whole(1 << 8 * w), w) for w in WIDTHS), F.lit(8))
    format_ = F.when(F.col("text"), "BLOB").when(F.col("float"), "FLOAT").when(F.col("low") < 0, "SIGNED").otherwise("UNSIGNED")
    size = F.when(F.col("text"), 0).when(F.col("float"), 8).when(F.col("low") < 0, signed).otherwise(unsigned)
    return kinds.select("trace_id", "type", format_.alias("format"), size.alias("size"))


def with_formats(points: DataFrame) -> DataFrame:
    """points with formats and sizes of formats_by_type where variables lack one; their values become of that format."""
    entry = F.struct("type", F.struct("format", "size"))
    by_trace = written(formats_by_type(points).groupBy("trace_id").agg(F.map_from_entries(F.collect_list(entry)).alias("__formats")))
    few = by_trace.limit(SENT + 1).count() <= SENT
    rows = points.join(F.broadcast(by_trace) if few else by_trace, "trace_id", "left")

    def formed(v: Column) -> Column:
        f = F.try_element_at("__formats", v["type"])
        is_ = lambda x: f["format"] == x
        number = F.coalesce(v["num"].cast("string"), v["dbl"].cast("string")).cast("binary")
        new = {"format": f["format"], "size": f["size"], "num": F.when(~f["format"].isin("FLOAT", "BLOB"), v["num"]), "dbl": F.when(is_("FLOAT"), F.coalesce(v["dbl"], v["num"].cast("double"))), "blob": F.when(is_("BLOB"), F.coalesce(v["blob"], number))}
        out = v
        for name, x in new.items():
            out = out.withField(name, x)
        return F.when(v["format"].isNull() & f.isNotNull(), out).otherwise(v)

    return rows.withColumn("vars", F.transform("vars", formed)).select(*points.columns)


def as_text(points: DataFrame) -> DataFrame:
    """trace_id, counter and a line for reading: "file:node name type=value ..."; blobs in hexadecimal."""
    place = F.concat_ws(":", S.file_id(F.col("statement")).cast("string"), S.stmt_id(F.col("statement")).cast("string"))
    value = lambda v: F.coalesce(v["num"].cast("string"), v["dbl"].cast("string"), F.hex(v["blob"]))
    each = F.transform("vars", lambda v: F.concat(v["name"], F.lit(" "), v["type"], F.lit("="), value(v)))
    return points.select("trace_id", "counter", F.concat_ws(" ", place, F.array_join(each, " ")).alias("line"))
