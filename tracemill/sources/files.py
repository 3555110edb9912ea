"""Trace files by way of Spark's file sources, so that any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill.plans import schema as S
from tracemill.sources import codec, columnar

ON_ERROR = ("raise", "skip", "keep")
DECODED = T.StructType([T.StructField("source", T.StringType()), *S.POINTS.fields[1:], T.StructField("error", T.StringType())])
_TYPE = T.StructType([T.StructField("type_name", T.StringType()), T.StructField("format", T.StringType()), T.StructField("size", T.IntegerType())])
HEADED = T.StructType([*DECODED.fields, T.StructField("types", T.ArrayType(_TYPE))])
CHUNK = 10_000  # points in a file
BATCH = 2000  # points handed on together
TOGETHER = 1 << 21  # bytes of small files that are decoded together


def _row(source: str, counter: int, p: codec.Point) -> dict:
    statement = p.statement
    if statement is not None and statement >= 1 << 63:
        statement -= 1 << 64
    whole = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    number = lambda n: None if n is None else Decimal(n)
    vars_ = [
        {
            "pos": i,
            "name": v.name,
            "type": v.type,
            "format": v.format,
            "size": v.size,
            "num": number(v.value) if v.format in ("UNSIGNED", "SIGNED", "POINTER") else None,
            "dbl": v.value if v.format == "FLOAT" else None,
            "blob": v.value if v.format == "BLOB" else None,
            "buffer_size": number(v.buffer_size),
        }
        for i, v in enumerate(p.vars)
    ]
    return {"source": source, "counter": counter, "statement": statement, "sizes": [{"address": Decimal(a), "size": Decimal(s)} for a, s in p.sizes], "vars": vars_, "aux": [whole(a) for a in p.aux], "error": None}


def decoded(
    files: DataFrame,
    format: str = "binary",
    max_points: int = 0,
    on_error: str = "raise",
    memory_map: bool = True,
    while_: Callable[[object], bool] | None = None,
    headers: bool = False,
) -> DataFrame:
    """Rows (path, content) -> the points of each file, in schema DECODED.

    A malformed trace is refused whole: it raises, or (skip) leaves one row that has only source and error; or (keep)
    its points before the error are taken. while_, for s-expressions, ends a trace at the first entry for which it is
    false. headers adds, for each file, a row without counter that has its types in order. If files have a column
    counters, it names the counters of the points in order.
    """
    if on_error not in ON_ERROR or max_points < 0 or format not in ("binary", "sexp"):
        raise ValueError("format is binary or sexp, on_error raise, skip or keep, max_points 0 or more")
    shape = HEADED if headers else DECODED
    arrow, nothing, rest = to_arrow_schema(shape), dict.fromkeys(shape.names), on_error == "keep"
    numbered = "counters" in files.columns

    def points_of(path: str, data: bytes, counters: list[int] | None) -> Iterator[dict]:
        try:
            if format == "binary":
                types, points = codec.decode(data, max_points, memory_map, rest)
            else:
                types, points = [], codec.decode_sexp(data.decode(), max_points, while_, rest)
        except codec.TraceError as e:
            if on_error == "raise":
                raise
            yield nothing | {"source": path, "error": str(e)}
            return
        if headers:
            yield nothing | {"source": path, "types": [{"type_name": n, "format": S.FORMATS[f], "size": s} for n, f, s in types]}
        for i, p in enumerate(points):
            yield _row(path, counters[i] if counters else i, p)

    def one_by_one(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for file in group:
            for r in points_of(*file):
                rows.append(r)
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def together(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The files as columns; those that aren't regular one by one."""
        found = columnar.decode(*(list(x) for x in zip(*group, strict=True)), arrow, memory_map)
        if found is not None:
            yield found
        elif len(group) == 1:
            yield from one_by_one(group)
        else:
            yield from together(group[: len(group) // 2])
            yield from together(group[len(group) // 2 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = format == "binary" and not max_points and not headers
        for b in batches:
            group, size = [], 0
            for i in range(b.num_rows):
                path, data, *counters = (c[i].as_py() for c in b.columns)
                group.append((path, data, counters[0] if counters else None))
                size += len(data)
                if size >= TOGETHER or i == b.num_rows - 1:
                    yield from together(group) if plain else one_by_one(group)
                    group, size = [], 0

    return files.select("path", "content", *(["counters"] if numbered else [])).mapInArrow(run, shape)


def trace_files(spark: SparkSession, path: str | list[str], max_traces: int = 0) -> DataFrame:
    """path and content of trace files; of the first max_traces of them by path, if that isn't 0."""
    if max_traces < 0:
        raise ValueError("max_traces is 0 or more")
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.join(found.select("path").orderBy("path").limit(max_traces), "path", "left_semi") if max_traces else found


def read_traces(spark: SparkSession, path: str | list[str], max_traces: int = 0, **options) -> DataFrame:
    """Points of trace files (options as of decoded())."""
    return decoded(trace_files(spark, path, max_traces), **options)


def encoded(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """trace_id, part, counters, content: points as binary traces, chunk counters to a file, so that no trace must fit one task."""

    def point(r: dict) -> codec.Point:
        value = lambda v: v["blob"] if v["format"] == "BLOB" else v["dbl"] if v["format"] == "FLOAT" else int(v["num"])
        vars_ = [codec.Variable(v["name"], v["type"], v["format"], v["size"], value(v)) for v in r["vars"] or ()]
        statement = None if r["statement"] is None else r["statement"] % (1 << 64)
        return codec.Point(statement, [(int(s["address"]), int(s["size"])) for s in r["sizes"] or ()], vars_, [a % (1 << 64) for a in r["aux"] or ()])

    def files(table: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        """Files whose points begin at these rows."""
        rows = table.combine_chunks().to_batches()[0]
        ends = np.append(begins[1:], rows.num_rows)
        data = columnar.encode(rows, np.repeat(np.arange(len(begins)), ends - begins))
        if data is None:
            data = [codec.encode(point(r) for b in pa.Table.from_batches([rows.slice(a, z - a)]).to_batches(BATCH) for r in b.to_pylist()) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
        keys = [rows.column(c).take(pa.array(begins)) for c in ("trace_id", "part")]
        counters = pa.ListArray.from_arrays(pa.array(np.append(begins, rows.num_rows), pa.int32()), rows.column("counter"))
        return pa.RecordBatch.from_arrays([*keys, counters, pa.array(data, pa.binary())], ["trace_id", "part", "counters", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None  # the points of a file that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for c in ("trace_id", "part"):
                x = table.column(c)
                value, null = pc.fill_null(x, 0).to_numpy(), x.is_null().to_numpy()
                change[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
            begins = np.flatnonzero(change)
            if len(begins) > 1:
                yield files(table.slice(0, begins[-1]), begins[:-1])
            left = table.slice(begins[-1])
        if left is not None:
            yield files(left, np.zeros(1, np.int64))

    rows = points.withColumn("part", F.floor(F.col("counter") / chunk).cast("long"))
    sorted_ = rows.repartition("trace_id", "part").sortWithinPartitions("trace_id", "part", "counter")
    return sorted_.mapInArrow(run, "trace_id long, part long, counters array<long>, content binary")


def round_trip(points: DataFrame) -> DataFrame:
    """points written as binary traces and read back; counters are those of points."""
    written = encoded(points).select(F.concat_ws("/", "trace_id", "part").alias("path"), "content", "counters")
    back = decoded(written, memory_map=False).where("error is null")
    return back.select(F.substring_index("source", "/", 1).cast("long").alias("trace_id"), *S.POINTS.names[1:])
