"""A store of traces: Parquet tables of points, types and traces under one path, and a log of the loads that are complete."""

from __future__ import annotations

import secrets
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators import binding
from tracemill.operators.dictionary import first_seen
from tracemill.plans import schema as S
from tracemill.scratch import written
from tracemill.sources import files
from tracemill.sources.adapters import with_formats


def numbered(rows: DataFrame, key: str, base: int) -> DataFrame:
    """Distinct values of key -> key and id: base, base + 1 .. in order of key. Only partitions are counted on one task."""
    placed = written(rows.select(key).orderBy(key).select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    sizes = placed.groupBy("p").agg(F.min("m").alias("m0"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select("p", "m0", before.alias("before")), "p").select(key, (base + F.col("before") + F.col("m") - F.col("m0")).alias("id"))


LOG = "entry string, load string, first long, n long"
MOST_NAMED = 500  # loads that a filter names; more are joined


class TraceStore:
    """Traces under path. Points are partitioned by loads and blocks of trace ids, so that a query of one trace reads little.

    A load writes folders of its own, and an entry of the log when all of them are there; readers look only into
    folders that the log names. So a load is there or not: one that fails, or isn't over, shows nowhere, and may be tried
    again; clean() removes what it left. at shows the store as of so many entries, whatever was loaded since.

    An index counts the traces of all loads, in order of the log (by the clocks of the loaders); ids are unique, but have gaps between
    loads, as each load draws its own range: loaders that run at once don't share ids. newest_first numbers traces from the
    latest (index 0) as the s-expression format does. In each file points are sorted by statement, so that a query of one
    file's statements skips most of what a Parquet file has.
    """

    BLOCK = 1024  # trace ids to a directory
    RANGE = 1 << 32  # ids of a load

    def __init__(self, spark: SparkSession, path: str, newest_first: bool = False, file: int | None = None, at: int | None = None):
        self.spark, self.path, self.newest_first, self.file, self.at = spark, path.rstrip("/"), newest_first, file, at

    @classmethod
    def create(cls, spark: SparkSession, path: str, **options) -> TraceStore:
        """An empty store; whatever is there is replaced."""
        store = cls(spark, path, **options)
        for name, schema in (("log", LOG), ("points", S.POINTS), ("types", S.TYPES), ("traces", S.TRACES)):  # the log goes first
            spark.createDataFrame([], schema).limit(0).write.mode("overwrite").parquet(f"{store.path}/{name}")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> TraceStore:
        return cls(spark, path, **options)

    def _loads(self) -> list:
        """Name, first id and number of traces of each load that is complete, in order of the log: a row for each load."""
        rows = self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{self.path}/log").orderBy("entry").collect()
        return rows if self.at is None else rows[: self.at]

    def position(self) -> int:
        """How many entries the log has; a store opened at it stays as it is now."""
        return len(self._loads())

    def _table(self, name: str, schema: T.StructType, *partitions: T.StructField) -> DataFrame:
        loads = [r.load for r in self._loads()]
        full = T.StructType([*(f for f in schema.fields if f.name != "load"), *partitions, T.StructField("load", T.StringType())])
        rows = self.spark.read.schema(full).parquet(f"{self.path}/{name}")
        if len(loads) <= MOST_NAMED:
            return rows.where(F.col("load").isin(loads))
        return rows.join(F.broadcast(self.spark.createDataFrame([(x,) for x in loads], "load string")), "load", "left_semi")

    def points(self, trace_id: int | None = None) -> DataFrame:
        """Points of all traces, or of one, whose block alone is read."""
        rows = self._table("points", S.POINTS, T.StructField("block", T.LongType()))
        if trace_id is not None:
            rows = rows.where((F.col("block") == trace_id // self.BLOCK) & (F.col("trace_id") == trace_id))
        rows = rows.select(*S.POINTS.names)
        return rows.where(S.in_file(F.col("statement"), self.file)) if self.file is not None else rows

    def traces(self) -> DataFrame:
        return self._table("traces", S.TRACES).select(*S.TRACES.names)

    def types(self) -> DataFrame:
        return self._table("types", S.TYPES).select(*S.TYPES.names)

    def restrict_to_file(self, file: int) -> TraceStore:
        """The same store, seen only at statements of one file; later additions are seen, too."""
        return TraceStore(self.spark, self.path, self.newest_first, file, self.at)

    def _append(self, points: DataFrame, types: DataFrame, ids: DataFrame, key: str, load: str, base: int, source, metadata: dict[str, str] | None) -> None:
        """Rows with key, the trace they belong to as of ids (key, id)."""
        into = lambda name: f"{self.path}/{name}/load={load}"
        rows = points.join(ids, key).select(F.col("id").alias("trace_id"), *S.POINTS.names[1:]).withColumn("block", F.floor(F.col("trace_id") / self.BLOCK))
        rows.sortWithinPartitions("block", "statement").write.partitionBy("block").parquet(into("points"))
        types.join(ids, key).select(F.col("id").alias("trace_id"), *S.TYPES.names[1:]).write.parquet(into("types"))
        meta = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)).cast("map<string,string>")
        ids.select(F.col("id").alias("trace_id"), source.alias("source"), meta.alias("metadata")).write.parquet(into("traces"))
        self._commit(load, base, ids.count())

    def _commit(self, load: str, first: int, n: int) -> None:
        """An entry of the log, a file in a folder of its own: with it the load is there."""
        entry = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(entry, load, first, n)], LOG).coalesce(1).write.parquet(f"{self.path}/log/{entry}")

    def clean(self, hours: float = 24) -> int:
        """Removes folders of loads that began so long ago and aren't in the log; gives their number."""
        jvm = self.spark._jvm
        named, before, n = {r.load for r in TraceStore(self.spark, self.path)._loads()}, time.time_ns() - int(hours * 3600e9), 0
        for name in ("points", "types", "traces"):
            root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for f in files.listStatus(root):
                folder = f.getPath().getName()
                load = folder.removeprefix("load=")
                if folder != load and load not in named and int(load.split("-")[0]) < before:
                    files.delete(f.getPath(), True)
                    n += name == "points"
        return n

    def _load(self) -> tuple[str, int]:
        """A name for a load, by its beginning, and the first id of a range that none of them has."""
        taken = {r.first // self.RANGE for r in self._loads()}
        part = secrets.randbits(30)
        while part in taken:
            part = secrets.randbits(30)
        return f"{time.time_ns():020d}-{uuid.uuid4().hex}", part * self.RANGE

    def add_points(self, points: DataFrame, metadata: dict[str, str] | None = None, source: str = "memory", infer: bool = False) -> None:
        """Appends traces given as points (schema POINTS), numbered in order of their trace_id. Types come in order of first sight.

        infer gives variables without a format that of all values of their type in the trace.
        """
        load, base = self._load()
        ids = written(numbered(points.select("trace_id").distinct(), "trace_id", base))
        points = with_formats(points) if infer else points
        seen = first_seen(points, F.col("v.type").alias("type_name"), F.col("v.format").alias("format"), F.col("v.size").alias("size"))
        index = F.row_number().over(Window.partitionBy("trace_id").orderBy("first", "type_name", "format", "size")) - 1
        types = seen.select("trace_id", index.cast("int").alias("type_idx"), "type_name", "format", "size")
        self._append(points, types, ids, "trace_id", load, base, F.lit(source), metadata)

    def add_files(self, path: str | list[str], metadata: dict[str, str] | None = None, max_traces: int = 0, **options) -> None:
        """Appends each trace file as a trace, in order of paths, also those without points; types as in their headers.

        Malformed files, if on_error is skip, aren't numbered. The files are decoded once.
        """
        rows = written(files.decoded(files.trace_files(self.spark, path, max_traces), headers=True, **options).where("error is null"))
        load, base = self._load()
        heads = rows.where("counter is null")
        ids = written(numbered(heads, "source", base))
        types = heads.select("source", F.posexplode("types").alias("type_idx", "t")).select("source", "type_idx", "t.*")
        self._append(rows.where("counter is not null"), types, ids, "source", load, base, F.col("source"), metadata)

    def n_traces(self) -> int:
        return sum(r.n for r in self._loads())

    def trace_size(self, index: int) -> int:
        return self.points(self.trace_id(index)).count()

    def trace_id(self, index: int) -> int:
        """The id of the trace at an index; IndexError beyond the last."""
        loads = self._loads()
        n = sum(r.n for r in loads)
        if not 0 <= index < n:
            raise IndexError(f"trace {index} of {n}")
        left = n - 1 - index if self.newest_first else index
        for r in loads:
            if left < r.n:
                return r.first + left
            left -= r.n
        raise AssertionError

    def trace_types(self, index: int) -> list[str]:
        """Names of the trace's types, in the order of its header; those of different formats repeat."""
        rows = self.types().where(F.col("trace_id") == self.trace_id(index)).orderBy("type_idx")
        return [r.type_name for r in rows.select("type_name").collect()]

    def metadata(self) -> DataFrame:
        return self.traces().select("trace_id", "metadata")

    def get_trace(self, index: int, file: int | None = None) -> DataFrame:
        """Points of a trace in order, with file_id and stmt_id."""
        rows = self.points(self.trace_id(index))
        rows = rows.withColumns({"file_id": S.file_id(F.col("statement")), "stmt_id": S.stmt_id(F.col("statement"))})
        return (rows.where(F.col("file_id") == file) if file is not None else rows).orderBy("counter")

    def query(self, index: int | None, *args, with_metadata: bool = False, **options) -> DataFrame:
        """binding.query() over a trace, or over all (None)."""
        found = binding.query(self.points(None if index is None else self.trace_id(index)), *args, **options)
        return found.join(self.metadata(), "trace_id", "left") if with_metadata else found

