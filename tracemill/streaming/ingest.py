"""Streams of trace files, and queries that keep pace with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators import binding
from tracemill.plans import schema as S
from tracemill.sources import files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def trace_stream(spark: SparkSession, landing: str, **options) -> DataFrame:
    """Points of the trace files that arrive in a folder; malformed files are skipped by default. A trace's id is a hash of its path."""
    arriving = spark.readStream.format("binaryFile").schema(_FILES).load(landing)
    found = files.decoded(arriving, **({"on_error": "skip"} | options)).where("error is null")
    return found.select(F.xxhash64("source").alias("trace_id"), *S.POINTS.names[1:])


def ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, timeout: float | None = None, **options) -> StreamingQuery:
    """Appends arriving traces to a Parquet table; with a timeout it waits so long for the files that are there, and stops."""
    query = trace_stream(spark, landing, **options).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    if timeout is None:
        return query.start()
    running = query.trigger(availableNow=True).start()
    running.awaitTermination(int(timeout))
    running.stop()
    return running


def stream_query(points: DataFrame, *args, **options) -> DataFrame:
    """A binding query over a stream of points; each point by itself, so duplicates stay and no state is kept."""
    return binding.query(points, *args, **(options | {"dedup": None}))
