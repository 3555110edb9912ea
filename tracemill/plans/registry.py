"""The registered queries over traces, and DuckDB SQL with the same results.

The traces are those of sources.adapters: one per user, a point per event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import ctypes as C
from tracemill.operators import binding, dictionary, memory
from tracemill.plans import predicate as P
from tracemill.plans import schema as S
from tracemill.scratch import scratch_dir
from tracemill.sources import files
from tracemill.sources.adapters import EVENT_FILES, as_text, events_as_points, inferred_formats, users_as_points, variable
from tracemill.store import TraceStore
from tracemill.streaming import ingest
from tracemill.streaming.memory import OUT, rocksdb, stream_pointer_sizes, write_pointer_sizes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

INT, DOUBLE, I64, U64, PTR, UINT = ["int"], ["double"], ["int64_t"], ["uint64_t"], ["*void"], ["unsigned int"]

_CASES = " ".join(f"WHEN '{t}' THEN {n}" for t, n in EVENT_FILES.items())
_EV = f"""ev AS (
  SELECT user_id AS trace_id, event_id AS counter, event_id % 16 AS stmt_id, CASE event_type {_CASES} ELSE 0 END AS file_id,
    event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
  FROM events
)"""
_ONE = "SELECT trace_id, counter, file_id, stmt_id, {pos} AS pos, '{name}' AS name, '{type}' AS type, {num} AS num, {dbl} AS dbl FROM ev"
_VARIABLES = (
    ("k", "int", "CAST(k AS HUGEINT)", "CAST(NULL AS DOUBLE)"),
    ("nk", "int", "CAST(-k AS HUGEINT)", "CAST(NULL AS DOUBLE)"),
    ("value", "double", "CAST(NULL AS HUGEINT)", "value"),
    ("v2", "double", "CAST(NULL AS HUGEINT)", "value * 2"),
    ("uid", "unsigned int", "CAST(trace_id AS HUGEINT)", "CAST(NULL AS DOUBLE)"),
    ("big", "int64_t", "CAST(9223372036854775807 AS HUGEINT) - counter", "CAST(NULL AS DOUBLE)"),
    ("ubig", "uint64_t", "CAST(18446744073709551615 AS HUGEINT) - counter", "CAST(NULL AS DOUBLE)"),
    ("p", "*void", "CAST(4096 * (counter % 4) + k AS HUGEINT)", "CAST(NULL AS DOUBLE)"),
)
_VARS = "vars AS (\n  " + "\n  UNION ALL ".join(_ONE.format(pos=i, name=n, type=t, num=num, dbl=d) for i, (n, t, num, d) in enumerate(_VARIABLES)) + "\n)"
_SIZED = """al AS (
  SELECT trace_id, counter, 4096 * (counter % 4) AS address, CASE WHEN event_type = 'signup' THEN 64 + k ELSE 0 END AS size
  FROM ev WHERE event_type IN ('signup', 'error')
), st AS (
  SELECT v.trace_id, v.counter, v.num AS pointer, a.address, arg_max(a.size, a.counter) AS size
  FROM vars v JOIN al a ON a.trace_id = v.trace_id AND a.counter <= v.counter WHERE v.type = '*void' GROUP BY ALL
), near AS (
  SELECT trace_id, counter, address + size - pointer AS room FROM st WHERE size > 0 AND address <= pointer
  QUALIFY row_number() OVER (PARTITION BY trace_id, counter ORDER BY address DESC) = 1
), sized AS (
  SELECT v.trace_id, v.counter, v.file_id, v.stmt_id, v.num, v.name, v.type, v.dbl, CASE WHEN n.room >= 0 THEN n.room END AS room
  FROM vars v LEFT JOIN near n USING (trace_id, counter) WHERE v.type = '*void'
)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_points(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _flat_sql(k: int) -> str:
    ids = "v0.trace_id, v0.counter, v0.file_id, v0.stmt_id"
    return ", ".join([ids, *(f"v{i}.name AS v{i}_name, v{i}.type AS v{i}_type, CAST(v{i}.num AS VARCHAR) AS v{i}_num, v{i}.dbl AS v{i}_dbl" for i in range(k))])


def _bind_sql(types: list[list[str]], where: str = "true", qualify: str = "", source: str = "vars") -> str:
    k = len(types)
    joins = "".join(f" JOIN {source} v{i} ON v{i}.trace_id = v0.trace_id AND v{i}.counter = v0.counter" for i in range(1, k))
    kinds = " AND ".join(f"v{i}.type IN ({', '.join(repr(t) for t in ts)})" for i, ts in enumerate(types))
    return f"WITH {_EV}, {_VARS} SELECT {_flat_sql(k)} FROM {source} v0{joins} WHERE {kinds} AND ({where}) {qualify}"


def _dedup_sql(k: int, last: bool = False) -> str:
    keys = ", ".join(f"v{i}.name, v{i}.type" for i in range(k))
    d = " DESC" if last else ""
    order = ", ".join([f"v0.counter{d}", *(f"v{i}.pos{d}" for i in range(k - 1, -1, -1))])
    return f"QUALIFY row_number() OVER (PARTITION BY v0.trace_id, v0.file_id, v0.stmt_id, {keys} ORDER BY {order}) = 1"


def _binding(name: str, types: list[list[str]], where: str = "true", qualify: str = "", **options) -> None:
    """A query by binding.query and its SQL."""
    k = len(types)
    options = {"dedup": None} | options

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return binding.flat(binding.query(_points(spark, sf_dir), "abcd"[:k], types, **options), k)

    _register(name, _bind_sql(types, where, qualify))(run)


V = lambda n: ("v/value", n)

_binding("bind_one", [DOUBLE])
_binding("bind_two", [INT, DOUBLE])
_binding("bind_three", [INT, INT, I64 + U64])
_binding("self_binding", [I64, I64])
_binding("distinct_bindings", [INT, INT], "v0.pos <> v1.pos", distinct_bindings=True)
_binding("distinct_vars", [INT, INT], "(v0.name, v0.num) IS DISTINCT FROM (v1.name, v1.num) AND v0.num > v1.num", _dedup_sql(2), predicate=("and", ("distinct-vars", "a", "b"), (">", V("a"), V("b"))), dedup="first")
_binding("cmp_gt", [INT], "v0.num > 50", predicate=(">", V("a"), 50))
_binding("cmp_ge", [INT], "v0.num >= 50", predicate=(">=", V("a"), 50))
_binding("cmp_lt", [INT], "v0.num < -50", predicate=("<", V("a"), -50))
_binding("cmp_le", [DOUBLE], "v0.dbl <= 12.5", predicate=("<=", V("a"), 12.5))
_binding("cmp_eq", [INT, INT], "v0.num = v1.num", predicate=("=", V("a"), V("b")))
_binding("bool_and", [INT, DOUBLE], "v0.num > 10 AND v1.dbl < 50", predicate=("and", (">", V("a"), 10), ("<", V("b"), 50)))
_binding("bool_or", [INT], "(v0.num > 10 AND v0.num < 20) OR v0.num = -7", predicate=("or", ("and", (">", V("a"), 10), ("<", V("a"), 20)), ("=", V("a"), -7)))
_binding("bool_not", [INT], "NOT (v0.num > 0)", predicate=("not", (">", V("a"), 0)))
_binding("not_invalid", [INT], "NOT coalesce(v0.num / nullif(v0.num - v0.num, 0) > 1, false)", predicate=("not", (">", ("/", V("a"), ("-", V("a"), V("a"))), 1)))
_binding("arith_add", [INT, INT], "v0.num + v1.num = 0", predicate=("=", ("+", V("a"), V("b")), 0))
_binding("arith_sub", [INT, INT], "v0.num - v1.num > 150", predicate=(">", ("-", V("a"), V("b")), 150))
_binding("arith_mul", [INT, INT], "v0.num * v1.num < -9000", predicate=("<", ("*", V("a"), V("b")), -9000))
_binding("arith_div", [INT, UINT], "coalesce(CAST(v0.num AS DOUBLE) / nullif(CAST(v1.num AS DOUBLE), 0) > 0.25, false)", predicate=(">", ("/", V("a"), V("b")), 0.25))
_binding("div_zero", [INT, INT], "coalesce(CAST(v0.num AS DOUBLE) / nullif(CAST(v1.num AS DOUBLE), 0) = 1, false)", predicate=("=", ("/", V("a"), V("b")), 1))
_binding("arith_mixed", [INT, DOUBLE], "v0.num + v1.dbl > 120", predicate=(">", ("+", V("a"), V("b")), 120))
_binding("overflow_i64", [I64, INT], "v0.num + v1.num > 9223372036854775807", predicate=(">", ("+", V("a"), V("b")), 9223372036854775807))
_binding("overflow_u64", [U64, U64], "v0.num + v1.num > 36893488147419100000", predicate=(">", ("+", V("a"), V("b")), 36893488147419100000))
_binding("exact_product", [U64, U64], "v0.pos = v1.pos AND v0.num >= 18446744073709551000", predicate=(">=", ("*", V("a"), V("b")), 18446744073709551000**2))
_binding("dedup_first", [DOUBLE, INT], "v1.num > 20", _dedup_sql(2), predicate=(">", V("b"), 20), dedup="first")
_binding("dedup_last", [DOUBLE, INT], "v1.num > 20", _dedup_sql(2, last=True), predicate=(">", V("b"), 20), dedup="last")
_binding("file_restrict", [INT], "v0.file_id = 3", file_id=3)
_binding("file_strict", [INT], "v0.file_id = 2", file_id=2, strict_file=True)
_binding("mask_filter", [DOUBLE], "v0.stmt_id % 4 = 2", mask=(3, 2))
_binding("result_filter", [INT], "v0.file_id = 1 AND v0.stmt_id < 8 AND v0.num % 2 = 0", result_filter=lambda r: (F.col("file_id") == 1) & (F.col("stmt_id") < 8) & (F.col("v0.num") % 2 == 0))
_binding("pick_point", [INT], "true", "QUALIFY rank() OVER (PARTITION BY v0.trace_id ORDER BY md5('17:' || v0.counter), v0.counter) = 1", pick=17)

_SCORE = "CAST(v0.num < 1 AS INTEGER)"
_binding("soft_one", [INT, DOUBLE], "true", f"QUALIFY {_SCORE} = max({_SCORE}) OVER (PARTITION BY v0.trace_id, v0.counter)", soft_predicates=[("<", V("a"), 1)])
_TWO = "CAST(v0.num < 1 AS INTEGER) + CAST(v0.num < v1.num AS INTEGER)"
_binding("soft_two", [INT, INT], "v0.num <> 40", f"QUALIFY {_TWO} = max({_TWO}) OVER (PARTITION BY v0.trace_id, v0.counter)", predicate=("not", ("=", V("a"), 40)), soft_predicates=[("<", V("a"), 1), ("<", V("a"), V("b"))])


_PRODUCT = "CAST(v0.num * v1.num < -100 AS INTEGER) + CAST(v0.num > 0 AS INTEGER)"
_binding("soft_product", [INT, INT], "v0.num * v1.num <> 0", f"QUALIFY {_PRODUCT} = max({_PRODUCT}) OVER (PARTITION BY v0.trace_id, v0.counter)", predicate=("not", ("=", ("*", V("a"), V("b")), 0)), soft_predicates=[("<", ("*", V("a"), V("b")), -100), (">", V("a"), 0)])
_THIRD = "CAST(v0.num * 3 = v1.num AND v0.num <> 0 AS INTEGER) + CAST(v0.num < v1.num AS INTEGER)"
_binding("soft_exact", [INT, UINT], "true", f"QUALIFY {_THIRD} = max({_THIRD}) OVER (PARTITION BY v0.trace_id, v0.counter)", soft_predicates=[("=", ("/", V("b"), V("a")), 3), ("<", V("a"), V("b"))], exact=True)


_binding("triple_product", [INT, UINT, I64], "v0.num * v1.num * v2.num < -5000000000000000000000", predicate=("<", ("*", ("*", V("a"), V("b")), V("c")), -5000000000000000000000))
_QUOTIENT = "v0.num <> 0 AND v2.num <> 0 AND v1.num * v2.num * sign(v0.num) * sign(v2.num) > v1.num * 2 * v0.num * sign(v0.num) * sign(v2.num)"
_binding("exact_quotients", [INT, UINT, INT], _QUOTIENT, predicate=(">", ("/", V("b"), V("a")), ("/", ("*", V("b"), 2), V("c"))), exact=True)


def _some_unflagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which every third has a statement without file; its bits are those of file 0."""
    s = F.col("statement")
    return _points(spark, sf_dir).withColumn("statement", F.when(F.col("counter") % 3 == 0, S.stmt_id(s)).otherwise(s))


def _by_file(name: str, strict: bool) -> None:
    rows = "CASE WHEN counter % 3 <> 0 THEN file_id END AS file_id"
    where = "counter % 3 <> 0 AND file_id = 0" if strict else "counter % 3 = 0 OR file_id = 0"

    @_register(name, f"WITH {_EV.replace('ELSE 0 END AS file_id', 'ELSE 0 END % 3 AS file_id')} SELECT trace_id, counter, {rows}, stmt_id FROM ev WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _some_unflagged(spark, sf_dir)
        s = F.col("statement")
        points = points.withColumn("statement", F.when(s < 0, S.encode_statement(S.file_id(s) % 3, S.stmt_id(s))).otherwise(s))
        return binding.query(points, file_id=0, strict_file=strict, dedup=None).select("trace_id", "counter", "file_id", "stmt_id")


_by_file("file_of_unflagged", False)
_by_file("file_strictly_flagged", True)


_WIDE = f"""{_EV}, en AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY counter) - 1 AS i FROM ev), wv AS (
  SELECT trace_id, 1 AS counter, 1 AS file_id, 1 AS stmt_id, 2 * i AS pos, event_type AS name, 'int' AS type, CAST(k AS HUGEINT) AS num, CAST(NULL AS DOUBLE) AS dbl FROM en
  UNION ALL SELECT trace_id, 1, 1, 1, 2 * i + 1, event_type, 'double', NULL, value FROM en
)"""


def _wide(name: str, types: list[list[str]], where: str, predicate: tuple) -> None:
    """A query of wide points, whose candidates are looked up."""

    @_register(name, _bind_sql(types, where, source="wv").replace(f"{_EV}, {_VARS}", _WIDE))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = users_as_points(spark.read.parquet(f"{sf_dir}/events.parquet"))
        return binding.flat(binding.query(points, "ab", types, predicate, dedup=None, indexed=True), 2)


_wide("bind_equal_join", [INT, INT], "v0.num + 1 = v1.num", ("=", ("+", V("a"), 1), V("b")))
_wide("bind_range_join", [DOUBLE, DOUBLE], "v1.dbl > v0.dbl AND v1.dbl <= v0.dbl + 1.0", ("and", (">", V("b"), V("a")), ("<=", V("b"), ("+", V("a"), 1))))


@_register(
    "store_query",
    f"WITH {_EV}, {_VARS} SELECT counter, file_id, stmt_id, name, CAST(num AS VARCHAR) AS num FROM vars WHERE type = 'int' AND num > 50 AND file_id IN (0, 3)",
)
def store_query(spark, sf_dir):
    """Traces of two loads, queried at the statements of two files."""
    points = _points(spark, sf_dir)
    store = TraceStore.create(spark, scratch_dir(spark))
    even = F.col("trace_id") % 2 == 0
    for part in (points.where(even), points.where(~even)):
        store.add_points(part)
    found = [store.restrict_to_file(f).query(None, ["a"], [INT], (">", V("a"), 50), dedup=None) for f in (0, 3)]
    return found[0].unionByName(found[1]).select("counter", "file_id", "stmt_id", F.col("v0.name").alias("name"), F.col("v0.num").cast("string").alias("num"))


@_register(
    "store_types",
    f"""WITH {_EV}, {_VARS}, seen AS (SELECT trace_id, type, min(counter * 100 + pos) AS first FROM vars GROUP BY ALL),
placed AS (SELECT trace_id, type, row_number() OVER (PARTITION BY trace_id ORDER BY first) - 1 AS type_idx FROM seen)
SELECT CAST(type_idx AS INTEGER) AS type_idx, type AS type_name, count(*) AS traces FROM placed GROUP BY ALL""",
)
def store_types(spark, sf_dir):
    """Types of all traces of a store, in order of first sight."""
    store = TraceStore.create(spark, scratch_dir(spark))
    store.add_points(_points(spark, sf_dir))
    return store.types().groupBy("type_idx", "type_name").agg(F.count("*").alias("traces"))


@_register("store_sizes", f"WITH {_EV}, n AS (SELECT trace_id, count(*) AS points FROM ev GROUP BY 1) SELECT points, 'b' AS k, count(*) AS traces FROM n GROUP BY ALL")
def store_sizes(spark, sf_dir):
    """How many traces of a store have how many points, with their metadata."""
    store = TraceStore.create(spark, scratch_dir(spark))
    store.add_points(_points(spark, sf_dir), {"k": "b"})
    sizes = store.points().groupBy("trace_id").agg(F.count("*").alias("points")).join(store.metadata(), "trace_id")
    return sizes.groupBy("points", F.col("metadata")["k"].alias("k")).agg(F.count("*").alias("traces"))


@_register("n_traces", "SELECT count(DISTINCT user_id) AS n FROM events")
def n_traces(spark, sf_dir):
    return _points(spark, sf_dir).agg(F.count_distinct("trace_id").alias("n"))


@_register("trace_size", "SELECT user_id AS trace_id, count(*) AS n FROM events GROUP BY 1")
def trace_size(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("trace_id").agg(F.count("*").alias("n"))


@_register("trace_types", f"WITH {_EV}, {_VARS} SELECT trace_id, type, count(*) AS n FROM vars GROUP BY ALL")
def trace_types(spark, sf_dir):
    return _points(spark, sf_dir).select("trace_id", F.explode("vars.type").alias("type")).groupBy("trace_id", "type").agg(F.count("*").alias("n"))


@_register("names", f"WITH {_EV}, {_VARS} SELECT DISTINCT trace_id, name FROM vars")
def names(spark, sf_dir):
    return _points(spark, sf_dir).select("trace_id", F.explode("vars.name").alias("name")).distinct()


@_register("get_trace", f"WITH {_EV} SELECT trace_id, counter, file_id, stmt_id, counter * 100 AS aux FROM ev")
def get_trace(spark, sf_dir):
    s = F.col("statement")
    return _points(spark, sf_dir).select("trace_id", "counter", S.file_id(s).alias("file_id"), S.stmt_id(s).alias("stmt_id"), F.col("aux")[0].alias("aux"))


@_register("get_trace_file", f"WITH {_EV} SELECT trace_id, counter, stmt_id FROM ev WHERE file_id = 4")
def get_trace_file(spark, sf_dir):
    s = F.col("statement")
    return _points(spark, sf_dir).where(S.file_id(s) == 4).select("trace_id", "counter", S.stmt_id(s).alias("stmt_id"))


@_register("statement_encode", f"WITH {_EV} SELECT counter, CAST(-9223372036854775808 + file_id * 1099511627776 + stmt_id AS BIGINT) AS statement FROM ev")
def statement_encode(spark, sf_dir):
    return _points(spark, sf_dir).select("counter", "statement")


@_register(
    "statement_decode",
    "SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey & 8388607 END AS file_id, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS stmt_id FROM lineitem",
)
def statement_decode(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = F.when(F.col("l_linenumber") % 2 == 0, S.encode_statement(F.col("l_orderkey").bitwiseAND(8388607), F.col("l_partkey"))).otherwise(F.col("l_suppkey"))
    rows = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), s.alias("s"))
    return rows.select("o", "n", S.file_id(F.col("s")).alias("file_id"), S.stmt_id(F.col("s")).alias("stmt_id"))


@_register("no_vars", f"WITH {_EV} SELECT trace_id, counter, file_id, stmt_id FROM ev QUALIFY row_number() OVER (PARTITION BY trace_id, file_id, stmt_id ORDER BY counter) = 1")
def no_vars(spark, sf_dir):
    return binding.query(_points(spark, sf_dir)).select("trace_id", "counter", "file_id", "stmt_id")


@_register("memory_map", f"WITH {_EV}, {_VARS}, {_SIZED} SELECT trace_id, counter, CAST(num AS BIGINT) AS pointer, CAST(room AS BIGINT) AS buffer_size FROM sized")
def memory_map(spark, sf_dir):
    found = memory.pointer_sizes(_points(spark, sf_dir))
    return found.select("trace_id", "counter", F.col("pointer").cast("long").alias("pointer"), F.col("buffer_size").cast("long").alias("buffer_size"))


@_register(
    "memory_free",
    f"WITH {_EV}, {_VARS}, {_SIZED} SELECT s.trace_id, s.address, count(*) AS pointers, count(*) FILTER (WHERE s.size = 0) AS freed FROM st s GROUP BY ALL",
)
def memory_free(spark, sf_dir):
    """Of each address how many pointers came after it was first allocated or freed, and after it was last freed."""
    found = memory.pointers_by_address(_points(spark, sf_dir))
    return found.select("trace_id", F.col("address").cast("long").alias("address"), "pointers", "freed")


_WORDS = f"""{_EV}, wd AS (
  SELECT trace_id, counter, 0 AS ord, 16 * (counter % 8) AS address, counter % 3 * 8 AS size FROM ev WHERE counter % 2 = 0
  UNION ALL SELECT trace_id, counter, 1, 16 * (counter % 8), (counter + 1) % 4 * 8 FROM ev WHERE counter % 6 = 0
  UNION ALL SELECT trace_id, counter, 2, 48, counter % 5 FROM ev WHERE counter % 4 = 0
), wl AS (
  SELECT e.trace_id, e.counter, e.counter % 3 AS n, w.address, arg_max(w.size, 4 * w.counter + w.ord) AS size
  FROM ev e JOIN wd w ON w.trace_id = e.trace_id AND w.counter <= e.counter GROUP BY ALL
)"""


@_register(
    "memory_words",
    f"WITH {_WORDS} SELECT trace_id, address, CAST(sum(n) AS BIGINT) AS pointers, CAST(coalesce(sum(n) FILTER (WHERE size = 0), 0) AS BIGINT) AS freed FROM wl GROUP BY trace_id, address",
)
def memory_words(spark, sf_dir):
    """As memory_free, of points with up to three words, some on one address, and 0 to 2 pointers."""
    c = F.col("counter")
    word = lambda when, address, size: F.when(when, F.array(F.struct(address.cast(S.NUM).alias("address"), size.cast(S.NUM).alias("size")))).otherwise(F.array().cast(S.POINTS["sizes"].dataType))
    sizes = F.concat(word(c % 2 == 0, c % 8 * 16, c % 3 * 8), word(c % 6 == 0, c % 8 * 16, (c + 1) % 4 * 8), word(c % 4 == 0, F.lit(48), c % 5))
    held = F.slice(F.array(*(variable(i, "p", "*void", "POINTER", 8, c) for i in range(2))), 1, (c % 3).cast("int"))
    found = memory.pointers_by_address(_points(spark, sf_dir).withColumns({"sizes": sizes, "vars": held}))
    return found.select("trace_id", F.col("address").cast("long").alias("address"), "pointers", "freed")


_OVERLAP = f"""{_EV}, oa AS (
  SELECT trace_id, counter, 16 * (counter % 8) AS address, CASE counter % 3 WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 24 END AS size FROM ev WHERE counter % 2 = 0 OR event_type = 'signup'
), ot AS (
  SELECT e.trace_id, e.counter, e.counter * 7 % 256 AS pointer, a.address, arg_max(a.size, a.counter) AS size
  FROM ev e JOIN oa a ON a.trace_id = e.trace_id AND a.counter <= e.counter GROUP BY ALL
), near AS (
  SELECT trace_id, counter, address + size - pointer AS room FROM ot WHERE size > 0 AND address <= pointer
  QUALIFY row_number() OVER (PARTITION BY trace_id, counter ORDER BY address DESC) = 1
)"""


@_register(
    "memory_overlap",
    f"WITH {_OVERLAP} SELECT e.trace_id, e.counter, e.counter * 7 % 256 AS pointer, CASE WHEN room >= 0 THEN room END AS buffer_size FROM ev e LEFT JOIN near USING (trace_id, counter)",
)
def memory_overlap(spark, sf_dir):
    """Allocations that overlap: one beneath a nearer one isn't consulted."""
    c = F.col("counter")
    size = F.when(c % 3 == 0, 0).when(c % 3 == 1, 200).otherwise(24)
    alloc = F.array(F.struct((c % 8 * 16).cast(S.NUM).alias("address"), size.cast(S.NUM).alias("size")))
    signup = F.shiftrightunsigned("statement", S.NODE_BITS).bitwiseAND(F.lit(S.FILE_MASK)) == EVENT_FILES["signup"]
    points = _points(spark, sf_dir).withColumn("sizes", F.when((c % 2 == 0) | signup, alloc).otherwise(F.array().cast(S.POINTS["sizes"].dataType)))
    points = points.withColumn("vars", F.array(variable(0, "p", "*void", "POINTER", 8, c * 7 % 256)))
    found = memory.pointer_sizes(points)
    return found.select("trace_id", "counter", F.col("pointer").cast("long").alias("pointer"), F.col("buffer_size").cast("long").alias("buffer_size"))


@_register("var_size", f"WITH {_EV}, {_VARS}, {_SIZED} SELECT trace_id, counter, CAST(num AS BIGINT) AS pointer, CAST(room AS BIGINT) AS room FROM sized WHERE room > 40")
def var_size(spark, sf_dir):
    points = memory.with_sizes(_points(spark, sf_dir), PTR)
    found = binding.query(points, ["p"], [PTR], (">", ("v/size", "p"), 40), dedup=None)
    return found.select("trace_id", "counter", F.col("v0.num").cast("long").alias("pointer"), F.col("v0.buffer_size").cast("long").alias("room"))


@_register("exact_division", _bind_sql([INT, UINT], "v0.num * 3 = v1.num"))
def exact_division(spark, sf_dir):
    """Quotients as fractions: v1 / v0 = 3 only where it is so."""
    found = binding.query(_points(spark, sf_dir), "ab", [INT, UINT], ("and", ("not", ("=", V("a"), 0)), ("=", ("/", V("b"), V("a")), 3)), dedup=None, exact=True)
    zero = binding.query(_points(spark, sf_dir), "ab", [INT, UINT], ("and", ("=", V("a"), 0), ("=", V("b"), 0)), dedup=None)
    return binding.flat(found.unionByName(zero), 2)


@_register("predicate_text", _bind_sql([INT, DOUBLE], "NOT (v0.num > v1.dbl) OR v0.num = 3"))
def predicate_text(spark, sf_dir):
    p = P.parse("(or (not (> (v/value a) (v/value b))) (equal (v/value a) 3))")
    return binding.flat(binding.query(_points(spark, sf_dir), "ab", [INT, DOUBLE], P.parse(P.show(p)), dedup=None), 2)


_LISTING = f"WITH {_EV}, {_VARS} SELECT trace_id, counter, file_id, stmt_id, pos, name, type, CAST(num AS VARCHAR) AS num, dbl FROM vars"


@_register("binary_round_trip", _LISTING)
def binary_round_trip(spark, sf_dir):
    """Every trace written in the binary format and read back."""
    back = files.round_trip(_points(spark, sf_dir))
    s = F.col("statement")
    rows = back.select("trace_id", "counter", S.file_id(s).alias("file_id"), S.stmt_id(s).alias("stmt_id"), F.explode("vars").alias("v"))
    return rows.select("trace_id", "counter", "file_id", "stmt_id", "v.pos", "v.name", "v.type", F.col("v.num").cast("string").alias("num"), F.col("v.dbl").alias("dbl"))


@_register("sexp_scan", f"WITH {_EV} SELECT counter, file_id, stmt_id, CAST(k AS BIGINT) AS k, value, counter % 7 AS aux FROM ev")
def sexp_scan(spark, sf_dir):
    """Each event as an s-expression, parsed."""
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("c"), F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("v"), "event_type")
    code = F.coalesce(*(F.when(F.col("event_type") == t, n) for t, n in EVENT_FILES.items()), F.lit(0))
    text = F.concat(F.lit("((:c . "), F.col("c") % 16, F.lit(") (:f . "), code, F.lit(') (:scopes ("k" "int" '), F.col("k"), F.lit(' nil) #("value" "double" '), F.format_string("%s", F.col("v")), F.lit(" nil)) (:aux "), F.col("c") % 7, F.lit("))"))
    found = files.decoded(points.select(F.col("c").cast("string").alias("path"), text.cast("binary").alias("content")), "sexp")
    s, v = F.col("statement"), F.col("vars")
    return found.select(F.col("source").cast("long").alias("counter"), S.file_id(s).alias("file_id"), S.stmt_id(s).alias("stmt_id"), v[0]["num"].cast("long").alias("k"), v[1]["dbl"].alias("value"), F.col("aux")[0].alias("aux"))


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, as the table may be a file or a folder


def _streamed(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f over the events as a stream of points, run until nothing is left."""
    found, out = f(events_as_points(_arriving(spark, sf_dir))), scratch_dir(spark)
    run = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@_register("stream_bind", _bind_sql([INT], "v0.num > 90"))
def stream_bind(spark, sf_dir):
    """A binding query over a stream."""
    return _streamed(spark, sf_dir, lambda points: binding.flat(ingest.stream_query(points, ["a"], [INT], predicate=(">", V("a"), 90)), 1))


@_register("stream_memory", ORACLES["memory_map"])
def stream_memory(spark, sf_dir):
    """Pointer sizes over a stream, with allocations as a table of state."""
    out = scratch_dir(spark)
    write_pointer_sizes(events_as_points(_arriving(spark, sf_dir)), out, f"{out}-live", f"{out}-state").awaitTermination()
    found = spark.read.schema(OUT).parquet(out)
    return found.select("trace_id", "counter", F.col("pointer").cast("long").alias("pointer"), F.col("buffer_size").cast("long").alias("buffer_size"))


@_register("stream_state", ORACLES["memory_map"])
def stream_state(spark, sf_dir):
    """Pointer sizes over a stream, with allocations in the state store."""
    with rocksdb(spark):
        found = _streamed(spark, sf_dir, stream_pointer_sizes)
    return found.where("not late").select("trace_id", "counter", F.col("pointer").cast("long").alias("pointer"), F.col("buffer_size").cast("long").alias("buffer_size"))


@_register("max_points", f"WITH {_EV} SELECT trace_id, counter, stmt_id FROM ev QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY counter) <= 5")
def max_points(spark, sf_dir):
    return binding.first_points(_points(spark, sf_dir), 5).select("trace_id", "counter", S.stmt_id(F.col("statement")).alias("stmt_id"))


@_register(
    "inferred_load",
    f"""WITH {_EV}, v AS (
  SELECT trace_id, 'offset' AS type, CASE WHEN counter % 2 = 0 THEN k ELSE -k * 300 END AS n, false AS f, false AS t FROM ev
  UNION ALL SELECT trace_id, 'id', trace_id * 70000, false, false FROM ev
  UNION ALL SELECT trace_id, 'mixed', k, counter % 5 = 0, false FROM ev
  UNION ALL SELECT trace_id, 'any', k, counter % 5 = 0, counter % 7 = 0 FROM ev
), g AS (SELECT trace_id, type, min(n) AS low, max(n) AS high, bool_or(f) AS f, bool_or(t) AS t FROM v GROUP BY ALL)
SELECT type AS type_name, CASE WHEN t THEN 'BLOB' WHEN f THEN 'FLOAT' WHEN low < 0 THEN 'SIGNED' ELSE 'UNSIGNED' END AS format,
  CASE WHEN t THEN 0 WHEN f THEN 8 WHEN low < 0 AND low >= -128 AND high < 128 THEN 1 WHEN low < 0 AND low >= -32768 AND high < 32768 THEN 2 WHEN low < 0 THEN 4
    WHEN high < 256 THEN 1 WHEN high < 65536 THEN 2 WHEN high < 4294967296 THEN 4 ELSE 8 END AS size, count(*) AS traces
FROM g GROUP BY ALL""",
)
def inferred_load(spark, sf_dir):
    """Types of a store whose points came without formats: integers of either sign, floats and text under one name."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    c, k, none = F.col("event_id"), F.get_json_object("props", "$.k").cast("int"), F.lit(None)

    def bare(pos: int, type_name: str, num, dbl=none, blob=none):
        plain = variable(pos, type_name, type_name, "SIGNED", 0, num)
        return plain.withField("format", none.cast("string")).withField("size", none.cast("int")).withField("dbl", dbl.cast("double")).withField("blob", blob.cast("binary"))

    fifth, seventh = c % 5 == 0, c % 7 == 0
    held = F.array(
        bare(0, "offset", F.when(c % 2 == 0, k).otherwise(-k * 300)),
        bare(1, "id", F.col("user_id") * 70000),
        bare(2, "mixed", F.when(~fifth, k), F.when(fifth, F.col("value"))),
        bare(3, "any", F.when(~fifth & ~seventh, k), F.when(fifth & ~seventh, F.col("value")), F.when(seventh, F.col("event_type"))),
    )
    store = TraceStore.create(spark, scratch_dir(spark))
    store.add_points(events_as_points(events, held), infer=True)
    return store.types().groupBy("type_name", "format", "size").agg(F.count("*").alias("traces"))


@_register("names_indexed", f"WITH {_EV}, {_VARS}, s AS (SELECT trace_id, name, min(counter * 100 + pos) AS first FROM vars GROUP BY ALL) SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY first) - 1 AS INTEGER) AS index, name FROM s")
def names_indexed(spark, sf_dir):
    return dictionary.names(_points(spark, sf_dir))


@_register(
    "types_indexed",
    f"WITH {_WIDE}, s AS (SELECT trace_id, name, type, min(pos) AS first FROM wv GROUP BY ALL) SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY first) - 1 AS INTEGER) AS index, name || ' ' || type AS type FROM s",
)
def types_indexed(spark, sf_dir):
    """Types named by event and kind, so that traces have different ones in different order."""
    points = users_as_points(spark.read.parquet(f"{sf_dir}/events.parquet"))
    points = points.withColumn("vars", F.transform("vars", lambda v: v.withField("type", F.concat_ws(" ", v["name"], v["type"]))))
    return dictionary.types(points).select("trace_id", "index", "type")


@_register("dictionary_round_trip", f"WITH {_EV}, {_VARS} SELECT trace_id, counter, file_id, stmt_id, pos, name, type, CAST(num AS VARCHAR) AS num, dbl FROM vars")
def dictionary_round_trip(spark, sf_dir):
    """Points with indices for names and types, decoded."""
    points = _points(spark, sf_dir)
    names_, types_ = dictionary.names(points), dictionary.types(points)
    back = dictionary.decoded(dictionary.encoded(points, names_, types_), names_, types_)
    s = F.col("statement")
    rows = back.select("trace_id", "counter", S.file_id(s).alias("file_id"), S.stmt_id(s).alias("stmt_id"), F.explode("vars").alias("v"))
    return rows.select("trace_id", "counter", "file_id", "stmt_id", "v.pos", "v.name", "v.type", F.col("v.num").cast("string").alias("num"), F.col("v.dbl").alias("dbl"))


@_register("max_points_long", f"WITH {_EV} SELECT counter, stmt_id FROM ev QUALIFY row_number() OVER (ORDER BY counter) <= greatest(1001, (SELECT count(*) FROM events) // 2)")
def max_points_long(spark, sf_dir):
    """The first half of all events, as one long trace."""
    points = _points(spark, sf_dir).withColumn("trace_id", F.lit(1).cast("long"))
    half = max(1001, points.count() // 2)
    return binding.first_points(points, half).select("counter", S.stmt_id(F.col("statement")).alias("stmt_id"))


@_register("inferred_formats", f"WITH {_EV}, {_VARS} SELECT type, CASE WHEN bool_or(num < 0) THEN 'SIGNED' ELSE 'UNSIGNED' END AS format FROM vars WHERE num IS NOT NULL GROUP BY type")
def inferred(spark, sf_dir):
    values = _points(spark, sf_dir).select(F.explode("vars").alias("v")).select("v.type", "v.num").where("num is not null")
    return inferred_formats(values)


@_register("text_dump", f"WITH {_EV}, {_VARS} SELECT trace_id, counter, file_id || ':' || stmt_id || ' ' || string_agg(name || ' ' || type || '=' || coalesce(CAST(num AS VARCHAR), CAST(dbl AS VARCHAR)), ' ' ORDER BY pos) AS line FROM vars GROUP BY trace_id, counter, file_id, stmt_id")
def text_dump(spark, sf_dir):
    """Points as lines."""
    return as_text(_points(spark, sf_dir))


#: Type strings made of the rows of part.
_BASES = ("int", "const char", "unsigned long int", "static volatile double", "std::string", "struct_t")
_TYPE_SQL = "repeat('*', CAST(p_partkey % 3 AS INTEGER)) || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '[]' ELSE '[' || p_size || ']' END || CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BASES)) + " END"


def _type_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    dims = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "[]").otherwise(F.concat(F.lit("["), F.col("p_size"), F.lit("]")))
    base = F.coalesce(*(F.when(F.col("p_partkey") % 6 == i, b) for i, b in enumerate(_BASES)))
    return part.select("p_partkey", F.concat(F.repeat(F.lit("*"), (F.col("p_partkey") % 3).cast("int")), dims, base).alias("t"))


_T = f"WITH t AS (SELECT p_partkey, {_TYPE_SQL} AS t FROM part), s AS (SELECT *, regexp_replace(t, '^(\\*|\\[[^\\[\\]]*\\])+', '') AS plain FROM t), b AS (SELECT *, trim(regexp_replace(plain, '\\b(const|static|volatile) ', '', 'g')) AS base FROM s)"


@_register("type_strip", f"{_T} SELECT p_partkey, t, plain, base FROM b")
def type_strip(spark, sf_dir):
    t = F.col("t")
    return _type_strings(spark, sf_dir).select("p_partkey", "t", C.stripped(t).alias("plain"), C.base_typename(t).alias("base"))


@_register("type_ptr_count", f"{_T} SELECT p_partkey, length(t) - length(replace(t, '*', '')) AS pointers FROM b")
def type_ptr_count(spark, sf_dir):
    return _type_strings(spark, sf_dir).select("p_partkey", C.pointer_count(F.col("t")).alias("pointers"))


@_register("type_dims", f"{_T} SELECT p_partkey, array_to_string(regexp_extract_all(t, '\\[([^\\[\\]]*)\\]', 1), ',') AS dims, len(regexp_extract_all(t, '\\[')) AS n FROM b")
def type_dims(spark, sf_dir):
    d = C.array_dims(F.col("t"))
    return _type_strings(spark, sf_dir).select("p_partkey", F.array_join(d, ",").alias("dims"), F.size(d).alias("n"))


@_register(
    "type_format",
    f"""{_T}, q AS (SELECT *, contains(t, '*') AS ptr, contains(t, '[') AS arr FROM b)
SELECT p_partkey,
  CASE WHEN ptr OR arr THEN 'POINTER' WHEN base = 'int' OR base = 'char' THEN 'SIGNED' WHEN base = 'unsigned long int' THEN 'UNSIGNED' WHEN base = 'double' THEN 'FLOAT' END AS format,
  CASE WHEN ptr OR arr THEN 8 WHEN base = 'int' THEN 4 WHEN base = 'char' THEN 1 WHEN base IN ('unsigned long int', 'double') THEN 8 END AS size,
  CASE WHEN (base = 'char' AND ptr <> arr) OR (base = 'std::string' AND NOT ptr AND NOT arr) THEN 'BLOB' WHEN ptr OR arr THEN 'POINTER' WHEN base = 'int' OR base = 'char' THEN 'SIGNED' WHEN base = 'unsigned long int' THEN 'UNSIGNED' WHEN base = 'double' THEN 'FLOAT' END AS printed
FROM q""",
)
def type_format(spark, sf_dir):
    t = F.col("t")
    return _type_strings(spark, sf_dir).select("p_partkey", C.type_format(t).alias("format"), C.type_size(t).alias("size"), C.type_format(t, True).alias("printed"))


@_register("type_round_trip", f"{_T} SELECT p_partkey, t FROM b")
def type_round_trip(spark, sf_dir):
    """Type strings taken apart and put together again."""
    t = F.col("t")
    parts = _type_strings(spark, sf_dir).select("p_partkey", C.pointer_count(t).alias("n"), C.array_dims(t).alias("dims"), F.split(C.stripped(t), " ").alias("words"))
    return parts.select("p_partkey", C.type_string(F.col("n"), F.col("dims"), F.col("words")).alias("t"))
