"""Formats, the store, streams, type strings."""

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tracemill.functions import ctypes as C
from tracemill.sources import codec, files
from tracemill.store import TraceStore
from tracemill.streaming import ingest


def sample():
    text = b"hello, world"
    return [
        codec.Point(
            100 + i,
            [(0xFF + i, 10 * i)],
            [
                codec.Variable("i", "int", "SIGNED", 4, i - 3),
                codec.Variable("ptr", "*char", "POINTER", 8, 0xFF + i),
                codec.Variable("c", "char", "SIGNED", 1, text[i]),
                codec.Variable("f", "float", "FLOAT", 4, struct.unpack("<f", struct.pack("<f", 0.1 * i))[0]),
                codec.Variable("d", "double", "FLOAT", 8, 0.2 * i),
                codec.Variable("u", "unsigned int", "UNSIGNED", 4, 2 * i),
                codec.Variable("ptr", "string", "BLOB", 0, text[i:]),
                codec.Variable("five", "five", "BLOB", 5, text[i % 7 : i % 7 + 5]),
            ],
            [100 * i],
        )
        for i in range(10)
    ]


def test_binary_round_trip():
    data = codec.encode(sample())
    types, back = codec.decode(data)
    assert [t[0] for t in types] == ["int", "*char", "char", "float", "double", "unsigned int", "string", "five"]
    assert [p.vars[1].buffer_size for p in back] == [None] + [10 * i for i in range(1, 10)]
    for p in back:
        p.vars[1].buffer_size = None
    assert back == sample()
    assert len(codec.decode(data, 3)[1]) == 3
    assert codec.decode(codec.encode([])) == ([], [])


def test_corruption():
    data = codec.encode(sample()[:1])
    head = len(codec.encode([])) + sum(len(n) + 1 for n in ("int", "i", "*char", "ptr", "char", "c", "float", "f", "double", "d", "unsigned int", "u", "string", "five")) + 12 * 8
    boundaries = 0
    for n in range(len(data)):
        try:
            assert codec.decode(data[:n])[1] == []
            boundaries += n >= head
        except codec.TraceEOFError:
            pass
    assert boundaries == 1 + 1 + 1 + 8 + 1  # the header's end, and after each entry but the last
    for bad in (b"\x07", struct.pack("<BII", 2, 99, 0), struct.pack("<BII", 2, 0, 99)):
        with pytest.raises(codec.TraceError):
            codec.decode(data + bad)
    with pytest.raises(codec.TraceError):
        codec.decode(struct.pack("<Q", 2) + b"a\0" + struct.pack("<IIII", 1, 0, 5, 4))
    with pytest.raises(codec.TraceError):
        codec.decode(struct.pack("<Q", 2) + b"a\0" + struct.pack("<IIII", 1, 3, 1, 4))
    with pytest.raises(ValueError):
        codec.decode(data, -1)


def test_sexp():
    text = '((:c . 5) (:f . 2) (:scopes #("x" "int" -1 nil) ("s" "string" "a\\"b" nil)) (:aux 7 8))\n((:c . 6)) ; end\n((:c . 7)) (oops'
    with pytest.raises(codec.TraceError):
        codec.decode_sexp(text)
    got = codec.decode_sexp(text, ignore_rest=True)
    assert [p.statement for p in got] == [1 << 63 | 2 << 40 | 5, 6, 7]
    assert got[0].aux == [7, 8] and [v.value for v in got[0].vars] == [-1, b'a"b']
    assert len(codec.decode_sexp(text, 2)) == 2
    assert len(codec.decode_sexp(text, while_=lambda e: codec._field(e, ":c") != 6)) == 1


def test_store_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.trace").write_bytes(codec.encode(sample()[: 3 + k]))
    (tmp_path / "in/9.trace").write_bytes(b"broken")
    src = str(tmp_path / "in")
    with pytest.raises(Exception):
        files.read_traces(spark, src).collect()
    bad = files.read_traces(spark, src, on_error="skip").where("error is not null").collect()
    assert len(bad) == 1 and bad[0].source.endswith("9.trace")
    store = TraceStore.create(spark, str(tmp_path / "store"))
    assert store.n_traces() == 0
    store.add_files(src, {"program": "sample"}, on_error="skip")
    assert store.n_traces() == 3 and [store.trace_size(i) for i in range(3)] == [3, 4, 5]
    assert store.trace_types(0)[:2] == ["int", "*char"]
    assert store.metadata().first().metadata == {"program": "sample"}
    assert [r.stmt_id for r in store.get_trace(1).collect()] == [100, 101, 102, 103]
    with pytest.raises(IndexError):
        store.trace_size(3)
    newest = TraceStore.open(spark, str(tmp_path / "store"), newest_first=True)
    assert newest.trace_size(0) == 5
    found = store.query(2, ["a"], [["int"]], (">", ("v/value", "a"), 0), with_metadata=True)
    assert [(r.counter, r.metadata["program"]) for r in found.collect()] == [(4, "sample")]
    assert store.restrict_to_file(0).points().count() == 12 and store.restrict_to_file(1).points().count() == 0

    ingest.ingest(spark, src, str(tmp_path / "live"), str(tmp_path / "state"), timeout=60)
    assert spark.read.parquet(str(tmp_path / "live")).count() == 12


def test_encoded_parts_come_back(spark):
    rows = [files._row("s", i, p) for i, p in enumerate(codec.decode(codec.encode(sample()), memory_map=False)[1])]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], files.DECODED).withColumn("trace_id", F.lit(1).cast("long"))
    back = files.decoded(files.encoded(df, chunk=4).select(F.col("part").cast("string").alias("path"), "content"), memory_map=False)
    assert back.count() == 10
    keep = ("statement", "sizes", "vars", "aux")
    assert sorted(map(str, back.select(*keep).collect())) == sorted(map(str, df.select(*keep).collect()))


@pytest.mark.parametrize(
    "t, pointers, dims, base, format_, size",
    [
        ("int", 0, [], "int", "SIGNED", 4),
        ("*int", 1, [], "int", "POINTER", 8),
        ("[]int", 0, [""], "int", "POINTER", 8),
        ("[5]int", 0, ["5"], "int", "POINTER", 8),
        ("*[]int", 1, [""], "int", "POINTER", 8),
        ("*[5]int", 1, ["5"], "int", "POINTER", 8),
        ("const int", 0, [], "int", "SIGNED", 4),
        ("volatile int", 0, [], "int", "SIGNED", 4),
        ("*restrict int", 1, [], "int", "POINTER", 8),
        ("static int", 0, [], "int", "SIGNED", 4),
        ("unsigned long int", 0, [], "unsigned long int", "UNSIGNED", 8),
        ("double", 0, [], "double", "FLOAT", 8),
        ("struct_t", 0, [], "struct_t", None, None),
    ],
)
def test_type_strings(spark, t, pointers, dims, base, format_, size):
    c = F.lit(t)
    r = spark.range(1).select(C.pointer_count(c), C.array_dims(c), C.base_typename(c), C.type_format(c), C.type_size(c), C.type_string(C.pointer_count(c), C.array_dims(c), F.split(C.stripped(c), " "))).first()
    assert tuple(r) == (pointers, dims, base, format_, size, t)


def test_strings_and_names(spark):
    check = lambda f, t: spark.range(1).select(f(F.lit(t))).first()[0]
    assert [check(C.is_string, t) for t in ("*char", "[9]const char", "*[9]char", "char", "std::string", "*string")] == [True, True, False, False, True, False]
    assert check(lambda c: C.type_format(c, True), "*char") == "BLOB" and check(lambda c: C.type_size(c, True), "*char") == 0
    assert [check(C.is_traceable_name, n) for n in ("x", "_y1", "1z", "__attribute__", "a.b")] == [True, True, False, False, False]


def test_store_keeps_every_trace(spark, tmp_path):
    """Empty traces have an index, malformed files none; types come as the header has them; ids of loads don't meet."""
    src = tmp_path / "in"
    src.mkdir()
    one = codec.encode(sample()[:1])
    unused = struct.pack("<Q", 6) + b"b\0a\0c\0" + struct.pack("<IIIIIIIIII", 3, 0, 1, 4, 1, 0, 8, 0, 1, 4)
    for name, data in (("0", one), ("1", unused), ("2", b"broken"), ("3", codec.encode(sample()[:2]))):
        (src / f"{name}.trace").write_bytes(data)
    store = TraceStore.create(spark, str(tmp_path / "store"))
    store.add_files(str(src), on_error="skip")
    assert store.n_traces() == 3 and [store.trace_size(i) for i in range(3)] == [1, 0, 2]
    assert store.trace_types(1) == ["b", "a", "b"]
    newest = TraceStore.open(spark, store.path, newest_first=True)
    assert [newest.trace_size(i) for i in range(3)] == [2, 0, 1]
    store.add_points(store.points(store.trace_id(2)), {"k": "v"})
    store.add_files(str(src), on_error="keep", max_traces=2)
    assert store.n_traces() == 6 and [store.trace_size(i) for i in range(6)] == [1, 0, 2, 2, 1, 0]
    assert len({r.trace_id for r in store.traces().collect()}) == 6
    assert store.trace_types(3) == store.trace_types(2) and store.metadata().where("metadata['k'] = 'v'").count() == 1


def test_decoding_options(spark):
    data = codec.encode(sample()[:3])
    rows = spark.createDataFrame([("a", bytearray(data + b"\x07")), ("b", bytearray(b"x"))], "path string, content binary")
    kept = files.decoded(rows, on_error="keep")
    assert kept.where("source = 'a' and error is null").count() == 3 and kept.where("source = 'b'").first().error
    text = spark.createDataFrame([("t", bytearray(b"((:c . 1)) ((:c . 2)) ((:c . 3)) ((:c . 1))"))], "path string, content binary")
    assert [r.statement for r in files.decoded(text, "sexp", while_=lambda e: codec._field(e, ":c") < 3).collect()] == [1, 2]


def test_blob_text(spark):
    from tracemill.plans.schema import bits, blob_text, unsigned

    rows = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xff"),), (None,)], "b binary")
    assert [r[0] for r in rows.select(blob_text(F.col("b"))).collect()] == ["é", None, None]
    big = spark.sql("select cast(18446744073709551615 as decimal(20,0)) n union all select 5 union all select null")
    assert sorted(str(r[0]) for r in big.select(unsigned(bits(F.col("n")))).collect()) == ["18446744073709551615", "5", "None"]


def test_stream_state(spark, tmp_path):
    """Allocations of one file of a stream are known to the next."""
    from decimal import Decimal

    from tracemill.plans.schema import POINTS
    from tracemill.streaming.memory import rocksdb, stream_pointer_sizes

    def point(counter, pointer, sizes):
        v = (0, "p", "*void", "POINTER", 8, Decimal(pointer), None, None, None)
        return (1, counter, 1, [(Decimal(a), Decimal(s)) for a, s in sizes], [v], [])

    src = str(tmp_path / "in")
    for c, (p, sizes) in enumerate([(15, [(10, 8)]), (16, []), (10, [(10, 0)])]):
        spark.createDataFrame([point(c, p, sizes)], POINTS).coalesce(1).write.mode("append").parquet(src)
    found = stream_pointer_sizes(spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(src))
    with rocksdb(spark):
        run = found.writeStream.format("memory").queryName("left").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.counter: r.buffer_size for r in spark.table("left").collect()}
    assert {k: None if v is None else int(v) for k, v in got.items()} == {0: 3, 1: 2, 2: None}


def _live_points(parts, per=30, traces=2, seed=5, spread=1):
    """Points in parts, with their MemoryMap results by (trace, counter)."""
    import random
    from decimal import Decimal

    from tracemill.operators.memory import MemoryMap

    rng, want, out = random.Random(seed), {}, []
    maps = [MemoryMap() for _ in range(traces)]
    for part in range(parts):
        rows = []
        for c in range(part * per, part * per + per):
            for t in range(traces):
                sizes = [(rng.randrange(0, 60, 10) * spread, rng.choice([0, 4, 12]) * spread) for _ in range(rng.choice([0, 0, 1, 2]))]
                for a, s in sizes:
                    maps[t].update(a, s)
                p = rng.randrange(70) * spread
                want[t, c] = maps[t].left_at(p)
                rows.append((t, c, 1, [(Decimal(a), Decimal(s)) for a, s in sizes], [(0, "p", "*void", "POINTER", 8, Decimal(p), None, None, None)], []))
        out.append(rows)
    return out, want


def _arrive(spark, src, rows):
    from tracemill.plans.schema import POINTS

    spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(src)


def _sizes(rows):
    return {(r.trace_id, r.counter): None if r.buffer_size is None else int(r.buffer_size) for r in rows}


def test_stream_in_stretches(spark, tmp_path):
    """Micro-batches are shared by many tasks; live allocations go on, frees too, and a restart goes on from there."""
    from tracemill.plans.schema import POINTS
    from tracemill.streaming.memory import write_pointer_sizes

    src, out, live = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "live"
    parts, want = _live_points(5)
    Path(src).mkdir()
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(src)
    for more in (parts[:3], parts[3:]):
        for rows in more:
            _arrive(spark, src, rows)
        write_pointer_sizes(stream, out, str(live), str(tmp_path / "state"), group=50).awaitTermination()
    assert _sizes(spark.read.parquet(out).collect()) == want
    # Folder 4 took in 2 and 3, 2 took in 1: what is left grows with the logarithm of the micro-batches.
    assert sorted(p.name for p in live.iterdir()) == ["4", "5"]


def test_folders_of_state():
    from tracemill.streaming import memory

    for n in range(1, 70):
        covered = [k for f in memory._prefix(n) for k in range((f & (f - 1)) + 1, f + 1)]
        assert sorted(covered) == list(range(1, n + 1))
        own = [k for f in memory._merged(n) for k in range((f & (f - 1)) + 1, f + 1)]
        assert sorted([*own, n]) == list(range((n & (n - 1)) + 1, n + 1))


def test_stored_map():
    """A tree in a map of state holds what a list in memory holds, and writes what changed."""
    import random

    from tracemill.operators.memory import SENTINEL, MemoryMap
    from tracemill.streaming.memory import StoredMap

    class State(dict):
        writes = 0

        def getValue(self, key):  # noqa: N802
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self[key], self.writes = value, self.writes + 1

        def removeKey(self, key):  # noqa: N802
            del self[key]
            self.writes += 1

    rng, state, plain = random.Random(3), State(), MemoryMap()
    some = [0, 1, 255, 256, 1 << 63, SENTINEL - 1, SENTINEL, *(rng.randrange(1 << 64) for _ in range(40)), *(rng.randrange(5000) for _ in range(40))]
    for _ in range(60):
        m = StoredMap(state)  # a micro-batch
        for _ in range(20):
            a, s = rng.choice(some), rng.choice([0, 0, 1, 300, SENTINEL])
            m.update(a, s)
            plain.update(a, s)
            for p in (rng.choice(some), rng.choice(some) + 1 & SENTINEL, rng.randrange(1 << 64)):
                assert m.left_at(p) == plain.left_at(p)
        m.flush()
    for a in list(plain.starts):
        plain.update(a, 0)
    m = StoredMap(state)
    for a in some:
        m.update(a, 0)
    m.flush()
    assert not state
    for live in (10, 3000):  # what one change writes doesn't grow with what is live
        m = StoredMap(state)
        for k in range(live):
            m.update(k * 64, 8)
        m.flush()
        state.writes = 0
        m = StoredMap(state)
        m.update(32, 8)
        m.update(0, 16)
        m.flush()
        assert state.writes <= 3
        m.update(32, 0)
        m.flush()


def test_stream_late_and_restarted(spark, tmp_path):
    """Micro-batches out of order within hold, and a restart between them, give what one batch gives; beyond hold points are late."""
    from tracemill.plans.schema import POINTS
    from tracemill.streaming.memory import rocksdb, stream_pointer_sizes

    parts, want = _live_points(4, per=8, spread=1 << 40)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    Path(src).mkdir()

    def run(*arriving):
        for rows in arriving:
            _arrive(spark, src, rows)
        found = stream_pointer_sizes(spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(src), 16)
        with rocksdb(spark):
            query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        rows = spark.read.parquet(out).collect()
        return [r for r in rows if not r.late], [r for r in rows if r.late]

    found, late = run(parts[0], parts[2])  # 1 comes after 2
    assert _sizes(found) == {k: v for k, v in want.items() if k[1] <= 7} and not late
    found, late = run(parts[1], parts[3], parts[0])
    assert _sizes(found) == {k: v for k, v in want.items() if k[1] <= 15} and len(found) == 32
    assert sorted((r.trace_id, r.counter, r.buffer_size) for r in late) == sorted((r[0], r[1], None) for r in parts[0])


def test_stream_of_ended_traces(spark, tmp_path):
    """A trace from which nothing comes ends: what was held back is given, and its state is gone."""
    import time

    from tracemill.plans.schema import POINTS
    from tracemill.streaming.memory import rocksdb, stream_pointer_sizes

    (rows,), want = _live_points(1, per=6, traces=1)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    Path(src).mkdir()
    found = stream_pointer_sizes(spark.readStream.schema(POINTS).parquet(src), 100, 1.0)
    with rocksdb(spark):
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        for n in (1, 2):  # the same trace begins anew
            _arrive(spark, src, rows)
            until = time.time() + 45
            while time.time() < until:
                time.sleep(1)
                got = spark.read.schema(found.schema).parquet(out).collect() if Path(out, "_spark_metadata").exists() else []
                if len(got) == n * len(rows):
                    break
            assert _sizes(got) == want and len(got) == n * len(rows) and not any(r.late for r in got)
    finally:
        query.stop()


def _some_points(spark, n=15, per=4):
    from tracemill.plans.schema import POINTS

    v = lambda i: [(0, "x", "int", "SIGNED", 4, i, None, None, None)]
    from decimal import Decimal

    rows = [(t, c, (c << 40) + t if c % 2 else (c << 40) + t - (1 << 63), [], [(*v(0)[0][:5], Decimal(t), None, None, None)], []) for t in range(n) for c in range(per)]
    return spark.createDataFrame(rows, POINTS)


def test_a_load_is_there_or_not(spark, tmp_path, monkeypatch):
    """A load that fails before its entry shows nowhere, may be tried again, and can be cleaned away."""
    store = TraceStore.create(spark, str(tmp_path / "store"))
    points = _some_points(spark)
    store.add_points(points)
    reader = store.points()

    def fails(*a):
        raise RuntimeError("no entry")

    with monkeypatch.context() as m:
        m.setattr(TraceStore, "_commit", fails)
        with pytest.raises(RuntimeError):
            store.add_points(points)
    for s in (store, TraceStore.open(spark, store.path)):
        assert s.n_traces() == 15 and s.points().count() == reader.count() == 60 and s.traces().count() == s.metadata().count() == 15 and s.types().count() == 15
        assert s.query(None, dedup=None).select("trace_id").distinct().count() == 15
        with pytest.raises(IndexError):
            s.trace_id(15)
    assert store.clean() == 0 and store.clean(hours=0) == 1 and store.points().count() == 60
    then = TraceStore.open(spark, store.path, at=store.position())
    store.add_points(points, {"k": "again"})
    assert store.n_traces() == 30 and store.points().count() == 120 and store.position() == 2
    assert then.n_traces() == 15 and then.points().count() == 60 and then.restrict_to_file(1).points().count() == 15
    assert len({r.trace_id for r in store.traces().collect()}) == 30
    monkeypatch.setattr("tracemill.store.MOST_NAMED", 1)
    assert store.points().count() == 120 and store.query(20, dedup=None).count() == 4


def test_statements_of_a_file_are_skipped_to(spark, tmp_path):
    """A file's statements are ranges, which are pushed to Parquet."""
    store = TraceStore.create(spark, str(tmp_path / "store"))
    store.add_points(_some_points(spark, 40, 6).coalesce(1))
    for f in (1, 2, 7):
        found = store.restrict_to_file(f).points()
        assert found.count() == (40 if f < 6 else 0)
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        (pushed,) = [x for x in plan.splitlines() if x.startswith("PushedFilters")]
        assert pushed.count("GreaterThanOrEqual(statement") == 2 and pushed.count("LessThanOrEqual(statement") == 2


def test_masks_as_ranges(spark):
    import random

    from tracemill.plans import schema as S

    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for _ in range(300):
        mask = rng.choice([rng.getrandbits(64), (1 << 64) - (1 << rng.randrange(64)), ((1 << rng.randrange(64)) - 1) << rng.randrange(64) & (1 << 64) - 1, S.FILE_MASK << S.NODE_BITS, 0])
        value = rng.getrandbits(64) & (mask if rng.random() < 0.9 else (1 << 64) - 1)
        ranges, exact = S.mask_ranges(signed(mask), signed(value))
        for s in [rng.getrandbits(64) for _ in range(20)] + [value, value | ~mask % (1 << 64), (value | rng.getrandbits(64) & ~mask) % (1 << 64)]:
            inside, holds = any(lo <= signed(s) <= hi for lo, hi in ranges), s & mask == value
            assert inside >= holds and (not exact or inside == holds)
    rows = [None, 5, -3, 1 << 40, S.FLAG | 1 << 40, S.FLAG | 1 << 40 | 7, (1 << 63) - 1]
    df = spark.createDataFrame([(x,) for x in rows], "s long")
    for mask, value in ((3, 1), (S.FLAG, S.FLAG), (S.FLAG, 0), (-1, 5), (0, 0), (0, 1), (~S.FLAG, 5), (S.FILE_MASK << S.NODE_BITS, 1 << S.NODE_BITS)):
        assert sorted(r.s for r in df.where(S.masked(F.col("s"), mask, value)).collect()) == sorted(x for x in rows if x is not None and x & mask == value)


def test_formats_of_points_without(spark, tmp_path):
    """Points of s-expressions, of which one type has both signs, another floats and a third text."""
    from decimal import Decimal

    from tracemill.plans.schema import POINTS

    def v(pos, type_, num=None, dbl=None, blob=None, format_=None):
        return (pos, f"v{pos}", type_, format_, None, None if num is None else Decimal(num), dbl, blob, None)

    rows = [
        (1, 0, 5, [], [v(0, "a", 3), v(1, "b", 70_000), v(2, "c", 1), v(3, "d", 2), v(4, None, 1), v(5, "e", 1, format_="SIGNED")], []),
        (1, 1, 5, [], [v(0, "a", -300), v(1, "b", 2**64 - 1), v(2, "c", dbl=0.5), v(3, "d", blob=b"x"), v(4, "f")], []),
        (2, 0, 5, [], [v(0, "a", 255), v(1, "d", dbl=1.5)], []),
    ]
    store = TraceStore.create(spark, str(tmp_path / "store"))
    store.add_points(spark.createDataFrame(rows, POINTS), infer=True)
    got = {(t, r.type_name): (r.format, r.size) for t in range(2) for r in store.types().where(F.col("trace_id") == store.trace_id(t)).collect() if r.type_name}
    assert got == {(0, "a"): ("SIGNED", 2), (0, "b"): ("UNSIGNED", 8), (0, "c"): ("FLOAT", 8), (0, "d"): ("BLOB", 0), (0, "e"): ("SIGNED", None), (0, "f"): ("UNSIGNED", 8), (1, "a"): ("UNSIGNED", 1), (1, "d"): ("FLOAT", 8)}
    c, d = ([(x["num"], x["dbl"], x["blob"]) for r in store.get_trace(0).collect() for x in r.vars if x["type"] == t] for t in "cd")
    assert c == [(None, 1.0, None), (None, 0.5, None)] and d == [(None, None, b"2"), (None, None, b"x")]
    assert store.query(0, ["x"], [["a"]], ("<", ("v/value", "x"), 0), dedup=None).count() == 1


def test_files_as_columns():
    """As codec has them, without its objects."""
    from decimal import Decimal

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from tracemill.plans import schema as S
    from tracemill.sources import columnar

    point = codec.Point
    traces = [sample(), [point()], sample()[3:5] + [point(None, [], [codec.Variable("int", "n", "UNSIGNED", 3, 2**24 - 1)], [2**64 - 1])], [point(2**64 - 1, [(2**64 - 1, 1)] * 2, [codec.Variable("ñ", "int", "SIGNED", 8, -(2**63))])]]
    number = lambda v: Decimal(v.value) if v.format not in ("FLOAT", "BLOB") else None
    signed = lambda n: None if n is None else n - (1 << 64) if n >> 63 else n

    def row(p, c):
        held = [{"pos": i, "name": v.name, "type": v.type, "format": v.format, "size": v.size, "num": number(v), "dbl": v.value if v.format == "FLOAT" else None, "blob": v.value if v.format == "BLOB" else None, "buffer_size": None} for i, v in enumerate(p.vars)]
        return {"trace_id": 1, "counter": c, "statement": signed(p.statement), "sizes": [{"address": Decimal(a), "size": Decimal(s)} for a, s in p.sizes], "vars": held, "aux": [signed(a) for a in p.aux]}

    rows = [row(p, i) for t in traces for i, p in enumerate(t)]
    batch = pa.RecordBatch.from_pylist([rows[0], *rows], to_arrow_schema(S.POINTS)).slice(1)
    data = columnar.encode(batch, np.repeat(np.arange(4), [len(t) for t in traces]))
    assert data == [codec.encode(t) for t in traces]
    shape = to_arrow_schema(files.DECODED)
    got = columnar.decode(list("abcd"), data, [None] * 4, shape, False)
    assert got.to_pylist() == [{"source": s} | {k: x for k, x in r.items() if k != "trace_id"} | {"error": None} for s, r in zip("a" * 10 + "b" + "ccc" + "d", rows, strict=True)]
    empty = codec.encode([])
    assert columnar.decode(["a", "b"], [empty, bytes(8)], [None, None], shape, True).num_rows == 0
    for bad in (data[0] + b"\x07", data[0][:-1], data[0][:20], b""):  # left to codec
        assert columnar.decode(["a", "b"], [data[1], bad], [None, None], shape, False) is None
    assert columnar.decode(["a"], [data[0]], [None], shape, True) is None  # its pointers need sizes
    rows[0]["vars"][0]["num"] = Decimal(2**31)
    assert columnar.encode(pa.RecordBatch.from_pylist(rows[:1], to_arrow_schema(S.POINTS)), np.zeros(1, int)) is None


def test_stored_map_asks_nothing_of_an_empty_state():
    from tracemill.streaming.memory import StoredMap

    class State(dict):
        asked, updateValue, removeKey = 0, dict.__setitem__, dict.pop  # noqa: N815

        def getValue(self, k):  # noqa: N802
            self.asked += 1
            return self.get(k)

    state = State()
    m = StoredMap(state, empty=True)
    m.update(4096, 10)
    m.update(8192, 10)
    m.update(8192, 0)
    assert (m.left_at(4100), m.left_at(8200), state.asked) == (6, None, 0)
    m.flush()
    m = StoredMap(state)
    assert (m.left_at(4100), m.left_at(8200)) == (6, None)
