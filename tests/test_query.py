"""Binding queries on the one-point fixture, and against a plain evaluator on random points."""

import random
import time
from collections import Counter
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F
from tracemill.operators import binding, dictionary, memory
from tracemill.operators.memory import SENTINEL, MemoryMap, pointer_sizes, pointers_by_address
from tracemill.plans import predicate as P
from tracemill.plans import schema as S

U, I, UI = ["unsigned int"], ["int"], ["unsigned int", "int"]
V = lambda n: ("v/value", n)


def var(pos, name, type_, format_, size, num=None, dbl=None, buffer_size=None, blob=None):
    dec = lambda x: None if x is None else Decimal(x)
    return (pos, name, type_, format_, size, dec(num), dbl, blob, dec(buffer_size))


def points(spark, *rows):
    """rows: (trace, counter, statement, vars) with sizes as an optional fifth."""
    full = [(r[0], r[1], r[2], [(Decimal(a), Decimal(s)) for a, s in (r[4] if len(r) > 4 else [])], r[3], []) for r in rows]
    return spark.createDataFrame(full, S.POINTS)


@pytest.fixture(scope="module")
def one(spark):
    return points(
        spark,
        (1, 1, 1, [
            var(0, "x", "unsigned int", "UNSIGNED", 4, 0),
            var(1, "y", "unsigned int", "UNSIGNED", 4, 1),
            var(2, "z", "int", "SIGNED", 4, -2),
            var(3, "big_positive", "int64_t", "SIGNED", 8, 9223372036854775807),
            var(4, "big_negative", "int64_t", "SIGNED", 8, -9223372036854775808),
            var(5, "big_unsigned", "uint64_t", "UNSIGNED", 8, 18446744073709551615),
            var(6, "var", "*void", "POINTER", 8, 0x1234, buffer_size=4),
        ]),
    ).cache()


def run(df, types, *args, **options):
    k = len(types)
    options = {"dedup": None} | options
    rows = binding.query(df, "ab"[:k], types, *args, **options).collect()
    rows.sort(key=lambda r: [r[f"p{i}"] for i in reversed(range(k))])
    return [tuple(r[f"v{i}"]["name"] for i in range(k)) for r in rows]


@pytest.mark.parametrize(
    "types, predicate, expected",
    [
        ([U, I], None, [("x", "z"), ("y", "z")]),
        ([U, U], None, 4),
        ([U, U], ("distinct-vars", "a", "b"), 2),
        ([UI], (">", V("a"), 0), [("y",)]),
        ([UI], ("<", V("a"), -1), [("z",)]),
        ([UI, UI], ("=", ("+", V("a"), V("b")), -1), [("z", "y"), ("y", "z")]),
        ([UI, UI], ("=", ("-", V("a"), V("b")), 3), [("y", "z")]),
        ([UI, UI], ("=", ("*", V("a"), V("b")), 0), 5),
        ([UI, UI], ("=", ("/", V("a"), V("b")), 0), 2),
        ([UI], ("or", ("and", (">", V("a"), 0), ("<", V("a"), 3)), ("=", V("a"), -2)), [("y",), ("z",)]),
        ([["int64_t"]] * 2, (">", ("+", V("a"), V("b")), 2**63 - 1), [("big_positive",) * 2]),
        ([["int64_t"]] * 2, ("<", ("+", V("a"), V("b")), -(2**63)), [("big_negative",) * 2]),
        ([["uint64_t"]] * 2, (">", ("+", V("a"), V("b")), 2**64 - 1), [("big_unsigned",) * 2]),
        ([["*void"]], ("=", ("v/size", "a"), 4), 1),
        ([["*void"]], ("=", ("v/size", "a"), 5), 0),
        ([UI, UI], None, 9),
    ],
)
def test_fixture(one, types, predicate, expected):
    got = run(one, types, predicate)
    assert got == expected if isinstance(expected, list) else len(got) == expected
    if predicate is not None:
        assert run(one, types, predicate, exact=True) == got


def test_soft(one):
    first = run(one, [UI, UI], soft_predicates=[("<", V("a"), 1)])
    assert len(first) == 6 and {a for a, _ in first} == {"x", "z"}
    both = run(one, [UI, UI], soft_predicates=[("<", V("a"), 1), ("=", V("a"), -2)])
    assert len(both) == 3 and {a for a, _ in both} == {"z"}
    assert len(run(one, [UI], soft_predicates=[(">", V("a"), 100)])) == 3  # none satisfied: all stay


def test_invalid_is_false_and_its_negation_true(one):
    assert run(one, [["*void"], I], (">", ("/", V("b"), 0), 1)) == []
    assert len(run(one, [["*void"], I], ("not", (">", ("/", V("b"), 0), 1)))) == 1
    assert len(run(one, [I], ("not", ("=", ("v/size", "a"), 4)))) == 1


def test_no_variables_and_preconditions(one):
    assert binding.query(one).count() == 1
    for bad in ({"predicate": (">", 1, 0)}, {"var_names": ["a"], "var_types": []}, {"dedup": "some"}):
        with pytest.raises(ValueError):
            binding.query(one, **bad)
    for bad in ((">", V("a")), ("xor", V("a"), 1), (">", V("c"), 1), (">", ("and",), 1), "(> 1"):
        with pytest.raises(P.PredicateError):
            binding.query(one, ["a"], [U], bad)


def test_text_round_trip():
    for p in (("and", ("distinct-vars", "a", "b"), (">=", V("a"), 1.5)), ("not", ("<=", ("*", V("a"), -3), ("v/size", "b")))):
        assert P.checked(P.show(p), ["a", "b"]) == p
    assert P.checked("nil", []) is None
    assert P.checked("(and (or) nil (equal 1 1))", []) == ("and", ("or",), ("=", 1, 1))


def _random_predicate(rng, names, depth=2):
    if depth and rng.random() < 0.5:
        op = rng.choice(["and", "or", "not"])
        return (op, *(_random_predicate(rng, names, depth - 1) for _ in range(1 if op == "not" else 2)))
    if rng.random() < 0.15:
        return ("distinct-vars", rng.choice(names), rng.choice(names))

    def value(d=1):
        if d and rng.random() < 0.5:
            return (rng.choice("+-*"), value(d - 1), value(d - 1))
        return rng.choice([V(rng.choice(names)), rng.randint(-3, 3), ("v/size", rng.choice(names))])

    return (rng.choice(list(P.COMPARE)), value(), value())


def test_against_plain_evaluator(spark):
    rng = random.Random(4)
    rows, plain = [], []
    for c in range(12):
        vs = []
        for i in range(rng.randint(0, 5)):
            t = rng.choice(["int", "double", "*void"])
            n = rng.randint(-3, 3)
            vs.append(var(i, f"n{i % 3}", t, {"int": "SIGNED", "double": "FLOAT", "*void": "POINTER"}[t], 8, None if t == "double" else n if t == "int" else abs(n), float(n) if t == "double" else None, rng.choice([None, 2]) if t == "*void" else None))
        rows.append((c % 2, c, c % 3, vs))
        plain.append([dict(zip(S.VAR.names, v, strict=True)) for v in vs])
    df = points(spark, *rows).cache()
    types = [["int", "double"], ["int", "*void"]]
    for _ in range(12):
        p = P.checked(_random_predicate(rng, ["a", "b"]), ["a", "b"])
        want = sorted((c, b["pos"], a["pos"]) for c, vs in enumerate(plain) for a, b in product(vs, vs) if a["type"] in types[0] and b["type"] in types[1] and P.evaluate(p, {"a": a, "b": b}.get))
        got = sorted((r.counter, r.p1, r.p0) for r in binding.query(df, "ab", types, p, dedup=None).collect())
        assert got == want, P.show(p)


EDGES = (0, 1, -1, 3, 10**9, 10**18 - 1, 10**18, -(10**18), 2**63 - 1, -(2**63), 2**64 - 1, 2**64 - 2, 9999999999999999999)


def test_integers_beyond_38_digits(spark):
    """Products of up to four variables, compared natively, as unbounded integers are."""
    rng = random.Random(9)
    rows = [(1, c, 1, [var(0, "a", "x", "SIGNED", 8, rng.choice(EDGES)), var(1, "b", "y", "SIGNED", 8, rng.choice(EDGES)), var(2, "d", "z", "FLOAT", 8, dbl=2.0)]) for c in range(80)]
    plain = [{n: dict(zip(S.VAR.names, v, strict=True)) for n, v in zip("abd", r[3], strict=True)} for r in rows]
    df = points(spark, *rows).cache()
    a, b = V("a"), V("b")
    square = ("*", a, b)
    for p in (
        ("<", square, -(10**38)),
        ("=", square, ("*", b, a)),
        (">", ("-", square, ("*", a, a)), 0),
        (">=", ("*", square, square), 10**75),
        ("<", ("+", ("*", square, a), 7), ("*", ("*", b, b), b)),
        ("not", ("<=", square, (2**64 - 1) ** 2 - 1)),
        ("=", ("*", a, ("*", b, V("d"))), ("*", 2, square)),
        ("<", ("v/size", "a"), square),
    ):
        p = P.checked(p, list("abd"))
        types = [["x"], ["y"], ["z"]]
        want = [c for c, v in enumerate(plain) if P.evaluate(p, v.get)]
        assert sorted(r.counter for r in binding.query(df, "abd", types, p, dedup=None).collect()) == want, P.show(p)


@pytest.mark.parametrize("exact", [False, True])
def test_soft_products_and_quotients(one, exact):
    product_, third = ("<", ("*", V("a"), V("b")), 0), ("=", ("/", V("a"), V("b")), ("/", V("b"), V("a")))
    assert run(one, [UI, UI], soft_predicates=[product_], exact=exact) == [("z", "y"), ("y", "z")]
    assert run(one, [UI, UI], product_, soft_predicates=[(">", V("a"), 0)], exact=exact) == [("y", "z")]
    assert run(one, [UI, UI], soft_predicates=[third, ("distinct-vars", "a", "b")], distinct_bindings=True, exact=exact) == [(a, b) for b in "xyz" for a in "xyz" if a != b]
    with_big = ["int64_t", "uint64_t"]
    assert run(one, [with_big] * 2, soft_predicates=[(">", ("*", V("a"), V("b")), 2 * 10**38)], exact=exact) == [("big_unsigned",) * 2]


def test_numbers_in_text():
    assert P.parse("(> nan 1)") == (">", "nan", 1) and P.parse("(> inf -1.5e3)") == (">", "inf", -1500.0) and P.parse("(> .5 +2)") == (">", 0.5, 2)


def test_dedup_keeps_first_or_last(spark):
    df = points(spark, *((1, c, 7, [var(0, "k", "int", "SIGNED", 4, c), var(1, "k", "int", "SIGNED", 4, c + 10)]) for c in range(3)))
    assert [r.v0.num for r in binding.query(df, ["a"], [I]).collect()] == [0]
    assert [r.v0.num for r in binding.query(df, ["a"], [I], dedup="last").collect()] == [12]
    assert binding.query(df, ["a"], [I], dedup=None).count() == 6
    assert binding.query(df, ["a"], [I], dedup=None, pick=3).count() == 2
    assert binding.query(df, "ab", [I, I], dedup=None, distinct_bindings=True).count() == 6


def test_files_and_masks(spark):
    flagged = S.FLAG + (5 << 40) + 9
    df = points(spark, (1, 0, flagged, []), (1, 1, 9, []), (1, 2, S.FLAG + 9, []))
    found = {r.counter: (r.file_id, r.stmt_id) for r in binding.query(df, dedup=None).collect()}
    assert found == {0: (5, 9), 1: (None, 9), 2: (0, 9)}
    ids = lambda **o: sorted(r.counter for r in binding.query(df, dedup=None, **o).collect())
    assert ids(file_id=5) == [0] and ids(file_id=0) == [1, 2] and ids(file_id=0, strict_file=True) == [2]
    assert ids(mask=(15, 9)) == [0, 1, 2] and ids(mask=(S.FLAG, 0)) == [1]


def test_memory_map():
    m = MemoryMap()
    m.update(3, 10)
    m.update(100, 2)
    assert [m.left_at(p) for p in (3, 100, 8, 101, 13, 102, 99, 2)] == [10, 2, 5, 1, 0, 0, None, None]
    m.update(3, 5)
    assert m.left_at(3) == 5
    m.update(100, 0)
    assert m.left_at(100) is None and m.left_at(SENTINEL) is None
    m.update(SENTINEL, 5)
    assert m.left_at(SENTINEL) is None


@pytest.mark.parametrize("group", [30, 300, 100_000])
def test_pointer_sizes_in_groups(spark, group):
    rng = random.Random(1)
    rows, want = [], {}
    for t in range(2):
        m = MemoryMap()
        for c in range(20):
            sizes = [(rng.randrange(0, 60, 10), rng.choice([0, 4, 12])) for _ in range(rng.randint(0, 2))]
            for a, s in sizes:
                m.update(a, s)
            p = rng.randrange(70)
            want[t, c] = m.left_at(p)
            rows.append((t, c, 1, [var(0, "p", "*void", "POINTER", 8, p)], sizes))
    got = {(r.trace_id, r.counter): None if r.buffer_size is None else int(r.buffer_size) for r in pointer_sizes(points(spark, *rows), group).collect()}
    assert got == want


def test_one_long_trace_is_shared_by_tasks(spark, monkeypatch):
    """300,000 addresses in one trace, none freed: no task goes through twice GROUP rows."""
    n, most = 300_000, []
    carried = memory.carried

    def measured(rows, order, same, value, keep, parts):
        by = rows.repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).count()
        most.append(by.agg(F.max("count")).first()[0])
        return carried(rows, order, same, value, keep, parts)

    monkeypatch.setattr(memory, "carried", measured)
    i = F.col("id")
    num = lambda x: x.cast(S.NUM)
    at = i * 7919 % (i + 2)  # up to i + 1, which comes later
    pointer = F.struct(F.lit(0).alias("pos"), F.lit("p").alias("name"), F.lit("*void").alias("type"), F.lit("POINTER").alias("format"), F.lit(8).alias("size"), num(16 * at + 4).alias("num"), F.lit(None).cast("double").alias("dbl"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast(S.NUM).alias("buffer_size"))
    df = spark.range(n).select(F.lit(1).cast("long").alias("trace_id"), i.alias("counter"), F.lit(1).cast("long").alias("statement"), F.array(F.struct(num(16 * i).alias("address"), num(F.lit(8)).alias("size"))).alias("sizes"), F.array(pointer).alias("vars"), F.array().cast("array<long>").alias("aux"))
    found = pointer_sizes(df).select("counter", (F.col("counter") * 7919 % (F.col("counter") + 2) <= F.col("counter")).alias("lives"), "buffer_size")
    right = F.when(F.col("lives"), F.col("buffer_size") == 4).otherwise(F.col("buffer_size").isNull())
    assert found.agg(F.count("*"), F.count_if(right)).first() == (n, n)
    assert len(most) == 2 and max(most) < 2 * memory.GROUP


def test_tasks_of_pointers_have_bounded_rows(spark, monkeypatch, capsys):
    """Short traces make no blocks; long ones are gathered without a sort, and whole points joined, by as many tasks as their rows need."""
    rng = random.Random(4)
    rows = [(t, c, 1, [var(0, "p", "*void", "POINTER", 8, rng.randrange(70))], [(rng.randrange(0, 60, 10), rng.choice([0, 8]))]) for t in range(20) for c in range(5)]
    df = points(spark, *rows).cache()
    key = lambda r: (r.trace_id, r.counter)
    by_blocks = pointer_sizes(df, 7)
    by_blocks.explain()
    assert "SortAggregate" not in capsys.readouterr().out and by_blocks.rdd.getNumPartitions() > 20
    want = sorted(map(tuple, by_blocks.collect()), key=str)
    monkeypatch.setattr(memory, "POINTS", 10)
    whole = memory.with_sizes(df)
    assert whole.rdd.getNumPartitions() == 10
    assert {key(r): r.vars[0].buffer_size for r in whole.collect()} == {(r[0], r[1]): r[4] for r in want}
    assert all(r.vars == [] for r in memory.with_sizes(df, ["int"]).collect())
    monkeypatch.setattr(memory, "carried", None)
    assert sorted(map(tuple, pointer_sizes(df, 10).collect()), key=str) == want


def test_pointers_by_address(spark):
    rng = random.Random(12)
    rows, want = [], Counter()
    for t in range(3):
        last = {}
        for c in range(25):
            sizes = [(rng.randrange(0, 40, 10), rng.choice([0, 0, 8])) for _ in range(rng.randint(0, 3))]
            n = rng.randint(0, 2)
            last.update(dict(sizes))
            for a, s in last.items():
                want[t, a, "all"] += n
                want[t, a, "freed"] += n * (s == 0)
            rows.append((t, 5 * c, 1, [var(i, "p", "*void", "POINTER", 8, 3) for i in range(n)], sizes))
    for group in (7, 10_000):
        got = {(r.trace_id, int(r.address)): (r.pointers, r.freed) for r in pointers_by_address(points(spark, *rows), group).collect()}
        assert got == {(t, a): (want[t, a, "all"], want[t, a, "freed"]) for t, a, _ in want}
    two = [var(0, "p", "*void", "POINTER", 8, 3), var(1, "p", "*void", "POINTER", 8, 3)]
    for sizes, freed in (([(100, 10), (100, 0)], 2), ([(100, 0), (100, 10)], 0)):
        assert [tuple(r)[2:] for r in pointers_by_address(points(spark, (1, 1, 1, two, sizes))).collect()] == [(2, freed)]
    assert [r.pointers for r in pointers_by_address(points(spark, (1, 1, 1, [], [(100, 1)]), (1, 2, 1, []))).collect()] == [0]
    assert pointers_by_address(points(spark)).count() == 0 and pointer_sizes(points(spark)).count() == 0


def _wide_points(spark, rng, counters=10, most=9):
    rows, plain = [], []
    for c in range(counters):
        vs = []
        for i in range(rng.randint(0, most)):
            t = rng.choice(["int", "double"])
            n = rng.choice([None, *range(-3, 4)])
            vs.append(var(i, f"n{i % 3}", t, "SIGNED" if t == "int" else "FLOAT", 8, n if t == "int" else None, None if t == "int" or n is None else rng.choice([float(n), float("nan"), n + 0.5]), rng.choice([None, 2])))
        rows.append((c % 2, c, c % 3, vs))
        plain.append([dict(zip(S.VAR.names, v, strict=True)) for v in vs])
    return points(spark, *rows).cache(), plain


@pytest.mark.parametrize("distinct", [False, True])
def test_branch_and_bound(spark, distinct):
    """The best of three variables, as all assignments tried give it."""
    rng = random.Random(21 + distinct)
    df, plain = _wide_points(spark, rng, most=6)
    types = [["int", "double"], ["int"], ["int", "double"]]
    for n in range(6):
        hard = P.checked(_random_predicate(rng, list("abc")), list("abc")) if n % 2 else None
        soft = [P.checked(_random_predicate(rng, rng.choice(["a", "bc", "abc", "c"])), list("abc")) for _ in range(rng.randint(1, 4))]
        want = []
        for c, vs in enumerate(plain):
            scored = []
            for combo in product(*([v for v in vs if v["type"] in t] for t in types)):
                get = dict(zip("abc", combo, strict=True)).get
                if (hard is None or P.evaluate(hard, get)) and (not distinct or len({v["pos"] for v in combo}) == 3):
                    scored.append((sum(P.evaluate(s, get) for s in soft), [v["pos"] for v in combo]))
            want += [(c, *p) for s, p in scored if s == max(s for s, _ in scored)]
        got = sorted((r.counter, r.p0, r.p1, r.p2) for r in binding.query(df, "abc", types, hard, soft, dedup=None, distinct_bindings=distinct, indexed=n > 3).collect())
        assert got == sorted(want), (P.show(hard), [P.show(s) for s in soft])


def test_branches_end_early(spark):
    """120 variables, three of them bound: hard conjuncts of single ones leave few branches."""
    df = points(spark, (1, 1, 1, [var(i, f"x{i}", "int", "SIGNED", 4, i) for i in range(120)])).cache()
    hard, soft = ("and", ("=", V("a"), 0), ("=", V("b"), 0)), [("<", V("c"), 3), ("<", ("+", V("a"), V("c")), ("+", V("b"), 2))]
    run = lambda: binding.query(df, "abc", [["int"]] * 3, hard, soft, dedup=None).collect()
    assert sorted(r.p2 for r in run()) == [0, 1]
    began = time.time()
    run()
    assert time.time() - began < 2


@pytest.mark.parametrize("predicate", [("=", V("a"), V("b")), ("=", ("+", V("a"), 1), V("b")), ("and", (">", V("b"), V("a")), ("<=", V("b"), ("+", V("a"), 1))), ("and", (">=", V("b"), ("*", V("a"), V("a"))), ("<", V("c"), V("b"))), ("=", ("v/size", "b"), V("a")), ("and", ("=", V("c"), ("/", V("a"), V("b"))), ("not", ("=", V("a"), V("b"))))])
def test_lookups_find_what_trying_finds(spark, predicate):
    df, _ = _wide_points(spark, random.Random(31))
    types = [["int", "double"], ["int", "double"], ["int"]]
    for distinct in (False, True):
        both = [sorted((r.counter, r.p0, r.p1, r.p2) for r in binding.query(df, "abc", types, predicate, dedup=None, distinct_bindings=distinct, indexed=i).collect()) for i in (False, True)]
        assert both[0] == both[1]


def test_lookups_make_few_rows(spark):
    """2000 variables and a = b: candidates that can't be equal are never rows."""
    df = points(spark, (1, 1, 1, [var(i, "x", "int", "SIGNED", 4, i // 2) for i in range(2000)]))
    found = binding.query(df, "ab", [["int"]] * 2, ("=", V("a"), V("b")), dedup=None, indexed=True)
    assert len(found.collect()) == 4000
    made, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Generate"):
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert len(made) == 2 and sum(made) < 10_000


def test_fractions(spark):
    """Quotients of integers of all sizes and signs, compared as fractions; with a float they are doubles."""
    rng = random.Random(17)
    rows = [(1, c, 1, [var(0, "a", "x", "SIGNED", 8, rng.choice(EDGES)), var(1, "b", "y", "SIGNED", 8, rng.choice(EDGES)), var(2, "d", "z", "FLOAT", 8, dbl=rng.choice([2.0, 0.0, float("nan")]))]) for c in range(60)]
    plain = [{n: dict(zip(S.VAR.names, v, strict=True)) for n, v in zip("abd", r[3], strict=True)} for r in rows]
    df = points(spark, *rows).cache()
    a, b, d = V("a"), V("b"), V("d")
    for p in (
        ("=", ("/", a, b), ("/", ("*", a, 3), ("*", b, 3))),
        (">", ("/", a, b), ("/", b, a)),
        ("<=", ("/", a, ("-", b, a)), ("+", ("/", b, a), 1)),
        ("not", ("<", ("/", ("/", a, b), ("/", b, a)), 7)),
        (">=", ("*", ("/", a, 3), ("/", b, 7)), ("-", a, ("/", 1, b))),
        ("<", ("/", a, d), b),
        ("=", ("+", ("/", a, b), d), ("*", ("/", b, a), d)),
        ("and", (">", ("/", 1, a), -1), ("=", ("/", 0, b), 0)),
    ):
        p = P.checked(p, list("abd"))
        want = [c for c, v in enumerate(plain) if P.evaluate(p, v.get)]
        found = binding.query(df, "abd", [["x"], ["y"], ["z"]], p, dedup=None, exact=True)
        assert sorted(r.counter for r in found.collect()) == want, P.show(p)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_picks_are_even(spark):
    """1,000 seeds over 20 points: every point is drawn about as often; one exchange."""
    seeds = spark.range(1000).select(F.col("id").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("counter"))
    drawn = seeds.groupBy("seed").agg(F.min_by("counter", binding.pick_key(F.col("counter"), F.col("seed"))).alias("c"))
    counts = [r["count"] for r in drawn.groupBy("c").count().collect()]
    assert len(counts) == 20 and sum((c - 50) ** 2 / 50 for c in counts) < 43.8  # 0.1 %
    df = points(spark, *[(t, c, 1, []) for t in range(3) for c in range(20)])
    found = binding.query(df, pick=5, dedup=None)
    assert sorted(r.trace_id for r in found.collect()) == [0, 1, 2]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_first_points_by_ranges(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, c, 1, []) for t in range(4) for c in rng.sample(range(-500, 2000), (300, 40, 7, 0)[t])]
    monkeypatch.setattr(binding, "RANKED", 0)
    monkeypatch.setattr(binding, "RANGE_BITS", 5)
    for n in (1, 7, 39, 40, 41, 299, 5000):
        want = sorted((t, c) for t in range(4) for c in sorted(c for u, c, *_ in rows if u == t)[:n])
        for sent in (0, 10):
            monkeypatch.setattr(binding, "SENT", sent)
            assert sorted((r.trace_id, r.counter) for r in binding.first_points(points(spark, *rows), n).collect()) == want


@pytest.mark.parametrize("group", [3, 100_000])
def test_dictionaries(spark, monkeypatch, group):
    """Indices in order of first sight, types told apart by format and size; encoding and back."""
    rng = random.Random(2)
    rows = []
    for t in range(3):
        for c in range(6):
            rows.append((t, c, 1, [var(i, rng.choice(["x", "y", None, "z", ""]), rng.choice(["int", "a b", None]), rng.choice(["SIGNED", None]), rng.choice([4, 8]), i) for i in range(rng.randint(0, 4))]))
    df = points(spark, *rows)
    want = {"names": {}, "types": {}}
    for t, _, _, vs in rows:
        for v in vs:
            for kind, key in (("names", v[1:2]), ("types", v[2:5])):
                own = want[kind].setdefault(t, {})
                own.setdefault(key, len(own))
    n, k = dictionary.names(df, group), dictionary.types(df, group)
    assert {(r.trace_id, (r.name,)): r["index"] for r in n.collect()} == {(t, x): i for t, d in want["names"].items() for x, i in d.items()}
    assert {(r.trace_id, (r.type, r.format, r.size)): r["index"] for r in k.collect()} == {(t, x): i for t, d in want["types"].items() for x, i in d.items()}
    for sent in (0, 1000):
        monkeypatch.setattr(dictionary, "SENT", sent)
        short = dictionary.encoded(df, n, k)
        assert short.selectExpr("explode(vars) as v").where("v.name_idx is null or v.type_idx is null").count() == 0
        back = dictionary.decoded(short, n, k)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_first_seen_hashes_variables(spark):
    """What is sorted is one row for each name and position, not each variable."""
    points = spark.range(600).selectExpr("id % 3 trace_id", "if(id = 599, null, 600 - id) counter", "transform(array(id % 7, id % 5, id % 7), (x, i) -> struct(i pos, concat('n', x) name)) vars")
    seen = dictionary.first_seen(points, F.col("v.name").alias("name"))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2
    old = points.select("trace_id", "counter", F.explode("vars").alias("v")).groupBy("trace_id", "v.name").agg(F.min(F.struct(F.coalesce("counter", F.lit(-1 << 63)), "v.pos")).alias("first"))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, old.collect()))


def test_events_with_given_variables(spark):
    """So that a query with variables of its own need not join the events to themselves."""
    from tracemill.sources.adapters import events_as_points, variable

    events = spark.createDataFrame([(1, 7, "click", 0.5, '{"k": 3}'), (1, 8, None, None, None)], "event_id long, user_id long, event_type string, value double, props string")
    points = events_as_points(events, F.array(variable(0, "id", "id", "SIGNED", 8, F.col("user_id") * 10)))
    assert sorted((r.trace_id, int(r.vars[0].num), len(r.vars)) for r in points.collect()) == [(7, 70, 1), (8, 80, 1)]
    assert "Join" not in points._jdf.queryExecution().executedPlan().toString()
