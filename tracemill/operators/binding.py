"""The binding query: at each point all assignments of free variables to variables in scope.

One row per point goes in; a chain of generators enumerates the assignments within the row, with the type test
of a variable directly above its own generator and each conjunct of the predicate as early as its variables
are bound, so no shuffle is needed until duplicates are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.plans import predicate as P
from tracemill.plans import schema as S
from tracemill.scratch import written


Test = Callable[[P.Node, Callable[[str], Column]], Column]  # a checked predicate over variables, compiled


def _bound(points: DataFrame, names: Sequence[str], types: Sequence[Sequence[str]], conjuncts: list, test: Test, distinct: bool, soft: Sequence = (), indexed: bool = False) -> DataFrame:
    """points with columns v0 .. and p0 .. for each assignment that satisfies all conjuncts, and column __most of the soft predicates, if there are any."""
    todo = [(c, set(P.names_in(c))) for c in conjuncts]
    var = _columns(names)
    lookups = [_lookup(conjuncts, names, i) if indexed else [] for i in range(len(names))]
    out, have = points.withColumns({f"__by{i}": _sorted_by(lookups[i][0][1], kinds) for i, kinds in enumerate(types) if lookups[i]}), set()
    for i, (name, kinds) in enumerate(zip(names, types, strict=True)):
        keep = [c for c in out.columns]
        if lookups[i]:
            out = out.select(*keep, F.explode(_slice(F.col(f"__by{i}"), lookups[i], var)["at"]).alias(f"p{i}")).withColumn(f"v{i}", F.get("vars", F.col(f"p{i}")))
        else:
            out = out.select(*keep, F.posexplode("vars").alias(f"p{i}", f"v{i}")).where(F.col(f"v{i}.type").isin(list(kinds)))
        if distinct:
            for j in range(i):
                out = out.where(F.col(f"p{j}") != F.col(f"p{i}"))
        have.add(name)
        for c, needs in [t for t in todo if t[1] <= have]:
            out = out.where(test(c, var))
        todo = [t for t in todo if not t[1] <= have]
        settled = [s for s in soft if set(P.names_in(s)) <= have]
        if any(name in P.names_in(s) for s in settled):
            # A filter on __most alone, which coalesce keeps Spark from inferring, would be pushed below all that makes the candidates.
            out = out.where(_score(settled, var, test) + (len(soft) - len(settled)) >= F.coalesce("__most", F.lit(-1)))
    for c, _ in todo:
        out = out.where(test(c, var))
    return out


def _columns(names: Sequence[str]) -> Callable[[str], Column]:
    return lambda n: F.col(f"v{list(names).index(n)}")


def _score(soft: Sequence, var: Callable[[str], Column], test: Test) -> Column:
    """How many of the soft predicates hold."""
    return sum((F.when(test(s, var), 1).otherwise(0) for s in soft), F.lit(0))


_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


def _lookup(conjuncts: list, names: Sequence[str], i: int) -> list[tuple[str, tuple, P.Node]]:
    """(comparison, value of variable i, what it is compared with) of the conjuncts by which candidates for variable i can be looked up when those before it are bound; all of one value."""
    found = []
    for op, *args in conjuncts:
        if op in P.COMPARE:
            for op_, own, other in ((op, *args), (_TURNED[op], *reversed(args))):
                if own in (("v/value", names[i]), ("v/size", names[i])) and (needs := set(P.names_in(other))) and needs <= set(names[:i]):
                    found.append((op_, own, other))
    return [f for f in found if f[1] == found[0][1]]


def _sorted_by(value: tuple, kinds: Sequence[str]) -> Column:
    """The variables of the types that have the value, as (value as a double, at), sorted."""
    name = value[1]

    def entry(v: Column, at: Column) -> Column:
        x = P.approximate(value, {name: v}.__getitem__)
        return F.when(v["type"].isin(list(kinds)) & x.isNotNull(), F.struct(x.alias("x"), at.alias("at")))

    return F.sort_array(F.filter(F.transform("vars", entry), lambda e: e.isNotNull()))


def _slice(by: Column, lookups: list, var: Callable[[str], Column]) -> Column:
    """The entries of by that may satisfy all lookups: bounds are found by halving, a little wide, as the values are rounded."""
    low, high = F.lit(0), F.size(by)
    for op, _, other in lookups:
        key = P.approximate(other, var)
        slack = F.abs(key) * 1e-9
        if op in ("=", ">", ">="):
            low = F.greatest(low, _place(by, key - slack, False))
        if op in ("=", "<", "<="):
            high = F.least(high, _place(by, key + slack, True))
        high = F.when(key.isNotNull(), high)
    return F.slice(by, low + 1, F.greatest(high - low, F.lit(0)))


def _place(by: Column, key: Column, after: bool) -> Column:
    """How many entries of by are below key, or not above it, if after."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        x = F.get(by, middle)["x"]
        right = x <= key if after else x < key
        return F.when(s["low"] < s["high"], F.when(right, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(by) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(by).alias("high")), halve, lambda s: s["low"])


def _softly(points: DataFrame, names: Sequence[str], types: Sequence[Sequence[str]], hard: list, soft: list, test: Test, distinct: bool, indexed: bool) -> DataFrame:
    """Assignments of each point that satisfy the most soft predicates.

    The most that any assignment satisfies is found within the point's row, by branch and bound, which keeps a number and
    no assignment; then the generators give those that reach it.
    """
    most, rows = _most(points, names, types, hard, soft, test, distinct)
    rows = rows.withColumn("__most", most).select(*points.columns, "__most")
    return _bound(rows, names, types, hard, test, distinct, soft, indexed).drop("__most")


def _most(points: DataFrame, names: Sequence[str], types: Sequence[Sequence[str]], hard: list, soft: list, test: Test, distinct: bool) -> tuple[Column, DataFrame]:
    """The most soft predicates that an assignment of a point satisfies, -1 if it has none, over points with columns of candidates.

    Predicates of one variable are evaluated once for each candidate, and leave out those that fail a hard one. Those of
    several are evaluated as soon as these are bound; a branch ends when a hard one fails, or when its score, the
    best that candidates of the other variables have on their own and the soft predicates still open don't exceed the best so far.
    """
    k = len(names)
    level = lambda p: max((list(names).index(n) for n in P.names_in(p)), default=0)
    alone = lambda p: len(set(P.names_in(p))) <= 1
    fields = list(P.RECORD) if any("distinct-vars" in str(p) for p in (*hard, *soft)) else ["num", "dbl", "buffer_size"]

    def candidates(i: int) -> Column:
        own = lambda ps: [p for p in ps if alone(p) and level(p) == i]

        def entry(v: Column, at: Column) -> Column:
            var = lambda n: v
            fits = v["type"].isin(list(types[i]))
            for h in own(hard):
                fits = fits & test(h, var)
            return F.when(fits, F.struct(at.alias("at"), _score(own(soft), var, test).alias("score"), *(v[f].alias(f) for f in fields)))

        return F.filter(F.transform("vars", entry), lambda e: e.isNotNull())

    joint_hard, joint_soft = ([p for p in ps if not alone(p)] for ps in (hard, soft))
    rows = points.withColumns({f"__c{i}": candidates(i) for i in range(k)})
    rows = rows.withColumns({f"__m{i}": F.array_max(F.transform(f"__c{i}", lambda e: e["score"])) for i in range(k)})
    bests = [F.col(f"__m{i}") for i in range(k)]
    whole = sum(bests, F.lit(0))
    if not joint_hard and not joint_soft and not distinct:
        return F.coalesce(whole, F.lit(-1)), rows

    def branch(i: int, bound: dict[int, Column], score: Column, best: Column) -> Column:
        var = lambda n: bound[list(names).index(n)]
        rest = sum(bests[i + 1 :], F.lit(0)) + sum(level(s) > i for s in joint_soft)

        def step(best: Column, v: Column) -> Column:
            bound[i] = v
            now = score + v["score"]
            most = now + rest + sum(level(s) == i for s in joint_soft)
            ok = most > best
            for j in range(i) if distinct else ():
                ok = ok & (bound[j]["at"] != v["at"])
            for h in joint_hard:
                if level(h) == i:
                    ok = ok & test(h, var)
            mine = [s for s in joint_soft if level(s) == i]

            def go_on(reached: Column) -> Column:
                deeper = branch(i + 1, dict(bound), reached, best) if i + 1 < k else reached
                return F.when(reached + rest > best, deeper).otherwise(best) if mine else deeper

            found = P.let(now + _score(mine, var, test), go_on) if mine else go_on(now)
            return F.when(ok, found).otherwise(best)

        return F.aggregate(F.col(f"__c{i}"), best, step)

    return F.when(whole.isNotNull(), branch(0, {}, F.lit(0), F.lit(-1))).otherwise(-1), rows


def pick_key(counter: Column, seed: Column) -> Column:
    """What points are drawn by: a digest of seed and counter."""
    return F.md5(F.concat_ws(":", seed.cast("string"), counter.cast("string")).cast("binary"))


def pick_point(points: DataFrame, seed: int) -> DataFrame:
    """One point of each trace, drawn by seed: that with the least digest. Each task sends one point of a trace on."""
    least = F.min_by(F.struct(*points.columns), F.struct(pick_key(F.col("counter"), F.lit(seed)), "counter"))
    return points.groupBy("trace_id").agg(least.alias("__p")).select("__p.*")


RANKED = 1000  # points of a trace that Spark cuts each partition to before it ranks them
RANGE_BITS = 16  # of the ranges of counters that are counted


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first n points of each trace; 0 means all.

    Up to RANKED Spark cuts each partition to n points a trace before they are shuffled. Beyond, points are counted by
    ranges of counters: all below the range in which the n-th lies pass, and only those in it are ranked.
    """
    if n < 0:
        raise ValueError("n is 0 or more")
    if not n:
        return points
    within = Window.partitionBy("trace_id").orderBy("counter")
    if n <= RANKED:
        return points.withColumn("__rank", F.row_number().over(within)).where(F.col("__rank") <= n).drop("__rank")
    range_ = F.shiftright("counter", RANGE_BITS)
    counts = points.groupBy("trace_id", range_.alias("range")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("trace_id").orderBy("range")) - F.col("n")  # of a trace's ranges, not its points
    last = written(counts.select("trace_id", "range", before.alias("before"), "n").where((F.col("before") < n) & (F.col("before") + F.col("n") >= n)).select("trace_id", F.col("range").alias("__range"), (n - F.col("before")).alias("__left")))
    few = last.limit(SENT + 1).count() <= SENT
    both = points.join(F.broadcast(last) if few else last, "trace_id", "left")
    below = both.where(F.col("__range").isNull() | (range_ < F.col("__range")))
    there = both.where(range_ == F.col("__range")).withColumn("__rank", F.row_number().over(within)).where("__rank <= __left")
    return below.select(*points.columns).unionByName(there.select(*points.columns))


SENT = 500_000  # narrow rows that are broadcast


def query(
    points: DataFrame,
    var_names: Sequence[str] = (),
    var_types: Sequence[Sequence[str]] = (),
    predicate: P.Node = None,
    soft_predicates: Sequence[P.Node] = (),
    pick: int | None = None,
    file_id: int | None = None,
    strict_file: bool = False,
    mask: tuple[int, int] | None = None,
    result_filter: Callable[[DataFrame], Column] | None = None,
    dedup: str | None = "first",
    distinct_bindings: bool = False,
    exact: bool = False,
    indexed: bool = False,
) -> DataFrame:
    """Bindings at the points (schema POINTS) of any number of traces.

    var_types[i] lists the type names that variable i may have; a variable may be bound twice at once unless
    distinct_bindings. Of each point only bindings with the most soft_predicates satisfied stay. pick draws one
    point of each trace first. file_id and mask (mask, value) restrict statements. result_filter sees columns
    file_id, stmt_id, v0 .. dedup keeps of bindings with the same trace, statement, names and types the first
    or last in order of point and positions (variable 0 varying fastest), or all (None).

    exact compares quotients of integers as fractions instead of doubles. Integers of the known names of types have no more
    digits than these hold. indexed is for points of hundreds of variables: where a conjunct compares a variable's value or size with what
    those before it give, its candidates are looked up in a sorted array of the point instead of tried one by one. The
    result is the same.

    The result has trace_id, counter, statement, file_id, stmt_id, v0 .., p0 .. (positions), sizes, aux, in no order:
    sort by trace_id, counter and the positions, the last first, for that of enumeration. Without variables there is
    one row per point.
    """
    names, types = list(var_names), [list(t) for t in var_types]
    if len(names) != len(types) or len(set(names)) != len(names):
        raise ValueError("var_names must be distinct, and var_types must have as many members")
    if not names and (predicate is not None or soft_predicates):
        raise ValueError("predicates need variables")
    if dedup not in ("first", "last", None):
        raise ValueError("dedup is first, last or None")
    hard = P.conjuncts(P.checked(predicate, names))
    soft = [s for s in (P.checked(s, names) for s in soft_predicates) if s is not None]
    rows = points
    if file_id is not None:
        rows = rows.where(S.in_file(F.col("statement"), file_id, strict_file))
    if mask is not None:
        rows = rows.where(S.masked(F.col("statement"), *mask))
    if pick is not None:
        rows = pick_point(rows, pick)
    if names:
        digits = {n: max(map(P.digits_of, kinds), default=20) for n, kinds in zip(names, types, strict=True)}
        test = lambda p, var: P.compile(p, var, exact, digits.__getitem__)
        rows = _softly(rows, names, types, hard, soft, test, distinct_bindings, indexed) if soft else _bound(rows, names, types, hard, test, distinct_bindings, indexed=indexed)
    k = len(names)
    statement = F.col("statement")
    rows = rows.select("trace_id", "counter", "statement", S.file_id(statement).alias("file_id"), S.stmt_id(statement).alias("stmt_id"), *(f"v{i}" for i in range(k)), *(f"p{i}" for i in range(k)), "sizes", "aux")
    if result_filter is not None:
        rows = rows.where(result_filter(rows))
    return deduplicated(rows, k, dedup) if dedup else rows


def deduplicated(rows: DataFrame, k: int, which: str = "first") -> DataFrame:
    """Of rows of k variables with the same trace, statement, names and types the first or last. Values don't count."""
    keys = [F.col(f"v{i}.{f}").alias(f"__{f}{i}") for i in range(k) for f in ("name", "type")]
    order = F.struct("counter", *(f"p{i}" for i in range(k - 1, -1, -1)))
    choose = F.min_by if which == "first" else F.max_by
    rest = [c for c in rows.columns if c not in ("trace_id", "statement")]
    best = rows.groupBy("trace_id", "statement", *keys).agg(choose(F.struct(*rest), order).alias("__best"))
    return best.select("trace_id", "statement", "__best.*").select(*rows.columns)


def flat(rows: DataFrame, k: int) -> DataFrame:
    """Scalars of a result: ids, and of each variable name, type, num (as text) and dbl."""
    return rows.select("trace_id", "counter", "file_id", "stmt_id", *(F.col(f"v{i}.{f}").cast("string" if f == "num" else "double" if f == "dbl" else "string").alias(f"v{i}_{f}") for i in range(k) for f in ("name", "type", "num", "dbl")))
