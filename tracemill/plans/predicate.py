"""Predicates over bound variables, as nested tuples or s-expressions, compiled to Columns.

    ("and", ("distinct-vars", "a", "b"), (">", ("v/value", "a"), 3))

Truth has two values: a comparison with an invalid operand (no such value, division by zero) is false, and its
negation true. Integers are exact, whatever their size: where DECIMAL(38) may overflow, as the digits of the variables'
declared types say, numbers are also computed in limbs of 18 digits, which are evaluated only for rows where it does.
Quotients are doubles, or, if exact is asked for, fractions of such integers, which are compared by cross multiplication;
whatever has a float in it is a double. All of it is Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.ctypes import SIGNED, UNSIGNED

Node = tuple | int | float | str | None
LOGIC = ("and", "or", "not")
COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
ARITHMETIC = ("+", "-", "*", "/")
DIGITS = 38
RECORD = ("name", "type", "format", "size", "num", "dbl", "blob", "buffer_size")  # what distinct-vars compares


class PredicateError(ValueError):
    """A predicate of the wrong shape."""


_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?")


def parse(text: str) -> Node:
    """An s-expression, with "equal" for "=" and "nil" or () for no predicate."""
    found = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def read() -> Node:
        nonlocal at
        if at >= len(found):
            raise PredicateError("the expression ends too early")
        t = found[at]
        at += 1
        if t == "(":
            items = []
            while at < len(found) and found[at] != ")":
                items.append(read())
            if at >= len(found):
                raise PredicateError("a ( isn't closed")
            at += 1
            return tuple(items) or None
        if t == ")":
            raise PredicateError("unexpected )")
        if _NUMBER.fullmatch(t):
            return float(t) if set(t) & set(".eE") else int(t)
        return None if t.lower() == "nil" else t.lower() if t.lower() in (*LOGIC, "equal", "distinct-vars", "v/value", "v/size") else t

    out = read()
    if at != len(found):
        raise PredicateError("text after the expression")
    return out


def show(p: Node) -> str:
    """The s-expression of a predicate."""
    if p is None:
        return "nil"
    return "(" + " ".join(map(show, p)) + ")" if isinstance(p, tuple) else str(p)


def checked(p: Node, names: list[str]) -> Node:
    """p in normal form: tuples, "=" for "equal", empty children dropped; raises PredicateError on a wrong shape."""
    if isinstance(p, str):
        p = parse(p)
    if p is None:
        return None
    if not isinstance(p, (tuple, list)) or not p:
        raise PredicateError(f"not a predicate: {p!r}")
    op, *args = p
    op = "=" if op == "equal" else op
    if op in ("and", "or"):
        return (op, *(c for c in (checked(a, names) for a in args) if c is not None))
    if op == "not":
        _arity(p, 1)
        return (op, checked(args[0], names) or ("and",))
    if op == "distinct-vars":
        _arity(p, 2)
        return (op, *(_name(a, names) for a in args))
    if op in COMPARE:
        _arity(p, 2)
        return (op, *(_value(a, names) for a in args))
    raise PredicateError(f"unknown operator {op!r}")


def _arity(p: Node, n: int) -> None:
    if len(p) != n + 1:
        raise PredicateError(f"{p[0]} takes {n} operands: {show(tuple(p))}")


def _name(a: Node, names: list[str]) -> str:
    if a not in names:
        raise PredicateError(f"unknown variable {a!r}")
    return a


def _value(a: Node, names: list[str]) -> Node:
    if isinstance(a, bool) or a is None:
        raise PredicateError(f"not a value: {a!r}")
    if isinstance(a, (int, float, Decimal)):
        return a
    if isinstance(a, (tuple, list)) and a:
        if a[0] in ("v/value", "v/size"):
            _arity(a, 1)
            return (a[0], _name(a[1], names))
        if a[0] in ARITHMETIC:
            _arity(a, 2)
            return (a[0], *(_value(x, names) for x in a[1:]))
    raise PredicateError(f"not a value: {a!r}")


def conjuncts(p: Node) -> list[Node]:
    """The parts of a checked predicate that must all hold; apart from each other each can be applied as early as its variables are bound."""
    if p is None:
        return []
    return [c for a in p[1:] for c in conjuncts(a)] if p[0] == "and" else [p]


LIMB = 18  # digits
_BASE = Decimal(10**LIMB)
_WIDE = "decimal(38,0)"


def _zero() -> Column:
    return F.lit(Decimal(0)).cast(_WIDE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _carried(limbs: Column) -> Column:
    """The same number with limbs below 10 ** LIMB, lowest first, and what is carried out of the last. Signs may differ."""

    def step(s: Column, x: Column) -> Column:
        y = (x + s["carry"]).cast(_WIDE)
        low = (y % F.lit(_BASE)).cast(_WIDE)
        return F.struct(((y - low).cast(_WIDE) / F.lit(_BASE)).cast(_WIDE).alias("carry"), F.concat(s["out"], F.array(low)).alias("out"))

    start = F.struct(_zero().alias("carry"), F.array().cast(f"array<{_WIDE}>").alias("out"))
    return F.aggregate(limbs, start, step, lambda s: F.concat(s["out"], F.array(s["carry"])))


def _limbs_of(num: Column, n: int) -> Column:
    text = F.lpad(F.abs(num).cast("string"), LIMB * n, "0")
    sign = F.when(num < 0, -1).otherwise(1)
    return F.when(num.isNotNull(), F.array(*((F.substring(text, LIMB * (n - 1 - i) + 1, LIMB).cast("long") * sign).cast(_WIDE) for i in range(n))))


def _combined(op: str, a: Column, n: int, b: Column, m: int) -> Column:
    """Limbs of a op b, where both aren't null."""

    def product(x: Column) -> Column:
        term = lambda k, i: (F.get(x["a"], i) * F.get(x["b"], k - i)).cast(_WIDE)
        each = lambda k: F.aggregate(F.sequence(F.greatest(F.lit(0), k - (m - 1)), F.least(F.lit(n - 1), k)), _zero(), lambda s, i: (s + term(k, i)).cast(_WIDE))
        return F.transform(F.sequence(F.lit(0), F.lit(n + m - 2)), each)

    def total(x: Column) -> Column:
        each = lambda p, q: (F.coalesce(p, _zero()) + F.coalesce(q, _zero()) if op == "+" else F.coalesce(p, _zero()) - F.coalesce(q, _zero())).cast(_WIDE)
        return F.zip_with(x["a"], x["b"], each)

    both = lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), (product if op == "*" else total)(x))
    return _carried(let(F.struct(a.alias("a"), b.alias("b")), both))


@dataclass
class _Value:
    num: Column | None  # exact, null where a part isn't an integer or the number outgrows DECIMAL(38)
    dbl: Column | None  # null where the number is an integer
    digits: int  # of the integer, at most
    limbs: Column | None = None  # of an integer that may outgrow DECIMAL(38), an array; null where it is no integer
    n: int = 0  # limbs

    def parts(self) -> tuple[Column, int]:
        n = -(-self.digits // LIMB)
        return (self.limbs, self.n) if self.limbs is not None else (_limbs_of(self.num, n), n)

    def no_integer(self) -> Column:
        return self.num.isNull() if self.limbs is None else self.num.isNull() & self.limbs.isNull()

    def any(self) -> Column:
        found = []
        if self.num is not None:
            found.append(self.num.cast("double"))
        if self.limbs is not None:
            found.append(F.aggregate(F.reverse(self.limbs), F.lit(0.0), lambda s, x: s * 10.0**LIMB + x.cast("double")))
        if self.dbl is not None:
            found.insert(0, self.dbl)
        return F.coalesce(*found)


def _integers(op: str, x: _Value, y: _Value) -> _Value:
    digits = x.digits + y.digits if op == "*" else max(x.digits, y.digits) + 1
    num = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x.num, y.num)
    if digits <= DIGITS:
        return _Value(num, None, digits)
    (a, n), (b, m) = x.parts(), y.parts()
    return _Value(num, None, digits, _combined(op, a, n, b, m), n + m if op == "*" else max(n, m) + 1)


@dataclass
class _Number:
    """top / bottom, a fraction of integers, where there are such; else dbl."""

    top: _Value | None  # its num and limbs are null, its dbl isn't, where a part isn't an integer
    bottom: _Value | None = None  # none: 1
    zero: Column | None = None  # a denominator on the way is zero
    dbl: Column | None = None  # of a fraction, where its parts aren't integers

    def any(self) -> Column:
        if self.bottom is None:
            return self.top.any()
        return F.when(~self.zero, F.try_divide(self.top.any(), self.bottom.any())) if self.dbl is None else F.coalesce(self.dbl, F.when(~self.zero, F.try_divide(self.top.any(), self.bottom.any())))

    def float(self) -> Column | None:
        """The double, null where the number is a fraction of integers."""
        return self.top.dbl if self.bottom is None else self.dbl


def digits_of(type_name: str) -> int:
    """Decimal digits that values of a type have at most, by its name; 20, those of all 64-bit integers, if it isn't known."""
    size = SIGNED.get(type_name) or UNSIGNED.get(type_name) or 8
    return 20 if size == 8 else len(str(1 << (8 * size)))


def _times(x: _Value, y: _Value | None) -> _Value:
    return x if y is None else _integers("*", x, y)


def _compile_value(a: Node, var: Callable[[str], Column], exact: bool = False, digits: Callable[[str], int] | None = None) -> _Number:
    if isinstance(a, int):
        n = len(str(abs(a)))
        if n <= DIGITS:
            return _Number(_Value(F.lit(Decimal(a)), None, n))
        left, limbs = abs(a), []
        while left:
            left, low = divmod(left, 10**LIMB)
            limbs.append(F.lit(Decimal(low if a > 0 else -low)).cast(_WIDE))
        return _Number(_Value(F.lit(None).cast(_WIDE), None, n, F.array(*limbs), len(limbs)))
    if isinstance(a, (float, Decimal)):
        return _Number(_Value(None, F.lit(float(a)), 0))
    op, *args = a
    if op == "v/value":
        v = var(args[0])
        return _Number(_Value(v["num"], v["dbl"], digits(args[0]) if digits else 20))
    if op == "v/size":
        return _Number(_Value(var(args[0])["buffer_size"], None, 20))
    x, y = (_compile_value(b, var, exact, digits) for b in args)
    if op == "/":
        whole = F.try_divide(x.any(), y.any())
        if not exact or x.top.num is None or y.top.num is None:
            return _Number(_Value(None, whole, 0))
        flat = [n for n in (x.float(), y.float()) if n is not None]
        zero = reduce(lambda p, q: p | q, [z for z in (x.zero, y.zero) if z is not None], _is_zero(y.top))
        # The parts are integers where neither has a float.
        top, bottom = _times(_whole(x.top), y.bottom), _times(_whole(y.top), x.bottom)
        return _Number(top, bottom, zero, F.when(reduce(lambda p, q: p | q, [n.isNotNull() for n in flat]), whole) if flat else None)
    if x.bottom is not None or y.bottom is not None:
        if x.top.num is not None and y.top.num is not None:
            return _fractions(op, x, y)
        return _Number(_Value(None, {"+": x.any() + y.any(), "-": x.any() - y.any(), "*": x.any() * y.any()}[op], 0))
    x, y = x.top, y.top
    out = _integers(op, x, y) if x.num is not None and y.num is not None else _Value(None, None, 0)
    if x.dbl is not None or y.dbl is not None or out.num is None:
        whole = {"+": x.any() + y.any(), "-": x.any() - y.any(), "*": x.any() * y.any()}[op]
        out.dbl = whole if out.num is None else F.when(out.no_integer(), whole)
    return _Number(out)


def _whole(x: _Value) -> _Value:
    """The integer alone."""
    return _Value(x.num, None, x.digits, x.limbs, x.n)


def _fractions(op: str, x: _Number, y: _Number) -> _Number:
    a, b = _whole(x.top), _whole(y.top)
    top = _times(a, b) if op == "*" else _integers(op, _times(a, y.bottom), _times(b, x.bottom))
    bottom = y.bottom if x.bottom is None else _times(x.bottom, y.bottom)
    zero = reduce(lambda p, q: p | q, [z for z in (x.zero, y.zero) if z is not None])
    flat = [n.isNotNull() for n in (x.float(), y.float()) if n is not None]
    whole = {"+": x.any() + y.any(), "-": x.any() - y.any(), "*": x.any() * y.any()}[op]
    return _Number(top, bottom, zero, F.when(reduce(lambda p, q: p | q, flat), whole) if flat else None)


def _sign(x: _Value, y: _Value) -> Column:
    """Of x - y in limbs; null where either is no integer."""
    (a, n), (b, m) = x.parts(), y.parts()
    # The highest limb that isn't zero decides, as the others together are smaller than a unit of it.
    return F.aggregate(_combined("-", a, n, b, m), F.lit(0), lambda s, d: F.when(d > 0, 1).when(d < 0, -1).otherwise(s))


def _signum(x: _Value) -> Column:
    """Of an integer; null where there is none."""
    own = F.when(x.num > 0, 1).when(x.num < 0, -1).when(x.num.isNotNull(), 0)
    return own if x.limbs is None else F.coalesce(own, F.aggregate(x.limbs, F.lit(0), lambda s, d: F.when(d > 0, 1).when(d < 0, -1).otherwise(s)))


def _is_zero(x: _Value) -> Column:
    return F.coalesce(_signum(x) == 0, F.lit(False))


def _compared(op: str, x: _Value, y: _Value) -> list[Column]:
    """Tests of integers, of which the first that isn't null counts."""
    tests = [COMPARE[op](x.num, y.num)]
    if x.limbs is not None or y.limbs is not None:
        tests.append(COMPARE[op](_sign(x, y), F.lit(0)))
    return tests


def _compile(p: Node, var: Callable[[str], Column], exact: bool, digits: Callable[[str], int] | None) -> Column:
    op, *args = p
    if op == "and":
        return reduce(lambda a, b: a & b, (_compile(a, var, exact, digits) for a in args), F.lit(True))
    if op == "or":
        return reduce(lambda a, b: a | b, (_compile(a, var, exact, digits) for a in args), F.lit(False))
    if op == "not":
        return ~_compile(args[0], var, exact, digits)
    if op == "distinct-vars":
        a, b = (F.struct(*(var(n)[f] for f in RECORD)) for n in args)
        return ~a.eqNullSafe(b)
    x, y = (_compile_value(a, var, exact, digits) for a in args)
    floats = [n for n in (x.float(), y.float()) if n is not None]
    tests = []
    if x.top.num is not None and y.top.num is not None:
        if x.bottom is None and y.bottom is None:
            tests += _compared(op, x.top, y.top)
        else:
            left, right = _times(_whole(x.top), y.bottom), _times(_whole(y.top), x.bottom)
            zero = reduce(lambda a, b: a | b, [z for z in (x.zero, y.zero) if z is not None])
            sign = reduce(lambda a, b: a * b, [_signum(n.bottom) for n in (x, y) if n.bottom is not None])
            plain = F.lit(True)
            for n in floats:
                plain = plain & n.isNull()
            way = F.when(sign > 0, F.coalesce(*_compared(op, left, right))).when(sign < 0, F.coalesce(*_compared(op, right, left)))
            tests.append(F.when(zero, F.lit(False)).when(plain, way))
    if floats:
        a, b = x.any(), y.any()
        tests.append(COMPARE[op](a, b) & ~F.isnan(a) & ~F.isnan(b))
    return F.coalesce(*tests, F.lit(False))


def compile(p: Node, var: Callable[[str], Column], exact: bool = False, digits: Callable[[str], int] | None = None) -> Column:
    """A Boolean Column, never null, for a checked predicate; var gives the struct column of a variable, digits how many its integers have at most."""
    return _compile(p, var, exact, digits)


def approximate(a: Node, var: Callable[[str], Column]) -> Column:
    """A checked value as a double, null where there is none."""
    return _compile_value(a, var).any()


def names_in(p: Node) -> Iterator[str]:
    if isinstance(p, tuple):
        if p[0] in ("v/value", "v/size", "distinct-vars"):
            yield from p[1:]
        else:
            for a in p[1:]:
                yield from names_in(a)


def evaluate(p: Node, var: Callable[[str], dict]) -> bool:
    """A checked predicate over variables given as dicts of RECORD fields, with fractions for quotients of integers."""
    op, *args = p
    if op == "and":
        return all(evaluate(a, var) for a in args)
    if op == "or":
        return any(evaluate(a, var) for a in args)
    if op == "not":
        return not evaluate(args[0], var)
    if op == "distinct-vars":
        a, b = ([var(n).get(f) for f in RECORD] for n in args)
        return a != b
    x, y = (_number(a, var) for a in args)
    if x is None or y is None or (x != x) or (y != y):
        return False
    return bool(COMPARE[op](*((x, y) if not isinstance(x, float) and not isinstance(y, float) else (float(x), float(y)))))


def _number(a: Node, var: Callable[[str], dict]) -> int | Fraction | float | None:
    if isinstance(a, (int, float)):
        return a
    if isinstance(a, Decimal):
        return float(a)
    op, *args = a
    if op in ("v/value", "v/size"):
        v = var(args[0])
        n = v.get("num") if op == "v/value" else v.get("buffer_size")
        return int(n) if n is not None else v["dbl"] if op == "v/value" else None
    x, y = (_number(b, var) for b in args)
    if x is None or y is None or (op == "/" and y == 0):
        return None
    if isinstance(x, float) or isinstance(y, float):
        x, y = float(x), float(y)
    if op == "/":
        return x / y if isinstance(x, float) else Fraction(x) / y
    return x + y if op == "+" else x - y if op == "-" else x * y
