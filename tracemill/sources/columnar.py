"""Binary traces from and to Arrow columns, many small files at a time.

The bytes are those of codec, which goes through objects of each point; here Python finds the entries of a file, and numpy makes
their values. What is out of the ordinary (an error, a size that a format doesn't have) is left to codec: None is returned.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracemill.plans.schema import FORMATS
from tracemill.sources import codec

NUM = pa.decimal128(20, 0)
_FORMATS = pa.array(FORMATS)


def _words(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of decimals of 128 bits the low 64 bits and the high ones; of nulls zero."""
    a = pc.fill_null(a, pa.scalar(0, NUM)) if a.null_count else a
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    both = np.frombuffer(a.buffers()[1], np.int64)[2 * a.offset : 2 * (a.offset + len(a))].reshape(-1, 2)
    return both[:, 0].view(np.uint64), both[:, 1]


def _bytes(x: np.ndarray) -> np.ndarray:
    """64 bits each, as rows of 8 bytes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists the length of each, the list of each element and its place there, and the elements. Null lists are empty."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return n, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), column.flatten()


def _first_seen(file: np.ndarray, code: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the place of its code among those of its file in order of first sight; and the rows of first sight, in order."""
    _, first, inverse = np.unique(file * many + code, return_index=True, return_inverse=True)
    by = np.sort(first)
    start = np.searchsorted(file[by], file[by])  # files come in order
    return (np.arange(len(by)) - start)[np.searchsorted(by, first)][inverse], by


def encode(points: pa.RecordBatch, file: np.ndarray) -> list[bytes] | None:
    """A trace for each file: codec.encode of its points. file: that of each point, in order, from 0 without gaps."""
    n_points, n_files = points.num_rows, int(file[-1]) + 1
    statement = points.column("statement")
    n_sizes, i_size, sizes = _flat(points.column("sizes"))
    n_vars, i_var, v = _flat(points.column("vars"))
    n_aux, i_aux, aux = _flat(points.column("aux"))
    name, kind, format_, size = (v.field(c) for c in ("name", "type", "format", "size"))
    if v.null_count or sizes.null_count or aux.null_count or any(x.null_count for x in (name, kind, format_, size)):
        return None
    code = pc.index_in(format_, _FORMATS).fill_null(codec.INVALID).to_numpy(zero_copy_only=False)
    size = size.to_numpy(zero_copy_only=False).astype(np.int64)
    is_blob, is_float = code == codec.BLOB, code == codec.FLOAT
    whole = ~is_blob & ~is_float
    num, dbl, blob = v.field("num"), v.field("dbl"), v.field("blob")
    missing = np.select([is_blob, is_float], [x.is_null().to_numpy(zero_copy_only=False) for x in (blob, dbl)], num.is_null().to_numpy(zero_copy_only=False))
    low, high = _words(num)
    shift = np.clip(8 * size, 8, 64)
    unsigned = (high == 0) & ((shift == 64) | (low >> (shift % 64).astype(np.uint64) == 0))
    sign = low.view(np.int64) >> 63
    signed = (high == sign) & (low.view(np.int64) >> (shift - 1) == sign)
    fits = np.where(code == codec.SIGNED, signed, unsigned) & (size >= 1) & (size <= 8)
    if missing.any() or (code >= codec.INVALID).any() or (whole & ~fits).any() or (is_float & (size != 4) & (size != 8)).any() or (is_blob & (size < 0)).any():
        return None
    blobs = blob.filter(pa.array(is_blob)).to_pylist()
    has = ~statement.is_null().to_numpy(zero_copy_only=False)
    length = 9 + size
    length[is_blob] = [9 + 4 * (not s) + len(b) for s, b in zip(size[is_blob], blobs, strict=True)]

    of_var, of_size, of_aux = np.repeat(np.arange(n_points), n_vars), np.repeat(np.arange(n_points), n_sizes), np.repeat(np.arange(n_points), n_aux)
    var_bytes = np.concatenate(([0], np.cumsum(length)))
    first_var = np.cumsum(n_vars) - n_vars
    in_vars = var_bytes[first_var + n_vars] - var_bytes[first_var]
    point_bytes = 9 * has + 17 * n_sizes + in_vars + 9 * n_aux + 1

    # names: the type's of each variable, then its own
    text = pa.concat_arrays([kind, name]).dictionary_encode()
    codes = np.stack(np.split(text.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2), axis=1).ravel()
    words = [x.encode() + b"\0" for x in text.dictionary.to_pylist()]
    var_file = file[of_var]
    name_at, names = _first_seen(np.repeat(var_file, 2), codes, len(words) + 1)
    type_key = pa.array(codes[::2] << 35 | code.astype(np.int64) << 32 | size).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    type_at, types = _first_seen(var_file, type_key, len(type_key) + 1)
    name_of, name_file = codes[names].tolist(), np.repeat(var_file, 2)[names]
    type_of = np.stack((name_at[::2][types], code[types], size[types]), axis=1).astype("<u4").tobytes()
    bounds = [np.searchsorted(x, np.arange(n_files + 1)).tolist() for x in (name_file, var_file[types])]
    heads, seen = [], {}
    for f in range(n_files):
        own = tuple(name_of[bounds[0][f] : bounds[0][f + 1]])
        block = seen.get(own)
        if block is None:
            block = seen[own] = b"".join(words[k] for k in own)
        t0, t1 = bounds[1][f], bounds[1][f + 1]
        heads.append(len(block).to_bytes(8, "little") + block + (t1 - t0).to_bytes(4, "little") + type_of[12 * t0 : 12 * t1])

    start = np.cumsum(point_bytes) - point_bytes
    out = np.zeros(int(point_bytes.sum()), np.uint8)

    def put(at: np.ndarray, rows: np.ndarray) -> None:
        out[at[:, None] + np.arange(rows.shape[1])] = rows

    at = start[has]
    out[at] = codec.STATEMENT
    put(at + 1, _bytes(pc.fill_null(statement, 0).to_numpy(zero_copy_only=False)[has]))
    at = start[of_size] + 9 * has[of_size] + 17 * i_size
    out[at] = codec.BUFFER_SIZE
    for k, c in enumerate(("address", "size")):
        word, over = _words(sizes.field(c))
        if sizes.field(c).null_count or over.any():
            return None
        put(at + 1 + 8 * k, _bytes(word))
    vars_at = start + 9 * has + 17 * n_sizes
    at = vars_at[of_var] + var_bytes[:-1] - var_bytes[first_var][of_var]
    out[at] = codec.VARIABLE
    put(at + 1, np.stack((name_at[1::2], type_at), axis=1).astype("<u4").view(np.uint8).reshape(-1, 8))
    numbers = pc.fill_null(dbl, 0.0).to_numpy(zero_copy_only=False)
    value = np.where(is_float[:, None], _bytes(numbers), _bytes(low))
    short = is_float & (size == 4)
    if short.any():
        if (np.isfinite(numbers[short]) & (np.abs(numbers[short]) > np.finfo(np.float32).max)).any():
            return None
        value[short, :4] = numbers[short].astype("<f4").view(np.uint8).reshape(-1, 4)
    for s in np.unique(size[~is_blob]).tolist():
        mine = ~is_blob & (size == s)
        put(at[mine] + 9, value[mine, :s])
    for a, s, b in zip(at[is_blob].tolist(), size[is_blob].tolist(), blobs, strict=True):
        b = b if s else len(b).to_bytes(4, "little") + b
        out[a + 9 : a + 9 + len(b)] = np.frombuffer(b, np.uint8)
    at = (vars_at + in_vars)[of_aux] + 9 * i_aux
    out[at] = codec.AUXILIARY
    put(at + 1, _bytes(aux.to_numpy(zero_copy_only=False)))
    out[start + point_bytes - 1] = codec.END

    ends = np.append(start, len(out))[np.searchsorted(file, np.arange(n_files + 1))].tolist()
    body = out.tobytes()
    return [h + body[a:b] for h, a, b in zip(heads, ends, ends[1:], strict=False)]


def _scan(data: bytes, at: int, types: list[tuple[str, int, int]], base: int, found: tuple[list[int], ...]) -> bool:
    """Adds, from base on, where the points of a trace end and where its entries are; whether all is well."""
    ends, statements, sizes, variables, kinds, aux = found
    size_of = [-1 if code == codec.BLOB and not size else size for _, code, size in types]
    last, tag = len(data), 0
    while at < last:
        tag = data[at]
        if tag == 2:
            kind = int.from_bytes(data[at + 5 : at + 9], "little")
            if kind >= len(size_of):
                return False
            size = size_of[kind]
            variables.append(base + at)
            kinds.append(kind)
            at += 9 + size if size >= 0 else 13 + int.from_bytes(data[at + 9 : at + 13], "little")
        elif tag == 0:
            ends.append(base + at)
            at += 1
        elif tag == 1:
            statements.append(base + at)
            at += 9
        elif tag == 4:
            aux.append(base + at)
            at += 9
        elif tag == 3:
            sizes.append(base + at)
            at += 17
        else:
            return False
    return at == last and tag == 0


def _decimals(low: np.ndarray, high: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    both = np.stack((low.view(np.int64), high), axis=1)
    a = pa.Array.from_buffers(NUM, len(both), [None, pa.py_buffer(np.ascontiguousarray(both))])
    return a if valid is None else pc.if_else(pa.array(valid), a, pa.scalar(None, NUM))


def decode(paths: list[str], contents: list[bytes], counters: list[list[int] | None], shape: pa.Schema, memory_map: bool) -> pa.RecordBatch | None:
    """The points of traces in the columns of shape; None if a trace isn't regular, or has sizes that its pointers need."""
    found: tuple[list[int], ...] = ([], [], [], [], [], [])
    starts, heads, seen = [0, *accumulate(map(len, contents))], [], {}
    names, types, kind_base, name_base, name_count, types_of, n_kinds, n_points = [], [], [], [], [], [], [], []
    for data, base in zip(contents, starts, strict=False):
        r = codec._Reader(data)
        try:
            size = int.from_bytes(data[:8], "little")
            n = int.from_bytes(data[8 + size : 12 + size], "little")
            head = data[: 12 + size + 12 * n]
            if head not in seen:
                own, kinds = codec.header(r)
                if r.at != len(head):
                    return None
                seen[head] = len(name_base)
                name_base.append(len(names))
                kind_base.append(len(types))
                name_count.append(len(own))
                types_of.append(kinds)
                names += own
                types += kinds
        except codec.TraceError:
            return None
        heads.append(seen[head])
        points, of_kind = len(found[0]), len(found[4])
        if not _scan(data, len(head), types_of[heads[-1]], base, found) or (memory_map and found[2]):
            return None
        n_kinds.append(len(found[4]) - of_kind)
        n_points.append(len(found[0]) - points)
    data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
    ends, statements, sizes, variables, kinds, aux = (np.array(x, np.int64) for x in found)
    n = len(ends)
    head, n_points = np.array(heads, np.int64), np.array(n_points, np.int64)

    def word(at: np.ndarray, size: int = 8) -> np.ndarray:
        return np.ascontiguousarray(data[at[:, None] + np.arange(size)]).view(f"<u{size}").ravel()

    def lists(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, np.concatenate(([0], ends))).astype(np.int32)

    of = lists(statements)
    if (np.diff(of) > 1).any():  # the last of them counts
        return None
    statement = np.zeros(n, np.int64)
    statement[np.diff(of) == 1] = word(statements + 1).view(np.int64)
    var_head = np.repeat(head, n_kinds)
    name = word(variables + 1, 4).astype(np.int64)
    if len(name) and (name >= np.array(name_count)[var_head]).any():
        return None
    kind = kinds + np.array(kind_base, np.int64)[var_head]
    code, size = (np.array([t[k] for t in types] or [0], np.int64)[kind] for k in (1, 2))
    is_blob, is_float = code == codec.BLOB, code == codec.FLOAT
    whole = ~is_blob & ~is_float
    spare = (64 - 8 * np.clip(size, 0, 8)).astype(np.uint64)
    raw = np.where(spare < 64, word(np.minimum(variables + 9, len(data) - 8)) << (spare % 64), np.uint64(0))
    signed = raw.view(np.int64) >> spare.astype(np.int64)
    is_signed = code == codec.SIGNED
    low = np.where(is_signed, signed.view(np.uint64), np.where(spare < 64, raw >> (spare % 64), np.uint64(0)))
    high = np.where(is_signed & (signed < 0), -1, 0)
    with np.errstate(invalid="ignore"):  # what isn't a float
        dbl = np.where(size == 4, low.astype(np.uint32).view(np.float32).astype(np.float64), low.view(np.float64))
    blobs = pa.nulls(len(kind), pa.binary())
    if is_blob.any():
        values = [None] * len(kind)
        for i in np.flatnonzero(is_blob).tolist():
            at, s = int(variables[i]) + 9, int(size[i])
            at, s = (at, s) if s else (at + 4, int.from_bytes(data[at : at + 4].tobytes(), "little"))
            values[i] = data[at : at + s].tobytes()
        blobs = pa.array(values, pa.binary())
    var_lists = lists(variables)
    pos = np.arange(len(kind)) - np.repeat(var_lists[:-1], np.diff(var_lists))
    at_name = name + np.array(name_base, np.int64)[var_head]
    columns = {
        "pos": pa.array(pos, pa.int32()),
        "name": pa.array(names, pa.string()).take(pa.array(at_name)),
        "type": pa.array([t[0] for t in types], pa.string()).take(pa.array(kind)),
        "format": _FORMATS.take(pa.array(code)),
        "size": pa.array(size, pa.int32()),
        "num": _decimals(low, high, whole),
        "dbl": pc.if_else(pa.array(is_float), pa.array(dbl), pa.scalar(None, pa.float64())),
        "blob": blobs,
        "buffer_size": pa.nulls(len(kind), NUM),
    }
    address, length = word(sizes + 1), word(sizes + 9)
    zero = np.zeros(len(sizes), np.int64)
    element = {c: shape.field(c).type.value_type for c in ("sizes", "vars", "aux")}
    struct = lambda t, cs: pa.StructArray.from_arrays([cs[t.field(i).name].cast(t.field(i).type) for i in range(t.num_fields)], fields=list(t))
    held = {"sizes": (lists(sizes), struct(element["sizes"], {"address": _decimals(address, zero), "size": _decimals(length, zero)})), "vars": (var_lists, struct(element["vars"], columns)), "aux": (lists(aux), pa.array(word(aux + 1).view(np.int64)))}
    first = np.repeat(np.cumsum(n_points) - n_points, n_points)
    counter = np.arange(n) - first
    if any(c is not None for c in counters):
        if [len(c or ()) for c in counters] != n_points.tolist():
            return None
        counter = np.array([x for c in counters for x in c or ()], np.int64)
    made = {
        "source": pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(paths)), n_points))),
        "counter": pa.array(counter, pa.int64()),
        "statement": pc.if_else(pa.array(np.diff(of) == 1), pa.array(statement), pa.scalar(None, pa.int64())),
        "error": pa.nulls(n, pa.string()),
    } | {c: pa.ListArray.from_arrays(pa.array(o), x, type=shape.field(c).type) for c, (o, x) in held.items()}
    return pa.RecordBatch.from_arrays([made[c] for c in shape.names], schema=shape)
