"""Alignment of two tokenizers: where tokens of both end at the same byte, a text is cut into groups.

A text is split before each run of spaces that follows another sign: neither tokenizer joins across such a place,
so both have a token's end there and a group never reaches over it. Each stretch is encoded by both, and the byte
offsets at which tokens end are intersected by galloping: the shorter list drives a search through the longer one, from
the stretch's first token in steps that double and then by halving, for all its ends at once. The places of the
common ends in either list cut both into groups; the differences of those places are what a group has of either, and
all pairs of them are linked. Stretches seen before are looked up in a table of bounded size.

Texts are encoded once, and written as what they link. Spark counts in how many documents an id pair is linked; then the
counts meet the documents: the most frequent pairs, at most FREQUENT of them, are sent to the tasks; the others, which
few documents hold, are joined by Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import joined, written
from tracemill.llm._text import chunks, kept, ranges

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
KNOWN = 150_000  # stretches that a worker remembers
KNOWN_CHARS = 40  # of a stretch that is remembered, at most
TOGETHER = 5000  # stretches that are encoded as one text
FREQUENT = 500_000  # pairs whose counts are sent to tasks
STEPS = 8  # classes of counts to a doubling
WIDE_GROUP = 4096  # links of a group from which on ids that repeat in it are paired once
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")
_SPACE = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: bytes with a visible sign for themselves, the others by the characters from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """A byte-level vocabulary; special tokens' strings are plain text.

    Where its ids are in the order of its merges, stretches of the older alphabets are encoded by a faster library with the
    same merges, many as one text: their tokens never join. All others go to the vocabulary's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        byte = byte_alphabet()
        self.entry = [bytes(byte[c] for c in e) if (e := self.tokenizer.id_to_token(i)) is not None and all(c in byte for c in e) else b"" for i in range(self.size)]
        self.length = np.array([len(e) for e in self.entry], np.int64)
        self.quick = self._ranked(path)

    def _ranked(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if model["normalizer"] is not None or len(vocabulary) != 256 + len(made) or any(vocabulary[m] != 256 + k for k, m in enumerate(made)):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.entry[i]: i for i in vocabulary.values()}
        return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has. Each text begins with a space."""
        plain = [self.quick is not None and len(t) < 1000 and not t[-1].isspace() and (t.isascii() or max(t) < "\u0500") for t in texts]
        order = [i for i, ok in enumerate(plain) if ok]
        ids, count = [], []
        for k in range(0, len(order), TOGETHER):
            part = [texts[i] for i in order[k : k + TOGETHER]]
            found = np.array(self.quick.encode_ordinary("".join(part)), np.int64)
            ends, stops = np.cumsum(self.length[found]), np.cumsum([len(t.encode()) for t in part])
            at = np.searchsorted(ends, stops)
            if not np.array_equal(ends[np.minimum(at, len(ends) - 1)], stops):
                raise ValueError("a token reaches over a cut")
            ids.append(found)
            count.append(np.diff(at + 1, prepend=0))
        rest = [i for i, ok in enumerate(plain) if not ok]
        each = [e.ids for e in self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)] if rest else []
        ids.append(np.fromiter(chain.from_iterable(each), np.int64))
        count.append(np.array([len(e) for e in each], np.int64))
        ids, count = np.concatenate(ids), np.concatenate(count)
        if rest:
            place = np.empty(len(texts), np.int64)
            place[order + rest] = np.arange(len(texts))
            first = np.cumsum(count) - count
            ids, count = ids[ranges(first[place], count[place])[1]], count[place]
        return ids, count


class PieceTokens:
    """A vocabulary of pieces, which puts a space before a text; the texts to encode begin with it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        self.entry = [bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(self.size)]
        self.length = np.array([len(e) for e in self.entry], np.int64)
        self.space = m.piece_to_id(_SPACE)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As of ByteTokens."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        found = [ids if len(t) > 1 else [self.space] for t, ids in zip(texts, found, strict=True)]  # nothing comes of an empty text
        return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(f) for f in found], np.int64)


def gallop(x: np.ndarray, sorted_values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each x the first place from start on, stop if there is none before, whose value isn't below x: by steps that double, then by halving."""
    low, high, step = start.copy(), start.copy(), 1
    open_ = np.arange(len(x))
    while len(open_):
        open_ = open_[high[open_] < stop[open_]]
        open_ = open_[sorted_values[high[open_]] < x[open_]]
        low[open_] = high[open_] + 1
        high[open_] += step
        step += step
    high = np.minimum(high, stop)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = sorted_values[middle] < x[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of their common values, both ascending; stretch k has n_a[k] and n_b[k] of them."""
    if len(a) > len(b):
        j, i = common_ends(b, a, n_b, n_a)
        return i, j
    stop = np.cumsum(n_b)
    at = gallop(a, b, np.repeat(stop - n_b, n_a), np.repeat(stop, n_a))
    hit = np.flatnonzero(at < np.repeat(stop, n_a))
    hit = hit[b[at[hit]] == a[hit]]
    return hit, at[hit]


@dataclass
class Table:
    """What is known of stretches, by number."""

    n: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))  # tokens of either kind, groups, links
    fits: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    shown: list[str] = field(default_factory=list)  # groups as text, each ended by ;
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each in key and times
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of linked pairs
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: Table) -> Table:
        joint = [np.concatenate((getattr(self, x), getattr(other, x))) for x in ("n", "fits", "key", "times")]
        return Table(joint[0], joint[1], self.shown + other.shown, np.concatenate((self.first, self.first[-1] + other.first[1:])), *joint[2:])

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of codes, place in key) of all pairs of stretches."""
        return ranges(self.first[codes], self.first[codes + 1] - self.first[codes])


class Aligner:
    """Both tokenizers and the stretches seen so far. A pair of ids is a key: id of A times the size of B's vocabulary plus id of B."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.known: dict[str, int] = {}  # without the space that each begins with
        self.table = Table()
        ends = ((self.a.size, ","), (self.a.size, "|"), (self.b.size, ","), (self.b.size, ";"))
        self.word = [f"{i}{end}" for size, end in ends for i in range(size)]  # an id in the text of groups
        self.width = np.array([len(w) for w in self.word], np.int64)

    def _aligned(self, texts: list[str]) -> Table:
        raw = "".join(texts).encode()
        (a, n_a), (b, n_b) = self.a.encode(texts), self.b.encode(texts)
        fits = np.ones(len(texts), bool)
        spelt = [b"".join([kind.entry[i] for i in ids.tolist()]) for kind, ids in ((self.a, a), (self.b, b))]
        if spelt != [raw, raw]:
            size = np.array([len(t.encode()) for t in texts])
            for kind, ids, n, own in ((self.a, a, n_a, spelt[0]), (self.b, b, n_b, spelt[1])):
                stop = np.concatenate(([0], np.cumsum(_sums(kind.length[ids], np.concatenate(([0], np.cumsum(n)))))))
                at = 0
                for k, m in enumerate(size.tolist()):
                    fits[k] &= own[stop[k] : stop[k + 1]] == raw[at : at + m]
                    at += m
            a, b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
            n_a, n_b = n_a * fits, n_b * fits
        i, j = common_ends(np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b]), n_a, n_b)
        p, q = np.diff(i, prepend=-1), np.diff(j, prepend=-1)  # tokens of each group
        of = np.repeat(np.arange(len(texts)), n_a)[i]
        groups = np.searchsorted(of, np.arange(len(texts) + 1))
        n = np.column_stack((n_a, n_b, np.diff(groups), _sums(p * q, groups)))

        start = np.cumsum(p + q) - p - q
        code = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(p)), q)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[i], last_b[j] = 1, 1
        code[(start - (i + 1 - p))[group_a] + np.arange(len(a))] = a + self.a.size * last_a
        code[(start + p - (j + 1 - q))[group_b] + np.arange(len(b))] = b + self.b.size * last_b + 2 * self.a.size
        text = "".join([self.word[k] for k in code.tolist()])
        ends = np.concatenate(([0], np.cumsum(self.width[code])))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        shown = [text[x:y] for x, y in zip(ends, ends[1:], strict=False)]

        small = np.flatnonzero(p * q < WIDE_GROUP)
        who, within = ranges(np.zeros(len(small), np.int64), (p * q)[small])
        g = small[who]
        keys = a[(i + 1 - p)[g] + within // q[g]] * self.b.size + b[(j + 1 - q)[g] + within % q[g]]
        times = np.ones(len(keys), np.int64)
        for w in np.flatnonzero(p * q >= WIDE_GROUP).tolist():
            x, y = (np.unique(ids[e + 1 - m : e + 1], return_counts=True) for ids, e, m in ((a, i[w], p[w]), (b, j[w], q[w])))
            keys = np.concatenate((keys, (x[0][:, None] * self.b.size + y[0]).ravel()))
            times = np.concatenate((times, (x[1][:, None] * y[1]).ravel()))
            g = np.concatenate((g, np.full(len(x[0]) * len(y[0]), w)))
        by = np.argsort(g, kind="stable") if len(small) < len(p) else slice(None)
        first = np.searchsorted(of[g[by]], np.arange(len(texts) + 1))
        return Table(n, fits, shown, first, keys[by], times[by])

    def of(self, texts: list[str | None]) -> tuple[Table, np.ndarray, np.ndarray, np.ndarray]:
        """A table, the stretches of all texts by number, the text of each stretch, and which texts have tokens. Others have no stretches."""
        split = [_stretches(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        code = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        table = self.table
        miss = np.flatnonzero(code < 0).tolist()
        if miss:
            missed = [flat[i] for i in miss]
            fresh = list(dict.fromkeys(missed))
            fresh.sort(key=lambda s: len(s) > KNOWN_CHARS)  # those to be remembered first
            number = dict(zip(fresh, range(len(table.shown), len(table.shown) + len(fresh)), strict=True))
            code[miss] = [number[s] for s in missed]
            found = self._aligned([f" {s}" for s in fresh])
            keep = sum(len(s) <= KNOWN_CHARS for s in fresh) if len(self.known) < KNOWN else 0
            if keep == len(fresh):
                table = self.table = table + found
            else:
                if keep:
                    cut = found.first[keep]
                    self.table = table + Table(found.n[:keep], found.fits[:keep], found.shown[:keep], found.first[: keep + 1], found.key[:cut], found.times[:cut])
                table = table + found
            self.known.update((s, number[s]) for s in fresh[:keep])
        whole = np.array([bool(t) for t in texts], bool)
        whole[doc[~table.fits[code]]] = False
        use = whole[doc]
        return table, code[use], doc[use], whole


def _stretches(text: str) -> list[str]:
    """The stretches of a text, each without the space that it begins with."""
    if text[0] != " " and text[-1] != " " and not _ODD.search(text):
        return text.split(" ")
    return [s[1:] for s in _CUT.split(" " + text)]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def linked(rows: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, row, COUNTS, groups_sha256, keys and times of rows (doc_id, text): the pairs that each links, once, and how often. row tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            aligner = kept(f"alignment of {a} and {b}", lambda: Aligner(a, b))
            span = aligner.a.size * aligner.b.size
            for c in chunks(batch.column(1)):
                texts = [None if c.null[i] else c.text(i).decode() for i in range(c.n)]
                table, code, doc, whole = aligner.of(texts)
                cut = np.searchsorted(doc, np.arange(c.n + 1))
                sums = [pa.array(_sums(table.n[code, k], cut)) for k in range(len(COUNTS))]
                codes = code.tolist()
                digest = [hashlib.sha256("".join([table.shown[k] for k in codes[i:j]])[:-1].encode()).hexdigest() if ok else "" for i, j, ok in zip(cut, cut[1:], whole, strict=False)]
                keys, times, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                step = max(1, (1 << 62) // span)  # documents whose keys fit into a long together
                for low in range(0, c.n, step):
                    part = code[cut[low] : cut[min(c.n, low + step)]]
                    which, at = table.pairs(part)
                    own = doc[cut[low] + which] - low
                    joint, where = np.unique(own * span + table.key[at], return_inverse=True)
                    total = np.zeros(len(joint), np.int64)
                    np.add.at(total, where, table.times[at])
                    keys.append(joint % span)
                    times.append(total)
                    n.append(np.bincount(joint // span, minlength=min(step, c.n - low)))
                ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(n)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (keys, times)]
                ids = pa.array((task << 33) + row + np.arange(c.n))
                row += c.n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), ids, *sums, pa.array(digest, pa.string()), *lists], ["doc_id", "row", *COUNTS, "groups_sha256", "keys", "times"])

    return rows.mapInArrow(run, "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>")


OUT = ("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def _judged(rows: DataFrame, size_b: int, often: tuple[np.ndarray, np.ndarray], best: np.ndarray) -> DataFrame:
    """OUT, row, and rest: the pairs that aren't in often (keys, counts). best: the highest count of each id of A."""
    sent = rows.sparkSession.sparkContext.broadcast((*often, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, highest = sent.value
        for batch in batches:
            key, times = (batch.column(k).flatten().to_numpy() for k in (7, 8))
            ends = np.concatenate(([0], np.cumsum(batch.column(7).value_lengths().to_numpy())))
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            count = np.where(hit, counts[place], 0) if len(keys) else np.zeros(len(key), np.int64)
            top = times * (hit & (count == highest[key // size_b]))
            rare = np.concatenate(([0], np.cumsum(_sums(~hit, ends)))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(rare), pa.StructArray.from_arrays([pa.array(key[~hit]), pa.array(times[~hit])], ["key", "times"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:6], pa.array(_sums(top, ends)), pa.array(_sums(times * count, ends)), batch.column(6), batch.column(1), rest], [*OUT, "row", "rest"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, row long, rest array<struct<key:long,times:long>>")


def align(docs: DataFrame, a: str | None = None, b: str | None = None, text: str = "text", id_col: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """OUT of every row of docs. a and b: paths of a byte-level vocabulary and of one of pieces.

    A text that is null or empty, or that either tokenizer doesn't spell byte for byte, has no tokens. frequent: how many
    pairs' counts are sent to tasks, at most; it decides how the others are found, not what is found.
    """
    a, b = a or tokenizer_path(TOKENIZER_A), b or tokenizer_path(TOKENIZER_B)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = written(linked(rows, a, b))
    counts = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("count"))
    counts = written(counts.withColumn("class", F.floor(F.log2("count") * STEPS)))
    sizes = sorted(((r["class"], r["count"]) for r in counts.groupBy("class").count().collect()), reverse=True)  # a row for each of some hundred classes
    low, held = 0, 0
    for c, n in sizes:
        if held + n > frequent:
            low = c + 1
            break
        held += n
    chosen = counts.where(F.col("class") >= low).select("key", "count").toArrow()
    by = np.argsort(chosen.column("key").to_numpy())
    often = (chosen.column("key").to_numpy()[by], chosen.column("count").to_numpy()[by])
    size_a, size_b = ByteTokens(a).size, PieceTokens(b).size
    id_of_a = F.expr(f"`key` div {size_b}L").alias("a")
    highest = counts.groupBy(id_of_a).agg(F.max("count").alias("best"))  # as many as A's vocabulary at most
    table = highest.toArrow()
    best = np.zeros(size_a, np.int64)
    best[table.column("a").to_numpy()] = table.column("best").to_numpy()
    judged = _judged(rows, size_b, often, best)
    if not low:
        return judged.select(*OUT)
    judged = written(judged)
    rest = judged.select("row", F.explode("rest").alias("p")).select("row", "p.*")
    met = joined(rest, written(counts.where(F.col("class") < low).select("key", "count")), "key").withColumn("a", id_of_a)
    met = met.join(F.broadcast(highest), "a")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    both = judged.drop("rest").join(more, "row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return both.withColumns(added).select(*OUT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over every whole text of documents.

    Null and empty texts, and those with a token that doesn't spell its bytes, have zeros and an empty digest. Repeated
    rows are documents of their own and count as such; null ids stay. Texts of any length are read whole; ties for
    the highest count of an id all count. Columns beyond doc_id and text, whatever their names, are ignored; an empty
    table gives no rows.
    """
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
