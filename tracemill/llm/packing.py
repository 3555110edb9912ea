"""Packing of documents into sequences by cutting-stock column generation.

A document's token ids (and a closing id) are cut into pieces of the sequence length and a rest. The
histogram of piece lengths, in classes of UNIT tokens, is the demand of a cutting-stock problem: a linear
program over patterns (how many pieces of each class a sequence holds), to which a knapsack by dynamic
programming over the dual prices adds columns until none is worth it. Patterns are used a whole number of
times; what that leaves is filled by greedy patterns. Only the histogram, of a fixed size, comes to the
driver. Pieces are ranked within their class by counts of (class, bucket), a class having as many buckets as its
share of the rows needs, and rank k takes the k-th place that the patterns have for the class.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm._shared import written
from tracemill.llm._text import chunks, kept, ranges

LENGTH = 4096  # tokens of a sequence
UNIT = 16  # tokens; lengths are rounded up to it when patterns are made
CLOSING_ID = 2
KNOWN_WORDS = 300_000  # words whose ids a worker remembers
KNOWN_RUNS = 400_000  # runs of letters and digits, or of other signs, likewise
MAX_COLUMNS = 4000
GAP = 1e-3  # of the linear program, at which no more columns are asked for
RANK_ROWS = 500  # pieces of a class that are ranked in one bucket, about
TOKENIZER = "word_bpe_49k.json"
# ASCII without ' and controls, and letters of Latin-1, but no <| as of a special token: words in which runs can be told by bytes.
_PLAIN = re.compile(rb"(?:[!-&(-;=-~]|<(?!\|)|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*").fullmatch
_RUN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words, end to end; ASCII white space is enough to cut at. It lower-cases, and letters and digits never
    share a token with other signs, so a plain word is cut further into runs of either kind. Words and runs
    seen before are looked up; the tables stop growing at a fixed size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, int] = {}
        self.runs: dict[bytes, bytes] = {}  # ids as 32-bit integers, which take less room than objects
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _runs(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """Ids of plain runs, many at a time; the places of their tokens tell them apart."""
        out = {}
        for i in range(0, len(fresh), 2000):
            part = fresh[i : i + 2000]
            texts = [w.decode() for w in part]
            start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
            e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32).tobytes()
            run = np.searchsorted(start, np.array([a for a, _ in e.offsets], np.int64), "right") - 1
            cut = (4 * np.searchsorted(run, np.arange(len(part) + 1))).tolist()
            out.update((w, ids[a:b]) for w, a, b in zip(part, cut, cut[1:], strict=False))
        return out

    def _ids(self, fresh: list[bytes]) -> list[bytes]:
        """Ids of words."""
        split = [[w.lower()] if w.isalnum() else _RUN.findall(w.lower()) if _PLAIN(w) else None for w in fresh]
        have = self.runs
        runs = self._runs(list({r for s in split if s is not None for r in s if r not in have}))
        if len(have) < KNOWN_RUNS:
            have.update(runs)
        else:
            runs.update((r, have[r]) for s in split if s is not None for r in s if r in have)
            have = runs
        odd = [w for w, s in zip(fresh, split, strict=True) if s is None]
        whole = iter([np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch([w.decode() for w in odd], add_special_tokens=False)])
        return [next(whole) if s is None else have[s[0]] if len(s) == 1 else b"".join([have[r] for r in s]) for s in split]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts. Millions of small objects, none in a cycle, are made: Python's search for cycles is off meanwhile."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        code = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        flat, first = self.flat, self.first
        miss = np.flatnonzero(code < 0).tolist()
        if miss:
            missed = [words[i] for i in miss]
            fresh = list(set(missed))
            found = self._ids(fresh)
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.concatenate((flat, np.frombuffer(b"".join(found), np.uint32)))
            first = np.concatenate((first, first[-1] + np.cumsum(size)))
            number = dict(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            code[miss] = [number[w] for w in missed]
            if len(self.known) < KNOWN_WORDS:
                self.known.update(number)
                self.flat, self.first = flat, first
        size = first[code + 1] - first[code]
        ids = flat[ranges(first[code], size)[1]] if len(code) else np.zeros(0, np.uint32)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([len(s) for s in split])]
        return np.split(ids, ends[:-1]) if len(ends) else []


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece. A null text is empty: its only id is the closing one."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(f"ids of {path}", lambda: WordIds(path))
        for batch in batches:
            for c in chunks(batch.column(1)):
                who, start, size, crc, total = [], [], [], [], []
                for i, ids in enumerate(coder.encode([c.text(i) for i in range(c.n)])):
                    ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
                    for at in range(0, len(ids), length):
                        part = ids[at : at + length]
                        who.append(c.first + i)
                        start.append(at)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    zero = F.lit(0).cast("long")
    return rows.mapInArrow(run, rows.select("doc_id", zero.alias("start"), zero.alias("length"), zero.alias("ids_crc32"), zero.alias("doc_tokens")).schema)


def knapsack(value: np.ndarray, size: np.ndarray, room: int, most: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The worthiest multiset of items of the given sizes within room; most limits each."""
    if most is None:
        most = room // size
    best = np.zeros(room + 1)
    taken = np.zeros((len(value), room + 1), np.int32)
    for i in np.flatnonzero((value > 1e-12) & (most > 0)):
        s = int(size[i])
        new, count = best.copy(), np.zeros(room + 1, np.int32)
        for k in range(1, min(int(most[i]), room // s) + 1):
            other = best[: room + 1 - k * s] + k * value[i]
            better = other > new[k * s :] + 1e-12
            new[k * s :][better] = other[better]
            count[k * s :][better] = k
        best, taken[i] = new, count
    out, left = np.zeros(len(value), np.int64), room
    for i in range(len(value) - 1, -1, -1):
        out[i] = taken[i, left]
        left -= int(out[i] * size[i])
    return float(best[room]), out


def column_generation(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, fractions allowed, at least cost: a revised simplex that asks the knapsack for columns."""
    m = len(size)
    basis = np.diag(room // size).astype(np.float64)  # a column of each class by itself
    inverse = np.diag(1.0 / (room // size))
    x = inverse @ demand
    for _ in range(MAX_COLUMNS):
        price = inverse.sum(0)
        worth, column = knapsack(np.maximum(price, 0), size, room)
        # No pattern is worth over `worth`, so the optimum is at least the present cost divided by it.
        if worth <= 1 + GAP:
            break
        move = inverse @ column
        able = move > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = x - step * move
        x[out] = step
        x = np.maximum(x, 0)
        basis[:, out] = column
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
    return basis.T.astype(np.int64), x


@dataclass
class Plan:
    """Places for the pieces of each class: pattern runs p with n sequences from first on, holding count places of the class in each."""

    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # class -> (places before, first sequence, count, place in the sequence)

    def place(self, kind: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and order in it of the piece of each rank."""
        before, first, count, order = self.places[kind]
        p = np.searchsorted(before, rank, "right") - 1
        r = rank - before[p]
        return first[p] + r // count[p], order[p] + r % count[p]


def plan(demand: dict[int, int], room: int) -> Plan:
    """demand: pieces by class (size in units)."""
    size = np.array(sorted(k for k, v in demand.items() if v > 0), np.int64)
    need = np.array([demand[int(k)] for k in size], np.int64)
    runs: list[tuple[np.ndarray, int]] = []
    if len(size):
        patterns, x = column_generation(size, need.astype(np.float64), room)
        for a, n in sorted(zip(patterns.tolist(), np.floor(x + 1e-6).astype(np.int64).tolist(), strict=True), key=lambda r: -r[1]):
            pattern = np.array(a)
            n = min(n, int((need[pattern > 0] // pattern[pattern > 0]).min())) if (pattern > 0).any() else 0
            if n > 0:
                runs.append((pattern, n))
                need = need - n * pattern
        while need.sum():  # a few sequences of what the rounding left
            big = np.flatnonzero(need)[-1]
            pattern = np.zeros(len(size), np.int64)
            pattern[big] = 1
            _, rest = knapsack(size.astype(np.float64) * (1 + 1e-6 * size), size, room - int(size[big]), need - pattern)
            pattern = pattern + rest
            n = int((need[pattern > 0] // pattern[pattern > 0]).min())
            runs.append((pattern, n))
            need = need - n * pattern
    places: dict[int, list] = {int(k): [] for k in size}
    first = 0
    before = dict.fromkeys(places, 0)
    for pattern, n in runs:
        at = 0
        for k in np.flatnonzero(pattern)[::-1]:
            kind, count = int(size[k]), int(pattern[k])
            places[kind].append((before[kind], first, count, at))
            before[kind] += n * count
            at += count
        first += n
    return Plan({k: tuple(np.array(v, np.int64).T) for k, v in places.items()})


def pack(found: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """pieces(), written -> the same with sequence_id and offset. Every piece has one place; repeated rows count apart."""
    kind = F.ceil(F.col("length") / unit).cast("int")
    rows = found.withColumn("__kind", kind)
    demand = {r["__kind"]: r["count"] for r in rows.groupBy("__kind").count().collect()}  # length / unit rows at most
    layout = plan(demand, length // unit)
    buckets = F.element_at(F.create_map(*(F.lit(x) for k, n in demand.items() for x in (k, -(-n // RANK_ROWS)))), F.col("__kind")) if demand else F.lit(1)
    # Repeated rows, which no hash of theirs tells apart, are dealt by their numbers, if they were numbered.
    by = ["__row"] if "__row" in found.columns else ["doc_id", "start", "ids_crc32"]
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*by), buckets).cast("int"))
    counts = rows.groupBy("__kind", "__bucket").count()
    before = Window.partitionBy("__kind").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__kind", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__kind", "__bucket").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = rows.withColumn("__rank", F.row_number().over(within) - 1).join(base, ["__kind", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__base"))
    sent = found.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seq, order = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            kinds, rank = b["__kind"].to_numpy(), b["__rank"].to_numpy(np.int64)
            for k in np.unique(kinds):
                own = kinds == k
                seq[own], order[own] = sent.value.place(int(k), rank[own])
            out = b.drop(columns=["__kind", "__rank"])
            out["sequence_id"], out["__order"] = seq, order
            yield out

    columns = [c for c in found.columns if c != "__row"]
    shape = found.select(*columns).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("__order", F.lit(0).cast("long")).schema
    placed = ranked.select(*columns, "__kind", "__rank").mapInPandas(run, shape)
    so_far = Window.partitionBy("sequence_id").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces with their places. They are numbered before they are written, so that a number stays with its row."""
    return pack(written(pieces(docs).withColumn("__row", F.monotonically_increasing_id())))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    A null text is empty: its one piece is the closing id. Repeated rows and null ids are packed apart, each with a place
    of its own. Columns beyond doc_id and text, whatever their names, are ignored. Texts of any length are encoded whole
    and cut at 4096 tokens; an empty table gives no rows.
    """
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
