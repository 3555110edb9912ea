"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of an item. Of each run of 13 words the least hash of its 5-word grams
is kept as a fingerprint (nine grams to a run), in documents and in items alike, so two texts that share
13 words in a row also share a fingerprint there. Fingerprints of documents are joined with those of the
items; each hit is extended to all windows around it, which are compared by a second hash of all their
words. Items of fewer than 13 words are one window; those are looked up by their own length.

Up to INDEX_BYTES of items are sent to all tasks as an index of fingerprints and windows: documents then aren't
shuffled, and a passage that many of them share costs each the same. Larger benchmarks stay tables, and the
fingerprints of both sides are joined by Spark. Neither way pairs positions, so repeated words cost what others do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm._shared import free_name, joined, written
from tracemill.llm._text import Chunk, Words, chunks, mix, slices, words

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1  # grams of a window
ITEM_BYTES = 100  # that an item counts besides its id and text
SOME_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
INDEX_BYTES = 32 << 20  # text of items that is sent to all tasks; more is joined
SHARE = 20  # contaminated: hit words are at least one in so many
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_Q = np.uint64(0xD6E8FEB86659FD93)


def ngrams(w: Words, n: int, salt: int) -> np.ndarray:
    """Hashes of the n words from each word on; NEVER where the document ends before."""
    size = len(w.hash)
    out = np.full(size, NEVER)
    if size >= n:
        h = np.full(size - n + 1, salt, np.uint64)
        for j in range(n):
            h = h * _Q + w.hash[j : size - n + 1 + j]
        h = mix(h)
        h[h == NEVER] = 0
        out[: size - n + 1] = np.where(w.doc[: size - n + 1] == w.doc[n - 1 :], h, NEVER)
    return out


def _sliding(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """f over x[i:i + n] for each i; runs off the end are cut short."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        more = out.copy()
        f(out[:-step], out[step:], out=more[:-step]) if len(out) > step else None
        out, have = more, have + step
    return out


def winnow(gram: np.ndarray) -> np.ndarray:
    """Positions of grams that are the least of some run of SPAN grams; ties are all kept."""
    least = _sliding(np.minimum, gram, SPAN)
    # The largest minimum of the runs that hold position i: those that begin at i - SPAN + 1 .. i.
    most = _sliding(np.maximum, np.concatenate((np.zeros(SPAN - 1, np.uint64), least)), SPAN)[: len(gram)]
    return np.flatnonzero((gram == most) & (gram != NEVER))


def _short(w: Words, n: int, most: int = WINDOW - 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of words up to most: hashes of the documents of just so many words, and which they are."""
    count = np.bincount(w.doc, minlength=n)
    out = {}
    for size in set(count[(count > 0) & (count <= most)].tolist()):
        first = np.flatnonzero((count[w.doc] == size) & (np.diff(w.doc, prepend=-1) != 0))
        out[size] = ngrams(w, size, 3)[first], w.doc[first]
    return out


def around(at: np.ndarray, n: int) -> np.ndarray:
    """Of n positions those at which a window begins that holds a gram which begins at one of at."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(at - SPAN + 1, 0), 1)
    np.add.at(step, at + 1, -1)
    return np.flatnonzero(np.cumsum(step[:n]) > 0)


class Index:
    """The windows of items, by fingerprints: distinct windows, each with the number of a list of distinct items."""

    def __init__(self, items: list[tuple[str, str]]):
        """(item id, text) pairs."""
        self.ids = np.array([i for i, _ in items], object)
        _, self.same = np.unique(self.ids.astype(str), return_inverse=True) if len(items) else (None, np.zeros(0, np.int64))
        key, item, prints = [], [], [np.zeros(0, np.uint64)]
        self.sizes: set[int] = set()
        for c in chunks(pa.array([t for _, t in items], pa.large_string())):
            w = words(c)
            gram, window = ngrams(w, GRAM, 1), ngrams(w, WINDOW, 2)
            prints.append(gram[winnow(gram)])
            full = window != NEVER
            key.append(window[full])
            item.append(w.doc[full] + c.first)
            for size, (h, who) in _short(w, c.n).items():
                self.sizes.add(size)
                key.append(h)
                item.append(who + c.first)
        self.print = np.unique(np.concatenate(prints))
        key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        item = self.same[np.concatenate(item)] if len(key) else np.zeros(0, np.int64)
        pair = np.unique(np.stack((key, item.astype(np.uint64)), axis=1), axis=0)
        self.window, first, count = np.unique(pair[:, 0], return_index=True, return_counts=True)
        # Windows of the same items share a list, told by a sum of hashes.
        total = np.add.reduceat(mix(pair[:, 1] + np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)
        _, one, self.list = np.unique(total, return_index=True, return_inverse=True)
        names = np.unique(self.ids.astype(str))
        self.lists = [names[pair[first[i] : first[i] + count[i], 1].astype(np.int64)].tolist() for i in one]
        self.maybe = np.zeros(1 << 20, bool)  # a bit for each fingerprint's upper bits, to pass over most grams
        self.maybe[(self.print >> np.uint64(44)).astype(np.int64)] = True

    def _find(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of each hash in a sorted table, -1 if it isn't there."""
        if not len(table):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return np.where(table[k] == h, k, -1)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows that occur: first word, number of words, list of items. Every word is looked at a fixed number of times."""
        out = [np.zeros((3, 0), np.int64)]
        gram = ngrams(w, GRAM, 1)
        at = winnow(gram)
        at = at[self.maybe[(gram[at] >> np.uint64(44)).astype(np.int64)]]
        at = at[self._find(self.print, gram[at]) >= 0]
        if len(at):
            a = around(at, len(gram))
            window = ngrams(w, WINDOW, 2)[a]
            k = self._find(self.window, window)
            ok = (k >= 0) & (window != NEVER)
            out.append(np.stack((a[ok], np.full(int(ok.sum()), WINDOW), self.list[k[ok]])))
        for size in self.sizes:
            gram = ngrams(w, size, 3)
            k = self._find(self.window, gram)
            a = np.flatnonzero((k >= 0) & (gram != NEVER))
            out.append(np.stack((a, np.full(len(a), size), self.list[k[a]])))
        return tuple(np.concatenate(out, axis=1))


#: What is known of a document: number of words, ranges of hit words (begin, end, begin, end ...), items.
FOUND = T.StructType(
    [T.StructField("n_words", T.LongType(), False), T.StructField("spans", T.ArrayType(T.LongType(), False), False), T.StructField("items", T.ArrayType(T.StringType(), False), False)]
)


def _merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges joined where they touch, as begin, end, begin, end ..."""
    if not len(begin):
        return np.zeros(0, np.int64)
    by = np.argsort(begin, kind="stable")
    begin, reach = begin[by], np.maximum.accumulate(end[by])
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    last = np.concatenate((first[1:] - 1, [len(begin) - 1]))
    return np.stack((begin[first], reach[last]), axis=1).ravel()


def _found(c: Chunk, index: Index) -> list[dict]:
    w = words(c)
    n = np.bincount(w.doc, minlength=c.n)
    first = np.cumsum(n) - n
    at, size, lists = index.hits(w)
    doc = w.doc[at]
    by = np.argsort(doc, kind="stable")
    at, size, lists, doc = at[by], size[by], lists[by], doc[by]
    lo, hi = np.searchsorted(doc, np.arange(c.n), "left"), np.searchsorted(doc, np.arange(c.n), "right")
    return [
        {"n_words": int(n[i]), "spans": [], "items": []}
        if lo[i] == hi[i]
        else {
            "n_words": int(n[i]),
            "spans": _merged(at[lo[i] : hi[i]] - first[i], (at + size)[lo[i] : hi[i]] - first[i]).tolist(),
            "items": sorted({x for k in set(lists[lo[i] : hi[i]].tolist()) for x in index.lists[k]}),
        }
        for i in range(c.n)
    ]


_ARROW = pa.struct([pa.field("n_words", pa.int64(), False), pa.field("spans", pa.list_(pa.field("element", pa.int64(), False)), False), pa.field("items", pa.list_(pa.field("element", pa.string(), False)), False)])


def _by_index(docs: DataFrame, items: DataFrame, text: str, into: str) -> DataFrame:
    """The items as an index in every task; only for items of a checked size."""
    sent = docs.sparkSession.sparkContext.broadcast(Index([(r.id, r.text) for r in items.collect()]))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [x for c in chunks(batch.column(at)) for x in _found(c, sent.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, _ARROW)], [*batch.schema.names, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(None).cast(FOUND)).schema)


def _hashes(rows: DataFrame, schema: str, of) -> DataFrame:
    """rows (a key, text, and perhaps prints) -> what of(words, chunk, batch) gives: row numbers in the batch, and columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in slices(batches):
            for c in chunks(batch.column(1)):
                who, *columns = of(words(c), c, batch)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who + c.first, pa.int64())), *(pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns)], names)

    return rows.mapInArrow(run, schema)


def _by_join(docs: DataFrame, items: DataFrame, text: str, into: str) -> DataFrame:
    """Fingerprints of texts joined with those of items, then the windows around what met: for items of any size.

    Texts take part once each, so that copies cost nothing. Fingerprints and windows that many texts hold, such as the window of an
    item of one frequent word, are dealt over tasks; a text's places of a window go to its items as one.
    """
    key = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    texts = written(docs.select(key.alias("key"), F.col(text).cast("string").alias("text")).where("text is not null").dropDuplicates(["key"]))

    def prints(w: Words, c: Chunk, batch: pa.RecordBatch):
        gram = ngrams(w, GRAM, 1)
        at = winnow(gram)
        return w.doc[at], gram[at]

    def item_windows(w: Words, c: Chunk, batch: pa.RecordBatch):
        full = np.flatnonzero((h := ngrams(w, WINDOW, 2)) != NEVER)
        parts = [(w.doc[full], h[full], np.full(len(full), WINDOW)), *((who, x, np.full(len(x), size)) for size, (x, who) in _short(w, c.n).items())]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    theirs = written(_hashes(items, "item string, window long, n long", item_windows).distinct())
    sizes = [r.n for r in theirs.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # 12 at most
    wanted = _hashes(items, "item string, print long", prints).select("print").distinct()
    met = joined(_hashes(texts, "key string, print long", prints).distinct(), written(wanted), "print").groupBy("key").agg(F.collect_set("print").alias("prints"))

    def near(w: Words, c: Chunk, batch: pa.RecordBatch):
        mine = batch.column(2).slice(c.first, c.n)
        gram = ngrams(w, GRAM, 1)
        at = winnow(gram)
        lists = [np.asarray(mine[i].values.to_numpy(zero_copy_only=False)).view(np.uint64) for i in range(c.n)]
        own = np.concatenate([at[w.doc[at] == i][np.isin(gram[at[w.doc[at] == i]], x)] for i, x in enumerate(lists)])
        a = around(own, len(gram))
        h = ngrams(w, WINDOW, 2)[a]
        a, h = a[h != NEVER], h[h != NEVER]
        first = np.searchsorted(w.doc, w.doc[a])
        return w.doc[a], h, np.full(len(a), WINDOW), a - first

    def short(w: Words, c: Chunk, batch: pa.RecordBatch):
        parts = []
        for size in sizes:
            h = ngrams(w, size, 3)
            a = np.flatnonzero(h != NEVER)
            parts.append((w.doc[a], h[a], np.full(len(a), size), a - np.searchsorted(w.doc, w.doc[a])))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    shape = "key string, window long, n long, at long"
    windows = _hashes(texts.join(met, "key").select("key", "text", "prints"), shape, near)
    if sizes:
        windows = windows.unionByName(_hashes(texts, shape, short))
    w = F.struct("window", "n").alias("w")
    lists = written(theirs.select(w, "item").groupBy("w").agg(F.collect_list("item").alias("items")))
    places = written(joined(windows.select("key", w, "at"), written(lists.select("w")), "w").groupBy("key", "w").agg(F.collect_set("at").alias("at")))
    items_of = joined(places.select("key", "w"), lists, "w").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    at = F.flatten(F.collect_list(F.transform("at", lambda x: F.struct(x.alias("at"), F.col("w.n").alias("n")))))
    hit = places.groupBy("key").agg(at.alias("at")).join(items_of, "key")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_merged(np.array([x["at"] for x in v]), np.array([x["at"] + x["n"] for x in v])).tolist() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.int64())), b.column(2)], ["__key", "__spans", "__items"])

    hit = written(hit.mapInArrow(merge, "__key string, __spans array<long>, __items array<string>"))
    at = docs.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = [np.bincount(words(c).doc, minlength=c.n) for c in chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], [*batch.schema.names, "__n"])

    rows = docs.mapInArrow(count, docs.withColumn("__n", F.lit(0).cast("long")).schema).withColumn("__key", key)
    # Only texts with hits are found here; a hot one of them is split by Spark's own handling of skewed joins.
    rows = rows.join(hit, "__key", "left")
    found = F.struct(F.col("__n").alias("n_words"), F.coalesce("__spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
    return rows.select(*docs.columns, found.alias(into))


def find(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "found", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with a column more, a struct FOUND.

    A null text has no words. An item without id or text takes no part; rows that repeat an item count once.
    Repeated documents stay. A column of docs that is named as the new one is replaced.
    """
    docs = docs.drop(into)
    items = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(SOME_WORD))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id") + ITEM_BYTES), F.lit(0))).first()[0]
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names that none of the columns added on the way has
    return (_by_index if total <= index_bytes else _by_join)(plain, items, f"c{docs.columns.index(text)}", "found").toDF(*docs.columns, into)


def contaminated(found: str = "found"):
    """Column: hit words are at least one in SHARE of a document's words."""
    return (n_hit(found) > 0) & (SHARE * n_hit(found) >= F.col(f"{found}.n_words"))


def n_hit(found: str = "found"):
    spans = F.col(f"{found}.spans")
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that are contaminated; columns stay as they are. Null and empty texts stay, copies are judged alike."""
    found = free_name(docs.columns, "__found")
    return find(docs, items, into=found).where(~contaminated(found)).drop(found)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark.

    A null or empty text has no words and is clean. Repeated rows give a row each. Items without id or text take no
    part, those of fewer than 13 words are one window; an empty benchmark hits nothing. Columns beyond doc_id, text and
    item_id, whatever their names, are ignored; texts of any length are read whole.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find(docs, items)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


QUERIES = {"op6_decontaminate": op6_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bk AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM bk),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (SELECT x.doc_id, x.k, x.n, iw.item_id FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM dk) x JOIN iw ON x.g = iw.g AND x.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
}
