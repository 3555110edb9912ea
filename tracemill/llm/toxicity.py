"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of digits, a-z and characters beyond ASCII, A-Z lower-cased) have hashed embeddings, the sum of
those of the word and of its beginnings, so that inflected forms share what is learnt; filters of several
widths run over the whole text. Each gives its largest response in every stretch of SEGMENT words; a
logistic unit joins the largest of these and their mean, which tells a single slip from abuse throughout. The
embeddings begin with smoothed log-odds of each word and beginning, in a component of its own kind, and random numbers
that tell words apart; a row that is trained on sees the odds without itself. Thresholds are calibrated by language on rows that neither odds nor filters come from; the
language is predicted from the text itself. A score of 0.5 is the threshold.

All labelled rows count, whole texts: one in CALIBRATE, by a hash of the id, for the thresholds, by a histogram; all others for the
log-odds, which are counted by Spark, and for filters and embeddings. For these, in each of ROUNDS rounds every task goes on from the same ones
with stochastic gradients over its own rows, BLOCK at a time, and what the tasks end with is averaged. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import language
from tracemill.llm._shared import fold, free_name, written
from tracemill.llm._text import Chunk, chunks, ranges, slices, words

BUCKET_BITS = 18
PAD = 1 << BUCKET_BITS  # a row of the embeddings that stays zero
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
PREFIXES = (4, 5, 6, 7)  # bytes of the beginnings
KINDS = 1 + len(PREFIXES)
SEGMENT = 64  # words
CALIBRATE = 4  # one row in so many is kept for the thresholds
ROUNDS = 3
VISITS = 16_000  # of rows, at least; so a few rows are gone through more often
MOST_TIMES = 5  # that a round goes through a row
BLOCK = 2000  # rows that a task holds at once
BATCH = 32
BIN = 1 / 64  # of a logit, in the histograms
PRIOR = 10.0  # weight of the class share in a word's log-odds
SPOT_BITS = 26  # of the filter that tells most unlabelled rows apart: 8 MB, whatever the number of rows; with more of those more pass it
CODEC = "zstd"  # of texts on their way to their labels


def word_ids(c: Chunk) -> list[np.ndarray]:
    """Of each document the buckets of each word and its beginnings (PAD for those it is too short for)."""
    w = words(c, prefixes=PREFIXES)
    every = np.column_stack((w.hash, w.prefix))
    ids = np.where(every == 0, PAD, every >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    return np.split(ids, np.cumsum(np.bincount(w.doc, minlength=c.n))[:-1])


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents end to end, each followed by padding for the widest filter; (ids, starts, ends). An empty one has a padding word."""
    gap = np.full((max(WIDTHS) - 1, KINDS), PAD, np.int32)
    parts, n = [], np.array([max(len(d), 1) for d in docs], np.int64)
    for d in docs:
        parts += [d if len(d) else gap[:1], gap]
    start = np.concatenate(([0], np.cumsum(n + len(gap))[:-1]))
    return np.concatenate(parts), start, start + n


@dataclass
class Pooled:
    x: np.ndarray  # embeddings of the words
    found: list[np.ndarray]  # responses of each width
    start: np.ndarray  # of each segment
    end: np.ndarray
    doc: np.ndarray  # of each segment
    count: np.ndarray  # of each document's segments
    top: np.ndarray  # segment x filter
    features: np.ndarray  # document x (largest, mean)


@dataclass
class ToxicityModel:
    embed: np.ndarray
    filters: list[np.ndarray]  # of each width: width x DIM x FILTERS
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    constant: float | None = None  # the score of all texts, where one class had no rows
    thresholds: dict[str, float] = field(default_factory=dict)  # by language; "" for others

    def __getstate__(self) -> dict:
        """As it is sent to tasks: embeddings in 16 bits."""
        return self.__dict__ | {"embed": self.embed.astype(np.float16)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"embed": state["embed"].astype(np.float32)})

    def responses(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        x = self.embed[ids[:, 0]]
        for k in range(1, KINDS):
            x += self.embed[ids[:, k]]
        found = []
        for width, w, b in zip(WIDTHS, self.filters, self.shift, strict=True):
            n = len(x) - max(WIDTHS) + 1
            found.append(sum((x[k : k + n] @ w[k] for k in range(1, width)), x[:n] @ w[0]) + b)
        return x, found

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(docs))
        i = 0
        while i < len(docs):  # bounded work arrays: about 64k words at a time, or one document
            j, n = i, 0
            while j < len(docs) and (j == i or n + len(docs[j]) <= 1 << 16):
                n += len(docs[j]) + 3
                j += 1
            s = self.pooled(*laid_out(docs[i:j]))
            out[i:j] = s.features @ self.out + self.bias
            i = j
        return out

    def pooled(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> Pooled:
        x, found = self.responses(ids)
        count = -(-(end - start) // SEGMENT)
        doc, k = ranges(np.zeros(len(start), np.int64), count)
        at = start[doc] + SEGMENT * k
        stop = np.minimum(at + SEGMENT, end[doc])
        pairs = np.stack((at, stop), axis=1).ravel()
        if pairs[-1] == len(found[0]):
            pairs = pairs[:-1]
        top = np.concatenate([np.maximum.reduceat(a, pairs)[::2] for a in found], axis=1)
        live = np.maximum(top, 0)
        first = np.cumsum(count) - count
        most = np.maximum.reduceat(live, first)
        mean = np.add.reduceat(live, first) / count[:, None]
        return Pooled(x, found, at, stop, doc, count, top, np.concatenate((most, mean), axis=1))

    def score(self, docs: list[np.ndarray], langs: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        t = np.array([self.thresholds.get(x, self.thresholds.get("", 0.0)) for x in langs])
        return 1 / (1 + np.exp(-np.clip(self.logits(docs) - t, -30, 30)))


def log_odds(pos: np.ndarray, neg: np.ndarray, r: float) -> np.ndarray:
    """Of buckets that so many toxic and clean rows have; r is the share of toxic rows."""
    return np.where(pos + neg > 0, np.log((pos + PRIOR * r) / (neg + PRIOR * (1 - r)) * (1 - r) / r), 0.0)


def embedded(odds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Embeddings with log-odds, and random numbers in the other components where known has odds."""
    rng, embed = np.random.default_rng(12), np.zeros((PAD + 1, DIM), np.float32)
    for i in range(0, PAD + 1, 1 << 14):  # no array of doubles as large
        embed[i : i + (1 << 14)] = rng.normal(0, 0.05, embed[i : i + (1 << 14)].shape)
    embed[~(known != 0).any(1)] = 0
    embed[:, :KINDS] = np.clip(odds, -1, 4)
    embed[PAD] = 0
    return embed


def initial(odds: np.ndarray) -> ToxicityModel:
    """A model before training; odds: bucket x kind."""
    rng = np.random.default_rng(11)
    embed = embedded(odds, odds)
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, :KINDS, : FILTERS // 2] = 0.3 / len(f)
    shift = [np.full(FILTERS, -0.2, np.float32) for _ in WIDTHS]
    return ToxicityModel(embed, filters, shift, rng.normal(0.1, 0.05, 2 * FILTERS * len(WIDTHS)).astype(np.float32), -1.0)


def weights(m: ToxicityModel) -> np.ndarray:
    """What is trained, as one array."""
    return np.concatenate([*(f.ravel() for f in m.filters), *m.shift, m.out, [m.bias]]).astype(np.float64)


def with_weights(m: ToxicityModel, w: np.ndarray) -> ToxicityModel:
    shapes = [(k, DIM, FILTERS) for k in WIDTHS] + [(FILTERS,) for _ in WIDTHS] + [m.out.shape]
    *parts, bias = np.split(w, np.cumsum([int(np.prod(x)) for x in shapes]))
    parts = [x.reshape(shape).astype(np.float32) for x, shape in zip(parts, shapes, strict=True)]
    n = len(WIDTHS)
    return ToxicityModel(m.embed, parts[:n], parts[n : 2 * n], parts[-1], float(bias[0]), m.constant, m.thresholds)


def train(m: ToxicityModel, docs: list[np.ndarray], y: np.ndarray, times: int, rate: float, slow: dict[str, np.ndarray], rng: np.random.Generator, by_class: np.ndarray, embed_sq: np.ndarray) -> None:
    """Stochastic gradients through the largest responses, times through docs; by_class are weights of clean and toxic rows.

    m has embeddings for clean rows and, after them, for toxic ones, neither of which count the row itself.
    """
    docs = [d + np.int32(t * (PAD + 1)) for d, t in zip(docs, y.tolist(), strict=True)]

    def stepped(name: str, g: np.ndarray) -> np.ndarray:
        slow[name] = 0.99 * slow.get(name, g * g) + 0.01 * g * g  # sums of squared gradients
        return rate * g / (np.sqrt(slow[name]) + 1e-5)

    half, buckets = FILTERS * len(WIDTHS), PAD + 1
    order = np.concatenate([rng.permutation(len(docs)) for _ in range(times)])
    for pick in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
        batch = [d if len(d) < 40 else d[rng.random(len(d)) > 0.1] for d in (docs[i] for i in pick)]
        ids, start, end = laid_out(batch)
        s = m.pooled(ids, start, end)
        p = 1 / (1 + np.exp(-np.clip(s.features @ m.out + m.bias, -30, 30)))
        g = ((p - y[pick]) * by_class[y[pick]] / len(pick)).astype(np.float32)
        is_most = s.top >= s.features[s.doc, :half]
        g_top = g[s.doc, None] * (m.out[:half] * is_most + m.out[half:] / s.count[s.doc, None])
        g_top = np.where(s.top > 0, g_top, 0).astype(np.float32)
        g_out, g_bias = s.features.T @ g + 1e-4 * m.out, g.sum()
        size = s.end - s.start
        seg, inside = ranges(s.start, size)
        rows, grads = [], []
        for k, (width, a) in enumerate(zip(WIDTHS, s.found, strict=True)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            at, f = np.nonzero(a[inside] == s.top[seg][:, cols])
            _, first = np.unique(seg[at] * FILTERS + f, return_index=True)
            where = inside[at[first]].reshape(len(size), FILTERS)
            gt = g_top[:, cols]
            g_w = np.stack([np.einsum("nf,nfd->df", gt, s.x[where + j]) for j in range(width)]) + 1e-4 * m.filters[k]
            for j in range(width):
                each = (gt[:, :, None] * m.filters[k][j].T[None]).reshape(-1, DIM)
                for kind in range(KINDS):
                    rows.append(ids[where + j, kind].ravel() % buckets)
                    grads.append(each)
            m.filters[k] = m.filters[k] - stepped(f"w{k}", g_w)
            m.shift[k] = m.shift[k] - stepped(f"b{k}", gt.sum(0))
        m.out = m.out - stepped("out", g_out)
        m.bias -= float(stepped("bias", np.array([g_bias]))[0])
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        u, inv = np.unique(rows, return_inverse=True)
        total = np.zeros((len(u), DIM), np.float32)
        np.add.at(total, inv, grads)
        u, total = u[u != PAD], total[u != PAD]
        embed_sq[u] += (total * total).mean(1)
        step = 0.02 * total / np.sqrt(embed_sq[u])[:, None]
        m.embed[u] -= step
        m.embed[u + buckets] -= step


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, pa.RecordBatch, list[np.ndarray]]]:
    for batch in map(unpacked, slices(batches)):
        for c in chunks(batch.column(0), *language.CHUNK):
            yield c, batch, word_ids(c)


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(packed, size, y) -> (text, y)."""
    texts = [pa.decompress(x.as_buffer(), n, CODEC).to_pybytes() if n else b"" for x, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary()).view(pa.large_string()), batch.column(2)], ["text", "y"])


def _spots(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(f"spot {i}")), F.lit(1 << SPOT_BITS)) for i in range(2)]


def packed(texts: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, packed, size: texts (doc_id, text), compressed, without most of those whose doc_id isn't in known.

    Texts are shuffled to their labels, so few others should be: a Bloom filter of the ids in known is sent to the tasks. None
    that is in known is lost by it; of the others the join with known drops what is left. Where the ids are of different types none is dropped.
    """
    spot = F.explode(F.array(*_spots(F.col("doc_id")))).alias("spot")
    one = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    got = known.select(spot).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # at most 2^20 rows
    words = np.zeros(1 << (SPOT_BITS - 6), np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    if texts.schema["doc_id"].dataType != known.schema["doc_id"].dataType:
        words[:] = -1
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codec = sent.value, pa.Codec(CODEC)
        for batch in batches:
            spots = [batch.column(i).to_numpy() for i in (2, 3)]
            batch = batch.filter(pa.array(np.logical_and(*(words[s >> 6] >> (s & 63) & 1 == 1 for s in spots))))
            raw = [x.as_buffer() for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()), pa.array([x.size for x in raw], pa.int64())], ["doc_id", "packed", "size"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", *_spots(F.col("doc_id"))).mapInArrow(run, f"doc_id {kind}, packed binary, size long")


def _odds(learn: DataFrame, n: dict[int, int]) -> list[np.ndarray]:
    """Log-odds of all rows, bucket x kind: as a clean row sees them that doesn't count itself, a toxic one, and one that isn't among them. Each task sends what it counted once."""
    size = KINDS * (PAD + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int64)
        for c, batch, docs in _tokenised(batches):
            for d, y in zip(docs, batch.column(1).slice(c.first, c.n).to_pylist(), strict=True):
                seen[y, np.unique(d + np.arange(KINDS, dtype=np.int32) * (PAD + 1))] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], ["at", "pos", "neg"])

    got = learn.select("packed", "size", "y").mapInArrow(run, "at long, pos long, neg long").groupBy("at").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()  # at most a row for each bucket and kind
    at, pos, neg = (got[c].to_numpy() for c in ("at", "pos", "neg"))

    def spread(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        odds = np.zeros(size, np.float32)
        odds[at] = log_odds(pos, neg, n[1] / (n[0] + n[1]))
        return odds.reshape(KINDS, PAD + 1).T

    return [spread(pos, np.maximum(neg - 1, 0)), spread(np.maximum(pos - 1, 0), neg), spread(pos, neg)]


def _averaged(learn: DataFrame, m: ToxicityModel, more: Broadcast, n: dict[int, int], turn: int) -> ToxicityModel:
    """m after a round: the mean of what tasks make of it, by their rows; tasks have a BLOCK of them, or more.

    m has embeddings for clean rows; more is what odds for toxic ones have more. An embedding's change is the mean over the
    tasks that changed it.
    """
    total = n[0] + n[1]
    learn = learn.coalesce(max(1, total // BLOCK))
    times = max(1, min(MOST_TIMES, -(-VISITS // (ROUNDS * total))))
    by_class = np.array([total / 2 / n[0], total / 2 / n[1]])
    sent = learn.sparkSession.sparkContext.broadcast(m)

    columns = [f"w{k}" for k in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slow, rng, rows = with_weights(sent.value, weights(sent.value)), {}, np.random.default_rng(turn), 0
        own.embed, embed_sq = np.concatenate((sent.value.embed,) * 2), np.full(PAD + 1, 1e-3, np.float32)
        own.embed[PAD + 1 :, :KINDS] += more.value
        docs, ys = [], []

        def learnt() -> int:
            train(own, docs, np.array(ys), times, 0.01 * (1 - turn / ROUNDS), slow, rng, by_class, embed_sq)
            return len(docs)

        for c, batch, found in _tokenised(batches):
            docs, ys = docs + found, ys + batch.column(1).slice(c.first, c.n).to_pylist()
            if len(docs) >= BLOCK:
                rows, docs, ys = rows + learnt(), [], []
        if docs:
            rows += learnt()
        if rows:
            w = weights(own)
            every = np.zeros((-(-len(w) // DIM), DIM))
            every.ravel()[: len(w)] = w
            touched = np.flatnonzero(embed_sq > np.float32(1e-3))
            at = np.concatenate((-1 - np.arange(len(every)), touched))  # below zero what is no embedding
            values = np.concatenate((every, own.embed[touched] - sent.value.embed[touched])) * rows
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), rows)), *(pa.array(x.astype(np.float32)) for x in values.T)], ["at", "n", *columns])

    got = learn.select("packed", "size", "y").mapInArrow(run, ", ".join(["at long", "n long", *(f"{c} float" for c in columns)]))
    got = got.groupBy("at").agg(*((F.sum(c) / F.sum("n")).cast("float").alias(c) for c in columns)).toArrow()
    at = got["at"].to_numpy()
    order = np.argsort(at)
    at, values = at[order], np.column_stack([got[c].to_numpy() for c in columns])[order]
    w = weights(m)
    mean = with_weights(m, values[at < 0][::-1].ravel()[: len(w)].astype(np.float64))
    mean.embed = m.embed.copy()
    mean.embed[at[at >= 0]] += values[at >= 0]
    sent.destroy()
    return mean


def _histogram(rest: DataFrame, m: ToxicityModel, lid: language.LanguageModel) -> tuple[np.ndarray, ...]:
    """logit, y, lang, count of all rows, logits to within half a BIN."""
    sent = rest.sparkSession.sparkContext.broadcast((m, lid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lid = sent.value
        for c, batch, docs in _tokenised(batches):
            bins = np.rint(np.clip(m.logits(docs), -30, 30) / BIN).astype(np.int64)
            lang = lid.decode(language.ngram_counts(c))[0]
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1).slice(c.first, c.n), pa.array(lang)], ["bin", "y", "lang"])

    got = rest.select("packed", "size", "y").mapInArrow(run, "bin long, y int, lang long").groupBy("lang", "y", "bin").count().toArrow().sort_by([(c, "ascending") for c in ("lang", "y", "bin")])
    return got["bin"].to_numpy() * BIN, got["y"].to_numpy(), got["lang"].to_numpy(), got["count"].to_numpy().astype(np.float64)


def threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the least weight of errors; the middle of the widest, where several do as well."""
    by = np.argsort(logit, kind="stable")
    s, t, w = logit[by], y[by], weight[by]
    # Errors of a cut below row i: toxic rows before it, clean rows from it on.
    miss = np.concatenate(([0], np.cumsum(w * (t == 1)))) + np.concatenate((np.cumsum((w * (t == 0))[::-1])[::-1], [0]))
    low, high = np.concatenate(([s[0] - 2], s)), np.concatenate((s, [s[-1] + 2]))
    best = np.flatnonzero((miss <= miss.min() + 1e-9) & (high > low))
    k = best[np.argmax((high - low)[best])] if len(best) else int(np.argmin(miss))
    return float((low[k] + high[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, out: int = 0) -> tuple[ToxicityModel, language.LanguageModel]:
    """Models of all labelled rows whose fold isn't out; a row with a null label, text or id takes no part."""
    part = fold(F.col("doc_id"), parts)
    lid = language.fit(docs, part != out)
    known = labels.where(part != out).select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    texts = docs.where(part != out).select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    kept = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    rows = written(packed(texts, known).join(known, "doc_id").select("packed", "size", "y", kept.alias("kept")))
    count = {(r.kept, r.y): r["count"] for r in rows.groupBy("kept", "y").count().collect()}
    n = {t: count.get((False, t), 0) for t in (0, 1)}
    learn, rest = rows.where("not kept"), rows.where("kept")
    if not all(n.values()) or not all(count.get((True, t)) for t in (0, 1)):  # too few rows to keep some
        n = {t: n[t] + count.get((True, t), 0) for t in (0, 1)}
        learn = rest = rows
    if not all(n.values()):
        return ToxicityModel(np.zeros((PAD + 1, DIM), np.float32), [], [], np.zeros(0), 0.0, float(n[1] > 0)), lid
    clean, toxic, whole = _odds(learn, n)
    m = initial(whole)
    first, final = embedded(clean, whole), m.embed
    more = docs.sparkSession.sparkContext.broadcast((embedded(toxic, whole) - first)[:, :KINDS].astype(np.float16))
    m.embed = first
    del clean, toxic, whole
    for turn in range(ROUNDS):
        m = _averaged(learn, m, more, n, turn)
    m.embed = final + (m.embed - first)
    logit, y, lang, each = _histogram(rest, m, lid)
    m.thresholds[""] = threshold(logit, y, each)
    for k, name in enumerate(lid.langs):
        own = lang == k
        if len(set(y[own].tolist())) == 2:
            m.thresholds[name] = threshold(logit, y, each * np.where(own, 1.0, 0.25))
    return m, lid


def scored(docs: DataFrame, models: tuple[ToxicityModel, language.LanguageModel], into: str = "score", text: str = "text") -> DataFrame:
    """docs with a column more, the score of each text. Null and empty texts have the score of no words.

    A column of docs that is named as the new one is replaced.
    """
    docs = docs.drop(into)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lid = sent.value
        for batch in slices(batches):
            found = []
            for c in chunks(batch.column(at), *language.CHUNK):
                lang = lid.decode(language.ngram_counts(c))[0]
                found.append(m.score(word_ids(c), [lid.langs[k] for k in lang] if lid.langs else [""] * c.n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*batch.schema.names, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(0.0)).schema)


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def without_toxic(docs: DataFrame, labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """docs without those scored 0.5 or more by a model of corpus and labels; columns stay as they are."""
    score = free_name(docs.columns, "__toxicity")
    return scored(docs, fit(corpus, labels), score).where(F.col(score) < 0.5).drop(score)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents.

    Null and empty texts have the score of no words; a null text isn't learnt from, an empty one is. Repeated rows give a
    row each, and labels that contradict each other are both learnt from. Rows with a null id are in no fold. Columns
    beyond doc_id, text and lang, whatever their names, are ignored. If the labels have one class, or none, all scores are alike.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs.select("doc_id", "text"), models)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
