"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a binary classifier over hashed byte n-grams (1 to 3, A-Z
lower-cased) predicts each bit. Decoding weighs each bit's exponential loss by how well its classifier
does, and chooses the nearest codeword; a lead over the next one below AMBIGUOUS is flagged.

The classifiers are fitted on all texts. Those of a language are dealt by a hash of the id into GROUPS_PER_LANG groups, fewer where
there are many languages (MAX_GROUPS in all, or two of each language, if that is more); the mean of the n-grams of a group's
texts, summed by the tasks that read them, is a row of the regressions. Every language that occurs is learnt. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import fold
from tracemill.llm._text import LOWER, Chunk, chunks, slices

BUCKETS = 4096
GROUPS_PER_LANG = 64
MAX_GROUPS = 4000
BITS = 63  # of random codes, for more than six languages
STEPS = 200
AMBIGUOUS = 0.2
CHUNK = 1 << 20, 400  # bytes and rows whose counts are held at once
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def ngram_counts(c: Chunk) -> np.ndarray:
    """Per document, unit vectors of square roots of hashed n-gram counts."""
    low = LOWER[c.data].astype(np.uint32)
    size = len(low)
    doc = np.repeat(np.arange(c.n, dtype=np.int64), np.diff(c.offs)) * BUCKETS
    code = np.zeros(size, np.uint32)
    total = np.zeros((c.n + 1) * BUCKETS, np.int64)
    for n in range(3):
        if size <= n:
            break
        code = code[: size - n] * np.uint32(257) + low[n:] + np.uint32(1 + n)
        at = doc[: size - n] + ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        if n:  # grams that would run into the next document go to a row of their own
            at[doc[: size - n] != doc[n:]] = c.n * BUCKETS
        total += np.bincount(at, minlength=len(total))
    x = np.sqrt(total[: c.n * BUCKETS].reshape(c.n, BUCKETS).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits for few languages, else random ones far from each other."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 6:
        bits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(bits, np.float32).T
    rng = np.random.default_rng(7)
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, BITS))
        far = (BITS - code @ code.T) / 2 + BITS * np.eye(n)
        if far.min() > gap and (np.abs(code.sum(0)) < n).all():
            best, gap = code, far.min()
    return best if best is not None else code


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # language x bit
    weight: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # of each bit; sums to 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of x: the language's number, its probability, its lead over the next."""
        n = len(x)
        if len(self.langs) < 2:
            return np.zeros(n, np.int64), np.ones(n), np.ones(n)
        margin = np.clip(x @ self.weight + self.bias, -6, 6)
        loss = np.exp(-margin) @ (self.trust[:, None] * (self.code.T > 0)) + np.exp(margin) @ (self.trust[:, None] * (self.code.T < 0))
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)).astype(np.float64))
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)
        return np.argmin(loss, axis=1), top[:, -1], top[:, -1] - top[:, -2]


def train(x: np.ndarray, y: np.ndarray, langs: list[str]) -> LanguageModel:
    """Logistic regressions of all bits at once by accelerated gradient steps."""
    m = LanguageModel(langs, codewords(len(langs)))
    if len(langs) < 2:
        return m
    target = m.code[y]
    size = np.bincount(y, minlength=len(langs))
    each = (1 / np.maximum(size[y], 1) / len(langs)).astype(np.float32)[:, None]  # languages count alike
    bits = m.code.shape[1]
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    v, vb = w.copy(), b.copy()
    for _ in range(STEPS):
        pull = each * target / (1 + np.exp(np.clip(target * (x @ (w + 0.9 * v) + b + 0.9 * vb), -30, 30)))
        v = 0.9 * v + 40 * (x.T @ pull - 1e-5 * w)
        vb = 0.9 * vb + 4 * pull.sum(0)
        w, b = w + v, b + vb
    right = (each * (target * (x @ w + b) > 0)).sum(0)
    wrong = np.clip(1 - right, 1e-3, 0.499)
    trust = np.log((1 - wrong) / wrong)
    return LanguageModel(langs, m.code, w, b, (trust / trust.sum()).astype(np.float32))


def fit(docs: DataFrame, train_rows: Column, lang: str = "lang", text: str = "text", per_lang: int = GROUPS_PER_LANG) -> LanguageModel:
    """A model of all of docs' rows for which train_rows holds and whose text and lang aren't null."""
    rows = docs.where(train_rows).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col("doc_id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    langs = sorted(r.l for r in rows.select("l").distinct().collect())
    groups = max(2, min(per_lang, MAX_GROUPS // max(len(langs), 1)))
    number = {l: k * groups for k, l in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a task's part of each group
        for batch in slices(batches):
            of = np.array([number[l] for l in batch.column(1).to_pylist()], np.int64) + batch.column(2).to_numpy()
            for c in chunks(batch.column(0), *CHUNK):
                x, own = ngram_counts(c), of[c.first : c.first + c.n]
                by = np.argsort(own, kind="stable")
                at, first = np.unique(own[by], return_index=True)
                for k, v in zip(at.tolist(), np.add.reduceat(x[by], first), strict=True):
                    sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["k", "x"])

    def added(b: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in b["x"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"k": b["k"][:1], "x": [(total / max(np.linalg.norm(total), 1e-9)).astype(np.float16).tobytes()]})

    group = F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups)).cast("long")
    got = rows.select("t", "l", group.alias("g")).mapInArrow(run, "k long, x binary").groupBy("k").applyInPandas(added, "k long, x binary").toPandas().sort_values("k")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return train(x, got["k"].to_numpy(np.int64) // groups, langs)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score and ambiguous of every row.

    Texts that are null or have no letter are und, with score 0 and the flag. So are all texts if the model knows no language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            langs, scores, flags = [], [], []
            for c in chunks(batch.column(n), *CHUNK):
                k, p, lead = m.decode(ngram_counts(c))
                known = [bool(m.langs) and bool(_LETTER.search(c.text(i).decode())) for i in range(c.n)]
                langs += [m.langs[j] if ok else UNDETERMINED for j, ok in zip(k, known, strict=True)]
                scores += np.where(known, p, 0.0).tolist()
                flags += (~np.array(known) | (lead < AMBIGUOUS)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], [*keep, "lang_pred", "score", "ambiguous"])

    schema = rows.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema
    return rows.mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of all documents.

    Texts that are null, empty or without a letter are und, with score 0. Repeated rows give a row each; those with a
    null id are in no fold and neither learnt from nor held out. Ties go to the language that sorts first. Columns beyond
    doc_id, text and lang, whatever their names, are ignored. Without a labelled row all texts are und.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = fold(F.col("doc_id"), 5)
    model = fit(docs, part != 0)
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
