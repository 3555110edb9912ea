"""Document quality by kernel ridge regression on random Fourier features, with isotonic calibration.

Statistics of the whole text (shares of kinds of characters, lengths of words and lines, repeats) are
standardised; cosines of random projections of them approximate a Gaussian kernel. Each task sums its rows
of the normal equations, which are added up over all labelled rows and solved once; scores are calibrated
by pooling adjacent violators over a histogram of them. All labelled rows take part, whose number isn't
bounded; what comes to the driver is of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import fold, written
from tracemill.llm._text import ALNUM, Chunk, chunks, words

FOURIER = 192  # random features
WIDTH = 3.0  # of the kernel, in standard deviations
RIDGE = 1e-3  # per row
BINS = 400  # of scores, for the calibration
SUMS = 64  # tasks between which the sums of all tasks are first split
CUT = 0.7

_CLASSES = {
    "upper": np.arange(65, 91),
    "lower": np.arange(97, 123),
    "digit": np.arange(48, 58),
    "space": np.array([32, 9, 13]),
    "newline": np.array([10]),
    "stop": np.array([46, 44, 59, 58, 63]),
    "exclaim": np.array([33]),
    "bar": np.array([124]),
    "quote": np.array([34, 39, 40, 41, 45]),
    "symbol": np.array([35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]),
    "high": np.arange(128, 256),
}
NAMES = (*_CLASSES, "log_words", "word_length", "long_words", "distinct_words", "repeated_pairs", "same_as_before", "line_words", "distinct_lines", "log_lines", "stop_gap")
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS_OF[_v] = _k


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Per document the number of distinct values."""
    by = np.lexsort((value, doc))
    d, v = doc[by], value[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=n)


_LINE = np.ones(256, bool)
_LINE[10] = False


def statistics(c: Chunk) -> np.ndarray:
    """Document x NAMES; texts without words or lines have zeros in place of ratios."""
    n, size = c.n, np.diff(c.offs)
    doc = np.repeat(np.arange(n), size)
    kinds = len(_CLASSES)
    count = np.bincount(doc * (kinds + 1) + _CLASS_OF[c.data], minlength=n * (kinds + 1)).reshape(n, -1)[:, :kinds]
    share = count / np.maximum(size, 1)[:, None]
    w = words(c, ALNUM)
    nw = np.bincount(w.doc, minlength=n)
    some = np.maximum(nw, 1)
    length = w.end - w.start
    mean = np.bincount(w.doc, length, minlength=n) / some
    long = np.bincount(w.doc, length > 12, minlength=n) / some
    same_doc = w.doc[1:] == w.doc[:-1]
    pair_doc, pair = w.doc[1:][same_doc], (w.hash[1:] * np.uint64(3) + w.hash[:-1])[same_doc]
    pairs = np.bincount(pair_doc, minlength=n)
    again = np.bincount(w.doc[1:][same_doc], (w.hash[1:] == w.hash[:-1])[same_doc], minlength=n)
    line = words(c, _LINE)
    lines = np.bincount(line.doc, minlength=n)
    stops = np.bincount(c.doc_of(np.flatnonzero(c.data == 46)), minlength=n)
    return np.column_stack(
        [
            share,
            np.log1p(nw),
            mean,
            long,
            _distinct(w.doc, w.hash, n) / some,
            1 - _distinct(pair_doc, pair, n) / np.maximum(pairs, 1),
            again / some,
            np.log1p(nw / np.maximum(lines, 1)),
            _distinct(line.doc, line.hash, n) / np.maximum(lines, 1),
            np.log1p(lines),
            np.log1p(nw / (stops + 1)),
        ]
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and stats of every row; a null text is empty."""
    rows = docs.select("doc_id", F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(c) for c in chunks(batch.column(1))]
            x = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    return rows.mapInArrow(run, rows.select("doc_id", F.array(F.lit(0.0)).alias("stats")).schema)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray  # statistic x feature
    phase: np.ndarray
    weight: np.ndarray
    edges: np.ndarray  # calibration: raw scores and what they stand for
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack((np.cos(z @ self.turn + self.phase) * np.sqrt(2 / FOURIER), z / 10, np.ones(len(z))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values)


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending x with total and good rows each -> x, non-decreasing shares (smoothed towards the whole)."""
    blocks: list[list[float]] = []
    for a, n, g in zip(x, total, good, strict=True):
        blocks.append([n, g, a, a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, g2, _, hi = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += g2
            blocks[-1][3] = hi
    base = good.sum() / max(total.sum(), 1)
    edges, values = [], []
    for n, g, lo, hi in blocks:
        v = (g + base) / (n + 1)
        edges += [lo, hi] if hi > lo else [lo]
        values += [v, v] if hi > lo else [v]
    return np.array(edges), np.maximum.accumulate(values)


def _summed(rows: DataFrame, f, width: int) -> np.ndarray:
    """The sum over all rows of what f makes of a batch of them, an array of width numbers: per task, then per group of tasks, then on the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for b in batches:
            if len(b):
                total += f(b)
        part = TaskContext.get().partitionId() % SUMS  # the same if the task is run again
        yield pd.DataFrame({"part": [part], "x": [total.tobytes()]})

    def added(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x": [np.sum([np.frombuffer(x) for x in b["x"]], axis=0).tobytes()]})

    got = rows.mapInPandas(partial, "part int, x binary").groupBy("part").applyInPandas(added, "x binary").collect()
    return np.sum([np.frombuffer(r.x) for r in got], axis=0) if got else np.zeros(width)


def _matrix(b: pd.DataFrame) -> np.ndarray:
    return np.array(b["stats"].tolist(), np.float64).reshape(-1, len(NAMES))


def fit(labelled: DataFrame) -> QualityModel:
    """labelled: stats and y (0 or 1) of each row. Without rows every score is 0."""
    k, m = len(NAMES), FOURIER + len(NAMES) + 1
    moments = _summed(labelled, lambda b: np.concatenate(([len(b)], (x := _matrix(b)).sum(0), (x * x).sum(0))), 1 + 2 * k)
    n = moments[0]
    rng = np.random.default_rng(5)
    mean = moments[1 : k + 1] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[k + 1 :] / max(n, 1) - mean**2, 1e-8))
    model = QualityModel(mean, scale, rng.normal(0, 1 / WIDTH, (k, FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER), np.zeros(m), np.array([0.0]), np.array([0.0]))
    if not n:
        return model

    def normal(b: pd.DataFrame) -> np.ndarray:
        z = model.features(_matrix(b))
        return np.concatenate(((z.T @ z).ravel(), z.T @ b["y"].to_numpy(np.float64)))

    sums = _summed(labelled, normal, m * m + m)
    model.weight = np.linalg.solve(sums[: m * m].reshape(m, m) + RIDGE * n * np.eye(m) / m, sums[m * m :])

    def histogram(b: pd.DataFrame) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(b)) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, b["y"].to_numpy(np.float64), minlength=BINS)))

    got = _summed(labelled, histogram, 2 * BINS)
    total, good = got[:BINS], got[BINS:]
    has = total > 0
    centre = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    model.edges, model.values = isotonic(centre[has], total[has], good[has])
    return model


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents.

    Null and empty texts have the statistics of no characters. Repeated rows give a row each; labels that contradict each
    other, and those of repeated rows, all count. Rows with a null id are in no fold. Columns beyond doc_id and text,
    whatever their names, are ignored. Without labels all scores are 0; an empty table gives no rows.
    """
    stats = written(with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    part = fold(F.col("doc_id"), 4)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(part != 2).select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    return scored(stats, fit(written(stats.join(labels, "doc_id").select("stats", "y")))).select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of rows with stats."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(sent.value.score(x), 0, 1))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, stats.select("doc_id", F.lit(0.0).alias("score")).schema)


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
