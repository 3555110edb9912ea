"""Hard negatives: rows of other labels whose inner product with an anchor is a little less than a positive's.

Vectors of whole numbers are ordered by label and along a Hilbert curve, and written as Parquet rows of one block
each: at most BLOCK vectors of one label, with a zone map, the least and the greatest value of each dimension. The
inner product of an anchor with any vector of a block lies between two sums that interval arithmetic gives: each of
the anchor's values times the end of the block's interval that makes the product least, or greatest. Only blocks whose
bounds meet the interval that an anchor still needs are read.

Positives: the block of the anchor's label with the highest bound is read first; the fifth score found is what a block
must be able to reach. Negatives: an interval from the lowest to the highest window of the anchor; again the block
with the highest bound is read first, which raises the lower ends of windows that are full. Results are exact, whatever
the order of the vectors; how many blocks are read depends on how well the curve keeps near vectors together.

Anchors meet zone maps in pages, and blocks in turns, so that no task holds more than a page of zones, a block and
CHUNK anchors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import written

BLOCK = 512  # vectors
PAGE = 1024  # zone maps that a task compares anchors with at once
CHUNK = 512  # anchors
SAMPLE = 20_000  # vectors whose quantiles make the cells of the curve
KEY_BITS = 128  # of a place on the curve, or a bit for each dimension, if these are more
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # hundredths of a positive's score
MOST = 1 << 56  # scores beyond it, on either side, count as it
EXACT = float(1 << 50)  # sums of magnitudes up to this are exact as doubles


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cells (bits each), as rows of bytes that sort like them.

    Skilling's transposition: from the highest bit down each axis either inverts the first one's lower bits or swaps them
    with its own; then Gray coding.
    """
    x = cells.astype(np.uint32).T.copy()
    if not len(x):
        return np.zeros((cells.shape[0], 0), np.uint8)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(len(x)):
            on = (x[i] & np.uint32(q)) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & np.uint32(q), np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


@dataclass
class Grid:
    """Cells of each dimension of vectors of one length."""

    edges: np.ndarray  # dimension x (2 ** bits - 1)
    bits: int

    @classmethod
    def fitted(cls, sample: np.ndarray) -> Grid:
        bits = min(16, max(1, KEY_BITS // max(1, sample.shape[1])))
        share = np.arange(1, 1 << min(bits, 8)) / (1 << min(bits, 8))
        return cls(np.quantile(sample, share, axis=0).T if sample.size else np.zeros((sample.shape[1], len(share))), min(bits, 8))

    def keys(self, x: np.ndarray) -> np.ndarray:
        cells = np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0))
        return hilbert(cells, self.bits)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), dim)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers kept in doubles: exact, and held within MOST."""
    if q.size and x.size and np.abs(q).sum(1).max() * np.abs(x).max() >= EXACT:
        whole = np.frompyfunc(int, 1, 1)
        return np.clip(whole(q) @ whole(x).T, -MOST, MOST).astype(np.int64)
    return (q @ x.T).astype(np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what the inner product of each q and any vector between low and high lies; infinite where sums may not be exact."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    least, most = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    far = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T >= EXACT
    return np.where(far, -np.inf, least), np.where(far, np.inf, most)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))


FOUND = "array<struct<minus:long,id:long>>"
ANCHOR = "row long, dim int, label long, x array<double>, low double, high double, windows array<long>"
_NAMES = [f.split()[0] for f in ANCHOR.split(", ")]


def _lists(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """(scores, ids) as FOUND; best first when sorted upwards."""
    n = np.cumsum([0, *(len(s) for s, _ in rows)]).astype(np.int32)
    s, i = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in range(2))
    return pa.ListArray.from_arrays(pa.array(n), pa.StructArray.from_arrays([pa.array(-s.astype(np.int64)), pa.array(i.astype(np.int64))], ["minus", "id"]))


def whole_vectors(rows: DataFrame, vec: str, id_col: str, label: Column) -> DataFrame:
    """row, id, label, dim, x of the rows that take part: components times 256, rounded down. row tells repeated rows apart."""
    v = F.col(vec)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.coalesce(fine, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.size(v).alias("dim"), v.cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(4)
            flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64)
            big = np.finfo(np.float64).max
            down = np.floor(np.clip(flat, -big / 256, big / 256) * 256)
            ends = np.concatenate(([0], np.cumsum(b.column(3).to_numpy()))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(down))], b.schema.names)

    return written(kept.mapInArrow(run, kept.schema))


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """rows (as of whole_vectors) as a written table of blocks: block, dim, label, low and high (the zone map), rows, ids, x (end to end)."""
    spark = rows.sparkSession
    n = rows.groupBy("dim").count().collect()  # a row for each length of vectors
    grids = {}
    for r in n:
        share = min(1.0, min(SAMPLE, 4_000_000 // max(1, r.dim)) / r["count"])
        drawn = F.pmod(F.xxhash64("row", F.lit("grid")), F.lit(1 << 30)) < int(share * (1 << 30))
        grids[r.dim] = Grid.fitted(_matrix(rows.where((F.col("dim") == r.dim) & drawn).select("x").toArrow().column("x"), r.dim))
    sent = spark.sparkContext.broadcast(grids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, out = b.column(3).to_numpy(), np.zeros(b.num_rows, object)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                out[own] = [k.tobytes() for k in sent.value[d].keys(_matrix(b.column(4).take(pa.array(own)), d))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "key"])

    order = ["dim", "label", "key", "id", "row"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sum(r["count"] for r in n) / (32 * size)))
    sorted_rows = rows.mapInArrow(placed, "row long, id long, label long, dim int, x array<double>, key binary").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        d = t.column("dim")[0].as_py()
        x = _matrix(t.column("x"), d)
        one = lambda v, kind: pa.array([v], kind)
        doubles, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
        values = [pa.array([d], pa.int32()), pa.array([t.column("label")[0].as_py()], pa.int64()), one(x.min(0), doubles), one(x.max(0), doubles), one(t.column("row").to_numpy(), longs), one(t.column("id").to_numpy(), longs), one(x.ravel(), doubles)]
        return pa.RecordBatch.from_arrays(values, ["dim", "label", "low", "high", "rows", "ids", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, have = [], None, 0
        for b in batches:
            kinds = np.column_stack((b.column(3).to_numpy(), b.column(2).to_numpy()))
            starts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(1)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if tuple(kinds[lo]) != now and held:
                    yield block(held)
                    held, have = [], 0
                now = tuple(kinds[lo])
                while lo < hi:
                    part = b.slice(lo, min(hi - lo, size - have))
                    held.append(part)
                    have, lo = have + part.num_rows, lo + part.num_rows
                    if have == size:
                        yield block(held)
                        held, have = [], 0
        if held:
            yield block(held)

    made = sorted_rows.mapInArrow(cut, "dim int, label long, low array<double>, high array<double>, rows array<long>, ids array<long>, x array<double>")
    return written(written(made).select(F.monotonically_increasing_id().alias("block"), "*"))


def _bounded(anchors: DataFrame, zones: DataFrame, own: bool, best: bool) -> DataFrame:
    """row, block, most: the blocks (of the anchor's label or of all others) whose bounds meet low .. high of the anchor; best: of each page only the one with the highest bound."""
    chunks, pages = (max(1, math.ceil(t.count() / n)) for t, n in ((anchors, CHUNK), (zones, PAGE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), every(pages).alias("page"))
    asked = zones.select(F.col("block").alias("z_block"), F.col("dim").alias("z_dim"), F.col("label").alias("z_label"), F.col("low").alias("z_low"), F.col("high").alias("z_high"), F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int").alias("z_page"), every(chunks).alias("z_chunk"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        if left.num_rows and right.num_rows:
            rows, dims, labels, low, high = (left.column(c).to_numpy() for c in ("row", "dim", "label", "low", "high"))
            ids, z_dims, z_labels = (right.column(c).to_numpy() for c in ("z_block", "z_dim", "z_label"))
            for d in np.intersect1d(dims, z_dims).tolist():
                a, z = np.flatnonzero(dims == d), np.flatnonzero(z_dims == d)
                least, most = bounds(_matrix(left.column("x").take(pa.array(a)), d), *(_matrix(right.column(c).take(pa.array(z)), d) for c in ("z_low", "z_high")))
                meets = (most >= low[a, None]) & (least <= high[a, None]) & ((labels[a, None] == z_labels[z]) == own)
                if best:
                    top = np.argmax(np.where(meets, most, -np.inf), axis=1)
                    i = np.flatnonzero(meets.any(1))
                    # Where all that meets has the bound -inf, the first of them will do.
                    top[i] = np.where(meets[i, top[i]], top[i], np.argmax(meets[i], axis=1))
                    j = top[i]
                else:
                    i, j = np.nonzero(meets)
                out.append([rows[a[i]], ids[z[j]], most[i, j]])
        row, block, most = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"row": row, "block": block, "most": most})

    return asking.groupBy("page", "chunk").cogroup(asked.groupBy("z_page", "z_chunk")).applyInArrow(compare, "row long, block long, most double")


def seeds(anchors: DataFrame, zones: DataFrame, own: bool) -> DataFrame:
    """row, block: of each anchor the block with the highest bound."""
    found = _bounded(anchors, zones, own, True)
    return found.groupBy("row").agg(F.max_by("block", F.struct("most", "block")).alias("block"))


def read(anchors: DataFrame, chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """row, window, found of each anchor and its chosen (row, block) blocks.

    An anchor without windows looks for its positives, the highest scores of other rows; else, for each score in windows, for
    the highest scores from LOW to HIGH hundredths of it.
    """
    turns = max(1, math.ceil(anchors.count() / CHUNK))
    asking = anchors.join(chosen, "row").withColumn("turn", F.pmod(F.xxhash64("row"), F.lit(turns)).cast("int"))
    asking = written(asking)
    turn = asking.select(F.col("block").alias("at"), F.col("turn").alias("in_turn")).distinct()
    held = blocks.select(F.col("block").alias("at"), "rows", "ids", F.col("x").alias("held")).join(turn, "at")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        row, window, found = [], [], []
        if left.num_rows and right.num_rows:
            own, ids = (right.column(c)[0].values.to_numpy() for c in ("rows", "ids"))
            d = left.column("dim")[0].as_py()
            score = scores(_matrix(left.column("x"), d), np.asarray(right.column("held")[0].values.to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), d))
            for r, w, s in zip(left.column("row").to_pylist(), left.column("windows").to_pylist(), score, strict=True):
                for p in w if w is not None else (None,):
                    at = np.flatnonzero(own != r if p is None else (LOW * p <= 100 * s) & (100 * s <= HIGH * p))
                    if len(at):
                        at = at[_first(s[at], ids[at], POSITIVES if p is None else NEGATIVES)]
                        row.append(r)
                        window.append(p)
                        found.append((s[at], ids[at]))
        return pa.table({"row": pa.array(row, pa.int64()), "window": pa.array(window, pa.int64()), "found": _lists(found)})

    return asking.groupBy("block", "turn").cogroup(held.groupBy("at", "in_turn")).applyInArrow(look, f"row long, window long, found {FOUND}")


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("row", "window").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def mined(rows: DataFrame, is_anchor: Column, vec: str = "embedding", id_col: str = "vec_id", label: Column | None = None, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor may use the columns id and label.

    Rows with a null label, id, vector or component, or a component that isn't finite, take no part. Vectors of different
    lengths have no inner product. Rows that repeat an id are rows of their own.
    """
    vectors = whole_vectors(rows, vec, id_col, label if label is not None else F.col("label"))
    blocks = blocks_of(vectors, block)
    zones = blocks.select("block", "dim", "label", "low", "high")
    endless = (F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(None).cast("array<long>").alias("windows"))
    anchors = vectors.where(is_anchor).select("row", "dim", "label", "x", *endless)
    ids = vectors.where(is_anchor).select("row", F.col("id").alias("anchor_id"))

    seed = written(seeds(anchors, zones, True))
    near = written(_merged(read(anchors, seed, blocks), POSITIVES))
    fifth = near.where(F.size("found") >= POSITIVES).select("row", (-F.col("found")[POSITIVES - 1]["minus"]).cast("double").alias("fifth"))
    reach = anchors.drop("low").join(fifth, "row", "left").withColumn("low", F.coalesce("fifth", F.lit(float("-inf")))).select(_NAMES)
    more = _bounded(reach, zones, True, False).select("row", "block").join(seed, ["row", "block"], "left_anti")
    positives = written(_merged(near.unionByName(read(reach, more, blocks)), POSITIVES).select("row", F.posexplode("found").alias("place", "p")).select("row", "place", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score")))

    # Windows of negative scores are empty.
    windows = positives.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    floor = F.floor(F.array_min("windows") * F.lit(LOW / 100.0)) - 1  # a step below what rounding of doubles may make of it
    ceiling = F.array_max("windows") * F.lit(HIGH / 100.0) + 1
    asking = written(anchors.drop("low", "high", "windows").join(windows, "row").select("row", "dim", "label", "x", floor.cast("double").alias("low"), ceiling.alias("high"), "windows"))
    seed = written(seeds(asking, zones, False))
    near = written(_merged(read(asking, seed, blocks), NEGATIVES))
    # A window that is full needs no score below its last one; the others need all that is in them.
    full = near.where(F.size("found") >= NEGATIVES).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", (-F.col("found")[NEGATIVES - 1]["minus"]).cast("double").alias("last")))).alias("last"))
    needs = F.transform("windows", lambda w: F.coalesce(F.try_element_at(F.col("last"), w), F.floor(w * F.lit(LOW / 100.0)).cast("double") - 1))
    reach = asking.join(full, "row", "left").withColumn("low", F.array_min(needs)).select(_NAMES)
    more = _bounded(reach, zones, False, False).select("row", "block").join(seed, ["row", "block"], "left_anti")
    negatives = _merged(near.unionByName(read(reach, more, blocks)), NEGATIVES).select("row", F.col("window").alias("positive_score"), F.posexplode("found").alias("at", "n"))
    out = positives.join(negatives, ["row", "positive_score"]).join(ids, "row")
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.minus")).alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100.

    Rows with a null id, label, vector or component, or with a component that isn't finite, take no part; nor do pairs of
    vectors of different lengths. Repeated rows are rows of their own: an anchor that is repeated asks, and is found, as often; equal scores go
    to the smaller id. Vectors of any length, also of none, are read whole. Scores beyond 2 ** 56 count as that. Columns beyond vec_id,
    embedding and label, whatever their names, are ignored; an empty table gives no rows.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows, F.col("id") % 100 == 0, label=label)


_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.id) AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op12_negatives": op12_negatives}
ORACLES = {"op12_negatives": _SQL}
