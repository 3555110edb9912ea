"""Approximate nearest neighbours by inner product, in a hierarchical k-means tree.

The tree is fitted on a bounded sample of the vectors; every vector is then sent down it to a leaf. A query
goes through the tree best bin first: a priority queue holds the nodes seen, the one whose centre has the
largest inner product with the query is opened next, and leaves are visited in the order in which they come
out. How many are visited is calibrated: for a bounded sample of queries the true neighbours are found by
brute force over all vectors, and visits are widened until the mean recall reaches TARGET.

Leaves are searched in blocks of at most LEAF_BLOCK vectors and QUERY_BLOCK queries, so a leaf may hold any
share of the vectors, and any number of queries may visit it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import written

NEAREST = 20
SAMPLE = 60_000  # vectors that the tree is fitted on, at most
SAMPLE_FLOATS = 4_000_000  # and their components
BRANCHES = 16
LEAF_ROWS = 400  # vectors of a leaf, about
LEAST_SAMPLE = 32  # of a node that is split
ROUNDS = 8  # of k-means
CALIBRATION = 200  # queries
TARGET = 0.95
LEAF_BLOCK = 8192
QUERY_BLOCK = 2048
MERGE_WAYS = 64  # groups in which the finds of many tasks are merged first
FOUND = "array<struct<minus:double,vec_id:long,leaf:int>>"


@dataclass
class Tree:
    centre: np.ndarray  # of each node; node 0 is the root
    children: list[list[int]]
    leaf: list[int] = field(default_factory=list)  # number of each node's leaf, or -1
    n_leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by the nearest centre."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centre[kids]
            best = kids[np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)]
            stack += [(int(k), rows[best == k]) for k in kids if (best == k).any()]
        return out

    def order(self, q: np.ndarray, visits: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that come out of the queue for one query: as many as visits, or until they hold (as of held) least vectors, if that is more."""
        near = self.centre @ q
        heap, out, seen = [(0.0, 0)], [], 0
        while heap and (len(out) < visits or seen < least):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                seen += int(held[self.leaf[node]]) if held is not None else 0
            for k in self.children[node]:
                heapq.heappush(heap, (-float(near[k]), k))
        return out


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster of each row, by k-means."""
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmin((centre * centre).sum(1) - 2 * x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return np.argmin((centre * centre).sum(1) - 2 * x @ centre.T, axis=1)


def grow(x: np.ndarray, rows: int) -> Tree:
    """A tree of the sample x of so many rows."""
    rng = np.random.default_rng(3)
    per = rows / max(len(x), 1)
    centre, children, leaf, todo = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [-1], [(0, np.arange(len(x)))]
    n = 0
    while todo:
        node, own = todo.pop()
        k = min(BRANCHES, int(np.ceil(len(own) * per / LEAF_ROWS)), len(own) // (LEAST_SAMPLE // 2))
        part = _split(x[own], k, rng) if k >= 2 and len(own) >= LEAST_SAMPLE else np.zeros(len(own), int)
        if len(set(part.tolist())) < 2:
            leaf[node], n = n, n + 1
            continue
        for p in sorted(set(part.tolist())):
            kid = own[part == p]
            children[node].append(len(centre))
            todo.append((len(centre), kid))
            centre.append(x[kid].mean(0))
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centre), children, leaf, n)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _best(score: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one query the k best rows, ties to the smaller id, and their scores.

    score is from a matrix product, whose last bits depend on the place in the matrix; rows that may be
    among the best are summed again, one like another, so that equal vectors tie.
    """
    ok = np.flatnonzero(score > -np.inf)
    if len(ok) > k:
        cut = np.partition(score[ok], len(ok) - k)[len(ok) - k]
        ok = ok[score[ok] >= cut - 1e-9 * max(1.0, abs(cut))]
    exact = (x[ok] * q).sum(1)
    by = np.lexsort((ids[ok], -exact))[:k]
    return ok[by], exact[by]


def _lists(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """(scores, ids, leaves) lists as FOUND; best first when sorted upwards."""
    n = np.array([len(r[0]) for r in rows])
    flat = [np.concatenate([r[j] for r in rows]) if len(rows) else np.zeros(0) for j in range(3)]
    s = pa.StructArray.from_arrays([pa.array(-flat[0].astype(np.float64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.int32))], ["minus", "vec_id", "leaf"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), s)


def merged(found: DataFrame, k: int = NEAREST, *apart: Column) -> DataFrame:
    """query (a row's number), found lists of parts of the vectors -> one list of the k best for each query (and value of apart)."""
    return found.groupBy("query", *apart).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds, over all other rows.

    Vectors that are null or zero, or hold a null or a component that isn't finite, take no part, nor do rows
    without an id. If lengths differ, only vectors of the commonest length do (the shortest of those, in a tie).
    Rows that repeat an id are rows of their own: each asks, and may be found by the others.
    """
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("x") == dim)
    share = min(1.0, min(SAMPLE, SAMPLE_FLOATS // dim) / n)
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = _vectors(rows.where(drawn).select("x").toArrow().column("x").combine_chunks(), dim)
    tree = grow(sample[np.lexsort(sample.T)] if len(sample) else sample, n)
    sent = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.assign(_vectors(b.column(1), dim)))], ["vec_id", "x", "asks", "row", "leaf"])

    placed = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(to_leaf, "vec_id long, x array<double>, asks boolean, row long, leaf int"))
    queries = written(placed.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "x"))
    visits = _calibrated(placed, queries, tree, dim, k)
    holders = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf of the bounded tree
    sizes_of = np.array([holders.get(leaf, 0) for leaf in range(tree.n_leaves)])

    def to_visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = [sent.value.order(q, visits, sizes_of, k + 1) for q in _vectors(b.column(1), dim)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int32()))], ["query", "x", "leaves"])

    pairs = written(queries.select("query", "x").mapInArrow(to_visit, "query long, x array<double>, leaves array<int>"))
    askers = {r.leaf: r["count"] for r in pairs.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    blocks = [(leaf, -(-held // LEAF_BLOCK), -(-askers[leaf] // QUERY_BLOCK)) for leaf, held in holders.items() if leaf in askers]
    size = spark.createDataFrame(blocks, "leaf int, parts int, turns int")
    held = placed.select("vec_id", "x", "leaf", "row").join(F.broadcast(size), "leaf")
    held = held.select("vec_id", "x", "leaf", "row", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    asked = pairs.select("query", "x", F.explode("leaves").alias("leaf")).join(F.broadcast(size), "leaf")
    asked = asked.select("query", "x", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query"), F.col("turns")).cast("int").alias("turn"))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query": pa.array([], pa.int64()), "found": _lists([])})
        ids, own, x = right.column("vec_id").to_numpy(), right.column("row").to_numpy(), _vectors(right.column("x").combine_chunks(), dim)
        asking, q = left.column("query").to_numpy(), _vectors(left.column("x").combine_chunks(), dim)
        leaf = np.full(k, right.column("leaf")[0].as_py())
        out = []
        for i in range(0, len(q), 256):
            score = q[i : i + 256] @ x.T
            score[asking[i : i + 256, None] == own[None]] = -np.inf
            for j, s in enumerate(score):
                at, exact = _best(s, q[i + j], x, ids, k)
                out.append((exact, ids[at], leaf[: len(at)]))
        return pa.table({"query": asking, "found": _lists(out)})

    keys = ("leaf", "part", "turn")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(look, f"query long, found {FOUND}")
    best = merged(found, k).join(queries.select("query", "query_id"), "query").select("query_id", F.posexplode("found").alias("at", "f"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.minus")).alias("score"))


def brute_force(placed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """query, found: the k nearest of a bounded set of queries, rows of the numbers ids, among all rows (vec_id, x, leaf, row). A task sends on k a query."""
    sent, dim = placed.sparkSession.sparkContext.broadcast((ids, q)), q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, q = sent.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(q)
        for b in batches:
            for i in range(0, b.num_rows, LEAF_BLOCK):
                part = b.slice(i, LEAF_BLOCK)
                own, x, leaf = part.column(0).to_numpy(), _vectors(part.column(1), dim), part.column(2).to_numpy()
                score = q @ x.T
                score[asking[:, None] == part.column(3).to_numpy()[None]] = -np.inf
                for j, s in enumerate(score):
                    at, exact = _best(s, q[j], x, own, k)
                    both = [np.concatenate(p) for p in zip(best[j], (exact, own[at], leaf[at]), strict=True)]
                    top = np.lexsort((both[1], -both[0]))[:k]
                    best[j] = tuple(p[top] for p in both)
        yield pa.RecordBatch.from_arrays([pa.array(asking), _lists(best)], ["query", "found"])

    found = placed.select("vec_id", "x", "leaf", "row").mapInArrow(run, f"query long, found {FOUND}")
    return merged(merged(found, k, (F.spark_partition_id() % MERGE_WAYS).alias("way")), k)


def _calibrated(placed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int) -> int:
    """The number of leaves to visit, so that the mean recall of a sample of queries reaches TARGET."""
    n = queries.count()
    if not n or tree.n_leaves < 2:
        return tree.n_leaves
    drawn = F.pmod(F.xxhash64("query", F.lit("calibrate")), F.lit(1 << 30)) < int(min(1.0, CALIBRATION / n) * (1 << 30))
    chosen = queries.where(drawn).collect()
    if not chosen:
        return tree.n_leaves
    ids, q = np.array([r.query for r in chosen]), np.array([r.x for r in chosen], np.float64).reshape(-1, dim)
    true = {r.query: [f.leaf for f in r.found] for r in brute_force(placed, ids, q, k).collect()}
    depth = [[order.index(leaf) for leaf in true[i]] for i, order in zip(ids.tolist(), (tree.order(v, tree.n_leaves) for v in q), strict=True) if true.get(i)]
    for visits in range(1, tree.n_leaves):
        if np.mean([np.mean(np.array(d) < visits) for d in depth]) >= TARGET:
            return visits
    return tree.n_leaves


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20; all others, where there are fewer.

    Vectors that are null or zero, or hold a null or a component that isn't finite, and rows without id take no part;
    nor do vectors of another length than the commonest, with which there is no inner product. Rows that repeat an id
    ask, and are found, each for itself. Ties go to the smaller id. Columns beyond vec_id and embedding are ignored.
    """
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op4_neighbours": op4_neighbours}
ORACLES: dict[str, str] = {}
