"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits, of which near copies differ in few. Fingerprints within a radius of 3 agree in
at least one of four blocks of 16 bits, so the distinct fingerprints are dealt into shards by (block, its
value) and no link is lost. Each shard has a BK-tree: children are keyed by their integer Hamming
distance to the parent, and a probe at distance d from a node follows only the edges d - 3 .. d + 3. A
shard that has grown beyond MAX_TREE fingerprints is dealt again, exactly, by blocks of its other bits.
A shard sends on only a spanning forest of its links, so a large group never becomes all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._components import components
from tracemill.llm._shared import joined, written
from tracemill.llm._text import chunks, ranges, slices

RADIUS = 3
SHINGLE = 3
SEED = 42
MAX_TREE = 4096  # fingerprints in a shard before it is dealt again
MAX_DEALS = 3  # four blocks of 12, 9 and 6 or 7 bits of what is left
BUCKET_ROWS = 40_000  # fingerprints whose trees one task builds at a time
PROBES = 1024  # fingerprints that go down a tree together


def shingle_hashes(text: bytes, n: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of the n-word shingles of text, A-Z lower-cased, words being separated by ASCII white space."""
    found = text.lower().split()
    if len(found) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else []
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(found) - n] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], seed) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=True)]


_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of counts[i] hashes the fingerprint: bits set in over half of them. An empty run gives 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = (np.cumsum(counts) - counts)[full]
    # A byte lane counts up to 255 hashes, so runs are summed in blocks of 255.
    who, block = ranges(np.zeros(len(full), np.int64), -(-counts[full] // 255))
    at = first[who] + 255 * block
    run = np.flatnonzero(block == 0)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), run, axis=0)
        for byte in range(8):
            bit = (2 * ones[:, byte] > counts[full]).astype(np.uint64)
            out[full] |= bit << np.uint64(8 * byte + b)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and fp, the fingerprint's 64 bits as a signed long. Null and empty texts have 0."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for c in chunks(batch.column(len(keep))):
                lists = [shingle_hashes(c.text(i)) for i in range(c.n)]
                counts = np.fromiter(map(len, lists), np.int64, c.n)
                flat = np.concatenate([np.array(x, np.uint64) for x in lists]) if counts.sum() else np.zeros(0, np.uint64)
                out.append(majority_bits(flat, counts).view(np.int64))
            fp = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fp], [*keep, "fp"])

    schema = rows.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema)


class BKForest:
    """BK-trees, one for each group, over 64-bit values that are distinct within their group."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        """group must be sorted."""
        n = len(value)
        self.value, self.parent, self.edge = value, np.full(n, -1), np.zeros(n, np.int64)
        _, first, which = np.unique(group, return_index=True, return_inverse=True)
        self.root = first[which]
        node = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[node]
        while len(node):  # each round moves every waiting value one edge down
            d = np.bitwise_count(value[node] ^ value[at]).astype(np.int64)
            _, child, which = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            new = node[child]
            self.parent[new], self.edge[new] = at[child], d[child]
            at = new[which]
            wait = at != node
            node, at = node[wait], at[wait]
        self.order = np.lexsort((self.edge, self.parent))
        self.keys = self.parent[self.order] * 65 + self.edge[self.order]

    def near(self, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, node) pairs of the probes' own groups at a distance of radius at most, without a node itself."""
        who, at = probes, self.root[probes]
        found = []
        while len(who):
            d = np.bitwise_count(self.value[who] ^ self.value[at]).astype(np.int64)
            hit = (d <= radius) & (who != at)
            found.append((who[hit], at[hit]))
            lo = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), "right")
            i, k = ranges(lo, hi - lo)
            who, at = who[i], self.order[k]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each of n nodes the least node that it is linked to, over any number of links."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(deeper := root[root], root):
                root = deeper
    return root


def _links_of(table: pa.Table) -> pa.Table:
    fp = table.column("fp").to_numpy()
    group = table.column("key").to_pandas().factorize()[0]
    by = np.argsort(group, kind="stable")
    group, fp = group[by], fp[by]
    forest = BKForest(group, fp.view(np.uint64))
    root = spanning(len(fp), (forest.near(np.arange(i, min(i + PROBES, len(fp))), RADIUS) for i in range(0, len(fp), PROBES)))
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return pa.table({"a": fp[linked], "b": fp[root[linked]]})


def _dealt(rows: DataFrame, left: int) -> DataFrame:
    """Each row's left remaining bits in four blocks: one row for each, keyed by block and value, with the others left."""
    rest, parts, end = F.col("rest"), [], 0
    for b in range(4):
        at, end = end, left * (b + 1) // 4
        size = end - at
        value = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << size) - 1))
        above = F.shiftleft(F.shiftrightunsigned(rest, end), at) if end < 64 else F.lit(0).cast("long")
        others = above.bitwiseOR(rest.bitwiseAND(F.lit((1 << at) - 1)))
        parts.append(F.struct(F.concat_ws("/", F.col("key"), F.concat(F.lit(f"{b}:"), value.cast("string"))).alias("key"), others.alias("rest")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("x")).select("fp", "x.key", "x.rest")


def links(fps: DataFrame, max_tree: int = MAX_TREE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join all fingerprints within RADIUS, directly or by way of others."""
    n = fps.count()
    rows = written(_dealt(fps.select("fp", F.lit(None).cast("string").alias("key"), F.col("fp").alias("rest")), 64))
    done, left = [], 48
    for _ in range(MAX_DEALS):
        large = written(rows.groupBy("key").count().where(F.col("count") > max_tree).select("key"))
        if large.isEmpty():
            break
        done.append(joined(rows, large, "key", "left_anti"))
        rows = written(_dealt(joined(rows, large, "key"), left))
        left -= left // 4
    for x in done:
        rows = rows.unionByName(x)
    bucket: Column = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-4 * n // BUCKET_ROWS))))
    return rows.select("key", "fp", bucket.alias("bucket")).groupBy("bucket").applyInArrow(_links_of, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, keep, fp, component_id.

    component_id is the least non-null id reachable by links, the document's own included; it is null if
    no document of the component has an id. Null and empty texts share fingerprint 0. Repeated rows and ids
    stay as they are. Other columns of docs don't matter.
    """
    prints = written(fingerprints(docs.select(F.col(id_col).alias("__id"), text, *keep), text, ("__id", *keep)))
    reps = written(prints.groupBy("fp").agg(F.min("__id").alias("rep"), (F.count("*") > 1).alias("copies")))
    comp = written(components(links(reps.select("fp"))))
    least = reps.join(comp.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("rep").alias("cid"))
    of_fp = joined(comp, written(least), "root").select(F.col("node").alias("fp"), "cid", F.lit(True).alias("linked"))
    # A fingerprint of one document without links needs no other: its component is the document itself.
    ids = reps.join(of_fp, "fp", "left").where("linked or copies").select("fp", F.coalesce("cid", "rep").alias("component_id"), F.lit(True).alias("__shared"))
    cid = F.when(F.col("__shared"), F.col("component_id")).otherwise(F.col("__id")).alias("component_id")
    return joined(prints, written(ids), "fp", "left").select(F.col("__id").alias(id_col), *keep, "fp", cid)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of all documents.

    Null and empty texts have fingerprint 0. Repeated rows give a row each; a component's id is the least that isn't
    null, and null if it has none. Columns beyond doc_id and text, whatever their names, are ignored; texts of any length
    are read whole; an empty table gives no rows.
    """
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group: the one with the least id stays.

    An id that several rows have stays if any of them is its group's least. Rows without an id stay, having
    nothing by which they could be told apart.
    """
    found = near_duplicates(docs).where("doc_id is not null")
    gone = written(found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select("doc_id"))
    return joined(docs, gone, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
