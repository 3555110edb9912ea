"""Hard negatives against brute force with Python's integers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import write_tables
from tracemill.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """The contract's rows."""
    fit = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        fit.append((i, [int(math.floor(256 * c)) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = Counter()
    for k, (i, q, label) in enumerate(fit):
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, x, strict=True)), j, other) for m, (j, x, other) in enumerate(fit) if m != k and len(x) == len(q)), key=lambda s: s[:2])
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out.update((i, pid, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(inside))
    return out


def vectors(n, dim, seed=1, hot=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [c[k] * 0.5 + rng.gauss(0, 0.3) for k in range(dim)]
        rows.append((i, [0.5] * dim if rng.random() < hot else v, rng.choice([0, 0, 0, 1, 2, 5, 9])))
    return rows


ODD = [(700, None, 1), (701, [1.0, None, 2.0], 1), (800, [1.0, float("nan"), 0.0], 1), (900, [1.0, float("inf"), 0.0], 2), (1000, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1), (1100, [0.0, 0.0, 0.0], 1), (1200, [0.5, 0.5], 1), (1201, [0.5, 0.6], 1), (1202, [0.5, 0.5], 2), (1300, [], 1), (1301, [], 1), (1302, [], 3), (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1), (1500, [1e9, 2e9, -1e9], 4), (1501, [2e9, 1e9, -1e9], 4), (1502, [2e9, 1e9, -1.1e9], 5)]


@pytest.mark.parametrize("block", [7, 64, 512])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(negatives, "PAGE", 5)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rows = vectors(500, 3) + ODD
    label = negatives.F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    found = negatives.mined(spark.createDataFrame(rows, SCHEMA), negatives.F.col("id") % 100 == 0, label=label, block=block)
    want = plain(rows)
    got = Counter(tuple(r) for r in found.collect())
    # Products beyond a long can't be told apart.
    assert {k: v for k, v in got.items() if k[0] != 1500} == {k: v for k, v in want.items() if k[0] != 1500}


def test_query(spark, tmp_path):
    rows = vectors(900, 20, seed=5)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as row", "'x' as found", "3 as low")
    got = negatives.op12_negatives(spark, write_tables(tmp_path, embeddings=table)).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)
    assert len(got) > 100
    assert negatives.op12_negatives(spark, write_tables(tmp_path / "none", embeddings=spark.createDataFrame([], SCHEMA))).count() == 0


def test_large_products():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**30, 1.0], [2.0**14, 5.0], [-(2.0**30), 0.0]])
    assert negatives.scores(q, x).tolist() == [[1 << 56, (1 << 54) + 15, -(1 << 56)]]
    assert negatives.bounds(q, x, x)[1].tolist() == [[np.inf, np.inf, np.inf]]


def test_hilbert_neighbours():
    """All cells of a cube, in order of the curve: each is one step from the one before."""
    for bits, dim in ((1, 4), (2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
        keys = [k.tobytes() for k in negatives.hilbert(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-50, 50, (9, 6)).astype(float), rng.integers(-50, 50, (40, 6)).astype(float)
    least, most = negatives.bounds(q, x.min(0)[None], x.max(0)[None])
    assert (least <= q @ x.T).all() and (most >= q @ x.T).all()


def test_few_blocks_are_read(spark):
    """Clusters far from each other: most blocks can't hold what an anchor needs."""
    rng = random.Random(3)
    rows = [(i, [(4.0 if k == i % 8 else 0.0) + rng.gauss(0, 0.05) for k in range(8)], i % 8 if i % 3 else (i + 1) % 8) for i in range(2000)]
    table = negatives.whole_vectors(spark.createDataFrame(rows, SCHEMA), "embedding", "vec_id", negatives.F.col("label"))
    blocks = negatives.blocks_of(table, 32)
    anchors = table.where("id % 100 = 0").selectExpr("row", "dim", "label", "x", "double(500000) as low", "double('inf') as high", "cast(null as array<long>) as windows")
    needed = negatives._bounded(anchors, blocks, True, False).count()
    assert 0 < needed < 0.35 * anchors.count() * blocks.count()
