import random
import zlib

import numpy as np
import pytest
from helpers import documents, prose, write_tables
from tracemill.llm import packing


def test_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    words = ["alpha", "beta,", "Gamma!", "délta", "x1"]
    docs = [(i, prose(rng, int(rng.paretovariate(0.7) * 20) % 9000, words)) for i in range(150)] + [(200, None), (201, ""), (202, "a b"), (202, "a b"), (None, "null id")] + [(300 + i, "same text") for i in range(200)]
    got = packing.op9_packing(spark, write_tables(tmp_path, documents=documents(spark, docs))).toPandas()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs}
    for r in got[got.doc_id.notna()].itertuples():
        own = ids[int(r.doc_id)]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    covered = got.groupby("doc_id").length.sum()
    assert all(covered[i] == len(v) * (2 if i == 202 else 1) for i, v in ids.items() if i is not None)
    assert len(got[got.doc_id.isna()]) == 1
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    used = by.groupby("sequence_id").length.sum()
    assert used.max() <= packing.LENGTH and len(used) <= 1.03 * used.sum() / packing.LENGTH + 2


def test_empty(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_knapsack_against_search():
    from itertools import product

    rng = random.Random(1)
    for _ in range(20):
        n, room = 4, rng.randint(5, 14)
        size, value, most = np.array(rng.sample(range(2, 9), n)), np.array([rng.random() for _ in range(n)]), np.array([rng.randint(0, 3) for _ in range(n)])
        best = max(sum(a * b for a, b in zip(p, value, strict=True)) for p in product(*(range(m + 1) for m in most)) if sum(a * b for a, b in zip(p, size, strict=True)) <= room)
        worth, taken = packing.knapsack(value, size, room, most)
        assert worth == pytest.approx(best) and taken @ value == pytest.approx(best) and taken @ size <= room and (taken <= most).all()


def test_columns_reach_the_bound():
    size, demand = np.array([45, 36, 31, 14]), np.array([97.0, 610, 395, 211])  # a textbook case: 452.25 rolls
    patterns, x = packing.column_generation(size, demand, 100)
    assert x.sum() == pytest.approx(452.25, rel=2e-3)
    assert (patterns @ size <= 100).all() and (patterns.T @ x >= demand - 1e-6).all()


def test_plan_gives_each_piece_one_place():
    rng = random.Random(3)
    demand = {k: rng.randint(1, 40) for k in rng.sample(range(1, 257), 30)}
    plan = packing.plan(demand, 256)
    fill, seen = {}, set()
    for k, n in demand.items():
        for s, o in zip(*plan.place(k, np.arange(n)), strict=True):
            assert (s, o) not in seen
            seen.add((s, o))
            fill[s] = fill.get(s, 0) + k
    size = np.array(sorted(demand))
    _, x = packing.column_generation(size, np.array([float(demand[k]) for k in size]), 256)
    assert max(fill.values()) <= 256 and len(fill) <= x.sum() + len(demand) / 3
