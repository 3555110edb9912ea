import random
import re

import numpy as np
import pytest
import xxhash
from helpers import UP, documents, write_tables
from tracemill.llm import _components, simhash


def plain(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(300, 900))) for _ in range(12)]
    out = [None, "", " \t\n", "One", "one", "two words", "Two Words", "Été x y", "été x y", "a b c", "a  b\tc"]
    for b in base:
        out.append(b)
        for _ in range(3):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    out.append("long " * 30000)
    return [(i * 7 % 101, t) for i, t in enumerate(out)] + [(None, base[0]), (None, "lonely text here now"), (500, base[1]), (500, base[1])]


def test_against_brute_force(spark, tmp_path):
    data = rows()
    docs = documents(spark, data)
    got = simhash.op1_simhash(spark, write_tables(tmp_path, documents=docs)).collect()
    fps = [plain(t) for _, t in data]
    comp = grouped(fps, [i for i, _ in data])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(data, fps, comp, strict=True)), key=lambda r: key((r[0], r[2])) + (r[1],))
    assert sorted(map(tuple, got), key=lambda r: key((r[0], r[2])) + (r[1],)) == want
    assert any(c != i for (i, _), c in zip(data, comp, strict=True))


@pytest.mark.parametrize("max_tree", [4, 10_000])
def test_links_join_all_that_are_near(spark, max_tree):
    """Crowded shards, dealt again or not, lose no link."""
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = _components.components(simhash.links(df, max_tree)).collect()
    root = {r.node % (1 << 64): r.root for r in found}
    comp = grouped(fps, list(range(len(fps))))
    for i in range(len(fps)):
        for j in range(i):
            assert (comp[i] == comp[j]) == (fps[i] in root and fps[j] in root and root[fps[i]] == root[fps[j]])


def test_trees_find_what_brute_force_does():
    rng = np.random.default_rng(2)
    value = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    group = np.sort(rng.integers(0, 3, len(value)))
    tree = simhash.BKForest(group, value)
    a, b = tree.near(np.arange(len(value)), 3)
    want = {(i, j) for i in range(len(value)) for j in range(len(value)) if i != j and group[i] == group[j] and int(value[i] ^ value[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in _components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_empty_and_extra_columns(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    docs = documents(spark, [(1, "a b c d"), (2, "a b c d"), (3, "other words are here")]).selectExpr("*", "1 as fp", "2 as component_id", "3 as rep")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]
    assert simhash.keep_one(docs).columns == docs.columns
