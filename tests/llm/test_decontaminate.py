import hashlib
import random
import re

import pyarrow as pa
import pytest
from helpers import UP, documents, prose, write_tables
from tracemill.llm import _shared, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(docs, items):
    windows = {}
    for i, t in items:
        if i is None or t is None:
            continue
        w = WORD.findall(t.translate(UP))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").translate(UP)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def tables():
    rng = random.Random(8)
    few, many = ["a", "b"], [f"w{i}" for i in range(300)]
    items = [(i, prose(rng, rng.randint(13, 60), many)) for i in range(12)] + [(20, prose(rng, 14, few)), (21, "Short one, is it?"), (22, "é"), (23, ""), (24, None), (None, "w1 w2"), (25, "a b a b a b a b a b a b a"), (3, "again the same id")]
    docs = []
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 80), many)]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, max(0, len(w) - 12))
            parts += [", ".join(w[cut : cut + rng.randint(11, 30)]).upper(), prose(rng, rng.randint(0, 40), many)]
        docs.append((k, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "a b " * 500), (102, "a b " * 500), (None, items[0][1]), (103, "it? SHORT one is it"), (104, prose(rng, 30_000, many) + " " + items[1][1])]
    return docs, items


@pytest.mark.parametrize(("index_bytes", "salted"), [(1 << 25, False), (200, False), (200, True)])
def test_against_brute_force(spark, index_bytes, salted, monkeypatch, tmp_path):
    docs, items = tables()
    if salted:  # nothing is broadcast, and keys of more than 20 rows are dealt
        monkeypatch.setattr(_shared.joined, "__defaults__", ("inner", 0))
        monkeypatch.setattr(_shared, "HOT_ROWS", 20)
    monkeypatch.setattr(decontaminate.find, "__defaults__", ("text", "found", index_bytes))
    path = write_tables(tmp_path, documents=documents(spark, docs), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in decontaminate.op6_decontaminate(spark, path).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = plain(docs, items)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[5] for r in want) > 5


def test_empty_tables_and_clashing_columns(spark):
    docs = documents(spark, [(1, "some words")]).selectExpr("*", "1 as n_words", "2 as items")
    items = spark.createDataFrame([], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 1
    assert decontaminate.without_contaminated(documents(spark, []), items).count() == 0
    own = decontaminate.find(docs.withColumnRenamed("items", "found"), items)
    assert own.columns == [*docs.columns[:-1], "found"] and own.first().found.n_words == 2


def test_repeated_words_cost_no_more():
    import time

    same = "word " * 20_000
    began = time.time()
    index = decontaminate.Index([("a", same), ("b", same), ("a", "word " * 30)])
    (c,) = decontaminate.chunks(pa.array([same, "word " * 12 + "x"], pa.large_string()))
    first, second = decontaminate._found(c, index)
    assert time.time() - began < 2
    assert first == {"n_words": 20_000, "spans": [0, 20_000], "items": ["a", "b"]} and second["items"] == []


@pytest.mark.parametrize("index_bytes", [0, 1 << 20])
def test_columns_of_any_name_stay(spark, index_bytes):
    item = " ".join(f"w{i}" for i in range(20))
    docs = documents(spark, [(1, item), (2, "clean " * 30), (3, None)]).selectExpr("*", "1 as __found", "2 as __n", "3 as __key", "4 as __spans", "5 as c0", "6 as found")
    items = spark.createDataFrame([("a", item), ("b", " .,; "), ("c", "")], "item_id string, text string")
    got = decontaminate.find(docs, items, into="out", index_bytes=index_bytes)
    assert got.columns == [*docs.columns, "out"]
    assert {r.doc_id: (list(r.out["items"]), r.found, r.c0, r["__key"]) for r in got.collect()} == {1: (["a"], 6, 5, 3), 2: ([], 6, 5, 3), 3: ([], 6, 5, 3)}
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_one_frequent_word_is_dealt(spark, monkeypatch):
    """A corpus of one word and an item of it: its window goes through the dealt joins, and the result is whole."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(_shared.joined, "__defaults__", ("inner", 0))
    monkeypatch.setattr(_shared, "HOT_ROWS", 100)
    seen, real = [], _shared.joined

    def spy(rows, table, key, how="inner"):
        got = real(rows, table, key, how)
        if key == "w":
            seen.append(got.groupBy("w").count().first()["count"])
        return got

    monkeypatch.setattr(decontaminate, "joined", spy)
    docs = documents(spark, [(k, "the " * (k + 1)) for k in range(150)])
    items = spark.createDataFrame([("a", "The"), ("b", "the the"), ("c", "other")], "item_id string, text string")
    got = decontaminate.find(docs, items, index_bytes=0).select("doc_id", F.col("found.items").alias("items"), decontaminate.n_hit().alias("n")).collect()
    assert {r.doc_id: (list(r["items"]), r.n) for r in got} == {k: (["a", "b"] if k else ["a"], k + 1) for k in range(150)}
    assert len(seen) == 2 and max(seen) > 100
