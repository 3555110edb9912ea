import random
from pathlib import Path

import corpus_pipeline
import pytest
from helpers import documents, prose, write_tables
from test_decontaminate import plain as contaminated
from test_pii import plain as personal
from test_simhash import grouped
from test_simhash import plain as fingerprint
from tracemill.llm import packing, toxicity

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
def test_stages(spark):
    """Each stage's rows follow from its operator's own findings."""
    from tracemill.llm import decontaminate, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n, outs = docs.columns, docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(SF)).cache()
        outs.append(out)
        if name != "packing":
            assert out.columns == columns and out.count() <= n
            n, docs = out.count(), out
    toxic, one, clean, masked, packed = outs
    comp = simhash.near_duplicates(toxic).select("component_id").distinct()
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.component_id for r in comp.collect())
    found = decontaminate.find(one, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert clean.count() == found.where(~decontaminate.contaminated()).count() < one.count()
    assert masked.count() == clean.count()
    want = packing.pieces(masked).agg({"length": "sum", "doc_id": "count"}).first()
    assert packed.agg({"length": "sum", "doc_id": "count"}).first() == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty, long, repeated and near texts, null ids, and columns named as the operators' own."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [prose(rng, 400, words) for _ in range(6)]
    near = base[0].split()
    near[5] = "changed"
    item = prose(rng, 40, [f"q{i}" for i in range(50)])
    rows = [(i, t) for i, t in enumerate(base)] + [(20, base[1]), (21, " ".join(near)), (22, None), (23, ""), (24, None), (25, " "), (26, "long " * 60_000), (27, base[2]), (27, base[2]), (None, base[3]), (None, None)]
    rows += [(30, item + " " + prose(rng, 100, words)), (31, "mail a@b.co or +1 222 333 4444 now"), (32, "x" * 200_000)]
    rows += [(100 + i, prose(rng, 30, words) + (" vile rotten" * 3 if i % 2 else "")) for i in range(80)]
    clash = ("found", "score", "fp", "component_id", "spans", "start", "length", "key", "tokens", "leaf", "__text")
    docs = documents(spark, rows).selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(clash)))
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(80)] + [(22, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = [(1, item), (2, None), (None, "w1"), (3, "")]
    path = write_tables(tmp_path_factory.mktemp("odd"), documents=docs, labels=labels, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    return path, rows, items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, stage):
    """Each stage by itself against a plain version."""
    path, rows, items = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, path)
    if stage != "packing":
        assert out.columns == docs.columns
        got = pairs(out)
    if stage == "toxicity":
        score = {(r.doc_id, r.text): r.toxic for r in toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet")), "toxic").collect()}
        assert got == sorted((r for r in rows if score[r] < 0.5), key=str)
        assert {i for i, _ in rows if i and i >= 100} - {i for i, _ in got} == {100 + i for i in range(1, 80, 2)} and (22, None) in got
    elif stage == "simhash":
        comp = grouped([fingerprint(t) for _, t in rows], [i for i, _ in rows])
        least = {i for (i, _), c in zip(rows, comp, strict=True) if i == c}
        assert got == sorted((r for r in rows if r[0] is None or r[0] in least), key=str)
        assert {20, 21, 23, 24}.isdisjoint(i for i, _ in got)
    elif stage == "decontaminate":
        bad = [r[5] for r in contaminated(rows, items)]
        assert got == sorted((r for r, b in zip(rows, bad, strict=True) if not b), key=str) and sum(bad) == 1
    elif stage == "pii":
        assert [i for i, _ in got] == [i for i, _ in sorted(rows, key=str)] or len(got) == len(rows)
        text = {i: t for i, t in got if i is not None}
        assert text[31] == "mail [EMAIL] or [PHONE] now" and not any(personal(t) for _, t in got)
        assert all(text[i] == t for i, t in rows if i is not None and i != 31)
    else:
        assert_packed(out.toPandas(), rows)
    assert run(spark, docs.limit(0), path).count() == 0


def assert_packed(got, rows):
    """Every document's ids once, in sequences without gaps."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert got.length.sum() == want and (got.doc_tokens >= got.start + got.length).all()
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    assert by.groupby("sequence_id").length.sum().max() <= packing.LENGTH


def test_run_is_its_stages(spark, odd):
    """run() packs what a document by document version of the stages before leaves."""
    path, _, _ = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
    assert_packed(corpus_pipeline.run(spark, path).toPandas(), pairs(docs))
