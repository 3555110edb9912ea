"""Held-out accuracy on made-up languages, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from helpers import documents, prose, write_tables
from tracemill.llm import language, quality, toxicity

WORDS = {
    "en": ["the", "thing", "hereof", "when", "which", "shower", "with", "other"],
    "de": ["der", "schaft", "ung", "heit", "zwischen", "für", "über", "doch"],
    "fr": ["le", "eaux", "très", "quelle", "ainsi", "être", "oiseau", "français"],
}
BAD = ("vile", "rotten")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(500):
        lang = rng.choice(list(WORDS))
        w = prose(rng, rng.randint(60, 160), WORDS[lang]).split()
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "ly", "ness"])
        text = " ".join(w)
        docs.append((i, text if good else "!! ".join(text.upper().split()), lang if i % 11 else None))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !! 34", None), (None, "the thing", "en"), (1003, "the " * 40_000, "en"), (5, docs[5][1], docs[5][2])]
    labels += [(5, 1, 0), (None, 1, 1), (9999, 0, 1), (7, None, None)]
    path = tmp_path_factory.mktemp("tables")
    return write_tables(path, documents=documents(spark, docs), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), docs, labels


def held(i, parts, rest):
    return i is not None and zlib.crc32(str(i).encode()) % parts == rest


def test_language(spark, tables):
    path, docs, _ = tables
    got = language.op2_language(spark, path).collect()
    assert len(got) == len(docs)
    truth = {d[0]: d[2] for d in docs if d[2] and d[0] is not None and d[0] < 1000}
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), "und")


def test_toxicity(spark, tables):
    path, docs, labels = tables
    got = toxicity.op3_toxicity(spark, path).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels if i is not None and i < 1000 and t is not None}
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 50 and np.mean(right) > 0.93


def test_quality(spark, tables):
    path, docs, labels = tables
    got = quality.op7_quality(spark, path).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels if i is not None and i < 1000 and q is not None}
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_without_labels_or_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = write_tables(tmp_path, documents=documents(spark, [(1, "a b", None), (2, None)]), labels=none)
    for query, k in ((language.op2_language, 3), (toxicity.op3_toxicity, 3), (quality.op7_quality, 3)):
        rows = query(spark, path).collect()
        assert len(rows) == 2 and all(len(r) > k for r in rows)
    empty = write_tables(tmp_path / "empty", documents=documents(spark, []), labels=none)
    for query in (language.op2_language, toxicity.op3_toxicity, quality.op7_quality):
        assert query(spark, empty).count() == 0


def test_codewords_differ():
    for n in (2, 3, 6, 12, 40):
        code = language.codewords(n)
        far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(far) >= (1 if n <= 6 else 12)


def test_isotonic():
    x, n = np.arange(5.0), np.array([4, 4, 4, 4, 4.0])
    edges, values = quality.isotonic(x, n, np.array([0, 3, 1, 4, 4.0]))
    assert (np.diff(values) >= 0).all() and values[np.searchsorted(edges, 1)] == values[np.searchsorted(edges, 2)]


def chunk_of(texts):
    import pyarrow as pa
    from tracemill.llm._text import chunks

    (c,) = chunks(pa.array(texts, pa.large_string()))
    return c


TEXTS = ["The thing, THE thing.", "", "été Ü", "a", "one two\n\nthree one two! |x|\n", "abc " * 50]


def test_ngrams_and_decoding_are_the_plain_ones():
    got = language.ngram_counts(chunk_of(TEXTS))
    for row, t in zip(got, TEXTS, strict=True):
        b, want = t.translate({c: c + 32 for c in range(65, 91)}).encode(), np.zeros(language.BUCKETS)
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                code = 0
                for k in range(n):
                    code = (code * 257 + b[i + k] + 1 + k) % 2**32
                want[(code * 2654435761 % 2**32) >> 20] += 1
        want = np.sqrt(want)
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9), atol=1e-6)
    rng = np.random.default_rng(1)
    code = language.codewords(4)
    trust = rng.random(code.shape[1])
    m = language.LanguageModel(list("abcd"), code, rng.normal(size=(language.BUCKETS, code.shape[1])), rng.normal(size=code.shape[1]), trust / trust.sum())
    best, _, lead = m.decode(got)
    for row, k, gap in zip(got, best, lead, strict=True):
        margin = [min(max(float(row @ m.weight[:, j] + m.bias[j]), -6), 6) for j in range(code.shape[1])]
        loss = [sum(t * np.exp(-c * x) for t, c, x in zip(m.trust, word, margin, strict=True)) for word in code]
        assert k == int(np.argmin(loss)) and 0 <= gap <= 1


def test_convolution_and_pooling_are_the_plain_ones():
    rng = np.random.default_rng(2)
    T = toxicity
    m = T.ToxicityModel(rng.normal(size=(T.PAD + 1, T.DIM)).astype(np.float32), [rng.normal(size=(w, T.DIM, T.FILTERS)).astype(np.float32) for w in T.WIDTHS], [rng.normal(size=T.FILTERS).astype(np.float32) for _ in T.WIDTHS], rng.normal(size=2 * T.FILTERS * len(T.WIDTHS)), 0.3)
    m.embed[T.PAD] = 0
    docs = [rng.integers(0, T.PAD, (n, T.KINDS)).astype(np.int32) for n in (0, 1, 5, 64, 65, 200)]
    for d, logit in zip(docs, m.logits(docs), strict=True):
        x = [sum(m.embed[i].astype(np.float64) for i in row) for row in d] or [np.zeros(T.DIM)]
        n = len(x)
        x += [np.zeros(T.DIM)] * 2
        most, mean = [], []
        for w, f, b in zip(T.WIDTHS, m.filters, m.shift, strict=True):
            for k in range(T.FILTERS):
                found = [sum(x[i + j] @ f[j, :, k].astype(np.float64) for j in range(w)) + b[k] for i in range(n)]
                tops = [max(0, max(found[i : i + T.SEGMENT])) for i in range(0, n, T.SEGMENT)]
                most.append(max(tops))
                mean.append(sum(tops) / len(tops))
        assert abs(np.array(most + mean) @ m.out + m.bias - logit) < 1e-2


def test_statistics_and_normal_equations_are_the_plain_ones(spark):
    import re

    got = dict(zip(quality.NAMES, quality.statistics(chunk_of(TEXTS)).T, strict=True))
    for i, t in enumerate(TEXTS):
        b, w = t.encode(), re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
        pairs = list(zip(w, w[1:], strict=False))
        lines = [x for x in b.split(b"\n") if x]
        assert got["upper"][i] == pytest.approx(sum(65 <= x <= 90 for x in b) / max(len(b), 1))
        assert got["log_words"][i] == pytest.approx(np.log1p(len(w))) and got["distinct_words"][i] == pytest.approx(len(set(w)) / max(len(w), 1))
        assert got["word_length"][i] == pytest.approx(sum(map(len, w)) / max(len(w), 1))
        assert got["repeated_pairs"][i] == pytest.approx(1 - len(set(pairs)) / max(len(pairs), 1))
        assert got["same_as_before"][i] == pytest.approx(sum(a == b for a, b in pairs) / max(len(w), 1))
        assert got["distinct_lines"][i] == pytest.approx(len(set(lines)) / max(len(lines), 1))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.4).astype(int)
    m = quality.fit(spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y, strict=True)], "stats array<double>, y int").repartition(5))
    z = m.features(x)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0))
    assert np.allclose(m.weight, np.linalg.solve(z.T @ z + quality.RIDGE * 300 * np.eye(z.shape[1]) / z.shape[1], z.T @ y), atol=1e-6)


def test_every_language_is_learnt(spark):
    rows = [(10 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}" * 30, f"l{k:03d}") for k in range(600) for i in range(2)]
    model = language.fit(documents(spark, rows), language.F.lit(True))
    assert len(model.langs) == 600 and len(np.unique(model.code, axis=0)) == 600


def test_all_rows_are_learnt_from(spark):
    """Words of 10,000 rows, each its own: those of all rows but the fold and the rows for thresholds have odds; each row is in a mean of its language."""
    n = 10_000
    word = [f"{chr(97 + i % 26)}{i:x}q" for i in range(n)]
    docs = documents(spark, [(i, f"{w} thing {'vile' if i % 2 else 'fine'}", "en" if i % 3 else "de") for i, w in enumerate(word)])
    m, lid = toxicity.fit(docs, spark.range(n).selectExpr("id doc_id", "cast(id % 2 as int) toxic"))
    ids = np.array([d[0, 0] for d in toxicity.word_ids(chunk_of(word))])
    assert 0.55 * n < np.count_nonzero(m.embed[ids, 0]) < 0.7 * n
    assert lid.langs == ["de", "en"]
    scores = m.score(toxicity.word_ids(chunk_of(["thing vile", "thing fine"])), ["en", "en"])
    assert scores[0] >= 0.5 > scores[1]
    few = docs.where("doc_id < 600 or doc_id = 9999").withColumn("text", language.F.expr("if(doc_id = 9999, repeat('xyzzy ', 50), text)"))
    a, b = (language.fit(few.where(where), language.F.lit(True)) for where in ("true", "doc_id <> 9999"))
    assert not np.array_equal(a.weight, b.weight)


def test_toxicity_moves_few_texts_to_their_labels(spark):
    texts = ["", "mañana " * 300, *("some words of text %d" % i for i in range(2, 3000))]
    docs = spark.createDataFrame([(i * 7919, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = docs.where("doc_id % 10 = 0").selectExpr("doc_id", "1 as y")
    rows = toxicity.packed(docs, known)
    assert rows.count() < 330  # of 3000, of which 300 have a label
    batches = rows.join(known, "doc_id").select("packed", "size", "y", "doc_id").toArrow().to_batches()
    got = {k: t for b in batches for k, t in zip(b["doc_id"].to_pylist(), toxicity.unpacked(b)["text"].to_pylist(), strict=True)}
    assert got == {i * 7919: t for i, t in enumerate(texts) if i * 7919 % 10 == 0}
    assert toxicity.packed(docs, known.selectExpr("cast(doc_id as int) doc_id", "y")).count() == 3000
