"""Base counts against a plain version, distances against dense histograms, verdicts on made-up languages."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import UP, documents, prose, write_tables
from hypothesis import given, settings
from hypothesis import strategies as st
from tracemill.llm import _text, rules

LANGS = {"en": "the of and to in that was for it with as his on be at".split(), "de": "der die und das nicht von sie ist mit für über schön straße groß auch".split()}


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


ODD = ["", " \n ", "a", "one two\none two\n\none two ", "x\r\nx\r\nx", "a b c d e a b c d e", "a a a a a a a", "é#ü $ | <漢字>\t😀", "  x", "w " * 30_000, "\n\n\n", "a b c d e f\na b c d e g"]


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#漢\xa0", max_size=60), max_size=6))
def test_base_counts(texts):
    found = [rules.base_counts(c) for c in _text.chunks(pa.array(texts + ODD, pa.string()), most=50)]
    assert np.concatenate(found).tolist() == [list(base(t)) for t in texts + ODD]


def js(p, q):
    keys = set(p) | set(q)
    half = lambda a, b: sum(a.get(k, 0) * math.log2(a[k] / ((a.get(k, 0) + b.get(k, 0)) / 2)) for k in keys if a.get(k, 0) > 0) / 2
    return math.sqrt(max(0, half(p, q) + half(q, p)))


def plain(docs):
    """(doc_id, counts, failed, kept) of each row, by dictionaries."""
    rows = []
    for i, t, lang in docs:
        counts = base(t)
        low = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(UP))
        chars = Counter(next((k for k, v in enumerate(rules.CLASSES.values()) if ch.encode()[0] in v), rules.OTHER) for ch in t or "")
        rows.append((i, lang, counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0], Counter(low), chars))
    words, chars = {}, {}
    for _, lang, _, failed, w, c in rows:
        if lang is not None and not failed:
            words.setdefault(lang, Counter()).update(w)
            chars.setdefault(lang, Counter()).update(c)
    whole = sum(sum(w.values()) for w in words.values())
    share = lambda c: {k: v / sum(c.values()) for k, v in c.items()}
    refs = {}
    for lang, w in words.items():
        n = sum(w.values())
        if n * rules.LANGUAGES >= whole:
            common = {k: v / n for k, v in w.items() if v * rules.COMMON >= n}
            refs[lang] = (share(chars[lang]), common)
    out = []
    for i, lang, counts, failed, w, c in rows:
        near = [refs[x] for x in refs if lang is None or x == lang]
        bad, n = False, sum(w.values())
        if near and sum(c.values()) >= rules.LEAST_CHARS:
            bad |= min(js(share(c), r[0]) for r in near) > rules.CHARS_FAR
        if near and n >= rules.LEAST_WORDS:
            dist = []
            for _, common in near:
                p = {k: w[k] / n for k in common if w[k]}
                dist.append(js(p | {None: 1 - sum(p.values())}, common | {None: max(0, 1 - sum(common.values()))}))
            bad |= min(dist) > rules.WORDS_FAR + rules.CHANCE / math.sqrt(n)
        out.append((i, *counts, failed, not failed and not bad))
    return out


def rows():
    rng = random.Random(8)
    docs = []
    for i in range(300):
        lang = rng.choice(list(LANGS))
        text = " ".join(rng.choice(LANGS[lang]) if rng.random() < 0.7 else "".join(rng.choices("aeiounrst", k=rng.randint(3, 8))) for _ in range(rng.randint(20, 400)))
        if i % 50 == 3:
            text = "!! ".join(text.upper().split())
        if i % 50 == 6:
            text = " | ".join(f"q{rng.randrange(10**6)}" for _ in range(200))
        docs.append((i, text, lang if i % 7 else None))
    rare = [(500, prose(rng, 30, ["zu", "zo", "za"]), "xx")]
    return docs + rare + [(600 + k, t, "en") for k, t in enumerate(ODD)] + [(700, None, "en"), (700, None, None), (None, docs[1][1], "de"), docs[1], docs[1]]


def test_against_plain(spark, tmp_path):
    docs = rows()
    table = documents(spark, docs).selectExpr("*", "1 as kind", "'x' as key", "2 as n_words", "true as kept")
    got = Counter(tuple(r) for r in rules.op13_rules(spark, write_tables(tmp_path, documents=table)).collect())
    want = plain(docs)
    assert got == Counter(want)
    verdict = {w[0]: w[-1] for w in want}
    assert not any(verdict[i] for i in range(300) if i % 50 in (3, 6) and want[i][1] > 150)
    assert np.mean([verdict[i] for i in range(300) if i % 50 not in (3, 6)]) > 0.9


def test_rest_of_columns(spark):
    got = {r.doc_id: r for r in rules.judged(documents(spark, rows())).collect()}
    assert got[601].char_distance is None and 0 <= got[1].char_distance <= 1 and got[500].word_distance is None


def test_empty(spark):
    assert rules.judged(documents(spark, [])).count() == 0


def test_identical_histograms_are_near():
    c = np.array([[3.0, 1.0] + [0] * (rules.KINDS - 2)])
    refs = rules.References(["a"], c / 4, np.array([0, 2]), np.array([5, 9], np.uint64), np.array([0.5, 0.5]))
    got = rules.distances(c, np.zeros(4, np.int64), np.array([5, 9, 9, 5], np.uint64), refs, 0, 1)
    assert got == pytest.approx(0, abs=1e-7)
    far = rules.distances(c[:, ::-1], np.zeros(2, np.int64), np.array([1, 2], np.uint64), refs, 0, 1)
    assert far == pytest.approx(1)
