"""The alignment of tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, prose, write_tables
from hypothesis import given
from hypothesis import strategies as st
from tracemill.llm import alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.tokenizer_path(alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.tokenizer_path(alignment.TOKENIZER_B))


def plain(texts, tokenizers):
    """The contract's columns of each text, with whole texts encoded at once and ends as sets."""
    ta, tb = tokenizers
    byte = alignment.byte_alphabet()
    each, held = [], defaultdict(int)
    for t in texts:
        found = None
        if t:
            a, b = ta.encode(" " + t, add_special_tokens=False), tb.encode(t)
            pa = [bytes(byte[c] for c in x) for x in a.tokens]
            pb = [bytes([int(p[1:-1], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, tb.encode(t, out_type=str), strict=True)]
            if b"".join(pa) == b"".join(pb) == (" " + t).encode():
                ends = [_ends(p) for p in (pa, pb)]
                both = sorted(ends[0].keys() & ends[1].keys())
                cut = [[ids[e[lo] if lo else 0 : e[hi]] for lo, hi in zip([0, *both], both, strict=False)] for ids, e in ((a.ids, ends[0]), (b, ends[1]))]
                found = list(zip(*cut, strict=True))
        each.append(found)
        for pair in {(x, y) for g in found or () for x in g[0] for y in g[1]}:
            held[pair] += 1
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for g in each:
        links = Counter((x, y) for p, q in g or () for x in p for y in q)
        shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g or ())
        out.append((sum(len(p) for p, _ in g or ()), sum(len(q) for _, q in g or ()), len(g or ()), sum(links.values()), sum(m for k, m in links.items() if held[k] == best[k[0]]), sum(m * held[k] for k, m in links.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out


def _ends(parts):
    """How many parts end at or before each end."""
    at, out = 0, {}
    for n, p in enumerate(parts):
        at += len(p)
        out[at] = n + 1
    return out


ODD = ["", None, " ", "  ", "a ", "a  ", " a", "x   y", "tab\t x", "line\n y", "two\n\n  z", "nb  s", "wide　 s", "low▁line", "<|endoftext|> a", "<s> b </s>", "<0x41>", "\x00", "\x1c x", "汉字假名 カタカナ", "emoji 👩‍👩‍👧 end", "é é", "==== ---- ====", "1234567890 12 345", "don't it's", "a" * 3000, "x" + " " * 70 + "y", "  u", "the the the the"]


def rows():
    rng = random.Random(4)
    words = ["alpha", "Beta,", "naïve", "été", "internationalisation", "x1;y2", "don't", "\n", "42", "--", "straße."]
    docs = [(i, prose(rng, rng.randint(1, 60), words)) for i in range(120)]
    docs += [(200 + i, t) for i, t in enumerate(ODD)]
    return docs + [(7, docs[7][1]), (None, "null id"), (300, docs[3][1]), (301, prose(rng, 20_000, words))]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_against_whole_texts(spark, tokenizers, frequent):
    docs = rows()
    got = alignment.align(documents(spark, docs), frequent=frequent).collect()
    want = Counter((i, *w) for (i, _), w in zip(docs, plain([t for _, t in docs], tokenizers), strict=True))
    assert Counter(tuple(r) for r in got) == want


def test_few_known_stretches(spark, tokenizers, monkeypatch):
    """What a worker remembers decides nothing."""
    docs = rows()[:60]
    a = alignment.Aligner(*(alignment.tokenizer_path(n) for n in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))
    monkeypatch.setattr(alignment, "KNOWN", 5)
    monkeypatch.setattr(alignment, "KNOWN_CHARS", 4)
    for start in range(0, 60, 7):
        part = [t for _, t in docs[start : start + 7]]
        table, code, doc, whole = a.of(part)
        assert [int(table.n[code[doc == k], 0].sum()) for k in range(len(part))] == [w[0] for w in plain(part, tokenizers)]
        assert whole.all()
    assert len(a.known) < 60


@given(st.lists(st.tuples(st.sets(st.integers(1, 60), min_size=1), st.sets(st.integers(1, 60), min_size=1)), max_size=8))
def test_galloping(stretches):
    """Ends of several stretches, one after the other."""
    flat = [np.array([100 * k + x for k, s in enumerate(stretches) for x in sorted(s[side])], np.int64) for side in (0, 1)]
    n = [np.array([len(s[side]) for s in stretches], np.int64) for side in (0, 1)]
    i, j = alignment.common_ends(*flat, *n)
    assert flat[0][i].tolist() == flat[1][j].tolist() == sorted(set(flat[0].tolist()) & set(flat[1].tolist()))


def test_wide_groups(spark, tokenizers, monkeypatch):
    """Groups whose repeated ids are paired once."""
    texts = [t for _, t in rows() if t and len(t) < 400]
    want = alignment.Aligner(*(alignment.tokenizer_path(n) for n in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))
    monkeypatch.setattr(alignment, "WIDE_GROUP", 2)
    fewer = alignment.Aligner(*(alignment.tokenizer_path(n) for n in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))
    got = fewer.of(texts)[0]
    monkeypatch.undo()
    table = want.of(texts)[0]

    def links(t, k):
        out = Counter()
        for key, times in zip(t.key[t.first[k] : t.first[k + 1]].tolist(), t.times[t.first[k] : t.first[k + 1]].tolist(), strict=True):
            out[key] += times
        return out

    assert got.shown == table.shown and all(links(got, k) == links(table, k) for k in range(len(table.shown)))


def test_quick_and_own_library(tokenizers):
    """Both libraries give the same ids of stretches of the older alphabets."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"()-_#*$%&|<>/\\\n\téèüßñçøłžαβγжщ½²€"
    texts = [" " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + [" don't", " we'll've", " 's", " a's'", " \n\nx"]
    ids, n = alignment.ByteTokens(alignment.tokenizer_path(alignment.TOKENIZER_A)).encode(texts)
    own = tokenizers[0].encode_batch(texts, add_special_tokens=False)
    assert n.tolist() == [len(e.ids) for e in own] and ids.tolist() == [i for e in own for i in e.ids]


def test_empty_and_clashing(spark, tmp_path):
    assert alignment.align(documents(spark, [])).count() == 0
    odd = documents(spark, [(1, "a b")]).selectExpr("*", "1 as key", "2 as row", "3 as rest", "4 as n_a", "5 as count")
    got = alignment.op11_alignment(spark, write_tables(tmp_path, documents=odd)).collect()
    assert [(r.doc_id, r.n_groups, r.count_sum) for r in got] == [(1, 2, 2)]
