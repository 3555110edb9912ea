import re

import numpy as np
import pyarrow as pa
from tracemill.llm import _text
from tracemill.llm.packing import WordIds, tokenizer_path


def test_words_match_the_pattern():
    texts = ["Hello, World! x", None, "", "é1-b\x00ç \U0001f600z", "  ", "A" * 50]
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for most in (1, 8, 1 << 20):
        seen = {}
        for c in _text.chunks(pa.array(texts), most):
            w = _text.words(c)
            low = _text.LOWER[c.data].tobytes()
            for s, e, d in zip(w.start, w.end, w.doc, strict=True):
                seen.setdefault(c.first + int(d), []).append(low[s:e].decode())
        for i, t in enumerate(texts):
            lowered = (t or "").translate({k: k + 32 for k in range(65, 91)})
            assert seen.get(i, []) == pattern.findall(lowered)


def test_equal_words_have_equal_hashes():
    (c,) = _text.chunks(pa.array(["one two one", "x ONE", "two"]))
    w = _text.words(c, prefixes=(2,))
    h = w.hash
    assert h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3
    assert w.prefix[0, 0] == w.prefix[2, 0] and w.prefix[3, 0] == 0


def test_ranges():
    who, value = _text.ranges(np.array([5, 0, 9]), np.array([2, 0, 3]))
    assert who.tolist() == [0, 0, 2, 2, 2] and value.tolist() == [5, 6, 9, 10, 11]


def test_word_ids_are_the_tokenizers():
    import random

    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(tokenizer_path()), WordIds(tokenizer_path())
    rng = random.Random(5)
    signs = "aZé É ß×÷ ñ…'\"`!%$.,|<>19 \t\ń  日本語İΣς\x00\x1c\U0001f600-_"
    texts = ["", "  ", "don't won't", "<|startoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|> a", "'s 'S", "a'b'll", "1.5e3", "hello,World!!%%%"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    for t, ids in zip(texts, ours.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_slices_are_the_batches_rows():
    batches = [pa.RecordBatch.from_pydict({"t": [f"text {i}" * (i % 3) if i % 7 else None for i in range(n)]}) for n in (0, 5, 23)]
    parts = list(_text.slices(iter(batches), 4))
    assert [p.num_rows for p in parts] == [4, 1, 4, 4, 4, 4, 4, 3]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
    for p in parts:
        assert [c.text(i).decode() for c in _text.chunks(p.column(0)) for i in range(c.n)] == [x or "" for x in p.column(0).to_pylist()]


def test_tables_are_kept_until_another_operator_begins():
    made = []
    make = lambda: made.append(1) or object()
    first = _text.kept("a", make)
    assert _text.kept("a", make) is first and len(made) == 1
    list(_text.slices(iter(())))
    assert _text.kept("a", make) is not first and len(made) == 2
    _text.kept("b", make)
    _text.kept("a", make)
    assert len(made) == 4
