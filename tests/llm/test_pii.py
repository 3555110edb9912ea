import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, write_tables
from tracemill.llm import pii

PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def ok(kind, match):
    digits = re.sub(r"\D", "", match)
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != 3 or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(k, m[0]))


TEXTS = [
    None,
    "",
    "no data here",
    "é mail a.b@c.example.com, x@y, @z.w q@a.b.c@d.e f@-.-",
    "a@b@c.d a@b.@c.d ..%@x.y",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3 99999.1.1.1 0.0.0.0",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 or 411111111111111144444444",
    "tel +1 (974) 555-3436 and +1 and +12345678 and +123456789012345678 and +49 30 901820",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" then",
    "2024-01-15 10:30, version 2.0. CC BY-NC 4.0. chapter 12",
    "1" * 5000 + " " + "a" * 5000 + "@x",
    "é" * 10 + "a@b.co 9" + "\n+1 222 333 4444",
]


def test_base_spans():
    for t in TEXTS:
        assert pii.base_spans(t or "") == plain(t), t


def test_query(spark, tmp_path):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[5])]
    got = pii.op8_pii(spark, write_tables(tmp_path, documents=documents(spark, docs))).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain(TEXTS[5 if r.doc_id is None else r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    secret = next(r for r in got if r.doc_id == 8)
    assert secret.spans == "secret:9:49"
    assert next(r for r in got if r.doc_id == 9).spans == ""


@pytest.fixture(scope="module")
def model():
    return pii.train()


def found(texts, model):
    """Base and added spans of each text."""
    got = pii._spans_of(pa.array(texts, pa.string()), model)
    return [got[i][:2] if i in got else ([], []) for i in range(len(texts))]


def test_random_field_fits_its_table(model):
    texts, spans = zip(*map(pii.marked, pii.LABELLED), strict=True)
    right = sum(more == [x for x in want if not any(x[0] < f and s < x[2] for s, _, f in base)] for (base, more), want in zip(found(texts, model), spans, strict=True))
    assert right >= 0.95 * len(texts)


def best_path(model, rows):
    """The best tags of a sequence, token by token."""
    score, back = None, []
    for x in rows:
        step = model.move[:1] if score is None else score[:, None] + model.move
        back.append(step.argmax(0))
        score = step.max(0) + x
    tags = [] if score is None else [int(score.argmax())]
    for b in back[:0:-1]:
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(0)
    small = pii.CRF(rng.normal(size=(9, 3)), rng.normal(size=(3, 3)))
    n = np.array([1, 4, 0, 2, 700])
    scores, first = rng.normal(size=(n.sum(), 3)).astype(np.float32), np.cumsum(n) - n
    got = {int(i): t[: n[i]].tolist() for own, tags in small.viterbi(scores, first, n) for i, t in zip(own, tags, strict=True)}
    for i, k in enumerate(n):
        rows = scores[first[i] : first[i] + k]
        assert got[i] == best_path(small, rows)
        if 0 < k < 5:
            value = lambda p: sum(x[t] for x, t in zip(rows, p, strict=True)) + sum(small.move[a, b] for a, b in zip((0, *p), p, strict=False))  # noqa: B023, E731
            assert tuple(got[i]) == max(product(range(3), repeat=int(k)), key=value)


def test_likelihood_rises_by_exact_gradients():
    """Of two tags that features tell apart, training finds the rule."""
    f = np.array([[3] * 11, [5] * 11], np.int32)
    rows = [(f[[0, 1, 0]], np.array([0, 1, 0])), (f[[1, 0]], np.array([1, 0]))] * 3
    m = pii.train(rows, steps=40)
    assert best_path(m, m.emit[f[[0, 0, 1, 0]]].sum(1)) == [0, 0, 1, 0]


def test_redaction(spark):
    docs = documents(spark, [(1, "mail a@b.co now"), (2, "clean"), (3, None), (4, "+1 222 333 4444 4111111111111111")]).selectExpr("*", "1 as spans")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "mail [EMAIL] now" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean" and out[3].text is None
    assert not plain(out[4].text) and pii.redact(docs).columns == docs.columns
    cut = "card 4111111111111111 123.5.6.7"  # one number by its digits, until the address goes
    assert [k for _, k, _ in plain(cut)] == [1] and pii.clean_text(cut, plain(cut)) == "card [CARD] [IP]"


PLAIN = "The quick brown fox jumped over the lazy dog and went home at night to eat some bread with butter. "


def test_labelled_spans_in_long_texts(spark, tmp_path):
    """Every labelled span without a base span in it is found by the query and masked, also those without a digit or @."""
    docs, want = [], {}
    for line in pii.LABELLED:
        text, spans = pii.marked(line)
        if spans and not plain(text):
            want[len(docs)] = ",".join(f"{pii.KINDS[k]}:{30 * len(PLAIN) + a}:{30 * len(PLAIN) + b}" for a, k, b in spans)
            docs.append((len(docs), PLAIN * 30 + text + "\n" + PLAIN * 30))
    docs += [(1000, PLAIN * 60), (1001, "at"), (1002, "AT noon, look at the dot"), (1003, "écrire à info (AT) example (DOT) com é")]
    df = documents(spark, docs).selectExpr("*", "1 as spans", "2 as __text", "3 as n_email")
    got = {r.doc_id: r.spans for r in pii.op8_pii(spark, write_tables(tmp_path, documents=df)).collect()}
    missed = [docs[i][1].strip(PLAIN) for i, w in want.items() if got[i] != w]
    assert len(want) >= 20 and len(missed) <= 0.05 * len(want), missed
    spelled = [i for i in want if "@" not in docs[i][1] and not any(c.isdigit() for c in docs[i][1])]
    assert len(spelled) >= 10 and all(got[i] == want[i] for i in spelled)
    assert [got[i] for i in (1000, 1001, 1002, 1003)] == ["", "", "", "email:9:36"]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i in spelled:
        assert "[EMAIL]" in clean[i] and not pii._SPELLED.search(clean[i])


def test_values_it_was_not_trained_on(model):
    """Recall of spans whose values, and carriers, aren't in the table; and no span in clean text."""
    import random

    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    area = lambda: str(rng.randint(201, 989))
    name = lambda: rng.choice(["otto", "kira.bell", "sven_p", "ada", "noor", "team"])
    host = lambda: rng.choice(["harbour", "quartz", "lindenhof", "cafe"]) + rng.choice([" dot com", " dot org", " (dot) net"])
    makers = [
        lambda: ("phone", f"({area()}) {area()}-{digits(4)}"),
        lambda: ("phone", f"{area()}-{area()}-{digits(4)}"),
        lambda: ("email", f"{name()} at {host()}"),
        lambda: ("secret", "".join(rng.choice("0123456789abcdef") for _ in range(40))),
    ]
    carriers = {"phone": "You can ring {} at any time", "email": "please write to {} about it", "secret": 'a token = "{}" was left'}
    texts, want = [], []
    for _ in range(200):
        kind, value = rng.choice(makers)()
        before = PLAIN * rng.randint(0, 3)
        head = before + carriers[kind].split("{}")[0]
        texts.append(before + carriers[kind].format(value) + ". " + PLAIN)
        want.append((len(head), pii.KINDS.index(kind), len(head) + len(value)))
    got = found(texts, model)
    recall = np.mean([w in b + more for (b, more), w in zip(got, want, strict=True)])
    assert recall >= 0.9, [(t, g) for t, g, w in zip(texts, got, want, strict=True) if w not in g[0] + g[1]][:5]
    assert all(more == [] for _, more in found([PLAIN * k for k in range(1, 30)], model))


def test_long_stretches_are_not_cut(model):
    """In a list of numbers each is found wherever it lies, also across the ends of stretches; and in text without spaces."""
    numbers = [f"({200 + i % 700}) 555-{1000 + i}" for i in range(900)]
    text = "".join(f"phone: {x} or write\n" for x in numbers)
    ((_, got), (_, none)) = found([text, "x" * 300_000], model)
    assert [text[a:b] for a, _, b in got] == numbers and none == []
    first, n, low, high = pii.segments(np.repeat([0, 1, 3], [1, 700, pii.SEGMENT]))
    assert np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)]).tolist() == list(range(701 + pii.SEGMENT))
    assert (first <= low).all() and (first + n >= high).all() and n.max() <= pii.SEGMENT + 2 * pii.OVERLAP


def test_tokens_and_their_blocks():
    text = "It's “x_1” été-3, A\tBC 12 a1b2é"
    c = pii._chunk_of([text, "", "end"])
    t = pii.tokens(c)
    got = [c.data[a:b].tobytes().decode() for a, b in zip(t.start, t.end, strict=True)]
    assert got == ["It", "'", "s", "“", "x", "_", "1", "”", "été", "-", "3", ",", "A", "BC", "12", "a1b2é", "end"]
    assert t.doc.tolist() == [0] * 16 + [2] and t.glued.tolist()[:4] == [False, True, True, False]
    at = pii.code_points(c)
    assert [text[at[a] : at[b]] for a, b in zip(t.start[:-1], t.end[:-1], strict=True)] == got[:-1]
    whole = pii.features(t)
    assert (np.concatenate([pii.features(t, 0, 5), pii.features(t, 5)]) == whole).all()
