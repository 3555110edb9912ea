import hashlib

import numpy as np
import pytest
from helpers import write_tables
from pyspark.sql import functions as F
from tracemill.llm import neighbours, urls, warc


def test_arc_to_warc():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\n\nx 1 2 3 text/html 5\n"
    records = [warc.ArcRecord("http://a.example/b c", "20010203040506", "text/html", body), warc.ArcRecord("dns:a.example", "20010203040506", "text/dns", b"1.2.3.4"), warc.ArcRecord("ftp://x/", "2001", "text/plain", b"")]
    for version in (1, 2):
        back = list(warc.parse_arc(warc.arc_file(records, version)))
        assert [(r.url, r.body) for r in back[1:]] == [(r.url, r.body) for r in records]
        info, page, dns, ftp = map(warc.to_warc, back)
        assert [w.headers["WARC-Type"] for w in (info, page, dns, ftp)] == ["warcinfo", "response", "resource", "resource"]
        assert page.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and ftp.headers["WARC-Date"] == "2001-01-01T00:00:00Z"
        payload = b"<html>\n\nx 1 2 3 text/html 5\n"
        assert page.headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        again = list(warc.parse_warc(b"".join(map(bytes, (info, page, dns, ftp)))))
        assert [w.block for w in again[1:]] == [r.body for r in records]
    for bad in (b"http://x\n", warc.arc_file(records, 1)[:-60], b"filedesc://x 0 0 t 4\n9 0 x\n"):
        with pytest.raises(warc.ArchiveError):
            list(warc.parse_arc(bad))


def test_convert_files(spark, tmp_path):
    import gzip

    data = warc.arc_file([warc.ArcRecord("http://a.example/", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\xff")], 2)
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(data))
    rows = warc.convert_files(spark, str(tmp_path)).orderBy("number").collect()
    assert [r.headers["WARC-Type"] for r in rows] == ["warcinfo", "response"] and rows[1].block.endswith(b"hi\xff")
    warc.write_records(warc.convert_files(spark, str(tmp_path)), str(tmp_path / "out"))
    back = [w for f in sorted((tmp_path / "out").glob("*.gz")) for w in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    assert [w.block for w in back] == [bytes(r.block) for r in rows]
    assert [{k: v for k, v in w.headers.items() if k != "Content-Length"} for w in back] == [r.headers for r in rows]


def test_pages_round_trip(spark, tmp_path):
    long, nasty = "é" * 60, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (3, "http://b", long), (None, "http://n", long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u\nv", "short"), (7, "u", nasty), (8, "u", nasty), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.op5_warc(spark, write_tables(tmp_path, pages=pages)).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and least[h] != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[h] if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    empty = write_tables(tmp_path / "none", pages=pages.limit(0))
    assert warc.op5_warc(spark, empty).count() == 0


def test_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 60)
    monkeypatch.setattr(neighbours, "LEAF_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[100:400] = x[100]  # a third of all rows are alike
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] + [1.0] * 5), (1060, [None] + [1.0] * 5), (1080, [float("inf")] * 6), (1100, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("clash"))
    got = neighbours.op4_neighbours(spark, write_tables(tmp_path, embeddings=df)).toPandas()
    d = x.astype(np.float64)
    found, total = 0, 0
    assert sorted(got.query_id.unique()) == list(range(0, 900, 20))
    for q, g in got.groupby("query_id"):
        s = (d * d[q]).sum(1)
        ids = np.array([i for i in np.lexsort((np.arange(900), -s)) if i != q])
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in g.vec_id.tolist()
        assert np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-12)
        assert g.vec_id.tolist() == sorted(g.vec_id, key=lambda i: (-s[i], i))
        found += len(set(ids[:20]) & set(g.vec_id))
        total += 20
    assert found >= 0.9 * total
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.search(few.limit(0), F.lit(True)).count() == 0


def test_leaves_of_few_vectors(spark, monkeypatch):
    """A query goes on until it has seen 20 others, though calibration asks for fewer leaves than hold them."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 4)
    monkeypatch.setattr(neighbours, "LEAST_SAMPLE", 6)
    monkeypatch.setattr(neighbours, "_calibrated", lambda *a: 1)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert len(got) == 10 and all(r["count"] == 20 for r in got)


def test_joins_of_hot_keys(spark):
    from tracemill.llm import _shared

    rows = spark.range(2000).selectExpr("case when id % 3 = 0 then 7 when id % 50 = 1 then null else id end as k", "id")
    table = _shared.written(spark.range(5, 1000).selectExpr("id as k", "id * 2 as v"))
    for how in ("inner", "left", "left_anti"):
        want = sorted(map(str, rows.join(table, "k", how).collect()))
        assert sorted(map(str, _shared.joined(rows, table, "k", how).collect())) == want
        _shared.HOT_ROWS, hot = 40, _shared.HOT_ROWS
        try:
            assert sorted(map(str, _shared.joined(rows, table, "k", how, most=10).collect())) == want
        finally:
            _shared.HOT_ROWS = hot


URLS = [
    None,
    "",
    "no scheme",
    "http://A.Example.ORG/es/1?x=/en/1",
    "https://example.org/en/12",
    "https://notexample.org/en/12#a",
    "http://x.org",
    "http://x.com/fr/1",
    "http://x.com/de/?q",
    "ftp://com/de/",
    "http://x.net?a/b#c",
    "a://b://c/d",
    "http://É.COM/fr/é\n/x#",
    "http://host/" + "p/" * 3000,
]


def test_urls(spark, tmp_path):
    rows = list(enumerate(URLS)) + [(1, URLS[1]), (None, URLS[3])] + [(100 + i, f"https://s{i % 3}.net/es/{i}") for i in range(60)] + [(200 + i, f"https://s.example.org/es/{i}") for i in range(60)]
    got = urls.op10_urls(spark, write_tables(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("x")))).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    text[None] = URLS[3]
    for r in got:
        u, host, path, best = text[r.page_id] or "", "", "", None
        if "://" in u:
            rest = u.split("://", 1)[1]
            k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, rest = rest[:k].translate({c: c + 32 for c in range(65, 91)}), rest[k:]
            path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        for v, h, p in urls.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
                best = (v, h + p)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert {r.verdict for r in got if r.page_id is not None and 100 <= r.page_id < 160} == {"block"}  # mined: es is blocked
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_that_differ_late(spark):
    """Third segments, third parameters and fifth labels of hosts make rules, also in URLs of very many tokens."""
    deep = "/".join(f"s{chr(97 + i)}" for i in range(25))
    ends = [("example.org", "{k}/y/z/{w}"), ("example.org", "{k}/?a=1&b=2&{w}=3"), ("{w}.b.c.d.e.example.org", "{k}/"), ("example.org", f"{{k}}/{deep}/{{w}}")]
    rows, want = [], {}
    for j, (host, rest) in enumerate(ends):
        for i in range(200):
            bad = i % 2
            host_, rest_ = (x.format(k=("es" if bad else "x"), w=("bad" if bad else "good") + "abcd"[j]) for x in (host, rest))
            other, late = host_.replace("example.org", "other.net"), rest_.replace("es", "q", 1) if bad else rest_.replace("x", "q", 1)
            rows += [(len(rows), f"http://{host_}/{rest_}"), (len(rows) + 1, f"http://{other}/{late}")]
            want[len(rows) - 1] = "block" if bad else "allow"
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {i: got[i] for i in want} == want
    flags = urls.host_and_path(F.col("url"))
    (r,) = spark.createDataFrame([("http://a.b.c.d.e.f/1/g/h/i?j=1&k&l=2",)], "url string").select(urls.tokens(F.col("url"), *flags).alias("t")).collect()
    assert {"host:a", "path:i", "query:l"} <= set(r.t)


def test_mined_rules_against_every_token_set(spark):
    """Rules and verdicts of a miner that tries all sets of tokens."""
    import math
    import random
    from itertools import combinations

    rng = random.Random(7)
    pool = [f"t{i}" for i in range(7)]
    more = [f"u{i}" for i in range(16)]  # on all rows: they change no rule but their own
    rows = []
    for k in range(300):
        t = sorted(rng.sample(pool, rng.randint(1, 5)))
        bad = ("t0" in t and "t1" in t) or "t2" in t and rng.random() < 0.97
        rows.append((k, ",".join(t), t, "block" if bad else "allow"))
    df = spark.createDataFrame([(str(k), [*t, *more], v) for k, _, t, v in rows], "key string, tokens array<string>, verdict string")
    got = {(tuple(r.antecedent), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in urls.mined(df)[0].collect()}
    least = max(1, math.ceil(urls.SUPPORT * len(rows)))
    every = {}
    for size in range(1, 6):
        for a in combinations(pool, size):
            fit = [v for _, _, t, v in rows if set(a) <= set(t)]
            for v in ("allow", "block"):
                if fit.count(v) >= least and fit.count(v) / len(fit) >= urls.CONFIDENCE:
                    every[a, v] = (round(fit.count(v) / len(fit), 9), round(fit.count(v) / len(rows), 9))
    want = {(a, v): x for (a, v), x in every.items() if len(a) == 1 or not any((b, v) in every and every[b, v][0] >= x[0] for b in combinations(a, len(a) - 1))}
    assert got == want and len(want) > 5
    sets = df.select("key", "tokens")
    verdicts = {r.key: r.mined for r in urls.decided(sets, *urls.mined(df)).collect()}
    for k, _, t, _ in rows:
        fits = [((c, s, len(a), " ".join(a)), v) for (a, v), (c, s) in want.items() if set(a) <= set(t)]
        assert verdicts.get(str(k)) == (max(fits)[1] if fits else None)


def test_tokens_that_tell_only_together(spark):
    """Two tokens of a path decide together, whatever else URLs hold: segments that all have, pairs that go together, others that tell nothing."""
    rows = []
    for i in range(800):
        a, b = i & 1, i >> 1 & 1
        same = [f"c{k}" for k in range(14)]
        couple = [f"d{k}{i >> 2 & 1}" for k in range(7)]
        noise = [f"e{k}{i >> (3 + k) & 1}" for k in range(4)]
        rows.append((i, [f"a{a}", f"b{b}", *same, *couple, *noise], "block" if a ^ b else "allow"))
    df = spark.createDataFrame([(str(i), t, v) for i, t, v in rows], "key string, tokens array<string>, verdict string")
    rules, alike = urls.mined(df)
    got = {(tuple(r.antecedent), r.verdict) for r in rules.collect()}
    assert got == {(("a0", "b0"), "allow"), (("a1", "b1"), "allow"), (("a0", "b1"), "block"), (("a1", "b0"), "block")}
    assert {r.standing for r in alike.collect()} == {"c0", "d00", "d01"}
    # A token that stands for others is met where one of these is.
    want = spark.createDataFrame([("x", ["a0", "b1", "zz"]), ("y", ["b0"])], "key string, tokens array<string>")
    assert {r.key: r.mined for r in urls.decided(want, rules, alike).collect()} == {"x": "block"}


def test_rows_that_repeat_an_id(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.search(few, F.col("vec_id") == 20).collect())
    assert got == sorted([(20, 1, 20, 1.0), (20, 2, 1, 0.5), (20, 3, 2, 0.25)] * 2)
