"""Quality rules: fixed counts first, then the divergence of a text from its language.

References are histograms of each language of the table: of classes of characters, and of common words, which make up at
least one in COMMON of the language's words, so that there are at most COMMON of them. All documents that pass the base
rules count. A language needs at least one in LANGUAGES of all words to have a reference.

A text is compared with the references of its language, or with the nearest ones where it names none, by the
Jensen-Shannon distance (the root of the divergence, in bits, from 0 to 1). What is too short to be judged isn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import written
from tracemill.llm._text import Chunk, chunks, mix, stretch_hashes, words

COMMON = 1000
LANGUAGES = 200
LEAST_CHARS = 600  # code points of a text whose characters are judged
LEAST_WORDS = 100  # words of letters and digits of a text whose common words are judged
CHARS_FAR = 0.32
WORDS_FAR, CHANCE = 0.25, 2.5  # the limit for n words is WORDS_FAR + CHANCE / sqrt(n), as few words fall far from any histogram by chance
FLUSH = 1_000_000  # distinct words that a task counts at once
WINDOW = 5

#: Classes by the first byte of a character; bytes that go on with one (128 to 191) have none.
CLASSES = {"vowel": b"aeiou", "consonant": b"bcdfghjklmnpqrstvwxyz", "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\v\f\r", "newline": b"\n", "stop": b".,;:?", "quote": b"\"'()-", "exclaim": b"!", "symbol": b"#*$%&|<>", "latin": bytes(range(0xC2, 0xCA)), "letters": bytes(range(0xCA, 0xE0)), "wide": bytes(range(0xE0, 0xF8))}
OTHER = len(CLASSES)  # other signs and controls
KINDS = OTHER + 1
_CLASS = np.full(256, OTHER, np.int64)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v)] = _k
_CLASS[128:192] = KINDS

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(CLASSES["symbol"])] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _runs(c: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs within documents."""
    border = np.zeros(len(inside) + 1, bool)
    border[c.offs] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | border[:-1])), np.flatnonzero(inside & (~after | border[1:])) + 1


def _again(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values of documents, in order: which are equal to an earlier one, and which occur more than once."""
    by = np.lexsort((np.arange(len(doc)), value, doc))
    d, v = doc[by], value[by]
    same = np.zeros(len(d) + 1, bool)
    same[1:-1] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    earlier, often = np.zeros(len(d), bool), np.zeros(len(d), bool)
    earlier[by], often[by] = same[:-1], same[:-1] | same[1:]
    return earlier, often


def base_counts(c: Chunk) -> np.ndarray:
    """Document x BASE."""
    n = c.n
    count = lambda doc, w=None: np.bincount(doc, w, minlength=n).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(c.offs))
    inside = _WORD[c.data]
    start, end = _runs(c, inside)
    of = c.doc_of(start)
    chars = count(doc[inside & ((c.data & 0xC0) != 0x80)])
    line_start, line_end = _runs(c, c.data != 10)
    filled = np.concatenate(([0], np.cumsum(inside)))
    some = filled[line_end] > filled[line_start]
    line_start, line_end = line_start[some], line_end[some]
    line_of = c.doc_of(line_start)
    copies = count(line_of[_again(line_of, stretch_hashes(c.data, line_start, line_end))[0]])
    word = stretch_hashes(c.data, start, end)
    repeats = np.zeros(n, np.int64)
    if len(word) >= WINDOW:
        window = np.zeros(len(word) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window = mix(window * np.uint64(3) + word[k : k + len(window)])
        at = np.flatnonzero(of[WINDOW - 1 :] == of[: len(window)])
        found = at[_again(of[at], window[at])[1]]
        change = np.zeros(len(word) + 1, np.int64)
        np.add.at(change, found, 1)
        np.add.at(change, found + WINDOW, -1)
        repeats = count(of[np.cumsum(change)[:-1] > 0])
    return np.column_stack((count(of), chars, count(doc[_SYMBOL[c.data]]), copies, repeats))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def class_counts(c: Chunk) -> np.ndarray:
    """Document x KINDS: code points of each class."""
    doc = np.repeat(np.arange(c.n), np.diff(c.offs))
    return np.bincount(doc * (KINDS + 1) + _CLASS[c.data], minlength=c.n * (KINDS + 1)).reshape(c.n, -1)[:, :KINDS]


@dataclass
class References:
    """By language, in order of name: shares of classes; of common words, sorted by hash within a language, and what is left."""

    names: list[str]
    chars: np.ndarray  # language x KINDS
    first: np.ndarray  # of a language's words
    word: np.ndarray
    share: np.ndarray

    def rest(self, k: int) -> float:
        return max(0.0, 1.0 - float(self.share[self.first[k] : self.first[k + 1]].sum()))


def _term(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a value of shares p and q adds to the divergence."""
    m = (p + q) / 2
    half = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0) / 2
    return half(p) + half(q)


def distances(chars: np.ndarray, word_doc: np.ndarray, word: np.ndarray, refs: References, k: int, n: int) -> np.ndarray:
    """Distances of n documents from language k, of classes and of common words. word_doc: ascending."""
    p = chars / np.maximum(chars.sum(1), 1)[:, None]
    by_class = _term(p, refs.chars[k][None]).sum(1)
    own, share = refs.word[refs.first[k] : refs.first[k + 1]], refs.share[refs.first[k] : refs.first[k + 1]]
    total = np.bincount(word_doc, minlength=n)
    at = np.minimum(np.searchsorted(own, word), max(len(own) - 1, 0))
    hit = own[at] == word if len(own) else np.zeros(len(word), bool)
    width = max(len(own), 1)
    key, times = np.unique(word_doc[hit] * width + at[hit], return_counts=True)
    doc, which = key // width, key % width
    q = share[which] if len(own) else np.zeros(0)
    met = np.bincount(doc, _term(times / np.maximum(total, 1)[doc], q), minlength=n)
    unseen = share.sum() - np.bincount(doc, q, minlength=n)  # such words add half their share
    left = 1 - np.bincount(doc, times, minlength=n) / np.maximum(total, 1)
    by_word = met + np.maximum(unseen, 0) / 2 + _term(left, np.full(n, refs.rest(k)))
    return np.sqrt(np.clip(np.column_stack((by_class, by_word)), 0, 1))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, list]]:
    for c in chunks(batch.column(1)):
        yield c, batch.column(2).slice(c.first, c.n).to_pylist()


def references(rows: DataFrame) -> References:
    """Of the languages of rows (doc_id, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        seen: list[tuple[np.ndarray, ...]] = []
        size = 0

        def summed() -> tuple[np.ndarray, ...]:
            lang, kind, key, n = (np.concatenate(x) for x in zip(*seen, strict=True))
            by = np.lexsort((key, kind, lang))
            lang, kind, key, n = lang[by], kind[by], key[by], n[by]
            new = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))))
            return lang[new], kind[new], key[new], np.add.reduceat(n, new)

        def out() -> pa.RecordBatch:
            lang, kind, key, n = summed()
            known = pa.array(list(names), pa.string())
            return pa.RecordBatch.from_arrays([known.take(pa.array(lang)), pa.array(kind.astype(np.int32)), pa.array(key), pa.array(n)], ["lang", "kind", "key", "n"])

        for batch in batches:
            for c, langs in _rows(batch):
                code = np.array([-1 if x is None else names.setdefault(x, len(names)) for x in langs], np.int64)
                code[base_failed(base_counts(c))] = -1
                chars, w = class_counts(c), words(c)
                for k in np.unique(code[code >= 0]).tolist():
                    seen.append((np.full(KINDS, k), np.zeros(KINDS, np.int64), np.arange(KINDS), chars[code == k].sum(0)))
                use = code[w.doc] >= 0
                lang, key = code[w.doc[use]], w.hash[use].view(np.int64)
                by = np.lexsort((key, lang))
                lang, key = lang[by], key[by]
                if len(key):
                    new = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (key[1:] != key[:-1]))))
                    seen.append((lang[new], np.ones(len(new), np.int64), key[new], np.diff(np.append(new, len(key)))))
                    size += len(new)
                if size >= FLUSH:
                    seen = [summed()]
                    size = len(seen[0][0])
                    if size >= FLUSH // 2:
                        yield out()
                        seen, size, names = [], 0, {}
        if seen:
            yield out()

    counts = written(rows.mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    whole = totals.where("kind = 1").agg(F.sum("total")).first()[0] or 0
    large = written(totals.where(F.col("kind") == 1).where(F.col("total") * LANGUAGES >= whole).select("lang", "total"))  # at most LANGUAGES
    common = counts.join(F.broadcast(large), "lang").where((F.col("kind") == 0) | (F.col("n") * COMMON >= F.col("total")))
    found = common.select("lang", "kind", "key", "n", "total").toArrow()  # at most LANGUAGES * (COMMON + KINDS)
    lang, kind, key, n, total = (found.column(c).to_numpy() for c in found.column_names)
    names = sorted(set(lang.tolist()))
    chars, first, word, share = np.zeros((len(names), KINDS)), [0], [], []
    for k, name in enumerate(names):
        own = lang == name
        is_class = own & (kind == 0)
        chars[k, key[is_class]] = n[is_class]
        own &= kind == 1
        by = np.argsort(key[own].view(np.uint64))
        word.append(key[own][by].view(np.uint64))
        share.append((n[own] / total[own])[by])
        first.append(first[-1] + len(by))
    chars /= np.maximum(chars.sum(1), 1)[:, None]
    return References(names, chars, np.array(first), np.concatenate(word) if word else np.zeros(0, np.uint64), np.concatenate(share) if share else np.zeros(0))


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judged(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """doc_id and OUT for every row of docs. Distances are null where a text is too short, or its language has no reference."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    refs = references(rows)
    sent = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = sent.value
        number = {name: k for k, name in enumerate(refs.names)}
        for batch in batches:
            for c, langs in _rows(batch):
                counts, chars, w = base_counts(c), class_counts(c), words(c)
                code = np.array([-2 if x is None else number.get(x, -1) for x in langs], np.int64)
                far = np.full((c.n, 2), np.inf)
                for k in range(len(refs.names)):
                    own = np.flatnonzero((code == k) | (code == -2))
                    if len(own):
                        place = np.full(c.n, -1)
                        place[own] = np.arange(len(own))
                        use = place[w.doc] >= 0
                        far[own] = np.minimum(far[own], distances(chars[own], place[w.doc[use]], w.hash[use], refs, k, len(own)))
                far[chars.sum(1) < LEAST_CHARS, 0] = np.inf
                n = np.bincount(w.doc, minlength=c.n)
                far[n < LEAST_WORDS, 1] = np.inf
                failed = base_failed(counts)
                limit = np.column_stack((np.full(c.n, CHARS_FAR), WORDS_FAR + CHANCE / np.sqrt(np.maximum(n, 1))))
                unlike = ((far > limit) & (far < np.inf)).any(1)
                shown = [pa.array(far[:, k], mask=far[:, k] == np.inf) for k in range(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & ~unlike), *shown], ["doc_id", *(x.split()[0] for x in OUT.split(", "))])

    return rows.mapInArrow(run, f"doc_id long, {OUT}")


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every whole text of documents.

    A null or empty text has no words and fails. A text without a language is compared with the nearest
    references, one of a language too rare for a reference with none. Repeated rows give a row each and count as often in
    references; null ids stay. Texts of any length are read whole. A distance equal to its limit is kept. Columns beyond
    doc_id, text and lang, whatever their names, are ignored; an empty table gives no rows.
    """
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


def _sql() -> str:
    def pattern(values: bytes) -> str:
        if values[0] < 128:
            return "".join(f"\\x{b:02x}" for b in values)
        first, last = ((b & 0x1F) << 6 if b < 0xE0 else 0x800 for b in (values[0], values[-1]))
        return f"\\x{{{first:x}}}-\\x{{{last + 63 if last < 0x800 else 0x10FFFF:x}}}"

    def term(p: str, q: str) -> str:
        half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"({half(p)} + {half(q)}) / 2"

    space = r"\x20\x09-\x0D"
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '[{pattern(v)}]', '', 'g'))" for v in CLASSES.values())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, regexp_extract_all(t, '[^{space}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS l FROM d),
ws AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM s),
wn AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS k FROM ws WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM wn WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT i + x) AS n FROM rep CROSS JOIN range({WINDOW}) t(x) GROUP BY r),
b AS (
  SELECT d.r, doc_id, lang, t, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d JOIN s ON d.r = s.r LEFT JOIN cov ON cov.r = d.r
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
cl AS (SELECT r, lang, base_failed, length(t) AS chars, list_append(c, length(t) - list_sum(c)) AS c FROM (SELECT *, [{classes}] AS c FROM f)),
cu AS (SELECT r, lang, base_failed, chars, unnest(c) AS n, generate_subscripts(c, 1) AS kind FROM cl),
lw AS (SELECT r, lang, base_failed, unnest(regexp_extract_all(translate(t, '{upper}', '{lower}'), '[0-9a-z\x{{80}}-\x{{10ffff}}]+')) AS word FROM f),
tw AS (SELECT r, lang, base_failed, word, count(*) AS n FROM lw GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS total FROM tw WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang),
large AS (SELECT lang, total FROM lt WHERE total * {LANGUAGES} >= (SELECT sum(total) FROM lt)),
cw AS (SELECT lang, word, sum(n) / any_value(total) AS q FROM tw JOIN large USING (lang) WHERE NOT base_failed GROUP BY lang, word HAVING sum(n) * {COMMON} >= any_value(total)),
cq AS (SELECT lang, sum(q) AS sumq FROM large LEFT JOIN cw USING (lang) GROUP BY lang),
cc AS (SELECT lang, kind, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cu WHERE NOT base_failed AND lang IN (SELECT lang FROM large) GROUP BY lang, kind),
jc AS (SELECT r, cc.lang, sqrt(sum({term("p", "q")})) AS far FROM (SELECT *, n / chars AS p FROM cu WHERE chars >= {LEAST_CHARS}) x JOIN cc ON x.kind = cc.kind AND (x.lang IS NULL OR x.lang = cc.lang) GROUP BY r, cc.lang),
td AS (SELECT r, lang, sum(n) AS total FROM tw GROUP BY r, lang HAVING sum(n) >= {LEAST_WORDS}),
mw AS (SELECT td.r, cw.lang, sum({term("(tw.n / td.total)", "q")}) AS met, sum(q) AS seen, sum(tw.n) / any_value(td.total) AS hit FROM td JOIN tw ON tw.r = td.r JOIN cw ON cw.word = tw.word AND (td.lang IS NULL OR td.lang = cw.lang) GROUP BY td.r, cw.lang),
jw AS (SELECT r, lang, total, sqrt(met + greatest(sumq - seen, 0) / 2 + {term("(1 - hit)", "greatest(1 - sumq, 0)")}) AS far FROM (SELECT td.r, cq.lang, total, coalesce(met, 0) AS met, coalesce(seen, 0) AS seen, coalesce(hit, 0) AS hit, coalesce(sumq, 0) AS sumq FROM td JOIN cq ON td.lang IS NULL OR td.lang = cq.lang LEFT JOIN mw ON mw.r = td.r AND mw.lang = cq.lang)),
bad AS (SELECT r FROM jc GROUP BY r HAVING min(far) > {CHARS_FAR} UNION SELECT r FROM jw GROUP BY r, total HAVING min(far) > {WORDS_FAR} + {CHANCE} / sqrt(total))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f
"""


QUERIES = {"op13_rules": op13_rules}
ORACLES = {"op13_rules": _sql()}
