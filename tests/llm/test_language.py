"""Language of texts against a plain version and held-out documents."""

import math
import re
import zlib
from collections import Counter

import pytest

from lotline.llm import language
from lotline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, word string, n int, share double, score string"
PROSE = {
    "en": "the cat and the dog went with the other children through the woods while nothing was there",
    "de": "der hund und die katze gingen mit den anderen kindern durch den wald während nichts dort war",
    "fr": "le chien et le chat sont allés avec les autres enfants dans la forêt pendant que rien était là",
}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def rows():
    texts = [(words, lang) for lang, prose in PROSE.items() for words in (prose, prose[20:], prose[:40].upper())]
    out = [(i, *texts[i % len(texts)]) for i in range(60)]
    # Languages in unseen words, ties, no letter, NULL and empty texts, other scripts, repeats, NULL ids and labels.
    out += [
        (100, "woodsing othering", None), (101, "waldkindern gingenden", "de"), (102, "forêtaient", None), (103, "12 34 !!", "en"),
        (104, None, "fr"), (105, "", "de"), (106, "日本語", None), (107, "the the und", "en"), (107, "the the und", "en"),
        (None, "der wald", "de"), (108, "cat " * 30_000, None), (109, "x" * 30_000, None), (110, "l'été, naïve_wood²", "fr"),
    ]
    return out


def plain(table):
    """Scores by the formula, from dictionaries of counts."""
    tokens = {}
    for doc_id, text, lang in table:
        if doc_id is not None and text is not None and lang is not None and not held(doc_id):
            tokens.setdefault(lang, Counter()).update(re.findall(r"[^\W\d_²]+", text.lower()))
    langs = sorted(lang for lang, counts in tokens.items() if counts)
    known = {w for lang in langs for w, n in tokens[lang].items() if n >= 2}
    marked = {lang: [f"\x02{w}\x03" for w in tokens[lang]] for lang in langs}
    grams = {lang: Counter() for lang in langs}
    for lang in langs:
        for w in marked[lang]:
            grams[lang].update(w[i:j] for j in range(2, len(w) + 1) for i in range(max(0, j - 5), j))
    every = set().union(*grams.values())
    kinds = Counter(map(len, every))
    sums = {(lang, k): sum(n for g, n in grams[lang].items() if len(g) == k) for lang in langs for k in range(1, 6)}

    def word(w, lang):
        if w in known:
            n = tokens[lang][w] if tokens[lang][w] >= 2 else 0
            return math.log((n + 0.5) / (sum(tokens[lang].values()) + 0.5 * len(known)))
        m, parts = f"\x02{w}\x03", []
        for j in range(2, len(m) + 1):
            g = next((m[i:j] for i in range(max(0, j - 5), j) if m[i:j] in every), None)
            if g is not None:
                parts.append(math.log((grams[lang][g] + 0.5) / (sums[lang, len(g)] + 0.5 * kinds[len(g)])))
        return sum(parts) / len(parts) if parts else 0.0

    def predicted(text):
        words = re.findall(r"[^\W\d_²]+", (text or "").lower())
        if not words:
            return "und", 0.0
        totals = [sum(word(w, lang) * n for w, n in Counter(words).items()) for lang in langs]
        best = max(range(len(langs)), key=lambda i: (round(totals[i], 6), -i))
        odds = [math.exp((t - max(totals)) * min(len(words), 30) / len(words)) for t in totals]
        return langs[best], odds[best] / sum(odds)

    return [(i, i is not None and held(i), *predicted(text)) for i, text, _ in table]


def test_predictions_equal_the_formula(spark, frame):
    table = rows()
    docs = frame([(*row, "w", 1, 0.5, "s") for row in table], SCHEMA).repartition(3)
    got = sorted(map(tuple, language.language_of(docs).collect()), key=lambda r: (str(r[0]), r[2]))
    expected = sorted(plain(table), key=lambda r: (str(r[0]), r[2]))
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected], abs=2e-6)
    told = {r[0]: r[2] for r in got}
    assert [told[i] for i in (100, 101, 102, 103, 104, 105, 107)] == ["en", "de", "fr", "und", "und", "und", "en"]


def test_nothing_to_learn_from(spark, frame):
    docs = frame([(1, "some words", None, "w", 1, 0.5, "s"), (2, None, "en", "w", 1, 0.5, "s")], SCHEMA)
    assert {tuple(r)[2:] for r in language.language_of(docs).collect()} == {("und", 0.0)}
    assert language.language_of(docs.limit(0)).count() == 0


def test_small_tables_of_words_fall_back_on_characters(spark, frame, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 6)
    docs = frame([(*row, "w", 1, 0.5, "s") for row in rows()], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in language.language_of(docs).collect()}
    assert all(got[i] == lang for i, text, lang in rows() if i is not None and i < 60)


def test_query_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    wrong = [r for r in got if r.held_out and r.lang_pred not in (r.lang, "und")]
    assert len(got) == docs.count() and len(wrong) <= 0.01 * sum(r.held_out for r in got)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
