"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from lotline.llm import periodic
from lotline.llm.queries import QUERIES
from tests.conftest import SF_DIR


def brute(words, least=6, periods=4):
    """Every stretch of words that match those ``q`` later, longest first in periods."""
    n, runs = len(words), []
    for q in range(1, n // periods + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least, periods * q):
                if all(any(words[i] != words[i + p] for i in range(start, start + length - p)) for p in range(1, q)):
                    runs.append((start, length, q))
            start = end + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def told(doc_id, words):
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    hashes = (hashlib.sha256(text.encode()).hexdigest() for text in (lines, kept(words, runs)))
    return (doc_id, len(runs), *figures, *hashes)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=90) | st.text(alphabet="abcd", max_size=30), max_size=4))
def test_runs_equal_brute_force(texts):
    words = [list(text) for text in texts if text]
    ids = periodic.numbered([w.encode() for one in words for w in one])
    starts = np.cumsum([0, *map(len, words)])[:-1]
    got = [tuple(r) for r in periodic.find_runs(ids, starts.astype(np.int64)).tolist()]
    assert got == [(s + at, length, q) for at, one in zip(starts.tolist(), words) for s, length, q in brute(one)]


def test_nested_and_neighbouring_runs():
    draw = random.Random(5)
    for _ in range(150):
        words = []
        while len(words) < 250:
            root = [draw.choice("abc") for _ in range(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))]
            words += (root * draw.randrange(1, 9))[: draw.randrange(1, 9 * len(root))] * draw.choice([1, 1, 4])
        ids = periodic.numbered([w.encode() for w in words])
        got = [tuple(r) for r in periodic.find_runs(ids, np.zeros(1, np.int64)).tolist()]
        assert got == brute(words)


def test_one_long_run_is_told_once():
    for q in (1, 3, 700):
        ids = np.tile(np.arange(q), 200_000 // q)
        assert periodic.find_runs(ids, np.zeros(1, np.int64)).tolist() == [[0, len(ids), q]]


SCHEMA = "doc_id long, text string, runs int, collapsed int, best int, lang string"
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a b " * 9 + "c"), (4, "a b " * 9 + "c"), (None, "z " * 7), (5, "no run here"),
    (6, "la\x1cla x " * 5 + "\x0b\x0c\r end"), (7, "word " * 60_000), (8, "x" * 100_000), (10, "p q r s t u v w x y z " * 3),
    (31, "one two three four five six seven eight nine ten"), (40, "k l m " * 30 + "n " * 5), (49, "é " * 6 + "日本 語 " * 8),
]


def test_query_on_odd_rows(spark, frame):
    docs = frame([(*row, 1, 2, 3, "en") for row in ROWS], SCHEMA).repartition(3)
    got = periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(docs)))

    def small(row):  # the brute force is quadratic
        return len(row[1] or "") < 2000

    expected = sorted(map(str, (told(i, planted(i, t)) for i, t in filter(small, ROWS))))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(str(r) for r in rows if r[0] not in (7, 8)) == expected
    assert [r[1:6] for r in rows if r[0] == 7] == [(1, 0, 60_000, 1, 60_000_000)]
    assert [r[1:3] for r in rows if r[0] == 8] == [(0, None)]
    assert periodic.digests(periodic.periodic_runs(docs.limit(0))).count() == 0


def test_query_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(map(str, (told(r.doc_id, planted(r.doc_id, r.text)) for r in docs)))
    got = QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()
    assert sorted(str(tuple(r)) for r in got) == expected
    assert sum(r.n_runs > 0 for r in got) > len(got) // 20
