"""Encoders, files and quality operators against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from lotline.llm import bpe, divergence, mixing, quality, simple8b, textstats, token_files, toxicity
from lotline.llm.queries import MIX_WEIGHTS, QUERIES
from lotline.sources.snapshots import scratch_dir
from tests.conftest import SF_DIR

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")

# NULL and empty texts, repeated rows, ties, odd white space, a very long word and a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t  "),
    (4, "the cat  sat\n \non the   mat, didn't it?"),
    (4, "the cat  sat\n \non the   mat, didn't it?"),
    (None, "no id"),
    (6, "x" * 3000),
    (7, "é́日本語\x1c\x1d ÀB <|endoftext|> 12345!!! \x00 ok"),
    (8, "wort, " * 4000),
]
# Extra columns with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, score double, ids string, x int, key string, source string"


def odd_docs(frame):
    return frame([(i, text, None, 1.0, "a", 3, "k", None) for i, text in ODD], SCHEMA)


def oracle():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.just(0), max_size=700))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    assert (simple8b.decode(simple8b.encode(ids)) == ids).all()


def test_simple8b_packs_runs_and_refuses_other_bytes():
    assert len(simple8b.encode(np.zeros(1200, np.uint64))) == simple8b.HEADER.size + 10 * 8
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 16)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the\n\t'sé1! \x1c "), max_size=80))
def test_bpe_equals_tiktoken(text):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    (ids,) = codec.encode([text])
    assert ids.tolist() == oracle().encode_ordinary(text)
    assert codec.decode(ids.tolist()) == text.encode()


def test_bpe_long_piece_and_many_pieces():
    codec, random_ = bpe.codec(RANKS, public_tokenizers.PATTERN), random.Random(3)
    words = ["".join(random_.choice("etaoinshré") for _ in range(random_.randrange(1, 40))) for _ in range(3000)]
    texts = ["q" + "ab" * 4000, " ".join(words)]
    assert [ids.tolist() for ids in codec.encode(texts)] == oracle().encode_ordinary_batch(texts)


def test_bpe_operators_on_odd_rows(spark, frame):
    docs, enc = odd_docs(frame), oracle()
    expected = sorted(
        (str(i), len(ids := enc.encode_ordinary(text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256((text or "").encode()).hexdigest())
        for i, text in ODD
    )
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((t or "").encode() for _, t in ODD)
    assert all(r.decodes for r in bpe.tokens(docs, RANKS, public_tokenizers.PATTERN).collect())
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files_equal_the_library(spark, frame):
    path = scratch_dir(spark, "tokens")
    token_files.write_token_files(odd_docs(frame), path, WORDS, block_ids=500, files=3)
    tokenizer, start, expected = Tokenizer.from_file(WORDS), 0, []
    for i, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read_token_index(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected
    ids = {r.doc_id: r.ids for r in token_files.read_token_ids(spark, path).collect()}
    assert ids[6][-1] == 1 and len(ids[8]) == 8001
    empty = scratch_dir(spark, "tokens")
    token_files.write_token_files(odd_docs(frame).limit(0), empty, WORDS)
    assert token_files.read_token_index(spark, empty).count() == 0


def test_token_files_query_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts):
        n = len(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids) + 1
        assert (got[i].start, got[i].n_tokens) == (start, n)
        start += n


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def test_quality_rules_count_as_told(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        counts = plain_counts(text) if len(text) < 6000 else None
        row = got[doc_id]
        if counts:
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert not (row.base_failed and row.kept)


def test_quality_rules_on_odd_rows(frame):
    got = divergence.quality_rules(odd_docs(frame)).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got if r.doc_id in (1, 2, 3, 6))
    assert divergence.quality_rules(odd_docs(frame).limit(0)).count() == 0


def test_other_languages_are_not_held_against_the_listed(frame):
    rng = random.Random(8)
    forms = {
        "en": [*divergence.COMMON_WORDS["en"].split(), "house", "river", "morning", "letter"],
        "ru": "дом река утро письмо город человек время слово дело жизнь день рука работа место вопрос лицо друг".split(),
        "el": "σπίτι ποτάμι πρωί γράμμα πόλη άνθρωπος χρόνος λέξη ζωή ημέρα χέρι δουλειά τόπος πρόσωπο φίλος".split(),
    }
    langs = ["en"] * 30 + ["ru"] * 30 + ["el"] * 3
    rows = [(i, " ".join(rng.choice(forms[lang]) for _ in range(200)) + ".", lang) for i, lang in enumerate(langs)]
    junk = " ".join(str(rng.randrange(10**9)) + "#$%" for _ in range(100))
    rows += [(100, junk, "en"), (101, junk, "ru"), (102, junk, None)]
    got = {r.doc_id: r for r in divergence.quality_rules(frame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(len(langs)))
    assert 0 < got[30].class_distance < divergence.MAX_CLASS_DISTANCE and got[30].word_distance == 0
    assert not any(got[i].kept or got[i].base_failed for i in (100, 101, 102))


def test_divergence_is_the_jensen_shannon_distance():
    p, q = np.array([3.0, 1.0, 0.0]), np.array([1.0, 1.0, 2.0])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m) if v)
    assert divergence.distances(p[None], q[None])[0] == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert divergence.distances(np.zeros((1, 3)), q[None])[0] == 0


@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeated_words(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    assert textstats.repeated_words([w.encode() for w in words]) == len(covered)


def held_out_table(spark, name, label):
    scores = QUERIES[name](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scores.join(labels, "doc_id").filter("held_out").select(label, "predicted", "score").collect()
    assert scores.count() == 1000 and all(0 <= r.score <= 1 for r in rows)
    return rows


def test_quality_classifier_on_held_out_documents(spark):
    rows = held_out_table(spark, "op1_quality_classifier", "quality")
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95
    good = [r for r in rows if r.quality]
    assert sum(r.predicted for r in good) > 0.98 * len(good)


def test_toxicity_on_held_out_documents(spark):
    rows = held_out_table(spark, "op4_toxicity", "toxic")
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.6
    assert sum(r.predicted for r in rows if not r.toxic) <= 1


def test_machine_adds_products_over_all_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(rng.normal(size=1 + 5 * (1 + toxicity.FACTORS)))
    texts = [[0, 2, 4], [], [3], [0, 1, 2, 3, 4]]
    ids, row = np.array(sum(texts, [])), np.repeat(np.arange(4), [len(t) for t in texts])
    for got, text in zip(machine.raw(ids, row, 4)[0], texts):
        pairs = sum(machine.vectors[a] @ machine.vectors[b] for a in text for b in text if a < b)
        assert got == pytest.approx(machine.constant + sum(machine.linear[a] for a in text) + pairs)


def test_isotonic_pools():
    assert quality.isotonic([(0, 1, 0.0), (1, 1, 1.0), (2, 1, 0.0), (3, 2, 2.0)]) == ([0, 1.5, 3], [0, 0.5, 1])


def test_classifiers_on_odd_rows(frame):
    docs = odd_docs(frame)
    labels = frame([(i, q, q) for i, q in ((4, 1), (7, 0), (8, None), (None, 1))], "doc_id long, quality int, toxic int")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert scores(docs, labels).count() == len(ODD)
        assert {r.score for r in scores(docs, labels.limit(0)).collect()} == {0.5}
        assert scores(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels.limit(0)).columns == docs.columns


def test_machine_gradient_is_the_slope_of_the_loss():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    values = rng.normal(size=1 + 3 * (1 + toxicity.FACTORS))
    active, y = [[0, 2], [1], [], [0, 1, 2]], [1.0, 0.0, 0.0, 1.0]
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array(active, pa.list_(pa.int32()))], names=["y", "active"])

    def loss(v):
        machine = toxicity.Machine(v)
        ids, row = toxicity._flat(batch.column(1))
        p = toxicity._sigmoid(machine.raw(ids, row, 4)[0])
        return -sum(math.log(q if t else 1 - q) for q, t in zip(p, y))

    (out,) = toxicity.gradient_sums(iter([batch]), values.tobytes())
    slope = np.frombuffer(out.column(0)[0].as_py())[:-1]
    for i in range(len(values)):
        step = np.zeros_like(values)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((loss(values + step) - loss(values - step)) / 2e-5, abs=1e-4)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_DIR)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and all(r.decodes for r in rows)
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").collect()}
    copies = {r.doc_id for r in QUERIES["op8_ngram_join"](spark, SF_DIR).filter("not kept").collect()}
    lost = good - copies - {r.doc_id for r in rows}
    assert len(lost) <= 0.05 * len(good)


def test_pipeline_tells_the_mixed_stream(spark, frame):
    rows = [(i // 2 if i < 40 else i, f"text {i}", None, f"src{i % 3}" if i % 9 else None, 7) for i in range(400)]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    stages = dict(corpus_pipeline.STAGES)
    stream = mixing.mix(docs, MIX_WEIGHTS, keep=tuple(docs.columns)).orderBy("slot", "place").collect()
    ordered = stages["mixing"](spark, docs, SF_DIR).repartition(5)  # as stored files come back
    got = stages["tokens"](spark, ordered, SF_DIR).orderBy("slot", "place").collect()
    tool = oracle()
    assert [(r.doc_id, r.slot, r.place, r.share, tool.decode(r.ids)) for r in got] == [
        (r.doc_id, r.slot, r.place, r.share, r.text) for r in stream
    ]


def test_the_mixing_stage_decides_the_stream(spark, frame, monkeypatch):
    rows = [(i, f"text {i}", None, f"src{i % 3}" if i % 9 else None, 7) for i in range(200)]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages, weights = dict(corpus_pipeline.STAGES), {"src0": 1, "src1": 3, mixing.REST: 2}

    def places(table):
        return {r.doc_id: (r.slot, r.share, r.place) for r in stages["tokens"](spark, table, SF_DIR).collect()}

    with monkeypatch.context() as other:
        other.setattr(corpus_pipeline, "MIX_WEIGHTS", weights)
        path = scratch_dir(spark, "mixed")
        stages["mixing"](spark, docs, SF_DIR).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.columns == docs.columns and sorted(stored.collect()) == sorted(docs.collect())
    stream = {r.doc_id: (r.slot, r.share, r.place) for r in mixing.mix(docs, weights).collect()}
    assert places(stored) == stream
    again = stages["mixing"](spark, stored, SF_DIR)  # the last schedule counts
    assert places(again) == {r.doc_id: (r.slot, r.share, r.place) for r in mixing.mix(docs, MIX_WEIGHTS).collect()}
    assert places(docs) == dict.fromkeys(stream, (None, None, None))  # the stage left out


def test_schedule_stays_with_the_source_column(frame):
    docs = frame([(1, "a")], "doc_id long, source string").withMetadata("source", {"note": "kept"})
    assert mixing.schedule_of(docs) is None
    handed = mixing.with_schedule(docs, {"a": 3, mixing.REST: 2}, block_docs=4)
    assert handed.columns == docs.columns and handed.schema["source"].metadata["note"] == "kept"
    assert mixing.schedule_of(handed.repartition(3).filter("doc_id = 1")) == {"weights": {"a": 3, mixing.REST: 2}, "block_docs": 4}


def test_one_row_of_each_group_stays(spark, frame):
    words = [f"w{i}" for i in range(60)]
    text, near, own = " ".join(words), " ".join([*words[:-1], "end"]), "a text of its own"
    third = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (2, near), (2, own), (3, third), (3, third), (None, near), (None, "no id"), (None, "no id"), (4, ""), (4, "")]
    docs = frame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF_DIR)
    assert out.columns == docs.columns
    assert sorted((r.n_chars, r.text) for r in out.collect()) == [(k, rows[k][1]) for k in (0, 2, 3, 6, 8, 9)]


def test_stages_on_odd_rows(spark, frame):
    docs = frame([(i, text, None, None, 0, "extra") for i, text in ODD], "doc_id long, text string, lang string, source string, n_chars long, key string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
        out = stage(spark, docs, SF_DIR)
        assert out.count() <= len(ODD)
        assert name == "tokens" or out.columns == docs.columns
