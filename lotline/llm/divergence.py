"""Quality rules: divergence of a document from references of its languages.

Two histograms of each document, of character classes and of common words, are held
against those of the languages by the Jensen-Shannon distance. The references are sums
over all documents of a language that are long enough, so no list of norms is needed.
A document fails when its distance to the nearest language is too large; documents
below a minimum length are not judged by a histogram they cannot fill. Languages without
a word list have a reference of classes only, which their own documents are held against
besides; a histogram for which the language of a document has no reference does not judge it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.llm import textstats
from lotline.llm.common import batch_task, stored, texts_of

# Frequent function words of the languages judged.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with be this from at or by an not have has which had but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass sie",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec elle",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o",
}
WORDS = sorted({word.encode() for words in COMMON_WORDS.values() for word in words.split()})
SHOWN = {form: i for i, word in enumerate(WORDS) for form in (word, word.decode().capitalize().encode())}

MIN_WORDS, MAX_REPEATED = 20, 30  # words at least; percent of words in repeated windows at most
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 150
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.33
MIN_REFERENCE_DOCS = 20  # long documents of a language without word list that has a reference

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
N_BINS = textstats.CLASSES + len(WORDS) + 1


def profile(text: str) -> tuple[list[int], np.ndarray]:
    """Counts of a text and its two histograms in a row, that of words closed by all other words."""
    data = text.encode("utf-8")
    words = data.split()
    bins = np.zeros(N_BINS, np.float32)
    classes = textstats.class_counts(data)
    bins[: textstats.CLASSES] = classes
    common = 0
    for word in words:
        at = SHOWN.get(word)
        if at is not None:
            bins[textstats.CLASSES + at] += 1
            common += 1
    bins[-1] = len(words) - common
    counts = [
        len(words),
        len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))),
        sum(data.count(symbol) for symbol in textstats.SYMBOLS),
        textstats.repeated_lines(data),
        textstats.repeated_words(words),
    ]
    return counts, bins


def profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [profile(text) for text in batch.column(1).to_pylist()]
        counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
        bins = np.array([b for _, b in found], dtype=np.float32).reshape(-1)
        ends = np.arange(0, len(bins) + 1, N_BINS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                *(pa.array(counts[:, i]) for i in range(len(COUNTS))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(bins)),
            ],
            names=["doc_id", "lang", *COUNTS, "bins"],
        )


def distances(bins: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of each row to its nearest reference; 0 without references or counts."""
    totals = bins.sum(axis=1, keepdims=True)
    p = np.divide(bins, totals, out=np.zeros_like(bins), where=totals > 0)
    nearest = np.full(len(bins), np.inf)
    for q in references / references.sum(axis=1, keepdims=True):
        middle = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=1)
            right = np.where(q > 0, q * np.log2(q / middle), 0).sum(axis=1)
        nearest = np.minimum(nearest, np.sqrt(np.clip((left + right) / 2, 0, 1)))
    return np.where((totals[:, 0] > 0) & np.isfinite(nearest), nearest, 0.0)


def nearest(
    bins: np.ndarray, langs: list[str | None], references: list[tuple[str, list[float]]]
) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to the nearest reference of classes and of words; 0 where a language has none."""
    named = [lang for lang, _ in references]
    reference = np.array([sums for _, sums in references], dtype=np.float64).reshape(-1, N_BINS)
    listed = np.array([lang in COMMON_WORDS for lang in named], bool)
    cut = textstats.CLASSES
    by_class, by_word = np.zeros(len(bins)), np.zeros(len(bins))
    group = [lang if lang not in COMMON_WORDS else "" for lang in langs]  # all listed languages are judged alike
    for lang in set(group):
        rows = np.flatnonzero([one == lang for one in group])
        if lang is None or lang == "" or lang in named:
            held = listed | np.array([lang is None or one == lang for one in named], bool)
            by_class[rows] = distances(bins[rows, :cut], reference[held, :cut])
        if lang is None or lang == "":
            by_word[rows] = distances(bins[rows, cut:], reference[listed, cut:])
    return by_class, by_word


def judge_batches(
    batches: Iterator[pa.RecordBatch], references: list[tuple[str, list[float]]]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins = np.asarray(batch.column("bins").flatten()).astype(np.float64).reshape(-1, N_BINS)
        counts = [batch.column(name) for name in COUNTS]
        n_words, word_chars, n_repeat = (np.asarray(counts[i]) for i in (0, 1, 4))
        by_class, by_word = nearest(bins, batch.column("lang").to_pylist(), references)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)
        strange = (word_chars >= MIN_CHARS_JUDGED) & (by_class > MAX_CLASS_DISTANCE)
        strange |= (n_words >= MIN_WORDS_JUDGED) & (by_word > MAX_WORD_DISTANCE)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *counts,
                pa.array(failed),
                pa.array(~failed & ~strange),
                pa.array(by_class),
                pa.array(by_word),
            ],
            names=["doc_id", *COUNTS, "base_failed", "kept", "class_distance", "word_distance"],
        )


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document.

    Words are runs without ASCII white space. A NULL text counts as empty, and an empty
    one fails by its length. Documents of ``COMMON_WORDS`` are judged by the nearest of those
    languages, documents without language by the nearest of all. A language that has no word list
    gets a reference of classes from ``MIN_REFERENCE_DOCS`` long documents on; its documents are judged
    by that one too, never by words, and with fewer by the base rules only. An empty table gives
    no rows; without any reference only the base rules judge. Rows are taken one by one.
    """
    rows = texts_of(docs, doc_id, text, F.nullif(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{name} long" for name in COUNTS)
    profiles = stored(
        rows.mapInArrow(
            batch_task("divergence", "profile_batches"), f"doc_id {id_type}, lang string, {counts}, bins array<float>"
        ),
        "profiles",
    )
    long_enough = (F.col("n_words") >= MIN_WORDS_JUDGED) & (F.col("word_chars") >= MIN_CHARS_JUDGED)
    sums = (
        profiles.filter(long_enough & F.col("lang").isNotNull())
        .groupBy("lang")
        .agg(F.count("*").alias("n"), *(F.sum(F.col("bins")[i]).alias(f"b{i}") for i in range(N_BINS)))
        .filter(F.col("lang").isin(*COMMON_WORDS) | (F.col("n") >= MIN_REFERENCE_DOCS))
    )
    references = [(row[0], list(row[2:])) for row in sorted(sums.collect())]  # one row per language
    return profiles.mapInArrow(
        batch_task("divergence", "judge_batches", references),
        f"doc_id {id_type}, {counts}, base_failed boolean, kept boolean, class_distance double, word_distance double",
    )
