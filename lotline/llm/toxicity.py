"""Toxicity by a factorization machine over hashed terms.

Each text is the set of its hashed words. Terms whose presence differs clearly between
toxic and other training texts stay active; over those the machine learns a weight per
term and a short vector per term whose products weigh pairs of terms. The sums of the
gradient are taken by partition and added in a tree.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.llm.common import batch_task, stored, texts_of

FOLDS, HELD_OUT = 3, 1  # by crc32 of the id
TOXIC = 0.7  # least score of a document taken as toxic

# Labelled rows that the machine learns from at most (the first by a hash of their id).
MAX_TRAIN_ROWS = 200_000

BUCKETS = 1 << 20
MIN_DOCS = 3  # training texts with an active term
MIN_EVIDENCE = 15.0  # likelihood ratio statistic of an active term
FACTORS = 4
STEPS, RATE = 30, 0.1
DECAY = 5e-5  # of all weights and vectors

WORD = re.compile(r"\w+")
CACHED = 400_000


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % BUCKETS


def terms(text: str, seen: dict[str, int]) -> list[int]:
    """Distinct buckets of the words of a text; ``seen`` remembers the buckets of words."""
    words = set(WORD.findall(text.lower()))
    if len(seen) > CACHED:
        seen.clear()
    for word in words.difference(seen):
        seen[word] = bucket(word)
    return list(set(map(seen.__getitem__, words)))


def term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        found = [terms(text, seen) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["y", "terms"]
        )


def active_batches(batches: Iterator[pa.RecordBatch], active: list[int]) -> Iterator[pa.RecordBatch]:
    """Places of the active terms of each training text."""
    table = np.array(active, dtype=np.int64)
    for batch in batches:
        ids, row = _flat(batch.column("terms"))
        at = np.minimum(np.searchsorted(table, ids), len(table) - 1)
        hit = table[at] == ids
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=batch.num_rows))]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("y"), places], names=["y", "active"])


def evidence(pos: float, neg: float, all_pos: float, all_neg: float) -> float:
    """Likelihood ratio statistic of a term that ``pos`` toxic and ``neg`` other texts hold."""

    def part(seen: float, expected: float) -> float:
        return seen * math.log(seen / expected) if seen else 0.0

    n, total = pos + neg, all_pos + all_neg
    rest = total - n
    return 2 * (
        part(pos, n * all_pos / total)
        + part(neg, n * all_neg / total)
        + part(all_pos - pos, rest * all_pos / total)
        + part(all_neg - neg, rest * all_neg / total)
    )


class Machine:
    """Weights: a constant, one per active term, and a vector per active term."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = (len(values) - 1) // (1 + FACTORS)
        self.constant, self.linear, self.vectors = values[0], values[1 : n + 1], values[n + 1 :].reshape(n, FACTORS)

    def raw(self, ids: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of ``n`` texts, and the sum of the vectors of each; ``row`` tells the text of each term."""
        sums = np.zeros((n, FACTORS))
        np.add.at(sums, row, self.vectors[ids])
        squares = np.bincount(row, (self.vectors[ids] ** 2).sum(axis=1), n)
        linear = np.bincount(row, self.linear[ids], n)
        return self.constant + linear + ((sums**2).sum(axis=1) - squares) / 2, sums


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(np.asarray(column.offsets))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(lengths)), lengths)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradient_sums(batches: Iterator[pa.RecordBatch], values: bytes) -> Iterator[pa.RecordBatch]:
    """One row per partition: the gradient of the logistic loss, and the number of texts."""
    machine = Machine(np.frombuffer(values))
    n_terms = len(machine.linear)
    out, texts = np.zeros(len(machine.values)), 0
    linear, vectors = out[1 : n_terms + 1], out[n_terms + 1 :].reshape(n_terms, FACTORS)
    for batch in batches:
        y = np.asarray(batch.column("y"))
        ids, row = _flat(batch.column("active"))
        raw, sums = machine.raw(ids, row, len(y))
        error = _sigmoid(raw) - y
        texts += len(y)
        out[0] += error.sum()
        linear += np.bincount(ids, error[row], n_terms)
        np.add.at(vectors, ids, error[row, None] * (sums[row] - machine.vectors[ids]))
    yield pa.RecordBatch.from_arrays([pa.array([np.append(out, texts).tobytes()], pa.binary())], names=["sums"])


def fit(train: DataFrame, start: np.ndarray) -> np.ndarray:
    """Weights after ``STEPS`` steps of Adam over all rows of ``train`` (``y``, ``active``)."""
    values, mean, square = start, np.zeros_like(start), np.zeros_like(start)
    for step in range(1, STEPS + 1):
        parts = train.mapInArrow(batch_task("toxicity", "gradient_sums", values.tobytes()), "sums binary")
        sums = parts.rdd.map(lambda row: np.frombuffer(row.sums)).treeReduce(lambda a, b: a + b, depth=2)
        slope = sums[:-1] / sums[-1]
        slope[1:] += DECAY * values[1:]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        values = values - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return values


def score_batches(batches: Iterator[pa.RecordBatch], active: list[int], values: bytes) -> Iterator[pa.RecordBatch]:
    machine = Machine(np.frombuffer(values))
    place = {b: i for i, b in enumerate(active)}
    seen: dict[str, int] = {}
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            words = set(WORD.findall(text.lower()))
            if len(seen) > CACHED:
                seen.clear()
            for word in words.difference(seen):
                seen[word] = place.get(bucket(word), -1)
            here = set(map(seen.__getitem__, words))
            here.discard(-1)
            found.append(sorted(here))
        ids = np.array([i for one in found for i in one], dtype=np.int64)
        row = np.repeat(np.arange(len(found)), [len(one) for one in found])
        score = np.round(_sigmoid(machine.raw(ids, row, len(found))[0]), 6)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])


def fold_of(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_TRAIN_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score`` of every document, learned from labelled rows outside fold 1.

    At most ``max_rows`` labelled rows teach, which bounds what is broadcast and the time of a
    step; all documents are scored. A NULL text counts as empty; an empty text has no
    terms and gets the score of the constant. NULL labels and NULL ids teach nothing, repeated rows count as
    often as they occur (a NULL id is not held out). With no usable label every score is 0.5. An empty table
    gives no rows; other columns are ignored.
    """
    rows = texts_of(docs, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    truth = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).na.drop()
    truth = truth.filter(fold_of(F.col("doc_id")) != HELD_OUT)
    truth = truth.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")

    labelled = rows.join(F.broadcast(truth), "doc_id").select("doc_id", "text", "y")
    words = stored(
        labelled.mapInArrow(batch_task("toxicity", "term_batches"), "y double, terms array<int>"), "terms"
    )
    n, pos = words.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return rows.select("doc_id", held_out, F.lit(0.5).alias("score"))
    counts = (
        words.select("y", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
        .filter(F.col("n") >= MIN_DOCS)
    )
    telling = []
    if 0 < pos < n:  # buckets that occur with one label only are compared with the share of the label
        share = pos / n
        unusual = F.abs(F.col("pos") / F.col("n") - share) > 2 * F.sqrt(F.lit(share * (1 - share)) / F.col("n"))
        telling = [
            (int(term), p, m - p)
            for term, p, m in counts.filter(unusual).collect()  # BUCKETS rows at most
            if evidence(p, m - p, pos, n - pos) >= MIN_EVIDENCE
        ]
    telling.sort()
    active = [term for term, _, _ in telling]
    odds = [math.log((p + 0.5) / (q + 0.5)) - math.log((pos + 1) / (n - pos + 1)) for _, p, q in telling]
    prior = math.log((pos + 0.5) / (n - pos + 0.5))
    vectors = np.random.default_rng(11).normal(0, 0.05, len(active) * FACTORS)
    start = np.concatenate([[prior], np.clip(odds, -6, 6), vectors])
    values = start
    if active:
        task = batch_task("toxicity", "active_batches", active)
        values = fit(stored(words.mapInArrow(task, "y double, active array<int>"), "active"), start)
    scored = rows.mapInArrow(
        batch_task("toxicity", "score_batches", active, values.tobytes()), f"doc_id {id_type}, score double"
    )
    return scored.select("doc_id", held_out, "score")
