"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics of a text.
The ridge scores need only the sums of products of those features: each partition adds
up its own rows and the sums are added in a tree. Sums are kept per fold, so that the
isotonic calibration sees scores of models that did not learn from the row itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.llm import textstats
from lotline.llm.common import batch_task, stored, texts_of

FOLDS = 5  # by crc32 of the id; fold 0 is held out
KEEP = 0.3  # least score of an accepted document

STATISTICS = textstats.CLASSES + 10
FEATURES = 192  # random Fourier features
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of a statistic
RIDGE = 1e-3  # per row
LIMIT = 4.0  # standardised statistics are cut here
BINS, LOW, HIGH = 2048, -0.5, 1.5  # of raw scores, for the calibration


def statistics(text: str) -> list[float]:
    """What is known of a text: shares of character classes, lengths and repetition. All zero when empty."""
    data = text.encode("utf-8")
    if not data:
        return [0.0] * STATISTICS
    words = data.split()
    n, lines = max(len(words), 1), data.count(b"\n") + 1
    classes = textstats.class_counts(data) / len(data)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    marked = sum(1 for word in words if word[-1] in b"#*$%&|<>!")
    return [
        *classes.tolist(),
        math.log1p(len(data)),
        math.log1p(lines),
        float(lengths.mean()),
        math.log1p(float(lengths.max())),
        float(lengths.std()),
        len(set(words)) / n,
        textstats.repeated_lines(data) / lines,
        textstats.repeated_words(words) / n,
        textstats.top_share(words),
        marked / n,
    ]


def statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(text) for text in batch.column(1).to_pylist()], np.float32).reshape(-1)
        ends = pa.array(np.arange(0, len(rows) + 1, STATISTICS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(rows))], names=["doc_id", "x"]
        )


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, STATISTICS)


def fourier(x: np.ndarray, mean: list[float], spread: list[float]) -> np.ndarray:
    """Random Fourier features of statistics, after a constant."""
    rng = np.random.default_rng(7)
    directions = rng.standard_normal((STATISTICS, FEATURES)) / WIDTH
    shifts = rng.uniform(0, 2 * np.pi, FEATURES)
    scaled = np.clip((x - np.array(mean)) / np.array(spread), -LIMIT, LIMIT)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(scaled @ directions + shifts)])


def normal_sums(batches: Iterator[pa.RecordBatch], mean: list[float], spread: list[float]):
    """One row per partition: per fold, the products of features with features and labels."""
    sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for batch in batches:
        z = fourier(_rows(batch.column("x")), mean, spread)
        y, fold = (np.asarray(batch.column(name)) for name in ("y", "fold"))
        for k in range(1, FOLDS):
            mine = z[fold == k]
            sums[k, :, :-1] += mine.T @ mine
            sums[k, :, -1] += mine.T @ y[fold == k]
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])


def ridge(sums: np.ndarray) -> list[float]:
    """Weights of the normal equations; the constant is not penalised."""
    products, targets = sums[:, :-1], sums[:, -1]
    penalty = np.full(len(products), RIDGE * products[0, 0] + 1e-9)
    penalty[0] = 1e-9
    return np.linalg.solve(products + np.diag(penalty), targets).tolist()


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)


def out_of_fold_bins(batches: Iterator[pa.RecordBatch], mean, spread, weights: list[list[float]]):
    """Rows and label sums per bin of the raw score, each row scored without its own fold."""
    for batch in batches:
        z = fourier(_rows(batch.column("x")), mean, spread)
        y, fold = (np.asarray(batch.column(name)) for name in ("y", "fold"))
        raw = np.einsum("ij,ij->i", z, np.array(weights)[fold])
        at = _bin(raw)
        bins = np.unique(at)
        n, total = np.bincount(at, minlength=BINS)[bins], np.bincount(at, y, minlength=BINS)[bins]
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n), pa.array(total)], names=["bin", "n", "total"])


def isotonic(bins: list[tuple[int, int, float]]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: centres of the pools of bins, and their label means."""
    pools: list[list[float]] = []
    for at, n, total in sorted(bins):
        pools.append([at * n, n, total])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [p[0] / p[1] for p in pools], [p[2] / p[1] for p in pools]


@dataclass(frozen=True)
class Model:
    """Scaling of the statistics, ridge weights and the calibration; without weights every score is 0.5."""

    mean: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    centres: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), 0.5)
        raw = fourier(x, self.mean, self.spread) @ np.array(self.weights)
        place = np.clip((raw - LOW) / (HIGH - LOW) * BINS - 0.5, 0, BINS - 1)
        return np.round(np.clip(np.interp(place, self.centres, self.means), 0, 1), 6)


def score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = model.scores(_rows(batch.column("x")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def accepted_batches(batches: Iterator[pa.RecordBatch], model: Model, text: str, keep: float):
    """The rows whose text scores ``keep`` or more."""
    for batch in batches:
        x = np.array([statistics(one or "") for one in batch.column(text).to_pylist()], np.float32).astype(np.float64)
        yield batch.filter(pa.array(model.scores(x.reshape(-1, STATISTICS)) >= keep))


def fold_of(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = texts_of(docs, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    task = batch_task("quality", "statistics_batches")
    return stored(rows.mapInArrow(task, f"doc_id {id_type}, x array<float>"), "statistics")


def _fit(known: DataFrame, labels: DataFrame, doc_id: str, label: str) -> Model:
    truth = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).na.drop()
    train = known.join(truth, "doc_id").select("x", "y", fold_of(F.col("doc_id")).alias("fold")).filter("fold <> 0")
    train = stored(train, "train")
    x = [F.col("x")[i] for i in range(STATISTICS)]
    sizes = train.agg(F.count("*"), *(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    if not sizes[0]:
        return Model()
    mean = list(sizes[1 : STATISTICS + 1])
    spread = [s if s > 1e-6 else 1.0 for s in sizes[STATISTICS + 1 :]]
    parts = train.mapInArrow(batch_task("quality", "normal_sums", mean, spread), "sums binary")
    sums = parts.rdd.map(lambda row: np.frombuffer(row.sums)).treeReduce(lambda a, b: a + b, depth=3)
    sums = sums.reshape(FOLDS, FEATURES + 1, FEATURES + 2)
    every = sums.sum(axis=0)
    weights = ridge(every)
    without = [weights] + [ridge(every - one if (every - one)[0, 0] > 0 else every) for one in sums[1:]]
    task = batch_task("quality", "out_of_fold_bins", mean, spread, without)
    bins = train.mapInArrow(task, "bin long, n long, total double").groupBy("bin")
    bins = bins.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # BINS rows at most
    return Model(mean, spread, weights, *isotonic([tuple(row) for row in bins]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """``doc_id, held_out, score`` of every document, by all labelled rows outside fold 0.

    ``held_out`` is true for documents of fold 0 (a NULL id has no fold and no label). A
    NULL text counts as empty; empty texts are scored by their zero statistics. Labels that
    are NULL teach nothing; repeated rows of either table count as often as they occur. With
    no usable label every score is 0.5. An empty table gives no rows; other columns are ignored.
    """
    known = _statistics(docs, doc_id, text)
    model = _fit(known, labels, doc_id, label)
    id_type = known.schema["doc_id"].dataType.simpleString()
    scored = known.mapInArrow(batch_task("quality", "score_batches", model), f"doc_id {id_type}, score double")
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep: float = KEEP,
) -> DataFrame:
    """The rows of ``docs`` that score ``keep`` or more, with all their columns.

    Each row is judged by its own text, by the model of ``quality_scores``; nothing is joined to the texts.
    """
    model = _fit(_statistics(docs, doc_id, text), labels, doc_id, label)
    return docs.mapInArrow(batch_task("quality", "accepted_batches", model, text, keep), docs.schema)
