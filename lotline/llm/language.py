"""Language of a text by its words, unseen words by their characters.

A word that the model knows counts with the logarithm of its frequency in each language. An
unseen word is read by its characters: at each place the longest known n-gram that ends there,
from five characters down to one, counts with its frequency among the distinct words of each
language, and the word with the mean over its places. The language with the greatest sum over all
words of the text is told.

Word counts are taken from whole texts of at most ``TRAIN_DOCS`` documents a language, drawn by a
hash of their ids. The model holds at most ``WORDS`` words and ``GRAMS`` n-grams, shared equally between languages,
the most frequent ones; words beyond that are unseen ones. So what is broadcast is bounded.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lotline.llm.common import CHUNK_CHARS, batch_task, stored, text_chunks, texts_of

FOLDS, HELD_OUT = 4, 2  # by crc32 of the id
UNKNOWN = "und"

LANGS = 256  # languages that are learned at most, those with the most documents
TRAIN_DOCS = 20_000  # documents a language is learned from, as expected by their draw
WORDS, GRAMS = 1 << 18, 1 << 18
MIN_COUNT = 2  # occurrences of a known word
ORDER = 5
SMOOTH = 0.5
# Words of a text that count as independent evidence in its score.
EVIDENCE = 30

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START, END = "\x02", "\x03"
HELD_WORDS = 500_000  # distinct words that a counting task holds
HELD_CELLS = 1 << 23  # scores of words times languages that a scoring task remembers


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` counted over the rows (``lang, text``) of a task, now and then told and forgotten."""
    counts: defaultdict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts[lang].update(words_of(text))
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield _told(counts, "word")
            counts.clear()
    yield _told(counts, "word")


def _told(counts: dict[str, Counter], name: str) -> pa.RecordBatch:
    columns = [
        pa.array([lang for lang, found in counts.items() for _ in found], pa.string()),
        pa.array([item for found in counts.values() for item in found], pa.string()),
        pa.array([n for found in counts.values() for n in found.values()], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", name, "n"])


def grams_of(word: str) -> Iterator[str]:
    marked = f"{START}{word}{END}"
    for end in range(2, len(marked) + 1):
        for start in range(max(0, end - ORDER), end):
            yield marked[start:end]


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n`` counted over distinct words (``lang, word``)."""
    counts: defaultdict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
            counts[lang].update(grams_of(word))
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield _told(counts, "gram")
            counts.clear()
    yield _told(counts, "gram")


class Table:
    """Gains over the least log frequency by item and language, as rows of the languages that have the item."""

    def __init__(self, items: list[str], langs: np.ndarray, gains: np.ndarray):
        starts = [i for i, item in enumerate(items) if i == 0 or item != items[i - 1]]
        self.place = {items[i]: at for at, i in enumerate(starts)}
        self.starts = np.array([*starts, len(items)], dtype=np.int64)
        self.langs, self.gains = langs, gains

    def add(self, out: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        """Add the gains of the items ``at``, weighed, to the rows ``row`` of ``out``."""
        sizes = self.starts[at + 1] - self.starts[at]
        flat = np.arange(sizes.sum()) + np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes)
        np.add.at(out, (np.repeat(row, sizes), self.langs[flat]), self.gains[flat] * np.repeat(weight, sizes))


@dataclass(frozen=True)
class Model:
    """Languages, least log frequencies (by language; by order and language) and entries sorted by item."""

    langs: list[str]
    word_floor: np.ndarray
    gram_floor: np.ndarray
    words: tuple[list[str], np.ndarray, np.ndarray]
    grams: tuple[list[str], np.ndarray, np.ndarray]


class Scorer:
    """Scores of texts by a model; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.grams = Table(*model.words), Table(*model.grams)
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def _backed_off(self, word: str) -> list[tuple[int, int]]:
        """Place in the table and order of the longest known n-gram that ends at each character."""
        marked, place, found = f"{START}{word}{END}", self.grams.place, []
        for end in range(2, len(marked) + 1):
            for start in range(max(0, end - ORDER), end):
                at = place.get(marked[start:end])
                if at is not None:
                    found.append((at, end - start))
                    break
        return found

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word in each language."""
        out = np.zeros((len(words), len(self.model.langs)))
        at = np.array([self.words.place.get(word, -1) for word in words], dtype=np.int64)
        known = np.flatnonzero(at >= 0)
        out[known] = self.model.word_floor
        self.words.add(out, known, at[known], np.ones(len(known)))
        unseen = [(i, self._backed_off(words[i])) for i in np.flatnonzero(at < 0).tolist()]
        flat = [(i, gram, order, 1 / len(found)) for i, found in unseen for gram, order in found]
        if flat:
            row, gram, order, weight = map(np.array, zip(*flat))
            np.add.at(out, row, self.model.gram_floor[order] * weight[:, None])
            self.grams.add(out, row, gram, weight)
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the scores of the words of each text, and the number of words."""
        if len(self.seen) * len(self.model.langs) > HELD_CELLS:
            self.seen, self.rows = {}, self.rows[:0]
        split = [words_of(text) for text in texts]
        fresh = sorted(set(chain.from_iterable(split)).difference(self.seen))
        self.rows = np.concatenate([self.rows, self.word_scores(fresh)])
        self.seen.update(zip(fresh, range(len(self.seen), len(self.seen) + len(fresh))))
        sizes = np.array([len(words) for words in split], dtype=np.int64)
        sums = np.zeros((len(texts), len(self.model.langs)))
        if sizes.any():
            ids = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            filled = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[filled]
            sums[filled] = np.add.reduceat(self.rows[ids], starts, axis=0)
        return sums, sizes


def judged(sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language with the greatest sum (the first by name among equals) and its share of the evidence."""
    rounded = np.round(sums, 6)
    best = rounded.argmax(axis=1)
    weight = np.minimum(sizes, EVIDENCE) / np.maximum(sizes, 1)
    odds = np.exp((sums - sums.max(axis=1, keepdims=True)) * weight[:, None])
    return best, np.round(odds[np.arange(len(best)), best] / odds.sum(axis=1), 6)


def predict_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    size = max(1 << 16, CHUNK_CHARS * 8 // max(8, len(model.langs)))
    for batch in batches:
        langs, scores = [], []
        for texts in text_chunks(batch.column(1).to_pylist(), size):
            sums, sizes = scorer.texts(texts)
            best, score = judged(sums, sizes)
            langs += [model.langs[i] if n else UNKNOWN for i, n in zip(best.tolist(), sizes.tolist())]
            scores += np.where(sizes > 0, score, 0.0).tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )


def fold_of(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _most_frequent(counts: DataFrame, item: str, most: int) -> pa.Table:
    """At most ``most`` items of each language, by item: those with the greatest counts, equal counts all or none.

    The least count of each language is told from the number of items per count, so nothing is sorted.
    """
    least: dict[str, int] = {}
    held: Counter = Counter()
    # Different counts are few: n of them need n * (n + 1) / 2 words of the documents drawn.
    for row in counts.groupBy("lang", "n").count().orderBy(F.col("n").desc(), "lang").collect():
        held[row.lang] += row["count"]
        if held[row.lang] <= most:
            least[row.lang] = row.n
    if not least:
        return counts.limit(0).toArrow()
    bounds = counts.sparkSession.createDataFrame(list(least.items()), "lang string, least long")
    found = counts.join(F.broadcast(bounds), "lang").filter("n >= least").drop("least")
    return found.toArrow().sort_by([(item, "ascending"), ("lang", "ascending")])


def _entries(table: pa.Table, item: str, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    number = {lang: i for i, lang in enumerate(langs)}
    gains = np.log(table.column("n").to_numpy() / SMOOTH + 1)
    return table.column(item).to_pylist(), np.array([number[v] for v in table.column("lang").to_pylist()], np.int32), gains


def train(known: DataFrame) -> Model | None:
    """The model of rows ``doc_id, text, lang``, none of them NULL; without words None."""
    sizes = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()
    shares = known.sparkSession.createDataFrame(
        [(r.lang, min(1.0, TRAIN_DOCS / r["count"])) for r in sizes], "lang string, share double"
    )
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    # One row a language that is learned, LANGS at most.
    taught = known.join(F.broadcast(shares), "lang").filter(drawn).select("lang", "text")
    counted = taught.mapInArrow(batch_task("language", "word_batches"), "lang string, word string, n long")
    counted = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return None
    words = _most_frequent(counted.filter(F.col("n") >= MIN_COUNT), "word", WORDS // len(langs))
    task = batch_task("language", "gram_batches")
    grams = counted.select("lang", "word").mapInArrow(task, "lang string, gram string, n long")
    grams = stored(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    order = F.length("gram").alias("k")
    spans = {(r.lang, r.k): r.n for r in grams.groupBy("lang", order).agg(F.sum("n").alias("n")).collect()}
    kinds = {r.k: r.n for r in grams.groupBy(order).agg(F.countDistinct("gram").alias("n")).collect()}
    size = len(set(words.column("word").to_pylist()))
    return Model(
        langs,
        np.array([math.log(SMOOTH / (totals[lang] + SMOOTH * size)) for lang in langs]),
        np.array(
            [
                [math.log(SMOOTH / (spans.get((lang, k), 0) + SMOOTH * max(1, kinds.get(k, 0)))) for lang in langs]
                for k in range(ORDER + 1)
            ]
        ),
        _entries(words, "word", langs),
        _entries(_most_frequent(grams, "gram", GRAMS // len(langs)), "gram", langs),
    )


def language_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learned from those outside fold 2.

    Rows with a NULL text, language or id teach nothing (a NULL id is not held out); repeated rows count as often as
    they occur. A NULL text, or one without letter, is ``und`` with score 0; so is every text when there is nothing to
    learn from. Languages that tell a text equally well are told by name. An empty table gives no rows; other columns are
    ignored.
    """
    rows = texts_of(docs, doc_id, text, F.col(f"`{lang}`").cast("string").alias("lang"))
    known = rows.filter(fold_of(F.col("doc_id")) != HELD_OUT).na.drop(subset=["lang"])
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    model = train(known)
    if model is None:
        return rows.select("doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, lang_pred string, score double"
    told = rows.select("doc_id", "text").mapInArrow(batch_task("language", "predict_batches", model), schema)
    return told.select("doc_id", held_out, "lang_pred", "score")
