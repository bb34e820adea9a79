"""Periodic runs of words: stretches that repeat with a period four times or more.

A run of period ``q`` and ``L`` words matches itself, shifted by ``q``, over ``L - q`` words: at least 5 for
``q = 1``, 6 for 2 and 3, and ``3 * low`` for periods from ``low = 4, 8, 16, ...`` up to ``2 * low - 1``. So for every
such class of periods the grams of that many words are numbered, and a gram inside a run comes again ``q``
words later. It does not come again sooner: a gram is longer than the period, so two closer
occurrences would give the run a smaller period. Hence only the next occurrence of a gram in its document is a
seed, one per word and class, however often a gram occurs. Seeds on the same diagonal (lag) are
extended to both sides as far as the words match; the furthest word covered on each lag
tells which seeds lie in a stretch that has been extended already.

A text is one row and is worked on whole; texts are taken some megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import batch_task, text_chunks, texts_of

LEAST_WORDS, LEAST_PERIODS = 6, 4
# Words compared at first when a seed is extended; doubled while they match.
REACH = 16


def classes(words: int) -> Iterator[tuple[int, int, int]]:
    """``(low, high, gram)`` of the classes of periods that a text of ``words`` words can have."""
    low = 1
    while LEAST_PERIODS * low <= words:
        yield low, 2 * low - 1, max(LEAST_WORDS, LEAST_PERIODS * low) - low
        low *= 2


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(word, len(seen)) for word in words], dtype=np.int64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


class Grams:
    """Numbers of the grams of growing length at the places of a text that may still be in a run."""

    def __init__(self, ids: np.ndarray):
        self.length, self.size = 1, len(ids)
        self.at = np.arange(len(ids))  # places still of interest
        self.rank = ids.copy()  # by place; -1 elsewhere

    def grow(self, length: int, ends: np.ndarray) -> None:
        """Grams of ``length`` words, up to twice the length before, that end by ``ends`` of their place."""
        while self.length < length:
            step = min(length - self.length, self.length)
            at = self.at[self.at + self.length + step <= ends[self.at]]
            left, right = self.rank[at], self.rank[at + step]
            both = right >= 0
            at = at[both]
            fresh = np.full(self.size, -1, dtype=np.int64)
            fresh[at] = _ranks(left[both] * self.size + right[both])
            self.at, self.rank, self.length = at, fresh, self.length + step

    def next_places(self, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose gram comes again in their document, and the next place where it does."""
        order = self.at[np.argsort(self.rank[self.at], kind="stable")]
        again = (self.rank[order[1:]] == self.rank[order[:-1]]) & (document[order[1:]] == document[order[:-1]])
        return order[:-1][again], order[1:][again]

    def keep(self, places: np.ndarray) -> None:
        """Leave only ``places``: no other gram repeats, so no longer one there does."""
        fresh = np.full(self.size, -1, dtype=np.int64)
        fresh[places] = self.rank[places]
        self.at, self.rank = places, fresh


def _reach(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """First place from ``at`` on, ``stop`` at most, whose word differs from that ``lag`` words later."""
    size = REACH
    while at < stop:
        high = min(at + size, stop)
        differs = ids[at:high] != ids[at + lag : high + lag]
        if differs.any():
            return at + int(differs.argmax())
        at, size = high, 2 * size
    return stop


def _reach_back(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """First place of the matching stretch that ends before ``at``, ``stop`` at least."""
    size = REACH
    while at > stop:
        low = max(at - size, stop)
        differs = ids[low:at] != ids[low + lag : at + lag]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, size = low, 2 * size
    return stop


def find_runs(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(start, length, period)`` of all runs in documents that begin at ``starts`` of ``ids``, in order.

    Starts are places in ``ids``; a document ends where the next one begins.
    """
    lengths = np.diff(np.append(starts, len(ids)))
    document = np.repeat(np.arange(len(starts)), lengths)
    ends = np.repeat(starts + lengths, lengths)
    grams, found = Grams(ids), []
    for low, high, gram in classes(int(lengths.max(initial=0))):
        grams.grow(gram, ends)
        here, after = grams.next_places(document)
        if not len(here):
            break
        lag = after - here
        seed = (low <= lag) & (lag <= high)
        found += _extended(ids, here[seed], lag[seed], gram, starts, lengths, document)
        grams.keep(np.union1d(here, after))
    runs = np.array(found, dtype=np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _extended(ids, here, lag, gram, starts, lengths, document) -> list[tuple[int, int, int]]:
    order = np.lexsort((here, lag))
    here, lag = here[order], lag[order]
    # Neighbouring seeds of a lag lie in one stretch.
    first = np.ones(len(here), dtype=bool)
    first[1:] = (here[1:] != here[:-1] + 1) | (lag[1:] != lag[:-1])
    opening = np.flatnonzero(first)
    closing = np.append(opening, len(here))[1:] - 1
    found, covered = [], {}
    for begin, last, q in zip(here[opening].tolist(), here[closing].tolist(), lag[opening].tolist()):
        if begin < covered.get(q, 0):
            continue
        mine = document[begin]
        floor = int(starts[mine])
        low = _reach_back(ids, begin, q, floor)
        high = _reach(ids, last + gram, q, floor + int(lengths[mine]) - q)
        covered[q] = high
        if high - low + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.append((low, high - low + q, q))
    return found


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, runs, collapsed`` of ``doc_id, text``."""
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        at = 0
        for texts in text_chunks(batch.column(1).cast(pa.binary()).to_pylist()):
            # Bytes split at the six characters of ASCII white space.
            split = [text.split() for text in texts]
            counts = np.array([len(words) for words in split], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            filled = np.flatnonzero(counts)
            runs = find_runs(numbered([word for words in split for word in words]), offsets[filled])
            bounds = np.searchsorted(runs[:, 0], offsets)
            runs[:, 0] -= np.repeat(offsets[:-1], np.diff(bounds))
            short = [collapsed(words, runs[bounds[i] : bounds[i + 1]]) for i, words in enumerate(split)]
            told = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(entry))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(texts)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), told),
                    pa.array(short, pa.binary()),
                ],
                names=["doc_id", "runs", "collapsed"],
            )
            at += len(texts)


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every document.

    ``runs`` holds ``start, length, period`` in words by start, then period; words lie between
    ASCII white space. A run has 6 words and four periods at least, and no neighbouring word goes on with its smallest period.
    ``collapsed`` is the text without the words that a run holds after its first period, joined by one space. A NULL or empty
    text, and one of white space, has no words, no runs and an empty collapsed text. Repeated rows and NULL ids are
    documents of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = texts_of(docs, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    found = rows.mapInArrow(batch_task("periodic", "run_batches"), schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where the texts of a tenth of the ids end in a run, to see that it is found.

    With ``h`` the CRC-32 of the decimal id and ``g`` a tenth of it, texts with ``h % 10 = 0`` go on from
    word ``a = g % n`` by repeating ``1 + (n - a) div (3 + g % 8)`` words. Others, also those without id or words, stay.
    """
    crc = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    whole = F.col(f"`{text}`")

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(crc / 10)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        piece = F.slice(words, a + 1, p)
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(piece, times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

    words = F.filter(F.split(whole, r"[ \t\n\x0B\f\r]+"), lambda word: word != "")
    # One element that is bound once, so that the words are split once a row.
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(whole))[0]
    return docs.withColumn(text, F.when(crc % 10 == 0, planted).otherwise(whole))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and checksums of the result of ``periodic_runs``."""
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("small")))
    )
    told = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    lines = F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.small")).alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
