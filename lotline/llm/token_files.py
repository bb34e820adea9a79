"""Token-id files: documents in ascending id order as packed blocks of ids.

Documents are range-partitioned and sorted by id, encoded, closed by an end id and
packed (``simple8b``) into blocks of whole documents. A file is a parquet container
written through Spark's committer, so a repeated task replaces its own output; a row
is a block:

``part`` number of the file in document order, ``block`` number in the file, ``first``
ids of the file before the block, ``n_ids``, ``doc_ids`` and ``doc_ends`` (end of each
document, in ids from the start of the block), ``words`` the packed ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lotline.llm import simple8b
from lotline.llm.common import batch_task, texts_of

BLOCK_IDS = 1 << 16
END_ID = 1
FILE_SCHEMA = (
    "part int, block int, first long, n_ids long, doc_ids array<long>, doc_ends array<long>, words binary"
)

# Words whose ids a worker remembers: some 150 MB at most.
CACHED_WORDS = 600_000
CACHED_CHARS = 48
# Separators for Python's split that the tokenizer takes as text.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")

# Stands between words that are encoded together; it has one id that nothing else has.
MARK = "\x00"
JOINED_WORDS = 30
CLOSING = ",.!"

_PACKED = struct.Struct("<I")

_tokenizers: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """Letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (byte for byte in range(256) if byte not in shown)
    return {byte: chr(256 + i) for i, byte in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
# Letters before this one are small after Python's ``lower`` exactly as after the tokenizer's, but for one.
LATIN_END, DOTTED_I = "\u0180", "\u0130"


def _is_latin(word: str) -> bool:
    """Letters only, all before ``LATIN_END``: nothing is composed, split or left out of them."""
    return word.isalpha() and max(word) < LATIN_END and DOTTED_I not in word


def _ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")


class WordIds:
    """Ids of texts, joined from the ids of their words between white space.

    The tokenizer drops white space and never joins characters across it, so the ids
    of a text are those of its words in a row; frequent words are encoded once. As it
    ignores case, ASCII letters are lowered first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.closing = dict(zip(CLOSING, self._encode(list(CLOSING))))
        (self.mark_id,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in found]

    def _learn(self, words: list[str]) -> None:
        """Encode words many at a time, with a mark between them that has an id of its own.

        Letters before one closing mark are a word of their own to the tokenizer. Latin
        letters alone are one piece to its splitter; their bytes go to its merges at once.
        """
        closing, known = self.closing, self.known
        closed, open_words = [], []
        for word in words:
            (closed if word[-1] in closing and word[:-1].isalpha() else open_words).append(word)
        bare = {word[:-1] for word in closed}.difference(known)
        rest, split, pack = [], self.tokenizer.model.tokenize, _PACKED.pack
        for word in bare.union(open_words):
            if not word.isalpha():
                rest.append(word)
                continue
            if word.isascii():
                piece = word
            elif _is_latin(word):
                piece = word.lower().encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
            else:
                rest.append(word)
                continue
            known[word] = b"".join([pack(token.id) for token in split(piece)])
        self._encode_words(rest)
        for word in closed:
            known[word] = known[word[:-1]] + closing[word[-1]]

    def _encode_words(self, words: list[str]) -> None:
        plain = [word for word in words if MARK not in word]
        for word in set(words).difference(plain):
            self.known[word] = self._encode([word])[0]
        for at in range(0, len(plain), JOINED_WORDS):
            some = plain[at : at + JOINED_WORDS]
            ids = np.frombuffer(self._encode([f" {MARK} ".join(some)])[0], "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            starts, ends = np.concatenate([[0], cuts + 1]).tolist(), [*cuts.tolist(), len(ids)]
            data = ids.tobytes()
            self.known.update((word, data[4 * a : 4 * b]) for word, a, b in zip(some, starts, ends, strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = [any(mark in text for mark in NOT_SPACE) for text in texts]
        words = [[] if odd else _ascii_lower(text).split() for odd, text in zip(whole, texts)]
        wanted = set().union(*words)
        missing = wanted.difference(self.known)
        if len(self.known) + len(missing) > CACHED_WORDS:
            # Words of the texts at hand stay, and with them the frequent ones.
            self.known = {word: self.known[word] for word in wanted.difference(missing)}
        self._learn(list(missing))
        find = self.known.__getitem__
        out = [
            np.frombuffer(self._encode([text])[0] if odd else b"".join(map(find, listed)), "<u4")
            for odd, text, listed in zip(whole, texts, words)
        ]
        for word in missing:
            if len(word) > CACHED_CHARS:
                del self.known[word]
                self.known.pop(word[:-1], None)
        return out


def _word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def encode_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int):
    """Blocks of the sorted documents of one partition."""
    encoder, part = _word_ids(path), TaskContext.get().partitionId()
    docs, held, size, first, block = [], [], 0, 0, 0

    def close() -> pa.RecordBatch:
        ends = np.cumsum([len(ids) for ids in held])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([size], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([ends.tolist()], pa.list_(pa.int64())),
                pa.array([simple8b.encode(np.concatenate(held))], pa.binary()),
            ],
            names=["part", "block", "first", "n_ids", "doc_ids", "doc_ends", "words"],
        )

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist())):
            ids = np.append(ids, np.uint32(end_id))
            docs.append(doc)
            held.append(ids)
            size += len(ids)
            if size >= block_ids:
                yield close()
                docs, held, size, first, block = [], [], 0, first + size, block + 1
    if docs:
        yield close()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    files: int | None = None,
) -> None:
    """Write the token files of all documents below ``path``.

    A NULL or empty text gives the end id alone. Rows that repeat an id follow each
    other by their text; a NULL id comes first. An empty table gives no block. Other
    columns are ignored. ``files`` is the number of range partitions, by default
    ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts_of(docs, doc_id, text).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    task = batch_task("token_files", "encode_blocks", tokenizer, end_id, block_ids)
    ranged.mapInArrow(task, FILE_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, length and checksum of each document of the blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(row["words"]).astype("<u4")
            ends = np.array(row["doc_ends"], dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(ends), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["first"], pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                ],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def document_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each document of the blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, ends = simple8b.decode(row["words"]).astype(np.int64), row["doc_ends"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids)),
                ],
                names=["doc_id", "ids"],
            )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of all documents of token files."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_ids", "doc_ends", "words")
    return blocks.mapInArrow(batch_task("token_files", "document_ids"), "doc_id long, ids array<long>")


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, read from the packed ids.

    ``start`` counts the ids of all documents before. Only one row per file is summed up
    in order; documents meet the start of their file in a join.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = blocks.select("part", "first", "doc_ids", "doc_ends", "words").mapInArrow(
        batch_task("token_files", "document_sums"),
        "part int, doc_id long, start long, n_tokens long, ids_crc32 long",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    starts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    return sums.join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )
