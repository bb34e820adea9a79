"""Byte-level BPE with given ranks: text to ids and ids to bytes.

A text is split by the pattern of the vocabulary and each match is merged on its own:
a segment tree over its byte positions keeps the leftmost pair of least rank at the
root; a merge takes that pair and updates the pairs of the live neighbours, each in
logarithmic time, so that a match of any length stays far from quadratic.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lotline.llm.common import batch_task, texts_of

# Pieces, and stretches, whose ids a worker remembers: some 100 MB at most.
CACHED = 250_000
CACHED_CHARS = 48
# Pieces of like length are merged together, from so many on and so many at a time.
TOGETHER = 48
ROWS = 4096

# A space between white space: the text is matched as a whole.
INNER_SPACE = re.compile(r"\s \s")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> bytes:
    """Ids of one match as 32-bit numbers: merge the leftmost adjacent pair of least rank until none is left."""
    n = len(piece)
    if n == 1:
        return array("I", [ranks[piece]]).tobytes()
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * n + n  # above every rank * n + position
    get = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    end = list(range(1, n + 1))  # end of the token that starts here
    begin = list(range(-1, n))  # start of the token that ends here
    while tree[1] < none:
        left = tree[1] % n
        middle = end[left]
        stop = end[middle]
        end[left] = stop
        begin[stop] = left
        put(middle, none)
        rank = get(piece[left : end[stop]]) if stop < n else None
        put(left, none if rank is None else rank * n + left)
        if left:
            before = begin[left]
            rank = get(piece[before:stop])
            put(before, none if rank is None else rank * n + before)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return array("I", ids).tobytes()


class PairRanks:
    """Rank of a pair of tokens, by their ranks, for many pairs at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.none = max(ranks.values()) + 1
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[key] for key in self.keys.tolist()], dtype=np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.none)


def merge_many(pieces: list[bytes], byte_ranks: np.ndarray, rank_of: PairRanks) -> list[bytes]:
    """``merge`` of many short pieces at a time, one segment tree per row.

    All rows take their next merge together; a row is done when its root is empty.
    """
    m = len(pieces)
    lengths = np.array([len(piece) for piece in pieces], dtype=np.int64)
    longest = int(lengths.max())
    size = 1 << max(longest - 2, 1).bit_length()
    none = rank_of.none * size
    codes = np.frombuffer(b"".join(piece.ljust(longest, b"\0") for piece in pieces), np.uint8).reshape(m, longest)
    width = longest + 2
    # Token that starts at a place, its end, and the start of the token that ends at a place.
    token = np.zeros((m, width), np.int64)
    token[:, :longest] = byte_ranks[codes]
    end = np.tile(np.arange(1, width + 1), (m, 1))
    begin = np.tile(np.arange(-1, width - 1), (m, 1))
    tree = np.full((m, 2 * size), none, np.int64)
    if longest > 1:
        places = np.arange(longest - 1)
        keys = rank_of(token[:, : longest - 1], token[:, 1:longest]) * size + places
        keys[places[None, :] + 1 >= lengths[:, None]] = none
        tree[:, size : size + longest - 1] = np.minimum(keys, none)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        root = tree[rows, 1]
        left = root % size
        middle = end[rows, left]
        stop = end[rows, middle]
        token[rows, left] = merged = root // size
        end[rows, left] = stop
        begin[rows, stop] = left
        tree[rows, size + middle % size] = np.where(middle < size, none, tree[rows, size + middle % size])
        after = np.minimum(rank_of(merged, token[rows, stop]) * size + left, none)
        after[stop >= lengths[rows]] = none
        tree[rows, size + left] = after
        before = begin[rows, left]
        has = before >= 0
        before = np.where(has, before, left)
        ahead = np.minimum(rank_of(token[rows, before], merged) * size + before, none)
        tree[rows, size + before] = np.where(has, ahead, after)
        for place in (middle % size, left, before):
            node = (size + place) >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1
        rows = rows[tree[rows, 1] < none]

    live = np.zeros((m, width), bool)
    live[:, 0] = True
    at = np.zeros(m, np.int64)
    rows = np.arange(m)
    while len(rows):
        at[rows] = end[rows, at[rows]]
        rows = rows[at[rows] < lengths[rows]]
        live[rows, at[rows]] = True
    flat = token[live].astype("<u4").tobytes()
    ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder of one vocabulary, with the ids of frequent pieces at hand."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ranks = np.array([self.ranks[bytes([byte])] for byte in range(256)], dtype=np.int64)
        self.pair_ranks = PairRanks(self.ranks)
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _ids_of_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece: whole tokens at once, short pieces by the hundred, long ones alone."""
        out, groups = {}, {}
        for piece in pieces:
            data = piece.encode("utf-8")
            rank = self.ranks.get(data)
            if rank is not None:
                out[piece] = array("I", [rank]).tobytes()
            else:
                groups.setdefault(max(len(data) - 2, 1).bit_length(), []).append((piece, data))
        for members in groups.values():
            if len(members) < TOGETHER or len(members[0][1]) > CACHED_CHARS:
                out.update((piece, merge(data, self.ranks)) for piece, data in members)
                continue
            for at in range(0, len(members), ROWS):
                some = members[at : at + ROWS]
                found = merge_many([data for _, data in some], self.byte_ranks, self.pair_ranks)
                out.update((piece, ids) for (piece, _), ids in zip(some, found))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.

        No match runs from other characters into a space, so a text is cut before its
        spaces and stretches seen before keep their ids. That does not hold for a space
        inside other white space: such a text is matched as a whole.
        """
        if len(self.stretches) >= CACHED:
            self.stretches.clear()
        if len(self.pieces) >= CACHED:
            self.pieces.clear()
        cut = []
        for text in texts:
            if INNER_SPACE.search(text):
                cut.append([text])
            else:
                first, *rest = text.split(" ")
                cut.append([first, *(" " + word for word in rest)])
        missing = set().union(*cut).difference(self.stretches)
        matched = {}
        for stretch in missing:
            found = self.pattern.findall(stretch)
            matched[stretch] = [stretch] if found == [stretch] else found  # one text in memory, not two
        pieces = self.pieces
        pieces.update(self._ids_of_pieces(set().union(*matched.values()).difference(pieces)))
        of_piece = pieces.__getitem__
        for stretch, found in matched.items():
            self.stretches[stretch] = b"".join(map(of_piece, found))
        find = self.stretches.__getitem__
        out = [np.frombuffer(b"".join(map(find, stretches)), "<u4") for stretches in cut]
        for stretch, found in matched.items():
            if len(stretch) > CACHED_CHARS:
                del self.stretches[stretch]
                for piece in found:
                    if len(piece) > CACHED_CHARS:
                        pieces.pop(piece, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids; an id outside the vocabulary raises ``KeyError``."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = codec(path, pattern).encode
    for batch in batches:
        ids = encode(batch.column(1).to_pylist())
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    decode = codec(path, pattern).decode
    for batch in batches:
        out = [decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])


def digest_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Encode each text, decode its ids, and keep count and checksums of both."""
    tool = codec(path, pattern)
    shown = {rank: str(rank) for rank in tool.tokens}
    for batch in batches:
        rows = []
        for found in tool.encode(batch.column(1).to_pylist()):
            ids = found.tolist()
            listed = " ".join(map(shown.__getitem__, ids)).encode()
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()))
        counts, listed, decoded = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def token_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Ids of each text with their number, and whether they decode to the text; columns after the text follow."""
    tool = codec(path, pattern)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ids = tool.encode(texts)
        right = [tool.decode(one.tolist()) == text.encode("utf-8") for one, text in zip(ids, texts)]
        ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        flat = pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32))
        columns = [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.ListArray.from_arrays(ends, flat)]
        columns += [pa.array(right, pa.bool_()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decodes", *batch.schema.names[2:]])


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every whole text.

    A NULL or empty text has no ids. Rows are taken one by one, so repeated rows repeat;
    other columns are ignored.
    """
    docs = texts_of(docs, doc_id, text)
    return docs.mapInArrow(batch_task("bpe", "encode_batches", path, pattern), f"doc_id {_id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded binary`` of every list of ids; NULL counts as empty."""
    rows = encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(
        batch_task("bpe", "decode_batches", path, pattern), f"doc_id {_id_type(rows)}, decoded binary"
    )


def round_trip(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of ids, their checksum and that of the decoded bytes, in one pass per text.

    Nulls, empties and repeated rows as in ``encode``.
    """
    docs = texts_of(docs, doc_id, text)
    schema = f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(batch_task("bpe", "digest_batches", path, pattern), schema)


def tokens(
    docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, n_tokens, ids, decodes`` of every whole text; the last tells whether the ids give the text again.

    The columns ``keep`` follow. Nulls, empties and repeated rows as in ``encode``.
    """
    docs = texts_of(docs, doc_id, text, *(F.col(f"`{name}`") for name in keep))
    kept = "".join(f", `{name}` {docs.schema[name].dataType.simpleString()}" for name in keep)
    schema = f"doc_id {_id_type(docs)}, n_tokens long, ids array<int>, decodes boolean{kept}"
    return docs.mapInArrow(batch_task("bpe", "token_batches", path, pattern), schema)
