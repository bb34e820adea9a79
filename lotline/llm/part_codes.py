"""Vector codes: every vector is cut into parts, every part told by its nearest codebook entry.

All arithmetic is on integers: a component becomes ``floor(1024 * x)``. Parts and entries are
padded with zeros to a power of two and go through the Walsh-Hadamard transform, which keeps
squared distances up to that power as a factor. Squared differences are added from the lowest
sequency up, where smooth parts have most of their energy; an entry whose sum so far exceeds the
full sum of another one is out. What remains is exact, ties go to the lower entry.

Codebooks are learned by rounds of assignment over all rows: tasks add up the parts of each
entry, Spark adds the sums of tasks, and the driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.llm.common import batch_task, stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE_BITS = 10  # components are told in 1024ths

# Coefficients added between two eliminations, and pairs of rows and entries compared at once.
BLOCK = 8
PAIRS = 1 << 16
# Sums leave a task in digits of this many bits, so that adding them up cannot overflow.
DIGIT = 32
# A label with more than this share of the rows is joined by broadcast; there are fewer than 1 / HOT_SHARE.
HOT_SHARE = 0.01


def whole_numbers(column: pa.Array, length: int) -> np.ndarray:
    """``floor(1024 * x)`` of the components of each vector, with zeros up to ``length``.

    64-bit integers, or Python integers where a component does not fit.
    """
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(np.ldexp(values, SCALE_BITS))
    if len(scaled) and not (np.abs(scaled) < 2.0**62).all():
        whole = np.array([math.floor(Fraction(v) * (1 << SCALE_BITS)) for v in values.tolist()], dtype=object)
    else:
        whole = scaled.astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), length), dtype=whole.dtype)
    out[np.arange(length) < sizes[:, None]] = whole
    return out


def cut(vectors: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    return np.hsplit(vectors, parts)


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``size`` (a power of two) by their number of sign changes."""
    changes, last = np.zeros(1, np.int64), np.ones(1, np.int64)
    while len(changes) < size:
        turned = (last < 0).astype(np.int64)
        changes = np.concatenate([2 * changes + turned, 2 * changes + 1 - turned])
        last = np.concatenate([last, -last])
    return np.argsort(changes)


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, padded to a power of two, in order of sequency."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), size), dtype=rows.dtype)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < size:
        pairs = out.reshape(len(rows), size // (2 * half), 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([low + high, low - high], axis=2).reshape(len(rows), size)
        half *= 2
    return out[:, sequency_order(size)]


def _exact(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no sum of squares can overflow, else as Python integers."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    largest = max((int(np.abs(one).max()) for one in (rows, entries) if one.size), default=0)
    kind = np.int64 if size * (2 * size * largest) ** 2 < 1 << 63 else object
    return rows.astype(kind), entries.astype(kind)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each row and its squared distance."""
    rows, entries = _exact(rows, entries)
    x, e = transform(rows), transform(entries)
    size = x.shape[1]
    step = max(1, PAIRS // len(e))
    found = [_nearest(x[i : i + step], e) for i in range(0, len(x), step)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, x.dtype)
    return np.concatenate([at for at, _ in found]), np.concatenate([total for _, total in found]) // size


def _nearest(x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = _squares(x[:, None, :BLOCK], e[None, :, :BLOCK])
    bound = _squares(x, e[np.argmin(first, axis=1)])
    row, at = np.nonzero(first <= bound[:, None])
    total = first[row, at]
    for low in range(BLOCK, x.shape[1], BLOCK):
        total = total + _squares(x[row, low : low + BLOCK], e[at, low : low + BLOCK])
        left = total <= bound[row]
        row, at, total = row[left], at[left], total[left]
    # The entry that gave the bound is always left, so every row is.
    starts = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(total, starts)
    hits = np.flatnonzero(total == least[row])
    return at[hits[np.searchsorted(row[hits], np.arange(len(x)))]], least


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as ``(place, digit)`` with digits from ``-2**31`` to ``2**31 - 1``."""
    place, half = 0, 1 << (DIGIT - 1)
    while value:
        digit = (value + half) % (1 << DIGIT) - half
        if digit:
            yield place, digit
        value, place = (value - digit) >> DIGIT, place + 1


def part_sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Per part, entry and position the sum of the parts nearest to the entry; their count at position -1."""
    width = length // len(books)
    sums = np.zeros((len(books), max(map(len, books)), width), dtype=object)
    counts = np.zeros(sums.shape[:2], dtype=np.int64)
    for batch in batches:
        for p, part in enumerate(cut(whole_numbers(batch.column(0), length), len(books))):
            at, _ = nearest(part, books[p])
            here = np.zeros((len(books[p]), width), dtype=part.dtype)
            if part.dtype == np.int64 and part.size and int(np.abs(part).max()) * len(part) >= 1 << 63:
                here, part = here.astype(object), part.astype(object)
            np.add.at(here, at, part)
            sums[p, : len(here)] += here.astype(object)
            counts[p] += np.bincount(at, minlength=counts.shape[1])
    rows = []
    for p, entry in zip(*np.nonzero(counts)):
        totals = [int(counts[p, entry]), *map(int, sums[p, entry])]
        rows += [(p, entry, i - 1, place, digit) for i, total in enumerate(totals) for place, digit in _digits(total)]
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = ["part", "entry", "position", "place", "digit"]
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def moved(books: list[np.ndarray], sums: list[tuple[int, int, int, int, int]]) -> list[np.ndarray]:
    """Codebooks whose used entries are the floored means of their parts."""
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for part, entry, position, place, digit in sums:
        here = totals.setdefault((part, entry), {})
        here[position] = here.get(position, 0) + (digit << (DIGIT * place))
    out = [book.astype(object) for book in books]
    for (part, entry), here in totals.items():
        out[part][entry] = [here.get(i, 0) // here[-1] for i in range(out[part].shape[1])]
    return [_small(book) for book in out]


def _small(book: np.ndarray) -> np.ndarray:
    fits = all(abs(v) < 1 << 62 for v in book.ravel().tolist())
    return book.astype(np.int64) if fits else book


def code_batches(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """``vec_id, label`` with the code of the vector and the sum of its squared distances (NULL beyond 64 bits)."""
    for batch in batches:
        found = [nearest(p, book) for p, book in zip(cut(whole_numbers(batch.column(0), length), len(books)), books)]
        codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
        told = codes.tobytes().hex()
        width = 2 * len(books)
        errors = sum(total.astype(object) for _, total in found)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(1),
                batch.column(2),
                pa.array([told[i : i + width] for i in range(0, len(told), width)], pa.string()),
                pa.array([e if e < 1 << 63 else None for e in errors.tolist()], pa.int64()),
            ],
            names=["vec_id", "label", "code", "error"],
        )


def codebooks(vectors: DataFrame, length: int, *, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of ``vectors`` (``vector, vec_id``), one per part, after ``rounds`` rounds over all rows.

    They start from the vectors of the smallest ids (ties by components, NULL ids last); entries
    that no part is nearest to stay.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    rows = pa.array([row.vector for row in first], pa.list_(pa.float64()))
    books = cut(whole_numbers(rows, length))
    for _ in range(rounds):
        task = batch_task("part_codes", "part_sums", books, length)
        schema = "part int, entry int, position int, place int, digit long"
        sums = vectors.select("vector").mapInArrow(task, schema).groupBy("part", "entry", "position", "place")
        # As many rows as the codebooks have components, a few times that for very large ones.
        books = moved(books, [tuple(row) for row in sums.agg(F.sum("digit")).collect()])
    return books


def _told(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with ``label_error``, the sum of the errors of their label; NULL labels count as one."""
    whole = F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)")
    sums = coded.groupBy("label").agg(
        F.when(F.count("error") == F.count("*"), whole).alias("label_error"), F.count("*").alias("__n")
    )
    sums = stored(sums.withColumnRenamed("label", "__label"), "label-errors")
    total = sums.agg(F.sum("__n")).first()[0] or 0
    same = F.col("label").eqNullSafe(F.col("__label"))
    hot = F.broadcast(sums.filter(F.col("__n") > HOT_SHARE * total))
    rest = sums.filter(F.col("__n") <= HOT_SHARE * total)
    often = coded.join(hot, same)
    seldom = coded.join(hot, same, "left_anti").join(rest, same)
    return often.unionByName(seldom).drop("__label", "__n")


def part_codes(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    ``code`` has two hex digits per part, ``error`` is the squared distance to the entries, ``label_error``
    its sum over equal labels, NULL labels together; both are NULL where they do not fit 64 bits.
    Vectors that are NULL or hold NULL or non-finite components are dropped; shorter vectors, empty ones too, count
    as filled up with zeros to the longest, and lengths that four does not divide to the next that it does. Repeated rows
    count as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits tells 1 to 256 entries")
    usable = vectors.select(
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
    ).filter(
        "vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    kinds = {field.name: field.dataType.simpleString() for field in usable.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    longest = usable.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        none = vectors.sparkSession.createDataFrame([], schema)
        return none.select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    length = max(1, -(-longest // PARTS)) * PARTS
    books = codebooks(usable, length, entries=entries, rounds=rounds)
    coded = usable.select("vector", "vec_id", "label").mapInArrow(batch_task("part_codes", "code_batches", books, length), schema)
    coded = _with_label_errors(stored(coded, "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(_told(books)).alias("codebooks_sha256"))
