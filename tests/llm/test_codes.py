"""Vector codes against plain integer arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lotline.llm import part_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, vector int, __n int, __label int"


def test_sequency_order_counts_sign_changes():
    for size in (1, 2, 8, 64):
        matrix = part_codes.transform(np.eye(size, dtype=np.int64)).T
        assert [int((row[1:] != row[:-1]).sum()) for row in matrix] == list(range(size))
        assert (matrix @ matrix.T == size * np.eye(size)).all()


@pytest.mark.parametrize("width", [1, 3, 8, 17])
@pytest.mark.parametrize("spread", [2, 300, 10**12])
def test_nearest_is_exact_with_ties(width, spread):
    draw = np.random.default_rng(width)
    rows = draw.integers(-spread, spread + 1, (400, width))
    entries = np.concatenate([rows[:40], rows[:40], draw.integers(-spread, spread + 1, (60, width))])
    at, total = part_codes.nearest(rows, entries)
    for row, i, d in zip(rows.tolist(), at.tolist(), total.tolist()):
        plain = [sum((a - b) ** 2 for a, b in zip(row, entry)) for entry in entries.tolist()]
        assert (d, i) == min(zip(plain, range(len(plain))))


def test_sums_are_exact_beyond_64_bits():
    for value in (0, 1, -1, 2**31, -(2**31), 2**95 + 7, -(2**200) + 3):
        assert sum(digit << (32 * place) for place, digit in part_codes._digits(value)) == value
    column = pa.array([[1e300, -1e300, 0.1], [-0.0001, 5e-324, 2.0**60]], pa.list_(pa.float64()))
    told = part_codes.whole_numbers(column, 4).tolist()
    assert told == [[math.floor(Fraction(x) * 1024) for x in one] + [0] for one in column.to_pylist()]


def brute(rows, entries=256, rounds=4, parts=4):
    """Codes, errors and checksum by the words of the task, on ``(vec_id, vector, label)``."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))

    def pieces(vector):
        whole = [math.floor(Fraction(x) * 1024) for x in vector]
        whole += [0] * (parts * width - len(whole))
        return [whole[p * width : (p + 1) * width] for p in range(parts)]

    cut = [pieces(r[1]) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def best(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for one in cut:
                members.setdefault(best(one[p], books[p])[1], []).append(one[p])
            books[p] = [
                [sum(column) // len(members[e]) for column in zip(*members[e])] if e in members else entry
                for e, entry in enumerate(books[p])
            ]
    told = [[best(one[p], books[p]) for p in range(parts)] for one in cut]
    errors = [sum(d for d, _ in one) for one in told]
    labels = {}
    for row, error in zip(kept, errors):
        labels[row[2]] = labels.get(row[2], 0) + error
    check = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()

    def fits(x):
        return x if x < 2**63 else None

    return [
        (r[0], "".join(f"{e:02x}" for _, e in one), fits(error), fits(labels[r[2]]), check)
        for r, one, error in zip(kept, told, errors)
    ]


def key(row):
    return tuple((v is None, str(v)) for v in row)


def test_part_codes_equal_plain_rounds(spark, frame):
    draw = random.Random(4)
    rows = [(i // 2, [draw.gauss(0, 0.2) for _ in range(10)], draw.choice([1, 1, 1, 2, None])) for i in range(300)]
    rows += [
        (1000, None, 1), (1001, [0.1, None], 1), (1002, [float("nan")], 1), (1003, [float("-inf")], 2), (None, [0.3] * 10, None),
        (1004, [], None), (1005, [0.5, -0.0], 9), (1006, [0.0] * 10, 2), (1006, [0.0] * 10, 2), (5, rows[3][1], 7),
    ]
    table = frame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    for entries, rounds in ((256, 4), (7, 2)):
        got = part_codes.part_codes(table, entries=entries, rounds=rounds).collect()
        assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows, entries, rounds), key=key)


def test_part_codes_of_huge_vectors_and_of_none(spark, frame):
    rows = [(i, [(-1.0) ** i * 1e200 * i, 0.001 * i, 3.0, 1.0], i % 2) for i in range(20)]
    table = frame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    got = part_codes.part_codes(table, entries=3).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows, 3), key=key)
    assert any(r.error is None for r in got)
    empty = part_codes.part_codes(table.filter("vec_id < 0"))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
