"""Counts of a text that several operators start from."""

from __future__ import annotations

from collections import Counter

import numpy as np

WINDOW = 8  # words of a window whose repetition counts
SYMBOLS = b"#*$%&|<>"

# Class of each byte: lower case, upper case, digit, blank, line break, sentence mark, symbol, beyond ASCII.
CLASSES = 8
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b" \t\x0b\x0c")] = 3
_CLASS[list(b"\n\r")] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[128:] = 7

_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(1, WINDOW + 1)], dtype=np.uint64)


def class_counts(data: bytes) -> np.ndarray:
    """Bytes of UTF-8 text per class."""
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=CLASSES)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
    if len(numbers) == len(words):
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    mixed = ids * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    keys = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        keys += mixed[i : i + n] * factor
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    places = np.flatnonzero(maybe)
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[places]
    _, kind, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    starts = places[counts[kind.reshape(-1)] > 1]
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def top_share(words: list[bytes]) -> float:
    """Share of the most frequent word."""
    return Counter(words).most_common(1)[0][1] / len(words) if words else 0.0
