"""Simple-8b: varying counts of ids packed into 64-bit words.

A block of ids is ``MAGIC``, three unsigned 32-bit numbers (ids, words, escapes), the
words and the escaped values, all little-endian. The upper four bits of a word are its
selector, the lower sixty hold ``COUNTS[selector]`` ids of ``BITS[selector]`` bits, the
first id lowest. A word of selector 0 stands for one id of more than 60 bits: it holds
the place of the value among the escapes. Ids beyond the end are padding zeros. As the
selectors alone tell how many ids each word holds, a block decodes without a loop over words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIII")
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
PAD = int(COUNTS.max())

_SMALL = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and int(ids.max()) < len(_SMALL):
        return _SMALL[ids]
    return np.searchsorted(_POWERS, ids, side="right").astype(np.uint8)


def _window_max(widths: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """Largest bit length of the next ``c`` ids at each of the first ``n`` places, per count ``c``."""
    doubled, step = {1: widths}, 1
    while 2 * step <= PAD:
        last = doubled[step]
        doubled[2 * step] = np.maximum(last, np.concatenate([last[step:], np.zeros(step, np.uint8)]))
        step *= 2
    out = {}
    for count in sorted(set(COUNTS.tolist())):
        base = 1 << (count.bit_length() - 1)
        rest = count - base
        out[count] = np.maximum(doubled[base][:n], doubled[base][rest : rest + n])
    return out


def encode(ids: np.ndarray) -> bytes:
    """The block of an array of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(2 * PAD, np.uint64)])
    widest = _window_max(_bit_lengths(padded), n)
    chosen = np.zeros(n, dtype=np.uint8)  # selector 0: escape
    for selector in range(15, 0, -1):  # from one id per word up to the most ids
        np.copyto(chosen, np.uint8(selector), where=widest[int(COUNTS[selector])] <= BITS[selector])
    jumps = COUNTS[chosen].astype(np.uint8).tobytes()
    starts, at = [], 0
    add = starts.append
    while at < n:
        add(at)
        at += jumps[at]
    starts = np.array(starts, dtype=np.int64)
    selectors = chosen[starts] if n else chosen
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        where = np.flatnonzero(selectors == selector)
        if selector == 0:
            words[where] |= np.arange(len(where), dtype=np.uint64)
            continue
        for place in range(int(COUNTS[selector]) if BITS[selector] else 0):
            words[where] |= padded[starts[where] + place] << np.uint64(place * int(BITS[selector]))
    escapes = ids[starts[selectors == 0]]
    return HEADER.pack(MAGIC, n, len(words), len(escapes)) + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode(block: bytes) -> np.ndarray:
    """The ids of a block."""
    magic, n, n_words, n_escapes = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of packed ids")
    words = np.frombuffer(block, "<u8", n_words, HEADER.size)
    escapes = np.frombuffer(block, "<u8", n_escapes, HEADER.size + 8 * n_words)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(int(ends[-1]) if n_words else 0, dtype=np.uint64)
    for selector in np.unique(selectors):
        where = np.flatnonzero(selectors == selector)
        first, bits = ends[where] - COUNTS[selector], int(BITS[selector])
        if selector == 0:
            out[first] = escapes[(words[where] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << bits) - 1)
        for place in range(int(COUNTS[selector]) if bits else 0):
            out[first + place] = (words[where] >> np.uint64(place * bits)) & mask
    return out[:n]
