"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# bytes from which a word is hashed on its own
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, first word of each text and the end).

    Words are runs of bytes other than blank and \\t to \\r, with A-Z lower-cased.
    """
    data = np.frombuffer((b"\n".join(contents) + b"\n").lower(), np.uint8)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    width = ends - starts
    value = np.zeros(len(starts), np.uint64)
    live = np.flatnonzero(width < _LONG)
    at, left = starts[live], width[live]
    j = 0
    while len(live):
        value[live] = (value[live] + data[at + j].astype(np.uint64) + np.uint64(1)) * _A
        j += 1
        more = left > j
        live, at, left = live[more], at[more], left[more]
    for i in np.flatnonzero(width >= _LONG):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        value[i] = int.from_bytes(digest, "little")
    text_starts = np.cumsum([0, *(len(c) + 1 for c in contents)])
    return mixed(value ^ width.astype(np.uint64)), np.searchsorted(starts, text_starts)


def shingle_sets(contents: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text of fewer words is one shingle, one without words none."""
    value, first = word_hashes(contents)
    chained = np.zeros(max(0, len(value) - words + 1), np.uint64)
    for j in range(words):
        chained = (chained ^ value[j:j + len(chained)]) * _B + np.uint64(j + 1)
    chained = mixed(chained)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(chained[a:b - words + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = (short ^ value[i:i + 1]) * _A + _B
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
