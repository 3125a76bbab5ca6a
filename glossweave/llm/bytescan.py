"""Words of many texts at once: vectorised scanning and hashing of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
#: Bytes scanned at a time; a longer word makes a longer slice.
SLICE = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SLICE + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(n, base & _M64, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def byte_table(outside: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after lower-casing A-Z), by byte; ``outside`` has the bytes that separate words."""
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    inside &= inside[fold]
    return inside, fold


#: Words of characters other than white space (space and U+0009 to U+000D).
SPACED = byte_table(bytes([*range(9, 14), 32]))
#: Words of digits, letters and everything beyond ASCII.
ALNUM = (lambda t: (np.array([(48 <= b <= 57) or (65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)]), t[1]))(byte_table(b""))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def scan(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash, first): byte places and 64-bit hashes of all words; row r has words first[r] to first[r + 1] - 1."""
    inside, fold = kind
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del word, begins, ends
    hashes = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        at = begin[i]
        j = max(i + 1, int(np.searchsorted(end, at + SLICE, side="right")))
        part = fold[data[at:end[j - 1]]].astype(np.uint64)
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[:len(part)], out=sums[1:])
        b, e = begin[i:j] - at, end[i:j] - at
        hashes[i:j] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        i = j
    return begin, end, hashes, np.searchsorted(begin, offsets)


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes of given (lower-cased) words, equal to those of scan()."""
    data = np.frombuffer(b"".join(words), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    every = np.ones(256, bool)
    return scan(data, offsets, (every, np.arange(256, dtype=np.uint8)))[2]
