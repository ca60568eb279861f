"""Vectorised word and shingle hashes shared by the text operators.

A word is a run of bytes other than space and 0x09-0x0D, which is what
``bytes.split()`` yields.  A word's hash is a polynomial over a random byte
table modulo 2**64, finished by a mixer; a shingle's hash is a polynomial over
word hashes.  Identity of a shingle is two such hashes (128 bits): at 10**13
shingles the chance of any false match is below 10**-12.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
CHUNK_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SPACE] = 0
_P = U64(0x9E3779B97F4A7C15)
_Q = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
_powers = np.ones(1, np.uint64)


def _pow_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        table = np.full(size, _P, np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64 (xor-shift and multiply rounds)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def word_hashes(data: bytes) -> np.ndarray:
    """uint64 hash of each word of ``data`` in order."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = raw[starts[0] :]
    starts -= starts[0]
    spans = np.diff(starts, append=len(raw))
    within = np.arange(len(raw)) - np.repeat(starts, spans)
    values = _BYTE[raw] * _pow_table(int(spans.max()))[within]
    return mix(np.add.reduceat(values, starts))


def batches_of(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` that hold about ``limit`` bytes each; one text is never cut."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def batch_word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts laid end to end, and how many words each text has."""
    counts = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts)) if len(texts) < 2 else _counts(texts)
    return word_hashes(b"\n".join(texts)), counts


def _counts(texts: Sequence[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    total = np.concatenate([[0], np.cumsum(first)])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    return np.diff(total[ends], prepend=0)


def shingle_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (k >= 1), by doubling; length len(words)-k+1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = _Q[which]
    power, level, width = q, words, 1
    out, out_width = None, 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, out_width = level, width
            else:  # level covers what follows the part in out
                shifted = level[out_width : out_width + len(level)]
                m = min(len(out), len(shifted))
                out = out[:m] * power + shifted[:m]
                out_width += width
        rest >>= 1
        if rest:
            level = level[:-width] * power + level[width:]
            power = U64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
            width *= 2
    return mix(out[:n])


def shingle_places(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: text index, word place inside the text and flat index of each k-run inside one text."""
    runs = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), runs)
    begin = np.cumsum(counts) - counts
    place = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    return text, place, place + begin[text]


def word_hashes_and_endings(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash, and a number made of its last three bytes (fewer for a shorter word)."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ending = np.zeros(len(starts), np.int64)
    for back in (1, 2, 3):
        at = ends - back
        ending = ending * 256 + np.where(at >= starts, raw[np.maximum(at, 0)] if len(raw) else 0, 0)
    return word_hashes(data), ending
