"""Count-min sketches built on the executors and merged by cell range.

A sketch has rows of 2**bits cells; a hash counts in one cell of each row, so the
smallest of its cells is at least its count.  A task sends only what it filled;
ranges are added up where they meet and reduced there.  ``build`` keeps counts,
``repeated`` only whether a cell counted twice.  What reaches the driver is bounded
by the parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from soripark.llm.common import slices, tidy

U64 = np.uint64
_SALTS = np.random.Generator(np.random.PCG64(97)).integers(1, 2**63, 8, dtype=np.uint64) * U64(2) + U64(1)
_HELD = 1 << 20
#: Most cells of a row of flags: two rows of 16 MB are broadcast.  Beyond some 10**8 hashes flags filter less and less, and lose nothing.
MOST_FLAG_BITS = 27


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> U64(31))) * _SALTS[row] >> U64(64 - bits)).astype(np.int64)


def bits_for(hashes: float, most: int, load: float = 0.5, least: int = 16) -> int:
    """Cells a row (their logarithm) at which ``hashes`` fill a share of ``load``, within limits."""
    return int(min(most, max(least, np.ceil(np.log2(max(1.0, hashes / load))))))


def _segments(bits: int) -> int:
    """Ranges a row is sent in; each is a whole number of bytes of flags."""
    return max(1, min(512, (1 << bits) // 64))


def _chunks(batches: Iterator[pa.RecordBatch], hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in slices(batches):
        for h in hashes(batch):
            held.append(h)
            n += len(h)
            if n >= _HELD:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _merged(filled: DataFrame, merge, rows: int, segments: int, empty: bytes) -> list[bytearray]:
    merged = filled.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(merge), "part int, bytes binary")
    width = len(empty)
    out = [bytearray(empty * segments) for _ in range(rows)]
    for r in merged.collect():
        row, s = divmod(r.part, segments)
        out[row][s * width : (s + 1) * width] = r.bytes
    return out


def _by_part(batches: Iterator[pa.RecordBatch], begin, add, done) -> Iterator[pa.RecordBatch]:
    """A range's parts arrive one after another; one total is held at a time."""
    part, total = None, None
    result = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done(total)], pa.binary())], ["part", "bytes"])
    for batch in batches:
        for p, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if p != part:
                if part is not None:
                    yield result()
                part, total = p, begin()
            add(total, a.as_buffer() if a.is_valid else None, b.as_buffer())
    if part is not None:
        yield result()


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], rows: int, bits: int, reduced: Callable[[np.ndarray], bytes]) -> list[bytearray]:
    """For each row the joined bytes of ``reduced(counts)`` of its cell ranges, in cell order.

    ``hashes`` yields uint64 arrays for a batch; ``counts`` are uint32, one a cell of the range.
    """
    segments = _segments(bits)
    width = (1 << bits) // segments

    def fill(batches):
        for joined in _chunks(batches, hashes):
            out = []
            for row in range(rows):
                at = np.sort(cells(joined, row, bits))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                cell, count = at[first], np.minimum(np.diff(first, append=len(at)), 65535).astype(np.uint16)
                cuts = np.searchsorted(cell, np.arange(segments + 1) * width)
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[s], cuts[s + 1]
                    if (b - a) * 6 < width * 2:
                        out.append((row * segments + s, (cell[a:b] - s * width).astype(np.uint32).tobytes(), count[a:b].tobytes()))
                    else:
                        dense = np.zeros(width, np.uint16)
                        dense[cell[a:b] - s * width] = count[a:b]
                        out.append((row * segments + s, None, dense.tobytes()))
            part, at_, n = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at_, pa.binary()), pa.array(n, pa.binary())], ["part", "a", "b"])

    def add(total, at, count):
        n = np.frombuffer(count, np.uint16)
        if at is None:
            total += n
        else:
            total[np.frombuffer(at, np.uint32)] += n

    def merge(batches):
        return _by_part(batches, lambda: np.zeros(width, np.int64), add, lambda total: reduced(np.minimum(total, 2**32 - 1).astype(np.uint32)))

    return _merged(df.mapInArrow(tidy(fill), "part int, a binary, b binary"), merge, rows, segments, reduced(np.zeros(width, np.uint32)))


def _gaps(sorted_cells: np.ndarray) -> bytes:
    """Rising numbers as bytes: each step less one is so many 255 and a smaller byte."""
    gap = np.diff(sorted_cells, prepend=-1) - 1
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    return out.tobytes()


def _ungaps(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 255)
    return np.cumsum(raw, dtype=np.int64)[ends] + np.arange(len(ends))


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], rows: int, bits: int) -> list[bytearray]:
    """For each row one bit a cell (first cell, highest bit): whether the cell counted two hashes or more."""
    segments = _segments(bits)
    width = (1 << bits) // segments

    def fill(batches):
        for joined in _chunks(batches, hashes):
            out = []
            for row in range(rows):
                at = np.sort(cells(joined, row, bits))
                new = np.concatenate([[True], at[1:] != at[:-1]])
                cell, twice = at[new], np.unique(at[~new])
                bounds = np.arange(segments + 1) * width
                cuts, twice_cuts = np.searchsorted(cell, bounds), np.searchsorted(twice, bounds)
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    out.append((row * segments + s, _gaps(cell[cuts[s] : cuts[s + 1]] - s * width), _gaps(twice[twice_cuts[s] : twice_cuts[s + 1]] - s * width)))
            part, once_, twice_ = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(once_, pa.binary()), pa.array(twice_, pa.binary())], ["part", "a", "b"])

    def add(total, once_, twice_):
        once, twice = total
        at = _ungaps(once_)
        twice[at] |= once[at]
        once[at] = True
        twice[_ungaps(twice_)] = True

    def merge(batches):
        return _by_part(batches, lambda: (np.zeros(width, bool), np.zeros(width, bool)), add, lambda total: np.packbits(total[1]).tobytes())

    return _merged(df.mapInArrow(tidy(fill), "part int, a binary, b binary"), merge, rows, segments, bytes(width // 8))


def flagged(flags: list[np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be repeated: its bit is set in every row (``flags``: uint8 arrays of ``repeated``)."""
    out = np.ones(len(hashes), bool)
    for row, table in enumerate(flags):
        cell = cells(hashes, row, bits)
        out &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out
