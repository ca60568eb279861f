"""The hashes that several sets hold, found by ranges of hashes: exactly, with nothing on the driver or broadcast.

A task sorts the hashes of a chunk of sets and deals them out by range, each
different one once, as steps between neighbours (six bytes, as a rule) with the
number of the set that holds it (two bytes).  What a chunk holds twice is repeated
already; its range gets one mark for it, so a hash that many sets hold arrives once
a chunk.  A range sends back what it finds in several chunks, and a chunk's sets are
put together again from what comes back.  Bytes shuffled grow with the hashes, and
no task holds more than a chunk or a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from soripark.llm.common import slices, tidy

U64 = np.uint64
#: Hashes and sets of a chunk, and about the hashes of a range.
CHUNK, CHUNK_SETS, RANGE = 1 << 20, 60_000, 1 << 21
#: Fewest and most ranges (their logarithm); the fewest keep all cores busy.
LEAST_BITS, MOST_BITS = 7, 15
#: In place of a set's number: the chunk holds this hash several times.
_MARK = 0xFFFF


def range_bits(hashes: float) -> int:
    """The logarithm of the number of ranges for so many hashes."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1.0, hashes / RANGE))))))


def packed(rising: np.ndarray, begin: int) -> bytes:
    """Rising uint64 from ``begin`` on as steps of as few whole bytes as the longest takes."""
    steps = np.diff(rising, prepend=U64(begin))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, n: int, begin: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + U64(begin)


def _begin(part: int, bits: int) -> int:
    return part << (64 - bits)


def _several(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``hashes``, and in this order which ones are the first of their value and which stand several times."""
    order = np.argsort(hashes, kind="stable")
    rising = hashes[order]
    same = rising[1:] == rising[:-1]
    first, several = np.ones(len(rising), bool), np.zeros(len(rising), bool)
    first[1:] = ~same
    several[1:] = same
    several[:-1] |= same
    return order, first, several


def _dealt(sets: list[np.ndarray], header: np.ndarray, chunk: int, bits: int) -> Iterator[tuple]:
    """A chunk's rows: part, chunk, sets' numbers, hashes and header; the row with the header holds what the chunk has several times."""
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order, first, several = _several(hashes)
    rising, owner = hashes[order], np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])[order]
    yield (1 << bits) + chunk % (1 << bits), chunk, owner[several].tobytes(), rising[several].tobytes(), header.tobytes()
    owner[several] = _MARK
    rising, owner = rising[first], owner[first]
    cuts = [*np.searchsorted(rising, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits)).tolist(), len(rising)]
    for part in range(1 << bits):
        a, b = cuts[part], cuts[part + 1]
        if b > a:
            yield part, chunk, owner[a:b].tobytes(), packed(rising[a:b], _begin(part, bits)), None


def _found(fragments: list[tuple], bits: int) -> Iterator[tuple]:
    """Of a range's fragments (part, chunk, numbers, hashes): chunk, numbers and hashes of what several chunks hold."""
    owners = [np.frombuffer(f[2], np.uint16) for f in fragments]
    hashes = np.concatenate([unpacked(f[3], len(o), _begin(f[0], bits)) for f, o in zip(fragments, owners)])
    order, _, several = _several(hashes)
    back = np.zeros(len(hashes), bool)
    back[order] = several
    end = 0
    for f, o in zip(fragments, owners):
        begin, end = end, end + len(o)
        at = back[begin:end] & (o != _MARK)
        if at.any():
            yield f[1], o[at].tobytes(), hashes[begin:end][at].tobytes(), None


def _whole(rows: list[tuple], columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's rows (chunk, numbers, hashes, header): the header, the repeated hashes set by set, how many each set has."""
    header = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows if r[3] is not None]).reshape(columns, -1)
    owner = np.concatenate([np.frombuffer(r[1], np.uint16) for r in rows])
    hashes = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
    return header, hashes[np.lexsort((hashes, owner))], np.bincount(owner, minlength=header.shape[1])


_SENT = [("part", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("header", pa.binary())]


def _batches(rows: Iterator[tuple], fields: list[tuple], held: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few MB."""
    own, size = [], 0
    schema = pa.schema(fields)
    for row in rows:
        own.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > held:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*own), fields)], schema=schema)
            own, size = [], 0
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*own), fields)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that stand together with one value of the first column."""
    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if own and own[0][0] != row[0]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def repeated_in(df: DataFrame, reader: Callable[[], Callable[[pa.RecordBatch], tuple[list, list[np.ndarray]]]], columns: int, hashes: float, result: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``result(header, repeated hashes set by set, how many each set has)`` of all chunks of sets.

    ``reader()``, called once a task, gives for a batch the header (``columns`` integer arrays, a value a set) and the sets' different hashes
    (uint64 arrays); ``hashes`` says about how many there are in all.  A set's hashes come back rising.
    """
    bits = range_bits(hashes)

    def send(batches):
        def rows():
            sets, held, headers, n, chunk = reader(), [], [], 0, TaskContext.get().partitionId() << 32
            flush = lambda: _dealt(held, np.concatenate([np.stack([np.asarray(x, np.int64) for x in h]) for h in headers], axis=1), chunk, bits)
            for batch in slices(batches):
                header, own = sets(batch)
                if held and (n + sum(map(len, own)) > CHUNK or len(held) + len(own) > CHUNK_SETS):
                    yield from flush()
                    held, headers, n, chunk = [], [], 0, chunk + 1
                held += own
                headers.append(header)
                n += sum(map(len, own))
            if held:
                yield from flush()

        return _batches(rows(), _SENT)

    def find(batches):
        def rows():
            for own in _groups(batches):
                if own[0][0] >> bits:
                    yield from (r[1:] for r in own)
                else:
                    yield from _found(own, bits)

        return _batches(rows(), _SENT[1:])

    def join(batches):
        for own in _groups(batches):
            yield result(*_whole(own, columns))

    dealt = df.mapInArrow(tidy(send), "part int, chunk long, a binary, b binary, header binary")
    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(find), "chunk long, a binary, b binary, header binary")
    return found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(tidy(join), schema)
