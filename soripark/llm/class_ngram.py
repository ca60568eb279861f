"""Language model scores of a class bigram model (Brown et al.) with exchange clustering.

Units are the words that occur at least ``LEAST`` times in training, each of their
own, and spelling bins for all other words, so units and their bigrams grow with the
corpus.  The units' bigram counts are gathered on the executors and stay there, packed
in blocks whose number grows with the units.  Exchange rounds send the class of each unit out, and bring back for each
unit of a block the class that raises the likelihood most, with other blocks fixed,
until a cycle of rounds over all blocks gains less than a share of the information.

    P(text) = product of P(class | class before) P(unit | class) P(word | unit)

Word counts of rare words never travel as a whole: the words of all documents
meet their training occurrences by hash bucket, and what returns is a sum a
document.  Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import forget, remainder, saved, slices, table, text_bytes, whole_texts
from soripark.llm.hashing import batches_of, mix, word_hashes_and_endings

LEAST = 10
BINS = 1024
CLASSES = 96
#: The exchange ends when a cycle of rounds gains less than this share of the mutual information of neighbouring classes.
GAIN = 0.001
#: Blocks at least, and units of a block at most on average.
BLOCKS, BLOCK_UNITS = 16, 2048
#: One block in this many moves its units in a round: blocks do not see each other's moves and would crowd the same classes.
STRIDE = 4
#: Units whose best classes are found together.
STEP = 64
#: Pseudo-counts: of a class transition, of a unit in its class, of a word in its bin and in the base.
TRANSITION, UNIT, WORD_COUNT = 20.0, 0.5, 0.5
BUCKET_ENTRIES = 3_000_000
END = np.uint64(0)  # stands for the end of a text; word hashes are never this by any likely chance


def _chunks(texts: list[bytes]):
    """First text, word counts, hashes and spelling bins of chunks of lower-cased texts."""
    lowered = [t.lower() for t in texts]
    for a, b in batches_of(lowered):
        joined = b"\n".join(lowered[a:b])
        hashes, endings = word_hashes_and_endings(joined)
        counts = np.fromiter((len(t.split()) for t in lowered[a:b]), np.int64, b - a)
        yield a, counts, hashes, (mix(endings.astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)


def _with_ends(counts: np.ndarray, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values with ``end`` after each text's, and where each text's part begins."""
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(values) + len(counts), values.dtype)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = values, end
    return out, ends - counts


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:  # numbers alone sort many times faster than their order
        keys = np.sort(keys)
    else:
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(first, append=len(keys)) if counts is None else (np.add.reduceat(counts[by], first) if len(first) else counts)
    return keys[first], n.astype(np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, first place and the place after the last of each run of equal values."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(values[first].tolist(), first.tolist(), np.append(first[1:], len(values)).tolist()))


@dataclass(frozen=True)
class Units:
    """Frequent words by sorted hash with their counts, and per bin tokens and kinds of the other words."""

    hashes: np.ndarray
    counts: np.ndarray
    bin_tokens: np.ndarray
    bin_kinds: np.ndarray
    tokens: int
    kinds: int

    @property
    def n(self) -> int:
        return len(self.hashes) + BINS

    def of(self, hashes: np.ndarray, bins: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return bins.copy()
        words, place = np.unique(hashes, return_inverse=True)  # in order and once each they are found faster
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        unit = np.where(self.hashes[at] == words, at + BINS, -1)[place]
        return np.where(unit >= 0, unit, bins)


def count_words(train: DataFrame, share: float, n_buckets: int, least: int = LEAST) -> Units:
    """Exact counts of all training words, each text's end among them; units have ``least`` occurrences and ``share`` of all tokens."""

    def run(batches):
        for batch in slices(batches):
            words, bins = [], []
            for _, counts, hashes, own in _chunks(text_bytes(batch.column(0))):
                words.append(np.concatenate([hashes, np.full(len(counts), END)]))
                bins.append(np.concatenate([own, np.zeros(len(counts), np.int64)]))
            words, bins = np.concatenate(words), np.concatenate(bins)
            by = np.argsort(words, kind="stable")
            words, bins = words[by], bins[by].astype(np.int16)
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            n = np.diff(first, append=len(words)).astype(np.int32)
            words, bins = words[first], bins[first]
            bucket = (words % np.uint64(n_buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            parts = [(b, by[x:y]) for b, x, y in _runs(bucket[by])]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32())] + [pa.array([a[i].tobytes() for _, i in parts], pa.binary()) for a in (words, bins, n)], ["bucket", "words", "bins", "n"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["words"]])
        bins = np.concatenate([np.frombuffer(x, np.int16) for x in pdf["bins"]])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["n"]]).astype(np.int64)
        by = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], words[by][1:] != words[by][:-1]]))
        words, bins, n = words[by][first], bins[by][first].astype(np.int64), np.add.reduceat(n[by], first)
        often = (n >= max(least, share * n.sum())) | (words == END)
        tokens, kinds = np.bincount(bins, n, BINS).astype(np.int64), np.bincount(bins, minlength=BINS)
        used = np.flatnonzero(kinds)
        return pd.concat([pd.DataFrame({"word": words[often].view(np.int64), "bin": bins[often], "n": n[often], "kinds": 0}), pd.DataFrame({"word": 0, "bin": used, "n": tokens[used], "kinds": kinds[used]})])

    counted = saved(train.select("text").mapInArrow(run, "bucket int, words binary, bins binary, n binary").groupBy("bucket").applyInPandas(total, "word long, bin long, n long, kinds long"))
    bins = counted.where("kinds > 0").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toPandas()
    bin_tokens, bin_kinds = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    bin_tokens[bins["bin"]], bin_kinds[bins["bin"]] = bins["n"], bins["kinds"]
    n, v = int(bin_tokens.sum()), int(bin_kinds.sum())
    core = counted.where((F.col("kinds") == 0) & ((F.col("n") >= max(least, share * n)) | (F.col("word") == 0))).select("word", "bin", "n").toPandas()
    hashes = core["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    np.subtract.at(bin_tokens, core["bin"].to_numpy(), core["n"].to_numpy())
    np.subtract.at(bin_kinds, core["bin"].to_numpy(), 1)
    return Units(hashes[by], core["n"].to_numpy(np.int64)[by], bin_tokens, bin_kinds, n, v)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers (0 or more) byte by byte: how many bytes the largest needs, all lowest bytes, then the next ones, up to that one.  Of these the high ones are mostly alike, which the shuffle's and the files' compression takes out."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype(np.int64).view(np.uint8).reshape(len(values), 8)[:, :width].T.tobytes()


def _numbers(planes: bytes | None) -> np.ndarray:
    if not planes:
        return np.zeros(0, np.int64)
    parts = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    for place, part in enumerate(parts):
        out[:, place] = part
    return out.view(np.int64).ravel()


def _pack(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Rising pair keys as their steps, and their counts."""
    return _planes(np.diff(keys, prepend=0)), _planes(n)


def _unpack(keys: bytes | None, n: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_numbers(keys)), _numbers(n)


def _split(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second unit of pair keys."""
    first = keys // size
    return first, keys - first * size


_SIDE = "block int, pairs binary, n binary"


def _side_rows(keys: np.ndarray, n: np.ndarray, unit: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A row a block of units with its pairs, keys rising."""
    block = (unit % blocks).astype(np.uint16 if blocks <= 1 << 16 else np.int64)  # 16 bits sort by radix
    by = np.argsort(block, kind="stable")
    parts = [(b, *_pack(keys[by[x:y]], n[by[x:y]])) for b, x, y in _runs(block[by].astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], ["block", "pairs", "n"])


def _joined(rows: pd.DataFrame) -> tuple[bytes, bytes]:
    parts = [_unpack(*x) for x in zip(rows["pairs"], rows["n"])]
    return _pack(*_summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))) if parts else _pack(np.zeros(0, np.int64), np.zeros(0, np.int64))


def _unit_bigrams(train: DataFrame, units: Units) -> DataFrame:
    """Packed counts of unit pairs: one row a block of units with what follows and what precedes each of them.

    Blocks that move their units in one round have one ``turn`` and lie together, so a round reads no others.  Tasks send their pairs once, by the first unit; what precedes a unit comes from the merged pairs.
    """
    held = whole_texts(train).sparkContext.broadcast(units)
    blocks, size = max(BLOCKS, -(-units.n // BLOCK_UNITS)), units.n

    def run(batches):
        u, kept, kept_n, waiting = held.value, np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged():
            return _summed(np.concatenate([kept, *(k for k, _ in waiting)]), np.concatenate([kept_n, *(n for _, n in waiting)]))

        end = int(u.of(np.array([END]), np.zeros(1, np.int64))[0])
        for batch in slices(batches):
            for _, counts, hashes, bins in _chunks(text_bytes(batch.column(0))):
                seq, begins = _with_ends(counts, u.of(hashes, bins), end)
                before = np.concatenate([[end], seq[:-1]])
                before[begins] = end
                waiting.append(_summed(before * u.n + seq))
                if sum(len(k) for k, _ in waiting) > max(1 << 20, len(kept)):  # so a pair is sorted a few times only
                    kept, kept_n = merged()
                    waiting.clear()
        kept, kept_n = merged()
        if len(kept):
            yield _side_rows(kept, kept_n, kept // u.n, blocks)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, n = _joined(pdf)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "pairs": [pairs], "n": [n]})

    def turn(batches):
        for batch in batches:
            for pairs, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys, count = _unpack(pairs, n)
                yield _side_rows(keys, count, keys % size, blocks)

    def both(key, out: pd.DataFrame, into: pd.DataFrame) -> pd.DataFrame:
        (out_pairs, out_n), (in_pairs, in_n) = _joined(out), _joined(into)
        return pd.DataFrame({"block": [key[0]], "out_pairs": [out_pairs], "out_n": [out_n], "in_pairs": [in_pairs], "in_n": [in_n]})

    after = saved(train.select("text").mapInArrow(run, _SIDE).groupBy("block").applyInPandas(merge, _SIDE).repartition(blocks, "block"))
    sides = after.groupBy("block").cogroup(after.mapInArrow(turn, _SIDE).groupBy("block"))
    packed = sides.applyInPandas(both, "block int, out_pairs binary, out_n binary, in_pairs binary, in_n binary").repartition(blocks, "block")
    out = saved(packed.withColumn("turn", F.col("block") % STRIDE), by="turn")
    forget(after)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by their (rising) owner, a row an owner."""
    out = np.zeros((n, values.shape[1]))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(first):
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _best_moves(m: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, loops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of several units the class to which it moves best, all others staying, and the gain in log likelihood.

    ``m``: class bigram counts; ``own``: the units' classes; ``out``/``into``: a row a unit, its bigrams with each class after and before
    it, its bigrams with itself (``loops``) among those of its own class.
    """
    each = np.arange(len(own))
    out, into = out.copy(), into.copy()
    out[each, own] -= loops
    into[each, own] -= loops

    def side(m, with_, across):
        """What row b gains when a unit's bigrams ``with_`` join it, for each b; without the unit's own counts where they stand now."""
        unit, at = np.nonzero(with_)  # only where it has bigrams
        each, x, columns = np.arange(len(unit)), with_[unit, at], np.ascontiguousarray(m.T)
        rest, before = columns[at], _xlogx(columns)[at]  # a row a bigram of a unit with a class; few places of it change without the unit's own counts
        home = np.flatnonzero(at == own[unit])
        rest[home] -= across[unit[home]]
        rest[each, own[unit]] -= x
        rest[home, own[unit[home]]] -= loops[unit[home]]
        before[home] = _xlogx(rest[home])
        before[each, own[unit]] = _xlogx(rest[each, own[unit]])
        rest += x[:, None]
        gain = np.log(np.maximum(rest, 1e-300))
        gain *= rest
        gain -= before
        return _sums(gain, unit, len(own))

    d = np.tile(np.diag(m), (len(own), 1))
    d[each, own] -= out[each, own] + into[each, own] + loops
    cross = _xlogx(d + out + into + loops[:, None]) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
    marginal = 0.0
    for totals, weight in ((m.sum(1), out.sum(1) + loops), (m.sum(0), into.sum(1) + loops)):  # a class keeps its total when a neighbour of its units moves
        rest = np.tile(totals, (len(own), 1))
        rest[each, own] -= weight
        marginal = marginal + _xlogx(rest + weight[:, None]) - _xlogx(rest)
    total = side(m, out, into) + side(m.T, into, out) + cross - marginal
    best = total.argmax(1)
    return best, total[each, best] - total[each, own]


def _shift(m: np.ndarray, a: int, b: int, out: np.ndarray, into: np.ndarray, loops: float) -> None:
    """Moves a unit's bigrams in ``m`` from class a to class b."""
    out, into = out.copy(), into.copy()
    out[a] -= loops
    into[a] -= loops
    m[a] -= out
    m[:, a] -= into
    m[a, a] -= loops
    m[b] += out
    m[:, b] += into
    m[b, b] += loops
    np.maximum(m, 0, out=m)


def _steps(n: int) -> list[tuple[int, int]]:
    """Stretches of a block's units, frequent ones first: few at a time where a move weighs much, up to ``STEP`` later."""
    out, begin = [], 0
    while begin < n:
        end = min(n, begin + min(STEP, 1 + begin // 4))
        out.append((begin, end))
        begin = end
    return out


def _information(m: np.ndarray) -> float:
    """Mutual information of neighbouring classes times the number of bigrams: the likelihood's part that classes change."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum() + _xlogx(m.sum()))


def cluster(bigrams: DataFrame, units: Units, classes: int = CLASSES, rounds: int | None = None, gain_share: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the class bigram counts (classes x classes); no more than ``rounds`` rounds if given."""
    spark = bigrams.sparkSession
    total = np.concatenate([units.bin_tokens, units.counts])
    of = np.empty(units.n, np.int64)
    of[np.argsort(-total, kind="stable")] = np.minimum(np.arange(units.n), classes - 1)  # frequent units found the classes, the others leave the last one
    size = units.n

    def matrix(of: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(of)

        def run(frames):
            m = np.zeros(classes * classes)
            for pdf in frames:
                for packed in zip(pdf["out_pairs"], pdf["out_n"]):
                    keys, n = _unpack(*packed)
                    first, then = _split(keys, size)
                    m += np.bincount(held.value[first] * classes + held.value[then], n, classes * classes)
            yield pd.DataFrame({"m": [m.tobytes()]})

        parts = [np.frombuffer(r.m, float) for r in bigrams.select("out_pairs", "out_n").mapInPandas(run, "m binary").collect()]  # classes x classes numbers a partition
        return np.sum(parts, 0).reshape(classes, classes) if parts else np.zeros((classes, classes))

    def moved_matrix(of: np.ndarray, new: np.ndarray, turn: int) -> np.ndarray:
        """What the class bigram counts gain when the units of blocks of this turn go from classes ``of`` to ``new``: of their own bigrams only, each once."""
        held = spark.sparkContext.broadcast((of, new))

        def run(frames):
            of, new = held.value
            moves, m = of != new, np.zeros(classes * classes)
            for pdf in frames:
                for row in pdf.itertuples():
                    for side, (keys, n) in enumerate((_unpack(row.out_pairs, row.out_n), _unpack(row.in_pairs, row.in_n))):
                        first, then = _split(keys, size)
                        at = np.flatnonzero(moves[then] & ~moves[first] if side else moves[first])  # a pair of two that move stands with what follows its first one
                        first, then, n = first[at], then[at], n[at]
                        m += np.bincount(new[first] * classes + new[then], n, classes * classes) - np.bincount(of[first] * classes + of[then], n, classes * classes)
            yield pd.DataFrame({"m": [m.tobytes()]})

        mine = bigrams.where(F.col("turn") == turn).select("out_pairs", "out_n", "in_pairs", "in_n")
        parts = [np.frombuffer(r.m, float) for r in mine.mapInPandas(run, "m binary").collect()]
        return np.sum(parts, 0).reshape(classes, classes)

    m = matrix(of)
    number, before = 0, _information(m)
    while rounds is None or number < rounds:
        held = spark.sparkContext.broadcast((of, m))

        def run(frames):
            of, m = held.value
            for pdf in frames:
                for row in pdf.itertuples():
                    (out_keys, out_n), (in_keys, in_n) = _unpack(row.out_pairs, row.out_n), _unpack(row.in_pairs, row.in_n)
                    sides = [(*_split(out_keys, size), out_n), (*_split(in_keys, size)[::-1], in_n)]
                    place = np.zeros(size, np.int64)
                    for mine, _, _ in sides:
                        place[mine] = 1
                    own = np.flatnonzero(place)
                    place[own] = np.arange(len(own))
                    counts = [np.bincount(place[mine] * classes + of[other], n, len(own) * classes).reshape(len(own), classes) for mine, other, n in sides]
                    loops = np.zeros(len(own))
                    mine, other, n = sides[0]
                    loops[place[mine[mine == other]]] = n[mine == other]
                    now, moves = m.copy(), []
                    order = np.argsort(-counts[1].sum(1), kind="stable")
                    for begin, end in _steps(len(order)):  # a step's own moves count at once for the next
                        at = order[begin:end]
                        best, gain = _best_moves(now, of[own[at]], counts[0][at], counts[1][at], loops[at])
                        for i, b in zip(at[(gain > 1e-6) & (best != of[own[at]])].tolist(), best[(gain > 1e-6) & (best != of[own[at]])].tolist()):
                            moves.append((int(own[i]), b))
                            _shift(now, int(of[own[i]]), b, counts[0][i], counts[1][i], float(loops[i]))
                    yield pd.DataFrame(moves, columns=["unit", "cls"]).astype("int64")

        moved = bigrams.where(F.col("turn") == number % STRIDE).drop("block", "turn").mapInPandas(run, "unit long, cls long").toPandas()
        if len(moved):
            new = of.copy()
            new[moved["unit"].to_numpy()] = moved["cls"].to_numpy()
            of, m = new, m + moved_matrix(of, new, number % STRIDE)  # whole numbers: exact
        number += 1
        if number % STRIDE == 0:  # every block has moved
            now = _information(m)
            if now - before <= gain_share * now:
                return of, m
            before = now
    return of, m


@dataclass(frozen=True)
class Model:
    units: Units
    unit_class: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(unit | class); for a bin also less log10 of the bin's word total
    base: np.ndarray  # log10 of the base probability of a frequent word; of a rare word's denominator, in the bins
    end: int


def fit(train: DataFrame, share: float = 0.0, classes: int = CLASSES, rounds: int | None = None, gain_share: float = GAIN, bucket_entries: int = BUCKET_ENTRIES) -> Model:
    """Counts, clustering and smoothed tables from ``train`` (text; null counts as empty).  No rows: uniform tables."""
    units = count_words(train, share, _buckets(train, bucket_entries))
    bigrams = _unit_bigrams(train, units)
    of, m = cluster(bigrams, units, classes, rounds, gain_share)
    total = np.concatenate([units.bin_tokens, units.counts]).astype(float)
    into = m.sum(0)
    prior = (into + 0.5) / (into.sum() + 0.5 * classes)
    transition = np.log10((m + TRANSITION * prior) / (m.sum(1, keepdims=True) + TRANSITION))
    in_class, members = np.bincount(of, total, classes), np.bincount(of, minlength=classes)
    emission = np.log10((total + UNIT) / (in_class + UNIT * members)[of])
    emission[:BINS] -= np.log10(units.bin_tokens + WORD_COUNT * (units.bin_kinds + 1))
    denominator = np.log10(units.tokens + WORD_COUNT * (units.kinds + 1))
    base = np.concatenate([np.full(BINS, -denominator), np.log10(units.counts + WORD_COUNT) - denominator])
    return Model(units, of, transition, emission, base, int(units.of(np.array([END]), np.zeros(1, np.int64))[0]))


def _buckets(docs: DataFrame, entries: int) -> int:
    return int((docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6 / entries) + 1


def score(docs: DataFrame, model: Model, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, is_train, n_tokens, n_known, base_score, score of every row of ``docs`` (doc_id, text, is_train).

    The training rows must be among ``docs``: rare words are counted where they meet.  Null and empty
    texts have one token, the end.  Repeated ids are rows of their own.
    """
    held = whole_texts(docs).sparkContext.broadcast(model)
    n_buckets = _buckets(docs, 2 * bucket_entries)
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def run(batches):
        m, u = held.value, held.value.units
        for number, batch in enumerate(slices(batches)):
            key = TaskContext.get().partitionId() << 32 | number
            ids, train = batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
            local = np.zeros((4, len(ids)))  # tokens, known, base, score
            rare, rare_doc = [], []
            for first, counts, hashes, bins in _chunks(text_bytes(batch.column(1))):
                unit = u.of(hashes, bins)
                own = np.repeat(np.arange(len(counts)), counts)
                is_rare = unit < BINS
                rare.append(hashes[is_rare])
                rare_doc.append((own[is_rare] + first).astype(np.int32))
                seq, begins = _with_ends(counts, unit, m.end)
                before = np.concatenate([[m.end], seq[:-1]])
                before[begins] = m.end
                cls = m.unit_class
                terms = m.transition[cls[before], cls[seq]] + m.emission[seq]
                here = slice(first, first + len(counts))
                local[0, here] = counts + 1
                local[1, here] = np.add.reduceat((seq >= BINS).astype(float), begins)
                local[2, here] = np.add.reduceat(m.base[seq], begins)
                local[3, here] = np.add.reduceat(terms, begins)
            if m.end < BINS:  # no training text: the end is a word never seen
                local[2:] += np.log10(WORD_COUNT)
            rows = [(0, key, 0, local.tobytes(), np.array([_NULL if i is None else i for i in ids], np.int64).tobytes(), train.tobytes())]
            rare, rare_doc = np.concatenate(rare), np.concatenate(rare_doc)
            bucket = (rare % np.uint64(n_buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            rare, rare_doc = rare[by], rare_doc[by]
            rows += [(b, key, 1, rare[x:y].tobytes(), rare_doc[x:y].tobytes(), train.tobytes()) for b, x, y in _runs(bucket[by])]
            rows[0] = (key % n_buckets, *rows[0][1:])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[pdf["kind"] == 0][["batch", "kind", "a", "b", "c"]]
        rare = pdf[pdf["kind"] == 1]
        if not len(rare):
            return out
        words = [np.frombuffer(x, np.uint64) for x in rare["a"]]
        docs_ = [np.frombuffer(x, np.int32) for x in rare["b"]]
        trains = [np.frombuffer(x, bool) for x in rare["c"]]
        all_ = np.concatenate(words)
        trained = np.concatenate([t[d] for t, d in zip(trains, docs_)])
        known, count = _summed(all_[trained])
        rows, begin = [], 0
        for batch, w, d, t in zip(rare["batch"], words, docs_, trains):
            if len(known):
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                c = np.where(known[at] == w, count[at], 0)
            else:
                c = np.zeros(len(w), np.int64)
            own, of = np.unique(d, return_inverse=True)
            sums = np.stack([np.bincount(of, np.log10(c + WORD_COUNT)), np.bincount(of, (c > 0).astype(float))])
            rows.append((batch, 1, sums.tobytes(), own.astype(np.int32).tobytes(), None))
        return pd.concat([out, pd.DataFrame(rows, columns=out.columns)])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["kind"] == 0].iloc[0]
        ids, train = np.frombuffer(head["b"], np.int64), np.frombuffer(head["c"], bool)
        local = np.frombuffer(head["a"], float).reshape(4, -1).copy()
        for row in pdf[pdf["kind"] == 1].itertuples():
            own = np.frombuffer(row.b, np.int32)
            logs, known = np.frombuffer(row.a, float).reshape(2, -1)
            local[1, own] += known
            local[2, own] += logs
            local[3, own] += logs
        return pd.DataFrame({"doc_id": pd.array([None if i == _NULL else i for i in ids.tolist()], dtype="Int64"), "is_train": train, "n_tokens": local[0].astype(np.int64), "n_known": local[1].astype(np.int64), "base_score": local[2], "score": local[3]})

    cells = docs.select("doc_id", "text", "is_train").mapInArrow(run, "bucket int, batch long, kind int, a binary, b binary, c binary")
    met = cells.groupBy("bucket").applyInPandas(meet, "batch long, kind int, a binary, b binary, c binary")
    return met.groupBy("batch").applyInPandas(finish, "doc_id long, is_train boolean, n_tokens long, n_known long, base_score double, score double")


_NULL = np.iinfo(np.int64).min


def is_training(doc_id: str | Column) -> Column:
    return remainder(doc_id, 5) != 1


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", is_training("doc_id").alias("is_train"))
    model = fit(docs.where("is_train"))
    out = score(docs, model)
    return out.select("doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.units.tokens).cast("long").alias("train_tokens"), "base_score", "score")
