"""Ranked lexical search over bit-sliced Bloom signatures.

Index: a document's signature holds an entry for each term and each level of its
count (``LEVELS``: at least 1, 2, 3, 4, 6, 8, 12 ... times).  Documents whose
signatures have one width are laid together, up to ``BLOCK_BITS`` bits a block,
and a block is stored by slices: slice b has one bit a document, set if its signature
has bit b.  Beside the blocks stand how many documents hold each term.

Search: the conjunction of an entry's slices says which documents may hold the term
that often, never leaving one out.  What a level can add to a score, weighted and
summed over an item's terms, bounds each document's score from above.  The documents of
the highest bounds are scored exactly; the tenth best of these is what others must
reach, and all whose bound reaches it are scored exactly from their whole texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soripark.llm.common import forget, saved, slices, small, table, text_bytes, whole_texts
from soripark.llm.hashing import batches_of, mix

#: Least counts of the levels; the last level stands for all higher counts.
LEVELS = np.array([1, 2, 3, 4] + [x << k for k in range(1, 29) for x in (3, 4)], np.int64)
#: Bits a signature has for each entry, at least; three are set.
ENTRY_BITS = 16
PROBES = 3
MOST_WIDTH_BITS = 21
BLOCK_BITS = 1 << 20
#: Terms of different items that one round of search holds, on the driver and in each task.
ROUND_TERMS = 1 << 18
#: Documents scored first for each item, as a multiple of the asked number.
FIRST = 3
_FLUSH = 1 << 19
_PROBE = np.arange(PROBES, dtype=np.uint64) * np.uint64(21)
_INDEX = "key long, n_docs long, width int, slices binary, doc_id binary, known binary, size binary"
_SCALE = 10**9
_POWER = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.Generator(np.random.PCG64(12)).integers(1, 2**64, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_LETTER[[x for x in range(128) if not chr(x).isalnum()]] = 0


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of texts laid end to end, and each one's text: bytes of letters, digits and of other scripts in a row, A-Z as a-z."""
    value = _LETTER[np.frombuffer(b" ".join(texts), np.uint8)]
    edge = np.diff(value > 0, prepend=False, append=False)
    starts, ends = np.flatnonzero(edge).reshape(-1, 2).T
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    inner = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(inner, size)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(size.max()), _POWER)))
    hashes = mix(np.add.reduceat(value[value > 0] * power[within], inner))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return hashes, np.searchsorted(begins, starts, "right") - 1


def _counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each text's distinct terms."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, np.int64)
    return t[first], h[first], np.diff(first, append=len(h))


def _entries(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return mix(hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _places(entries: np.ndarray, width: int) -> np.ndarray:
    """The bits of each entry in signatures of ``width`` bits: PROBES columns."""
    return ((entries[:, None] >> _PROBE) & np.uint64(width - 1)).astype(np.int64)


class _Blocks:
    """Documents of one task, gathered by the width of their signatures."""

    def __init__(self):
        self.held = defaultdict(list)

    def add(self, width: int, doc_id, size: int, entries: np.ndarray):
        docs = self.held[width]
        docs.append((doc_id, size, entries))
        if len(docs) * width >= BLOCK_BITS:
            yield self.block(width)

    def rest(self):
        for width in sorted(self.held):
            if self.held[width]:
                yield self.block(width)

    def block(self, width: int) -> dict:
        docs = self.held.pop(width)
        bits = np.zeros((width, -(-len(docs) // 8) * 8), bool)
        who = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
        bits[_places(np.concatenate([d[2] for d in docs]), width), who[:, None]] = True
        known = np.array([d[0] is not None for d in docs])
        ids = np.array([d[0] or 0 for d in docs], np.int64)
        return {"width": width, "slices": np.packbits(bits, axis=1).tobytes(), "doc_id": ids.tobytes(), "known": known.tobytes(), "size": np.array([d[1] for d in docs], np.int64).tobytes()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "n_docs": pa.int64(), "width": pa.int32()}
    names = [x.split()[0] for x in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.binary())) for n in names], names)


def _counts_batch(hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in _INDEX.split(", ")]
    nothing = {"width": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))] + [pa.nulls(len(n), nothing.get(x, pa.binary())) for x in names[2:]], names)


def _index_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, seen = _Blocks(), []
    held = 0
    for batch in slices(batches):
        ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
        for a, b in batches_of(texts):
            hashes, text = _terms(texts[a:b])
            size = np.bincount(text, minlength=b - a)
            who, term, count = _counted(hashes, text)
            terms, docs = np.unique(term, return_counts=True)
            seen.append((terms, docs))
            held += len(terms)
            levels = np.searchsorted(LEVELS, count, "right")
            # one entry a level, the levels of a term one after another
            level = np.arange(int(levels.sum())) - np.repeat(np.cumsum(levels) - levels, levels)
            entries = _entries(np.repeat(term, levels), level)
            ends = np.searchsorted(np.repeat(who, levels), np.arange(b - a), "right")
            begin = 0
            for i, end in enumerate(ends.tolist()):
                if end > begin:
                    width = 1 << min(MOST_WIDTH_BITS, max(6, int(ENTRY_BITS * (end - begin) - 1).bit_length()))
                    yield from map(lambda x: _batch([x]), blocks.add(width, ids[a + i], int(size[i]), entries[begin:end].copy()))
                begin = end
            if held >= _FLUSH:
                yield _summed(seen)
                seen, held = [], 0
    if seen:
        yield _summed(seen)
    for block in blocks.rest():
        yield _batch([block])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    keys, place = np.unique(keys, return_inverse=True)
    return _counts_batch(keys, np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64))


@dataclass(frozen=True)
class Index:
    """``parts``: signature blocks, and rows of a term's hash with a number of documents, to be added up."""

    parts: DataFrame
    docs: DataFrame
    n_docs: int
    n_terms: int

    def forget(self) -> None:
        forget(self.parts)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Reads every whole text once.  Documents without a term (null and empty ones too) are in no block."""
    whole_texts(docs)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = saved(docs.mapInArrow(_index_part, _INDEX))

    @F.arrow_udf("struct<n: long, size: long>")
    def sums(size: pa.Array) -> pa.Array:
        held = [np.frombuffer(x.as_buffer(), np.int64) for x in size]
        return pa.StructArray.from_arrays([pa.array([len(x) for x in held], pa.int64()), pa.array([int(x.sum()) for x in held], pa.int64())], ["n", "size"])

    total = parts.where("width is not null").select(sums("size").alias("s")).agg(F.sum("s.n").alias("n"), F.sum("s.size").alias("size")).first()
    return Index(parts, docs, total.n or 0, total.size or 0)


@dataclass
class _Query:
    """Items of one round; ``terms`` are sorted hashes, ``of`` and ``weight`` each item's terms by place."""

    names: list
    terms: np.ndarray
    of: list[np.ndarray]
    weight: list[np.ndarray]
    n_docs: int
    n_terms: int
    k: int
    floor: np.ndarray | None = None

    @property
    def heaviest(self) -> int:
        return max(int(w.sum()) for w in self.weight)

    def length(self, size: np.ndarray) -> np.ndarray:
        """The contract's m of documents of so many terms."""
        return 10 + (90 * size.astype(object) * self.n_docs // self.n_terms).astype(np.int64) if int(size.max(initial=0)) * self.n_docs > 1 << 56 else 10 + 90 * size * self.n_docs // self.n_terms


def _share(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (_SCALE * count) // (1000 * count + 8 * m)


class _Best:
    """The best few (value, id) a task has met for each item: highest value first, then least id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64),) * 3 for _ in range(n_items)]

    def add(self, item: int, value: np.ndarray, unknown: np.ndarray, doc: np.ndarray):
        value, unknown, doc = (np.concatenate(x) for x in zip(self.rows[item], (value, unknown, doc)))
        best = np.lexsort((doc, unknown, -value))[: self.k]
        self.rows[item] = value[best], unknown[best], doc[best]

    def least(self, item: int) -> int:
        held = self.rows[item][0]
        return int(held[-1]) if len(held) == self.k else 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        for item, (value, unknown, doc) in enumerate(self.rows):
            if len(value):
                ids = pa.array(doc, pa.int64(), mask=unknown > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), item), pa.int32()), pa.array(value), ids], ["item", "value", "doc_id"])


def _bounds(query: _Query, row: dict) -> Iterator[tuple[int, np.ndarray]]:
    """For each item the upper bound of every document of a block."""
    size = np.frombuffer(row["size"], np.int64)
    width, n = row["width"], len(size)
    cells = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
    m = query.length(size)
    exact = np.float32 if query.heaviest < 1 << 24 else np.float64
    bounds = [np.zeros(n, np.int64) for _ in query.of]
    alive, bits, before = np.arange(len(query.terms)), None, np.zeros(n, np.int64)
    for level in range(len(LEVELS)):
        places = _places(_entries(query.terms[alive], level), width)
        now = np.bitwise_and.reduce(cells[places], axis=1)
        if bits is not None:
            now &= bits  # a term that often is there less often too
        keep = now.any(axis=1)
        alive, bits = alive[keep], now[keep]
        if not len(alive):
            break
        most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else None
        share = _share(np.minimum(most, size), m) if most is not None else _share(size, m)
        dense = np.unpackbits(bits, axis=1)[:, :n].astype(exact)
        slot = np.full(len(query.terms), -1)
        slot[alive] = np.arange(len(alive))
        for item, (terms, weight) in enumerate(zip(query.of, query.weight)):
            at = slot[terms]
            here = at >= 0
            if here.any():
                bounds[item] += (weight[here].astype(exact) @ dense[at[here]]).astype(np.int64) * (share - before)
        before = share
    yield from enumerate(bounds)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _promising(index: Index, query: _Query) -> DataFrame:
    """item, doc_id of the highest bounds."""
    held = index.parts.sparkSession.sparkContext.broadcast(query)

    def scan(batches):
        query, best = held.value, _Best(len(held.value.names), FIRST * held.value.k)
        for row in _rows(batches):
            ids, unknown = np.frombuffer(row["doc_id"], np.int64), 1 - np.frombuffer(row["known"], np.int8).astype(np.int64)
            for item, bound in _bounds(query, row):
                at = np.flatnonzero(bound >= best.least(item))
                if len(at):
                    best.add(item, bound[at], unknown[at], ids[at])
        yield from best.batches()

    return _leaders(_blocks(index).mapInArrow(scan, "item int, value long, doc_id long"), FIRST * query.k).select("doc_id").distinct()


def _blocks(index: Index) -> DataFrame:
    return index.parts.where("width is not null").select("width", "slices", "doc_id", "known", "size")


def _leaders(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("value"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reaching(index: Index, query: _Query) -> DataFrame:
    """doc_id of every document whose bound for some item reaches what it must."""
    held = index.parts.sparkSession.sparkContext.broadcast(query)

    def scan(batches):
        query = held.value
        for row in _rows(batches):
            ids, known = np.frombuffer(row["doc_id"], np.int64), np.frombuffer(row["known"], bool)
            reach = np.zeros(len(ids), bool)
            for item, bound in _bounds(query, row):
                reach |= bound >= query.floor[item]
            yield pa.RecordBatch.from_arrays([pa.array(ids[reach], pa.int64(), mask=~known[reach])], ["doc_id"])

    return _blocks(index).mapInArrow(scan, "doc_id long").distinct()


def _scored(index: Index, wanted: DataFrame, query: _Query) -> DataFrame:
    """item, value, doc_id, rank: the best k by exact score of the wanted documents' whole texts."""
    wanted = saved(wanted)
    held = index.parts.sparkSession.sparkContext.broadcast(query)

    def score(batches):
        query, best = held.value, _Best(len(held.value.names), held.value.k)
        holders = defaultdict(list)
        for item, terms in enumerate(query.of):
            for place, term in enumerate(terms.tolist()):
                holders[term].append((item, place))
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in batches_of(texts):
                hashes, text = _terms(texts[a:b])
                m = query.length(np.bincount(text, minlength=b - a).astype(np.int64))
                at = np.minimum(np.searchsorted(query.terms, hashes), len(query.terms) - 1)
                hit = query.terms[at] == hashes
                who, term, count = _counted(at[hit].astype(np.uint64), text[hit])
                share = _share(count, m[who])
                unknown = np.array([x is None for x in ids[a:b]], np.int64)
                doc = np.array([x or 0 for x in ids[a:b]], np.int64)
                total = {}
                order = np.argsort(term, kind="stable")
                cuts = np.flatnonzero(np.diff(term[order], prepend=np.uint64(2**63)))
                for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
                    rows = order[x:y]
                    for item, place in holders[int(term[rows[0]])]:
                        sums = total.setdefault(item, np.zeros(b - a, np.int64))
                        sums[who[rows]] += query.weight[item][place] * share[rows]
                for item, sums in total.items():
                    at = np.flatnonzero(sums >= max(1, best.least(item)))
                    if len(at):
                        best.add(item, sums[at], unknown[at], doc[at])
        yield from best.batches()

    near = small(wanted, wanted.count())
    texts = index.docs.join(near.withColumnRenamed("doc_id", "__sp_wanted"), F.col("doc_id").eqNullSafe(F.col("__sp_wanted")), "left_semi")
    return _leaders(texts.mapInArrow(score, "item int, value long, doc_id long"), query.k)


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id and its distinct terms' hashes; an item without a term has no row."""

    def split(batches):
        for batch in slices(batches):
            texts = text_bytes(batch.column(1))
            for a, b in batches_of(texts):
                who, term, _ = _counted(*_terms(texts[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + who)), pa.array(term.view(np.int64))], ["item_id", "key"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(split, f"item_id {_kind(rows)}, key long").distinct()


def _kind(items: DataFrame) -> str:
    return items.schema["item_id"].dataType.simpleString()


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents of score above 0, ties to smaller doc_id, null ids last.

    Rows of equal item_id make one item.  Items without a term (null and empty texts too) and empty tables give
    no row.  Documents of one doc_id are ranked each on its own.  Items are searched in rounds of some
    ``ROUND_TERMS`` terms, each against the whole index; the items of a round are all that the driver holds.
    """
    spark = index.parts.sparkSession
    terms = saved(_item_terms(items, item_id, text))
    counts = index.parts.where("width is null").groupBy("key").agg(F.sum("n_docs").alias("df"))
    n_terms = terms.count()
    weight = F.floor(F.lit(1000) * F.log((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = saved(counts.join(small(terms, n_terms), "key").select("item_id", "key", weight.cast("long").alias("weight")))
    rounds = n_terms // ROUND_TERMS + 1
    out = spark.createDataFrame([], f"item_id {_kind(weighed)}, rank int, doc_id long, score long")
    for part in range(rounds):
        found = _one_round(index, weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == part), k)
        out = found if part == 0 and found is not None else out.unionByName(found) if found is not None else out
    forget(terms, weighed)
    return out


def _one_round(index: Index, weighed: DataFrame, k: int) -> DataFrame | None:
    """The best documents of the items of one round, or None where no document holds a term of theirs."""
    got, spark = weighed.toArrow(), weighed.sparkSession
    if not got.num_rows:
        return None
    ids, keys, weights = got.column("item_id").to_pylist(), got.column("key").to_numpy().view(np.uint64), got.column("weight").to_numpy()
    names = sorted(set(ids), key=lambda x: (x is None, x if x is not None else 0))
    place = {x: i for i, x in enumerate(names)}
    vocabulary = np.unique(keys)
    who = np.array([place[x] for x in ids])
    order = np.argsort(who, kind="stable")
    cuts = np.searchsorted(who[order], np.arange(1, len(names)))
    at = np.searchsorted(vocabulary, keys)
    query = _Query(names, vocabulary, np.split(at[order], cuts), np.split(weights[order], cuts), index.n_docs, index.n_terms, k)
    first = saved(_scored(index, _promising(index, query), query))
    least = first.where(F.col("rank") == k).select("item", "value").collect()  # one row an item of this round
    query.floor = np.ones(len(names), np.int64)
    for row in least:
        query.floor[row.item] = max(1, row.value)
    forget(first)
    best = _scored(index, _reaching(index, query), query)
    label = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {_kind(weighed)}")
    return best.join(small(label, len(names)), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("value").alias("score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents"))
    best = search(index, table(spark, sf_dir, "benchmark"))
    index.forget()
    return best


OP12_SQL = r"""
with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
t as (select doc_id, term, count(*) as tf from d group by all),
z as (select doc_id, count(*) as n from d group by all),
c as (select count(*) as docs, sum(n)::bigint as terms from z),
f as (select term, count(*) as df from t group by all),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
w as (select item_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from i join f using (term), c),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
      from w join t using (term) join z using (doc_id), c group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""
