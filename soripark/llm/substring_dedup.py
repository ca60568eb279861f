"""Removal of repeated word windows, with a count-min prefilter.

First pass: each window of ``width`` words is stood for by the smallest-hash
``GRAM``-word run in it.  Equal windows have equal such runs, so the count of the
run, and the sketch's count above it, is never below the count of the window.
The runs picked by any window (one in seven places) fill partition sketches.
Second pass: windows whose run is counted once are done; the others are grouped
exactly by 128 bits of hash over their words.  Within a batch only a window's
first place travels on, later ones are settled there; so a window in very many
documents sends one entry a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm import sketch
from soripark.llm.common import give_back, slices, table, text_bytes, tidy, whole_texts
from soripark.llm.hashing import batch_word_hashes, batches_of, mix, shingle_hashes

WIDTH = 20
GRAM = 8
SKETCH_ROWS = 2
#: Entries that one task groups at a time, on average.
BUCKET_ENTRIES = 150_000
_NO_ID = np.iinfo(np.int64).min


def _slide(values: np.ndarray, width: int, fn) -> np.ndarray:
    """fn over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = fn(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _windows(texts: list[bytes], width: int, gram: int):
    """Per chunk of texts: first text, word counts, word hashes, run hashes, each window's smallest run and whether the window lies in one text."""
    for a, b in batches_of(texts):
        words, counts = batch_word_hashes(texts[a:b])
        n = len(words) - width + 1
        if n <= 0:
            continue
        runs = shingle_hashes(words, gram)
        least = _slide(runs, width - gram + 1, np.minimum)[:n]
        inside = np.zeros(n, bool)
        ends = np.cumsum(counts)
        for begin, end in zip((ends - counts)[counts >= width].tolist(), ends[counts >= width].tolist()):
            inside[begin : end - width + 1] = True
        yield a, counts, words, runs, least, inside


def _picked(runs: np.ndarray, least: np.ndarray, inside: np.ndarray, span: int) -> np.ndarray:
    """Hashes of the places that are the smallest run of some window, each place once."""
    held = np.where(inside, least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    most = _slide(np.concatenate([pad, held, pad]), span, np.maximum)[: len(runs)]
    return runs[: len(most)][(most == runs[: len(most)]) & (most > 0)]


def _first_places(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Sorts entries by key and place; the order, where keys begin, and which entries come after their key's first place."""
    order = np.lexsort((start, doc, key2, key))
    k, k2, d, s = key[order], key2[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=len(order))
    late = (d != np.repeat(d[begin], size)) | (s != np.repeat(s[begin], size))
    return order, late


_ENTRY = [("key", np.uint64), ("key2", np.uint64), ("doc", np.int64), ("text", np.int64), ("start", np.int32)]
_COLUMNS = "bucket int, key binary, key2 binary, doc binary, text binary, start binary, settled boolean"


def _row(bucket: int, arrays: dict, settled: bool) -> tuple:
    return (bucket, *(arrays[n].astype(t).tobytes() for n, t in _ENTRY), settled)


def _marks(doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """One row a document: its settled window starts, packed."""
    order = np.lexsort((start, text, doc))
    doc, text, start = doc[order], text[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    parts = np.split(start.astype(np.int32), begin[1:]) if len(doc) else []
    return pd.DataFrame({"doc_id": doc[begin], "text_hash": text[begin], "starts": [p.tobytes() for p in parts]})


def later_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bits: int | None = None, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, text_hash, starts (packed int32): the windows whose words also start earlier.

    ``docs``: doc_id long (null sorts first), text, text_hash.  Earlier means a smaller doc_id, or the
    same doc_id and a smaller start.  Rows with one doc_id are one place each: equal rows keep both.
    """
    gram = min(gram, width)
    span = width - gram + 1

    def sampled(batch):
        for _, _, _, runs, least, inside in _windows(text_bytes(batch.column(0)), width, gram):
            yield _picked(runs, least, inside, span)

    n_words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    bits = bits or sketch.bits_for(n_words * 2 / (span + 1), sketch.MOST_FLAG_BITS)
    repeated = sketch.repeated(docs.select("text"), sampled, SKETCH_ROWS, bits)
    n_buckets = int(n_words * 0.3 / bucket_entries) + 1
    held = whole_texts(docs).sparkContext.broadcast(repeated)

    def candidates(batches):
        table_ = [np.frombuffer(x, np.uint8) for x in held.value]
        for batch in slices(batches, 1000):
            ids = np.array([_NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            hashes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            found = {n: [] for n in ("run", *(n for n, _ in _ENTRY))}
            for first, counts, words, _, least, inside in _windows(text_bytes(batch.column(1)), width, gram):
                at = np.flatnonzero(inside)
                at = at[sketch.flagged(table_, least[at], bits)]
                if not len(at):
                    continue
                text = np.repeat(np.arange(len(counts)), counts)[at]
                found["run"].append(least[at])  # equal windows share it, and neighbours mostly do: it deals them out
                found["key"].append(shingle_hashes(words, width, 0)[at])
                found["key2"].append(shingle_hashes(words, width, 1)[at])
                found["doc"].append(ids[first + text])
                found["text"].append(hashes[first + text])
                found["start"].append((at - (np.cumsum(counts) - counts)[text]).astype(np.int32))
            if not found["key"]:
                continue
            e = {n: np.concatenate(x) for n, x in found.items()}
            order, late = _first_places(e["key"], e["key2"], e["doc"], e["start"])
            e = {n: x[order] for n, x in e.items()}
            out = []
            by = np.where(late, (e["text"].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64), (mix(e["run"]) % np.uint64(n_buckets)).astype(np.int64)) * 2 + late
            order = np.lexsort((e["start"], e["text"], e["doc"], by))
            e, by = {n: x[order] for n, x in e.items()}, by[order]
            begin = np.flatnonzero(np.diff(by, prepend=-1))
            for a, b, i in zip(begin.tolist(), np.append(begin[1:], len(by)).tolist(), by[begin].tolist()):
                part = {n: x[a:b] for n, x in e.items()}
                if i & 1:
                    part["key"] = part["key2"] = part["key"][:0]
                out.append(_row(i // 2, part, bool(i & 1)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["bucket", "key", "key2", "doc", "text", "start", "settled"]), schema=pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n, _ in _ENTRY] + [("settled", pa.bool_())]), preserve_index=False)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        def joined(rows):
            return {n: np.concatenate([np.frombuffer(x, t) for x in rows[n]]) if len(rows) else np.zeros(0, t) for n, t in _ENTRY}

        done, open_ = joined(pdf[pdf["settled"]]), joined(pdf[~pdf["settled"]])
        order, late = _first_places(open_["key"], open_["key2"], open_["doc"], open_["start"])
        late = order[late]
        return _marks(*(np.concatenate([done[n], open_[n][late]]) for n in ("doc", "text", "start")))

    entries = docs.select("doc_id", "text", "text_hash").mapInArrow(tidy(candidates), _COLUMNS)
    return entries.groupBy("bucket").applyInPandas(settle, "doc_id long, text_hash long, starts binary")


def _kept(text: str | None, starts, width: int) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    if not starts:
        return len(words), 0, b" ".join(words).decode()
    change = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.concatenate([np.frombuffer(s, np.int32) for s in starts]))
    change[at] += 1
    change[at + width] -= 1
    removed = np.cumsum(change)[:-1] > 0
    return len(words), int(removed.sum()), b" ".join(w for w, r in zip(words, removed.tolist()) if not r).decode()


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "kept", digest: bool = False, width: int = WIDTH) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_removed, text (the kept words joined by one space; a SHA-256 of it with ``digest``).

    A word goes if a window of ``width`` words that covers it also starts earlier.  Null and short
    texts lose nothing.  Every other column stays as it is.
    """
    keyed = docs.withColumns({"__sp_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)), "__sp_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    marks = later_windows(keyed.select(F.col("__sp_id").alias("doc_id"), F.col(text).alias("text"), F.col("__sp_hash").alias("text_hash")), width)
    marks = marks.groupBy(F.col("doc_id").alias("__sp_id"), F.col("text_hash").alias("__sp_hash")).agg(F.collect_list("starts").alias("__sp_starts"))
    fields = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("text", pa.string())]

    def kept(texts: pa.Array, starts: pa.Array) -> pa.Array:
        rows = [_kept(t.as_py(), s.as_py(), width) for t, s in zip(texts, starts)]
        last = [hashlib.sha256(x[2].encode()).hexdigest() if digest else x[2] for x in rows]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array(last, pa.string())], fields=fields)

    @F.arrow_udf("struct<n_words: long, n_removed: long, text: string>")
    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield kept(*batch)
        batch = None
        give_back()

    return keyed.join(marks, ["__sp_id", "__sp_hash"], "left").withColumn(into, keep(F.col(text), F.col("__sp_starts"))).drop("__sp_id", "__sp_hash", "__sp_starts")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = without_repeats(docs, digest=True)
    return kept.select("doc_id", "kept.n_words", "kept.n_removed", F.col("kept.text").alias("kept_sha256"))


OP6_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d),
k as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h from p),
f as (select *, row_number() over (partition by h order by doc_id, i) as n from k),
c as (select distinct doc_id, unnest(range(i, i + 20)) as i from f where n > 1),
g as (select doc_id, list(i) as gone from c group by doc_id),
r as (select d.doc_id, w, coalesce(gone, []::bigint[]) as gone from d left join g using (doc_id))
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(gone, i)), ' ')) as kept_sha256
from r
"""
