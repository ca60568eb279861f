"""Periodic runs of words: maximal stretches in which words q apart are identical, and texts with each run cut to its first period.

A run has a smallest period q, at least ``POWER`` periods and ``LEAST`` words, and no
neighbouring word extends it.  Periods below ``DIRECT`` are found by comparing words
q apart.  The others come from string synchronising sets, one a dyadic scale t, for
periods from t to 2t-1.  A place i is in the set if, of the hashes of the t-word
pieces that begin at i..i+t, the least one is at i or at i+t.  Pieces of period t/4 or
less take no part; they lie in the highly periodic runs that smaller scales have
found, which keeps the set sparse.  Membership depends on the 2t words from i on
only, and every t places hold a member unless they lie in such a run.  So a run of
period q >= t and 4q words has members at some i and at i+q with equal words in
their 2t-word contexts, and none of that context between them: neighbours among
members of equal context propose their distance as a period, and comparing words
from there on gives the whole run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import table, text_bytes, whole_texts
from soripark.llm.hashing import batch_word_hashes, batches_of, mix

POWER = 4
LEAST = 6
DIRECT = 8
_BASE = 0x9E3779B97F4A7C15
_NEVER = np.uint64(2**64 - 1)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _stretches(words: np.ndarray, ends: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal stretch of period q, of 4q and of LEAST words, inside one text."""
    same = words[:-q] == words[q:]
    across = (ends[:-1, None] - 1 - np.arange(q)).ravel()
    same[across[across >= 0]] = False
    at = np.flatnonzero(same)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    begin, end = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1 + q
    long = end - begin >= max(LEAST, POWER * q)
    return begin[long], end[long]


def _matching(left: np.ndarray, right: np.ndarray) -> int:
    """How many first entries are equal, looked at in growing pieces."""
    at, piece = 0, 64
    while at < len(left):
        unlike = np.flatnonzero(left[at : at + piece] != right[at : at + piece])
        if len(unlike):
            return at + int(unlike[0])
        at += piece
        piece *= 2
    return len(left)


def _whole_run(words: np.ndarray, at: int, q: int, begin: int, end: int) -> tuple[int, int]:
    """The stretch of period q around ``at`` in the text from ``begin`` to ``end``."""
    ahead = _matching(words[at : end - q], words[at + q : end])
    back = _matching(words[begin:at][::-1], words[begin + q : at + q][::-1])
    return at - back, at + ahead + q


def _members(pieces: np.ndarray, scale: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the synchronising set; ``pieces`` are hashes of the scale's pieces, ``runs`` what smaller scales found."""
    rank = mix(pieces) >> np.uint64(1)
    dense = [(b, e) for b, e, q in runs if 4 * q <= scale <= e - b]
    if dense:
        change = np.zeros(len(rank) + 1, np.int64)
        np.add.at(change, [min(b, len(rank)) for b, _ in dense], 1)
        np.add.at(change, [min(e - scale + 1, len(rank)) for _, e in dense], -1)
        rank[np.cumsum(change[:-1]) > 0] = _NEVER
    least = _least_of(rank, scale + 1)
    n = len(least)
    return np.flatnonzero(((least == rank[:n]) | (least == rank[scale : scale + n])) & (least != _NEVER))


def _scale_runs(words: np.ndarray, ends: np.ndarray, members: np.ndarray, contexts: np.ndarray, scale: int) -> set[tuple[int, int, int]]:
    """Runs of periods from ``scale`` to twice it, from neighbours among members of equal context."""
    limit = ends[np.searchsorted(ends, members, "right")]
    inside = members + 2 * scale <= limit
    members, limit = members[inside], limit[inside]
    context = contexts[members]
    order = np.argsort(context, kind="stable")
    at, period = members[order][:-1], np.diff(members[order])
    good = (np.diff(context[order]) == 0) & (period >= scale) & (period < 2 * scale) & (at + period + 2 * scale <= limit[order][:-1])
    out, last = set(), (0, 0, 0)
    at, period = at[good], period[good]
    for i in np.lexsort((at, period)).tolist():
        place, q = int(at[i]), int(period[i])
        if last[2] == q and last[0] <= place and place + q <= last[1]:
            continue
        text = int(np.searchsorted(ends, place, "right"))
        last = (*_whole_run(words, place, q, int(ends[text - 1]) if text else 0, int(ends[text])), q)
        if last[1] - last[0] >= max(LEAST, POWER * q):
            out.add(last)
    return out


def _ordered_runs(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, period) of all runs of texts laid end to end, longest text first."""
    counts = np.diff(ends, prepend=0)
    runs: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()

    def keep(found):
        for run in sorted(found, key=lambda r: r[2]):
            if run[:2] not in known:  # the same stretch with a smaller period, which divides this one
                known.add(run[:2])
                runs.append(run)

    for q in range(1, DIRECT):
        texts = int(np.count_nonzero(counts >= max(LEAST, POWER * q)))
        if texts:
            upto = ends[:texts]
            begin, end = _stretches(words[: upto[-1]], upto, q)
            keep((b, e, q) for b, e in zip(begin.tolist(), end.tolist()))
    scale, pieces, base = 1, words, np.uint64(_BASE)
    while texts := int(np.count_nonzero(counts >= POWER * scale)):
        upto = ends[:texts]
        pieces = pieces[: max(0, upto[-1] - scale + 1)]
        doubled = pieces[:-scale] * base + pieces[scale:]
        if scale >= DIRECT:
            keep(_scale_runs(words, upto, _members(pieces, scale, runs), doubled, scale))
        scale, pieces, base = 2 * scale, doubled, np.uint64(int(base) ** 2 & (2**64 - 1))
    return runs


def word_runs(words: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each of several texts laid end to end (a number a word): (start, length, period) of its runs, by start and period."""
    order = np.argsort(-counts, kind="stable")
    sizes, begins = counts[order], (np.cumsum(counts) - counts)[order]
    ends = np.cumsum(sizes)
    laid = np.repeat(begins - (ends - sizes), sizes) + np.arange(len(words))
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for begin, end, q in _ordered_runs(words[laid], ends):
        text = int(np.searchsorted(ends, begin, "right"))
        out[int(order[text])].append((begin - int(ends[text] - sizes[text]), end - begin, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The text's words without those that a run holds after its first period, joined by one space."""
    words = text.split()
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            change[start + q] += 1
            change[start + length] -= 1
        words = [w for w, gone in zip(words, (np.cumsum(change) > 0).tolist()) if not gone]
    return b" ".join(words)


def collapse_runs(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``into``: runs (start, length, period; by start, then period) and text, the words without the repeats of any run.

    Words are maximal stretches without space and 0x09-0x0D, told apart by 64-bit hashes.  Null, empty and
    short texts have no run; null gives the empty text.  An existing column ``into`` is replaced.  Whole
    texts are read, whatever their length; each text is worked on alone, so copies need no care.
    """

    @F.arrow_udf("struct<runs: array<struct<start: long, length: long, period: long>>, text: string>")
    def collapse(column: pa.Array) -> pa.Array:
        texts, runs = text_bytes(column), []
        for a, b in batches_of(texts):
            runs += word_runs(*batch_word_hashes(texts[a:b]))
        flat = [run for one in runs for run in one]
        parts = [pa.array([run[i] for run in flat], pa.int64()) for i in range(3)]
        offsets = pa.array(np.cumsum([0] + [len(one) for one in runs]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(_RUN)))
        kept = pa.array([_collapsed(*x).decode() for x in zip(texts, runs)], pa.string())
        return pa.StructArray.from_arrays([lists, kept], ["runs", "text"])

    whole_texts(docs)
    return docs.withColumn(into, collapse(F.col(text)))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the contract's runs in the texts of one in ten ids: words from place a on repeat the p words there.  A null id plants none."""
    code = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(code % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    rows = docs.withColumns({"__sp_g": F.floor(code / 10), "__sp_w": words}).withColumn("__sp_n", F.when(F.size("__sp_w") > 0, F.size("__sp_w")))
    rows = rows.withColumn("__sp_a", (F.col("__sp_g") % F.col("__sp_n")).cast("int"))
    left = F.col("__sp_n") - F.col("__sp_a")
    rows = rows.withColumn("__sp_p", F.lit(1) + F.floor(left / (3 + F.col("__sp_g") % 8)).cast("int"))
    unit = F.slice("__sp_w", F.col("__sp_a") + 1, F.col("__sp_p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(left / F.col("__sp_p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("__sp_w", F.lit(1), F.col("__sp_a")), tail), " ")
    return rows.withColumn("text", F.when(F.col("__sp_n").isNotNull(), planted).otherwise(F.col("text"))).select(*docs.columns)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = collapse_runs(docs).select("doc_id", F.col("periodic.runs").alias("runs"), F.col("periodic.text").alias("kept"))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(F.lit(""))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    rows = rows.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"), "runs_sha256", "collapsed_sha256")
    return rows.withColumn("exponent_milli", F.expr("1000 * length div period"))
