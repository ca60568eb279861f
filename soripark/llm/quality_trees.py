"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted from a whole text's bytes, many texts at a time.  Trees are
fitted in one task on at most ``SAMPLE_ROWS`` labelled rows, whose statistics are
sorted into histogram bins; every inner node takes the split of the greatest gain in
log loss.  A model is flat arrays, a tree's nodes in heap order, so scoring walks all
rows down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import remainder, saved, small, table, text_bytes, whole_texts
from soripark.llm.hashing import batch_word_hashes, batches_of, mix

#: Labelled rows a model is fitted on, at most; of more rows a share is drawn by a hash of id and statistics.
SAMPLE_ROWS = 1 << 16
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 64
L2 = 1.0
#: Least sum of second derivatives on both sides of a split.
LEAST_WEIGHT = 1.0
#: Words of the windows whose worst one counts.
WINDOW = 32

NAMES = (
    "log_chars", "log_words", "word_chars", "letters", "upper", "digits", "marks", "symbols", "stops", "shouted_words", "capital_words", "wordless", "marked_words",
    "distinct_words", "commonest_word", "echoed_words", "distinct_pairs", "distinct_fives", "log_lines", "line_words", "distinct_lines",
    "worst_shouted", "worst_symbols", "worst_echoed", "worst_wordless", "best_letters",
)

_CODES = np.arange(256)
_SPACE = np.isin(_CODES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 0xC0)  # the first byte of a character outside ASCII counts as a letter
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_STOP = np.isin(_CODES, [ord(c) for c in ".!?"])
_SYMBOL = np.isin(_CODES, [ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~/"])
_MARK = (_CODES > 32) & (_CODES < 127) & ~_LETTER & ~_DIGIT


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners: how many different keys it has, and how often its commonest one stands."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))) if len(k) else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], np.diff(first, append=len(k)))
    return np.bincount(o[first], minlength=n), most


def _runs(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each run of k words of one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0], owner[:0]
    h = hashes[:n].copy()
    for i in range(1, k):
        h = mix(h) + hashes[i : i + n]
    one = owner[:n] == owner[k - 1 :]
    return h[one], owner[:n][one]


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of NAMES a text; all 0 for a text without a word."""
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    hashes, n_words = batch_word_hashes(texts)
    if not len(hashes):
        return out.astype(np.float32)
    owner = np.repeat(np.arange(n), n_words)
    edge = np.diff(~_SPACE[raw], prepend=False, append=False)
    begin, end = np.flatnonzero(edge).reshape(-1, 2).T

    def of_words(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[end] - total[begin]

    def of_texts(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n)

    after = np.append(raw[1:], 0)
    accented = (raw == 0xC3) & (after >= 0x80) & (after <= 0x9E)  # capital letters of Latin-1
    chars, letters, upper = of_words((raw & 0xC0) != 0x80), of_words(_LETTER[raw]), of_words(_UPPER[raw] | accented)
    digits, marks, symbols, stops = (of_words(x[raw]) for x in (_DIGIT, _MARK, _SYMBOL, _STOP))
    capital = (_UPPER[raw] | accented)[begin]
    shouted = (upper == letters) & (letters > 1)
    echoed = np.append(False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    has = np.maximum(1, n_words)
    n_chars = np.maximum(1, of_texts(chars))
    distinct, most = _distinct(hashes, owner, n)

    def variety(k: int) -> np.ndarray:
        keys, who = _runs(hashes, owner, k)
        total = np.bincount(who, minlength=n)
        return np.where(total > 0, _distinct(keys, who, n)[0] / np.maximum(1, total), 1.0)

    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    first = np.flatnonzero(place % WINDOW == 0)
    width = np.diff(first, append=len(owner))

    def windows(values: np.ndarray, per: np.ndarray, pick, start: float) -> np.ndarray:
        best = np.full(n, start)
        pick.at(best, owner[first], np.add.reduceat(values.astype(float), first) / np.maximum(1, per))
        return np.where(n_words > 0, best, 0.0)

    window_chars = np.add.reduceat(chars, first)
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    columns = [
        np.log1p(of_texts(chars)), np.log1p(n_words), of_texts(chars) / has, of_texts(letters) / n_chars, of_texts(upper) / np.maximum(1, of_texts(letters)),
        of_texts(digits) / n_chars, of_texts(marks) / n_chars, of_texts(symbols) / n_chars, of_texts(stops) / has, of_texts(shouted) / has, of_texts(capital) / has,
        of_texts(letters == 0) / has, of_texts(symbols > 0) / has, distinct / has, most / has, of_texts(echoed) / has, variety(2), variety(5),
        np.log1p(n_lines), n_words / n_lines, np.array([len(set(x)) for x in lines]) / n_lines,
        windows(shouted, width, np.maximum, 0.0), windows(symbols, window_chars, np.maximum, 0.0), windows(echoed, width, np.maximum, 0.0),
        windows(letters == 0, width, np.maximum, 0.0), windows(letters, window_chars, np.minimum, 9.0),
    ]
    return np.where((n_words > 0)[:, None], np.stack(columns, axis=1), 0.0).astype(np.float32)


def statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """``docs`` with an array of floats ``into``, one a name of NAMES, from the whole text.  Null counts as empty; an existing column of that name is replaced."""

    @F.arrow_udf("array<float>")
    def count(column: pa.Array) -> pa.Array:
        texts = text_bytes(column)
        rows = np.concatenate([text_statistics(texts[a:b]) for a, b in batches_of(texts)]) if texts else np.zeros((0, len(NAMES)), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))

    whole_texts(docs)
    return docs.withColumn(into, count(F.col(text)))


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold``: trees x inner nodes in heap order, right where the value is greater; ``leaf``: trees x leaves; ``base`` is the log odds without trees."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(int(len(leaf)).bit_length() - 1):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -700, 700)))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = L2, least: float = LEAST_WEIGHT) -> Trees:
    """Boosts ``trees`` trees.  Of equal gains the first feature and least bin; no gain: all go left.  No rows: score 0.5."""
    n, width = rows.shape
    base = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1))) if n else 0.0
    inner, shape = 2**depth - 1, (trees, 2**depth)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros(shape)
    if not n:
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(rows[:, f], np.arange(1, bins) / bins, method="lower")).astype(np.float32) for f in range(width)]
    cell = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1) + np.arange(width) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            at = (node[:, None] * (width * bins) + cell).ravel()
            size = nodes * width * bins
            g, h = (np.bincount(at, weights=np.repeat(x, width), minlength=size).reshape(nodes, width, bins).cumsum(2) for x in (slope, curve))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9).tolist():
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    feature[t, nodes - 1 + k], threshold[t, nodes - 1 + k] = f, edges[f][b]
            node = 2 * node + (rows[np.arange(n), feature[t, nodes - 1 + node]] > threshold[t, nodes - 1 + node])
        g, h = (np.bincount(node, weights=x, minlength=2**depth) for x in (slope, curve))
        leaf[t] = -rate * g / (h + l2)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def train(rows: DataFrame, features: str = "statistics", label: str = "label", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on rows of label 0 or 1 (others, and null statistics, take no part).

    Of more than ``sample_rows`` rows a share is drawn by a hash of key, statistics and label: rows equal in
    all three are drawn or left together, and never more than twice the bound are taken.  No row: score 0.5.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(features).alias("x"), F.col(label).cast("int").alias("y")).where("x is not null and y in (0, 1)")
    n = rows.count()
    if not n:
        return fit(np.zeros((0, len(NAMES)), np.float32), np.zeros(0))
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("k", "x", "y"), F.lit(1 << 40)) < int(sample_rows / n * (1 << 40))).limit(2 * sample_rows)
    rows = rows.select("x", "y")

    def boost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [np.zeros((0, len(NAMES)), np.float32)], [np.zeros(0, np.int32)]
        for batch in batches:
            x.append(_matrix(batch.column(0)))
            y.append(batch.column(1).to_numpy())
        x, y = np.concatenate(x), np.concatenate(y)
        order = np.lexsort((y, *x.T))  # sums in one order, however the rows came
        model = fit(x[order], y[order].astype(float))
        parts = [[model.base], model.feature.astype(float).ravel(), model.threshold.astype(float).ravel(), model.leaf.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tolist()], pa.list_(pa.float64()))], ["model"])

    flat = np.array(rows.repartition(1).mapInArrow(boost, "model array<double>").first()[0])
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, threshold, leaf = np.split(flat[1:], np.cumsum([TREES * inner, TREES * inner]))
    return Trees(float(flat[0]), feature.astype(np.int64).reshape(TREES, inner), threshold.astype(np.float32).reshape(TREES, inner), leaf.reshape(TREES, leaves))


def judge(docs: DataFrame, model: Trees, features: str = "statistics", into: str = "quality") -> DataFrame:
    """``docs`` with a double ``into`` from 0 to 1, higher where label 1 is likelier."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(held.value.scores(_matrix(column)))

    return docs.withColumn(into, score(F.col(features)))


def held_out(doc_id: str | Column) -> Column:
    return remainder(doc_id, 3) == 1


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = saved(statistics(docs).select("doc_id", "statistics"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = train(counted.where(~held_out("doc_id")).join(small(labels, labels.count()), "doc_id"))
    rows = judge(counted, model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))
