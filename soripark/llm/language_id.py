"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per language on the executors; the driver sees only
the languages x buckets matrix, whose size the two parameters bound.  Scoring
broadcasts the log-probability matrix and adds up its rows for the n-grams of
each whole text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import give_back, remainder, table, tidy, whole_texts

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256
_CHUNK = 1 << 19
_SEP = "\x01\x01"


@dataclass(frozen=True)
class Model:
    """``log_prob`` is buckets x languages (float32); ``prior`` the log share of training documents."""

    languages: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...]


def _chunks(texts: list[str]):
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _CHUNK:
            yield begin, i
            begin, held = i, 0
        held += len(t) + len(_SEP)
    if begin < len(texts):
        yield begin, len(texts)


def _ngram_buckets(texts: list[str], orders: tuple[int, ...], bits: int):
    """For each order the bucket at each code point of the joined texts, and where each text begins.

    Two separators end each text, so no n-gram of up to three characters sees its neighbour.
    """
    lowered = [t.lower() for t in texts]
    begins = np.cumsum([0] + [len(t) + len(_SEP) for t in lowered[:-1]])
    code = np.frombuffer((_SEP.join(lowered) + _SEP + "\x01" * max(orders)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = len(code) - max(orders)
    out = []
    h = np.zeros(size, np.uint64)
    for n in range(1, max(orders) + 1):
        h = (h + code[n - 1 : n - 1 + size] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in orders:
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64))
    return out, begins


def train(docs: DataFrame, text: str = "text", lang: str = "lang", *, orders=ORDERS, bits: int = BUCKET_BITS, alpha: float = 0.5) -> Model:
    """Fit on all rows with a non-null language and text.  No such row: a model without languages."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(langs)), key=langs.__getitem__)
            texts, langs = [texts[i] for i in order], [langs[i] for i in order]
            for a, b in _chunks(texts):
                cuts = [a] + [i for i in range(a + 1, b) if langs[i] != langs[i - 1]] + [b]
                for x, y in zip(cuts, cuts[1:]):
                    total = sums.setdefault(langs[x], np.zeros(1 << bits, np.int64))
                    n_docs[langs[x]] = n_docs.get(langs[x], 0) + y - x
                    for buckets in _ngram_buckets(texts[x:y], orders, bits)[0]:
                        total += np.bincount(buckets, minlength=1 << bits)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n_docs[name]), pa.int64())], ["lang", "bucket", "n"])

    whole_texts(docs)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counted = rows.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return Model((), np.zeros(0), np.zeros((1 << bits, 0), np.float32), tuple(orders))
    place = {x: i for i, x in enumerate(names)}
    which = np.array([place[x] for x in got.column("lang").to_pylist()])
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros((1 << bits, len(names)))
    feature = bucket >= 0
    counts[bucket[feature], which[feature]] = n[feature]
    docs_per = np.zeros(len(names))
    docs_per[which[~feature]] = n[~feature]
    log_prob = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * (1 << bits))
    return Model(tuple(names), np.log(docs_per / docs_per.sum()), log_prob.astype(np.float32), tuple(orders))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Most probable language and its posterior; ``und`` and 0.0 for null, letterless text or an empty model."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    bits = int(model.log_prob.shape[0]).bit_length() - 1
    width = max(1, 4 * _CHUNK // max(4, len(model.languages)))
    for a, b in _chunks([texts[i] for i in known]):
        group = known[a:b]
        orders, begins = _ngram_buckets([texts[i] for i in group], model.orders, bits)
        total = np.tile(model.prior, (len(group), 1))
        for buckets in orders:
            for x in range(0, len(buckets), width):  # a piece of the joined texts; a long text adds up over pieces
                first = np.searchsorted(begins, x, "right") - 1
                last = np.searchsorted(begins, x + width, "left")
                cuts = np.maximum(begins[first:last] - x, 0)
                total[first:last] += np.add.reduceat(model.log_prob[buckets[x : x + width]].astype(np.float64), cuts, axis=0)
        best = total.argmax(1)
        posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for i, k, p in zip(group, best.tolist(), posterior.tolist()):
            names[i], scores[i] = model.languages[k], min(1.0, p)
    return names, scores


def predictor(spark: SparkSession, model: Model):
    """An Arrow UDF text -> struct<lang_pred, score> with the model broadcast."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            names, scores = score_texts(held.value, text.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        text = None
        give_back()

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (lang_pred, score); an existing column of that name is replaced.

    Null or empty text, or text without a letter: ``und`` with score 0.  Equal probabilities: the
    alphabetically first language.  Whole texts are read, whatever their length.
    """
    return docs.withColumn(into, predictor(whole_texts(docs), model)(F.col(text)))


def held_out(doc_id: str | Column) -> Column:
    return remainder(doc_id, 4) == 2


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))
