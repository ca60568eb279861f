"""Repeated hashes by ranges: exact whatever the number of hashes, chunks and copies."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from soripark.llm import jaccard_join, sketch, token_ranges


def plain_sets(rows, k=5):
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    return sets


def test_only_repeated_shingles_are_stored_when_flags_would_be_full(spark, monkeypatch):
    """Copies with one word changed among texts of their own: as with many documents, no sketch tells which shingles are single."""
    monkeypatch.setattr(sketch, "bits_for", lambda *a, **b: 6)
    rows = [(i, " ".join(f"own{i}_{j}" for j in range(80))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"base{i // 2}_{j}" if j != 40 or i % 2 else "other" for j in range(80))) for i in range(20)]
    kept, saved = [], jaccard_join.saved

    def counted(df, by=None):
        out = saved(df, by)
        if "kept" in out.columns:
            kept.append(sum(len(r.kept) for r in out.where("kept is not null").collect()))
        return out

    monkeypatch.setattr(jaccard_join, "saved", counted)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = Counter(s for x in plain_sets(rows) for s in x)
    repeated = [sum(held[s] > 1 for s in x) for x in plain_sets(rows)]
    assert kept and max(kept) == sum(n for n, x in zip(repeated, plain_sets(rows)) if 100 * n >= 75 * len(x))
    assert {r.doc_id: r.component_id for r in got if r.doc_id >= 1000} == {1000 + i: 1000 + i - i % 2 for i in range(20)}


@pytest.mark.parametrize("chunk, per_range", [(1 << 20, 1 << 21), (50, 40)])
def test_repeated_hashes_equal_plain_counts(spark, monkeypatch, chunk, per_range):
    """Sets of one chunk or many, with hashes at both ends, at the borders of ranges, and one in every set."""
    monkeypatch.setattr(token_ranges, "CHUNK", chunk)
    monkeypatch.setattr(token_ranges, "RANGE", per_range)
    rng = np.random.default_rng(3)
    pool = np.concatenate([np.array([0, 1, 2**64 - 1, 2**63, 2**63 - 1], np.uint64), np.arange(1, 128, dtype=np.uint64) << np.uint64(57), rng.integers(0, 2**64, 3000, dtype=np.uint64)])
    own = [np.unique(np.append(rng.choice(pool, rng.integers(0, 30)), pool[7])) for _ in range(300)] + [np.zeros(0, np.uint64)]
    df = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(own)], "id long, x array<long>").repartition(3)

    def sets(batch):
        return [batch.column(0).to_numpy()], [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column(1)]

    def result(header, hashes, counts):
        ends = np.cumsum(counts)
        lists = [hashes[b - n : b].view(np.int64) for b, n in zip(ends.tolist(), counts.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(header[0]), pa.array(lists, pa.list_(pa.int64()))], ["id", "x"])

    got = {r.id: set(r.x) for r in token_ranges.repeated_in(df, lambda: sets, 1, sum(map(len, own)), result, "id long, x array<long>").collect()}
    held = Counter(h for x in own for h in x.view(np.int64).tolist())
    assert got == {i: {h for h in x.view(np.int64).tolist() if held[h] > 1} for i, x in enumerate(own)}


def test_steps_are_packed_and_unpacked():
    for rising in ([5], [0, 2**64 - 1], [2**57 + 1, 2**57 + 2], [2**57, 2**57 + 3, 2**58 - 1]):
        x = np.array(rising, np.uint64)
        for begin in {0, int(x[0])}:
            assert token_ranges.unpacked(token_ranges.packed(x, begin), len(x), begin).tolist() == rising
