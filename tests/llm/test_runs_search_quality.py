import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from soripark.llm import periodic_runs, quality_trees, ranked_search

from edges import SCHEMA, documents, prose


@pytest.fixture(scope="module")
def rows():
    return documents(seed=11)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# periodic runs


def plain_runs(w):
    """All maximal runs by comparing words q apart, for every q."""
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def _laid(texts):
    words = np.array([v + 1 for w in texts for v in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return periodic_runs.word_runs(words, np.array([len(w) for w in texts]))


def test_runs_equal_comparison_of_all_periods():
    rng, n = random.Random(1), 0
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            size, k = rng.choice([0, 1, 5, rng.randint(0, 60), rng.randint(0, 400)]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(k) for _ in range(size)]
            for _ in range(rng.randint(0, 3)):
                if size > 4:
                    a = rng.randrange(size)
                    p = rng.randint(1, max(1, (size - a) // rng.randint(3, 8)))
                    for i in range(a, rng.randint(a, size)):
                        w[i] = w[a + (i - a) % p]
            texts.append(w)
        want = [plain_runs(w) for w in texts]
        assert _laid(texts) == want
        n += sum(map(len, want))
    assert n > 300


@pytest.mark.parametrize("period,times", [(7, 4), (8, 4), (15, 4), (16, 4), (17, 5), (31, 4), (64, 4), (127, 9), (300, 4), (1000, 4.5)])
def test_runs_at_the_edges_of_scales(period, times):
    rng = random.Random(period)
    unit = [rng.randrange(10**6) for _ in range(period)]
    body = (unit * 10)[: int(period * times)]
    w = [-1] + body + [-1, -1]
    for text in (w, body, body[:-1] if times == 4 else body):
        assert _laid([[7] * 50, [v + 2 for v in text]]) == [[(0, 50, 1)], plain_runs(text)]


def test_runs_of_runs_and_fibonacci_words():
    x, y = [0], [0, 1]
    while len(y) < 2000:
        x, y = y, y + x
    nested = ([1] * 9 + [2]) * 6 + [3]
    for w in (y, nested * 7, [5] * 30000, nested * 5 + [4] + nested * 5):
        assert _laid([w])[0] == (plain_runs(w) if len(w) < 5000 else [(0, 30000, 1)])


def planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_run_query_on_awkward_rows(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(periodic_runs.op11(spark, str(tmp_path)).collect(), key=repr)
    want, n_planted = [], 0
    for doc_id, text, *_ in rows:
        w = planted(doc_id, (text or "").encode().split())
        n_planted += w != (text or "").encode().split()
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        want.append((doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, runs)).hexdigest(), 1000 * best[1] // best[2] if runs else None))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_runs, r.start, r.length, r.period, r.runs_sha256, r.collapsed_sha256, r.exponent_milli)) for r in got)
    assert n_planted > 2


def test_collapse_keeps_other_columns_and_takes_empty_tables(docs, empty, rows):
    got = periodic_runs.collapse_runs(docs, into="node")
    assert got.columns == docs.columns and got.count() == len(rows)
    assert periodic_runs.collapse_runs(empty).count() == 0


# ranked search


def plain_terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_ranks(docs, items, k=10):
    counted = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, out))


def items_of(rows, n=12):
    rng = random.Random(4)
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 20]
    items = [(i, " ".join(rng.choice(texts).split()[3:25]) + "! THE, Re-ed é日本") for i in range(n)]
    return items + [(n, None), (n + 1, ""), (n + 2, "-- !"), (None, "the and of"), (3, "again"), (3, "again"), (n + 3, "nobody says xyzzy"), (n + 4, texts[0])]


def searched(docs, items):
    index = ranked_search.build(docs)
    return sorted(repr(tuple(r)) for r in ranked_search.search(index, items).select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_plain_ranking(spark, docs, rows):
    items = items_of(rows)
    want = plain_ranks([r[:2] for r in rows], items)
    table = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, term int")
    assert searched(docs, table) == want
    assert searched(docs.repartition(7), table.repartition(3)) == want


def test_search_with_crowded_signatures_rounds_and_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "MOST_WIDTH_BITS", 8)  # most bits are set: everything is promising, nothing may be lost
    monkeypatch.setattr(ranked_search, "ROUND_TERMS", 60)
    monkeypatch.setattr(ranked_search, "small", lambda df, rows: df)
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert searched(docs, table) == plain_ranks([r[:2] for r in rows], items)


def test_search_with_ties_and_many_copies(spark):
    rng = random.Random(9)
    texts = [prose(rng, "en", 40) for _ in range(30)]
    rows = [(i, texts[0] if i % 3 else texts[i % 30]) for i in range(400, 0, -1)] + [(500, "the " * 3000 + texts[0])]
    items = [(0, texts[0]), (1, texts[5] + " the"), (2, texts[9])]
    got = searched(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain_ranks(rows, items)


def test_search_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert searched(docs, none) == searched(empty, one) == searched(empty, none) == []


def test_bounds_are_never_below_scores(docs, rows):
    """Every signature level: the bound of a single term is its score or more, and exact where no bits clash."""
    index = ranked_search.build(docs)
    terms = np.unique(ranked_search._terms([(r[1] or "").encode() for r in rows])[0])[:200]
    query = ranked_search._Query([0], terms, [np.arange(len(terms))], [np.arange(1, len(terms) + 1)], index.n_docs, index.n_terms, 10)
    by_size = Counter()
    for row in ranked_search._blocks(index).toLocalIterator():
        row = row.asDict()
        for _, bound in ranked_search._bounds(query, row):
            by_size.update(zip(np.frombuffer(row["size"], np.int64).tolist(), bound.tolist()))
    for r in rows:
        hashes = ranked_search._terms([(r[1] or "").encode()])[0]
        if len(hashes):
            m = query.length(np.array([len(hashes)]))
            score = sum(w * int(ranked_search._share(np.array([c]), m)[0]) for w, c in ((i + 1, int((hashes == t).sum())) for i, t in enumerate(terms)) if c)
            assert any(size == len(hashes) and bound >= score for size, bound in by_size)


def test_search_sql_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = sorted(con.sql(ranked_search.OP12_SQL).fetchall())
    assert sorted(tuple(r) for r in ranked_search.op12(spark, folder).select("item_id", "rank", "doc_id", "score").collect()) == want


# quality


def plain_statistics(text):
    w = (text or "").encode().split()
    if not w:
        return [0.0] * len(quality_trees.NAMES)
    s = [x.decode() for x in w]
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) > 127
    upper = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ"
    count = lambda x, f: sum(map(f, x))
    sym, stop = set("#$%&*+<=>@[\\]^_`{|}~/"), set(".!?")
    chars, letters = sum(map(len, s)), sum(count(x, letter) for x in s)
    mark = lambda c: " " < c < "\x7f" and not c.isalnum()
    shout = [count(x, letter) > 1 and count(x, upper) == count(x, letter) for x in s]
    symbols, echo = [count(x, sym.__contains__) for x in s], [i > 0 and w[i] == w[i - 1] for i in range(len(w))]
    bare = [count(x, letter) == 0 for x in s]
    lines = (text or "").split("\n")
    n, parts = len(w), [range(i, min(i + 32, len(w))) for i in range(0, len(w), 32)]

    def variety(k):
        runs = [tuple(w[i : i + k]) for i in range(n - k + 1)]
        return len(set(runs)) / len(runs) if runs else 1.0

    share = lambda p, x: sum(x[i] for i in p)
    size = lambda p: sum(len(s[i]) for i in p)
    return [
        math.log1p(chars), math.log1p(n), chars / n, letters / chars, sum(count(x, upper) for x in s) / max(1, letters), sum(count(x, lambda c: "0" <= c <= "9") for x in s) / chars,
        sum(count(x, mark) for x in s) / chars, sum(symbols) / chars, sum(count(x, stop.__contains__) for x in s) / n, sum(shout) / n, sum(upper(x[0]) for x in s) / n, sum(bare) / n,
        sum(x > 0 for x in symbols) / n, len(set(w)) / n, max(Counter(w).values()) / n, sum(echo) / n, variety(2), variety(5), math.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines),
        max(share(p, shout) / len(p) for p in parts), max(share(p, symbols) / size(p) for p in parts), max(share(p, echo) / len(p) for p in parts), max(share(p, bare) / len(p) for p in parts),
        min(sum(count(s[i], letter) for i in p) / size(p) for p in parts),
    ]


def test_statistics_equal_plain_counts(docs, rows):
    got = quality_trees.statistics(docs, into="node").select("doc_id", "text", "node").collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(r.node, plain_statistics(r.text), atol=1e-5), r.text
    mixed = ["HELLO!! WORLD!! ÉÀ $$$ *** a|b 12 12 12\nx\nx\n", "\n\n", "a\n\na b", "ÉÀ 日本 A"]
    assert np.allclose(quality_trees.text_statistics([t.encode() for t in mixed]), [plain_statistics(t) for t in mixed], atol=1e-5)


def plain_margin(model, row):
    total = model.base
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_trees_equal_plain_walk_and_first_split_is_best():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 12, (300, len(quality_trees.NAMES))).astype(np.float32)
    labels = ((rows[:, 3] > 6) ^ (rng.random(300) < 0.05)).astype(float)
    model = quality_trees.fit(rows, labels, trees=5)
    assert np.allclose(model.margin(rows), [plain_margin(model, r) for r in rows])
    p = (labels.sum() + 1) / (len(labels) + 2)
    slope, curve = p - labels, np.full(300, p * (1 - p))

    def gain(right):
        parts = [(slope[x].sum(), curve[x].sum()) for x in (right, ~right)]
        return sum(g**2 / (h + 1) for g, h in parts) - slope.sum() ** 2 / (curve.sum() + 1) if min(h for _, h in parts) >= 1 else 0

    best = max(gain(rows[:, f] > v) for f in range(rows.shape[1]) for v in range(12))
    assert math.isclose(gain(rows[:, model.feature[0, 0]] > model.threshold[0, 0]), best, rel_tol=1e-9)
    assert ((model.scores(rows) >= 0.5) == (labels == 1)).mean() > 0.9


def test_training_on_odd_labels(spark, docs, empty):
    counted = quality_trees.statistics(docs)
    none = quality_trees.train(counted.selectExpr("doc_id", "statistics", "cast(null as int) as label"))
    assert {r.quality for r in quality_trees.judge(counted, none).collect()} == {0.5}
    ones = quality_trees.train(counted.selectExpr("doc_id", "statistics", "1 as label"))
    assert min(r.quality for r in quality_trees.judge(counted, ones).collect()) > 0.9
    assert quality_trees.judge(quality_trees.statistics(empty), ones).count() == 0


def test_fit_does_not_depend_on_partitions_and_samples_beyond_the_bound(docs):
    counted = quality_trees.statistics(docs).selectExpr("doc_id", "statistics", "int(doc_id % 2) as label").cache()
    one, seven = quality_trees.train(counted.coalesce(1)), quality_trees.train(counted.repartition(7))
    assert np.array_equal(one.leaf, seven.leaf) and np.array_equal(one.threshold, seven.threshold)
    assert np.isfinite(quality_trees.train(counted, sample_rows=20).leaf).all()


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = quality_trees.op13(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(judged) > 80 and sum(a == b for a, b in judged) / len(judged) > 0.93
