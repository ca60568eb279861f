import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from soripark.llm import class_ngram, jaccard_join, language_id, mixing, piece_encoding, substring_dedup

from edges import SCHEMA, documents


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


# language ID


def test_language_id_on_held_out_rows(docs, rows):
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    prose = [r for r in got if r.doc_id is not None and r.doc_id < 40 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert prose and all(r.language.lang_pred == r.lang for r in prose)
    for r in got:
        assert 0 <= r.language.score <= 1 and r.node == "clash"
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.language.lang_pred, r.language.score) == ("und", 0.0)


def test_language_id_equals_plain_counts(docs):
    model = language_id.train(docs)
    text = "the reed Été 12"
    total = model.prior.copy()
    for group, _ in [language_id._ngram_buckets([text], model.orders, language_id.BUCKET_BITS)]:
        for buckets in group:
            for b in buckets:
                total += model.log_prob[b]
    want = math.exp(max(total)) / sum(math.exp(x) for x in total) if max(total) > -700 else None
    name, score = language_id.score_texts(model, [text])
    assert name[0] == model.languages[int(total.argmax())]
    assert want is None or abs(score[0] - want) < 1e-6


def test_language_id_without_training_rows(docs, empty):
    got = language_id.identify(docs, language_id.train(empty)).select("language.*").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]
    assert language_id.identify(empty, language_id.train(docs)).count() == 0


# mixing


def test_mixing_equals_sql(docs, rows):
    documents = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    # equal ids share a hash and a fate, so repeated rows repeat in the SQL as well
    want = sorted(map(repr, con.sql(mixing.OP4_SQL).fetchall()))
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in got)
    assert abs(sum({(r.source_size, r.target) for r in got} and {r.target for r in got}) - sum(len(words(r[1])) for r in rows)) < 1e-6


def test_mixed_repeats_rows(docs, empty):
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.passes
    got = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert got == +plan
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# class n-grams


def test_class_ngram_base_score_and_totals(spark, docs, rows):
    frame = docs.select("doc_id", "text", class_ngram.is_training("doc_id").alias("is_train"))
    model = class_ngram.fit(frame.where("is_train"), share=2.0**-7, classes=6, rounds=4, bucket_entries=500)
    got = class_ngram.score(frame, model, bucket_entries=500).collect()
    trained = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    count = Counter()
    for r in trained:
        count.update([*(r[1] or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    assert (model.units.tokens, model.units.kinds) == (n, v)

    def base(text):
        tokens = [*(text or "").encode().lower().split(), None]
        return len(tokens), sum(count[t] > 0 for t in tokens), round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), 6)

    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(base(r[1]) for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # the tables are probabilities
    assert abs((10**model.transition).sum(1) - 1).max() < 1e-9
    bins = class_ngram.BINS
    emission = model.emission.copy()
    emission[:bins] += [math.log10(t + 0.5 * (k + 1)) for t, k in zip(model.units.bin_tokens, model.units.bin_kinds)]
    for c in set(model.unit_class.tolist()):
        assert abs((10 ** emission[model.unit_class == c]).sum() - 1) < 1e-9


def test_class_ngram_units_grow_with_the_corpus(spark):
    """A word seen often enough is a unit, however small its share of the tokens; rarer words stay in bins."""
    rows = [(i, " ".join(["the"] * 5000 + [f"often{i % 30}", f"rare{i}"]), True) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, is_train boolean")
    model = class_ngram.fit(frame, classes=8)
    assert sorted(model.units.counts.tolist()) == [10] * 30 + [300, 1500000] and model.units.bin_kinds.sum() == 300
    assert len(model.unit_class) == model.units.n


def test_class_ngram_knows_the_end_of_one_long_text(spark):
    """With 50,000 words a text its end is rarer than any share, and still a unit."""
    frame = spark.createDataFrame([(0, " ".join(f"w{i % 50}" for i in range(50000)), True), (1, "w1 new", False)], "doc_id long, text string, is_train boolean")
    got = {r.doc_id: r for r in class_ngram.score(frame, class_ngram.fit(frame.where("is_train"), classes=8)).collect()}
    each = lambda n: math.log10((n + 0.5) / (50001 + 0.5 * 52))
    assert (got[0].n_known, got[1].n_known) == (50001, 2)
    assert abs(got[0].base_score - 50000 * each(1000) - each(1)) < 1e-4 and abs(got[1].base_score - each(1000) - each(0) - each(1)) < 1e-9


def test_class_ngram_beats_the_base_on_held_out_text(docs):
    frame = docs.where("doc_id < 40").select("doc_id", "text", class_ngram.is_training("doc_id").alias("is_train"))
    got = class_ngram.score(frame, class_ngram.fit(frame.where("is_train"), share=2.0**-9, classes=8)).where("not is_train").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_class_ngram_without_training_rows(docs, empty):
    frame = docs.select("doc_id", "text", (docs.doc_id < 0).alias("is_train"))
    got = class_ngram.score(frame, class_ngram.fit(frame.where("is_train"))).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and abs(r.base_score) < 1e-9 for r in got)
    none = empty.select("doc_id", "text", (empty.doc_id < 0).alias("is_train"))
    assert class_ngram.score(none, class_ngram.fit(none)).count() == 0


def test_exchange_gain_equals_recounted_likelihood():
    import numpy as np

    rng = np.random.default_rng(2)
    n, classes = 12, 4
    pairs = rng.integers(0, 6, (n, n))
    of = rng.integers(0, classes, n)

    def matrix(of):
        m = np.zeros((classes, classes))
        for i in range(n):
            for j in range(n):
                m[of[i], of[j]] += pairs[i, j]
        return m

    def likelihood(m):
        return class_ngram._xlogx(m).sum() - class_ngram._xlogx(m.sum(0)).sum() - class_ngram._xlogx(m.sum(1)).sum()

    out, into = (np.array([np.bincount(of, x, classes) for x in side]) for side in (pairs, pairs.T))
    found = class_ngram._best_moves(matrix(of), of, out, into, np.diag(pairs).astype(float))
    for u, best, gain in zip(range(n), *found):
        every = []
        for c in range(classes):
            moved = of.copy()
            moved[u] = c
            every.append(likelihood(matrix(moved)))
        assert abs(gain - (max(every) - every[of[u]])) < 1e-6 and abs(every[best] - max(every)) < 1e-6


def test_packed_pairs_come_back():
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (0, 1, 5, 1000):
        keys, n = np.unique(rng.integers(0, 2**40, size)), None
        n = rng.integers(1, 2**31 - 1, len(keys))
        back = class_ngram._unpack(*class_ngram._pack(keys, n))
        assert np.array_equal(back[0], keys) and np.array_equal(back[1], n)
    assert class_ngram._steps(0) == [] and class_ngram._steps(1) == [(0, 1)]
    for size in (7, 5000):
        steps = class_ngram._steps(size)
        assert steps[0] == (0, 1) and steps[-1][1] == size and all(a[1] == b[0] for a, b in zip(steps, steps[1:])) and max(b - a for a, b in steps) <= class_ngram.STEP


def test_packed_pairs_hold_no_empty_bytes():
    import numpy as np

    assert len(class_ngram._planes(np.array([1, 2, 200]))) == 4 and len(class_ngram._planes(np.array([1, 256, 2]))) == 7


def test_exchange_reads_its_own_blocks_and_keeps_exact_counts(spark, docs):
    """Blocks of a turn lie together, and counts moved round by round equal those of all pairs, as does each round's start."""
    import numpy as np

    frame = docs.select("text")
    units = class_ngram.count_words(frame, 0.0, 3, least=2)
    bigrams = class_ngram._unit_bigrams(frame, units)
    assert {(r.block % class_ngram.STRIDE, r.turn) for r in bigrams.collect()} == {(t, t) for t in range(class_ngram.STRIDE)}
    plan = bigrams.where("turn = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(turn" in plan
    start, _ = class_ngram.cluster(bigrams, units, classes=7, rounds=0)
    for rounds in (1, 2, 6):
        of, m = class_ngram.cluster(bigrams, units, classes=7, rounds=rounds)
        want = np.zeros((7, 7))
        for r in bigrams.collect():
            keys, n = class_ngram._unpack(r.out_pairs, r.out_n)
            np.add.at(want, (of[keys // units.n], of[keys % units.n]), n)
        assert np.array_equal(m, want) and (of != start).any()


def test_unit_bigrams_equal_plain_counts(docs, rows):
    """Both sides of every block against counted neighbours of all texts."""
    import numpy as np

    texts = [(r[1] or "").encode() for r in rows]
    frame = docs.select("text")
    units = class_ngram.count_words(frame, 0.0, 3)
    end = int(units.of(np.array([class_ngram.END]), np.zeros(1, np.int64))[0])
    want = Counter()
    for text in texts:
        seq = [int(u) for _, _, hashes, bins in class_ngram._chunks([text]) for u in units.of(hashes, bins)] + [end]
        want.update(zip([end, *seq], seq))
    for one in (0, 1):
        got = {}
        for r in class_ngram._unit_bigrams(frame, units).collect():
            keys, n = class_ngram._unpack(*((r.out_pairs, r.out_n) if one == 0 else (r.in_pairs, r.in_n)))
            assert len({int(k // units.n if one == 0 else k % units.n) % class_ngram.BLOCKS for k in keys} | {r.block}) == 1
            got |= {(int(k // units.n), int(k % units.n)): int(c) for k, c in zip(keys, n)}
        assert got == want


def test_class_ngram_score_is_the_product_of_its_three_probabilities(docs, rows):
    """Every text's score from plain counts of classes, units and words, given only which unit a word is and which class a unit."""
    import numpy as np

    train = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1 for r in rows]
    frame = docs.select("doc_id", "text", class_ngram.is_training("doc_id").alias("is_train"))
    classes = 6
    model = class_ngram.fit(frame.where("is_train"), classes=classes)

    def spoken(text):
        words_ = (text or "").encode().lower().split()
        unit = [int(u) for _, _, hashes, bins in class_ngram._chunks([(text or "").encode()]) for u in model.units.of(hashes, bins)] if words_ else []
        return [*zip(unit, words_), (model.end, None)]

    texts = [spoken(r[1]) for r in rows]
    token, unit_n, kinds, pairs = Counter(), Counter(), {}, Counter()
    for text, learn in zip(texts, train):
        if learn:
            token.update(w for _, w in text)
            unit_n.update(u for u, _ in text)
            pairs.update(zip([model.end, *(u for u, _ in text)], (u for u, _ in text)))
            for u, w in text:
                kinds.setdefault(u, set()).add(w)
    cls = model.unit_class
    m = np.zeros((classes, classes))
    for (a, b), n in pairs.items():
        m[cls[a], cls[b]] += n
    prior = (m.sum(0) + 0.5) / (m.sum() + 0.5 * classes)
    members, mass = Counter(cls.tolist()), Counter()
    for u, n in unit_n.items():
        mass[int(cls[u])] += n
    want = []
    for (doc_id, *_), text in zip(rows, texts):
        total, before = 0.0, model.end
        for u, w in text:
            a, b = int(cls[before]), int(cls[u])
            total += math.log10((m[a, b] + 20 * prior[b]) / (m[a].sum() + 20)) + math.log10((unit_n[u] + 0.5) / (mass[b] + 0.5 * members[b]))
            if u < class_ngram.BINS:
                total += math.log10((token[w] + 0.5) / (unit_n[u] + 0.5 * (len(kinds.get(u, ())) + 1)))
            before = u
        want.append((repr(doc_id), len(text), total))
    got = sorted((repr(r.doc_id), r.n_tokens, r.score) for r in class_ngram.score(frame, model).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2]))


# substring dedup


def plain_windows(rows, width):
    first, found = {}, []
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            key, place = tuple(w[i : i + width]), (-1 if doc_id is None else doc_id, i)
            found.append((key, place, doc_id, text))
            first[key] = min(first.get(key, place), place)
    gone = {}
    for key, place, doc_id, text in found:
        if place > first[key]:
            gone.setdefault((doc_id, text), set()).update(range(place[1], place[1] + width))
    return gone


@pytest.mark.parametrize("width", [20, 3, 1])
def test_substring_dedup_equals_plain_windows(docs, rows, width):
    gone = plain_windows([r[:2] for r in rows], width)
    want = []
    for doc_id, text, *_ in rows:
        w = words(text)
        lost = gone.get((doc_id, text), ())
        want.append((doc_id, len(w), len(lost), b" ".join(x for i, x in enumerate(w) if i not in lost).decode()))
    got = substring_dedup.without_repeats(docs, width=width).select("doc_id", "kept.*", "node").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:4]) for r in got)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.without_repeats(empty).count() == 0


def test_a_saturated_sketch_loses_nothing(docs, rows, spark):
    keyed = docs.select("doc_id", "text", jaccard_join.text_hash("text").alias("text_hash")).where("doc_id is not null")
    small = substring_dedup.later_windows(keyed, bits=10).groupBy("doc_id").count().collect()
    large = substring_dedup.later_windows(keyed).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in small} == {r.doc_id for r in large} and large


# n-gram Jaccard join


def plain_components(rows, k=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return out


def test_jaccard_join_equals_all_pairs(docs, rows):
    got = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain_components([r[:2] for r in rows])))


def test_jaccard_join_on_chains_and_hubs(spark):
    """Copies of a base with different edits: some meet only the base, some only each other."""
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"w{j}" for j in range(i * 4, i * 4 + 40))) for i in range(8)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain_components(rows)))


def test_jaccard_join_keeps_a_link_by_one_prefix_token(spark):
    """x and y share 9 of 12 words and one prefix word; z, which holds that word too, is of a size with a greater need."""
    c, e = [f"c{i}" for i in range(1, 10)], [f"e{i}" for i in range(11)]
    sets = [["u", *c], ["v1", "v2", *c], ["c1", *e]] + [[f"long{i}_{j}" for j in range(60)] + c[1:] + e for i in range(12)]
    rows = [(i, " ".join(s)) for i, s in enumerate(sets)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain_components(rows, 1)))
    assert {r.doc_id: r.component_id for r in got}[1] == 0


def test_jaccard_join_at_the_threshold(spark):
    """Pairs of 5 to 60 words whose overlap is exactly at the threshold, with other sets at their words."""
    import random

    rng = random.Random(5)
    sets = []
    for g in range(150):
        a = rng.randint(5, 60)
        b = rng.choice([b for b in range(max(5, -(-3 * a // 4)), min(60, 4 * a // 3) + 1) if (a + b) % 7 == 0] or [a])
        both = 3 * (a + b) // 7
        common = [f"g{g}_{i}" for i in range(both)]
        sets += [common + [f"a{g}_{i}" for i in range(a - both)], common + [f"b{g}_{i}" for i in range(b - both)]]
        n = rng.randint(5, 60)
        sets.append(common[:1] + [f"p{rng.randrange(300)}" for _ in range(n)])
        sets += [common[1:] + [f"l{g}_{j}_{i}" for i in range(2 * both)] for j in range(4)]
    rows = [(i, " ".join(rng.sample(s, len(s)))) for i, s in enumerate(sets)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain_components(rows, 1)))


def test_caps_of_first_tokens_lose_no_overlap(spark):
    """For sets of 1 to 60 with any overlap that links, the first common token, wherever it stands, lies within both caps."""
    import numpy as np

    tokens = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = spark.createDataFrame([(n, n, tokens[:n].view(np.int64).tolist()) for n in range(1, 61)], "node long, size int, kept array<long>")
    counts, share = [np.full(1 << 16, 2, np.uint16).tobytes()] * 2, spark.sparkContext.broadcast
    caps = {}
    for r in jaccard_join.first_tokens(live, 75, share([b"\xff" * (1 << 13)] * 2), 16, share(counts)).where("token & 3 = 0").collect():
        caps.setdefault(r.node, []).append(r.cap)
    assert len(caps) == 60
    for a in range(1, 61):
        for b in range(1, 61):
            for both in range(1, min(a, b) + 1):
                if 100 * both >= 75 * (a + b - both):  # all kept tokens before the first common one: a - both at most
                    first_a, first_b = sorted(caps[a])[::-1][a - both], sorted(caps[b])[::-1][b - both]
                    assert b <= first_a and a <= first_b


def test_jaccard_join_when_every_cell_is_full(spark, docs, rows, monkeypatch):
    """Flags that tell nothing, and tokens whose counts all collide, cost time and lose no link."""
    from soripark.llm import sketch

    monkeypatch.setattr(sketch, "bits_for", lambda *a, **b: 6)
    got = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain_components([r[:2] for r in rows])))


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """300 sets around one base, many of them just short of a link: the search after the rounds finds every component."""
    import random

    rng = random.Random(21)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            p = rng.randrange(len(w))
            w[p : p + rng.choice([1, 1, 2])] = rng.choice([[], [f"e{rng.randrange(60)}"], [f"u{i}"]])
        rows.append((i, " ".join(w)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain_components(rows)))


def test_one_of_each(docs, rows, empty):
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = Counter(r.doc_id for r in got.collect())
    groups = {}
    for (doc_id, n, component) in plain_components([r[:2] for r in rows]):
        if n:
            groups.setdefault(component, []).append(doc_id)
    assert all(kept[c] == 1 for c in groups) and all(kept[d] == 0 for c, ds in groups.items() for d in ds if d is not None and d != c)
    assert jaccard_join.one_of_each(empty).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model_path())


def test_pieces_equal_the_library(docs, rows, library):
    vocabulary = piece_encoding.load_vocabulary(piece_encoding.default_model_path())
    encoded = piece_encoding.encode(docs, vocabulary)
    got = piece_encoding.decode(encoded, vocabulary).select("text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.decoded == library.decode(ids)
    digests = piece_encoding.round_trip(docs, vocabulary).select("text", "pieces.*").collect()
    for r in digests:
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_random_strings(library):
    import random

    vocabulary = piece_encoding.load_vocabulary(piece_encoding.default_model_path())
    encoder = piece_encoding.Encoder(vocabulary)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab e tion the ▁ \n\t.,日é😀01") for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["".join(rng.choice(vocabulary.pieces).replace("▁", " ") for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += [" " * n + "x" + " " * n for n in (1, 2, 15, 16, 17, 31, 64, 65, 66, 200)] + ["a" * 5000, "퟿\U0010ffff"]
    for text in texts:
        assert encoder.encode(text) == library.encode(text), text
    for _ in range(500):
        ids = [rng.randrange(3, 32000) for _ in range(6)]
        assert encoder.decode(ids) == library.decode(ids)


def test_parts_of_a_group_fill_their_tables_together(library, monkeypatch):
    """Each in a Python loop over its matches took most of the time (946 CPU seconds a GB by the check, 900 allowed)."""
    import random

    class Counted:
        def __init__(self, automaton):
            self.automaton, self.calls = automaton, 0

        def iter(self, text):
            self.calls += 1
            return self.automaton.iter(text)

    encoder = piece_encoding.Encoder(piece_encoding.load_vocabulary(piece_encoding.default_model_path()))
    encoder.matches = Counted(encoder.matches)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rng.randrange(1, n)))
    text = " ".join(word(20) for _ in range(4000)) + "\n" + "\n".join(word(9) for _ in range(300))
    assert encoder.encode(text) == library.encode(text)
    assert encoder.matches.calls == 0

    monkeypatch.setattr(piece_encoding, "GROUP", 4000)
    monkeypatch.setattr(piece_encoding, "FEWEST_TOGETHER", 2)
    monkeypatch.setattr(piece_encoding, "TOGETHER", 150)
    monkeypatch.setattr(piece_encoding, "REMEMBERED", 500)
    pieces = encoder.vocabulary.pieces
    texts = ["".join(rng.choice("ab e tion the ▁ \n\t\r.,日é😀\u0378\x000123") for _ in range(rng.randrange(90))) for _ in range(2000)]
    texts += ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += ["".join(rng.choice(pieces).replace("▁", "") for _ in range(rng.randrange(40))) for _ in range(300)]  # parts on both sides of LONGEST_TOGETHER
    texts += ["a" * n for n in range(60, 70)] + ["日" * n for n in range(60, 70)] + [" " * n + "x\n" + " " * n for n in (1, 2, 16, 17, 66, 200)]
    texts += [None, "", " ", "\n", "\n\n ", "▁", "x▁", "▁▁x", "\n\n▁x\n", word(9) * 3000]
    rng.shuffle(texts)
    assert list(encoder.encode_all(texts)) == [library.encode(t or "") for t in texts]
    assert list(encoder.encode_all([])) == []
    encoder.forget()
    assert encoder.tables.judged is None and encoder.encode(text) == library.encode(text)


# pipeline


def test_pipeline_stages_keep_columns_and_agree_with_plain_versions(spark, docs, rows, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    now = plain
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        stage(spark, before, "").write.parquet(str(tmp_path / f"{number}"))
        now = spark.read.parquet(str(tmp_path / f"{number}"))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == plain.columns
        had, has = before.collect(), now.collect()
        if name == "language_id":
            assert {r.doc_id for r in had if any(c.isalpha() for c in r.text or "")} == {r.doc_id for r in has}
        if name == "jaccard_join":
            groups = plain_components([(r.doc_id, r.text) for r in had])
            assert Counter(r.doc_id for r in has) == Counter({c for _, n, c in groups if n} | {d for d, n, _ in groups if not n})
        if name == "substring_dedup":
            gone = plain_windows([(r.doc_id, r.text) for r in had], 20)
            want = {}
            for r in had:
                lost = gone.get((r.doc_id, r.text), ())
                left = b" ".join(x for i, x in enumerate(words(r.text)) if i not in lost).decode() if lost else r.text
                if not lost or left:
                    want[r.doc_id] = (left, len(left))
            assert {r.doc_id: (r.text, r.n_chars) for r in has} == want
        if name == "mixing":
            assert set(Counter(r.doc_id for r in has).values()) <= {1, 2, 3}
        if name == "pieces":
            assert len(has) == len(had) and all(r.round_trip and r.n_tokens == len(r.ids) for r in has)


def test_pipeline_encodes_in_one_trip_and_remembers_nothing_after(spark, docs, rows, library):
    """Two Python nodes would take two workers a task, each with an encoder."""
    tokens = corpus_pipeline.token_ids(spark, docs, "")
    assert tokens._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert tokens.schema["ids"].dataType.simpleString() == "array<int>"
    got = Counter((repr(r.doc_id), tuple(r.ids), r.n_tokens, r.round_trip) for r in tokens.collect())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "")
        want[(repr(r[0]), tuple(ids), len(ids), library.decode(ids) == (r[1] or "").replace("▁", " "))] += 1
    assert got == want
    encoder = piece_encoding.Encoder(piece_encoding.load_vocabulary(piece_encoding.default_model_path()))
    first = encoder.encode("one two  three")
    encoder.forget()
    assert not (encoder.new or encoder.old or encoder.valid) and encoder.encode("one two  three") == first


def test_a_task_gives_its_memory_back():
    """Workers outlive their tasks: what a task held must not stay with them."""
    import re
    from pathlib import Path

    import numpy as np

    from soripark.llm.common import tidy

    own = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    marks = []

    def run(batches):
        held = [np.ones(8000) for _ in range(2000)]  # 128 MB in pieces that malloc keeps
        pins = [np.ones(16) for _ in range(2000)]
        marks.append(own())
        for batch in batches:
            yield batch, len(held) + len(pins)

    assert [n for n, _ in tidy(run)([1, 2])] == [1, 2]
    assert marks[0] - own() > 100


def test_pipeline_of_an_empty_table(spark, empty):
    now = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0
