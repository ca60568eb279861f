import math
import random

import pytest
from pyspark.sql import functions as F

from soripark.llm import graph_index, metric_tree, template_extraction
from soripark.llm.vectors import usable


def vectors(seed=1, n=300, dims=8):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(80)]  # one very common vector
    rows += [(n + 100, None), (n + 101, []), (n + 102, [1.0, None] + [0.0] * 6), (n + 103, [float("nan")] + [0.0] * 7), (n + 104, [math.inf] + [0.0] * 7), (n + 150, [0.0] * dims), (None, rows[0][1]), (n + 200, [1.0, 2.0])]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").repartition(3).cache()


def test_top_k_equals_brute_force(table):
    rows = table.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", metric_tree.whole("embedding").alias("v"))
    queries = rows.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = metric_tree.top_k(rows, queries, 5, shard_rows=100).collect()
    data = {r.vec_id: r.v for r in rows.collect()}
    want = []
    for q in sorted(i for i in data if i % 10 == 0):
        hits = sorted((-sum(a * b for a, b in zip(data[q], v)), i) for i, v in data.items() if i != q and len(v) == len(data[q]))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits[:5])]
    assert sorted(tuple(r) for r in got) == want


def test_tree_pages_are_bounded_and_cover():
    import numpy as np

    rows = np.array([[0] * 4] * 3000 + [[i, i % 7, -i, 3] for i in range(1000)])
    pages = metric_tree.build(np.arange(4000), rows)
    assert all(len(p["vectors"]) <= metric_tree.PAGE for p in pages)
    assert sorted(i for p in pages if p["leaf"] for i in p["ids"].tolist()) == list(range(4000))


def test_top_k_of_wide_and_few_vectors(spark):
    rows = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, -5]), (50, [3, 2**41])], "vec_id long, v array<long>")
    got = metric_tree.top_k(rows, rows.where("vec_id = 50").withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert [tuple(r) for r in got] == [(50, 1, 0, 3 * 2**40 + 2**41), (50, 2, 1, 3 * 2**40 - 5 * 2**41)]
    none = rows.where("vec_id < 0")
    assert metric_tree.top_k(none, none.withColumnRenamed("vec_id", "query_id"), 5).count() == 0


def test_top_k_of_a_query_longer_than_all_vectors(spark):
    """Products beyond 2^52 are exact, whatever the lengths of the stored vectors."""
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-900, 900) for _ in range(6)]) for i in range(1, 400)] + [(400, [rng.randrange(-(2**50), 2**50) for _ in range(6)])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = metric_tree.top_k(frame.where("vec_id < 400"), frame.where("vec_id = 400").withColumnRenamed("vec_id", "query_id"), 5).collect()
    want = sorted((-sum(a * b for a, b in zip(rows[-1][1], v)), i) for i, v in rows[:-1])[:5]
    assert [(r.score, r.vec_id) for r in sorted(got)] == [(-s, i) for s, i in want]


def test_vector_searches_with_clashing_columns_and_repeated_rows(spark):
    rows = spark.createDataFrame([(i % 30, [float(i), 1.0, float(i % 7)], 5, 6) for i in range(60)], "vec_id long, v array<float>, rank int, score int")
    queries = rows.where("vec_id = 3").withColumnRenamed("vec_id", "query_id")
    whole = rows.select("vec_id", metric_tree.whole("v", 1).alias("v"))
    top = metric_tree.top_k(whole, whole.where("vec_id = 3").distinct().limit(1).withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert [r.rank for r in sorted(top, key=lambda r: r.rank)] == [1, 2, 3, 4, 5] and all(r.vec_id != 3 for r in top)
    found = graph_index.search(rows.select("vec_id", "v"), queries.select("query_id", "v").limit(1), 4).collect()
    assert len(found) == 4 and all(r.vec_id != 3 for r in found)
    none = rows.where("vec_id < 0").select("vec_id", "v")
    assert graph_index.search(none, none.withColumnRenamed("vec_id", "query_id"), 4).count() == 0


def test_a_full_graph_with_shipped_parameters():
    """Recall of the ten nearest in one graph of 5,000 points about ten centres, and how few distances that takes."""
    import numpy as np

    rng = np.random.default_rng(2)
    points = (rng.normal(0, 1, (10, 64))[rng.integers(0, 10, 5000)] + rng.normal(0, 0.5, (5000, 64))).astype(np.float32)
    edges, entries = graph_index.build(points)
    found, _, computed = graph_index.beam_search(points, edges, entries, points[:100], graph_index.QUERY_BEAM)
    hit = 0
    for i in range(100):
        gap = ((points.astype(float) - points[i].astype(float)) ** 2).sum(1)
        gap[i] = np.inf
        hit += len(set(np.argsort(gap)[:10].tolist()) & set(found[i].tolist()))
    assert hit >= 900 and computed.mean() < 0.4 * len(points)


def test_graph_search_recall_and_order(table):
    rows = table.where(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("v"))
    queries = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in graph_index.search(rows, queries, 10, shard_rows=120).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    data = {r.vec_id: r.v for r in rows.collect()}
    hit = total = 0
    for q, found in got.items():
        found.sort()
        exact = sorted((math.dist(data[q], v), i) for i, v in data.items() if i != q and len(v) == len(data[q]))[:10]
        assert [f[1:] for f in found] == sorted(f[1:] for f in found) and all(abs(s - math.dist(data[q], data[i])) < 1e-9 for _, s, i in found)
        hit += len({i for _, i in exact} & {i for _, _, i in found})
        total += len(exact)
    assert len(got) == sum(i % 5 == 0 for i in data if len(data[i]) == 8) and hit >= 0.95 * total


def test_graph_sees_past_dense_clumps(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 1e-3, (300, 16)), rng.normal(0, 1, (500, 16))]).astype(np.float32)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, v array<float>")
    queries = rows.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in graph_index.search(rows, queries, 10, beam=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        gap = ((points.astype(float) - points[q].astype(float)) ** 2).sum(1)
        gap[q] = np.inf
        hit += len(found & set(np.argsort(gap)[:10].tolist()))
    assert len(got) == 80 and hit >= 0.95 * 800


def test_graph_recall_on_a_full_shard_without_clusters(spark):
    """As many normal vectors of 64 components as a shard holds, which have no near neighbours, under the shipped parameters."""
    import numpy as np
    import pandas as pd

    points = np.random.default_rng(1).normal(0, 1, (graph_index.SHARD_ROWS, 64)).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(points)), "v": list(points.tolist())}), "vec_id long, v array<float>")
    got = {}
    for r in graph_index.search(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit, wide = 0, points.astype(float)
    for q, found in got.items():
        gap = ((wide - wide[q]) ** 2).sum(1)
        gap[q] = np.inf
        hit += len(found & set(np.argsort(gap)[:10].tolist()))
    assert len(got) == 164 and hit >= 0.95 * 1640


ARTICLE = "<article><h1>{t}</h1><p>{a}</p><p>{b}<br>more &amp; more&nbsp;text</p></article>"
PAGE = '<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var s="</p><p>no";</script></head><body><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class="cookie-notice">We use cookies</div>{m}<div class="misc"><p>Always here</p></div><section id="comments"><p>nice!</p></section><form><input><label>Mail</label></form><footer>&copy; all</footer></body></html>'


def pages():
    rows = []
    for i in range(30):
        rows.append((i, "https://a.example.org/p/%d" % i, PAGE.format(m=ARTICLE.format(t=f"T{i}", a=f"first {i} one", b=f"second {i}"))))
    for i in range(30, 50):  # no article element: the host's largest container, and a template line inside it
        rows.append((i, "http://b.example.org:80/%d" % i, f"<body><div class=top><p>Top</p></div><div class=text><p>Read this first</p><p>own words of page number {i} and more</p><p>and {i * 7} others</div></body>"))
    rows += [(50, None, None), (51, "odd", ""), (52, "http://c.example.org/", "plain <b>wor</b>ds"), (53, "http://c.example.org/", "<nav>only</nav>"), (53, "http://c.example.org/", "<nav>only</nav>"), (None, "http://d.example.org/", "<p>a<p>b</div></span> c<!-- x"), (54, "http://d.example.org/", "x" * 100000)]
    return rows


def test_extraction(spark):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = template_extraction.extract(frame.repartition(3))
    assert got.columns == [*frame.columns, "main_text"] and got.count() == len(pages())
    text = {r.page_id: r.main_text for r in got.collect()}
    for i in range(30):
        assert text[i] == f"T{i}\n\nfirst {i} one\n\nsecond {i} more & more text"
    for i in range(30, 50):
        assert text[i] == f"own words of page number {i} and more\n\nand {i * 7} others"
    assert (text[50], text[51], text[52], text[53], text[None], text[54]) == ("", "", "plain words", "", "a\n\nb c", "x" * 100000)


def test_all_slots_but_furniture_are_text(spark):
    """Text beside the largest container, and two articles whose paths differ."""
    rows = [
        (0, "http://a.example.org/", "<nav>menu</nav><div id=content><h1>T</h1><div class=text><p>longest part of all</p></div><blockquote>said</blockquote><div class=more>more</div></div>"),
        (1, "http://b.example.org/", "<article class=a><p>one</p></article><div><article class=b><p>two, longer</p></article></div><footer>end</footer>"),
        (2, "http://c.example.org/", "<main><p>m</p></main><section><p>after</p></section>"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.main_text for r in template_extraction.extract(frame).collect()}
    assert text == {0: "T\n\nlongest part of all\n\nsaid\n\nmore", 1: "one\n\ntwo, longer", 2: "m\n\nafter"}


def plain_template(rows, size=3, share=0.5):
    """Tokens of a host's template by comparing whole occurrence vectors."""
    import collections

    vectors = collections.defaultdict(lambda: [0] * len(rows))
    for i, source in enumerate(rows):
        for where, tag, text, _, _ in template_extraction.parse(source):
            vectors[(where, tag, None) if text is None else (where, "", text)][i] += 1
    groups = collections.defaultdict(list)
    for token, vector in vectors.items():
        groups[tuple(vector)].append(token)
    spread = lambda v: sum(x > 0 for x in v)
    return {t for v, ts in groups.items() if len(ts) >= size and any(x[2] is None for x in ts) and spread(v) >= 2 and len(ts) * spread(v) >= 24 and spread(v) >= share * len(rows) for t in ts}


def test_templates_equal_plain_occurrence_vectors(spark):
    rng = random.Random(6)
    hosts = {f"h{h}": [f"<body><nav>{'<a>x</a>' * rng.randint(1, 3)}</nav><div class=top><p>Welcome</p></div><div class=main><p>{i} {rng.random()}</p>{'<p>again</p>' * rng.randint(0, 2)}</div>{'<aside><p>Extra</p></aside>' if i % 2 else ''}<footer>all</footer></body>" for i in range(n)] for h, n in enumerate((1, 2, 5, 12))}
    rows = spark.createDataFrame([(h, s) for h, ss in hosts.items() for s in ss], "host string, html string")
    got = {r.host: {(e.token, e.text) for e in r.template or ()} for r in template_extraction.templates(rows).collect()}
    for host, sources in hosts.items():
        assert got[host] == {(template_extraction._hash(where, text if text is not None else tag), text is not None) for where, tag, text in plain_template(sources)}
    assert not got["h0"] and got["h3"]


def test_the_template_decides_the_slots(spark):
    """Names inside the main slot do not cut the article, and slots elsewhere stay whatever their size; without the template names cut."""
    rng = random.Random(3)
    page = lambda i: f"<html><head><title>t</title></head><body><div class=zone><p>buy {rng.random()}</p></div><div class=story><p>{' '.join(str(rng.random()) for _ in range(60))}</p><div class=search-box><p>about engines {i}</p></div><p>x <math><mi>a{i}</mi></math> y</p></div><div class=tail><p>end {rng.random()}</p></div></body></html>"
    sources = [page(i).replace("<div class=search-box>", "<div class=search-box>" if i % 3 else "<div class=other>") for i in range(20)]
    got = {r.page_id: r.main_text for r in template_extraction.extract(spark.createDataFrame([(i, "http://a.example.org/", s) for i, s in enumerate(sources)], "page_id long, url string, html string")).collect()}
    for i, s in enumerate(sources):
        assert f"about engines {i}\n\nx a{i} y" in got[i] and "buy" in got[i] and "end" in got[i]
        alone = template_extraction.page_text(s, None, None)
        assert "buy" in alone and ("engines" in alone) == (i % 3 == 0)


def words(rng, n):
    return " ".join("w%d" % rng.randrange(10**6) for _ in range(n))


def extracted(spark, sources, url="http://a.example.org/%d"):
    frame = spark.createDataFrame([(i, url % i, s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    return {r.page_id: r.main_text for r in template_extraction.extract(frame).collect()}


def test_no_part_of_an_article_goes_by_its_size(spark):
    """A short summary outside the long story, and a heading that all articles share."""
    rng = random.Random(8)
    parts = [(words(rng, 80), words(rng, 4), words(rng, 30)) for _ in range(20)]
    sources = [f"<body><nav><a>Home</a></nav><section class=summary><p>{b}</p></section><div class=story><p>{a}</p><h2>Conclusion</h2><p>{c}</p></div><div class=sidebar><h3>Latest</h3><p>{words(rng, 5)}</p></div><footer>all</footer></body>" for a, b, c in parts]
    assert extracted(spark, sources) == {i: f"{b}\n\n{a}\n\nConclusion\n\n{c}" for i, (a, b, c) in enumerate(parts)}


def test_hosts_of_one_page_keep_parts_whose_name_holds_a_furniture_word(spark):
    rng = random.Random(9)
    parts = [(words(rng, 30), words(rng, 10)) for _ in range(6)]
    sources = [f"<body><div class=cookie-banner>c</div><div class=story><p>{a}</p><div class=search-engines><p>{b}</p></div></div><div class='site-footer'>f</div><div id=related_posts>r</div></body>" for a, b in parts]
    assert extracted(spark, sources, "http://h%d.example.org/") == {i: f"{a}\n\n{b}" for i, (a, b) in enumerate(parts)}


def test_a_long_reader_part_does_not_push_the_article_out(spark):
    rng = random.Random(10)
    parts = [(words(rng, 12), words(rng, 200)) for _ in range(20)]
    sources = [f"<body><header><h1>Site</h1></header><div class=piece><p>{a}</p></div><div class=said><p>{b}</p></div><footer>all</footer></body>" for a, b in parts]
    assert all(got.startswith(parts[i][0]) for i, got in extracted(spark, sources).items())
    named = [s.replace("class=said", "class=comments") for s in sources]
    assert extracted(spark, named) == {i: a for i, (a, _) in enumerate(parts)}


def test_repeated_boilerplate_is_template(spark):
    """A line that stands twice on every page, in unnamed containers, is no article text; whole texts against all vectors."""
    rng = random.Random(11)
    texts = [words(rng, 40) for _ in range(15)]
    sources = [f"<body><div class=x1><p>Read more here</p></div><div class=body><p>{a}</p></div><div class=x1><p>Read more here</p></div></body>" for a in texts]
    assert extracted(spark, sources) == dict(enumerate(texts))


def test_templates_joined_by_shuffle_give_the_same_text(spark, monkeypatch):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    want = sorted(map(repr, template_extraction.extract(frame).collect()))
    monkeypatch.setattr(template_extraction, "BROADCAST_TOKENS", 0)
    assert sorted(map(repr, template_extraction.extract(frame).collect())) == want


def test_copies_do_not_make_a_template(spark):
    body = "<body><div class=text><p>one</p><p>two</p><p>three</p></div></body>"
    frame = spark.createDataFrame([(i, "http://a.example.org/", body) for i in range(40)], "page_id long, url string, html string")
    assert {r.main_text for r in template_extraction.extract(frame).collect()} == {"one\n\ntwo\n\nthree"}
    assert template_extraction.extract(frame.where("page_id < 0")).count() == 0
