import datetime

from soripark.llm import url_filters

D = lambda day: datetime.date(2024, 1, day)


def test_intervals_decide_at_their_time(spark):
    entries = [("bad.example.org", "block", D(5)), ("bad.example.org", "remove", D(10)), ("example.org", "block", D(12)), ("bad.example.org/ok", "allow", D(1)), ("x.example.org", "block", D(3)), ("x.example.org", "remove", D(3)), (None, "block", D(1)), ("y.com", "block", None)]
    captures = [(i, u, D(d) if d else None, "clash") for i, (u, d) in enumerate([
        ("http://bad.example.org/a", 4), ("http://bad.example.org/a", 5), ("http://BAD.example.org:80/a?q", 9), ("http://bad.example.org/a", 10), ("http://u@bad.example.org./z", 12), ("http://bad.example.org/ok/1", 13),
        ("http://x.example.org", 4), ("http://y.com/", 5), (None, 5), ("odd", 5), ("", 5), ("http://bad.example.org/a", None), ("http://bad.example.org/a", 5), ("http://a.b.c.bad.example.org/" + "p" * 50000, 6)])]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at date, key string").repartition(3)
    got = {r.page_id: (r.verdict, r.list_key) for r in url_filters.judge(frame, spark.createDataFrame(entries, "key string, verdict string, at date")).collect()}
    assert len(got) == len(captures)
    block = ("block", "bad.example.org")
    assert [got[i] for i in range(14)] == [("none", None), block, block, ("none", None), ("block", "example.org"), ("allow", "bad.example.org/ok"), ("none", None), ("none", None), ("none", None), ("none", None), ("none", None), ("none", None), block, block]


def test_empty_tables_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "http://a.com/", D(1))] * 2, "page_id long, url string, fetched_at date")
    none = spark.createDataFrame([], "key string, verdict string, at date")
    assert [r.verdict for r in url_filters.judge(frame, none).collect()] == ["none", "none"]
    assert url_filters.judge(frame.where("page_id = 0"), none).count() == 0


def test_hot_keys_go_to_several_tasks_with_the_same_result(spark, monkeypatch):
    """Half of all captures are of one key; without a broadcast they are dealt out in parts."""
    rows = [(i, f"http://{'hot.example.org' if i % 2 else f'h{i % 13}.example.org'}/p{i}", D(1 + i % 28)) for i in range(600)]
    frame = spark.createDataFrame(rows, "page_id long, url string, fetched_at date").repartition(4)
    entries = [("hot.example.org", "block" if d % 2 else "remove", D(d)) for d in range(1, 28, 3)] + [("h3.example.org", "block", D(4)), ("example.org", "allow", D(20))]
    listed = spark.createDataFrame(entries, "key string, verdict string, at date")
    want = sorted(map(repr, url_filters.judge(frame, listed).collect()))
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(url_filters, "HOT_CAPTURES", 100)
    assert sorted(map(repr, url_filters.judge(frame, listed).collect())) == want
    asked = frame.selectExpr("url as __sp_url", "fetched_at as __sp_at", "split(url, '/')[2] as key")
    dealt, active = url_filters._in_parts(asked, url_filters.intervals(listed))
    parts = {r.key: r.n for r in dealt.groupBy("key").agg({"part": "max"}).withColumnRenamed("max(part)", "n").collect()}
    assert parts["hot.example.org"] > 30 and parts["h3.example.org"] == 0
    assert active.where("key = 'hot.example.org'").count() == 64 * url_filters.intervals(listed).where("key = 'hot.example.org'").count()
