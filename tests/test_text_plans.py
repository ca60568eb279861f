"""Texts go through each step once: what is looked up a character equals the step-by-step tokens, and plans hold no step twice."""

from pyspark.sql import functions as F

from soripark import bridge, queries
from soripark.functions import hangul as h

TEXTS = ["닭같이 국물, 신라! 좋다", "  않싫 밥 12시 먹는 앞문 3.5 해옷", "", "abc def", "값|여 꽃(일) 책\n\t학굳", "싸시 씨 샤 쉬", None, "𝄞 가 é ㅋ ʰ", "가 나", "01 002 7시"]


def test_looked_up_symbols_equal_those_of_tokens(spark):
    rows = spark.createDataFrame(list(enumerate([*TEXTS, "".join(map(chr, range(0xAC00, 0xD7A4)))])), "id int, text string")
    got = {r.id: r.ipa for r in h.with_ipa(rows, "text").collect()}
    want = {r.id: r.x for r in h.with_tokens(rows, "text", "p").select("id", F.transform("p", lambda x: x["symbol"]).alias("x")).collect()}
    assert got == want


def test_candidates_are_made_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.pronunciation_candidates(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 3 and plan.count("Filter") <= 1  # of the numbers twice, of the syllables once
    rows = h.candidates(bridge.hangul(F.col("text")))
    want = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").select("doc_id", F.explode(rows).alias("c")).select("doc_id", "c.rank", "c.is_primary", F.sha2("c.pronunciation", 256))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_symbols_come_without_categories(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.pronunciation_ipa(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "semivowel" not in plan and "nucleus" not in plan
