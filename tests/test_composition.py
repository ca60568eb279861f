"""Composition in columns against the standard library."""

import random
import unicodedata

from pyspark.sql import functions as F

from soripark.functions import composition
from soripark.functions import hangul as h


def composed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(4)
    out = rows.select("i", composition.composed(F.col("x")).alias("y"))
    assert not any(name in out._jdf.queryExecution().executedPlan().toString() for name in ("Python", "Arrow"))
    return [r.y for r in out.orderBy("i").collect()]


def test_all_syllables_from_their_parts(spark):
    texts = [unicodedata.normalize("NFD", "".join(map(chr, range(c, min(c + 60, 0xD7A4))))) for c in range(0xAC00, 0xD7A4, 60)]
    assert composed(spark, texts) == [unicodedata.normalize("NFC", x) for x in texts]


def test_all_letters_of_the_blocks_both_ways(spark):
    chars = [chr(c) for a, b in composition.BLOCKS for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    texts = chars + [unicodedata.normalize("NFD", c) for c in chars] + ["x" + unicodedata.normalize("NFD", c) + "y" for c in chars]
    assert composed(spark, texts) == [unicodedata.normalize("NFC", x) for x in texts]


def test_marks_in_any_order_on_phonetic_letters(spark):
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    letters = "aeiouyɯɨʉɪʊøœɛɜɞəɐɔæɑɒʌkptsmnlrɾɕçāǖ각가ᄀ뷁 -"
    texts = ["".join(rng.choice(letters) + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    texts += ["t͈ʰa̠", "ḉ", "̧́a", "ą́̂", "각", "각ᆨ", "각ᆨ", "ᄀ", "ᅡᄀ", "ÅΩ", "日本é", "", "ä́"]
    assert composed(spark, texts) == [unicodedata.normalize("NFC", x) for x in texts]
    assert composed(spark, [None]) == [None]


def test_tokens_of_decomposed_ipa(spark):
    text = "kʰa " + unicodedata.normalize("NFD", "çã") + ", ˈta"
    got = spark.range(1).select(h.ipa_tokens(composition.composed(F.lit(text))).alias("x")).first().x
    assert got == ["kʰa", "çã", "ta"]
