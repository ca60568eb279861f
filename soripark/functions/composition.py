"""Canonical composition of text as column functions: jamo to syllables, letters and their marks to one character."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from soripark.functions import hangul as h

#: Blocks whose letters and marks are composed: Latin with its extensions and phonetic letters, marks, Greek, Cyrillic, and letterlike signs.
BLOCKS = ((0x00C0, 0x0590), (0x1D00, 0x2000), (0x20D0, 0x2130))
_LEADS, _VOWELS, _TAILS = (0x1100, 19), (0x1161, 21), (0x11A8, 27)
_span = lambda first, n: f"[\\u{first:04X}-\\u{first + n - 1:04X}]"
#: A syllable in parts, a whole one with a tail after it, or a stretch without either.
_PARTS = f"({_span(*_LEADS)}{_span(*_VOWELS)}{_span(*_TAILS)}?|[가-힣]{_span(*_TAILS)}|[^가-힣\\u{_LEADS[0]:04X}-\\u{_LEADS[0] + _LEADS[1] - 1:04X}]+|(?s:.))"
#: A letter with its marks, or marks alone.
_CLUSTER = r"(\P{M}\p{M}*|\p{M}+)"


@cache
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Full decompositions, pairs that compose (letter and mark as one string), and the order classes of marks; by rule from the blocks."""
    chars = [chr(c) for a, b in BLOCKS for c in range(a, b)]
    apart = {c: unicodedata.normalize("NFD", c) for c in chars if unicodedata.normalize("NFD", c) != c}
    pairs = {}
    for c in chars:
        two = unicodedata.decomposition(c).split(" ")
        if len(two) == 2 and not two[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
            pairs["".join(chr(int(x, 16)) for x in two)] = c
    order = {c: str(unicodedata.combining(c)) for c in chars if unicodedata.combining(c)}
    return apart, pairs, order


def _map(values: dict[str, str]) -> Column:
    """A literal map, its keys and values split from two strings so that the plan stays small."""
    return F.map_from_arrays(F.split(F.lit("\x00".join(values)), "\x00"), F.split(F.lit("\x00".join(values.values())), "\x00"))


def _syllable(cluster: Column) -> Column:
    """A cluster of jamo, or of an open syllable and a tail, as one syllable; a closed syllable keeps its tail beside it."""
    first, second, third = (F.ascii(F.substring(cluster, i, 1)) for i in (1, 2, 3))
    tail = lambda c: c - (_TAILS[0] - 1)
    zero = F.lit(0)
    from_parts = h.compose(first - _LEADS[0], second - _VOWELS[0], F.when(F.length(cluster) == 3, tail(third)).otherwise(zero))
    begun = h.code(cluster)
    closed = h.compose(F.floor(begun / 588).cast("int"), F.floor(begun % 588 / 28).cast("int"), tail(second))
    return F.when(first < h.FIRST, from_parts).when((F.length(cluster) == 2) & (begun % 28 == 0), closed).otherwise(cluster)


def _composed(cluster: Column, apart: Column, pairs: Column, order: Column) -> Column:
    """A letter with its marks: taken apart, marks put in order, then joined one by one where no mark of the same or a later class stands between."""
    chars = F.flatten(F.transform(F.split(cluster, "(?!^)"), lambda c: F.split(F.coalesce(F.try_element_at(apart, c), c), "(?!^)")))
    rank = lambda c: F.coalesce(F.try_element_at(order, c).cast("int"), F.lit(0))
    ranked = F.transform(chars, lambda c, i: F.struct(rank(c).alias("rank"), i.alias("i"), c.alias("c")))
    placed = F.array_sort(ranked)
    empty = F.struct(F.lit("").alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def join(a: Column, x: Column) -> Column:
        both = F.try_element_at(pairs, F.concat(a["letter"], x["c"]))
        free = (a["rest"] == "") | (a["last"] < x["rank"])
        return (
            F.when((x["i"] == 0) & (x["rank"] == 0), F.struct(x["c"].alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("last")))
            .when(both.isNotNull() & free, F.struct(both.alias("letter"), a["rest"].alias("rest"), a["last"].alias("last")))
            .otherwise(F.struct(a["letter"].alias("letter"), F.concat(a["rest"], x["c"]).alias("rest"), x["rank"].alias("last")))
        )

    return F.aggregate(placed, empty, join, lambda a: F.concat(a["letter"], a["rest"]))


def composed(text: Column) -> Column:
    """``text`` in canonical composed form, over Hangul and the letters and marks of ``BLOCKS``; other characters stay as they are.  Null stays null.

    Only clusters of a mark or of jamo are worked on, and characters of their own that stand for others.
    """
    apart, pairs, order = map(_map, _tables())
    lone = "".join(sorted(c for c in _tables()[0] if unicodedata.normalize("NFC", c) != c))

    def lettered(cluster: Column) -> Column:
        return F.when((F.length(cluster) > 1) | F.lit(lone).contains(cluster), _composed(cluster, apart, pairs, order)).otherwise(cluster)

    def syllabled(part: Column) -> Column:
        return F.when(part.rlike(f"^({_span(*_LEADS)}{_span(*_VOWELS)}|[가-힣]{_span(*_TAILS)})"), _syllable(part)).otherwise(part)

    each = lambda x, pattern, fn: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), fn), "")
    return each(each(text, _PARTS, syllabled), _CLUSTER, lettered)
