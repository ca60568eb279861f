"""Korean text to pronunciation and IPA as column functions; no Python runs on executors."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from soripark import tables as t

SYLLABLE = "[가-힣]"
FIRST = 0xAC00


def letters(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def at(values: list[str], index: Column) -> Column:
    return F.get(letters(values), index.cast("int"))


def code(ch: Column) -> Column:
    return F.ascii(ch) - F.lit(FIRST)


def is_syllable(ch: Column) -> Column:
    return ch.rlike(f"^{SYLLABLE}$")


def decompose(ch: Column) -> Column:
    """struct<onset, vowel, coda> of a syllable; null for any other character."""
    c = code(ch)
    parts = F.struct(at(t.ONSETS, F.floor(c / 588)).alias("onset"), at(t.VOWELS, F.floor(c % 588 / 28)).alias("vowel"), at(t.CODAS, c % 28).alias("coda"))
    return F.when(is_syllable(ch), parts)


def compose(onset: Column, vowel: Column, coda: Column) -> Column:
    """The syllable of three indexes (0-based)."""
    return F.get(_table("|".join(chr(FIRST + i) for i in range(11172))), (onset * 588 + vowel * 28 + coda).cast("int"))


def _table(values: str) -> Column:
    """Values between bars as an array, which Spark splits once, while it plans."""
    return F.split(F.lit(values), r"\|", -1)


def numeral(digits: Column) -> Column:
    """Sino-Korean reading of a run of digits; digit by digit after a leading zero, and for more than 16 digits, which have no unit."""
    digit = lambda d: at(t.DIGITS, F.ascii(d) - 48)
    spelled = F.array_join(F.transform(F.split(digits, "(?!^)"), digit), "")

    def group(chunk: Column) -> Column:
        chunk = F.lpad(chunk, 4, "0")
        parts = []
        for place in range(4):
            d = F.substring(chunk, place + 1, 1)
            unit = 3 - place
            word = F.concat(F.when((d == "1") & F.lit(unit > 0), F.lit("")).otherwise(digit(d)), F.lit(t.SMALL_UNITS[unit]))
            parts.append(F.when(d == "0", F.lit("")).otherwise(word))
        return F.concat(*parts)

    wide = F.lpad(digits, 16, "0")
    parts = []
    for big in range(3, -1, -1):
        word = group(F.substring(wide, 4 * (3 - big) + 1, 4))
        parts.append(F.when(word == "", F.lit("")).otherwise(F.concat(word, F.lit(t.BIG_UNITS[big]))))
    return (
        F.when(digits.rlike("^0+$"), F.lit(t.DIGITS[0])).when(digits.startswith("0"), spelled).when(F.length(digits) > 16, spelled).otherwise(F.concat(*parts))
    )


def normalize(text: Column) -> Column:
    """Trimmed, numbers in words (1 to 12 before 시 in native numerals), white space collapsed."""
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1))
    rest = F.split(text, "[0-9]+", -1)
    hour = lambda run, after: after.startswith("시") & run.rlike("^0*([1-9]|1[0-2])$")
    words = F.zip_with(
        runs,
        F.slice(rest, 2, F.greatest(F.size(runs), F.lit(1))),
        lambda run, after: F.when(hour(run, after), at(t.HOURS, F.greatest(F.try_to_number(F.substring(run, -2, 2), F.lit("99")).cast("int"), F.lit(1)) - 1)).otherwise(numeral(run)),
    )
    joined = F.array_join(F.flatten(F.zip_with(rest, F.concat(words, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.regexp_replace(F.when(text.rlike("[0-9]"), joined).otherwise(text), r"(?U)\s+", " ")


@cache
def _border(coda: str, onset: str, palatal: bool, linking: bool) -> tuple[str, str]:
    """What becomes of a syllable's coda and the next one's onset."""
    if palatal and onset == "ㅇ" and coda in ("ㄷ", "ㅌ"):
        coda, onset = "", "ㅈ" if coda == "ㄷ" else "ㅊ"
    if coda in ("ㅎ", "ㄶ", "ㅀ") and onset in t.ASPIRATED:
        coda, onset = {"ㅎ": "", "ㄶ": "ㄴ", "ㅀ": "ㄹ"}[coda], t.ASPIRATED[onset]
    if onset in ("ㄴ", "ㅁ"):
        coda = next((n for n, those in t.NASALISED.items() if coda and coda in those), coda)
    if (coda, onset) in (("ㄴ", "ㄹ"), ("ㄹ", "ㄴ")):
        coda = onset = "ㄹ"
    if onset in t.TENSED:
        if (coda, onset) == ("ㄺ", "ㄱ"):
            coda, onset = "ㄹ", "ㄲ"
        elif coda not in ("", "ㄴ", "ㄹ", "ㅁ", "ㅇ"):
            onset = t.TENSED[onset]
    if linking and onset == "ㅇ" and coda in t.LINKED:
        coda, onset = "", coda
    return coda, onset


def border_table(linking: bool) -> list[tuple[int, int]]:
    """New coda and onset indexes for coda x onset x palatalising vowel, in that order."""
    pairs = [_border(c, o, p, linking) for c in t.CODAS for o in t.ONSETS for p in (False, True)]
    return [(t.CODAS.index(c), t.ONSETS.index(o)) for c, o in pairs]


def _codes(normal: Column) -> Column:
    return F.transform(F.regexp_extract_all(normal, F.lit(f"({SYLLABLE})"), F.lit(1)), code)


def _beside(codes: Column) -> Column:
    """Each code with its neighbours, so that no lambda computes the whole row again."""
    none = F.array(F.lit(None).cast("int"))
    beside = F.arrays_zip(codes.alias("c"), F.concat(none, codes).alias("before"), F.concat(F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))), none).alias("after"))
    return F.filter(beside, lambda x: x["c"].isNotNull())


def _changed(beside: Column, rest: Column, linking: bool) -> Column:
    """The changed syllables of ``_beside`` between the ``rest`` of the text."""
    table = border_table(linking)
    new_coda, new_onset = (F.array(*(F.lit(x[i]) for x in table)) for i in (0, 1))
    palatal = F.array(*(F.lit(int(v in t.PALATAL_VOWELS)) for v in t.VOWELS))
    onset = lambda c: F.floor(c / 588)
    vowel = lambda c: F.floor(c % 588 / 28)
    key = lambda left, right: (left % 28 * 38 + onset(right) * 2 + F.get(palatal, vowel(right).cast("int"))).cast("int")

    def changed(x: Column) -> Column:
        c = x["c"]
        coda = F.coalesce(F.get(new_coda, key(c, x["after"])), c % 28)
        on = F.coalesce(F.get(new_onset, key(x["before"], c)), onset(c))
        return compose(on, vowel(c), coda)

    return F.array_join(F.flatten(F.zip_with(rest, F.concat(F.transform(beside, changed), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def pronounce(normal: Column, linking: bool) -> Column:
    """Sound changes between neighbouring syllables of a normalised text, over spaces and punctuation.

    Each border reads only the coda before and the onset and vowel after it, so all are looked up at once.
    """
    return _changed(_beside(_codes(normal)), F.split(normal, SYLLABLE, -1), linking)


def symbols_of(ch: Column) -> Column:
    """array<struct<symbol, position>> of one character."""
    c = code(ch)
    o, v, k = F.floor(c / 588), F.floor(c % 588 / 28), c % 28
    soft = v.isin([t.VOWELS.index(x) for x in sorted(t.PALATAL_VOWELS)])
    onset = F.when(soft & (o == t.ONSETS.index("ㅅ")), F.lit("ɕ")).when(soft & (o == t.ONSETS.index("ㅆ")), F.lit("ɕ͈")).otherwise(at(t.ONSET_IPA, o))
    part = lambda s, p: F.struct(s.alias("symbol"), F.lit(p).alias("position"))
    syllable = F.array(part(onset, "onset"), part(at(t.VOWEL_IPA, v), "nucleus"), part(at(t.CODA_IPA, k), "coda"))
    return F.when((c >= 0) & (c < 11172), F.filter(syllable, lambda s: s["symbol"] != "")).otherwise(F.array(part(ch, "other")))


@cache
def _syllable_ipa() -> str:
    """The symbols of ``symbols_of``, spaces between, of every syllable in order."""
    out = []
    for i in range(11172):
        onset, vowel = t.ONSETS[i // 588], t.VOWELS[i % 588 // 28]
        soft = {"ㅅ": "ɕ", "ㅆ": "ɕ͈"}.get(onset) if vowel in t.PALATAL_VOWELS else None
        out.append(" ".join(x for x in (soft or t.ONSET_IPA[i // 588], t.VOWEL_IPA[i % 588 // 28], t.CODA_IPA[i % 28]) if x))
    return "|".join(out)


def narrow_symbols_of(ch: Column) -> Column:
    """``symbols_of`` in the narrow transcription: front rounded vowels, double codas, no softened s."""
    c = code(ch)
    part = lambda values, i, p: F.struct(at(values, i).alias("symbol"), F.lit(p).alias("position"))
    syllable = F.array(part(t.ONSET_IPA, F.floor(c / 588), "onset"), part(t.NARROW_VOWEL_IPA, F.floor(c % 588 / 28), "nucleus"), part(t.NARROW_CODA_IPA, c % 28, "coda"))
    return F.when((c >= 0) & (c < 11172), F.filter(syllable, lambda s: s["symbol"] != "")).otherwise(F.array(F.struct(ch.alias("symbol"), F.lit("other").alias("position"))))


def ipa_symbols(pronunciation: Column) -> Column:
    """array<struct<symbol, position>> of a pronunciation form."""
    chars = F.filter(F.split(normalize(pronunciation), "(?!^)"), lambda ch: ~ch.rlike(r"(?U)^\s*$"))
    return F.flatten(F.transform(chars, symbols_of))


# Punctuation, modifier letters and vowel letters of IPA texts.
_MARKS = r"[,.?!;:\"'`()\[\]{}]"
_MODIFIERS = "ʰʷʲːˑ̥̬̹̜̟̠̩̯̤̰̪̺̻͈̈̃̚"
_VOWELS = "aeiouyɯɨʉɪʊøœɛɜɞəɐɔæɑɒʌ"


def ipa_text(ipa: Column) -> Column:
    """IPA without stress marks and punctuation, white space collapsed (input in composed form)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(ipa, "[ˈˌ]", ""), _MARKS, " "), r"(?U)\s+", " "))


def split_ipa(text: Column) -> Column:
    clusters = F.regexp_extract_all(text, F.lit(rf"(\X[{_MODIFIERS}]*)"), F.lit(1))
    return F.when(text == "", F.array().cast("array<string>")).when(text.contains(" "), F.split(text, " ")).otherwise(clusters)


def ipa_tokens(ipa: Column) -> Column:
    """Tokens of an IPA text: by spaces, or by characters with their modifiers where there is no space."""
    return split_ipa(ipa_text(ipa))


def category(symbol: Column) -> Column:
    """vowel if it holds a vowel letter, else semivowel, boundary, other (empty) or consonant."""
    return (
        F.when(symbol == "", "other").when(symbol.rlike(f"[{_VOWELS}]"), "vowel").when(symbol.isin("j", "w", "ɰ", "ɥ"), "semivowel").when(symbol.isin(" ", "|"), "boundary").otherwise("consonant")
    )


def placed(tokens: Column, symbols: Column, same: Column) -> Column:
    guess = F.transform(tokens, lambda x: F.when(x.endswith("̚") | (x == "l"), "coda").when(category(x) == "vowel", "nucleus").otherwise("onset"))
    positions = F.when(same, F.transform(symbols, lambda s: s["position"])).otherwise(guess)
    return F.zip_with(tokens, positions, lambda x, p: F.struct(x.alias("symbol"), category(x).alias("category"), p.alias("position")))


def positioned_tokens(symbols: Column) -> Column:
    """array<struct<symbol, category, position>>: symbol positions, or the whole-text fallback where token and symbol counts differ."""
    tokens = ipa_tokens(F.array_join(F.transform(symbols, lambda s: s["symbol"]), " "))
    return placed(tokens, symbols, F.size(tokens) == F.size(symbols))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def labels_to_ipa(labels: Column) -> Column:
    """IPA symbols of recogniser labels; S and SS soften before a palatalising vowel; unknown labels stay."""
    kept = F.filter(labels, lambda x: x.isNotNull() & ~x.isin(t.SPECIAL_LABELS))
    table = _map(t.LABEL_IPA)

    def of(label: Column, after: Column) -> Column:
        soft = F.coalesce(after.isin(t.PALATAL_LABELS), F.lit(False))
        return F.when((label == "S") & soft, "ɕ").when((label == "SS") & soft, "ɕ͈").otherwise(F.coalesce(F.try_element_at(table, label), label))

    after = F.concat(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.array(F.lit(None).cast("string")))
    symbols = F.filter(F.zip_with(kept, after, of), lambda s: s.isNotNull())
    return F.filter(symbols, lambda s: s != "|")


def ipa_to_labels(symbols: Column) -> Column:
    """struct<labels, unsupported>: labels of IPA symbols, or null with the symbols that have none."""
    table = _map(t.IPA_LABEL)
    missing = F.filter(F.array_distinct(symbols), lambda s: F.try_element_at(table, s).isNull())
    labels = F.transform(symbols, lambda s: F.try_element_at(table, s))
    return F.struct(F.when(F.size(missing) == 0, labels).alias("labels"), missing.alias("unsupported"))


def candidates(text: Column) -> Column:
    """array<struct<rank, pronunciation, is_primary>>: standard, linked and spelled form, repeats and empty ones left out; empty text: null."""
    normal = normalize(text)
    forms = F.array(pronounce(normal, False), pronounce(normal, True), normal)
    different = F.filter(F.array_distinct(forms), lambda x: x != "")
    rows = F.transform(different, lambda p, i: F.struct(i.alias("rank"), p.alias("pronunciation"), (i == 0).alias("is_primary")))
    return F.when(normal != "", rows)


def with_candidates(df, text: str = "text", into: str = "candidates"):
    """``df`` with the array of ``candidates``; each step is a column of its own, so none is computed twice."""
    df = df.withColumn("__trim", F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")).withColumn("__normal", normalize(F.col("__trim")))
    df = df.withColumns({"__codes": _codes(F.col("__normal")), "__rest": F.split("__normal", SYLLABLE, -1)}).withColumn("__beside", _beside(F.col("__codes")))
    df = df.withColumns({"__standard": _changed(F.col("__beside"), F.col("__rest"), False), "__linked": _changed(F.col("__beside"), F.col("__rest"), True)})
    forms = F.filter(F.array_distinct(F.array("__standard", "__linked", "__normal")), lambda x: x != "")
    rows = F.transform(forms, lambda p, i: F.struct(i.alias("rank"), p.alias("pronunciation"), (i == 0).alias("is_primary")))
    return df.withColumn(into, F.when(F.col("__normal") != "", rows)).drop("__trim", "__normal", "__codes", "__rest", "__beside", "__standard", "__linked")


def with_tokens(df, pronunciation: str, into: str = "tokens"):
    """``df`` with the positioned tokens of a pronunciation form, step by step."""
    df = df.withColumn("__normal", normalize(F.col(pronunciation)))
    df = df.withColumn("__chars", F.filter(F.split("__normal", "(?!^)"), lambda ch: ~ch.rlike(r"(?U)^\s*$")))
    df = df.withColumn("__symbols", F.flatten(F.transform("__chars", symbols_of)))
    df = df.withColumn("__ipa", ipa_text(F.array_join(F.transform("__symbols", lambda x: x["symbol"]), " "))).withColumn("__tokens", split_ipa(F.col("__ipa")))
    df = df.withColumn("__same", F.size("__tokens") == F.size("__symbols"))
    return df.withColumn(into, placed(F.col("__tokens"), F.col("__symbols"), F.col("__same"))).drop("__normal", "__chars", "__symbols", "__ipa", "__tokens", "__same")


def with_ipa(df, pronunciation: str, into: str = "ipa"):
    """``df`` with the symbols alone of ``with_tokens``: a look-up a character, no category or position."""
    df = df.withColumn("__chars", F.filter(F.split(F.regexp_replace(normalize(F.col(pronunciation)), r"(?U)\s+", ""), "(?!^)"), lambda ch: ch != ""))
    table = _table(_syllable_ipa())
    df = df.withColumn("__ipa", ipa_text(F.array_join(F.transform("__chars", lambda ch: F.coalesce(F.get(table, code(ch)), ch)), " ")))
    return df.withColumn(into, split_ipa(F.col("__ipa"))).drop("__chars", "__ipa")
