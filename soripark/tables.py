"""Fixed values of the Korean sound system that results depend on, and thresholds."""

from __future__ import annotations

# Letters of a syllable, in Unicode order.
ONSETS = "ㄱ ㄲ ㄴ ㄷ ㄸ ㄹ ㅁ ㅂ ㅃ ㅅ ㅆ ㅇ ㅈ ㅉ ㅊ ㅋ ㅌ ㅍ ㅎ".split()
VOWELS = "ㅏ ㅐ ㅑ ㅒ ㅓ ㅔ ㅕ ㅖ ㅗ ㅘ ㅙ ㅚ ㅛ ㅜ ㅝ ㅞ ㅟ ㅠ ㅡ ㅢ ㅣ".split()
CODAS = ["", *"ㄱ ㄲ ㄳ ㄴ ㄵ ㄶ ㄷ ㄹ ㄺ ㄻ ㄼ ㄽ ㄾ ㄿ ㅀ ㅁ ㅂ ㅄ ㅅ ㅆ ㅇ ㅈ ㅊ ㅋ ㅌ ㅍ ㅎ".split()]

# IPA of those letters, in the same order ("" is silent).
ONSET_IPA = ["k", "k͈", "n", "t", "t͈", "ɾ", "m", "p", "p͈", "s", "s͈", "", "tɕ", "tɕ͈", "tɕʰ", "kʰ", "tʰ", "pʰ", "h"]
VOWEL_IPA = ["a", "ɛ", "ja", "jɛ", "ʌ", "e", "jʌ", "je", "o", "wa", "wɛ", "we", "jo", "u", "wʌ", "we", "wi", "ju", "ɯ", "ɰi", "i"]
CODA_IPA = ["", "k̚", "k̚", "k̚", "n", "n", "n", "t̚", "l", "k̚", "m", "p̚", "l", "l", "p̚", "l", "m", "p̚", "p̚", "t̚", "t̚", "ŋ", "t̚", "t̚", "k̚", "t̚", "p̚", "t̚"]
# Where the narrow transcription differs.
NARROW_VOWEL_IPA = ["a", "ɛ", "ja", "jɛ", "ʌ", "e", "jʌ", "je", "o", "wa", "wɛ", "ø", "jo", "u", "wʌ", "we", "y", "ju", "ɯ", "ɯi", "i"]
NARROW_CODA_IPA = ["", "k̚", "k̚", "k̚", "n", "n", "n", "t̚", "l", "lk̚", "lm", "lp̚", "ls", "ltʰ", "lpʰ", "lh", "m", "p̚", "p̚", "t̚", "t̚", "ŋ", "t̚", "t̚", "k̚", "t̚", "p̚", "h"]
PALATAL_VOWELS = set("ㅣㅑㅕㅛㅠㅒㅖ")

# Sound changes at a syllable border.
TENSED = dict(zip("ㄱㄷㅂㅅㅈ", "ㄲㄸㅃㅆㅉ"))
ASPIRATED = dict(zip("ㄱㄷㅈㅅ", "ㅋㅌㅊㅆ"))
NASALISED = {"ㅇ": "ㄱㄲㅋㄳㄺ", "ㄴ": "ㄷㅅㅆㅈㅊㅌㅎ", "ㅁ": "ㅂㅍㄼㅄ"}
LINKED = set("ㄱㄲㄷㅂㅅㅆㅈㅊㅋㅌㅍㅎ")

# Numerals.
DIGITS = list("영일이삼사오육칠팔구")
SMALL_UNITS = ["", "십", "백", "천"]
BIG_UNITS = ["", "만", "억", "조"]
HOURS = ["한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉", "열", "열한", "열두"]

# Recogniser labels and their IPA, vowels first.
LABEL_IPA = {
    "A": "a", "E": "e", "EO": "ʌ", "EU": "ɯ", "I": "i", "O": "o", "U": "u", "iA": "ja", "iE": "je", "iEO": "jʌ", "iO": "jo", "iU": "ju", "euI": "ɰi",
    "oA": "wa", "oE": "wɛ", "uEO": "wʌ", "uI": "wi",
    "G": "k", "GG": "k͈", "Kh": "kʰ", "D": "t", "DD": "t͈", "Th": "tʰ", "B": "p", "BB": "p͈", "Ph": "pʰ", "J": "tɕ", "JJ": "tɕ͈", "CHh": "tɕʰ",
    "S": "s", "SS": "s͈", "H": "h", "N": "n", "M": "m", "NG": "ŋ", "R": "ɾ", "L": "l", "k": "k̚", "t": "t̚", "p": "p̚",
}
PALATAL_LABELS = ["I", "iA", "iE", "iEO", "iO", "iU"]
SPECIAL_LABELS = ["", "[PAD]", "[UNK]", "<s>", "</s>"]
#: IPA of references that no label has, by the label that stands in for them.
EXTRA_IPA_LABEL = {"ɛ": "E", "jɛ": "iE", "ɕ": "S", "ɕ͈": "SS", "we": "oE"}
IPA_LABEL = {ipa: label for label, ipa in LABEL_IPA.items()} | EXTRA_IPA_LABEL

# Phonetic features. Consonants: place, manner, voicing, aspiration, tenseness. Vowels: height, backness, rounding.
_PLAIN, _STRONG, _TENSE = ("none", "none"), ("strong", "none"), ("none", "tense")
CONSONANT_FEATURES = {}
for _place, _manner, _voicing, _symbols in (
    ("velar", "stop", "voiceless", "k k̚ kʰ k͈"), ("alveolar", "stop", "voiceless", "t t̚ tʰ t͈"), ("bilabial", "stop", "voiceless", "p p̚ pʰ p͈"),
    ("alveolar", "fricative", "voiceless", "s s͈"), ("alveolo-palatal", "fricative", "voiceless", "ɕ ɕ͈"), ("glottal", "fricative", "voiceless", "h"),
    ("alveolo-palatal", "affricate", "voiceless", "tɕ tɕʰ tɕ͈"), ("alveolar", "nasal", "voiced", "n"), ("bilabial", "nasal", "voiced", "m"),
    ("velar", "nasal", "voiced", "ŋ"), ("alveolar", "tap", "voiced", "ɾ"), ("alveolar", "lateral", "voiced", "l"), ("alveolar", "trill", "voiced", "r"),
):
    for _s in _symbols.split():
        CONSONANT_FEATURES[_s] = (_place, _manner, _voicing, *(_STRONG if _s.endswith("ʰ") else _TENSE if _s.endswith("͈") else _PLAIN))
SEMIVOWEL_FEATURES = {s: (p, "approximant", "voiced", "none", "none") for s, p in (("j", "palatal"), ("w", "labio-velar"), ("ɰ", "velar"))}
VOWEL_FEATURES = {
    s: (height, backness, rounding)
    for height, backness, rounding, symbols in (
        ("open", "front", "unrounded", "a ja"), ("open-mid", "front", "unrounded", "ɛ jɛ"), ("close-mid", "front", "unrounded", "e je"), ("close", "front", "unrounded", "i"),
        ("open-mid", "back", "unrounded", "ʌ jʌ"), ("close-mid", "back", "rounded", "o we jo"), ("close", "back", "rounded", "u ju"), ("close", "back", "unrounded", "ɯ ɯi"),
        ("close-mid", "front", "rounded", "ø"), ("close", "front", "rounded", "y"), ("open", "back", "rounded", "wa"), ("open-mid", "back", "rounded", "wʌ"), ("open-mid", "front", "rounded", "wɛ"),
    )
    for s in symbols.split()
}
CONSONANT_WEIGHTS = {"place": 0.25, "manner": 0.35, "voicing": 0.10, "aspiration": 0.18, "tenseness": 0.22}
VOWEL_WEIGHTS = {"height": 0.28, "backness": 0.28, "rounding": 0.18}
# What is added to a pair's cost, for all learners and for speakers of Russian; a pair has no order.
PAIR_COST = {
    "default": {
        ("tɕ", "tɕʰ"): -0.15, ("tɕ", "tɕ͈"): -0.15, ("tɕʰ", "tɕ͈"): -0.15, ("k", "kʰ"): -0.12, ("k", "k͈"): -0.12, ("t", "tʰ"): -0.12, ("t", "t͈"): -0.12,
        ("p", "pʰ"): -0.12, ("p", "p͈"): -0.12, ("s", "s͈"): -0.10, ("ɾ", "l"): -0.15, ("ʌ", "o"): -0.10, ("ɯ", "u"): -0.10, ("ɛ", "e"): -0.08,
    },
    "ru": {("ɾ", "l"): -0.25, ("tɕ", "tɕʰ"): -0.08, ("tɕ", "tɕ͈"): -0.08, ("ʌ", "o"): -0.10, ("ɯ", "u"): -0.10, ("s", "s͈"): -0.08},
}

# Thresholds of confidence, gaps and prosody rules.
LOW, VERY_LOW = 0.20, 0.05
LOW_FLOOR, VERY_LOW_FLOOR = 0.01, 0.001
LARGE_GAP, WARNING_GAP, FAILURE_GAP = 0.30, 0.80, 1.20
TOKEN_MIN_COUNT = 30
COARSE_SCORE = 75.0
TAIL_MAX_TRIM = 2
# Tokens whose frames give weak evidence.
WEAK_TOKENS = ["t̚", "k̚", "p̚", "ŋ", "t", "k", "p", "jo", "l"]
# Quality levels, worst first.
QUALITY_LEVELS = ["discardable", "usable_with_warnings", "minor_warnings", "clean"]
RULES = {"pitch_rising_excess": 0.1, "pitch_falling_excess": 0.1, "pitch_offset": 0.8, "syllable_elongation": 2.5, "eojeol_slow": 2.5}
WINDOW = {"size_ratio": 0.1, "stride_ratio": 0.05}
DIMS = "f0_mean f0_std f0_slope f0_range f0_max_pos f0_min_pos f0_start f0_end duration syllable_count last_syl_ratio voiced_ratio".split()
RULE_ORDER = ["pitch_rising_excess", "pitch_falling_excess", "pitch_offset", "eojeol_slow", "syllable_elongation"]
# Kinds of made-up faults, the dimension each moves, the direction, and the label it should get.
PERTURBATIONS = {
    "rising": ("f0_slope", 1, "rising 과도"), "falling": ("f0_slope", -1, "falling 과도"), "flat": ("f0_range", -1, "억양 평탄"),
    "elongation": ("last_syl_ratio", 1, "마지막 음절 elongation"), "slow": ("duration", 1, "어절 전체 느림"),
}
