"""Small document tables with the awkward cases of every operator."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, __x array<int>, size int"

_SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or".split(), "fr": "le re la de en eau ou ai tion que ment é è".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(seed: int = 3, n: int = 40):
    """Rows of SCHEMA: nulls in every column, empty and wordless texts, copies, near copies, shared passages, one long text, equal rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        rows.append((i, prose(rng, lang, rng.randint(5, 120)), lang, f"s{i % 3}"))
    base = rows[3][1].split()
    passage = prose(rng, "en", 60)
    for i in range(n, n + 8):  # near copies of one text
        words = base[:]
        words[rng.randrange(len(words))] = "changed%d" % i
        rows.append((i, " ".join(words), "en", "s0"))
    for i in range(n + 8, n + 14):  # a passage that several share
        rows.append((i, prose(rng, "en", 30) + "\n" + passage + "\t " + prose(rng, "en", 30), "en", "s0"))
    rows += [
        (n + 14, None, "en", "s1"), (n + 15, "", "fr", None), (n + 16, " \t\n ", None, "s2"), (n + 17, "12 34 !?", "en", None), (n + 18, "one", "en", "s1"), (n + 19, "One", None, "s1"),
        (None, rows[3][1], "en", "s2"), (None, None, None, None), (n + 20, prose(rng, "en", 6000), "en", "s1"), (n + 21, "again and " * 200, "en", "s1"),
        (n + 22, rows[5][1].upper(), "fr", "s2"), (n + 22, rows[5][1].upper(), "fr", "s2"), (n + 23, "x" * 40000, None, "s1"), (n + 24, "日本語 の 文 é ü  " + rows[6][1], "fr", "s9"),
    ]
    return [(a, b, c, d, len(b or ""), "clash", [1], 7) for a, b, c, d in rows]
