"""Main text of web pages by deducing each host's template from token equivalence classes.

A page becomes tokens: start tags and text blocks, each with the containers about
it.  Over a host's pages every token has an occurrence vector; its fingerprint is
the sum of count x page hash, so it comes from a plain grouped sum and no host's
pages ever meet in one task.  Tokens of one host with one fingerprint form an
equivalence class.  A class is part of the template if it is large, holds a tag,
and has enough different pages; classes nest by how many pages they span.  On a
page a class counts only where its tokens keep the template's order.

Text blocks of the template itself are dropped, but for headings of slots that are
kept.  The other text stands in slots: a slot is the innermost container that the
template repeats.  The slot with most words on a host's pages, readers' comments by
name aside, is the main one.
Text in it is kept whatever its own elements are called; a container of the template
inside it is left out if its element or name says furniture.  All other slots, large or
small, are kept unless they are such furniture.  Pages of a host without a template
fall back on elements and names.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import saved, table, whole_texts

#: A class needs this many tokens, this share of its host's pages, this many of 64 page-hash buckets, and this product of tokens and buckets.
CLASS_SIZE = 3
CLASS_SHARE = 0.5
CLASS_PAGES = 2
CLASS_EVIDENCE = 24
#: Template tokens of all hosts together up to which templates are broadcast; beyond, pages meet them by shuffle, each host's in so many parts.
BROADCAST_TOKENS = 100_000
HOST_PARTS = 16
#: A page's part of a fingerprint; sums of count x page stay exact in 38 digits.
_PAGE_BITS = (1 << 60) - 1

# HTML element names and usual names of page furniture.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"article", "aside", "blockquote", "body", "center", "details", "dialog", "div", "figure", "footer", "form", "header", "main", "menu", "nav", "section", "table", "td"}
BLOCKS = CONTAINERS | {"address", "caption", "dd", "dl", "dt", "fieldset", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "html", "li", "ol", "p", "pre", "tbody", "tfoot", "th", "thead", "tr", "ul"}
FURNITURE_TAGS = {"aside", "dialog", "footer", "form", "head", "header", "menu", "nav"}
FURNITURE_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "alert", "author-box", "banner", "banners", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent",
    "cookie", "cookies", "disclaimer", "discussion", "disqus", "footer", "footers", "gdpr", "header", "headers", "login", "masthead", "menu", "menus", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "privacy", "promo", "promotion", "recommended", "related", "replies", "reply", "respond",
    "search", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget", "widgets",
}
READER_NAMES = {"comment", "comments", "discussion", "disqus", "replies", "reply", "respond"}
#: Words that say nothing of a part's role: a name of several words says furniture if one of them does and the others are of these, or furniture as well.
PLAIN_WORDS = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "card", "center", "column", "container", "content", "entry", "field", "fixed", "form", "global", "group",
    "holder", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "more", "news", "outer", "overlay", "page", "panel", "post", "posts", "primary", "reader",
    "right", "row", "secondary", "section", "site", "slot", "small", "stories", "story", "sub", "text", "thread", "toggle", "top", "trail", "unit", "user", "wrap", "wrapper", "zone",
}
FURNITURE_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _names(attributes: str) -> tuple[str, bool, bool]:
    """The part of a tag that marks its role (class, id and a furniture role, without digits), whether that says page furniture, and whether it is hidden."""
    if not attributes or attributes.isspace():
        return "", False, False
    values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    names = (values.get("class", "") + " " + values.get("id", "")).lower().split()
    role = values.get("role", "").lower()
    names += [role] if role in FURNITURE_ROLES else []
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    return re.sub(r"\d+", "", ".".join(names)), _furniture_names(names), hidden


def _furniture_names(names: list[str]) -> bool:
    for name in names:
        words = [w for w in re.split(r"[-_.\d]+", name) if w]
        if name in FURNITURE_NAMES or name in FURNITURE_ROLES or (any(w in FURNITURE_NAMES for w in words) and all(w in FURNITURE_NAMES or w in PLAIN_WORDS for w in words)):
            return True
    return False


def _is_furniture(path: str) -> bool:
    """Whether the innermost container of a path is page furniture by its element or names."""
    tag, *names = path.rpartition("/")[2].split(".")
    return tag in FURNITURE_TAGS or _furniture_names(names)


def parse(source: str | None) -> list[tuple[str, str, str | None, bool, bool]]:
    """Tokens of a page in order: (containers, tag, text or None for a start tag, whether it stands in page furniture, whether it is hidden)."""
    out: list[tuple[str, str, str | None, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # element, containers, furniture, hidden
    held: list[str] = []
    at, source = 0, source or ""

    def place():
        return stack[-1][1:] if stack else ("", False, False)

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            where, furniture, hidden = place()
            out.append((where, "", text, furniture, hidden))

    def close(names, within):
        """Ends the innermost open element of these names, unless one of ``within`` stands before it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if any(x[0] in BLOCKS for x in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    while m := _TOKEN.match(source, at):
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                held.append(html.unescape(piece))
            continue
        name = name.lower()
        if m[1]:
            if name == "p":
                flush()
            if name == "br":
                held.append(" ")
            close({name}, CONTAINERS - {name} if name not in CONTAINERS else ())
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I | re.S).search(source, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(source)
            if name in ("select", "button"):
                held.append(" ")
            continue
        if name in BLOCKS:
            flush()
            close({"p"}, CONTAINERS)
        if name in CLOSED_BY:
            close(CLOSED_BY[name], {"ul", "ol", "dl", "table"} | CONTAINERS - {"td"})
        label, furniture, hidden = _names(m[3])
        where, inside, unseen = place()
        if name in CONTAINERS:
            where = f"{where}/{name}" + (f".{label}" if label else "")
        furniture, hidden = inside or furniture or name in FURNITURE_TAGS, unseen or hidden
        out.append((where, name, None, furniture, hidden))
        if name not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((name, where, furniture, hidden))
    flush()
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SEEN = "host string, kind string, token long, path string, count decimal(38,0), print decimal(38,0), place double, pages long, buckets long, words long"
_SEEN_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.float64(), pa.int64(), pa.int64(), pa.int64()]


def _occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token: how often, on how many pages, the vector's fingerprint and mean place; and (kind slot) per path the words of visible text."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict[tuple, list] = {}
                tokens = parse(source)
                for i, (where, tag, text, _, hidden) in enumerate(tokens):
                    key = ("tag", _hash(where, tag), where if tag in CONTAINERS else None) if text is None else ("text", _hash(where, text), None)
                    seen = own.setdefault(key, [0, 0.0])
                    seen[0] += 1
                    seen[1] += i / len(tokens)
                    if text is not None and not hidden:
                        slot = sums.setdefault((host, "slot", 0, where), [0, 0, 0.0, 0, 0, 0])
                        slot[5] += len(text.split())
                page = _hash(source or "") & _PAGE_BITS
                bit = 1 << (page & 63) if (page & 63) < 63 else -(1 << 63)
                for (kind, token, path), (n, place) in own.items():
                    s = sums.setdefault((host, kind, token, path), [0, 0, 0.0, 0, 0, 0])
                    s[0] += n
                    s[1] += n * page
                    s[2] += place / n
                    s[3] += 1
                    s[4] |= bit
                s = sums.setdefault((host, "page", 0, None), [0, 0, 0.0, 0, 0, 0])
                s[3] += 1
            rows = [(*k, *v) for k, v in sums.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SEEN_TYPES)], [c.split()[0] for c in _SEEN.split(", ")])

    seen = pages.select("host", "html").mapInArrow(run, _SEEN)
    return seen.groupBy("host", "kind", "token", "path").agg(*(F.sum(c).alias(c) for c in ("count", "print", "place", "pages", "words")), F.bit_or("buckets").alias("buckets"))


def templates(pages: DataFrame, class_size: int = CLASS_SIZE, share: float = CLASS_SHARE, class_pages: int = CLASS_PAGES, evidence: int = CLASS_EVIDENCE) -> DataFrame:
    """One row a host: ``template``, its classes' tokens (class, token, is text, container path), outer classes first, and ``slots`` (path, words).

    A class's tokens stand equally often on each page, once or more.
    """
    wide = F.bit_count("buckets") >= class_pages
    seen = saved(_occurrences(pages).where(F.col("kind").isin("page", "slot") | wide))
    size = seen.where("kind = 'page'").select("host", F.col("pages").alias("host_pages"))
    tokens = seen.where("kind in ('tag', 'text')")
    different = F.bit_count("b")
    classes = (
        tokens.groupBy("host", "count", "print", "pages")
        .agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "tag").alias("tags"), F.bit_or("buckets").alias("b"))
        .where((F.col("n") >= class_size) & (F.col("tags") > 0) & (different >= class_pages) & (F.col("n") * different >= evidence))
        .join(size, "host")
        .where(F.col("pages") >= share * F.col("host_pages"))
        .select("host", "count", "print", "pages")
    )
    entry = F.struct((-F.col("pages")).alias("outer"), F.xxhash64("count", "print").alias("cls"), (F.col("place") / F.col("pages")).alias("place"), F.col("token").alias("token"), (F.col("kind") == "text").alias("text"), F.col("path").alias("path"))
    structure = saved(tokens.join(classes, ["host", "count", "print", "pages"]).select("host", entry.alias("e")))
    in_template = structure.groupBy("host").agg(F.sort_array(F.collect_list("e")).alias("template"))
    # a path's slot: the longest of its beginnings that the template repeats
    repeated = structure.where("e.path is not null").select("host", F.col("e.path").alias("slot")).distinct()
    steps = F.split("path", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    of = seen.where("kind = 'slot'").select("host", "path", "words", F.explode(begins).alias("slot"))
    own = of.join(repeated, ["host", "slot"]).groupBy("host", "path").agg(F.max_by("slot", F.length("slot")).alias("slot"), F.first("words").alias("words"))
    slots = own.groupBy("host", "slot").agg(F.sum("words").alias("words")).groupBy("host").agg(F.collect_list(F.struct(F.col("slot").alias("path"), "words")).alias("slots"))
    return size.select("host").join(in_template, "host", "left").join(slots, "host", "left")


def kept_slots(containers: set[str], slots: dict[str, int]) -> dict[str, bool]:
    """Whether the text of each slot is kept, whatever its size; ``containers``: all paths of the template, ``slots``: the words of those that hold text.

    The main slot is the one with most words among those that no name gives to readers' comments, which may well be
    longer than the article; of equally large ones the first by path.
    """
    if not slots:
        return {}
    own = [p for p in slots if not READER_NAMES & set(re.split(r"[-_./]+", p))] or list(slots)
    main = max(sorted(own), key=slots.__getitem__)
    under = lambda path, top: path == top or path.startswith(top + "/")
    # of a slot's containers those that are not the main one's as well
    return {path: not any(_is_furniture(c) for c in containers if under(path, c) and not under(main, c)) for path in slots}


def page_text(source: str | None, template: list[tuple[int, int, bool]] | None, kept: dict[str, bool] | None) -> str:
    """The main text of one page; ``template`` in order: (class, token, whether it is text); ``kept``: of ``kept_slots``.

    Text outside all slots, and all text where there is no template, is kept unless it stands in furniture.  A
    template's heading is the article's own where it begins inside a slot that is kept.
    """
    tokens = parse(source)
    found: set[int] = set()
    if template:
        known = {t: c for c, t, _ in template}
        order: dict[int, list[int]] = {}
        for c, t, _ in template:
            order.setdefault(c, []).append(t)
        on_page: dict[int, list[int]] = {}
        keys = [_hash(where, tag if text is None else text) for where, tag, text, _, _ in tokens]
        for key in keys:
            if key in known:
                on_page.setdefault(known[key], []).append(key)
        valid = {c for c, seq in on_page.items() if seq == order[c] or (len(seq) > len(order[c]) and len(set(Counter(seq).values())) == 1 and set(seq) == set(order[c]))}
        found = {i for i, key in enumerate(keys) if known.get(key) in valid}
    slot_of: dict[str, bool | None] = {}

    def decided(where: str) -> bool | None:
        if where not in slot_of:
            path = where
            while path and path not in kept:
                path = path.rpartition("/")[0]
            slot_of[where] = kept[path] if path else None
        return slot_of[where]

    out = []
    for i, (where, _, text, furniture, hidden) in enumerate(tokens):
        if text is None or hidden:
            continue
        keep = decided(where) if kept else None
        if i in found and not (keep and i and tokens[i - 1][1] in HEADINGS and tokens[i - 1][0] == where):
            continue
        if (not furniture) if keep is None else keep:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, url: str = "url", source: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` with a string column of main text.

    Null or empty html, or a page of furniture only: the empty text.  A null or odd url: its pages are
    one host, the empty name.  Repeated pages do not make a template by themselves: a class must span
    ``CLASS_PAGES`` different page hashes, so a host of one page has none and its pages fall back on
    elements and names.  Unclosed and stray tags are tolerated.
    """
    whole_texts(pages)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    keyed = pages.withColumn("__sp_host", host)
    known = templates(keyed.select(F.col("__sp_host").alias("host"), F.col(source).alias("html")))
    known = saved(known.select(F.col("host").alias("__sp_host"), F.struct("template", "slots").alias("__sp_template")))
    entries = known.select(F.size("__sp_template.template").alias("a"), F.size("__sp_template.slots").alias("b")).agg(F.sum(F.greatest("a", F.lit(0)) + F.greatest("b", F.lit(0)) + 1)).first()[0] or 0
    on = ["__sp_host"]
    if entries <= BROADCAST_TOKENS:
        known = F.broadcast(known)
    else:  # a large host's pages go to several tasks
        keyed = keyed.withColumn("__sp_part", F.pmod(F.xxhash64(F.col(source)), F.lit(HOST_PARTS)))
        known = known.withColumn("__sp_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOST_PARTS - 1).cast("long"))))
        on.append("__sp_part")

    @F.arrow_udf("string")
    def text_of(sources: pa.Array, template: pa.Array) -> pa.Array:
        out, last, ready = [], None, (None, None)
        for s, t in zip(sources, template):
            t = t.as_py()
            if t != last:
                last, entries = t, (t or {}).get("template") or []
                slots = {e["path"]: e["words"] for e in (t or {}).get("slots") or []}
                ready = [(e["cls"], e["token"], e["text"]) for e in entries], kept_slots({e["path"] for e in entries if e["path"]}, slots)
            out.append(page_text(s.as_py(), *ready))
        return pa.array(out, pa.string())

    return keyed.join(known, on, "left").withColumn(into, text_of(F.col(source), F.col("__sp_template"))).drop(*on, "__sp_template")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
