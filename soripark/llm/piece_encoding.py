"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

In a BPE encoding every prefix of a text has one last token, and a token row is
an encoding exactly when each adjacent pair is one.  So one pass over an
automaton's matches fills a table "prefix end -> last token": among the tokens
that end there, the one that forms a valid pair with the last token of the
prefix before it.  Ids are read backwards from the table's end.

White space is a piece boundary: pieces hold the space mark at their start or
consist of it.  A text is therefore cut before space marks, and cut parts are
remembered.  Runs of marks merge after everything else and are encoded apart.

Texts are encoded by the group: of a group's parts those not remembered, each
once, fill their tables together, in numpy, the automaton a character further
in all of them at a time (``Tables``).  Few or long parts go one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm.common import give_back, table, whole_texts

SPACE = "▁"
#: Memory of a Python worker, with no effect on results: cut parts of up to so many characters, two generations that end at so many, and so many judged pairs.
LONGEST_REMEMBERED = 40
REMEMBERED = 60_000
REMEMBERED_PAIRS = 300_000
#: Texts are encoded in groups of about so many characters; so many parts of a group fill their tables together, longer ones or fewer one by one.  No effect on results.
GROUP = 500_000
TOGETHER = 32_768
LONGEST_TOGETHER = 64
FEWEST_TOGETHER = 200


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: pieces by id, merge order (0 first), byte ids, unknown and control ids."""

    pieces: tuple[str, ...]
    order: dict[str, int]
    byte_ids: tuple[int, ...]
    unknown: int
    controls: frozenset[int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; the result (one entry per piece) is broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(n))
    byte_ids = [-1] * 256
    normal = []
    for i, piece in enumerate(pieces):
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal.append(i)
    normal.sort(key=lambda i: (-model.get_score(i), i))
    rank, order, last = -1, {}, None
    for i in normal:
        if model.get_score(i) != last:
            rank, last = rank + 1, model.get_score(i)
        order[pieces[i]] = rank
    return Vocabulary(pieces, order, tuple(byte_ids), model.unk_id(), frozenset(i for i in range(n) if model.is_control(i)))


def merge_slowly(symbols: list[str], order: dict[str, int]) -> list[str]:
    """Plain BPE: join the best adjacent pair, leftmost among equals, until none is a piece."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (order.get(symbols[i] + symbols[i + 1], 1 << 60), i))
        if symbols[best] + symbols[best + 1] not in order:
            break
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols


class Tables:
    """The automaton in arrays, and the tables of many parts at once: ``Encoder.part`` for each, with the same matches and the same judgement of pairs.

    Nodes are numbered from 0, the root.  A node's successor by a character of class c stands at ``base[node] + c`` if
    ``owner`` names the node there.  ``fails`` is the node of the longest proper suffix, ``longest`` the node of the
    longest piece that ends a node's text, ``shorter`` that of the next shorter one; 0 where there is none.
    """

    def __init__(self, pieces: dict[int, str], order: dict[int, int], halves: dict[int, tuple[int, int]], n_ids: int):
        classes = {c: i for i, c in enumerate(sorted({c for p in pieces.values() for c in p}), 1)}
        width = len(classes) + 1
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in classes]] = list(classes.values())
        successors: dict[int, int] = {}
        parent, by, depth, token = [0], [0], [0], [-1]
        for i, piece in pieces.items():
            node = 0
            for c in piece:
                key = node * width + classes[c]
                if key not in successors:
                    successors[key] = len(parent)
                    parent.append(node)
                    by.append(classes[c])
                    depth.append(depth[node] + 1)
                    token.append(-1)
                node = successors[key]
            token[node] = i
        fails, longest, shorter = ([0] * len(parent) for _ in range(3))
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if depth[node] > 1:
                at = fails[parent[node]]
                while at and at * width + by[node] not in successors:
                    at = fails[at]
                fails[node] = successors.get(at * width + by[node], 0)
            shorter[node] = longest[fails[node]]
            longest[node] = node if token[node] >= 0 else shorter[node]
        self.fails, self.longest, self.shorter = (np.array(x, np.int32) for x in (fails, longest, shorter))
        self.token, self.length = np.array(token, np.int32), np.array(depth, np.int32)
        self._place(successors, width, len(parent))
        self.n_ids = n_ids
        self.order = np.zeros(n_ids, np.int64)
        self.order[list(order)] = list(order.values())
        self.size = np.ones(n_ids, np.int32)
        self.size[list(pieces)] = [len(p) for p in pieces.values()]
        self.halves = np.zeros((2, n_ids), np.int64)
        self.halves[:, list(halves)] = np.array(list(halves.values()), np.int64).reshape(-1, 2).T
        joined = sorted((a * n_ids + b, order[i]) for i, (a, b) in halves.items())
        self.joined = np.array([k for k, _ in joined] + [1 << 62], np.int64)
        self.joined_order = np.array([o for _, o in joined] + [1 << 60], np.int64)
        self.id_objects = np.array(range(n_ids), object)
        self.judged: np.ndarray | None = None

    def _place(self, successors: dict[int, int], width: int, nodes: int) -> None:
        """Finds each node a base where its successors' places are free, nodes of many successors first."""
        children: dict[int, list[int]] = {}
        for key in successors:
            children.setdefault(key // width, []).append(key % width)
        slots = 1 << (4 * len(successors)).bit_length()
        used = bytearray(slots + width)
        self.base, self.owner, self.target = np.zeros(nodes, np.int32), np.full(slots + width, -1, np.int32), np.zeros(slots + width, np.int32)
        base = 0
        for node in sorted(children, key=lambda x: (-len(children[x]), x)):
            own = children[node]
            while any(used[base + c] for c in own):
                base = (base * 1103515245 + 12345) % slots
            for c in own:
                used[base + c] = 1
            at = np.array(own) + base
            self.base[node], self.owner[at] = base, node
            self.target[at] = [successors[node * width + c] for c in own]

    def _step(self, state: np.ndarray, by: np.ndarray) -> np.ndarray:
        at = self.base[state] + by
        found = self.owner[at] == state
        out = np.where(found, self.target[at], 0)
        left = np.flatnonzero(~found & (state > 0))
        state = state[left]
        while left.size:
            state = self.fails[state]
            at = self.base[state] + by[left]
            found = self.owner[at] == state
            out[left[found]] = self.target[at[found]]
            on = ~found & (state > 0)
            left, state = left[on], state[on]
        return out

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Encoder._pair_is_valid`` of many pairs."""
        valid = np.zeros(len(left), bool)
        which, limit = np.arange(len(left)), np.full(len(left), 1 << 60)
        while which.size:
            key = left * self.n_ids + right
            at = np.searchsorted(self.joined, key)
            a, b = self.order[left], self.order[right]
            earlier = (self.joined[at] == key) & (self.joined_order[at] < limit)
            whole = ~earlier & (a <= b) & (b < 0)
            valid[which[whole]] = True
            on = ~(earlier | whole)
            which, left, right, a, b = which[on], left[on], right[on], a[on], b[on]
            first = a > b
            limit = np.where(first, a, b + 1)
            left, right = np.where(first, self.halves[1, left], left), np.where(first, right, self.halves[0, right])
        return valid

    def _valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Looks pairs up among those judged; a place keeps the pair that came last, others are judged anew."""
        if self.judged is None:
            self.judged = np.full(1 << 20, -1, np.int64)
        key = left.astype(np.int64) * self.n_ids + right
        place = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)
        got = self.judged[place]
        valid = (got & 1) == 1
        new = np.flatnonzero(got >> 1 != key)
        if new.size:
            keys, back = np.unique(key[new], return_inverse=True)
            judged = self._judge(keys // self.n_ids, keys % self.n_ids)[back]
            valid[new] = judged
            self.judged[place[new]] = key[new] << 1 | judged
        return valid

    def parts(self, texts: list[str]) -> tuple[list[tuple[int, ...]], list[int]]:
        """For each text its tokens, a character that is no piece as -1 - its code point; and the texts with such characters."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        by = self.classes[codes]
        rank = np.argsort(-lengths, kind="stable")  # longest first: texts that go on stand in front
        begin, ends = (np.cumsum(lengths) - lengths)[rank], lengths[rank]
        top = int(ends[0])
        going = n - np.searchsorted(ends[::-1], np.arange(top), side="right")
        last = np.full((top + 1) * n, -1, np.int32)  # by end, then text
        state = np.zeros(n, np.int32)
        for end in range(1, top + 1):
            k = going[end - 1]
            state = self._step(state[:k], by[begin[:k] + (end - 1)])
            node = self.longest[state]
            which = np.flatnonzero(node)
            node = node[which]
            while which.size:
                token = self.token[node]
                before = last[(end - self.length[node]) * n + which]
                ok = before < 0  # the text's start, or a character that is no piece
                pairs = np.flatnonzero(~ok)
                ok[pairs] = self._valid(before[pairs], token[pairs])
                last[end * n + which[ok]] = token[ok]
                on = ~ok
                node = self.shorter[node[on]]
                which = which[on][node > 0]
                node = node[node > 0]
        rounds, counts, which, end = [], np.zeros(n, np.int64), np.arange(n), ends
        while which.size:
            token = last[end * n + which]
            none = np.flatnonzero(token < 0)
            token[none] = -1 - codes[begin[which[none]] + end[none] - 1].astype(np.int32)
            rounds.append((which, token))
            counts[which] += 1
            end = end - np.where(token < 0, 1, self.size[token])
            which, end = which[end > 0], end[end > 0]
        placed = np.zeros(n, np.int64)
        placed[rank] = counts
        stops = np.cumsum(placed)
        stop = stops[rank]
        flat = np.zeros(stops[-1], np.int32)
        for i, (which, token) in enumerate(rounds):
            flat[stop[which] - 1 - i] = token
        ids = self.id_objects[np.maximum(flat, 0)]
        strange = np.flatnonzero(flat < 0)
        ids[strange] = flat[strange].tolist()
        ids, ends = ids.tolist(), stops.tolist()
        return [tuple(ids[b:e]) for b, e in zip(chain([0], ends), ends)], np.unique(np.searchsorted(stops, strange, side="right")).tolist()  # the last end begins none


class Encoder:
    """Tables and memory of one Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.ids = {v.pieces[i]: i for i in range(len(v.pieces)) if v.pieces[i] in v.order}
        self.order: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.valid: dict[int, bool] = {}
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.runs: dict[int, list[int]] = {}
        self.matches = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if SPACE in piece[1:]:  # a run of marks
                continue
            if len(piece) > 1:
                halves = self._halves(piece)
                if halves is None:
                    continue  # plain BPE never makes it
                self.halves[i] = halves
                self.joined[halves] = i
            self.order[i] = v.order[piece] if len(piece) > 1 else -1
            self.matches.add_word(piece, (i, len(piece)))
        self.matches.make_automaton()
        for i, (left, right) in self.halves.items():
            if self.order[i] <= max(self.order[left], self.order[right]):
                raise ValueError(f"piece {v.pieces[i]!r} merges before its own parts")
        self.tables = Tables({self.ids[p]: p for p in self.ids if self.ids[p] in self.order}, self.order, self.halves, len(v.pieces))
        self.breaks_lines = not any("\n" in p for p in self.ids)
        self.id_text = [str(i) for i in range(len(v.pieces))]
        self.raw = [b"" if i in v.controls else " ⁇ ".encode() if i == v.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        self.of_byte = {i: b for b, i in enumerate(v.byte_ids) if i >= 0}
        for i, b in self.of_byte.items():
            self.raw[i] = bytes([b])

    def _halves(self, piece: str) -> tuple[int, int] | None:
        order, symbols = self.vocabulary.order, list(piece)
        if not all(c in self.ids for c in symbols):
            raise ValueError(f"piece {piece!r} has a character that is no piece")
        while len(symbols) > 2:
            before = len(symbols)
            best = min(range(before - 1), key=lambda i: (order.get(symbols[i] + symbols[i + 1], 1 << 60), i))
            if symbols[best] + symbols[best + 1] not in order:
                return None
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return self.ids[symbols[0]], self.ids[symbols[1]]

    def _pair_is_valid(self, left: int, right: int) -> bool:
        """Undo the two tokens, latest merge first; at no time may what meets at the seam have merged earlier."""
        order, joined, halves = self.order, self.joined, self.halves
        limit = 1 << 60
        while True:
            both = joined.get((left, right))
            if both is not None and order[both] < limit:
                return False
            a, b = order[left], order[right]
            if a > b:
                limit, left = a, halves[left][1]
            elif b >= 0:  # of two equal merges the left one happened first, and one at the seam before the right one
                limit, right = b + 1, halves[right][0]
            else:
                return True

    def part(self, text: str) -> list[int]:
        """Ids of a text in which a space mark stands at the start only, if at all."""
        last: list[int] = [-1] * (len(text) + 1)
        valid = self.valid
        for end, (token, length) in self.matches.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before < 0:  # the text's start, or a character that is no piece
                last[end] = token
                continue
            key = before << 32 | token
            ok = valid.get(key)
            if ok is None:
                if len(valid) >= REMEMBERED_PAIRS:
                    valid.clear()
                ok = valid[key] = self._pair_is_valid(before, token)
            if ok:
                last[end] = token
        out, end, sizes = [], len(text), self.vocabulary.pieces
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
                end -= len(sizes[token])
            else:
                out.extend(reversed(self._spelled(text[end - 1])))
                end -= 1
        out.reverse()
        return out

    def _spelled(self, character: str) -> list[int]:
        spelled = [self.vocabulary.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]
        return spelled if min(spelled) >= 0 else [self.vocabulary.unknown]

    def parts(self, texts: list[str]) -> list[tuple[int, ...]]:
        """``part`` of each text."""
        together = [t for t in texts if 0 < len(t) <= LONGEST_TOGETHER]
        if len(together) < FEWEST_TOGETHER:
            return [tuple(self.part(t)) for t in texts]
        out: list[tuple[int, ...]] = []
        for begin in range(0, len(together), TOGETHER):
            got, strange = self.tables.parts(together[begin : begin + TOGETHER])
            for i in strange:
                got[i] = tuple(chain.from_iterable((t,) if t >= 0 else self._spelled(chr(-1 - t)) for t in got[i]))
            out += got
        if len(together) < len(texts):
            short = iter(out)
            out = [next(short) if 0 < len(t) <= LONGEST_TOGETHER else tuple(self.part(t)) for t in texts]
        return out

    def forget(self) -> None:
        """Drops the remembered parts and pairs, not the tables."""
        self.valid.clear()
        self.new, self.old, self.tables.judged = {}, {}, None

    def run(self, n: int) -> list[int]:
        """Ids of n space marks alone."""
        got = self.runs.get(n)
        if got is None:
            got = self._run(n)
            if n < 4096:
                self.runs[n] = got
        return got

    def _run(self, n: int) -> list[int]:
        order, longest = self.vocabulary.order, max((len(p) for p in self.ids if not p.strip(SPACE)), default=1)
        if n > 4 * longest:  # full blocks come first from the left; they are whatever a long run starts with
            head = self.run(4 * longest)
            block = self.ids.get(SPACE * longest)
            if block is not None and head[: len(head) - 1].count(block) == len(head) - 1:
                return [block] * (n // longest - 2) + self.run(n - longest * (n // longest - 2))
        return [self.ids[p] for p in merge_slowly([SPACE] * n, order)]

    def _cut(self, text: str) -> list[str]:
        """The keys of a text's parts: a word that follows a mark by itself, with marks before it if there are more of them; one that does not with a mark behind it; marks that no word follows; a line's end."""
        keys: list[str] = []
        marked = SPACE + text.replace(" ", SPACE)
        for i, line in enumerate(marked.split("\n") if self.breaks_lines else [marked]):
            if i:
                keys.append("\n")
            words = line.split(SPACE)
            if words[0]:
                words[0] += SPACE
            else:
                del words[0]
            if "" in words:
                waiting = ""
                for word in words:
                    if word:
                        keys.append(waiting + word)
                        waiting = ""
                    else:
                        waiting += SPACE
                if waiting:
                    keys.append(waiting)
            else:
                keys += words
        return keys

    def _learn(self, keys: Iterable[str]) -> None:
        """Remembers the ids of each key's part."""
        newline = "\n" if self.breaks_lines else None
        plain, others = [], []
        for key in keys:
            (others if SPACE in key or key == newline else plain).append(key)
        words = [key[:-1] if key[0] != SPACE and key != newline else SPACE + key.lstrip(SPACE) for key in others]
        parts = self.parts([SPACE + key for key in plain] + words)
        self.new.update(zip(plain, parts))  # the rest of the parts follows
        for key, word, got in zip(others, words, parts[len(plain) :], strict=True):
            if key == newline:
                got = (self.vocabulary.byte_ids[10] if self.vocabulary.byte_ids[10] >= 0 else self.vocabulary.unknown,)
            elif word == SPACE:
                got = tuple(self.run(len(key)))
            elif key[0] == SPACE:
                waiting = len(key) - len(word) + 1
                got = (*self.run(waiting + 1), *got[1:]) if got[0] == self.ids.get(SPACE) else (*self.run(waiting), *got)
            self.new[key] = got

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of whole texts, in order; null and the empty text have none."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self._cut(text) if text else [])
            size += len(text or "")
            if size >= GROUP:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[list[int]]:
        new, old = self.new, self.old
        unknown = set().union(*group).difference(new)
        recalled = [key for key in unknown if key in old]
        new.update(zip(recalled, map(old.__getitem__, recalled), strict=True))
        unknown.difference_update(recalled)
        self._learn(unknown)
        for keys in group:
            yield list(chain.from_iterable(map(new.__getitem__, keys)))
        for key in unknown:
            if len(key) > LONGEST_REMEMBERED:
                del new[key]
        if len(new) >= REMEMBERED:
            self.old, self.new = new if len(new) < 3 * REMEMBERED else {}, {}  # one very long text may bring more

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and the empty text have none."""
        (ids,) = self.encode_all([text])
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, one leading space dropped, bytes read as UTF-8 (a bad byte: U+FFFD)."""
        if not ids:
            return ""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.vocabulary.pieces[ids[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "soripark_each_byte")


def _each_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


import codecs  # noqa: E402

codecs.register_error("soripark_each_byte", _each_byte)

_encoders: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    """One encoder a worker and vocabulary; workers live on between tasks."""
    v = held.value
    key = hash((len(v.pieces), v.pieces[-50:], v.unknown))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(v)
    return _encoders[key]


def _id_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with an array<int> column of ids.  Null and empty texts: an empty array."""
    held = whole_texts(docs).sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        e = _encoder(held)
        return _id_lists([np.array(ids, np.int32) for ids in e.encode_all(x.as_py() for x in texts)])  # four bytes an id, a group of texts at a time

    return docs.withColumn(into, run(F.col(text)))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of an id array; null and empty arrays: the empty text."""
    held = whole_texts(docs).sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        e = _encoder(held)
        return pa.array([e.decode(rows[i].values.to_numpy().tolist() if rows[i].is_valid else []) for i in range(len(rows))], pa.string())

    return docs.withColumn(into, run(F.col(ids)))


def encode_checked(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with a struct: ids, and whether decoding them gives the text (space marks read as spaces; null as empty).

    The same encoding and decoding as ``encode`` and ``decode``, in one trip to Python: two would take two workers a
    task, each with an encoder, and the decoded texts would pass the JVM.  What a worker remembers ends with its task.
    """
    held = whole_texts(docs).sparkContext.broadcast(vocabulary)
    fields = [pa.field("ids", pa.list_(pa.int32())), pa.field("round_trip", pa.bool_())]

    @F.arrow_udf("struct<ids: array<int>, round_trip: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = _encoder(held)
        for texts in batches:
            rows, same = [], []
            for whole, ids in zip(texts, e.encode_all(x.as_py() for x in texts), strict=True):
                rows.append(np.array(ids, np.int32))
                same.append(e.decode(ids) == (whole.as_py() or "").replace(SPACE, " "))
            yield pa.StructArray.from_arrays([_id_lists(rows).cast(fields[0].type), pa.array(same, pa.bool_())], fields=fields)
        texts = rows = None
        e.forget()
        give_back()

    return docs.withColumn(into, run(F.col(text)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with n_tokens and the SHA-256 of ids and of the decoded text, without keeping either.

    The same encoding and decoding as ``encode`` and ``decode``, in one trip to Python.
    """
    held = whole_texts(docs).sparkContext.broadcast(vocabulary)
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(texts: pa.Array) -> pa.Array:
        e = _encoder(held)
        n, a, b = [], [], []
        for ids in e.encode_all(x.as_py() for x in texts):
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(e.id_text.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], fields=fields)

    return docs.withColumn(into, run(F.col(text)))


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    vocabulary = load_vocabulary(model_path or default_model_path())
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "pieces.*")
