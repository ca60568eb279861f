"""Near-duplicate groups by exact n-gram Jaccard similarity, with prefix filters under two global orders.

Documents with equal shingle sets are one node.  Shingles that one set alone holds are
in no intersection, and a set needs ``percent`` of its shingles repeated to link at all,
so most documents end here; which are repeated is found by ranges of hashes, first among
all documents and then among the different sets left.  These keep their repeated shingles
("kept"), and all later steps read these, never the texts.

Under any global order, the first common token of two linked sets has all their
overlap at or behind it.  At place i of m kept tokens it leaves m - i, so a set of n
tokens links there only with sets of at most ``cap`` tokens, the largest size whose
needed overlap is m - i.  Two sets are a candidate under an order if at some common
token each one's size is within the other's cap.  Two orders are used, each by rising
token frequency as a row of a count-min sketch sees it, so tokens of common passages
stand at the end of both.  Candidates must meet under both before they are verified.

Groups of near copies do not become pairs: first each node is verified against a few
of the best sets that hold its tokens.  Then only pairs between different components
are generated and verified.  A pair left out lies in one component already, so no
link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soripark.llm import sketch, token_ranges
from soripark.llm.common import drop_shuffles, forget, saved, slices, small, table, text_bytes, tidy, whole_texts
from soripark.llm.components import components
from soripark.llm.hashing import batch_word_hashes, batches_of, mix, shingle_hashes

WORDS = 5
PERCENT = 75
ORDERS = 2
#: Sets of a token that are proposed to the others, and proposals of each kind that a node has verified; they save pairs, the search after them is whole.
LEADERS, PROPOSALS = 4, 2
#: Most cells of a row of counts (two bytes each); an order, not a result, depends on them.
MOST_COUNT_BITS = 21
#: Pairs that one copy of a set meets in a task.
HUB_PAIRS = 500
#: So many rows of a few longs are broadcast (24 MB); more are joined by shuffle.
BROADCAST_LONGS = 1_000_000
_NO_ID = np.iinfo(np.int64).min


def shingle_sets(texts: list[bytes], k: int):
    """The sorted distinct shingle hashes of each text, ASCII letters lower-cased; a shorter text is one shingle."""
    lowered = [t.lower() for t in texts]
    for a, b in batches_of(lowered):
        words, counts = batch_word_hashes(lowered[a:b])
        all_ = shingle_hashes(words, k)
        begin = 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(all_[begin : begin + n - k + 1])
            else:
                yield shingle_hashes(words[begin : begin + n], n) if n else np.zeros(0, np.uint64)
            begin += n


def fingerprint(tokens: np.ndarray) -> int:
    """A set's 64-bit hash as a signed number; equal sets, equal hashes, in whatever order."""
    return int(mix(np.array([mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).astype(np.int64)[0])


def _listed(kept: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> pa.Array:
    """``kept`` cut by ``counts`` into lists, null where not ``whole``."""
    ends = np.cumsum(counts)
    return pa.array([kept[b - n : b].view(np.int64) if w else None for b, n, w in zip(ends.tolist(), counts.tolist(), whole.tolist())], pa.list_(pa.int64()))


def token_sets(docs: DataFrame, k: int, percent: int, tokens: float) -> DataFrame:
    """id, hash, node and size of each document's set; of sets that can link, once a task, the kept tokens.  ``tokens`` says about how many there are."""

    def reader():
        seen: set[int] = set()

        def sets(batch):
            all_ = list(shingle_sets(text_bytes(batch.column(1)), k))
            nodes = [fingerprint(x) if len(x) else 0 for x in all_]
            own = []
            for node, x in zip(nodes, all_):
                own.append(x[:0] if node in seen else x)
                seen.add(node)
            ids = [_NO_ID if x is None else x for x in batch.column(0).to_pylist()]
            return [ids, batch.column(2).to_numpy(zero_copy_only=False), nodes, [len(x) for x in all_]], own

        return sets

    def result(header, kept, counts):
        ids, hashes, nodes, sizes = header
        live = (counts > 0) & (100 * counts >= percent * sizes)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(nodes), pa.array(sizes.astype(np.int32)), _listed(kept, counts, live)], ["__sp_id", "hash", "node", "size", "kept"])

    return token_ranges.repeated_in(docs, reader, 4, tokens, result, "__sp_id long, hash long, node long, size int, kept array<long>")


def linkable(live: DataFrame, percent: int, tokens: float) -> DataFrame:
    """node, size and kept tokens of different sets: the tokens that two of them hold, and the sets that have enough of these."""

    def sets(batch):
        return [batch.column(0).to_numpy(), batch.column(1).to_numpy()], [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column(2)]

    def result(header, kept, counts):
        nodes, sizes = header
        live = (counts > 0) & (100 * counts >= percent * sizes)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sizes.astype(np.int32)), _listed(kept, counts, live)], ["node", "size", "kept"]).filter(pa.array(live))

    return token_ranges.repeated_in(live.select("node", "size", "kept"), lambda: sets, 2, tokens, result, "node long, size int, kept array<long>")


def first_tokens(live: DataFrame, percent: int, flags: Broadcast, bits: int, counts: Broadcast) -> DataFrame:
    """The tokens of each set under each order at which a link can begin, and the size of its largest partner there.

    The last two bits of a token are the number of its order; ``common`` is the mean logarithm of the counts of the
    set's kept tokens, large for sets in the middle of a group of near copies.  ``flags`` may leave out tokens that occur once;
    without a row of them all stay.
    """

    def run(batches):
        repeated = [np.frombuffer(x, np.uint8) for x in flags.value]
        rows = [np.frombuffer(c, np.uint16) for c in counts.value]
        count_bits = len(rows[0]).bit_length() - 1
        for batch in slices(batches):
            out = [[], [], [], [], []]
            for node, n, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = kept.values.to_numpy(zero_copy_only=False).view(np.uint64)
                tokens = tokens[sketch.flagged(repeated, tokens, bits)]
                m = len(tokens)
                first = m + percent * n // -100 + 1  # so many tokens leave enough for the smallest partner
                if first <= 0:
                    continue
                cap = (100 + percent) * (m - np.arange(first)) // percent - n
                counted = [row[sketch.cells(tokens, r, count_bits)] for r, row in enumerate(rows)]
                common = float(np.log2(np.maximum(np.minimum.reduce(counted), 1)).sum()) / n
                for r, row in enumerate(counted):
                    own = mix(tokens + np.uint64(r))
                    first_own = own[np.lexsort((own, row))[:first]]
                    out[0].append((first_own & ~np.uint64(3) | np.uint64(r)).view(np.int64))
                    out[1].append(np.full(first, node, np.int64))
                    out[2].append(np.full(first, n, np.int32))
                    out[3].append(cap.astype(np.int32))
                    out[4].append(np.full(first, common, np.float32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "node", "size", "cap", "common"])

    return live.mapInArrow(tidy(run), "token long, node long, size int, cap int, common float")


def _under_all_orders(met: DataFrame) -> DataFrame:
    """The pairs (a, b) that have met at a token of every order."""
    order = F.bit_or(F.expr("shiftleft(1, cast(token & 3 as int))"))
    return met.groupBy("a", "b").agg(order.alias("orders")).where(F.col("orders") == 2**ORDERS - 1).select("a", "b")


def proposals(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with a few sets among the leaders of its first tokens.

    A token's leaders are the sets with the largest ``common`` and with the most kept tokens for their size, and
    sets picked by the hash of their node, those with a large cap first, so that a group's tokens agree on them.
    Of its tokens' leaders a node takes those with the largest ``common`` and those it meets most often.  These are
    guesses whom to verify first: one order is enough for them.
    """
    share = F.col("cap") / F.col("size")
    picked = [(share >= 1.2).cast("int") + (share >= 1).cast("int") + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2**30)) / 2.0**30 for k in range(2, LEADERS)]
    best = [F.max(F.struct(w.alias("w"), F.struct("node", "size", "cap", "common").alias("l"))) for w in (F.col("common").cast("double"), share, *picked)]
    leaders = postings.groupBy("token").agg(F.array(*best).alias("x"), F.count("*").alias("sets"))
    leaders = leaders.where("sets > 1").select("token", F.array_distinct(F.transform("x", lambda e: F.struct(e["l"]["node"].alias("node"), e["l"]["size"].alias("size"), e["l"]["cap"].alias("cap"), e["l"]["common"].alias("common")))).alias("x"))
    met = postings.join(leaders, "token").select("node", "size", "cap", F.explode("x").alias("l")).where("node <> l.node and size <= l.cap and l.size <= cap")
    shared = met.groupBy(F.col("node").alias("a"), F.col("l.node").alias("b")).agg(F.count("*").alias("n"), F.max("l.common").alias("common"))
    rank = lambda first, then: F.row_number().over(Window.partitionBy("a").orderBy(F.col(first).desc(), F.col(then).desc(), "b"))
    return shared.withColumns({"often": rank("n", "common"), "middle": rank("common", "n")}).where(F.least("often", "middle") <= PROPOSALS).select("a", "b")


def _undecided(postings: DataFrame, joined: DataFrame) -> DataFrame:
    """The postings with their component, of tokens that sets of two components hold."""
    placed = postings.join(small(joined, joined.count(), BROADCAST_LONGS), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return placed.join(several, "token", "left_semi")


def _bucket(size):
    """Sizes in steps of a tenth."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1.1))).cast("int")


def across_components(rest: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that are candidates under every order.

    The larger set of a pair looks for smaller ones by token and size.  The sets of a token's most
    common component meet only those of the others.
    """
    each = rest.groupBy("token", "component").count()
    main = each.groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    marked = saved(rest.join(main, "token").withColumn("is_main", F.col("component") == F.col("main")).drop("main"))
    larger = marked.withColumn("bucket", F.explode(F.sequence(_bucket(F.ceil(F.col("size") * percent / 100)), _bucket(F.least("cap", "size"))))).alias("x")
    smaller = marked.where("cap >= size").withColumn("bucket", _bucket(F.col("size"))).alias("y")
    linkable = F.expr(
        "x.token = y.token and x.bucket = y.bucket and x.component <> y.component and y.size <= x.cap and x.size <= y.cap"
        " and (y.size < x.size or y.size = x.size and y.node < x.node)"
    )
    met = larger.where("not is_main").join(smaller, linkable).union(larger.where("is_main").join(smaller.where("not is_main"), linkable))
    return _under_all_orders(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.token").alias("token")))


def verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; shingles that occur once are in no intersection.

    The sets of a meet their pairs, and the sets of b, each in one copy for ``HUB_PAIRS`` pairs, meet these.
    """
    n = pairs.count()
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("copies"))
    own = pairs.join(small(copies, n, BROADCAST_LONGS), "b").withColumn("copy", F.pmod(F.xxhash64("a", "b"), F.col("copies")).cast("int")).drop("copies")
    sets = lambda side: live.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("kept").alias(f"kept_{side}"))
    with_a = sets("a").join(small(own, n, BROADCAST_LONGS), "a")
    spread = sets("b").join(small(copies, n, BROADCAST_LONGS), "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = F.size(F.array_intersect("kept_a", "kept_b")).cast("long")
    linked = 100 * both >= percent * (F.col("size_a").cast("long") + F.col("size_b") - both)
    return with_a.join(spread, ["b", "copy"]).where(linked).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a row of ``docs``: doc_id, text_hash, n_shingles, node (its set), component_id (least doc_id
    reachable by links), is_first (whether this id and text come first in their component).

    Null or wordless text: no shingles, linked with nothing, its own component.  A null id is its own
    component unless linked; it is never another's component_id while that has an id.  Rows with one
    id and different texts join their components only through links of their texts.
    """
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("__sp_id"), F.col(text).alias("text"), text_hash(text).alias("hash"))
    share = whole_texts(docs).sparkContext.broadcast
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    every = saved(token_sets(own, k, percent, chars / 6))
    drop_shuffles(every)
    sets = saved(every.drop("kept"))
    different = saved(every.where("kept is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("kept").alias("kept")))
    forget(every)
    held = different.agg(F.sum(F.size("kept"))).first()[0] or 0
    live = saved(linkable(different, percent, held))
    forget(different)
    drop_shuffles(live)
    kept = live.agg(F.sum(F.size("kept"))).first()[0] or 0
    lists = lambda batch: (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column(0))
    flags, bits = share([]), 16  # the kept tokens are repeated, all of them
    counts = share(sketch.build(live.select("kept"), lists, ORDERS, sketch.bits_for(kept, MOST_COUNT_BITS), lambda n: np.minimum(n, 65535).astype(np.uint16).tobytes()))
    postings = saved(first_tokens(live, percent, flags, bits, counts))
    flags.destroy()
    counts.destroy()
    drop_shuffles(postings)

    edges = lambda pairs: components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    asked = saved(proposals(postings))
    drop_shuffles(asked)
    links = saved(verified(asked, live, percent))
    rest = saved(_undecided(postings, edges(links)))
    drop_shuffles(rest)
    untried = saved(across_components(rest, percent).join(asked.union(asked.select("b", "a")), ["a", "b"], "left_anti"))
    final = edges(links.union(saved(verified(untried, live, percent))))
    forget(rest, postings, live)
    drop_shuffles(sets)

    grouped = sets.drop("kept").join(final, "node", "left").withColumn("group", F.coalesce("component", "node"))
    real = F.when(F.col("__sp_id") != _NO_ID, F.col("__sp_id"))
    here = F.struct(real.isNull().alias("null"), F.col("__sp_id").alias("id"), F.col("hash").alias("hash"))
    least = grouped.where("size > 0").groupBy("group").agg(F.min(real).alias("least"), F.min(here).alias("first"))
    out = grouped.join(least, "group", "left")
    linked = F.col("size") > 0
    return out.select(real.alias("doc_id"), F.col("hash").alias("text_hash"), F.col("size").cast("long").alias("n_shingles"), "node",
                      F.when(linked, F.col("least")).otherwise(real).alias("component_id"), F.when(linked, here == F.col("first")).otherwise(True).alias("is_first"))


def text_hash(text: str):
    """Tells rows of one id apart (null counts as empty)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but the first row (least id) of each near-duplicate group; of equal rows one stays.

    Texts without words are no near duplicates and all stay, but for equal rows.
    """
    keep = near_duplicates(docs, doc_id, text, k, percent).where("is_first").select(F.col("doc_id").alias("__sp_id"), F.col("text_hash").alias("__sp_hash")).distinct()
    keyed = docs.withColumns({"__sp_id": F.col(doc_id).cast("long"), "__sp_hash": text_hash(text)})
    d, n = keyed.alias("d"), keep.alias("n")
    kept = d.join(n, F.col("d.__sp_hash").eqNullSafe(F.col("n.__sp_hash")) & F.col("d.__sp_id").eqNullSafe(F.col("n.__sp_id")), "left_semi")
    once = F.row_number().over(Window.partitionBy("__sp_hash", "__sp_id").orderBy("__sp_hash"))
    return kept.withColumn("__sp_once", once).where("__sp_once = 1").drop("__sp_id", "__sp_hash", "__sp_once")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
