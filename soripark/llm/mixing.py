"""Mixing sources to target weights by hash thresholds; DataFrame operations only.

Each source has a token budget.  A budget is whole passes over the source plus a
rest.  Every row has a fixed 60-bit hash; the rest is met by the rows below a
threshold hash.  The threshold is found without sorting rows: token sums per
source and 12-bit hash bucket give the bucket in which the budget ends, then only
that bucket's rows are summed again by the next 12 bits, five times in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soripark.llm.common import WORD, saved, small, table

HASH_BITS = 60
LEVEL_BITS = 12
MAX_REPEATS = 3


def row_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text (null: empty text), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def with_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: the whole is shared by the weights 1, 2, 3,
    repeating in code point order (null last); no target exceeds ``max_repeats`` times its source.

    One row per source goes through one window: the list of sources, not their rows.
    """
    every = Window.partitionBy()
    rising = Window.orderBy("fill", F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    levels = (
        weighed.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("at", F.row_number().over(rising))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("fill"), F.col("level")), F.when(F.col("level") <= F.col("fill"), F.col("at"))).over(every)
    return levels.withColumn("water", level).select("source", "source_size", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """Per source the hash ``upto`` below which rows are taken once more, and whether rows at it are too.

    ``rows``: source, size, hash.  ``budgets``: source, rest.  The boundary row is taken if that
    brings the sum strictly nearer to the rest.
    """
    state = budgets.select("source", "rest", F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        up, shift = HASH_BITS - LEVEL_BITS * (level - 1), HASH_BITS - LEVEL_BITS * level
        s = small(state, n_sources).alias("s")
        inside = rows.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.shiftright("r.hash", up) == F.col("s.prefix")))
        hist = inside.groupBy(F.col("r.source").alias("source"), F.shiftright("r.hash", shift).alias("bucket")).agg(
            F.sum("r.size").alias("held"), F.first("s.rest").alias("rest"), F.first("s.below").alias("below"))
        upto = F.sum("held").over(Window.partitionBy("source").orderBy("bucket"))
        ends = hist.withColumn("upto", F.col("below") + upto).where("upto > rest and upto - held <= rest")
        state = ends.select("source", "rest", (F.col("upto") - F.col("held")).alias("below"), F.col("bucket").alias("prefix"), "held")
    nearer = F.col("below") + F.col("held") - F.col("rest") < F.col("rest") - F.col("below")
    return state.select("source", F.col("prefix").alias("upto"), nearer.alias("also"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, passes (0 to max_repeats), taken.

    Size is the number of words (null text: 0).  ``taken`` is passes times size.  Null sources are
    one source of their own.  Equal ids share a hash and so a fate.  A source without words has
    target 0.  An empty table gives no rows.
    """
    sized = sizes(docs, key, source, text)
    plan = _plan(sized, max_repeats).alias("p")
    joined = sized.alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = joined.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", _passes("d.hash").alias("passes"))
    return rows.withColumn("taken", F.col("passes") * F.col("size"))


def sizes(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """doc_id, source, size, hash of each row, written once: the later steps do not read texts again."""
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return saved(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words.alias("size"), row_hash(F.col(key)).alias("hash")))


def _plan(sized: DataFrame, max_repeats: int) -> DataFrame:
    """One row a source: source_size, target, whole passes and the threshold of the rest; broadcast if there are few."""
    sources = saved(with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats))
    n_sources = sources.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = sources.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    ends = thresholds(sized.select("source", "size", "hash"), budgets, n_sources)
    plan = budgets.alias("b").join(ends.alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")), "left").select("b.*", "e.upto", "e.also")
    return small(plan, n_sources)


def _passes(row: str) -> Column:
    once_more = (F.col(row) < F.col("p.upto")) | ((F.col(row) == F.col("p.upto")) & F.col("p.also"))
    return F.col("p.whole") + F.coalesce(once_more, F.lit(False)).cast("long")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it; texts are filtered where they are, not shuffled."""
    plan = _plan(sizes(docs, key, source, text), max_repeats).alias("p")
    rows = docs.withColumn("__sp_hash", row_hash(F.col(key))).alias("d").join(plan, F.col(f"d.{source}").eqNullSafe(F.col("p.source")))
    return rows.select("d.*", F.explode(F.array_repeat(F.lit(1), _passes("d.__sp_hash").cast("int"))).alias("__sp_pass")).drop("__sp_hash", "__sp_pass")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
z as (select source, sum(size)::bigint as source_size from s group by source),
w as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from z),
f as (select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as fill from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
              / (sum(weight) over (order by fill, source nulls last rows between current row and unbounded following))::double as level,
              row_number() over (order by fill, source nulls last) as pos from f),
t as (select source, source_size, least(cap, (select level from l where level <= fill order by pos limit 1) * weight) as target from l),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
r as (select *, target - whole * source_size as rest from b),
g as (select source, h, sum(size)::bigint as held from s group by source, h),
c as (select *, sum(held) over (partition by source order by h)::bigint as upto from g),
k as (select c.source, c.h, (c.upto <= r.rest or (c.upto - c.held <= r.rest and c.upto - r.rest < r.rest - (c.upto - c.held))) as more
      from c join r on c.source is not distinct from r.source)
select s.doc_id, s.size, r.source_size, r.target, (s.size * (r.whole + k.more::bigint))::bigint as taken
from s join r on s.source is not distinct from r.source join k on s.source is not distinct from k.source and s.h = k.h
"""
