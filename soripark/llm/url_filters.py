"""URL filters: a temporal join of captures with dated list entries.

Entries of one key, in time order, become validity intervals that do not overlap.
A capture has a few keys: its host and parent domains, each also with the first
path segment.  The as-of join is an equality join on the key with the capture's
time inside the interval, so each key of a capture meets one interval at most; the
longest active key decides.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soripark.llm.common import BROADCAST_ROWS, saved, small, table

#: Where intervals are too many to broadcast: captures of a key from which it is dealt out, to so many parts; most such keys that are broadcast.
HOT_CAPTURES = 1_000_000
HOT_PARTS = 64
BROADCAST_HOT = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null for a null url, empty for an odd one."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def keys_of(url: Column) -> Column:
    """The host, its parent domains of two labels or more, and each with the first path segment."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segment = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]+)", 1)
    with_path = F.when(segment != "", F.transform(hosts, lambda h: F.concat(h, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(hosts, with_path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """key, verdict, since, until (null: still) from entries (key, verdict, at): each holds until the key's next one.

    ``verdict`` is block, allow or remove; removals only end what was before.  Of entries of one key
    and time the alphabetically last verdict holds.  Null keys or times are no entries.
    """
    rows = entries.where("key is not null and at is not null").groupBy("key", "at").agg(F.max("verdict").alias("verdict"))
    until = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    return rows.select("key", "verdict", F.col("at").alias("since"), until.alias("until")).where("verdict <> 'remove'")


def _in_parts(asked: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part: captures of a key with more than ``HOT_CAPTURES`` are dealt out to ``HOT_PARTS`` parts, and its intervals stand in each."""
    hot = saved(asked.join(active.select("key").distinct(), "key", "left_semi").groupBy("key").count().where(F.col("count") > HOT_CAPTURES).select("key", F.lit(True).alias("hot")))
    hot = small(hot, hot.count(), BROADCAST_HOT)
    dealt = F.pmod(F.xxhash64("__sp_url", "__sp_at"), F.lit(HOT_PARTS)).cast("int")
    asked = asked.join(hot, "key", "left").withColumn("part", F.when(F.col("hot"), dealt).otherwise(0)).drop("hot")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return asked, active.join(hot, "key", "left").withColumn("part", F.explode(parts)).drop("hot")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``verdict`` (block, allow or none), ``list_key`` and ``since`` of the deciding entry.

    The longest key active at the capture's time decides.  Null or odd urls and null times: none.
    Every row of ``captures`` stays; equal (url, time) pairs are judged once.
    """
    active = saved(intervals(entries))
    n = active.count()
    different = captures.select(F.col(url).alias("__sp_url"), F.col(at).alias("__sp_at")).where("__sp_url is not null and __sp_at is not null").distinct()
    asked = different.select("*", F.explode(keys_of(F.col("__sp_url"))).alias("key"))
    if n > BROADCAST_ROWS:
        asked, active = _in_parts(asked, active)
    else:
        asked, active = asked.withColumn("part", F.lit(0)), F.broadcast(active.withColumn("part", F.lit(0)))
    inside = (F.col("a.key") == F.col("i.key")) & (F.col("a.part") == F.col("i.part")) & (F.col("a.__sp_at") >= F.col("i.since")) & (F.col("i.until").isNull() | (F.col("a.__sp_at") < F.col("i.until")))
    hits = asked.alias("a").join(active.alias("i"), inside)
    best = F.max(F.struct(F.length("i.key").alias("n"), F.col("i.key").alias("list_key"), F.col("i.verdict").alias("verdict"), F.col("i.since").alias("since")))
    judged = hits.groupBy("__sp_url", "__sp_at").agg(best.alias("__sp_best"))
    rows = captures.withColumns({"__sp_url": F.col(url), "__sp_at": F.col(at)}).join(judged, ["__sp_url", "__sp_at"], "left")
    return rows.withColumns({"verdict": F.coalesce("__sp_best.verdict", F.lit("none")), "list_key": F.col("__sp_best.list_key"), "since": F.col("__sp_best.since")}).drop("__sp_url", "__sp_at", "__sp_best")


def _number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day of 2024 from their id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int")).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list from the pages' own hosts: a third blocked for 100 days, their domains' www. hosts allowed, example.org blocked late."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key <> ''").distinct().withColumn("n", _number(F.col("key")))
    blocked = hosts.where("n % 3 = 0")
    rows = blocked.select("key", F.lit("block").alias("verdict"), day(F.col("n") % 200).alias("at"))
    rows = rows.unionByName(blocked.select("key", F.lit("remove").alias("verdict"), day(F.col("n") % 200 + 100).alias("at")))
    rows = rows.unionByName(hosts.where("n % 3 = 1").select(F.concat("key", F.lit("/en")).alias("key"), F.lit("allow").alias("verdict"), day(F.col("n") % 50).alias("at")))
    domains = hosts.select(F.substring_index("key", ".", -2).alias("key")).distinct()
    return rows.unionByName(domains.where("key = 'example.org'").select("key", F.lit("block").alias("verdict"), day(F.lit(180)).alias("at")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(captures_of(pages), entries_of(pages))


OP7_SQL = r"""
with p as (select page_id, url, date '2024-01-01' + ((page_id * 7919) % 365)::int as fetched_at, rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') as host,
             regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) as seg from pages),
h as (select distinct host, ('0x' || substr(md5(host), 1, 6))::bigint as n from p where host <> ''),
e as (select host as key, 'block' as verdict, date '2024-01-01' + (n % 200)::int as at_ from h where n % 3 = 0
  union all select host, 'remove', date '2024-01-01' + (n % 200 + 100)::int from h where n % 3 = 0
  union all select host || '/en', 'allow', date '2024-01-01' + (n % 50)::int from h where n % 3 = 1
  union all select distinct 'example.org', 'block', date '2024-01-01' + 180 from h where array_to_string(string_split(host, '.')[-2:], '.') = 'example.org'),
g as (select key, at_, max(verdict) as verdict from e group by 1, 2),
i as (select * from (select key, verdict, at_ as since, lead(at_) over (partition by key order by at_) as until from g) where verdict <> 'remove'),
s as (select page_id, url, fetched_at, seg, string_split(host, '.') as l from p where host <> ''),
x as (select page_id, url, fetched_at, seg, array_to_string(l[j:], '.') as k from (select *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as j from s)),
k as (select page_id, fetched_at, k as key from x union select page_id, fetched_at, k || seg from x where seg <> ''),
m as (select page_id, i.*, row_number() over (partition by page_id order by length(i.key) desc, i.key desc) as r from k join i on k.key = i.key and fetched_at >= since and (until is null or fetched_at < until))
select p.page_id, p.url, p.fetched_at, coalesce(m.verdict, 'none') as verdict, m.key as list_key, m.since from p left join m on p.page_id = m.page_id and m.r = 1
"""
