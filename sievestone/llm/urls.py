"""URL filters: a temporal join of captures with dated lists.

A list is a table of dated entries (list, kind, pattern, action, at): an entry adds or removes a host, a
domain with all below it, or a path prefix of a host. Successive entries of one pattern become validity
intervals, from an addition up to the next entry that is not an addition. Every capture is evaluated
against the entries in force when it was fetched: an interval holds from its begin, inclusive, to its
end, exclusive.

A capture asks for a few keys: its host, the domains above it, its host with each prefix of its path. The join is an equi-join on key and month, with the instant compared as a residual, so neither
the number of patterns nor the age of a list widens it. A host that holds a third of all captures is
split by Spark's skew handling, because the list side of a key is small: one interval per pattern, list
and month in the usual case.

Null or unparsable URLs and null fetch times match nothing. Hosts compare in lower case without user,
port or trailing dot. Entries of one pattern at the same instant: the removal wins. Repeated entries
count once. Repeated captures each get their row. An empty list matches nothing; no captures give an
empty result. Columns of the captures are kept; those of the same names as the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read

OPEN_END = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) from dated entries."""
    host = F.lower(F.regexp_extract("pattern", "^([^/]*)", 1))
    prefix = F.concat_ws("/", host, F.array_join(parts(F.regexp_extract("pattern", "^[^/]*(/.*)", 1)), "/"))
    key = F.concat(F.col("kind"), F.lit(":"), F.when(F.col("kind") == "prefix", prefix).otherwise(F.lower("pattern")))
    dated = entries.where(F.col("at").isNotNull() & F.col("pattern").isNotNull()).select("list", key.alias("key"), F.col("at").cast("timestamp").alias("at"), (F.col("action") == "add").alias("adds"))
    dated = dated.groupBy("list", "key", "at").agg(F.min("adds").alias("adds"))
    order = W.partitionBy("list", "key").orderBy("at")
    dated = dated.withColumn("was", F.coalesce(F.lag("adds").over(order), F.lit(False))).where(F.col("adds") != F.col("was"))
    ended = F.coalesce(F.lead("at").over(order), F.lit(OPEN_END).cast("timestamp"))
    return dated.withColumn("valid_to", ended).where("adds").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def keys(url: Column) -> Column:
    """What a capture is looked up by."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    way = parts(path_of(url))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(way)), lambda i: F.concat(F.lit("prefix:"), F.concat_ws("/", host, F.when(i > 0, F.array_join(F.slice(way, 1, F.greatest(i, F.lit(1))), "/")))))
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes))


def as_of(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at", last_month: int | None = None) -> DataFrame:
    """captures with `lists`: the sorted names of the lists that held an entry for them when they were fetched.

    Only lists' rows are repeated, once per month of validity up to the last month that a capture has.
    """
    known = [c for c in captures.columns if c != "lists"]
    rows = captures.select(*[F.col(f"`{c}`") for c in known]).withColumn("__row", F.monotonically_increasing_id())
    asked = rows.where(F.col(time_col).isNotNull()).select(F.col(time_col).cast("timestamp").alias("__at"), F.struct(*[F.col(f"`{c}`") for c in [*known, "__row"]]).alias("__all"), F.explode(keys(F.col(url_col))).alias("key"))
    if last_month is None:
        last_month = captures.select(F.max(month(F.col(time_col).cast("timestamp")))).first()[0] or 0
    valid = intervals(entries).withColumn("month", F.explode(F.when(month(F.col("valid_from")) <= last_month, F.sequence(month(F.col("valid_from")), F.least(month(F.col("valid_to")), F.lit(last_month))))))
    held = asked.withColumn("month", month(F.col("__at"))).join(valid, ["key", "month"]).where((F.col("__at") >= F.col("valid_from")) & (F.col("__at") < F.col("valid_to")))
    found = held.select(F.col("__all.__row").alias("__row"), "list").groupBy("__row").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    none = F.array().cast("array<string>")
    return rows.join(found, "__row", "left").withColumn("lists", F.coalesce("lists", none)).drop("__row")


# The lists that op7 applies: hosts, domains and path prefixes with the days they were added and removed.
ENTRIES = [
    ("spam", "domain", "spam-farm.example.org", "add", "2024-01-10"),
    ("spam", "domain", "spam-farm.example.org", "remove", "2024-03-01"),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-05-20"),
    ("pills", "domain", "cheap-pills.example.com", "add", "2023-11-01"),
    ("pills", "domain", "cheap-pills.example.com", "remove", "2024-08-15"),
    ("registry", "domain", "example.net", "add", "2024-02-01"),
    ("registry", "domain", "example.net", "remove", "2024-02-15"),
    ("registry", "domain", "example.net", "add", "2024-09-01"),
    ("registry", "domain", "example.net", "remove", "2024-10-01"),
    ("hosts", "host", "m.therou.example.com", "add", "2024-04-01"),
    ("hosts", "host", "blog.ththan.example.net", "add", "2024-06-15"),
    ("hosts", "host", "blog.ththan.example.net", "remove", "2024-06-16"),
    ("hosts", "host", "ththre.example.com", "remove", "2024-01-01"),
    ("paths", "prefix", "www.ththen.example.com/en", "add", "2024-03-15"),
    ("paths", "prefix", "ththed.example.org/de", "add", "2024-01-01"),
    ("paths", "prefix", "ththed.example.org/de", "remove", "2024-12-01"),
]


def fetched_at(page_id: Column) -> Column:
    """Pages carry no fetch time: the captures are laid over the hours of 2024 by their ids."""
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(page_id * 7919, F.lit(8784)) * 3600)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = read(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_at", fetched_at(F.col("page_id")))
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, at string")
    found = as_of(captures, entries, last_month=2024 * 12 + 12)
    return found.select("page_id", "url", host_of(F.col("url")).alias("host"), F.unix_timestamp("fetched_at").alias("fetched"), F.array_join("lists", ",").alias("lists"), (F.size("lists") > 0).alias("blocked"))


_ROWS = ",\n    ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in ENTRIES)
OP7_SQL = rf"""
WITH entries(list, kind, pattern, action, day) AS (VALUES
    {_ROWS}
), dated AS (
  SELECT list, kind, pattern, day, bool_and(action = 'add') AS adds FROM entries GROUP BY ALL
), last_entry AS (
  SELECT p.page_id, p.url, d.list, d.kind, d.pattern, arg_max(d.adds, d.day) AS held
  FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
               to_timestamp(1704067200 + (page_id * 7919) % 8784 * 3600) AT TIME ZONE 'UTC' AS fetched FROM pages) p
  JOIN dated d ON d.day <= p.fetched AND CASE d.kind
    WHEN 'host' THEN p.host = d.pattern
    WHEN 'domain' THEN p.host = d.pattern OR ends_with(p.host, '.' || d.pattern)
    ELSE starts_with(p.host || p.path || '/', d.pattern || '/') END
  GROUP BY ALL
), held AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM last_entry WHERE held GROUP BY page_id
)
SELECT p.page_id, p.url, nullif(regexp_replace(lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host,
       (1704067200 + (p.page_id * 7919) % 8784 * 3600)::BIGINT AS fetched,
       coalesce(h.lists, '') AS lists, h.lists IS NOT NULL AS blocked
FROM pages p LEFT JOIN held h USING (page_id)
"""
