"""Joins that detectors need: theta, containment, overlap, set operations, recurring lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators.routes import overlapping
from .catalog import query, table

#: Words from which on a passage has five whole ones inside, and characters that are the key of a shorter one.
LONG, GRAM = 7, 8

TEMPLATE = r"""'/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '\.html$', ''), '/'), lambda p: p <> ''),
  lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN '{id}' ELSE p END), '/')"""


@query(f"SELECT {TEMPLATE} AS route, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1")
def route_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(text.path_template(F.col("url")).alias("route")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query(r"""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '\.html$', ''), '/'), lambda s: s <> '') AS raw FROM pages),
t AS (SELECT DISTINCT list_transform(raw, lambda s: CASE WHEN page_id % 2 = 0 AND regexp_matches(s, '^[0-9]+$') THEN '{id}' ELSE s END) AS seg FROM p),
c AS (SELECT a.seg AS x, b.seg AS y FROM t a JOIN t b ON len(a.seg) = len(b.seg) AND array_to_string(a.seg, '/') < array_to_string(b.seg, '/'))
SELECT array_to_string(x, '/') AS l, array_to_string(y, '/') AS r FROM c
WHERE len(list_filter(range(1, len(x) + 1), lambda i: x[i] = y[i] OR x[i] = '{id}' OR y[i] = '{id}')) = len(x)
""")
def route_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that some path fits both of."""
    raw = F.filter(F.split(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*(/[^?#]*)", 1), r"\.html$", ""), "/"), lambda s: s != "")
    even = F.col("page_id") % 2 == 0
    t = table(spark, sf_dir, "pages").select(F.transform(raw, lambda s: F.when(even & s.rlike("^[0-9]+$"), F.lit("{id}")).otherwise(s)).alias("parts")).distinct()
    t = t.select(F.size("parts").alias("n"), "parts", F.array_join("parts", "/").alias("template"))
    return overlapping(t, "template", "n", lambda s: s == "{id}").select("l", "r")


@query(r"""
WITH d AS (SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))), ',') AS deps FROM pages)
SELECT sha256(deps) AS deps_hash, count(*) AS n, min(page_id) AS first_page FROM d GROUP BY deps HAVING count(*) >= 2
""")
def repeated_dependency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1))), ",")
    return table(spark, sf_dir, "pages").groupBy(F.sha2(deps, 256).alias("deps_hash")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n >= 2")


@query("""
SELECT o_orderkey, count(*) AS inside, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey
""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    held = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.join(l, held).groupBy("o_orderkey").agg(F.count("*").alias("inside"), F.sum("l_quantity").alias("quantity"))


@query("""
WITH hits AS (SELECT doc_id, item_id, instr(d.text, b.text) AS start, len(b.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '')
SELECT doc_id, item_id, start::BIGINT AS start, (start + n)::BIGINT AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, item_id) = 1 AS first FROM hits
""")
def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages found whole inside documents: an equi-join on a key that any such document holds, then the exact test.

    A passage may begin and end inside a word. One of LONG words or more has five whole words inside; a
    shorter one has its first GRAM characters, or where it is shorter still its first one. Keys are hashes.
    Empty passages are in no document.
    """
    split = lambda t: F.split(t, " ")
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage").where("passage <> ''").withColumn("ws", split(F.col("passage")))
    long, gram = F.size("ws") >= LONG, F.length("passage") >= GRAM
    b = b.withColumn("kind", F.when(long, "words").when(gram, "gram").otherwise("first"))
    b = b.withColumn("key", F.xxhash64("kind", F.when(long, F.array_join(F.slice("ws", 2, 5), " ")).when(gram, F.substring("passage", 1, GRAM)).otherwise(F.substring("passage", 1, 1))))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = lambda kind, parts: F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.lit(kind), p)))
    d = d.withColumn("ws", split(F.col("text")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 4, F.lit(1))), lambda i: F.array_join(F.slice("ws", i, 5), " "))
    keys = [hashed("words", runs)]
    for kind, width in (("gram", GRAM), ("first", 1)):  # texts are cut so only where there are such passages
        if not b.where(F.col("kind") == kind).isEmpty():
            keys.append(hashed(kind, F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{width}}}))"), 1)))
    hits = d.select("doc_id", F.explode(F.concat(*keys)).alias("key")).join(b.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    held = hits.join(d.select("doc_id", "text"), "doc_id").join(b.select("item_id", "passage"), "item_id").where(F.contains("text", F.col("passage")))
    start = F.instr(F.col("text"), F.col("passage")).cast("long")
    placed = held.select("doc_id", "item_id", start.alias("start"), (start + F.length("passage")).alias("stop"))
    return placed.withColumn("first", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "item_id")) == 1)


@query("""
WITH old AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE doc_id % 3 <> 1)
SELECT 'new' AS status, count(*) AS n FROM new WHERE h NOT IN (SELECT h FROM old)
UNION ALL SELECT 'fixed', count(*) FROM old WHERE h NOT IN (SELECT h FROM new)
UNION ALL SELECT 'both', count(*) FROM (SELECT h FROM old INTERSECT SELECT h FROM new)
""")
def set_ops_new_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    seen = d.groupBy("h").agg(F.count_if(F.col("doc_id") % 3 != 0).alias("old"), F.count_if(F.col("doc_id") % 3 != 1).alias("new"))
    counts = seen.agg(F.sum(F.when(F.col("old") == 0, F.col("new")).otherwise(0)).alias("new"), F.sum(F.when(F.col("new") == 0, F.col("old")).otherwise(0)).alias("fixed"), F.count_if((F.col("old") > 0) & (F.col("new") > 0)).alias("both"))
    return counts.unpivot([], ["new", "fixed", "both"], "status", "n")


@query("""
SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN (props->>'$.k')::BIGINT >= 66 THEN 'high' WHEN (props->>'$.k')::BIGINT >= 33 THEN 'medium' ELSE 'low' END AS severity FROM events
""")
def diagnostic_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k >= 66, "high").when(k >= 33, "medium").otherwise("low").alias("severity"))
