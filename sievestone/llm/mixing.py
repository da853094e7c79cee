"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue whose documents stand in a pseudo-random but fixed order. A document's virtual
finish time is the running total of its source's words, its own included, over the source's target; a
second pass through the queue continues where the first ended. All queues are served in the order of
finish times and the service stops when the budget is spent. Since the targets add up to the budget,
that is virtual time 1: a document that straddles it is taken only as far as its source's target goes.

Running totals never gather a source in one task. The order inside a source is the md5 of the id (of the
text, where there is no id), so its leading hex digits cut any source, however large, into even buckets;
bucket totals give each bucket its offset, and windows run inside buckets. The service order is cut by
finish time in the same way, which is even because shuffled documents spread evenly over virtual time;
what the mix leaves out has no place in it and is dealt out by hash.

Null text has size 0. Null sources form one source, which stands last. Rows that repeat a document
count one by one and are served one after another; equal rows are interchangeable. An empty table gives
an empty result, and if no document has words every target is 0. Columns beside id, text and source are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, n_words, read

HEX_DIGITS = 8


def targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """One row per source: its size and its target, weights being dealt by code point and repeated.

    Sharing anew what capped sources leave, until no target is above its cap, ends at the water level
    min(cap, level * weight): sources fill in the order of cap / weight.
    """
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    dealt = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", dealt.cast("double"))
    cap = (F.col("source_size") * repeats).cast("double")
    own = own.withColumn("cap", cap).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = every.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = every.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    own = own.withColumn("left", left).withColumn("open_weight", F.sum("weight").over(rest))
    own = own.withColumn("filled", F.col("fills_at") * F.col("open_weight") <= F.col("left"))
    # The level is that of the first source which its cap does not stop.
    level = F.min(F.when(~F.col("filled"), F.struct("fills_at", F.col("source").isNull().alias("last"), "source", "left", "open_weight"))).over(every)
    own = own.withColumn("level", level).withColumn("budget", F.lit(min(share, float(repeats))) * F.sum("source_size").over(every))
    share_of = F.col("level.left") * F.col("weight") / F.col("level.open_weight")
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), share_of))
    return own.select("source", "source_size", "budget", target.alias("target"))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of an md5 in hex; buckets follow the order of the digests."""
    return F.floor(F.conv(F.substring(key, 1, HEX_DIGITS), 16, 10).cast("long") * buckets / (1 << (4 * HEX_DIGITS))).cast("int")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: str = "mix", rows_per_bucket: int = 1024, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and served_at (words the mix serves before it) per row of docs.

    carry: more columns of docs to return.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), *[F.col(c) for c in carry]))
    buckets = max(1, min(1 << 20, sizes.count() // rows_per_bucket))
    sizes = sizes.withColumn("bucket", bucket_of(F.col("key"), buckets))

    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    per_source = targets(per_bucket.withColumnRenamed("words", "size"), weights, share, repeats)
    offsets = per_bucket.withColumn("before", before).alias("o").join(per_source.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.bucket", "o.before", "t.source_size", "t.target", "t.budget")

    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carry)
    queue = sizes.withColumn("nth", F.row_number().over(inside)).withColumn("words", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    same = F.col("q.source").eqNullSafe(F.col("o.source")) & (F.col("q.bucket") == F.col("o.bucket"))
    queue = queue.alias("q").join(offsets.alias("o"), same).select("q.doc_id", "q.source", "q.size", "q.key", "q.bucket", "q.nth", *[f"q.{c}" for c in carry], "o.source_size", "o.target", "o.budget", (F.col("o.before") + F.col("q.words")).alias("end"))

    passes = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass")
    served = queue.select("*", passes).withColumn("finish", F.col("pass") * F.col("source_size") + F.col("end"))
    room = F.greatest(F.lit(0.0), F.col("target") - (F.col("finish") - F.col("size")))
    served = served.withColumn("part", F.floor(F.least(F.col("size").cast("double"), room)).cast("long")).where((F.col("pass") == 0) | (F.col("part") > 0))
    time = F.when(F.col("target") > 0, F.col("finish") / F.col("target")).otherwise(F.lit(2.0))
    idle = -1 - F.pmod(F.xxhash64("key", "nth"), F.lit(buckets))  # before all others, without words
    served = served.withColumn("time", time).withColumn("slice", F.when(F.col("part") > 0, F.floor(F.least(F.col("time"), F.lit(1.0)) * buckets)).otherwise(idle).cast("int"))

    per_slice = served.groupBy("slice").agg(F.sum("part").alias("words"))
    begins = F.sum("words").over(W.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    starts = per_slice.select("slice", begins.alias("begins"))
    line = W.partitionBy("slice").orderBy("time", "key", "doc_id", "pass", "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    served = served.withColumn("ahead", F.sum("part").over(line) - F.col("part")).join(starts, "slice")
    served = served.withColumn("at", F.col("begins") + F.col("ahead"))
    served = served.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("part"), F.floor(F.col("budget") - F.col("at")).cast("long"))))

    rows = served.groupBy("source", "bucket", "nth", "key", "doc_id", "size", "source_size", "target", *carry)
    return rows.agg(F.sum("part").alias("taken"), F.min(F.when(F.col("part") > 0, F.col("at"))).alias("served_at")).select("doc_id", "source", "size", "source_size", "target", "taken", "served_at", *carry)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken.

    The one document of each source that straddles the end is cut after its last word that is taken, at
    a word's end and with its own white space. Each row is taken for itself, whether or not it has an id
    or repeats one: takes come back by two hashes of all columns, and rows equal in all of them are one
    text with as many takes. chars_col, if given, is set to the length of the text that is returned.
    """
    own = [F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns]).alias(f"__h{salt}") for salt in (1, 2)]
    keyed = docs.select("*", *own)
    taken = mix(keyed, id_col=id_col, text_col=text_col, source_col=source_col, carry=("__h1", "__h2"), **options).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    # A text is taken whole, twice or in part, so it has few different takes however often it is repeated.
    taken = taken.groupBy("__h1", "__h2", whole.alias("__whole"), rest.alias("__rest")).agg(F.count("*").cast("int").alias("__times"))
    texts = keyed.groupBy("__h1", "__h2").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__doc"))
    rows = texts.join(taken, ["__h1", "__h2"]).select("__doc.*", "__rest", "__whole", "__times")
    part = F.when(F.col("__rest") > 0, F.array_repeat(F.lit(True), F.col("__times"))).otherwise(F.array().cast("array<boolean>"))
    rows = rows.withColumn("__cut", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("__whole") * F.col("__times")), part)))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"(?:{SPACE})?{WORD}"), 0), 1, F.greatest(F.col("__rest"), F.lit(1))), "")
    rows = rows.withColumn(text_col, F.when(F.col("__cut"), head).otherwise(F.col(text_col)))
    if chars_col:
        rows = rows.withColumn(chars_col, F.when(F.col("__cut"), F.length(text_col).cast("long")).otherwise(F.col(chars_col)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key
  FROM documents
), own AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), dealt AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight,
         (source_size * 2)::DOUBLE AS cap
  FROM own
), filling AS (
  SELECT *, cap / weight AS fills_at,
         1.5::DOUBLE * sum(source_size) OVER ()
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM dealt
), level AS (
  SELECT rest AS level_rest, open_weight AS level_weight FROM filling
  WHERE NOT fills_at * open_weight <= rest ORDER BY fills_at, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, budget, weight,
         CASE WHEN level_rest IS NULL THEN cap ELSE least(cap, level_rest * weight / level_weight) END AS target
  FROM filling LEFT JOIN level ON true
), queue AS (
  SELECT s.doc_id, s.source, s.size, s.key, t.source_size, t.target, t.budget,
         row_number() OVER (PARTITION BY s.source ORDER BY key, doc_id, size) AS nth,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS done
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), served AS (
  SELECT *, pass * source_size + done AS finish,
         floor(least(size::DOUBLE, greatest(0, target - (pass * source_size + done - size))))::BIGINT AS part,
         CASE WHEN target > 0 THEN (pass * source_size + done) / target ELSE 2 END AS time
  FROM queue CROSS JOIN (VALUES (0), (1)) p(pass)
), placed AS (
  SELECT *, sum(part) OVER (ORDER BY time, key, doc_id, pass, nth ROWS UNBOUNDED PRECEDING) - part AS place FROM served
)
SELECT doc_id, size, source_size, target,
       sum(greatest(0, least(part, floor(budget - place))))::BIGINT AS taken
FROM placed GROUP BY source, nth, key, doc_id, size, source_size, target
"""
