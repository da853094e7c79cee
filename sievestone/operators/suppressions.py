"""Suppression directives in comments, as line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines

DIRECTIVE = r"^\s*(?://|#)\s*sievestone-ignore-(next-line|start|end)\s+([A-Za-z0-9_.\-]+)\s*(?:--\s*(.*))?$"


def directives(files: DataFrame) -> DataFrame:
    """(path, rule, kind, from_line, to_line, reason, nth) from (path, source).

    An end closes the latest open start of its rule, as brackets do: the start of the same depth. A
    start that nothing closes runs to the end of the file.
    """
    rows = files.where("source IS NOT NULL").select("path", F.size(lines(F.col("source"))).alias("last"), F.posexplode(lines(F.col("source"))).alias("at", "text"))
    part = lambda k: F.regexp_extract("text", DIRECTIVE, k)
    found = rows.where(F.col("text").rlike(DIRECTIVE)).select("path", "last", (F.col("at") + 1).alias("line"), part(1).alias("kind"), part(2).alias("rule"), F.nullif(part(3), F.lit("")).alias("reason"))
    single = found.where("kind = 'next-line'").select("path", "rule", F.lit("next-line").alias("kind"), (F.col("line") + 1).alias("from_line"), (F.col("line") + 1).alias("to_line"), "reason")
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    so_far = W.partitionBy("path", "rule").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    depth = F.sum(step).over(so_far) + F.when(F.col("kind") == "end", 1).otherwise(0)
    marks = found.where("kind <> 'next-line'").withColumn("depth", depth)
    after = W.partitionBy("path", "rule", "depth").orderBy("line")
    closed = marks.withColumn("closes", F.lead("line").over(after)).withColumn("closer", F.lead("kind").over(after)).where("kind = 'start'")
    blocks = closed.select("path", "rule", F.lit("block").alias("kind"), (F.col("line") + 1).alias("from_line"), F.when(F.col("closer") == "end", F.col("closes") - 1).otherwise(F.col("last")).alias("to_line"), "reason")
    return single.unionByName(blocks).withColumn("nth", F.row_number().over(W.partitionBy("path").orderBy("from_line", "rule")))
