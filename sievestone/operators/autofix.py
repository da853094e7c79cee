"""Safe edits to sources: all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conflicts(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that overlap the one before them, reach beyond their file's bytes, or name no file."""
    order = W.partitionBy("path").orderBy("start", "stop", "replacement")
    checked = edits.withColumn("before", F.lag("stop").over(order)).join(files.select("path", F.octet_length("source").alias("size")), "path", "left")
    return checked.where("before > start OR stop > size OR start > stop OR start < 0 OR size IS NULL").drop("before", "size")


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, source) after the edits (path, start, stop, replacement; byte offsets) of each file, from the end to the start.

    Any conflict stops the whole run before anything is returned.
    """
    bad = conflicts(files, edits).limit(5).collect()
    if bad:
        raise ValueError(f"edits conflict: {[tuple(b) for b in bad]}")
    per_file = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "replacement")), asc=False).alias("edits"))

    def step(source, e):
        return F.concat(F.substr(source, F.lit(1), e["start"]), F.encode(e["replacement"], "utf-8"), F.substr(source, e["stop"] + 1, F.octet_length(source)))

    return files.join(per_file, "path").select("path", F.decode(F.aggregate("edits", F.encode("source", "utf-8"), step), "utf-8").alias("source"))
