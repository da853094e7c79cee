"""Beyond batch: exact duplicates over a stream of files, within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised


def first_seen(stream: DataFrame, *, text_col: str = "text", time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows whose normalised content was not seen within the delay; state is dropped behind the watermark."""
    hashed = stream.withColumn("content_hash", F.sha2(normalised(F.col(text_col)), 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])
