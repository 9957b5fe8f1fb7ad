"""Sketches over streams: bins are counted per time window by Spark's own stateful aggregation.

State is a count for each window, key and bin, so it is bounded by bins, and the watermark drops it and late rows. The
output is the long form of tessera.operators.merging; closed windows become sketches in any later batch query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.mapping import bin_index, sign_of
from tessera.operators.merging import gathered


def windowed_bins(stream: DataFrame, time: str, value: Column | str, window: str, lateness: str, keys: list[str] | None = None, slide: str | None = None, accuracy: float = 0.01, rule: str = "ceil") -> DataFrame:
    """start, end, keys, sign, i, c: counts by bin of each window. Works on batch tables too."""
    keys = list(keys or [])
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = stream.select(time, *keys, value.alias("v__")).where("v__ is not null")
    if stream.isStreaming:
        rows = rows.withWatermark(time, lateness)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counts = rows.groupBy(span.alias("w__"), *keys, sign_of(F.col("v__")).alias("sign"), bin_index(F.col("v__"), accuracy, rule).alias("i")).agg(F.count("*").cast("double").alias("c"))
    return counts.select(F.col("w__.start").alias("start"), F.col("w__.end").alias("end"), *keys, "sign", "i", "c")


def sketches(bins: DataFrame, keys: list[str] | None = None, accuracy: float = 0.01, column: str = "sketch") -> DataFrame:
    """The decoded sketch of each window and key, of bins that windowed_bins() gave, over batches as often as they come."""
    keys = ["start", "end", *(keys or [])]
    return gathered(bins.groupBy(*keys, "sign", "i").agg(F.sum("c").alias("c")), keys, accuracy, column)
