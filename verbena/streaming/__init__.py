"""Verbs on streams.

Verbs that neither order rows nor look at whole groups (select, rename, mutate without aggregates, filter, joins with a static table)
build the same plan on a streaming DataFrame; grouped counts and summaries run as stateful aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, width: str, late: str, *keys: str, **aggregates: F.Column) -> DataFrame:
    """Aggregates by tumbling window and keys, with a watermark for late rows; batch frames give the same rows."""
    kind = df.schema[time].dataType
    df = df.withColumn(time, F.col(time).cast("timestamp"))  # watermarks take no other type
    w = F.window(time, width)
    got = df.withWatermark(time, late).groupBy(w, *keys).agg(*(a.alias(k) for k, a in aggregates.items()))
    return got.select(F.col("window.start").cast(kind).alias("window_start"), *keys, *aggregates)
