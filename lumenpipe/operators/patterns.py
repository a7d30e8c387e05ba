"""Log patterns: messages with their variable parts masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks in order of application.
MASKS = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r'"[^"]*"', "<text>"),
    (r"\b0[xX][0-9a-fA-F]+\b", "<hex>"),
    (r"\b(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}\b", "<hex>"),
    (r"[0-9]+(\.[0-9]+)*", "<num>"),
]


def mask(text: Column) -> Column:
    for pattern, sign in MASKS:
        text = F.regexp_replace(text, pattern, sign)
    return text


def log_patterns(df: DataFrame, column: str = "body", time: str | None = "time_unix_nano") -> DataFrame:
    """(pattern, count, example[, first_seen, last_seen]); the example is the least of the earliest messages."""
    rows = df.withColumn("__pattern", mask(F.col(column)))
    if time:
        example = F.min_by(column, F.struct(time, column)).alias("example")
        extra = [F.min(time).alias("first_seen"), F.max(time).alias("last_seen")]
    else:
        example, extra = F.min(column).alias("example"), []
    return rows.groupBy(F.col("__pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("count"), example, *extra)
