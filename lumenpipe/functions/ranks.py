"""Values at exact ranks per group, by cumulative counts, and the index rules that ask for them.

Equal values are folded first. A group with few distinct values is cumulated in one window partition. A
group with many is cumulated over value buckets, and then only inside the buckets that hold a wanted
rank, so that no task sees more than a bucket's values, however large the group is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import int_div

#: Distinct values up to which one window partition takes a whole group.
WIDE = 1 << 16
#: Bits of the values of a bucket (whole numbers), and buckets per octave as a power of two (others).
BUCKET_BITS, OCTAVE_BITS = 20, 12

Rule = Callable[[Column], Column]


def rollup_index(n: Column, p: int) -> Column:
    """Zero-based (n - 1) * p / 100, cut off."""
    return int_div((n - 1) * p, F.lit(100))


def health_index(n: Column, p: float) -> Column:
    """Zero-based p / 100 * (n - 1), rounded half up."""
    return F.floor((n - 1) * (p / 100.0) + 0.5).cast("bigint")


def exemplar_index(n: Column) -> Column:
    """Zero-based n * 9 / 10, cut off, never past the end."""
    return F.least(int_div(n * 9, F.lit(10)), n - 1)


def median_index(n: Column) -> Column:
    """Zero-based index of the lower median."""
    return int_div(n + 1, F.lit(2)) - 1


def _bucket(value: Column, kind: T.DataType) -> Column:
    """Order-preserving buckets."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.shiftright(value.cast("bigint"), BUCKET_BITS)
    x = value.cast("double")
    size = F.least(F.abs(x), F.lit(1.7e308))
    return (F.signum(x) * (F.floor(F.log2(size + 1.0) * float(1 << OCTAVE_BITS)) + 1)).cast("bigint")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped. Without keys all rows meet (one on the right)."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True) if extra is None else extra
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def values_at_ranks(counts: DataFrame, keys: list[str], value: str, count: str, picks: dict[str, Rule]) -> DataFrame:
    """One row per group: for each pick the value at the zero-based index that its rule gives for the group's total.

    ``counts`` has a row per (keys, value), values not null, with its count. Groups are those with a
    positive total; keys may be null.
    """
    kind = counts.schema[value].dataType
    rows = counts.where(F.col(count) > 0).select(*keys, F.col(value).alias("__v"), F.col(count).alias("__c"))
    anchor = [] if keys else [F.lit(0).alias("__all")]
    keys_ = keys or ["__all"]
    rows = rows.select("*", *anchor)
    size = rows.groupBy(*keys_).agg(F.sum("__c").alias("__n"), (F.count(F.lit(1)) > WIDE).alias("__wide"))
    rows = joined(rows, size, keys_)

    def pick(df: DataFrame, part: list[str], base: Column, names: list[str]) -> list[Column]:
        upto = Window.partitionBy(*part).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("__upto", base + F.sum("__c").over(upto))
        found = [picks[n](F.col("__n")) for n in names]
        at = [
            F.max(F.when((i < F.col("__upto")) & (i >= F.col("__upto") - F.col("__c")), F.col("__v"))).alias(n)
            for i, n in zip(found, names)
        ]
        return df.groupBy(*keys_).agg(*at)

    names = list(picks)
    narrow = pick(rows.where(~F.col("__wide")), keys_, F.lit(0), names)
    wide = rows.where("__wide").withColumn("__b", _bucket(F.col("__v"), kind))
    sums = wide.groupBy(*keys_, "__b").agg(F.sum("__c").alias("__bc"), F.first("__n").alias("__n"))
    upto = Window.partitionBy(*keys_).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__to", F.sum("__bc").over(upto))
    hit = F.lit(False)
    for rule in picks.values():
        i = rule(F.col("__n"))
        hit = hit | ((i < F.col("__to")) & (i >= F.col("__to") - F.col("__bc")))
    goal = sums.where(hit).select(*keys_, F.col("__b").alias("__goal"), (F.col("__to") - F.col("__bc")).alias("__base"))
    inside = joined(wide, goal, keys_, "inner", F.col("__b") == F.col("__goal"))
    deep = pick(inside, [*keys_, "__b"], F.col("__base"), names)
    return narrow.unionByName(deep).drop("__all")


def ranked_values(df: DataFrame, keys: list[str], value: str, picks: dict[str, Rule]) -> DataFrame:
    """``values_at_ranks`` of raw rows. Null values have no rank; groups without values have no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__count"))
    return values_at_ranks(counts, keys, value, "__count", picks)
