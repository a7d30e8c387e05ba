"""Mixing sources to target weights along a time-varying curriculum.

Source s has the weight w_s(t) = share_s * (1 + slope_s * (2t - 1)) at training time t in [0, 1]. The weights
sum to one at any time and integrate to the target shares, so after time t source s must have given
T * share_s * (t + slope_s * (t^2 - t)) tokens. A document whose tokens begin at c in its source's stream
takes the time at which that demand reaches c; the mix is the documents in order of time. T is the largest
total at which no source has to be repeated more often than it may.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import BLANKS, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest slope of a source's weight: at 0.5 it moves from half to one and a half of its share.
STEEPNESS = 0.5
#: Blocks of a source's stream for the two-level running sums.
BLOCKS = 4096
#: Listed sources up to which their plan is broadcast (about 100 bytes each).
SMALL_LIST = 10_000


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    import base64

    import tiktoken

    # fixed value: the tokenizer's published pattern
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(documents: DataFrame, path: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns and ``n_tokens``, the length of the text in tokens of the public tokenizer; null texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"]
            )

    source = documents.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(count, f"{fields}, n_tokens bigint")


def source_name(col: str | Column) -> Column:
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def plan(sized: DataFrame, targets: DataFrame, steepness: float = STEEPNESS) -> DataFrame:
    """One row per listed source: tokens there, share to reach, slope, demand in tokens and passes needed.

    Sources without tokens or with a share, repeats or size that is null or not positive give nothing; the
    shares of the others are scaled to one. Sources that may be repeated more (small, curated ones) rise
    over training, the others fall.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    wanted = targets.groupBy(source_name("source").alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    rows = wanted.join(have, "source", "left")
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    every = Window.partitionBy()
    share = F.when(F.col("usable"), F.col("target_share"))
    rows = rows.withColumn("share", share / F.sum(share).over(every))
    rows = rows.withColumn("total", F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).over(every))
    lean = F.col("max_repeats") - F.sum(F.col("share") * F.col("max_repeats")).over(every)
    rows = rows.withColumn("lean", F.when(F.col("usable"), lean))
    most = F.max(F.abs("lean")).over(every)
    rows = rows.withColumn("slope", F.when(most > 0, F.col("lean") / most * steepness).otherwise(F.when(F.col("usable"), 0.0)))
    rows = rows.withColumn("demand", F.col("share") * F.col("total"))
    passes = F.least(F.col("max_repeats").cast("bigint"), F.ceil(F.col("demand") / F.col("tokens") - 1e-9))
    return rows.withColumn("passes", F.when(F.col("usable"), passes)).drop("lean", "usable")


def _streams(sized: DataFrame) -> DataFrame:
    """Start of every document in its source's stream (a fixed pseudo-random order), by two-level running sums."""
    key = F.xxhash64("doc_id")
    rows = sized.withColumn("key", key).withColumn("block", F.pmod(F.shiftright("key", 32), F.lit(BLOCKS)))
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "block", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(base, ["source", "block"]).withColumn("start", F.col("base") + F.col("inside"))


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, sized: DataFrame | None = None) -> DataFrame:
    """The mix in training order: (position, doc_id, source, pass, n_tokens); position is the time in [0, 1).

    Documents of sources that are not listed, and documents without tokens, give nothing. A document is taken
    at most ``max_repeats`` times; the last one of a source may exceed its demand by a part of its length.
    """
    if sized is None:
        sized = sized_documents(documents, path)
    per_source = plan(sized, targets).where("passes > 0").select("source", "tokens", "demand", "slope", "passes")
    per_source = materialize(per_source)
    if per_source.count() <= SMALL_LIST:  # sources are listed by hand; a longer list is left to the planner
        per_source = F.broadcast(per_source)
    docs = _streams(sized.where("n_tokens > 0")).join(per_source, "source")
    runs = docs.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
    c = (F.col("start") + F.col("pass") * F.col("tokens")) / F.col("demand")
    runs = runs.withColumn("c", c).where("c < 1")
    # slope*t^2 + (1 - slope)*t = c, in the form that also holds for slope 0
    s = F.col("slope")
    position = 2 * F.col("c") / ((1 - s) + F.sqrt((1 - s) * (1 - s) + 4 * s * F.col("c")))
    return runs.select(position.alias("position"), "doc_id", "source", "pass", "n_tokens").orderBy(
        "position", "source", "doc_id", "pass"
    )


def sized_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) with the source's plain name, written once."""
    counted = with_token_counts(documents, path)
    return materialize(counted.withColumn("source", source_name("source")))


def shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per listed source: target share, share reached, tokens taken and times that the source was gone through."""
    sized = sized_documents(documents, path)
    taken = mix(documents, targets, path, sized).groupBy("source").agg(
        F.sum("n_tokens").alias("taken_tokens"), F.count(F.lit(1)).alias("taken_documents"),
        (F.max("pass") + 1).alias("passes_used"),
    )
    every = Window.partitionBy()
    rows = plan(sized, targets).join(taken, "source", "left").fillna(0, ["taken_tokens", "taken_documents", "passes_used", "tokens"])
    return rows.select(
        "source", "target_share", "max_repeats", F.col("tokens").alias("source_tokens"), "taken_tokens",
        "taken_documents", "passes_used",
        (F.col("taken_tokens") / F.sum("taken_tokens").over(every)).alias("actual_share"),
    )
