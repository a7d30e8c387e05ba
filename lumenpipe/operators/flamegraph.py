"""Flamegraphs: values of call stacks summed over every prefix of the path from the root to the leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flamegraph(samples: DataFrame, stacks: DataFrame, retention_after: int | None = None) -> DataFrame:
    """Nodes (path, frame_id, depth, parent_path, total_value, self_value).

    A stack's frames are listed from the leaf (position 0) up. Samples are summed per stack before
    they meet the frames. With ``retention_after`` samples before that time are left out; nodes whose
    total is not positive disappear. Samples without a known stack wait (give nothing).
    """
    if retention_after is not None:
        samples = samples.where(F.col("time_unix_nano") >= retention_after)
    per_stack = samples.groupBy("stack_id").agg(F.sum("value").alias("value"))
    frames = stacks.distinct().groupBy("stack_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "frame_id")), asc=False), lambda x: x["frame_id"]).alias("f")
    )
    rows = per_stack.join(frames, "stack_id")
    nodes = rows.select("value", F.size("f").alias("n"), "f", F.posexplode("f").alias("i", "frame_id"))
    path = F.array_join(F.transform(F.slice("f", F.lit(1), F.col("i") + 1), lambda x: x.cast("string")), "/")
    nodes = nodes.select(
        path.alias("path"), "frame_id", F.col("i").alias("depth"),
        F.when(F.col("i") > 0, F.array_join(F.transform(F.slice("f", F.lit(1), F.greatest("i", F.lit(1))), lambda x: x.cast("string")), "/")).alias("parent_path"),
        "value", F.when(F.col("i") == F.col("n") - 1, F.col("value")).otherwise(0).alias("own"),
    )
    out = nodes.groupBy("path", "frame_id", "depth", "parent_path").agg(
        F.sum("value").alias("total_value"), F.sum("own").alias("self_value")
    )
    return out.where("total_value > 0")


def node_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changes between two flamegraphs: (op, path, frame_id, depth, parent_path, total_value, self_value).

    ``op`` is created, updated or removed; removed nodes have their last values. Nodes that stay as they are are not there.
    """
    old = before.select(F.col("path").alias("__path"), F.struct("frame_id", "depth", "parent_path", "total_value", "self_value").alias("__old"))
    new = after.select("path", F.struct("frame_id", "depth", "parent_path", "total_value", "self_value").alias("new"))
    both = new.join(old, F.col("path") == F.col("__path"), "full_outer")
    op = F.when(F.col("__path").isNull(), "created").when(F.col("path").isNull(), "removed").when(~F.col("new").eqNullSafe(F.col("__old")), "updated")
    changed = both.select(op.alias("op"), F.coalesce("path", "__path").alias("path"), F.coalesce("new", "__old").alias("node")).where("op IS NOT NULL")
    return changed.select("op", "path", "node.*")


def icicle(nodes: DataFrame) -> DataFrame:
    """Share of the overall root total per node, siblings in order of value."""
    from pyspark.sql import Window

    root = nodes.where("depth = 0").agg(F.sum("total_value").alias("all_total"))
    siblings = Window.partitionBy("parent_path").orderBy(F.desc("total_value"), "path")
    ranked = nodes.withColumn("rank", F.row_number().over(siblings)).join(F.broadcast(root))  # one row
    return ranked.withColumn("share", F.col("total_value") / F.coalesce(F.nullif("all_total", F.lit(0)), F.lit(1))).drop("all_total")
