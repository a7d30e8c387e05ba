"""Helpers shared by the data-processing operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NS = 1_000_000_000
BLANKS = " \t\r\n\f\u000b "

_local_dirs: dict[str, str] = {}
_scope: ContextVar[str] = ContextVar("scope", default="tables")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read: ``spark.checkpoint.dir``. Only in local mode, where there is one machine, a temporary one will do."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="lumenpipe-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return "file://" + _local_dirs[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lumenpipe/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove the tables that this application has written to the shared folder; results not yet computed are lost."""
    _remove(spark, _folder(spark))


@contextmanager
def scope(spark: SparkSession):
    """``with scope(spark): ...`` removes the tables that are written within it at its end; results must be computed by then."""
    name = f"scope-{uuid.uuid4().hex}"
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)
        _remove(spark, f"{_folder(spark)}/{name}")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, never a re-run of the plan, and
    several consumers share one computation. The files stay until the end of the ``scope``, or ``release``.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{_scope.get()}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hex_id(col: Column | str) -> Column:
    """Identifier by its hexadecimal digits: case, blanks and dashes do not matter."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.translate(c, BLANKS + "-", ""))


def parent_id(col: Column | str) -> Column:
    """Normalised parent identifier; null, empty and all-zero mean none (null)."""
    c = hex_id(col)
    return F.when(F.translate(c, "0", "") == "", F.lit(None)).otherwise(c)


def floor_div(num: Column, den: Column) -> Column:
    """Integer division rounding towards minus infinity; the divisor must be positive."""
    return int_div(num, den) - F.when(num % den < 0, 1).otherwise(0)


def int_div(num: Column, den: Column) -> Column:
    """Integer division rounding towards zero."""
    return F.call_function("div", num, den)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    name, k = f"__{base}", 0
    while name.lower() in have:
        k += 1
        name = f"__{base}_{k}"
    return name


def previous_row(df: DataFrame, keys: list[str], time: str, columns: list[str], width: int) -> DataFrame:
    """Adds ``previous``, a struct of the columns of the row before in (time) order per key, null for the first.

    Rows are cut into time shards of ``width``; a shard's first row takes the last row of the shard before,
    found among one summary row per shard. So a hot key is spread over as many tasks as it has shards.
    """
    rows = df.withColumn("__shard", floor_div(F.col(time), F.lit(width)))
    inside = Window.partitionBy(*keys, "__shard").orderBy(time)
    rows = rows.withColumn("previous", F.lag(F.struct(*columns)).over(inside))
    last = rows.groupBy(*keys, "__shard").agg(F.max_by(F.struct(*columns), time).alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__shard")
    names = [F.col(k).alias(f"__k_{k}") for k in keys]
    carry = last.select(*names, F.col("__shard").alias("__s"), F.lag("__last").over(over).alias("__carry"))
    on = F.col("__shard") == F.col("__s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = rows.join(carry, on).withColumn("previous", F.coalesce("previous", "__carry"))
    return out.drop("__shard", "__s", "__carry", *[f"__k_{k}" for k in keys])
