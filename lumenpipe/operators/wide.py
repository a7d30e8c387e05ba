"""Attribute-value rows into wide, typed tables by characteristic sets.

An entity's characteristic set (signature) is the exact set of catalog attributes it has a value for, a bit mask. Every
entity is laid out densely under its signature: a row has exactly the cells of its set, in catalog order, and which
cell is which attribute is known from the signature alone. There are thousands of signatures, growing with the data, and a plan cannot
unite thousands of tables: so the rows are written once, sorted by signature, into a fixed number of groups of signatures
that agree on the first attributes. Each group is read with the columns that its signatures can have, and
the groups are united by name with the missing columns null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, hex_id, materialize

#: Signatures are grouped by whether they have each of so many attributes, the first of the catalog: 2**GROUP_BITS groups.
GROUP_BITS = 4

SQL_TYPES = {"string": "string", "int64": "bigint", "double": "double", "bool": "boolean"}


def bare_value(col: str | Column) -> Column:
    """A written value without outer blanks and one pair of enclosing double quotes; null if nothing is left."""
    c = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))
    quoted = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    inner = F.when(quoted, F.btrim(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(BLANKS))).otherwise(c)
    return F.when(inner != "", inner)


def reads_as(value: Column, value_type: Column) -> Column:
    """Whether a bare value reads as the type: 64-bit int64, finite decimal double, true/false, any string."""
    whole = value.rlike("^[+-]?[0-9]+$") & value.try_cast("bigint").isNotNull()
    number = value.try_cast("double")
    decimal = value.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(number) < float("inf"))
    return (
        F.when(value_type == "int64", whole)
        .when(value_type == "double", F.coalesce(decimal, F.lit(False)))
        .when(value_type == "bool", F.lower(value).isin("true", "false"))
        .otherwise(F.lit(True))
    )


def attribute_rows(spans: DataFrame, attrs: DataFrame) -> DataFrame:
    """(trace_id, span_id, key, value, wal_seq) from the attribute rows and the overflow maps; ids and keys normalised."""
    overflow = spans.where(F.size("_overflow_attrs") > 0).select(
        "trace_id", "span_id", F.explode("_overflow_attrs").alias("key", "value"), "wal_seq"
    )
    both = attrs.select("trace_id", "span_id", "key", "value", "wal_seq").unionByName(overflow)
    return both.select(
        hex_id("trace_id").alias("trace_id"), hex_id("span_id").alias("span_id"),
        F.lower(F.btrim("key", F.lit(BLANKS))).alias("key"), bare_value("value").alias("value"), "wal_seq",
    )


def entities(rows: DataFrame, catalog: list[tuple[str, str, str]]) -> DataFrame:
    """One dense row per span with attributes: trace_id, span_id, its signature ``mask``, and ``cells`` (value, ill) in catalog order.

    ``value`` is the latest well-typed one (highest wal_seq, ties to the greater text), null if there is none; ``ill`` says whether any
    value of the attribute did not read as its type. Rows are first folded by (span, attribute), map-side.
    """
    names = F.create_map(*[F.lit(x) for i, (k, c, _) in enumerate(catalog) for x in (k.lower(), i, c.lower(), i)])
    types = F.array(*[F.lit(t) for _, _, t in catalog])
    known = rows.withColumn("bit", names[F.col("key")]).where("bit IS NOT NULL AND value IS NOT NULL")
    fits = F.coalesce(reads_as(F.col("value"), F.get(types, F.col("bit"))), F.lit(False))
    folded = known.withColumn("fits", fits).groupBy("trace_id", "span_id", "bit").agg(
        F.max(F.when(F.col("fits"), F.struct("wal_seq", "value")))["value"].alias("value"), F.max(~F.col("fits")).alias("ill")
    )
    cells = F.transform(F.sort_array(F.collect_list(F.struct("bit", "value", "ill"))), lambda x: F.struct(x["value"], x["ill"]))
    mask = F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).cast("bigint")
    return folded.groupBy("trace_id", "span_id").agg(mask.alias("mask"), cells.alias("cells"))


def signature_keys(mask: Column, catalog: list[tuple[str, str, str]]) -> Column:
    """The attributes of a signature, in the order of the cells of its rows."""
    has = lambda i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0
    return F.filter(F.array(*[F.lit(k) for k, _, _ in catalog]), lambda _, i: has(i))


def laid_out(spans: DataFrame, attrs: DataFrame, listed: list[tuple[str, str, str]]) -> DataFrame:
    """The dense rows of all entities in a table, by group of signatures and sorted by signature; no shuffle beyond that of the fold."""
    rows = entities(attribute_rows(spans, attrs), listed)
    group = F.col("mask").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).cast("int")
    return materialize(rows.withColumn("sets", group).sortWithinPartitions("sets", "mask"), "sets")


def _listed(catalog: DataFrame) -> list[tuple[str, str, str]]:
    listed = [tuple(r) for r in catalog.select("key", "column_name", "value_type").orderBy("key").limit(63).collect()]
    if len(listed) > 62:
        raise ValueError("the catalog may have at most 62 attributes")
    return listed


def _typed(value: Column, value_type: str) -> Column:
    return value if value_type == "string" else F.lower(value).try_cast(SQL_TYPES[value_type])


def wide_table(spans: DataFrame, attrs: DataFrame, catalog: DataFrame, with_bare_spans: bool = True) -> DataFrame:
    """One row per span: trace_id, span_id, a typed column per catalog row, and ``ill_typed`` (keys with bad values).

    Spans without any known attribute are there with nulls unless ``with_bare_spans`` is off. The catalog
    is a small driver-side table of at most 62 attributes (one bit each).
    """
    listed = _listed(catalog)
    rows = laid_out(spans, attrs, listed)
    mask = F.col("mask")

    def cell(i: int) -> Column:
        """The i-th attribute: its place among the cells is the number of lower bits in the signature."""
        place = F.bit_count(mask.bitwiseAND(F.lit((1 << i) - 1).cast("bigint"))).cast("int")
        return F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.get("cells", place)["value"])

    keys = signature_keys(mask, listed)
    ill = F.filter(F.transform(keys, lambda k, i: F.when(F.get("cells", i)["ill"], k)), lambda k: k.isNotNull())

    def table(group: int) -> DataFrame:
        columns = [(i, c, t) for i, (_, c, t) in enumerate(listed) if i >= GROUP_BITS or group >> i & 1]
        cells = [_typed(cell(i), t).alias(c) for i, c, t in columns]
        return rows.where(F.col("sets") == group).select("trace_id", "span_id", *cells, ill.alias("ill_typed"))

    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [table(g) for g in reversed(range(1 << min(GROUP_BITS, len(listed))))])
    if with_bare_spans:
        ids = spans.select(hex_id("trace_id").alias("trace_id"), hex_id("span_id").alias("span_id")).distinct()
        found = rows.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__s"))
        bare = ids.join(found, (F.col("trace_id") == F.col("__t")) & (F.col("span_id") == F.col("__s")), "left_anti")
        out = out.unionByName(bare, allowMissingColumns=True)
    columns = [F.col(c) if c in out.columns else F.lit(None).cast(SQL_TYPES[t]).alias(c) for _, c, t in listed]
    return out.select("trace_id", "span_id", *columns, "ill_typed")


def ill_typed_values(spans: DataFrame, attrs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(trace_id, span_id, key) of attributes with a value that does not read as the catalog's type.

    The cells of the dense rows say which place is ill, their signatures which attribute that is.
    """
    listed = _listed(catalog)
    rows = laid_out(spans, attrs, listed)
    places = rows.select("trace_id", "span_id", "mask", F.posexplode("cells").alias("place", "cell")).where("cell.ill")
    return places.select("trace_id", "span_id", F.get(signature_keys(F.col("mask"), listed), F.col("place")).alias("key"))
