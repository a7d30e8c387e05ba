"""Content hashes of the data model, as JVM-side expressions: FNV-1a and name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of FNV-1a, and the DNS name space of UUIDs.
FNV32, PRIME32 = 0x811C9DC5, 0x01000193
FNV64, PRIME64 = 0xCBF29CE484222325, 0x100000001B3
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

_MASK = (1 << 32) - 1


def fnv1a_64(data: bytes) -> int:
    """Signed 64-bit FNV-1a of bytes on the driver."""
    h = FNV64
    for b in data:
        h = ((h ^ b) * PRIME64) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def fnv1a_32(data: bytes) -> int:
    h = FNV32
    for b in data:
        h = ((h ^ b) * PRIME32) & 0xFFFFFFFF
    return h


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a string as numbers."""
    one_per_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    n = F.octet_length(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.ascii(F.substr(one_per_byte, i, F.lit(1))).cast("bigint"))
    return F.when(n > 0, each).when(text.isNotNull(), F.array().cast("array<bigint>"))


def long_bytes(number: Column) -> Column:
    """The eight little-endian bytes of a 64-bit number."""
    return F.array(*[F.shiftrightunsigned(number, 8 * i).bitwiseAND(F.lit(255).cast("bigint")) for i in range(8)])


def fnv32_of(data: Column) -> Column:
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(PRIME32).cast("bigint")).bitwiseAND(F.lit(_MASK))
    return F.aggregate(data, F.lit(FNV32).cast("bigint"), step)


def fnv64_of(data: Column) -> Column:
    """FNV-1a 64 over an array of bytes, as a signed number.

    The state is kept in two halves: the prime is 2**40 + 435, so no product leaves 64 bits.
    """
    small = F.lit(PRIME64 & 0xFFFF).cast("bigint")
    mask = F.lit(_MASK)

    def step(s: Column, b: Column) -> Column:
        low = s["low"].bitwiseXOR(b)
        product = low * small
        high = s["high"] * small + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(FNV64 >> 32).cast("bigint").alias("high"), F.lit(FNV64 & _MASK).cast("bigint").alias("low"))
    return F.aggregate(data, start, step, lambda s: F.shiftleft(s["high"], 32).bitwiseOR(s["low"]))


def fnv32(text: Column) -> Column:
    """FNV-1a 32 of a string's UTF-8 bytes (null stays null)."""
    return fnv32_of(utf8_bytes(text))


def fnv64(text: Column) -> Column:
    return fnv64_of(utf8_bytes(text))


def uuid5_dns(text: Column) -> Column:
    """UUID version 5 of a name in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(text, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant,
        F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def metric_id(name: Column, description: Column, unit: Column, kind: Column, resource_id: Column, scope_id: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (name, description, unit, kind, resource_id, scope_id)]
    return uuid5_dns(F.concat_ws("\u0000", *parts))


def series_id(metric_key: Column, attributes: Column) -> Column:
    """Of the metric and its sorted attributes; ``attributes`` is a map of strings."""
    sorted_ = F.array_sort(F.map_entries(attributes))
    tail = F.array_join(F.transform(sorted_, lambda e: F.concat(e["key"], F.lit("\u0000"), e["value"], F.lit("\u0000"))), "")
    return fnv64(F.concat(F.lit("metric_"), F.regexp_replace(metric_key, "-", ""), F.lit("\u0000"), tail))
