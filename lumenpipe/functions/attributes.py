"""Typed access to overflow attributes: a map of keys to JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _raw(attributes: Column, key: str) -> Column:
    return F.try_element_at(attributes, F.lit(key))


def _is_text(raw: Column) -> Column:
    return raw.startswith('"')


def overflow_text(raw: Column) -> Column:
    """A JSON string as its text with its escapes resolved, any other value as its JSON text."""
    # texts with escapes go through the JSON parser; one that is no valid JSON keeps its inner characters
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    inner = F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))
    quoted = (F.length(raw) >= 2) & raw.startswith('"') & raw.endswith('"')
    return F.when(quoted, F.when(raw.contains("\\"), F.coalesce(decoded, inner)).otherwise(inner)).otherwise(raw)


def overflow_get_str(attributes: Column, key: str) -> Column:
    """A text as it is, any other value as its JSON text; null if the key is missing."""
    return overflow_text(_raw(attributes, key))


def overflow_get_i64(attributes: Column, key: str) -> Column:
    """A whole number, or a fraction cut off; null for texts and others."""
    raw = _raw(attributes, key)
    number = F.coalesce(raw.try_cast("bigint"), F.when(F.abs(raw.try_cast("double")) < 2.0**63, raw.try_cast("double")).try_cast("bigint"))
    return F.when(~_is_text(raw) & raw.rlike(r"^[-+]?[0-9.]"), number)


def overflow_get_f64(attributes: Column, key: str) -> Column:
    """A number; null for texts and others."""
    raw = _raw(attributes, key)
    return F.when(~_is_text(raw) & raw.rlike(r"^[-+]?[0-9.]"), raw.try_cast("double"))


def overflow_get_bool(attributes: Column, key: str) -> Column:
    raw = _raw(attributes, key)
    return F.when(raw == "true", True).when(raw == "false", False)
