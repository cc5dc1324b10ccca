"""JSON, maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_number(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("double")


def map_mean(c: Column) -> Column:
    """Mean of a map's values; 0 for an empty map, missing for a missing one."""
    values = F.map_values(c)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values)).when(c.isNotNull(), F.lit(0.0))


def map_below(c: Column, limit: float) -> Column:
    return F.map_filter(c, lambda _, v: v < limit)


def top_by_abs(c: Column, value_field: str, name_field: str, k: int = 3) -> Column:
    """The k elements of an array of structs with the largest absolute value (ties by name)."""
    keyed = F.transform(c, lambda e: F.struct((-F.abs(e[value_field])).alias("o"), e[name_field].alias("t"), e.alias("e")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda e: e["e"])
