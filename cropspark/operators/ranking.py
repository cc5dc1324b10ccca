"""Latest rows, top-k lists, dedupe and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key. An aggregate: combined map-side, so a hot key costs no big sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def dedupe_latest(df: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """One row per key: the largest by ``order``, remaining ties by the whole row, so the choice is repeatable."""
    rest = [c for c in df.columns if c not in keys]
    return latest_per_key(df, keys, [*order, *[c for c in rest if c not in order]])


def top_rows(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def signed_top(df: DataFrame, value: str, k: int, rising: bool, ties: list[str]) -> DataFrame:
    """The k largest rises (or falls) with their place in the list; zero is neither."""
    moved = df.where(F.col(value) > 0) if rising else df.where(F.col(value) < 0)
    order = F.col(value).desc() if rising else F.col(value).asc()
    return moved.orderBy(order, *ties).limit(k)


def top_by_magnitude(df: DataFrame, value: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.abs(F.col(value)).desc(), *ties).limit(k)


def directed(column: str, descending: bool) -> Column:
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def spanish_order(column: str) -> Column:
    """Sort key in Spanish collation, blanks last."""
    return F.collate(F.nullif(F.trim(F.col(column)), F.lit("")), "es").asc_nulls_last()


def in_spanish_order(df: DataFrame, by: list[str], column: str, ties: list[str], place: str = "place") -> DataFrame:
    """Each row's place in Spanish order within its group, blanks last. Groups of any size: places are counted over ordered ranges."""
    from cropspark.operators.ranks import OrderedRanges

    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    keyed = df.withColumns({"_blank": text.isNull(), "_key": F.collate(text, "es")})
    keyed = keyed.withColumns({f"_tie{i}": F.col(c) for i, c in enumerate(ties)})
    order = ["_blank", "_key", *[f"_tie{i}" for i in range(len(ties))]]
    return OrderedRanges(keyed, by, order).add(**{place: ("sum", F.lit(1))}).rows.drop("_part", *order)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_with_precedence(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which an earlier frame wins over a later one for the same key."""
    ranked = [f.withColumn("_priority", F.lit(-i)) for i, f in enumerate(frames)]
    return dedupe_latest(union_all(ranked), keys, ["_priority"]).drop("_priority")
