"""Declared loads of facts: several foreign keys resolved in one pass, rejects by reason, then an upsert."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.operators.merge import upsert
from cropspark.operators.ranking import dedupe_latest
from cropspark.session import materialise

DUPLICATE = "duplicate"


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``on`` maps columns of the rows to those of the dimension, ``key`` is the dimension's own, ``reason`` names rows it lacks."""

    reason: str
    dimension: DataFrame
    on: dict[str, str]
    key: str


@dataclass(frozen=True)
class Load:
    """What makes a fact of landed rows.

    ``required`` values must be there, ``references`` must resolve, both in the order given: a row counts for the first it fails. Of several rows with one
    ``key`` the last by ``order`` is loaded, the others count as duplicates.
    """

    key: list[str]
    values: list[str]
    required: list[str] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    order: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Loaded:
    accepted: DataFrame
    rejects: DataFrame
    counts: DataFrame

    def into(self, stored: DataFrame, key: list[str]) -> DataFrame:
        """The stored fact with the accepted rows, and what happened to each."""
        return upsert(stored, self.accepted, key)


def resolve(rows: DataFrame, plan: Load) -> Loaded:
    """Accepted rows (key and values), rejected rows with their ``reason``, and rows by reason (``accepted`` and ``duplicate`` among them).

    The rows are read once: each dimension, reduced to one row for each natural key, is joined from the left, and the outcome is written once for the
    three results. Spark broadcasts a dimension if its own size check allows it, and splits hot keys otherwise. A reference whose ``key`` is the
    natural key itself only checks it.
    """
    reason = F.lit(None).cast("string")
    for c in plan.required:
        reason = F.coalesce(reason, F.when(F.col(c).isNull(), F.lit(f"missing {c}")))
    judged = rows.withColumn("_reason", reason)
    for i, r in enumerate(plan.references):
        natural = list(r.on.values())
        known = r.dimension.where(F.col(r.key).isNotNull()).select(*[F.col(c).alias(f"_{i}_{c}") for c in natural], F.col(r.key).alias(f"_{i}_key"))
        known = dedupe_latest(known, [f"_{i}_{c}" for c in natural])
        same = F.lit(True)
        for own, theirs in r.on.items():
            same = same & (F.col(own) == F.col(f"_{i}_{theirs}"))
        judged = judged.join(known, same, "left").withColumns({
            "_reason": F.coalesce("_reason", F.when(F.col(f"_{i}_key").isNull(), r.reason)), r.key: F.col(f"_{i}_key")})
        judged = judged.drop(f"_{i}_key", *[f"_{i}_{c}" for c in natural])
    judged = materialise(judged)
    good = judged.where(F.col("_reason").isNull())
    columns = [*plan.key, *plan.values]
    extra = [c for c in plan.order if c not in columns]
    once = dedupe_latest(good.select(*columns, *extra), plan.key, plan.order).select(*columns)
    by_key = good.groupBy(*plan.key).agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle: a key with very many rows is one
    sums = by_key.agg(F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(DUPLICATE))
    outcome = sums.select(F.explode(F.create_map(F.lit("accepted"), "accepted", F.lit(DUPLICATE), DUPLICATE)).alias("reason", "n"))
    rejects = judged.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    counts = outcome.unionByName(rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
    return Loaded(once, rejects.select(*rows.columns, "reason"), counts)


def add_members(dimension: DataFrame, rows: DataFrame, natural: str, attributes: dict[str, Column], key: str) -> DataFrame:
    """The dimension with a member for each natural key that only the rows have; new keys continue after the largest, in sort order."""
    from cropspark.operators.ranks import assign_surrogate_keys

    fresh = rows.where(F.col(natural).isNotNull()).groupBy(natural).agg(*[F.min(c).alias(name) for name, c in attributes.items()])
    keys = assign_surrogate_keys(dimension, fresh, natural, key)
    new = fresh.join(keys, natural)
    blank = [c for c in dimension.columns if c not in new.columns]
    return dimension.unionByName(new.select(*[c for c in dimension.columns if c not in blank], *[F.lit(None).cast(dimension.schema[c].dataType).alias(c) for c in blank]))
