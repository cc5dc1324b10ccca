"""Exact ranks, quantiles and dense codes without sorting a whole group in one task.

A plain window over a group (or over everything) pulls that group into one task. Here values are first reduced to
distinct values with counts (combined map-side), split into value ranges at approximate cut points, counted inside each
range, and shifted by the total of the lower ranges. The result is exact: the cut points only decide who works on what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.session import materialise

_ALL = "_all"


#: Distinct values that one range holds about, and copies of a group's cut points, so that a large group is no single join key.
RANGE_VALUES, SALTS = 50_000, 16


def _default_ranges(counts: DataFrame) -> int:
    """A power of two: at least as many value ranges as shuffle tasks, and one for every RANGE_VALUES distinct values."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << (max(tasks, 64, counts.count() // RANGE_VALUES) - 1).bit_length()


def rows_below(df: DataFrame, group: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """One row per distinct value: ``n`` rows hold it, ``below`` hold a smaller one, ``total`` are in the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return below_of_counts(counts, group, value, ranges)


def below_of_counts(counts: DataFrame, group: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """The same for distinct values that already carry their number of rows ``n``; further columns are kept."""
    keys = list(group) or [_ALL]
    # Read several times below; without the cut in lineage the whole upstream plan would run as often.
    base = materialise(counts if group else counts.withColumn(_ALL, F.lit(0)))
    ranges = ranges or _default_ranges(base)
    extra = [c for c in counts.columns if c not in (*group, value, "n")]
    steps = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")  # one constant, however many
    # Also written once, so that the totals and the rows inside a range use the same cut points.
    cuts = materialise(base.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, steps)).alias("_cuts")))
    if group:
        salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        with_cuts = base.withColumn("_salt", F.pmod(F.hash(value), F.lit(SALTS))).join(salted, [*keys, "_salt"]).drop("_salt")
    else:
        with_cuts = base.withColumn("_cuts", cuts.select("_cuts").scalar())
    placed = _place(with_cuts, "_cuts", value, "_range", ranges).drop("_cuts")
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # At most ``ranges`` rows per group.
    totals = (
        placed.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"),
                F.sum("_n").over(whole).alias("total"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = (
        placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(totals, [*keys, "_range"])
        .select(*keys, value, "n", (F.col("_offset") + F.col("_inside")).alias("below"), "total", *extra)
    )
    return out if group else out.drop(_ALL)


def _place(df: DataFrame, cuts: str, value: str, name: str, ranges: int) -> DataFrame:
    """Number of cut points below the value, by binary search over the sorted array (get gives none past its end)."""
    df = df.withColumn(name, F.lit(0))
    step = 1 << (ranges - 1).bit_length() - 1
    while step:
        beyond = F.get(cuts, F.col(name) + (step - 1)) < F.col(value)
        df = df.withColumn(name, F.col(name) + F.when(beyond, step).otherwise(0))
        step //= 2
    return df


def average_rank() -> Column:
    """Rank of a row of :func:`rows_below`, ties sharing their mean rank."""
    return F.col("below") + (F.col("n") + 1) / 2


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group; ``probs`` maps output names to probabilities."""
    ranked = rows_below(df, group, value)
    picks = [F.max("total").alias("n_values")]
    for name, p in probs.items():
        position = F.lit(p) * (F.col("total") - 1)
        picks += [
            F.max(F.when(F.col("below") <= F.floor(position), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(F.col("below") <= F.ceil(position), F.col(value))).alias(f"_hi_{name}"),
        ]
    found = ranked.groupBy(*group).agg(*picks)
    out = [*group, "n_values"]
    for name, p in probs.items():
        position = F.lit(p) * (F.col("n_values") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*out)


def dense_codes(df: DataFrame, value: str, code: str = "code", start: int = 0) -> DataFrame:
    """Distinct values in sort order with consecutive codes."""
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    # Ranges of the sort order are fixed by the checkpoint; each range is numbered alone and shifted by the lower ones.
    placed = materialise(
        distinct.repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range: the number of ranges is the number of shuffle partitions.
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(value)
    return placed.join(offsets, "_part").select(
        value, (F.col("_offset") + F.row_number().over(inside) - 1 + start).cast("long").alias(code)
    )


def assign_surrogate_keys(dimension: DataFrame, incoming: DataFrame, natural: str, key: str) -> DataFrame:
    """Keys of the new natural keys only: they continue after the largest existing key, in sort order."""
    new = incoming.select(natural).where(F.col(natural).isNotNull()).distinct()
    new = new.join(dimension.select(natural), natural, "left_anti")
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    return dense_codes(new, natural, "_code", start=1).select(
        natural, (F.col("_code") + top).cast("long").alias(key)
    )


class OrderedRanges:
    """Rows of each group in order, cut into ranges of which every task has one: running counts, sums and maxima of a group of any size.

    The order continues the group's columns in one sort key, so the cuts fall inside a large group as well; they are fixed by a checkpoint. Running
    values are those inside a range, combined with the totals of the group's lower ranges, of which there are as many as tasks. ``order`` must tell the
    rows of a group apart.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str], parts: int | None = None):
        self.by, self.order = by, order
        cut = [*by, *order] if parts is None else [parts, *by, *order]
        self.rows = materialise(df.repartitionByRange(*cut).withColumn("_part", F.spark_partition_id()))

    def add(self, **values: tuple[str, Column]) -> OrderedRanges:
        """Add columns with the running ``sum`` or ``max`` (first in each pair) of a value up to and including the row; ``total`` is the whole group's
        sum on each row."""
        how = {"sum": F.sum, "max": F.max, "total": F.sum}
        keys = [*self.by, "_part"]
        lower = Window.partitionBy(*self.by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        inside = Window.partitionBy(*keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = self.rows.groupBy(*keys).agg(*[how[kind](c).alias(f"_{name}") for name, (kind, c) in values.items()])
        spans = {name: Window.partitionBy(*self.by) if kind == "total" else lower for name, (kind, _) in values.items()}
        before = sums.select(*keys, *[how[kind](f"_{name}").over(spans[name]).alias(f"_{name}") for name, (kind, _) in values.items()])
        own = self.rows.withColumns({name: how[kind](c).over(inside) for name, (kind, c) in values.items() if kind != "total"})
        same = [own[c].eqNullSafe(before[c]) for c in keys]
        joined = own.join(before, same)
        done = {"sum": lambda name: own[name] + F.coalesce(before[f"_{name}"], F.lit(0)), "max": lambda name: F.greatest(own[name], before[f"_{name}"]), "total": lambda name: before[f"_{name}"]}
        self.rows = joined.select(*[own[c] for c in self.rows.columns], *[done[kind](name).alias(name) for name, (kind, _) in values.items()])
        return self
