"""Series operators.

They expect one row per key and time step. Reduce raw rows to that grain first: then a window partition is bounded by
the calendar, however many raw rows one hot key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.functions import dates as D


def _present(value: str | Column, *fields: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.struct(value.alias("value"), *fields))


def with_values_before(df: DataFrame, keys: list[str], day: str, value: str, lookups: dict[str, tuple[int, int | None]],
                       last_flag: str | None = None) -> DataFrame:
    """As-of lookups backwards: for each name the last value at least so many days old and at most so many, and its day.

    Range frames over the series itself answer them; nothing is joined, and all lookups share one sort by day number.
    ``last_flag`` marks the row of a series that nothing follows.
    """
    order = Window.partitionBy(*keys).orderBy("_day_no")
    out = df.withColumn("_day_no", D.day_number(F.col(day)))
    columns = {}
    for name, (at_least_days, max_age_days) in lookups.items():
        lower = Window.unboundedPreceding if max_age_days is None else -max_age_days
        columns[f"_{name}"] = F.last(_present(value, day), ignorenulls=True).over(order.rangeBetween(lower, -at_least_days))
    if last_flag:
        columns[last_flag] = F.lead("_day_no").over(order).isNull()
    out = out.withColumns(columns)
    found = {}
    for name in lookups:
        found |= {name: F.col(f"_{name}.value"), f"{name}_day": F.col(f"_{name}.{day}")}
    return out.withColumns(found).drop("_day_no", *[f"_{name}" for name in lookups])


def with_value_before(df: DataFrame, keys: list[str], day: str, value: str, name: str, at_least_days: int = 1,
                      max_age_days: int | None = None) -> DataFrame:
    return with_values_before(df, keys, day, value, {name: (at_least_days, max_age_days)})


def value_at_offset(keys: list[str], position: str, value: str | Column, offset: int) -> Column:
    """Value exactly ``offset`` steps away on an integer axis; a gap gives none (unlike lag)."""
    frame = Window.partitionBy(*keys).orderBy(position).rangeBetween(offset, offset)
    return F.max(value).over(frame)


def prior_mean(keys: list[str], position: str, value: str) -> Column:
    """Mean of all earlier rows, missing ones ignored; the current row never counts."""
    frame = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return F.avg(value).over(frame)


def rolling(keys: list[str], position: str, value: str | Column, width: int, min_count: int, kind: str = "avg") -> Column:
    """Mean or sample deviation of the last ``width`` steps of an integer axis, when enough of them have a value."""
    frame = Window.partitionBy(*keys).orderBy(position).rangeBetween(-(width - 1), 0)
    measure = {"avg": F.avg, "std": F.stddev_samp}[kind]
    return F.when(F.count(value).over(frame) >= min_count, measure(value).over(frame))


def prior_stats(df: DataFrame, keys: list[str], position: str, value: str, width: int) -> DataFrame:
    """Mean, deviation and count of the last ``width`` rows before each row."""
    frame = Window.partitionBy(*keys).orderBy(position).rowsBetween(-width, -1)
    return df.withColumns({
        "prior_mean": F.avg(value).over(frame), "prior_std": F.stddev_samp(value).over(frame),
        "prior_n": F.count(value).over(frame),
    })


def climatology(df: DataFrame, keys: list[str], value: str, min_years: int) -> DataFrame:
    """Percent anomaly and z-score against all years of the same key (one row per key and year)."""
    group = Window.partitionBy(*keys)
    mean, std, n = F.avg(value).over(group), F.stddev_samp(value).over(group), F.count(value).over(group)
    out = df.withColumns({"_mean": mean, "_std": std, "_n": n})
    enough = F.col("_n") >= min_years
    gap = F.col(value) - F.col("_mean")
    return out.withColumns({
        "anomaly_pct": F.when(enough & (F.col("_mean") > 0), gap / F.col("_mean") * 100),
        "z_score": F.when(enough & (F.col("_std") > 0), gap / F.col("_std")),
    }).drop("_mean", "_std", "_n")


def relative_to_group_mean(df: DataFrame, keys: list[str], value: str, index: str | None = None,
                           deviation: str | None = None) -> DataFrame:
    """Index (mean = 100) and/or deviation from the group mean.

    The mean is aggregated and joined back: a group may hold a third of all rows, which a window would put in one task.
    """
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    out = df.join(means, keys, "left")
    if index:
        out = out.withColumn(index, F.when(F.col("_mean") != 0, F.col(value) / F.col("_mean") * 100))
    if deviation:
        out = out.withColumn(deviation, F.col(value) - F.col("_mean"))
    return out.drop("_mean")


def difference_from_previous(keys: list[str], position: str, value: str) -> Column:
    order = Window.partitionBy(*keys).orderBy(position)
    return F.col(value) - F.lag(value).over(order)


def forward_fill(df: DataFrame, keys: list[str], position: str, value: str, limit: int, end: str) -> DataFrame:
    """Carry each value over at most ``limit`` following empty steps, up to the ``end`` position column.

    Each row is expanded over the steps it fills, so no spine has to be joined to every series.
    """
    order = Window.partitionBy(*keys).orderBy(position)
    stop = F.least(F.coalesce(F.lead(position).over(order) - 1, F.col(end)), F.col(position) + limit)
    return (
        df.where(F.col(value).isNotNull()).withColumn("_stop", F.greatest(stop, F.col(position)))
        .withColumn("_step", F.explode(F.sequence(F.col(position), F.col("_stop"))))
        .withColumn("is_filled", F.col("_step") != F.col(position))
        .withColumn(position, F.col("_step")).drop("_step", "_stop")
    )


def interpolate(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Every step from the first to the last row: linear between known values, the last one carried to the end."""
    order = Window.partitionBy(*keys).orderBy(position)
    last = df.groupBy(*keys).agg(F.max(position).alias("_end"))
    known = df.where(F.col(value).isNotNull()).select(*keys, position, value).join(last, keys)
    following = F.lead(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))).over(order)
    spread = known.withColumn("_next", following).withColumn(
        "_stop", F.coalesce(F.col("_next.p") - 1, F.col("_end")))
    step = F.explode(F.sequence(F.col(position), F.col("_stop"))).alias("_step")
    rows = spread.select(*keys, position, value, "_next", step)
    slope = (F.col("_next.v") - F.col(value)) / (F.col("_next.p") - F.col(position))
    filled = F.coalesce(F.col(value) + slope * (F.col("_step") - F.col(position)), F.col(value))
    return rows.select(*keys, F.col("_step").alias(position), filled.alias(value),
                       (F.col("_step") != F.col(position)).alias("is_filled"))


def series_summary(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    first, last = F.min_by(value, day), F.max_by(value, day)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        first.alias("first_value"), last.alias("last_value"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"), F.count(F.lit(1)).alias("n_days"),
        F.when(first > 0, (last - first) / first * 100).alias("change_pct"),
    )
