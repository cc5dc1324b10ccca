"""Aggregates with the domain's rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def harvest_rollup(df: DataFrame, keys: list[str], sown: str, harvested: str, production: str, yield_col: str, lots: str | None = None) -> DataFrame:
    """Sum areas and production; the yield is recomputed from the sums, or the mean where nothing was harvested.

    Rows may be sums already: then ``lots`` tells how many yields each stands for, and ``yield_col`` holds their sum.
    """
    area, tons = F.sum(harvested), F.sum(production)
    mean = F.avg(yield_col) if lots is None else F.sum(yield_col) / F.nullif(F.sum(lots), F.lit(0))
    return df.groupBy(*keys).agg(
        F.sum(sown).alias(sown), area.alias(harvested), tons.alias(production),
        F.coalesce(F.when(area > 0, tons / area), mean).alias(yield_col),
    )


def combine_blocks(df: DataFrame, keys: list[str], mean: str, low: str, high: str, count: str) -> DataFrame:
    """Final step over partial statistics: weighted mean, extremes, and none at all where no reading counted."""
    counted = df.where(F.col(count) > 0)
    total = F.sum(count)
    return counted.groupBy(*keys).agg(
        (F.sum(F.when(F.col(mean).isNotNull(), F.col(mean) * F.col(count)))
         / F.nullif(F.sum(F.when(F.col(mean).isNotNull(), F.col(count))), F.lit(0))).alias(mean),
        F.min(low).alias(low), F.max(high).alias(high), total.alias(count),
    )


def moments(value: str, weight: str | None = None) -> list[Column]:
    """Aggregates that later merge: count, mean and squared deviations of a value, and of a weight its sum, its count and the weighted sum."""
    n, none = F.count(value), F.lit(None).cast("double")
    state = [n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2")]
    if weight is None:
        return [*state, F.lit(0).cast("long").alias("weights"), none.alias("weight_sum"), none.alias("product_sum"), none.alias("product_weight")]
    both = F.col(value).isNotNull()
    return [*state, F.count(weight).alias("weights"), F.sum(weight).cast("double").alias("weight_sum"), F.sum(F.col(value) * F.col(weight)).cast("double").alias("product_sum"),
            F.sum(F.when(both, F.col(weight))).cast("double").alias("product_weight")]


def merge_moments(df: DataFrame, keys: list[str], mean: str, std: str, weight_mean: str, weighted: str) -> DataFrame:
    """Mean, sample deviation, mean weight and weighted mean per key from rows of ``moments``; one value has no deviation."""
    n, centre = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * centre * centre
    return df.groupBy(*keys).agg(
        centre.alias(mean), F.when(n > 1, F.sqrt(F.greatest(F.sum("m2") + between, F.lit(0.0)) / (n - 1))).alias(std),
        (F.sum("weight_sum") / F.nullif(F.sum("weights"), F.lit(0))).alias(weight_mean),
        (F.sum("product_sum") / F.nullif(F.sum("product_weight"), F.lit(0))).alias(weighted))


def merge_aliases(df: DataFrame, keys: list[str], low: str, high: str, mean: str, first_of: list[str], order: str) -> DataFrame:
    """Rows that became one after renaming: extremes, mean of means, first known attribute by ``order``."""
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_of]
    return df.groupBy(*keys).agg(F.min(low).alias(low), F.max(high).alias(high), F.avg(mean).alias(mean), *firsts)


def most_frequent_class(df: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """Most frequent label per key, ties to the smallest. Counted first: a hot key never meets in one buffer."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(name))


def largest_share(df: DataFrame, keys: list[str], label: str, weight: str, name: str) -> DataFrame:
    """Label with the largest weight per key, ties to the smallest label."""
    return df.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col(weight), F.col(label))).alias(name))


def share_of_total(df: DataFrame, count: str, share: str, digits: int = 0) -> DataFrame:
    """Percent of the grand total (half-up); the total is a scalar subquery, no window over everything."""
    from cropspark.functions.numeric import round_half_up

    total = df.agg(F.sum(count)).scalar()
    return df.withColumn(share, round_half_up(F.col(count) / F.nullif(total, F.lit(0)) * 100, digits))


def counts_by_level(df: DataFrame, level: str, names: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """One column per level; a level that does not occur is 0."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(level) == v).alias(n) for n, v in names.items()])


def ordered_values(df: DataFrame, keys: list[str], day: str, value: str, name: str) -> DataFrame:
    """Values of a bounded span in day order as an array."""
    pairs = F.array_sort(F.collect_list(F.struct(day, value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def completeness(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, columns, percent filled per column (map) and rows repeating a key, without a second scan per column."""
    columns = [c for c in df.columns if not c.startswith("_")]
    filled = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[F.round(F.coalesce(100.0 * F.count(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 2) for c in columns]))
    duplicates = (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))) if keys else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  filled.alias("completeness_pct"), duplicates.cast("long").alias("key_duplicates"))


def excess_rows(df: DataFrame, keys: list[str], name: str = "excess") -> DataFrame:
    """Rows beyond the first of every key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.greatest(F.col("_n") - 1, F.lit(0))), F.lit(0)).cast("long").alias(name))


def error_sets(df: DataFrame, product: str, horizon: str, model_error: str, naive_error: str) -> DataFrame:
    """Errors overall, by product, by horizon and by both, in one pass."""
    sets = [[], [product], [horizon], [product, horizon]]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], F.col(product), F.col(horizon)).agg(
        F.grouping(product).alias("all_products"), F.grouping(horizon).alias("all_horizons"),
        F.count(F.lit(1)).alias("n"), F.avg(model_error).alias("mae_model"), F.avg(naive_error).alias("mae_naive"))
    return out.withColumn("improvement", F.when(F.col("mae_naive") > 0, 1 - F.col("mae_model") / F.col("mae_naive")))


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and n. The total variation comes from the sample variance, one pass and stable."""
    error = F.col(actual) - F.col(predicted)
    n = F.count(error)
    spread = F.var_pop(F.when(error.isNotNull(), F.col(actual))) * n
    squares = F.sum(error * error)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread > 0, 1 - squares / spread).alias("r2"), n.alias("n"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and F1 weighted by class support, from the confusion counts (classes are few)."""
    confusion = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("c").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("a") == F.col("p"), F.col("c")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("c").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per_class = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    f1 = F.coalesce(2 * F.col("hit") / F.nullif(F.col("actual") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    total = F.sum("actual")
    return per_class.agg((F.sum(f1 * F.col("actual")) / total).alias("f1_weighted"),
                         (F.sum("hit") / total).alias("accuracy"), total.alias("n"))


def pct_if(condition: Column) -> Column:
    """Aggregate: percent of rows meeting the condition, missing when there are none."""
    return F.count_if(condition) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100
