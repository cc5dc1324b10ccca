"""Year folds, baselines and calibrated intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions.numeric import at_least
from cropspark.operators.ranks import exact_quantiles


def year_folds(years: list[int], n_splits: int = K.YIELD_FOLDS, min_train: int = K.YIELD_MIN_TRAIN_YEARS) -> list[tuple[list[int], int]]:
    """Expanding window: train on all years before the validation year; the last ``n_splits`` possible years."""
    ordered = sorted(set(years))
    candidates = ordered[min_train:]
    if not candidates:
        raise ValueError(f"history too short: {len(ordered)} years, at least {min_train + 1} are needed")
    return [([y for y in ordered if y < v], v) for v in candidates[-n_splits:]]


def distinct_years(df: DataFrame, year: str = "year") -> list[int]:
    return sorted(r[0] for r in df.select(year).distinct().collect())  # bounded by the calendar


def fold_sizes(df: DataFrame, folds: list[tuple[list[int], int]], year: str = "year") -> DataFrame:
    """Rows trained on and validated per fold, in one aggregate over year counts."""
    per_year = df.groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    spread = per_year.withColumn("validation_year", F.explode(F.array(*[F.lit(v) for _, v in folds])))
    return spread.groupBy("validation_year").agg(
        F.coalesce(F.sum(F.when(F.col(year) < F.col("validation_year"), F.col("n"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(F.col(year) == F.col("validation_year"), F.col("n"))), F.lit(0)).alias("n_validation"))


def with_baseline(df: DataFrame, training: Column, target: str, history: str, group: str) -> DataFrame:
    """Baseline per row: own history mean, else the group's training mean, else the overall training mean.

    The evaluated year never enters a training mean.
    """
    train = df.where(training)
    means = train.groupBy(group).agg(F.avg(target).alias("_group_mean"))
    overall = train.agg(F.avg(target)).scalar()
    return df.join(means, group, "left").withColumn("baseline", F.coalesce(F.col(history), F.col("_group_mean"), overall)).drop("_group_mean")


def calibrated_intervals(oof: DataFrame, test_year: int, years: list[int], group: str = "crop_id",
                         min_own: int = K.MIN_CROP_RESIDUALS) -> DataFrame:
    """p10 and p90 around out-of-fold predictions from the residuals of other years.

    Residuals of the test year calibrate nobody and no row calibrates its own year. By crop where enough residuals exist,
    else over all crops; the lower bound is at least 0.
    """
    residuals = oof.where(F.col("year") != test_year).select(group, F.col("year").alias("_own"), (F.col("y") - F.col("yhat")).alias("res"))
    others = residuals.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years]))).where(F.col("year") != F.col("_own"))
    own = exact_quantiles(others, ["year", group], "res", {"own_lo": 0.1, "own_hi": 0.9}).where(F.col("n_values") >= min_own).drop("n_values")
    overall = exact_quantiles(others, ["year"], "res", {"all_lo": 0.1, "all_hi": 0.9}).drop("n_values")
    joined = oof.join(overall, "year", "left").join(own, ["year", group], "left")
    low = F.col("yhat") + F.coalesce("own_lo", "all_lo")
    return joined.withColumns({
        "lo": at_least(low, 0.0), "hi": F.col("yhat") + F.coalesce("own_hi", "all_hi"),
    }).drop("own_lo", "own_hi", "all_lo", "all_hi")


def interval_coverage(bounded: DataFrame, year: int) -> DataFrame:
    inside = F.col("y").between(F.col("lo"), F.col("hi")).cast("double")
    return bounded.where(F.col("year") == year).agg(F.avg(inside).alias("coverage"), F.count(F.lit(1)).alias("n"))
