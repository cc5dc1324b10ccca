"""Feature store: one row per town, crop and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.operators import windows as W

CROP_SERIES = ["town_id", "crop_id"]
LAGGED = ["rain_year", "temp_year", "spi_mean", "oni_mean", "price_mean"]
HISTORY = ["yield_t_ha", "production_t"]


def enso_years(enso: DataFrame, nino: DataFrame) -> DataFrame:
    """Annual means of the indices over months and regions, and the El Niño flag."""
    return enso.join(nino.select("year", "is_nino"), "year", "left").groupBy("year").agg(
        F.avg("spi").alias("spi_mean"), F.avg("oni").alias("oni_mean"), F.avg("rain_anomaly_pct").alias("rain_anomaly_mean"),
        F.bool_or("is_nino").alias("is_nino"))


def input_index_years(inputs: DataFrame) -> DataFrame:
    """Input prices as index (mean of each series = 100), then mean and deviation per year."""
    indexed = W.relative_to_group_mean(inputs, ["input_name", "region_id"], "price", index="price_index")
    return indexed.groupBy("year").agg(
        F.avg("price_index").alias("input_index_mean"), F.stddev_samp("price_index").alias("input_index_std"))


def add_lags(df: DataFrame, columns: list[str] = LAGGED, years: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Values exactly k calendar years earlier; a gap gives none. One row per series and year: bounded windows."""
    return df.withColumns({
        f"{c}_lag{k}": W.value_at_offset(CROP_SERIES, "year", c, -k) for k in years for c in columns if c in df.columns})


def add_history(df: DataFrame, columns: list[str] = HISTORY) -> DataFrame:
    return df.withColumns({f"{c}_hist": W.prior_mean(CROP_SERIES, "year", c) for c in columns if c in df.columns})


def encode(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "suitability_score": R.ordinal_score(F.col("suitability")), "is_nino_number": R.flag_number(F.col("is_nino")),
        "has_climate": N.is_present(F.col("rain_year")), "has_price": N.is_present(F.col("price_mean"))})


def feature_store(harvest: DataFrame, towns: DataFrame, climate_years: DataFrame, enso: DataFrame, prices: DataFrame,
                  inputs: DataFrame, suitability: DataFrame) -> DataFrame:
    """Join all yearly tables to the harvest and add lags, history and encodings.

    All three window families share the partitioning by town and crop, so they cost one shuffle.
    """
    joined = (
        harvest.join(towns.select("town_id", "department", "region_id", "lat", "lon"), "town_id")
        .join(climate_years, ["town_id", "year"], "left").join(enso, "year", "left")
        .join(prices, ["crop_id", "year"], "left").join(inputs, "year", "left")
        .join(suitability, ["town_id", "crop_id"], "left")
    )
    return encode(add_history(add_lags(joined)))
