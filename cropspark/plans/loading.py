"""The loads of monthly prices, soil suitability, census and input prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.functions import text as T
from cropspark.operators.loading import Load, Loaded, Reference, add_members, resolve

CENSUS_YEAR = 2014


def load_monthly_prices(rows: DataFrame, months: DataFrame, crops: DataFrame, markets: DataFrame) -> tuple[Loaded, DataFrame]:
    """Monthly market prices (year, month, product, market, city, prices, volume): crops nobody knows yet become members of their dimension, which is
    returned as well; months and markets must be known."""
    named = rows.withColumns({
        "crop_key": F.nullif(T.normalise_text(F.col("product")), F.lit("")), "market": F.trim("market"), "city": F.trim("city"),
        "year": N.clean_number(F.col("year")).cast("int"), "month": N.clean_number(F.col("month")).cast("int")})
    crops = add_members(crops, named, "crop_key", {"crop": F.col("product")}, "crop_id")
    plan = Load(
        ["market_id", "crop_id", "month_id"], ["price_min", "price_max", "price_avg", "volume"], ["crop_key"],
        [Reference("unknown month", months, {"year": "year", "month": "month"}, "month_id"), Reference("unknown crop", crops, {"crop_key": "crop_key"}, "crop_id"),
         Reference("unknown market", markets, {"market": "market", "city": "city"}, "market_id")])
    return resolve(named, plan), crops


def load_soil(rows: DataFrame, crops: DataFrame, towns: DataFrame) -> Loaded:
    """Suitability of towns for crops (town_id, product, suitability text), in the four classes; one row for each town and crop."""
    named = rows.withColumns({"crop_key": F.nullif(T.normalise_text(F.col("product")), F.lit("")), "suitability": R.suitability_class(F.col("suitability"))})
    plan = Load(["town_id", "crop_id"], ["suitability"], ["town_id"],
                [Reference("unknown crop", crops, {"crop_key": "crop_key"}, "crop_id"), Reference("unknown town", towns, {"town_id": "town_id"}, "town_id")])
    return resolve(named, plan)


CENSUS_AREAS = ["pasture_ha", "fallow_ha", "farmed_ha", "built_ha"]


def load_census(rows: DataFrame, towns: DataFrame) -> Loaded:
    """Land use of towns by census year; a year that is missing or no number is the one census there has been."""
    dated = rows.withColumn("census_year", F.coalesce(N.clean_number(F.col("census_year")).cast("int"), F.lit(CENSUS_YEAR)))
    plan = Load(["town_id", "census_year"], CENSUS_AREAS, ["town_id"], [Reference("unknown town", towns, {"town_id": "town_id"}, "town_id")])
    return resolve(dated, plan)


def load_input_prices(rows: DataFrame, months: DataFrame) -> Loaded:
    """Monthly prices of farm inputs by kind, name and region; a missing region is a region of its own."""
    plan = Load(["month_id", "kind", "input_name", "region_id"], ["price"], ["input_name"], [Reference("unknown month", months, {"year": "year", "month": "month"}, "month_id")])
    return resolve(rows, plan)
