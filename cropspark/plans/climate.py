"""Monthly climate: unification, town and year roll-ups, indices, ENSO, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import dates as D
from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.functions import text as T
from cropspark.operators import conform as C
from cropspark.operators import joins as J
from cropspark.operators import windows as W

STATION_MONTH = ["station_id", "year", "month"]
MEASURES = ["rain_mm", "temp_mean", "temp_max", "temp_min", "humidity", "sun_hours"]


def label_sensor(c):
    return T.ordered_keyword(F.lower(c), K.SENSOR_RULES, None, last_wins=True)


def unify_monthly(rain: DataFrame, readings: DataFrame) -> DataFrame:
    """Rain totals and sensor readings to one row per station and month.

    Rain below 0 counts as 0 and above 3000 as missing; temperature and humidity out of bounds are missing.
    """
    wet = rain.select(*STATION_MONTH, N.clamp_low_null_high(N.clean_number(F.col("total")), 0, 3000).alias("rain_mm"))
    wet = wet.dropna(subset=STATION_MONTH)
    kinds = [label for _, label in K.SENSOR_RULES]
    labelled = readings.withColumn("_kind", label_sensor(F.col("sensor"))).where(F.col("_kind").isNotNull())
    labelled = C.coerce_numeric(labelled, ["mean_value", "max_value", "min_value"])
    wide = labelled.groupBy(*STATION_MONTH).pivot("_kind", kinds).agg(
        F.avg("mean_value").alias("mean"), F.avg("max_value").alias("max"), F.avg("min_value").alias("min"))
    temperature, humidity, sun = "temperatura_media_c", "humedad_relativa_pct", "brillo_solar_horas_dia"
    dry = wide.dropna(subset=STATION_MONTH).select(
        *STATION_MONTH, N.null_outside(F.col(f"{temperature}_mean"), -10, 50).alias("temp_mean"),
        N.null_outside(F.col(f"{temperature}_max"), -10, 50).alias("temp_max"),
        N.null_outside(F.col(f"{temperature}_min"), -10, 50).alias("temp_min"),
        N.null_outside(F.col(f"{humidity}_mean"), 0, 100).alias("humidity"), F.col(f"{sun}_mean").alias("sun_hours"))
    return wet.join(dry, STATION_MONTH, "full_outer")


def daily_to_monthly(daily: DataFrame) -> DataFrame:
    """Daily grid-point weather to months: means, and sunshine from seconds to hours."""
    return daily.groupBy("station_id", F.year("day").alias("year"), F.month("day").alias("month")).agg(
        F.avg("temp_mean").alias("temp_mean"), F.avg("temp_max").alias("temp_max"), F.avg("temp_min").alias("temp_min"),
        F.avg("humidity").alias("humidity"), (F.avg("sunshine_s") / 3600).alias("sun_hours"))


def town_months(climate: DataFrame) -> DataFrame:
    """One row per town and month: stations averaged, extremes kept."""
    return climate.groupBy("town_id", "year", "month").agg(
        F.avg("rain_mm").alias("rain_mm"), F.avg("temp_mean").alias("temp_mean"), F.max("temp_max").alias("temp_max"),
        F.min("temp_min").alias("temp_min"), F.avg("humidity").alias("humidity"), F.avg("sun_hours").alias("sun_hours"))


def town_years(months: DataFrame) -> DataFrame:
    """Annual climate of a town from its months; annual rain only with at least 10 months of data."""
    first_half = F.col("month") <= 6
    return months.groupBy("town_id", "year").agg(
        N.sum_if_enough(F.col("rain_mm"), K.MIN_RAIN_MONTHS).alias("rain_year"),
        F.avg("temp_mean").alias("temp_year"), F.max("temp_max").alias("temp_max_year"),
        F.min("temp_min").alias("temp_min_year"), F.avg("humidity").alias("humidity_year"),
        F.avg("sun_hours").alias("sun_year"), F.stddev_samp("rain_mm").alias("rain_std"),
        F.stddev_samp("temp_mean").alias("temp_std"), N.sum_when(first_half, F.col("rain_mm")).alias("rain_half_a"),
        N.sum_when(~first_half, F.col("rain_mm")).alias("rain_half_b"),
        N.avg_when(first_half, F.col("temp_mean")).alias("temp_half_a"),
        N.avg_when(~first_half, F.col("temp_mean")).alias("temp_half_b"), F.count("rain_mm").alias("rain_months"))


def station_years(climate: DataFrame) -> DataFrame:
    """Annual climate straight from station rows: rain is summed over all stations of the town."""
    return climate.groupBy("town_id", "year").agg(
        F.avg("rain_mm").alias("rain_mean"), F.sum("rain_mm").alias("rain_total"), F.avg("temp_mean").alias("temp_mean"),
        F.avg("temp_max").alias("temp_max"), F.avg("temp_min").alias("temp_min"), F.avg("humidity").alias("humidity"),
        F.avg("sun_hours").alias("sun_hours"))


def production_with_climate(harvest: DataFrame, towns: DataFrame, crops: DataFrame, climate: DataFrame) -> DataFrame:
    """Harvest rows with names and the annual climate of their town."""
    return (harvest.join(towns, "town_id").join(crops, "crop_id")
            .join(station_years(climate), ["town_id", "year"], "left"))


def monitor(climate: DataFrame, stations: DataFrame, towns: DataFrame, enso: DataFrame) -> DataFrame:
    """Monthly station climate with names, calendar and the ENSO row of its region."""
    index = enso.select("year", "month", "region_id", "phase", "spi")
    return (climate.join(stations, "station_id").join(towns, "town_id")
            .join(index, ["year", "month", "region_id"], "left")
            .withColumns({"quarter": F.ceil(F.col("month") / 3).cast("int"), "month_name": D.month_name_es(F.col("month"))}))


def region_rain_indices(climate: DataFrame, towns: DataFrame) -> DataFrame:
    """Region-month mean rain with percent anomaly and standardised anomaly against the same month of other years."""
    located = climate.where(F.col("rain_mm").isNotNull()).join(
        towns.where(F.col("region_id").isNotNull()).select("town_id", "region_id"), "town_id")
    months = located.groupBy("region_id", "year", "month").agg(F.avg("rain_mm").alias("rain_mm"))
    return W.climatology(months, ["region_id", "month"], "rain_mm", K.MIN_CLIMATOLOGY_YEARS)


def nino_years(oni: DataFrame) -> DataFrame:
    """Years with the index at or above the threshold in at least five months. One row per month comes in."""
    warm = F.count_if(F.col("oni") >= K.ENSO_THRESHOLD)
    return oni.groupBy("year").agg(warm.alias("warm_months"), (warm >= K.MIN_NINO_MONTHS).alias("is_nino"))


def enso_facts(oni: DataFrame, regions: DataFrame) -> DataFrame:
    """Monthly index rows for every natural region, with the phase."""
    phased = oni.withColumn("phase", R.enso_phase(F.col("oni")))
    return J.expand_over_table(phased, regions, ["region_id"])


def with_indices(enso: DataFrame, indices: DataFrame) -> DataFrame:
    """Write derived rain indices into the ENSO rows they belong to."""
    derived = indices.where(F.col("z_score").isNotNull() | F.col("anomaly_pct").isNotNull()).select(
        "year", "month", "region_id", F.col("anomaly_pct").alias("rain_anomaly_pct"), F.col("z_score").alias("spi"))
    return enso.join(derived, ["year", "month", "region_id"], "left")


def risk_months(months: DataFrame, towns: DataFrame, enso: DataFrame) -> DataFrame:
    """Town months with index, observed risk (0 to 2), event and period number."""
    index = enso.select("year", "month", "region_id", "oni", "phase", "spi", "rain_anomaly_pct")
    joined = months.join(towns.select("town_id", "region_id"), "town_id").join(index, ["year", "month", "region_id"], "left")
    return joined.withColumns({
        "period": D.month_index(F.col("year"), F.col("month")),
        "risk": R.risk_score(F.col("spi"), F.col("rain_anomaly_pct"), F.col("temp_max"), F.col("phase")),
        "event": R.event_type(F.col("spi"), F.col("rain_anomaly_pct"), F.col("temp_max"), F.col("temp_min"), F.col("humidity")),
    })


def alert_samples(risk: DataFrame) -> DataFrame:
    """Features of a month and as target the risk of the next calendar month; a missing month gives no target."""
    key = ["town_id"]
    return risk.withColumns({
        "target": W.value_at_offset(key, "period", "risk", 1),
        "rain_mm_lag1": W.value_at_offset(key, "period", "rain_mm", -1),
        "rain_anomaly_pct_lag1": W.value_at_offset(key, "period", "rain_anomaly_pct", -1),
        "risk_lag1": W.value_at_offset(key, "period", "risk", -1),
        "month_sin": D.season_sin(F.col("month"), 12.0), "month_cos": D.season_cos(F.col("month"), 12.0),
    })


def anova_units(climate: DataFrame, towns: DataFrame, enso: DataFrame) -> DataFrame:
    """The three named rain comparisons as (comparison, group, rain): by ENSO phase, by quarter, by town.

    Stations of a month are not independent, so months (or town years) are averaged first.
    """
    located = climate.where(F.col("rain_mm").isNotNull()).join(towns.select("town_id", "town", "region_id"), "town_id")
    phased = located.join(enso.select("year", "month", "region_id", "phase"), ["year", "month", "region_id"], "left")
    by_phase = phased.where(F.col("phase").isNotNull()).groupBy("year", "month", "phase").agg(F.avg("rain_mm").alias("rain"))
    by_quarter = located.groupBy("year", "month").agg(F.avg("rain_mm").alias("rain"))
    by_town = located.groupBy("town", "year").agg(F.avg("rain_mm").alias("rain"))
    quarter = F.concat(F.lit("T"), F.ceil(F.col("month") / 3).cast("string"))
    return (by_phase.select(F.lit("phase").alias("comparison"), F.col("phase").alias("level"), "rain")
            .unionByName(by_quarter.select(F.lit("quarter").alias("comparison"), quarter.alias("level"), "rain"))
            .unionByName(by_town.select(F.lit("town").alias("comparison"), F.col("town").alias("level"), "rain")))
