"""Read queries of the front end over predictions, alerts, harvest and logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import collections as FC
from cropspark.functions import dates as D
from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.functions import text as T
from cropspark.operators import aggregate as A
from cropspark.operators import conform as C
from cropspark.operators import joins as J
from cropspark.operators import ranking as Q

PREDICTION_KEY = ["town_id", "crop_id", "year"]


# --- predictions --------------------------------------------------------------------------------------
def prediction_vs_real(predictions: DataFrame, harvest: DataFrame, towns: DataFrame, crops: DataFrame) -> DataFrame:
    real = harvest.select(*PREDICTION_KEY, F.col("yield_t_ha").alias("real"))
    return (predictions.select(*PREDICTION_KEY, "predicted", "low", "high").join(real, PREDICTION_KEY, "left")
            .join(towns, "town_id").join(crops, "crop_id")
            .withColumn("absolute_error", F.abs(F.col("real") - F.col("predicted"))))


def scenario_shift(base: Column, enso: Column, rain: Column) -> Column:
    """Orientation rule: percent of the yield by ENSO phase and rain regime, to two decimals."""
    enso_map = F.create_map(*[F.lit(x) for kv in K.ENSO_YIELD_PCT.items() for x in kv])
    rain_map = F.create_map(*[F.lit(x) for kv in K.RAIN_YIELD_PCT.items() for x in kv])
    pct = F.coalesce(F.try_element_at(enso_map, enso), F.lit(0.0)) + F.coalesce(F.try_element_at(rain_map, rain), F.lit(0.0))
    return N.round_half_up(base * pct, 2)


def scenario_projection(predictions: DataFrame) -> DataFrame:
    """Every prediction under every scenario; bounds move along and never fall below 0."""
    rows = J.expand_over(predictions, list(K.ENSO_YIELD_PCT), "enso")
    rows = J.expand_over(rows, list(K.RAIN_YIELD_PCT), "rain")
    rows = rows.withColumn("shift", scenario_shift(F.col("predicted"), F.col("enso"), F.col("rain")))
    return rows.withColumns({
        "projected": F.col("predicted") + F.col("shift"),
        "projected_low": N.at_least(F.col("low") + F.col("shift"), 0.0), "projected_high": F.col("high") + F.col("shift")})


def prediction_lookup(predictions: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested town, crop and year the latest prediction not after it, else the latest of all.

    Predictions and distinct requests of a pair stand in one sequence of years, which the calendar bounds; no pair is joined. The answered
    year tells whether the fallback was used. Pairs without a prediction give no row.
    """
    answer = F.struct("year", "predicted", "low", "high")
    made = predictions.select("town_id", "crop_id", "year", F.lit(0).alias("side"), answer.alias("p"))
    asked = requests.select("town_id", "crop_id", "year").distinct().select("*", F.lit(1).alias("side"), F.lit(None).cast(made.schema["p"].dataType).alias("p"))
    years = Window.partitionBy("town_id", "crop_id").orderBy("year", "side", "p")
    so_far = F.last("p", ignorenulls=True).over(years.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ever = F.last("p", ignorenulls=True).over(years.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = made.unionByName(asked).withColumn("found", F.coalesce(so_far, ever))
    return both.where((F.col("side") == 1) & F.col("found").isNotNull()).select("town_id", "crop_id", F.col("year").alias("asked_year"), "found.*")


def prediction_answer(found: DataFrame, harvest: DataFrame, alerts: DataFrame, models: DataFrame, yield_model: str) -> DataFrame:
    """The looked-up predictions with what is shown beside them: the real yield of that year, the town's alert (of the year's last month that has one) and
    the typical error of the active yield model. All but the prediction may be missing."""
    real = harvest.select(*PREDICTION_KEY, F.col("yield_t_ha").alias("real"))
    last = alerts.groupBy("town_id", "year").agg(F.max_by(F.struct("level", "score"), "month").alias("_a"))
    error = model_metrics(models.where(F.col("model_name") == yield_model)).select(F.struct("mae", "test_rmse").alias("_m")).scalar()  # one row: the active version
    joined = found.join(real, PREDICTION_KEY, "left").join(last, ["town_id", "year"], "left")
    return joined.withColumn("_m", error).select(
        *found.columns, "real", F.col("_a.level").alias("risk"), F.col("_a.score").alias("score"), N.round_half_up(F.col("_m.mae"), 2).alias("typical_error"),
        N.round_half_up(F.col("_m.test_rmse"), 2).alias("test_error"))


def search_predictions(named: DataFrame, wanted: str, k: int = 10) -> DataFrame:
    found = C.conjunction(named, contains_any=(["town", "crop"], wanted))
    return Q.top_rows(found, [F.col("year").desc(), F.col("predicted").desc_nulls_last(), F.col("town"), F.col("crop")], k)


def yield_ranking(named: DataFrame, crop: str | None, descending: bool, k: int = 10) -> DataFrame:
    rows = C.conjunction(named, contains_any=(["crop"], crop or ""))
    means = rows.groupBy("town", "department").agg(F.avg("predicted").alias("mean_predicted"), F.count(F.lit(1)).alias("n"))
    return Q.top_rows(means, [Q.directed("mean_predicted", descending), F.col("town")], k)


def crop_recommendation(named: DataFrame, town: str, k: int = 8) -> DataFrame:
    rows = C.conjunction(named, equal_ci={"town": town})
    stats = rows.groupBy("crop").agg(F.avg("predicted").alias("mean_predicted"), F.stddev_samp("predicted").alias("std_predicted"),
                                     F.count(F.lit(1)).alias("n"))
    return Q.top_rows(stats, [F.col("mean_predicted").desc_nulls_last(), F.col("crop")], k)


def default_pair(predictions: DataFrame, towns: DataFrame, crops: DataFrame) -> DataFrame:
    """The town and crop with most predictions."""
    counts = predictions.groupBy("town_id", "crop_id").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(towns, "town_id").join(crops, "crop_id")
    return Q.top_rows(named, [F.col("n").desc(), F.col("town"), F.col("crop")], 1).select("town", "crop", "n")


def neighbours(predictions: DataFrame, harvest: DataFrame, alerts: DataFrame, towns: DataFrame, town: str, crop_id: str,
               year: int | None = None, k: int = 6) -> DataFrame:
    """Other towns of the same department with a prediction for the crop and year (default: the latest year)."""
    home = towns.where(F.lower("town") == town.lower()).select("department", F.col("town_id").alias("home_id"))
    nearby = towns.join(home, "department").where(F.col("town_id") != F.col("home_id"))
    wanted = F.lit(year) if year else predictions.agg(F.max("year")).scalar()
    rows = predictions.where((F.col("crop_id") == crop_id) & (F.col("year") == wanted)).join(nearby, "town_id")
    worst = alerts.groupBy("town_id", "year").agg(F.max_by("level", F.struct("score", "level")).alias("level"))
    rows = rows.join(worst, ["town_id", "year"], "left").join(
        harvest.select(*PREDICTION_KEY, F.col("yield_t_ha").alias("real")), PREDICTION_KEY, "left")
    rows = rows.withColumn("vs_real_pct", F.when(F.col("real") != 0, (F.col("predicted") - F.col("real")) / F.col("real") * 100))
    return Q.top_rows(rows, [F.col("predicted").desc_nulls_last(), F.col("town")], k)


# --- alerts -------------------------------------------------------------------------------------------
def active_alerts(alerts: DataFrame, towns: DataFrame) -> DataFrame:
    return alerts.where("is_active").join(towns, "town_id")


def list_alerts(alerts: DataFrame, towns: DataFrame, level: str | None = None, town: str | None = None, k: int = 20) -> DataFrame:
    rows = C.conjunction(active_alerts(alerts, towns), equal_ci={"level": level}, contains_any=(["town"], town or ""))
    return Q.top_rows(rows, [F.col("score").desc_nulls_last(), F.col("town"), F.col("year"), F.col("month")], k)


def alerts_by_event(alerts: DataFrame, k: int = 6) -> DataFrame:
    """Most frequent events of active alerts and their share of those listed."""
    counts = alerts.where("is_active").groupBy(F.coalesce("event", F.lit("Sin clasificar")).alias("event")).agg(
        F.count(F.lit(1)).alias("total"))
    return A.share_of_total(Q.top_rows(counts, [F.col("total").desc(), F.col("event")], k), "total", "pct")


def risk_levels(alerts: DataFrame) -> DataFrame:
    return A.counts_by_level(alerts.where("is_active"), "level", {"low": "BAJO", "medium": "MEDIO", "high": "ALTO"})


def risk_map(alerts: DataFrame, towns: DataFrame, k: int = 120) -> DataFrame:
    """Top active alert per town that has coordinates, worst first."""
    top = alerts.where("is_active").groupBy("town_id").agg(
        F.max_by(F.struct("level", "score"), F.struct("score", "level")).alias("a"))
    rows = towns.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).join(top, "town_id").select(
        "town", "department", "lat", "lon", "a.level", "a.score")
    return Q.top_rows(rows, [F.col("score").desc_nulls_last(), F.col("town")], k)


# --- dashboards ---------------------------------------------------------------------------------------
def top_towns(predictions: DataFrame, towns: DataFrame, k: int = 6) -> DataFrame:
    """Averages per town id before the names are joined, so only one row per town shuffles."""
    partial = predictions.groupBy("town_id").agg(F.sum("predicted").alias("s"), F.count("predicted").alias("n"))
    named = partial.join(towns, "town_id").groupBy(F.concat_ws(", ", "town", "department").alias("place")).agg(
        (F.sum("s") / F.sum("n")).alias("mean_predicted"))
    return Q.top_rows(named, [F.col("mean_predicted").desc_nulls_last(), F.col("place")], k)


def holdout_series(predictions: DataFrame, harvest: DataFrame) -> DataFrame:
    """Real and predicted means per year over the same hold-out rows."""
    real = harvest.where(F.col("yield_t_ha").isNotNull()).select(*PREDICTION_KEY, F.col("yield_t_ha").alias("real"))
    return predictions.where("is_holdout").select(*PREDICTION_KEY, "predicted").join(real, PREDICTION_KEY).groupBy("year").agg(
        F.avg("real").alias("real"), F.avg("predicted").alias("predicted"), F.count(F.lit(1)).alias("n"))


def anomalies(predictions: DataFrame, towns: DataFrame, crops: DataFrame, k: int = 6) -> DataFrame:
    rows = predictions.where("is_anomaly").join(towns, "town_id").join(crops, "crop_id")
    return Q.top_rows(rows, [F.col("anomaly_score").desc_nulls_last(), F.col("town"), F.col("crop"), F.col("year")], k)


def impact(harvest: DataFrame, alerts: DataFrame, predictions: DataFrame, models: DataFrame) -> DataFrame:
    """Headline figures: one aggregate per table instead of one query per figure."""
    h = harvest.agg(F.struct(
        F.count_distinct("town_id").alias("towns"), F.count_distinct("crop_id").alias("crops"),
        F.coalesce(F.sum("sown_ha"), F.lit(0.0)).alias("hectares"), F.min("year").alias("first_year"), F.max("year").alias("last_year")))
    a = alerts.agg(F.struct(F.count_if("is_active").alias("active_alerts"),
                            F.count_if(F.col("is_active") & (F.col("level") == "ALTO")).alias("high_alerts")))
    p = predictions.agg(F.struct(F.count(F.lit(1)).alias("predictions"), F.avg("predicted").alias("mean_yield")))
    m = models.agg(F.struct(F.max("trained_at").alias("trained_at")))
    one = harvest.sparkSession.range(1)
    return one.select(h.scalar().alias("h"), a.scalar().alias("a"), p.scalar().alias("p"), m.scalar().alias("m")).select(
        "h.*", "a.*", "p.*", "m.*")


def compare_towns(predictions: DataFrame, alerts: DataFrame, towns: DataFrame, names: list[str]) -> DataFrame:
    """Two to five towns side by side. Each table is aggregated before the join, so rows cannot multiply."""
    if not 2 <= len(names) <= 5:
        raise ValueError("compare 2 to 5 towns")
    chosen = towns.where(F.lower("town").isin(*[n.lower() for n in names])).select("town_id", "town", "department")
    yields = predictions.join(chosen.select("town_id"), "town_id", "left_semi").groupBy("town_id").agg(
        F.avg("predicted").alias("mean_predicted"), F.count_distinct("crop_id").alias("crops"))
    high = alerts.where(F.col("is_active") & (F.col("level") == "ALTO")).groupBy("town_id").agg(F.count(F.lit(1)).alias("high_alerts"))
    return chosen.join(yields, "town_id", "left").join(high, "town_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("crops", "high_alerts")})


def recent_climate(climate: DataFrame, towns: DataFrame, town: str, k: int = 12) -> DataFrame:
    rows = climate.join(C.conjunction(towns, contains_any=(["town"], town)), "town_id")
    months = rows.groupBy("town", "year", "month").agg(F.avg("rain_mm").alias("rain_mm"), F.avg("temp_mean").alias("temp_mean"))
    return Q.top_rows(months, [F.col("year").desc(), F.col("month").desc(), F.col("town")], k)


def towns_with_harvest(towns: DataFrame, harvest: DataFrame) -> DataFrame:
    """Distinct 'town, department' labels of towns that have a harvest."""
    return towns.join(harvest.select("town_id").distinct(), "town_id", "left_semi").select(
        F.concat_ws(", ", "town", "department").alias("place")).distinct()


def crops_with_harvest(crops: DataFrame, harvest: DataFrame) -> DataFrame:
    return crops.join(harvest.select("crop_id").distinct(), "crop_id", "left_semi").select("crop").distinct()


def recommendation(pairs: DataFrame, suitability: DataFrame, enso: DataFrame, alerts: DataFrame, predictions: DataFrame,
                   as_of_year: int, enso_phase: str = K.ENSO_NEUTRAL, rain: str = "Normal") -> DataFrame:
    """Facts and rule-based advice for each (town_id, crop_id, crop): soil class, mean deficit probability of the last two
    years, high alerts, base yield, dose, sowing window and projected yield."""
    deficit = enso.where(F.col("year") >= as_of_year - 2).agg(F.avg("deficit_probability")).scalar()
    high = alerts.where(F.col("is_active") & (F.col("level") == "ALTO")).groupBy("town_id").agg(F.count(F.lit(1)).alias("high_alerts"))
    base = predictions.groupBy("town_id", "crop_id").agg(N.round_half_away(F.avg("predicted"), 2).alias("base_yield"))
    rows = (pairs.join(suitability, ["town_id", "crop_id"], "left").join(high, "town_id", "left")
            .join(base, ["town_id", "crop_id"], "left").withColumn("deficit", deficit))
    window = T.ordered_keyword(F.col("crop"), [(c, c) for c in K.SOWING_WINDOWS], K.DEFAULT_WINDOW_CROP)
    first = F.create_map(*[F.lit(x) for c, w in K.SOWING_WINDOWS.items() for x in (c, w[0])])
    second = F.create_map(*[F.lit(x) for c, w in K.SOWING_WINDOWS.items() for x in (c, w[1])])
    return rows.withColumns({
        "high_alerts": F.coalesce("high_alerts", F.lit(0)), "dose_kg_ha": R.fertiliser_dose(F.col("suitability"), F.col("deficit")),
        "window_crop": window, "window_a": F.element_at(first, window), "window_b": F.element_at(second, window),
        "adjustment": F.lit(K.SOWING_ADJUSTMENT.get(enso_phase, K.SOWING_ADJUSTMENT[K.ENSO_NEUTRAL])),
        "projected": F.col("base_yield") + scenario_shift(F.col("base_yield"), F.lit(enso_phase), F.lit(rain))})


# --- operation ----------------------------------------------------------------------------------------
def system_state(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Per source: last state and time, last good run, newest data day, errors of the last 24 hours. One aggregate."""
    ok = F.col("status") == "ok"
    recent = (F.col("status") == "error") & (F.col("started_at") > D.moment(as_of) - F.expr("INTERVAL 24 HOURS")) & (F.col("started_at") <= D.moment(as_of))
    return runs.where(~F.col("source").startswith("notice:")).groupBy("source").agg(
        F.max_by("status", F.struct("started_at", "event_id")).alias("last_status"), F.max("started_at").alias("last_start"),
        F.max(F.when(ok, F.col("finished_at"))).alias("last_ok"), F.max(F.when(ok, F.col("max_day"))).alias("max_day"),
        F.count_if(recent).alias("errors_24h"))


def overall_state(sources: DataFrame, indicators: DataFrame, models: DataFrame) -> DataFrame:
    """One row: ``con_errores`` if the last run of a source failed, else ``con_alertas`` if an indicator's last run is out of its range, else ``ok``, or
    ``sin_datos`` without any source; how many indicators are in each state, when they ran, and the model trained last."""
    runs = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("last_status") == "error").alias("failing"))
    last = indicators.agg(
        *[F.count_if(F.col("state") == v).alias(n) for v, n in (("OK", "n_ok"), ("ALERTA", "n_alert"), ("SIN_DATOS", "n_without_data"))], F.max("executed_at").alias("checked_at"))
    model = Q.latest_per_key(models, ["model_name"], ["id_version"]).agg(F.max_by("model_name", F.struct("trained_at", "model_name")).alias("model"), F.max("trained_at").alias("trained_at"))
    row = runs.withColumns({"_i": last.select(F.struct(*last.columns)).scalar(), "_m": model.select(F.struct(*model.columns)).scalar()}).select("sources", "failing", "_i.*", "_m.*")
    state = F.when(F.col("failing") > 0, "con_errores").when(F.col("n_alert") > 0, "con_alertas").when(F.col("sources") > 0, "ok").otherwise("sin_datos")
    return row.withColumn("state", state)


def price_runs_state(runs: DataFrame, feeds: list[str], as_of: datetime) -> DataFrame:
    """Per feed: last check, last good load, last load that changed rows, errors of the last 24 hours."""
    ok = F.col("status") == "ok"
    recent = (F.col("status") == "error") & (F.col("started_at") > D.moment(as_of) - F.expr("INTERVAL 24 HOURS"))
    return runs.where(F.col("source").isin(*feeds)).groupBy("source").agg(
        F.max("started_at").alias("last_check"), F.max(F.when(ok, F.col("finished_at"))).alias("last_ok"),
        F.max(F.when(ok & (F.col("new_rows") > 0), F.col("finished_at"))).alias("last_change"),
        F.count_if(recent).alias("errors_24h"))


def model_metrics(models: DataFrame) -> DataFrame:
    """Metrics of the active version per model, read out of the JSON document."""
    active = Q.latest_per_key(models, ["model_name"], ["id_version"])
    return active.withColumns({
        "mae": FC.json_number(F.col("metrics_json"), "$.mae"), "test_rmse": FC.json_number(F.col("metrics_json"), "$.test.rmse")})


def usage(messages: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Messages per key with a flag where the limit is passed."""
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("messages"), (F.count(F.lit(1)) > limit).alias("over_limit"))


def catalogue(spark, names: dict[str, DataFrame | None]) -> DataFrame:
    """Row counts of named tables; an absent one is missing, not 0."""
    parts = []
    for name, df in names.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(None).cast("long").alias("n_rows")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows"))
    return Q.union_all(parts)
