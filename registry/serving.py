"""Front-end and operation queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cropspark.operators import ranking as Q
from cropspark.operators import quality as QC
from cropspark.plans import serving as V
from registry import standins as S
from registry.base import CTES, query, table

AS_OF = datetime(2024, 1, 30)


def named_predictions(spark, sf):
    return S.predictions(spark, sf).join(S.towns(spark, sf), "town_id").join(S.crops(spark, sf), "crop_id")


NAMED = "predictions JOIN towns USING (town_id) JOIN crops USING (crop_id)"


@query("prediction_vs_real", {"town": "s", "department": "s", "region": "s", "crop": "s", "year": "i", "real": "f", "predicted": "f",
                              "absolute_error": "f", "low": "f", "high": "f"}, """
SELECT town, department, region, crop, p.year, h.yield_t_ha AS real, predicted, ABS(h.yield_t_ha - predicted) AS absolute_error, low, high
FROM predictions p JOIN towns USING (town_id) JOIN crops USING (crop_id)
LEFT JOIN harvest h ON h.town_id = p.town_id AND h.crop_id = p.crop_id AND h.year = p.year""")
def _(spark, sf):
    return V.prediction_vs_real(S.predictions(spark, sf), S.harvest(spark, sf), S.towns(spark, sf), S.crops(spark, sf))


@query("prediction_lookup", {"town_id": "i", "crop_id": "s", "asked_year": "i", "year": "i", "predicted": "f"}, """
SELECT r.town_id, r.crop_id, r.year AS asked_year, ARG_MAX(p.year, (p.year <= r.year, p.year)) AS year, ARG_MAX(p.predicted, (p.year <= r.year, p.year)) AS predicted
FROM harvest r JOIN predictions p ON p.town_id = r.town_id AND p.crop_id = r.crop_id GROUP BY ALL""")
def _(spark, sf):
    return V.prediction_lookup(S.predictions(spark, sf), S.harvest(spark, sf).select("town_id", "crop_id", "year"))


@query("prediction_answer", {"town_id": "i", "crop_id": "s", "asked_year": "i", "year": "i", "predicted": "f", "real": "f", "risk": "s", "score": "f", "typical_error": "f2", "test_error": "f2"}, """
WITH f AS (SELECT r.town_id, r.crop_id, r.year AS asked_year, ARG_MAX(p.year, (p.year <= r.year, p.year)) AS year, ARG_MAX(p.predicted, (p.year <= r.year, p.year)) AS predicted
  FROM harvest r JOIN predictions p ON p.town_id = r.town_id AND p.crop_id = r.crop_id GROUP BY ALL),
a AS (SELECT town_id, year, ARG_MAX(level, month) AS risk, ARG_MAX(score, month) AS score FROM alerts GROUP BY ALL),
m AS (SELECT ARG_MAX(mae, id_version) AS mae FROM models WHERE model_name = 'click')
SELECT f.*, h.yield_t_ha AS real, risk, score, FLOOR(mae * 100 + 0.5) / 100 AS typical_error, FLOOR(mae / 2 * 100 + 0.5) / 100 AS test_error
FROM f LEFT JOIN harvest h USING (town_id, crop_id, year) LEFT JOIN a USING (town_id, year) CROSS JOIN m""")
def _(spark, sf):
    harvest = S.harvest(spark, sf)
    found = V.prediction_lookup(S.predictions(spark, sf), harvest.select("town_id", "crop_id", "year"))
    return V.prediction_answer(found, harvest, S.alerts(spark, sf), S.models(spark, sf), "click")


@query("search_predictions", {"town": "s", "crop": "s", "year": "i", "predicted": "f"}, f"""
SELECT * FROM {NAMED} WHERE town ILIKE '%brand#2%' OR crop ILIKE '%brand#2%' ORDER BY year DESC, predicted DESC NULLS LAST, town, crop LIMIT 10""")
def _(spark, sf):
    return V.search_predictions(named_predictions(spark, sf), "brand#2")


@query("yield_ranking", {"direction": "s", "town": "s", "department": "s", "mean_predicted": "f", "n": "i"}, f"""
(SELECT 'best' AS direction, town, department, AVG(predicted) AS mean_predicted, COUNT(*) AS n FROM {NAMED} WHERE crop ILIKE '%brand#1%' GROUP BY town, department ORDER BY mean_predicted DESC NULLS LAST, town LIMIT 10)
UNION ALL (SELECT 'worst', town, department, AVG(predicted) AS mean_predicted, COUNT(*) FROM {NAMED} WHERE crop ILIKE '%brand#1%' GROUP BY town, department ORDER BY mean_predicted ASC NULLS LAST, town LIMIT 10)""")
def _(spark, sf):
    rows = named_predictions(spark, sf)
    return Q.union_all([V.yield_ranking(rows, "brand#1", True).withColumn("direction", F.lit("best")),
                        V.yield_ranking(rows, "brand#1", False).withColumn("direction", F.lit("worst"))])


@query("crop_recommendation", {"crop": "s", "mean_predicted": "f", "std_predicted": "f", "n": "i"}, f"""
SELECT crop, AVG(predicted) AS mean_predicted, STDDEV_SAMP(predicted) AS std_predicted, COUNT(*) AS n FROM {NAMED}
WHERE LOWER(town) = 'nation_3' GROUP BY crop ORDER BY mean_predicted DESC NULLS LAST, crop LIMIT 8""")
def _(spark, sf):
    return V.crop_recommendation(named_predictions(spark, sf), "NATION_3")


@query("default_pair", {"town": "s", "crop": "s", "n": "i"}, f"""
SELECT town, crop, COUNT(*) AS n FROM {NAMED} GROUP BY town, crop ORDER BY n DESC, town, crop LIMIT 1""")
def _(spark, sf):
    return V.default_pair(S.predictions(spark, sf), S.towns(spark, sf), S.crops(spark, sf))


@query("neighbours", {"town": "s", "year": "i", "predicted": "f", "level": "s", "real": "f", "vs_real_pct": "f"}, """
SELECT t.town, p.year, p.predicted, a.level, h.yield_t_ha AS real, CASE WHEN h.yield_t_ha <> 0 THEN (p.predicted - h.yield_t_ha) / h.yield_t_ha * 100 END AS vs_real_pct
FROM towns b JOIN towns t ON t.department = b.department AND t.town_id <> b.town_id
JOIN predictions p ON p.town_id = t.town_id AND p.crop_id = 'Brand#12' AND p.year = (SELECT MAX(year) FROM predictions)
LEFT JOIN (SELECT town_id, year, ARG_MAX(level, (score, level)) AS level FROM alerts GROUP BY ALL) a ON a.town_id = p.town_id AND a.year = p.year
LEFT JOIN harvest h ON h.town_id = p.town_id AND h.crop_id = p.crop_id AND h.year = p.year
WHERE LOWER(b.town) = 'nation_2' ORDER BY p.predicted DESC NULLS LAST, t.town LIMIT 6""")
def _(spark, sf):
    return V.neighbours(S.predictions(spark, sf), S.harvest(spark, sf), S.alerts(spark, sf), S.towns(spark, sf), "NATION_2", "Brand#12")


@query("active_alerts", {"town": "s", "department": "s", "region": "s", "year": "i", "month": "i", "level": "s", "event": "s", "score": "f"},
       "SELECT * FROM alerts JOIN towns USING (town_id) WHERE is_active")
def _(spark, sf):
    return V.active_alerts(S.alerts(spark, sf), S.towns(spark, sf))


@query("list_alerts", {"town": "s", "year": "i", "month": "i", "level": "s", "score": "f"}, """
SELECT * FROM alerts JOIN towns USING (town_id) WHERE is_active AND LOWER(level) = 'medio' AND town ILIKE '%nation_1%'
ORDER BY score DESC NULLS LAST, town, year, month LIMIT 20""")
def _(spark, sf):
    return V.list_alerts(S.alerts(spark, sf), S.towns(spark, sf), "medio", "nation_1")


@query("share_of_total", {"event": "s", "total": "i", "pct": "f"}, """
SELECT event, total, FLOOR(total * 1.0::DOUBLE / SUM(total) OVER () * 100 + 0.5) AS pct FROM (
  SELECT COALESCE(event, 'Sin clasificar') AS event, COUNT(*) AS total FROM alerts WHERE is_active GROUP BY event ORDER BY total DESC, event LIMIT 6)""")
def _(spark, sf):
    return V.alerts_by_event(S.alerts(spark, sf))


@query("risk_pivot", {"low": "i", "medium": "i", "high": "i"}, """
SELECT COUNT(*) FILTER (WHERE level = 'BAJO') AS low, COUNT(*) FILTER (WHERE level = 'MEDIO') AS medium, COUNT(*) FILTER (WHERE level = 'ALTO') AS high
FROM alerts WHERE is_active""")
def _(spark, sf):
    return V.risk_levels(S.alerts(spark, sf))


@query("top1_lateral", {"town": "s", "department": "s", "lat": "f", "lon": "f", "level": "s", "score": "f"}, """
SELECT town, department, lat, lon, level, score FROM towns, LATERAL (
  SELECT level, score FROM alerts a WHERE a.town_id = towns.town_id AND a.is_active ORDER BY score DESC NULLS LAST, level DESC LIMIT 1) x
WHERE lat IS NOT NULL AND lon IS NOT NULL ORDER BY score DESC NULLS LAST, town LIMIT 120""")
def _(spark, sf):
    return V.risk_map(S.alerts(spark, sf), S.towns(spark, sf))


@query("top_towns", {"place": "s", "mean_predicted": "f"}, """
SELECT town || ', ' || department AS place, AVG(predicted) AS mean_predicted FROM predictions JOIN towns USING (town_id) GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 6""")
def _(spark, sf):
    return V.top_towns(S.predictions(spark, sf), S.towns(spark, sf))


@query("holdout_series", {"year": "i", "real": "f", "predicted": "f", "n": "i"}, """
SELECT p.year, AVG(h.yield_t_ha) AS real, AVG(predicted) AS predicted, COUNT(*) AS n FROM predictions p
JOIN harvest h ON h.town_id = p.town_id AND h.crop_id = p.crop_id AND h.year = p.year WHERE is_holdout AND h.yield_t_ha IS NOT NULL GROUP BY p.year""")
def _(spark, sf):
    return V.holdout_series(S.predictions(spark, sf), S.harvest(spark, sf))


@query("top_anomalies", {"town": "s", "crop": "s", "year": "i", "predicted": "f", "anomaly_score": "f"}, f"""
SELECT * FROM {NAMED} WHERE is_anomaly ORDER BY anomaly_score DESC NULLS LAST, town, crop, year LIMIT 6""")
def _(spark, sf):
    return V.anomalies(S.predictions(spark, sf), S.towns(spark, sf), S.crops(spark, sf))


@query("impact_kpis", {"towns": "i", "crops": "i", "hectares": "f2", "first_year": "i", "last_year": "i", "active_alerts": "i", "high_alerts": "i",
                       "predictions": "i", "mean_yield": "f", "trained_at": "t"}, """
SELECT * FROM (SELECT COUNT(DISTINCT town_id) AS towns, COUNT(DISTINCT crop_id) AS crops, SUM(sown_ha) AS hectares, MIN(year) AS first_year, MAX(year) AS last_year FROM harvest) h
CROSS JOIN (SELECT COUNT(*) FILTER (WHERE is_active) AS active_alerts, COUNT(*) FILTER (WHERE is_active AND level = 'ALTO') AS high_alerts FROM alerts) a
CROSS JOIN (SELECT COUNT(*) AS predictions, AVG(predicted) AS mean_yield FROM predictions) p CROSS JOIN (SELECT MAX(trained_at) AS trained_at FROM models) m""")
def _(spark, sf):
    return V.impact(S.harvest(spark, sf), S.alerts(spark, sf), S.predictions(spark, sf), S.models(spark, sf))


@query("compare_towns", {"town": "s", "department": "s", "mean_predicted": "f", "crops": "i", "high_alerts": "i"}, """
SELECT town, department, (SELECT AVG(predicted) FROM predictions p WHERE p.town_id = t.town_id) AS mean_predicted,
       (SELECT COUNT(DISTINCT crop_id) FROM predictions p WHERE p.town_id = t.town_id) AS crops,
       (SELECT COUNT(*) FROM alerts a WHERE a.town_id = t.town_id AND a.is_active AND a.level = 'ALTO') AS high_alerts
FROM towns t WHERE LOWER(town) IN ('nation_1', 'nation_7', 'nation_20')""")
def _(spark, sf):
    return V.compare_towns(S.predictions(spark, sf), S.alerts(spark, sf), S.towns(spark, sf), ["NATION_1", "NATION_7", "NATION_20"])


@query("recent_climate", {"town": "s", "year": "i", "month": "i", "rain_mm": "f", "temp_mean": "f"}, """
SELECT town, year, month, AVG(rain_mm) AS rain_mm, AVG(temp_mean) AS temp_mean FROM climate JOIN towns USING (town_id) WHERE town ILIKE '%nation_11%'
GROUP BY ALL ORDER BY year DESC, month DESC, town LIMIT 12""")
def _(spark, sf):
    return V.recent_climate(S.climate(spark, sf), S.towns(spark, sf), "nation_11")


@query("semi_exists", {"kind": "s", "label": "s"}, """
SELECT DISTINCT 'town' AS kind, town || ', ' || department AS label FROM towns t WHERE EXISTS (SELECT 1 FROM harvest h WHERE h.town_id = t.town_id)
UNION ALL SELECT DISTINCT 'crop', crop FROM crops c WHERE EXISTS (SELECT 1 FROM harvest h WHERE h.crop_id = c.crop_id)""")
def _(spark, sf):
    harvest = S.harvest(spark, sf)
    towns = V.towns_with_harvest(S.towns(spark, sf), harvest).select(F.lit("town").alias("kind"), F.col("place").alias("label"))
    crops = V.crops_with_harvest(S.crops(spark, sf), harvest).select(F.lit("crop").alias("kind"), F.col("crop").alias("label"))
    return towns.unionByName(crops)


@query("recommendation", {"town_id": "i", "crop_id": "s", "suitability": "s", "deficit": "f", "high_alerts": "i", "base_yield": "f",
                          "dose_kg_ha": "i", "window_crop": "s", "window_a": "s", "projected": "f"}, """
SELECT x.*, CASE suitability WHEN 'alta' THEN 250 WHEN 'moderada' THEN 320 WHEN 'marginal' THEN 400 ELSE 350 END + CASE WHEN deficit > 0.6 THEN 30 ELSE 0 END AS dose_kg_ha,
       'Maíz' AS window_crop, 'marzo, abril' AS window_a, base_yield + FLOOR(base_yield * (-0.10::DOUBLE + -0.08::DOUBLE) * 100 + 0.5) / 100 AS projected
FROM (SELECT p.town_id, p.crop_id, s.suitability, (SELECT AVG(deficit_probability) FROM enso WHERE year >= 1999) AS deficit,
        (SELECT COUNT(*) FROM alerts a WHERE a.town_id = p.town_id AND is_active AND level = 'ALTO') AS high_alerts, ROUND(AVG(predicted), 2) AS base_yield
      FROM predictions p LEFT JOIN suitability s ON s.town_id = p.town_id AND s.crop_id = p.crop_id GROUP BY ALL) x""")
def _(spark, sf):
    predictions = S.predictions(spark, sf)
    pairs = predictions.select("town_id", "crop_id").distinct().join(S.crops(spark, sf).select("crop_id", "crop"), "crop_id")
    return V.recommendation(pairs, S.suitability(spark, sf), S.enso(spark, sf), S.alerts(spark, sf), predictions, 2001, "El Niño", "Déficit")


# --- operation ----------------------------------------------------------------------------------------
@query("run_state", {"source": "s", "last_status": "s", "last_start": "t", "last_ok": "t", "max_day": "d", "errors_24h": "i"}, """
SELECT source, ARG_MAX(status, (started_at, event_id)) AS last_status, MAX(started_at) AS last_start, MAX(finished_at) FILTER (WHERE status = 'ok') AS last_ok,
       MAX(max_day) FILTER (WHERE status = 'ok') AS max_day,
       COUNT(*) FILTER (WHERE status = 'error' AND started_at > TIMESTAMP '2024-01-29' AND started_at <= TIMESTAMP '2024-01-30') AS errors_24h
FROM runs GROUP BY source""")
def _(spark, sf):
    return V.system_state(S.runs(spark, sf), AS_OF)


CTES["indicator_runs"] = """
SELECT event_type AS indicator, user_id, value, ts AS executed_at, event_id, CASE WHEN value IS NULL THEN 'SIN_DATOS' WHEN value > 20 THEN 'ALERTA' ELSE 'OK' END AS state FROM events"""


def indicator_runs(spark, sf):
    from cropspark.functions import rules as R

    rows = table(spark, sf, "events")
    return rows.select(F.col("event_type").alias("indicator"), "value", F.col("ts").alias("executed_at"), "event_id", R.threshold_state(F.col("value"), F.lit(None).cast("double"), F.lit(20.0)).alias("state"))


@query("latest_indicators", {"indicator": "s", "value": "f", "state": "s", "executed_at": "t"}, """
SELECT indicator, ARG_MAX(value, (executed_at, event_id)) AS value, ARG_MAX(state, (executed_at, event_id)) AS state, MAX(executed_at) AS executed_at FROM indicator_runs GROUP BY indicator""")
def _(spark, sf):
    """The last run of each indicator, with its state."""
    return QC.latest_indicators(indicator_runs(spark, sf).withColumn("executed_at", F.col("executed_at")))


@query("overall_state", {"state": "s", "sources": "i", "failing": "i", "n_ok": "i", "n_alert": "i", "n_without_data": "i", "checked_at": "t", "model": "s", "trained_at": "t"}, """
WITH r AS (SELECT COUNT(*) AS sources, COUNT(*) FILTER (WHERE last = 'error') AS failing FROM (SELECT source, ARG_MAX(status, (started_at, event_id)) AS last FROM runs GROUP BY source)),
i AS (SELECT COUNT(*) FILTER (WHERE s = 'OK') AS n_ok, COUNT(*) FILTER (WHERE s = 'ALERTA') AS n_alert, COUNT(*) FILTER (WHERE s = 'SIN_DATOS') AS n_without_data, MAX(t) AS checked_at
  FROM (SELECT indicator, ARG_MAX(state, (executed_at, event_id)) AS s, MAX(executed_at) AS t FROM indicator_runs GROUP BY indicator)),
m AS (SELECT ARG_MAX(model_name, (trained_at, model_name)) AS model, MAX(trained_at) AS trained_at FROM (SELECT model_name, ARG_MAX(trained_at, id_version) AS trained_at FROM models GROUP BY model_name))
SELECT CASE WHEN failing > 0 THEN 'con_errores' WHEN n_alert > 0 THEN 'con_alertas' WHEN sources > 0 THEN 'ok' ELSE 'sin_datos' END AS state, * FROM r CROSS JOIN i CROSS JOIN m""")
def _(spark, sf):
    sources = V.system_state(S.runs(spark, sf), AS_OF)
    return V.overall_state(sources, QC.latest_indicators(indicator_runs(spark, sf)), S.models(spark, sf))


@query("price_runs_state", {"source": "s", "last_check": "t", "last_ok": "t", "last_change": "t", "errors_24h": "i"}, """
SELECT source, MAX(started_at) AS last_check, MAX(finished_at) FILTER (WHERE status = 'ok') AS last_ok,
       MAX(finished_at) FILTER (WHERE status = 'ok' AND new_rows > 0) AS last_change,
       COUNT(*) FILTER (WHERE status = 'error' AND started_at > TIMESTAMP '2024-01-29') AS errors_24h
FROM runs WHERE source IN ('click', 'view') GROUP BY source""")
def _(spark, sf):
    return V.price_runs_state(S.runs(spark, sf), ["click", "view"], AS_OF)


@query("json_metrics", {"model_name": "s", "id_version": "i", "mae": "f", "test_rmse": "f"}, """
SELECT model_name, MAX(id_version) AS id_version, ARG_MAX(mae, id_version) AS mae, ARG_MAX(mae, id_version) / 2 AS test_rmse FROM models GROUP BY model_name""")
def _(spark, sf):
    return V.model_metrics(S.models(spark, sf))


@query("usage_by_session", {"conv_id": "i", "role": "s", "messages": "i", "over_limit": "b"}, """
SELECT conv_id, role, COUNT(*) AS messages, COUNT(*) > 2 AS over_limit FROM conversations GROUP BY ALL""")
def _(spark, sf):
    return V.usage(table(spark, sf, "conversations"), ["conv_id", "role"], 2)


@query("usage_by_day", {"user_id": "i", "day": "d", "messages": "i", "over_limit": "b"}, """
SELECT user_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, COUNT(*) AS messages, COUNT(*) > 3 AS over_limit FROM events GROUP BY ALL""")
def _(spark, sf):
    from cropspark.functions.dates import local_day

    return V.usage(table(spark, sf, "events").withColumn("day", local_day(F.col("ts"))), ["user_id", "day"], 3)


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("catalogue", {"table_name": "s", "n_rows": "n"}, " UNION ALL ".join([f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in TABLES]) + " UNION ALL SELECT 'absent', NULL")
def _(spark, sf):
    names = {n: table(spark, sf, n) for n in TABLES}
    return V.catalogue(spark, {**names, "absent": None})
