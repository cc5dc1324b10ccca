"""Forecast panel, folds, intervals, models and streaming."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from cropspark.functions import collections as FC
from cropspark.models import alerts as AL
from cropspark.models import anomalies as AN
from cropspark.models import folds as FO
from cropspark.models import price_forecast as PF
from cropspark.models import seasonal as SE
from cropspark.models import trees as TR
from cropspark.models import yield_model as YM
from cropspark.operators import aggregate as A
from cropspark.operators import merge as M
from cropspark.plans import climate as CL
from cropspark.plans import prices as P
from cropspark.session import shared_dir
from cropspark.streaming import ingest as IN
from registry import standins as S
from registry.base import CTES, query, table
from registry.climate import feature_store

# --- forecast panel -----------------------------------------------------------------------------------
CTES["weekday_prices"] = """
SELECT market_id, product_id, day, LN(price_avg) AS log_price FROM panel_daily WHERE ISODOW(day) < 6 AND price_avg > 0
QUALIFY COUNT(*) OVER (PARTITION BY market_id, product_id) >= 180"""
CTES["business_spine"] = """
SELECT d AS day, ROW_NUMBER() OVER (ORDER BY d) - 1 AS pos, COUNT(*) OVER () AS len FROM (
  SELECT CAST(UNNEST(GENERATE_SERIES(CAST(MIN(day) AS TIMESTAMP), CAST(MAX(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM weekday_prices) WHERE ISODOW(d) < 6"""
CTES["filled_panel"] = """
SELECT s.market_id, s.product_id, b.day, b.pos, b.len, LAST_VALUE(w.log_price IGNORE NULLS) OVER (PARTITION BY s.market_id, s.product_id ORDER BY b.pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS log_price,
       w.log_price IS NULL AS is_filled
FROM (SELECT DISTINCT market_id, product_id FROM weekday_prices) s CROSS JOIN business_spine b
LEFT JOIN weekday_prices w ON w.market_id = s.market_id AND w.product_id = s.product_id AND w.day = b.day"""
CTES["panel_diffs"] = """
SELECT *, log_price - LAG(log_price, 1) OVER w AS r1, log_price - LAG(log_price, 5) OVER w AS r5, log_price - LAG(log_price, 20) OVER w AS r20 FROM filled_panel
WINDOW w AS (PARTITION BY market_id, product_id ORDER BY pos)"""


@query("ffill_spine", {"market_id": "i", "product_id": "s", "day": "d", "log_price": "f", "is_filled": "b"},
       "SELECT * FROM filled_panel WHERE log_price IS NOT NULL")
def _(spark, sf):
    from cropspark.functions.dates import business_date

    return PF.panel(S.panel_daily(spark, sf)).withColumn("day", business_date(F.col("idx")))


@query("rolling_features", {"market_id": "i", "product_id": "s", "pos": "i", "r1": "f", "r5": "f", "r20": "f", "vol5": "f", "vol20": "f", "dev20": "f", "dev90": "f",
                            "prod_r5": "f"}, """
SELECT * FROM (
  SELECT market_id, product_id, pos, log_price, r1, r5, r20,
    CASE WHEN COUNT(r1) OVER w5 >= 3 THEN STDDEV_SAMP(r1) OVER w5 END AS vol5, CASE WHEN COUNT(r1) OVER w20 >= 10 THEN STDDEV_SAMP(r1) OVER w20 END AS vol20,
    CASE WHEN COUNT(log_price) OVER w20 >= 10 THEN log_price - AVG(log_price) OVER w20 END AS dev20,
    CASE WHEN COUNT(log_price) OVER w90 >= 30 THEN log_price - AVG(log_price) OVER w90 END AS dev90, AVG(r5) OVER (PARTITION BY product_id, pos) AS prod_r5
  FROM panel_diffs
  WINDOW w5 AS (PARTITION BY market_id, product_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY market_id, product_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         w90 AS (PARTITION BY market_id, product_id ORDER BY pos ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) WHERE log_price IS NOT NULL""")
def _(spark, sf):
    return PF.features(PF.panel(S.panel_daily(spark, sf))).withColumn("pos", F.col("idx") - F.col("panel_start"))


@query("lead_targets", {"market_id": "i", "product_id": "s", "pos": "i", "h": "i", "y": "f", "target_day": "d"}, """
SELECT f.market_id, f.product_id, f.pos, v.h, t.log_price - f.log_price AS y, f.day + CAST(v.h + 2 * ((ISODOW(f.day) - 1 + v.h) // 5) AS INTEGER) AS target_day
FROM filled_panel f CROSS JOIN (SELECT UNNEST(RANGE(1, 11)) AS h) v
LEFT JOIN filled_panel t ON t.market_id = f.market_id AND t.product_id = f.product_id AND t.pos = f.pos + v.h WHERE f.log_price IS NOT NULL""")
def _(spark, sf):
    return PF.lead_targets(PF.panel(S.panel_daily(spark, sf))).withColumn("pos", F.col("idx") - F.col("panel_start"))


@query("backtest_folds", {"fold": "i", "n_train": "i", "n_test": "i", "last_target": "i"}, """
SELECT fold, COUNT(*) FILTER (WHERE f.pos >= st AND (f.pos - st) % 2 = 0 AND f.pos + h <= cut) AS n_train, COUNT(*) FILTER (WHERE f.pos > cut AND f.pos <= cut + 20) AS n_test,
       MAX(f.pos + h) FILTER (WHERE f.pos >= st AND (f.pos - st) % 2 = 0 AND f.pos + h <= cut) AS last_target
FROM (SELECT f.pos, v.h, GREATEST(20, f.len - 750) AS st, f.len FROM filled_panel f CROSS JOIN (SELECT UNNEST(RANGE(1, 11)) AS h) v
      JOIN filled_panel t ON t.market_id = f.market_id AND t.product_id = f.product_id AND t.pos = f.pos + v.h
      WHERE f.log_price IS NOT NULL AND t.log_price IS NOT NULL) f
CROSS JOIN LATERAL (SELECT UNNEST([0, 1, 2, 3]) AS fold) k CROSS JOIN LATERAL (SELECT f.len - 80 + fold * 20 - 1 AS cut) c GROUP BY fold""")
def _(spark, sf):
    samples = PF.lead_targets(PF.panel(S.panel_daily(spark, sf))).withColumn("pos", F.col("idx") - F.col("panel_start"))
    known = samples.where(F.col("y").isNotNull())
    train_rows = PF.training_rows(known).withColumn("is_train", F.lit(True))
    flagged = known.join(train_rows.select("market_id", "product_id", "idx", "h", "is_train"), ["market_id", "product_id", "idx", "h"], "left")
    aggregates = []
    for fold in range(4):
        train_if, test_if = PF.fold_of(fold)
        train = F.coalesce(F.col("is_train"), F.lit(False)) & train_if
        aggregates.append(F.struct(F.lit(fold).alias("fold"), F.count_if(train).alias("n_train"), F.count_if(test_if).alias("n_test"),
                                   F.max(F.when(train, F.col("pos") + F.col("h"))).alias("last_target")))
    return flagged.agg(F.array(*aggregates).alias("a")).select(F.explode("a").alias("r")).select("r.*")


# --- folds and intervals ------------------------------------------------------------------------------
@query("year_folds", {"validation_year": "i", "n_train": "i", "n_validation": "i"}, """
SELECT v.year AS validation_year, (SELECT COUNT(*) FROM harvest h WHERE h.year < v.year) AS n_train, (SELECT COUNT(*) FROM harvest h WHERE h.year = v.year) AS n_validation
FROM (SELECT year FROM (SELECT DISTINCT year FROM harvest) WHERE year > (SELECT MIN(year) + 2 FROM harvest) ORDER BY year DESC LIMIT 3) v""")
def _(spark, sf):
    harvest = S.harvest(spark, sf)
    return FO.fold_sizes(harvest, FO.year_folds(FO.distinct_years(harvest)))


@query("baseline", {"town_id": "i", "crop_id": "s", "year": "i", "baseline": "f"}, """
SELECT town_id, crop_id, year, COALESCE(hist, (SELECT AVG(yield_t_ha) FROM harvest x WHERE x.year < 2000 AND x.crop_id = h.crop_id)) AS baseline
FROM (SELECT *, AVG(yield_t_ha) OVER (PARTITION BY town_id, crop_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM harvest) h""")
def _(spark, sf):
    from cropspark.plans.features import add_history

    store = add_history(S.harvest(spark, sf))
    return FO.with_baseline(store, F.col("year") < 2000, "yield_t_ha", "yield_t_ha_hist", "crop_id")


@query("oof_intervals", {"town_id": "i", "crop_id": "s", "year": "i", "lo": "f", "hi": "f"}, """
WITH oof AS (SELECT town_id, crop_id, year, yield_t_ha AS y, predicted AS yhat, yield_t_ha - predicted AS res FROM predictions),
years AS (SELECT DISTINCT year FROM oof),
o AS (SELECT v.year, QUANTILE_CONT(res, 0.1) AS l, QUANTILE_CONT(res, 0.9) AS h FROM years v JOIN oof x ON x.year <> v.year AND x.year <> 2001 GROUP BY v.year),
c AS (SELECT v.year, crop_id, QUANTILE_CONT(res, 0.1) AS l, QUANTILE_CONT(res, 0.9) AS h FROM years v JOIN oof x ON x.year <> v.year AND x.year <> 2001 GROUP BY v.year, crop_id HAVING COUNT(*) >= 30)
SELECT oof.town_id, oof.crop_id, oof.year, GREATEST(yhat + COALESCE(c.l, o.l), 0) AS lo, yhat + COALESCE(c.h, o.h) AS hi
FROM oof JOIN o ON o.year = oof.year LEFT JOIN c ON c.year = oof.year AND c.crop_id = oof.crop_id""")
def _(spark, sf):
    oof = S.predictions(spark, sf).select(
        "town_id", "crop_id", "year", F.col("yield_t_ha").alias("y"), F.col("predicted").alias("yhat"))
    return FO.calibrated_intervals(oof, 2001, FO.distinct_years(oof))


CTES["pairs_test"] = """
SELECT r.risk AS r, n.risk AS y FROM risk r JOIN risk n ON n.town_id = r.town_id AND n.period = r.period + 1
WHERE r.period >= (SELECT MAX(a.period) - 5 FROM risk a JOIN risk b ON b.town_id = a.town_id AND b.period = a.period + 1)"""


@query("persistence_metrics", {"f1_weighted": "f", "accuracy": "f", "n": "i", "side": "s"}, """
SELECT f1_weighted, accuracy, n, side FROM (
  SELECT 'test' AS side, COUNT(*) AS n, AVG(CASE WHEN y = r THEN 1.0 ELSE 0 END) AS accuracy,
    (SELECT SUM(f1 * s) / SUM(s) FROM (SELECT k, (SELECT COUNT(*) FROM pairs_test WHERE y = k) AS s,
      COALESCE(2.0::DOUBLE * (SELECT COUNT(*) FROM pairs_test WHERE y = k AND r = k) / NULLIF((SELECT COUNT(*) FROM pairs_test WHERE y = k) + (SELECT COUNT(*) FROM pairs_test WHERE r = k), 0), 0) AS f1 FROM (VALUES (0), (1), (2)) v(k))) AS f1_weighted
  FROM pairs_test)""")
def _(spark, sf):
    from cropspark.session import materialise

    _, test = AL.time_split(materialise(CL.alert_samples(S.risk(spark, sf))))
    return A.classification_metrics(test, "target", "risk").withColumn("side", F.lit("test"))


# --- models (no SQL counterpart) ----------------------------------------------------------------------
#: Candidates of the yield model, judged by the mean error of the year folds.
YIELD_GRID = [{"maxDepth": 3}, {"maxDepth": 5}]


@query("permutation_importance", {"feature": "s", "importance": "f"}, """
WITH p AS (SELECT town_id, crop_id, year, yield_t_ha AS y, sown_ha, harvested_ha, production_t,
    LEAD(ROW(sown_ha, harvested_ha, production_t)) OVER w AS n, FIRST_VALUE(ROW(sown_ha, harvested_ha, production_t)) OVER w AS f
  FROM harvest WHERE harvested_ha > 0 WINDOW w AS (ORDER BY MD5('42|' || town_id || '|' || crop_id || '|' || year), town_id, crop_id, year)),
v AS (SELECT *, COALESCE(n, f) AS d FROM p),
e AS (SELECT AVG(ABS(y - production_t / harvested_ha)) AS base, AVG(ABS(y - production_t / d[2])) AS h, AVG(ABS(y - d[3] / harvested_ha)) AS q FROM v)
SELECT 'sown_ha' AS feature, 0.0::DOUBLE AS importance UNION ALL SELECT 'harvested_ha', h - base FROM e UNION ALL SELECT 'production_t', q - base FROM e""")
def _(spark, sf):
    """Importance under a prediction that SQL can state: the yield from production and area; the sown area plays no part in it."""
    rows = S.harvest(spark, sf).where("harvested_ha > 0")
    predict = lambda d: d.withColumn("yhat", F.col("production_t") / F.col("harvested_ha"))
    return TR.permutation_importance(rows, ["sown_ha", "harvested_ha", "production_t"], ["town_id", "crop_id", "year"], predict, "yield_t_ha", "yhat")


@query("yield_model", {"model": "s", "mae": "f", "rmse": "f", "r2": "f", "n": "i", "coverage": "f", "chosen_depth": "i", "place": "i", "feature": "s", "importance": "f"})
def _(spark, sf):
    """Metrics of model and baseline, the chosen candidate and, for the model, the ten features that count most."""
    report = YM.train_and_evaluate(feature_store(spark, sf), YIELD_GRID)
    scores = report.metrics.withColumns({"coverage": report.coverage.select("coverage").scalar(), "chosen_depth": F.lit(report.params["maxDepth"])})
    return scores.join(report.importances.withColumn("model", F.lit("trees")), "model", "left")


@query("alert_model", {"town_id": "i", "year": "i", "month": "i", "level": "s", "event": "s", "is_active": "b", "description": "s", "accuracy": "f", "persistence": "f"})
def _(spark, sf):
    """Alerts with the accuracy of the forest and of persistence on the test months."""
    rows, metrics = AL.train_and_evaluate(CL.alert_samples(S.risk(spark, sf)))
    accuracy = {r.model: r.accuracy for r in metrics.collect()}
    return rows.withColumns({"accuracy": F.lit(accuracy.get("forest")).cast("double"), "persistence": F.lit(accuracy["persistence"])})


@query("price_forecast", {"market_id": "i", "product_id": "s", "target_day": "d", "h": "i", "price": "f", "p10": "f", "p90": "f", "method": "s", "confidence": "s"})
def _(spark, sf):
    samples = PF.prepare(S.panel_daily(spark, sf))
    return PF.predict(samples, PF.backtest(samples))


# One row for each month of a town and measure, from the first to the last that is known, gaps on the straight line between their neighbours.
CTES["seasonal_months"] = """
WITH m AS (SELECT town_id, 'rain_mm' AS measure, year * 12 + month AS period, rain_mm AS v FROM town_month UNION ALL SELECT town_id, 'temp_mean', year * 12 + month, temp_mean FROM town_month),
k AS (SELECT * FROM m WHERE v IS NOT NULL),
spine AS (SELECT s.town_id, s.measure, UNNEST(GENERATE_SERIES(first, last)) AS period FROM (SELECT town_id, measure, MAX(period) AS last FROM m GROUP BY ALL) s
  JOIN (SELECT town_id, measure, MIN(period) AS first, COUNT(*) AS n FROM k GROUP BY ALL) f ON f.town_id = s.town_id AND f.measure = s.measure WHERE n >= 24),
e AS (SELECT s.*, k.v, LAST_VALUE(k.v IGNORE NULLS) OVER w AS a, LAST_VALUE(k.period IGNORE NULLS) OVER w AS pa, FIRST_VALUE(k.v IGNORE NULLS) OVER u AS b, FIRST_VALUE(k.period IGNORE NULLS) OVER u AS pb
  FROM spine s LEFT JOIN k ON k.town_id = s.town_id AND k.measure = s.measure AND k.period = s.period
  WINDOW w AS (PARTITION BY s.town_id, s.measure ORDER BY s.period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY s.town_id, s.measure ORDER BY s.period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT town_id, measure, period, ROW_NUMBER() OVER (PARTITION BY town_id, measure ORDER BY period) - 1 AS t, CASE WHEN pb = pa OR pb IS NULL THEN a ELSE a + (b - a) / (pb - pa) * (period - pa) END AS y FROM e"""


@query("seasonal_recursion", {"town_id": "i", "measure": "s", "year": "i", "month": "i", "horizon": "i", "value": "f3", "sse": "f2"}, """
WITH RECURSIVE r AS (
  SELECT town_id, measure, 11 AS t, AVG(y) FILTER (WHERE t < 12) AS level, (AVG(y) FILTER (WHERE t >= 12) - AVG(y) FILTER (WHERE t < 12)) / 12 AS trend,
    [x - AVG(y) FILTER (WHERE t < 12) FOR x IN LIST(y ORDER BY t) FILTER (WHERE t < 12)] AS season, 0.0::DOUBLE AS sse
  FROM seasonal_months WHERE t < 24 GROUP BY town_id, measure
  UNION ALL
  SELECT town_id, measure, t, l2, 0.1 * (l2 - level) + 0.9 * trend, LIST_CONCAT(season[2:], [0.25 * (y - l2) + 0.75 * s]), sse + POW(y - level - trend - s, 2)
  FROM (SELECT m.town_id, m.measure, m.t, m.y, level, trend, season, sse, season[1] AS s, 0.5 * (m.y - season[1]) + 0.5 * (level + trend) AS l2
        FROM r JOIN seasonal_months m ON m.town_id = r.town_id AND m.measure = r.measure AND m.t = r.t + 1)),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY town_id, measure ORDER BY t DESC) AS rn FROM r),
f AS (SELECT l.town_id, l.measure, h AS horizon, level + h * trend + season[h] AS v, sse, p.period + h AS period FROM last l CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1, 6)) AS h)
  JOIN (SELECT town_id, measure, MAX(period) AS period FROM seasonal_months GROUP BY ALL) p ON p.town_id = l.town_id AND p.measure = l.measure WHERE rn = 1)
SELECT town_id, measure, (period - 1) // 12 AS year, (period - 1) % 12 + 1 AS month, horizon, CASE WHEN measure = 'rain_mm' AND v < 0 THEN 0 ELSE v END AS value, sse FROM f""")
def _(spark, sf):
    """Holt-Winters at given parameters."""
    return SE.seasonal_forecast(CL.town_months(S.climate(spark, sf)), parameters=(0.5, 0.1, 0.25))


CTES["alert_history"] = """
SELECT r.town_id, r.period + 1 AS period, r.risk, r.event, r.points, FALSE AS is_active FROM risk r JOIN risk n ON n.town_id = r.town_id AND n.period = r.period + 1
WHERE r.period >= (SELECT MAX(a.period) - 5 FROM risk a JOIN risk b ON b.town_id = a.town_id AND b.period = a.period + 1)"""


@query("alert_rows", {"town_id": "i", "year": "i", "month": "i", "level": "s", "event": "s", "score": "f", "is_active": "b", "description": "s"}, """
SELECT town_id, (period - 1) // 12 AS year, (period - 1) % 12 + 1 AS month, level, event, score, is_active,
  'Riesgo ' || LOWER(level) || ' previsto para ' || ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][(period - 1) % 12 + 1] || ' (evento observado: ' || event || ').' AS description
FROM (SELECT *, ['BAJO', 'MEDIO', 'ALTO'][risk + 1] AS level, risk / 10.0 AS score, ROW_NUMBER() OVER (PARTITION BY town_id, period ORDER BY is_active DESC) AS rn FROM (
  SELECT town_id, MAX(period) + 1 AS period, ARG_MAX(risk, period) AS risk, ARG_MAX(event, period) AS event, ARG_MAX(points, period) AS points, TRUE AS is_active FROM risk GROUP BY town_id
  UNION ALL SELECT * FROM alert_history)) WHERE rn = 1""")
def _(spark, sf):
    """Alerts as they are published, with the risk of now as the prediction."""
    from cropspark.operators.ranking import latest_per_key
    from cropspark.session import materialise

    data = materialise(CL.alert_samples(S.risk(spark, sf)))
    _, test = AL.time_split(data)
    columns = ["town_id", "period", "event", F.col("risk").cast("double").alias("prediction"), (F.col("risk") / 10.0).alias("score")]
    return AL.alert_rows(latest_per_key(data, ["town_id"], ["period"]).select(*columns), test.select(*columns))


@query("anomaly_flags", {"town_id": "i", "crop_id": "s", "year": "i", "score": "f", "is_anomaly": "b"}, """
SELECT town_id, crop_id, year, anomaly_score AS score, anomaly_score > l AS is_anomaly
FROM predictions JOIN (SELECT crop_id, QUANTILE_CONT(anomaly_score, 0.93) AS l FROM predictions GROUP BY crop_id) USING (crop_id)""")
def _(spark, sf):
    """The most isolated share of each crop, by scores that SQL can state."""
    scores = S.predictions(spark, sf).select("town_id", "crop_id", "year", F.col("anomaly_score").alias("score"))
    return AN.flag_isolated(scores, ["town_id", "crop_id", "year"])


# Published prices from predictions, improvements and bands that SQL can state: large types are sure, small ones have no band of their own, PROMO was never
# tested, and no band is known for 20 days.
CTES["future_prices"] = """
SELECT market_id, product_id, day + h AS target_day, h, LN(price) AS log_price, CASE WHEN price > 2000 THEN 0.004 ELSE -0.002 END * h AS pred
FROM (SELECT market_id, product_id, MAX(day) AS day, ARG_MAX(price_avg, day) AS price FROM panel_daily GROUP BY ALL) CROSS JOIN (VALUES (1), (5), (20)) v(h)"""


@query("published_prices", {"market_id": "i", "product_id": "s", "target_day": "d", "h": "i", "price": "f", "p10": "f", "p90": "f", "method": "s", "confidence": "s"}, """
SELECT market_id, product_id, target_day, h, EXP(log_price + shift) AS price, EXP(log_price + shift + q10) AS p10, EXP(log_price + shift + q90) AS p90, CASE WHEN use THEN 'trees' ELSE 'naive' END AS method, confidence
FROM (SELECT *, CASE WHEN use THEN pred ELSE 0 END AS shift,
        CASE WHEN h = 20 THEN -0.1 WHEN product_id IN ('SMALL', 'PROMO') THEN -0.2 - CASE WHEN use THEN 0.01 ELSE 0.02 END ELSE -0.01 * h - CASE WHEN use THEN 0.01 ELSE 0.02 END END AS q10,
        CASE WHEN h = 20 THEN 0.1 WHEN product_id IN ('SMALL', 'PROMO') THEN 0.3 ELSE 0.02 * h END AS q90
      FROM (SELECT *, confidence <> 'baja' AS use FROM (SELECT *, CASE WHEN product_id = 'LARGE' OR (product_id = 'SMALL' AND h = 1) THEN 'alta' WHEN product_id IN ('MEDIUM', 'SMALL') THEN 'media' ELSE 'baja' END AS confidence FROM future_prices)))""")
def _(spark, sf):
    """What is published: the model where it has earned it, else the price of today, with bands."""
    daily = S.panel_daily(spark, sf)
    last = daily.groupBy("market_id", "product_id").agg(F.max("day").alias("day"), F.max_by("price_avg", "day").alias("price"))
    horizons = F.explode(F.array(*[F.lit(h) for h in (1, 5, 20)])).alias("h")
    future = last.select("*", horizons).select(
        "market_id", "product_id", F.date_add("day", F.col("h")).alias("target_day"), "h", F.log("price").alias("log_price"), (F.when(F.col("price") > 2000, 0.004).otherwise(-0.002) * F.col("h")).alias("pred"))
    types = table(spark, sf, "part").select(F.col("p_type").alias("product_id")).distinct().select("product_id", horizons)
    product, h = F.col("product_id"), F.col("h")
    gain = F.when((product == "LARGE") | ((product == "SMALL") & (h == 1)), 0.1).when(product.isin("MEDIUM", "SMALL"), 0.05).otherwise(0.0)
    improvement = types.where(product != "PROMO").select("product_id", "h", gain.alias("improvement"))
    kinds = F.explode(F.array(F.lit("model"), F.lit("naive"))).alias("kind")
    more = F.when(F.col("kind") == "model", 0.01).otherwise(0.02)
    bands = types.where(~product.isin("SMALL", "PROMO") & (h < 20)).select("product_id", "h", kinds).select(
        "kind", "product_id", "h", (-0.01 * h - more).alias("q10"), (0.02 * h).alias("q90"), (F.lit(-0.2) - more).alias("all10"), F.lit(0.3).alias("all90"))
    return PF.publish(future, improvement, bands)


@query("seasonal_forecast", {"town_id": "i", "measure": "s", "year": "i", "month": "i", "horizon": "i", "value": "f3", "method": "s"})
def _(spark, sf):
    return SE.seasonal_forecast(CL.town_months(S.climate(spark, sf)))


@query("anomaly_forest", {"town_id": "i", "crop_id": "s", "year": "i", "score": "f", "is_anomaly": "b"})
def _(spark, sf):
    return AN.isolation_scores(AN.anomaly_inputs(S.predictions(spark, sf)))


@query("backtest_reuse", {"model_name": "s", "id_version": "i", "mae": "f"}, """
SELECT model_name, MAX(id_version) AS id_version, MAX_BY(mae, id_version) AS mae FROM models WHERE model_name = 'click' GROUP BY model_name
HAVING MAX_BY(trained_at, id_version) > TIMESTAMP '2024-02-02' - INTERVAL 7 DAY""")
def _(spark, sf):
    found = PF.reusable_backtest(S.models(spark, sf), "click", datetime(2024, 2, 2))
    return found.withColumn("mae", FC.json_number(F.col("metrics_json"), "$.mae"))


# --- streaming ----------------------------------------------------------------------------------------
def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _landed(sf: str, name: str) -> str:
    """A table as a stream's input, be it a file or a folder of files: a pattern takes both."""
    return f"{sf}/{name}.parque[t]"


@query("stream_ingest", {"market_id": "i", "product_id": "s", "day": "d", "price_min": "f", "price_max": "f", "price_avg": "f", "source": "s"}, """
SELECT market_id, product_id, day, price_min, price_max, price_avg, 'soap' AS source FROM daily""")
def _(spark, sf):
    """The quotes as a stream of files, any number to a batch; the sums of all batches give the daily rows."""
    base = _scratch(spark, "prices")
    stream = IN.file_stream(spark, _landed(sf, "lineitem"), table(spark, sf, "lineitem").schema, "parquet")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")

    def transform(batch):
        return batch.join(supplier, batch.l_suppkey == supplier.s_suppkey).join(part, batch.l_partkey == part.p_partkey).select(
            F.col("s_nationkey").alias("market_id"), F.col("p_brand").alias("product_id"), F.to_date("l_shipdate").alias("day"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))

    IN.run_available(stream, IN.quote_sink(f"{base}/sums", transform), f"{base}/checkpoint")
    return IN.quoted_days(spark, f"{base}/sums").withColumn("source", F.lit("soap"))


@query("stream_daily_rollup", {"event_type": "s", "day": "d", "mean": "f", "n": "i"}, """
SELECT event_type, CAST(ts AS DATE) AS day, AVG(value) AS mean, COUNT(*) AS n FROM events GROUP BY ALL""")
def _(spark, sf):
    base = _scratch(spark, "rollup")
    stream = IN.file_stream(spark, _landed(sf, "events"), table(spark, sf, "events").schema, "parquet")
    # A watermark needs an instant, not a wall-clock time: take the instant that reads the same in UTC, in any session zone.
    instant = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    timed = stream.select("event_type", instant.alias("event_time"), "value")
    means = IN.daily_means(timed, "event_time", ["event_type"], "value")
    sink = IN.update_sink(f"{base}/table", lambda b: b.select("event_type", IN.window_day().alias("day"), "mean", "n"), ["event_type", "day"])
    IN.run_available(means, sink, f"{base}/checkpoint", "update")
    return IN.latest_rows(spark, f"{base}/table", ["event_type", "day"])


@query("newer_data", {"max_day": "d", "done_day": "d", "is_due": "b"}, """
SELECT (SELECT MAX(max_day) FROM runs) AS max_day, MAX(max_day) AS done_day, (SELECT MAX(max_day) FROM runs) > MAX(max_day) AS is_due FROM runs
WHERE source = 'purchase' AND status = 'ok'""")
def _(spark, sf):
    runs = S.runs(spark, sf)
    fact = runs.select(F.col("max_day").alias("day"))
    return IN.newer_data(fact, runs, "purchase")


@query("missing_months", {"year": "i", "month": "i"}, """
SELECT YEAR(m) AS year, MONTH(m) AS month FROM (SELECT UNNEST(GENERATE_SERIES(TIMESTAMP '1994-06-01', TIMESTAMP '2002-03-01', INTERVAL 1 MONTH)) AS m)
EXCEPT SELECT YEAR(o_orderdate), MONTH(o_orderdate) FROM orders""")
def _(spark, sf):
    present = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return IN.missing_months(present, "1994-06-01", "2002-03-01")


@query("reprocess_window", {"event_id": "i"}, "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-28' - 7")
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return IN.reprocess_window(events, "day", datetime(2024, 1, 28))

