"""Climate, harvest, index and feature-store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropspark.functions import dates as D
from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.operators import aggregate as A
from cropspark.operators import conform as C
from cropspark.operators import joins as J
from cropspark.operators import ranks as RK
from cropspark.operators import windows as W
from cropspark.plans import climate as CL
from cropspark.plans import features as FS
from cropspark.plans import prices as P
from cropspark.session import materialise
from registry import standins as S
from registry.base import CTES, query, table

F6 = "f6"


@query("harvest_rollup", {"town_id": "i", "crop_id": "s", "year": "i", "sown_ha": "f", "harvested_ha": "f", "production_t": "f",
                          "yield_t_ha": "f"}, "SELECT * FROM harvest")
def _(spark, sf):
    return S.harvest(spark, sf)


@query("dashboard_agro", {"town_id": "i", "town": "s", "department": "s", "region": "s", "crop": "s", "cycle": "s", "year": "i",
                          "sown_ha": "f", "production_t": "f", "yield_t_ha": "f", "rain_mean": "f", "rain_total": "f", "temp_mean": "f",
                          "temp_max": "f", "temp_min": "f", "humidity": "f", "sun_hours": "f"}, """
SELECT * FROM harvest JOIN towns USING (town_id) JOIN crops USING (crop_id)
LEFT JOIN (SELECT town_id, year, AVG(rain_mm) AS rain_mean, SUM(rain_mm) AS rain_total, AVG(temp_mean) AS temp_mean, AVG(temp_max) AS temp_max,
           AVG(temp_min) AS temp_min, AVG(humidity) AS humidity, AVG(sun_hours) AS sun_hours FROM climate GROUP BY ALL) USING (town_id, year)""")
def _(spark, sf):
    return CL.production_with_climate(S.harvest(spark, sf), S.towns(spark, sf), S.crops(spark, sf), S.climate(spark, sf))


@query("climate_monitor", {"station": "s", "town": "s", "region": "s", "year": "i", "month": "i", "quarter": "i", "month_name": "s",
                           "rain_mm": "f", "temp_mean": "f", "phase": "s", "spi": "f", "is_nino": "b"}, """
SELECT c_name AS station, town, region, c.year, c.month, QUARTER(MAKE_DATE(c.year, c.month, 1)) AS quarter,
       ['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre'][c.month] AS month_name,
       rain_mm, temp_mean, phase, spi, is_nino
FROM climate c JOIN customer ON c_custkey = station_id JOIN towns USING (town_id)
LEFT JOIN enso e ON e.year = c.year AND e.month = c.month AND e.region_id = towns.region_id
LEFT JOIN nino n ON n.year = c.year""")
def _(spark, sf):
    rows = CL.monitor(S.climate(spark, sf), S.stations(spark, sf), S.towns(spark, sf), S.enso(spark, sf))
    return rows.join(S.nino(spark, sf).select("year", "is_nino"), "year", "left")


@query("two_level_climate", {"town_id": "i", "year": "i", "rain_year": "f", "temp_year": "f", "temp_max_year": "f", "temp_min_year": "f",
                             "rain_std": "f", "temp_std": "f", "rain_half_a": "f", "rain_half_b": "f", "temp_half_a": "f",
                             "temp_half_b": "f", "rain_months": "i"}, "SELECT * FROM town_year")
def _(spark, sf):
    return CL.town_years(CL.town_months(S.climate(spark, sf)))


@query("climatology_anomaly", {"region_id": "i", "year": "i", "month": "i", "rain_mm": "f", "anomaly_pct": "f", "z_score": "f"},
       "SELECT * FROM rain_indices")
def _(spark, sf):
    return CL.region_rain_indices(S.climate(spark, sf), S.towns(spark, sf))


@query("enso_indices", {"year": "i", "month": "i", "region_id": "i", "oni": "f", "phase": "s", "spi": "f", "rain_anomaly_pct": "f"},
       "SELECT * FROM enso")
def _(spark, sf):
    return S.enso(spark, sf)


@query("nino_years", {"year": "i", "warm_months": "i", "is_nino": "b"}, "SELECT * FROM nino")
def _(spark, sf):
    return S.nino(spark, sf)


@query("cross_expand", {"year": "i", "month": "i", "region_id": "i", "oni": F6},
       "SELECT year, month, r_regionkey AS region_id, oni FROM oni CROSS JOIN region")
def _(spark, sf):
    return J.expand_over_table(S.oni(spark, sf), S.regions(spark, sf), ["region_id"])


@query("index_base100", {"input_name": "s", "region_id": "i", "year": "i", "month": "i", "price": "f", "price_index": "f"}, """
SELECT *, price / NULLIF(AVG(price) OVER (PARTITION BY input_name, region_id), 0) * 100 AS price_index FROM inputs""")
def _(spark, sf):
    return W.relative_to_group_mean(S.inputs(spark, sf), ["input_name", "region_id"], "price", index="price_index")


@query("input_price_means", {"year": "i", "month": "i", "region_id": "i", "kind": "s", "input_name": "s", "price": "f"}, """
SELECT YEAR(l_shipdate) AS year, MONTH(l_shipdate) AS month, n_regionkey AS region_id,
       CASE WHEN LOWER(p_name) LIKE '%sam%' OR LOWER(p_name) LIKE '%urea%' OR LOWER(p_name) LIKE '%dap%' OR LOWER(p_name) LIKE '%kcl%'
              OR LOWER(p_name) LIKE '%fertilizante%' OR LOWER(p_name) LIKE '!_%' ESCAPE '!' THEN 'Fertilizante' ELSE 'Otros' END AS kind,
       p_name AS input_name, AVG(p_retailprice * (1 + l_tax)) AS price
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
GROUP BY ALL""")
def _(spark, sf):
    line, part, supplier, nation = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))
    return (line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
                     F.col("n_regionkey").alias("region_id"), R.input_type(F.col("p_name")).alias("kind"),
                     F.col("p_name").alias("input_name"))
            .agg(F.avg(F.col("p_retailprice") * (1 + F.col("l_tax"))).alias("price")))


_SEEN = "harvested_ha > 0 AND (year <> 1998 OR yield_t_ha > 2) AND (year <> 1997 OR sown_ha > 250)"
CTES["sparse_harvest"] = f"SELECT * REPLACE (CASE WHEN {_SEEN} THEN yield_t_ha END AS yield_t_ha, CASE WHEN {_SEEN} THEN production_t END AS production_t) FROM harvest"


def sparse_harvest(spark, sf):
    """The whole harvest; some yields and productions of 1997 and 1998 are missing, and a missing value is a gap."""
    seen = F.expr(_SEEN)
    return S.harvest(spark, sf).withColumns({c: F.when(seen, F.col(c)) for c in ("yield_t_ha", "production_t")})


@query("calendar_lag_1_3", {"town_id": "i", "crop_id": "s", "year": "i", "yield_t_ha": "f", "lag1": "f", "lag3": "f", "next1": "f"}, """
SELECT h.town_id, h.crop_id, h.year, h.yield_t_ha, a.yield_t_ha AS lag1, b.yield_t_ha AS lag3, c.yield_t_ha AS next1
FROM sparse_harvest h LEFT JOIN sparse_harvest a ON a.town_id = h.town_id AND a.crop_id = h.crop_id AND a.year = h.year - 1
LEFT JOIN sparse_harvest b ON b.town_id = h.town_id AND b.crop_id = h.crop_id AND b.year = h.year - 3
LEFT JOIN sparse_harvest c ON c.town_id = h.town_id AND c.crop_id = h.crop_id AND c.year = h.year + 1""")
def _(spark, sf):
    key = ["town_id", "crop_id"]
    return sparse_harvest(spark, sf).withColumns({
        "lag1": W.value_at_offset(key, "year", "yield_t_ha", -1), "lag3": W.value_at_offset(key, "year", "yield_t_ha", -3),
        "next1": W.value_at_offset(key, "year", "yield_t_ha", 1)})


@query("shifted_key_join", {"town_id": "i", "crop_id": "s", "year": "i", "yield_t_ha_lag2": "f", "production_t_lag2": "f"}, """
SELECT h.town_id, h.crop_id, h.year, a.yield_t_ha AS yield_t_ha_lag2, a.production_t AS production_t_lag2
FROM sparse_harvest h LEFT JOIN sparse_harvest a ON a.town_id = h.town_id AND a.crop_id = h.crop_id AND a.year = h.year - 2""")
def _(spark, sf):
    return J.shifted_lookup(sparse_harvest(spark, sf), ["town_id", "crop_id"], "year", ["yield_t_ha", "production_t"], 2, "_lag2")


@query("history_avg_prior", {"town_id": "i", "crop_id": "s", "year": "i", "yield_hist": "f", "production_hist": "f"}, """
SELECT town_id, crop_id, year, AVG(yield_t_ha) OVER w AS yield_hist, AVG(production_t) OVER w AS production_hist FROM sparse_harvest
WINDOW w AS (PARTITION BY town_id, crop_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    key = ["town_id", "crop_id"]
    return sparse_harvest(spark, sf).withColumns({
        "yield_hist": W.prior_mean(key, "year", "yield_t_ha"), "production_hist": W.prior_mean(key, "year", "production_t")})


@query("yoy_and_crop_deviation", {"town_id": "i", "crop_id": "s", "year": "i", "change": "f", "deviation": "f"}, """
SELECT town_id, crop_id, year, yield_t_ha - LAG(yield_t_ha) OVER (PARTITION BY town_id, crop_id ORDER BY year) AS change,
       yield_t_ha - AVG(yield_t_ha) OVER (PARTITION BY crop_id) AS deviation FROM sparse_harvest""")
def _(spark, sf):
    rows = sparse_harvest(spark, sf).withColumn("change", W.difference_from_previous(["town_id", "crop_id"], "year", "yield_t_ha"))
    return W.relative_to_group_mean(rows, ["crop_id"], "yield_t_ha", deviation="deviation")


@query("interpolate_gaps", {"town_id": "i", "period": "i", "rain_mm": "f", "is_filled": "b"}, """
WITH known AS (SELECT town_id, year * 12 + month AS period, rain_mm FROM (
    SELECT c_nationkey AS town_id, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month, AVG(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN o_totalprice END) AS rain_mm
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)),
held AS (SELECT * FROM known WHERE rain_mm IS NOT NULL),
spine AS (SELECT town_id, UNNEST(GENERATE_SERIES((SELECT MIN(h.period) FROM held h WHERE h.town_id = known.town_id), MAX(period))) AS period FROM known GROUP BY town_id),
edges AS (SELECT s.town_id, s.period, k.rain_mm,
    (SELECT MAX(x.period) FROM held x WHERE x.town_id = s.town_id AND x.period <= s.period) AS p0,
    (SELECT MIN(x.period) FROM held x WHERE x.town_id = s.town_id AND x.period >= s.period) AS p1
  FROM spine s LEFT JOIN held k USING (town_id, period))
SELECT e.town_id, e.period, CASE WHEN p1 = p0 OR p1 IS NULL THEN a.rain_mm ELSE a.rain_mm + (b.rain_mm - a.rain_mm) / (p1 - p0) * (e.period - p0) END AS rain_mm,
       e.rain_mm IS NULL AS is_filled
FROM edges e JOIN held a ON a.town_id = e.town_id AND a.period = p0 LEFT JOIN held b ON b.town_id = e.town_id AND b.period = p1""")
def _(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    urgent = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), F.col("o_totalprice"))
    months = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(
        F.col("c_nationkey").alias("town_id"), D.month_index(F.year("o_orderdate"), F.month("o_orderdate")).alias("period")).agg(
        F.avg(urgent).alias("rain_mm"))
    return W.interpolate(months, ["town_id"], "period", "rain_mm")


# --- risk ---------------------------------------------------------------------------------------------
@query("risk_score", {"town_id": "i", "year": "i", "month": "i", "risk": "i"}, "SELECT * FROM risk")
def _(spark, sf):
    return S.risk(spark, sf)


@query("event_type", {"event": "s", "risk": "i", "n": "i"}, "SELECT event, risk, COUNT(*) AS n FROM risk GROUP BY ALL")
def _(spark, sf):
    return S.risk(spark, sf).groupBy("event", "risk").agg(F.count(F.lit(1)).alias("n"))


@query("alert_samples", {"town_id": "i", "period": "i", "target": "n", "risk_lag1": "n", "rain_mm_lag1": "f", "month_sin": "f", "month_cos": "f"}, """
SELECT r.town_id, r.period, n.risk AS target, p.risk AS risk_lag1, p.rain_mm AS rain_mm_lag1,
       SIN(2 * PI() * r.month / 12) AS month_sin, COS(2 * PI() * r.month / 12) AS month_cos
FROM risk r LEFT JOIN risk n ON n.town_id = r.town_id AND n.period = r.period + 1
LEFT JOIN risk p ON p.town_id = r.town_id AND p.period = r.period - 1""")
def _(spark, sf):
    return CL.alert_samples(S.risk(spark, sf))


# --- conforming of climate sources --------------------------------------------------------------------
CTES["raw_readings"] = """
SELECT o_custkey AS station_id, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Temperatura del aire' WHEN '2-HIGH' THEN 'Humedad y temperatura'
       WHEN '3-MEDIUM' THEN 'BRILLO SOLAR' WHEN '4-NOT SPECIFIED' THEN 'Presion' ELSE 'temp minima' END AS sensor,
  o_totalprice / 6000 - 15 AS value FROM orders"""


def raw_readings(spark, sf):
    names = {"1-URGENT": "Temperatura del aire", "2-HIGH": "Humedad y temperatura", "3-MEDIUM": "BRILLO SOLAR", "4-NOT SPECIFIED": "Presion"}
    sensor = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in names.items()], F.lit("temp minima"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        sensor.alias("sensor"), (F.col("o_totalprice") / 6000 - 15).alias("value"))


@query("unify_climate", {"station_id": "i", "year": "i", "month": "i", "rain_mm": "f", "temp_mean": "f", "temp_max": "f", "temp_min": "f",
                         "humidity": "f", "sun_hours": "f"}, """
WITH wet AS (SELECT o_custkey AS station_id, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month,
    CASE WHEN SUM(fallen) / 200 - 100 < 0 THEN 0 WHEN SUM(fallen) / 200 - 100 <= 3000 THEN SUM(fallen) / 200 - 100 END AS rain_mm
  FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS fallen FROM orders) GROUP BY ALL),
wide AS (SELECT station_id, year, month,
    AVG(CASE WHEN kind = 't' THEN value END) AS tm, AVG(CASE WHEN kind = 't' THEN value + 5 END) AS tx, AVG(CASE WHEN kind = 't' THEN value - 5 END) AS tn,
    AVG(CASE WHEN kind = 'h' THEN value END) AS hm, AVG(CASE WHEN kind = 's' THEN value END) AS sm
  FROM (SELECT *, CASE sensor WHEN 'Humedad y temperatura' THEN 'h' WHEN 'BRILLO SOLAR' THEN 's' WHEN 'Presion' THEN NULL ELSE 't' END AS kind FROM raw_readings)
  WHERE kind IS NOT NULL GROUP BY ALL)
SELECT COALESCE(w.station_id, d.station_id) AS station_id, COALESCE(w.year, d.year) AS year, COALESCE(w.month, d.month) AS month, rain_mm,
  CASE WHEN tm BETWEEN -10 AND 50 THEN tm END AS temp_mean, CASE WHEN tx BETWEEN -10 AND 50 THEN tx END AS temp_max,
  CASE WHEN tn BETWEEN -10 AND 50 THEN tn END AS temp_min, CASE WHEN hm BETWEEN 0 AND 100 THEN hm END AS humidity, sm AS sun_hours
FROM wet w FULL JOIN wide d ON d.station_id = w.station_id AND d.year = w.year AND d.month = w.month""")
def _(spark, sf):
    rain = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        (F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))) / 200 - 100).cast("string").alias("total"))
    readings = raw_readings(spark, sf).select(
        "station_id", "year", "month", "sensor", F.col("value").cast("string").alias("mean_value"),
        (F.col("value") + 5).cast("string").alias("max_value"), (F.col("value") - 5).cast("string").alias("min_value"))
    return CL.unify_monthly(rain, readings)


@query("pivot_sensors", {"station_id": "i", "year": "i", "temp_mean": "f", "temp_max": "f", "sun_min": "f"}, """
SELECT station_id, year, AVG(CASE WHEN sensor = 'Temperatura del aire' THEN value END) AS temp_mean,
       MAX(CASE WHEN sensor = 'Temperatura del aire' THEN value END) AS temp_max, MIN(CASE WHEN sensor = 'BRILLO SOLAR' THEN value END) AS sun_min
FROM raw_readings GROUP BY ALL""")
def _(spark, sf):
    wide = C.pivot_readings(raw_readings(spark, sf), ["station_id", "year"], "sensor", ["Temperatura del aire", "BRILLO SOLAR"], "value")
    return wide.select("station_id", "year", F.col("Temperatura del aire_mean").alias("temp_mean"),
                       F.col("Temperatura del aire_max").alias("temp_max"), F.col("BRILLO SOLAR_min").alias("sun_min"))


@query("daily_to_monthly", {"station_id": "i", "year": "i", "month": "i", "temp_mean": "f", "sun_hours": "f"}, """
SELECT user_id AS station_id, YEAR(ts) AS year, MONTH(ts) AS month, AVG(value) AS temp_mean, AVG(value * 60) / 3600 AS sun_hours FROM events GROUP BY ALL""")
def _(spark, sf):
    v = F.col("value")
    days = table(spark, sf, "events").select(
        F.col("user_id").alias("station_id"), F.to_date("ts").alias("day"), v.alias("temp_mean"), v.alias("temp_max"),
        v.alias("temp_min"), v.alias("humidity"), (v * 60).alias("sunshine_s"))
    return CL.daily_to_monthly(days)


@query("weighted_mean_final", {"station_id": "i", "mean": "f", "low": "f", "high": "f", "n": "i"}, """
SELECT o_custkey AS station_id, AVG(o_totalprice) AS mean, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, COUNT(*) AS n
FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    blocks = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(
        F.avg("o_totalprice").alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"))
    return A.combine_blocks(blocks, ["station_id"], "mean", "low", "high", "n")


@query("bounds_and_sentinels", {"o_orderkey": "i", "clamped": "f", "bounded": "f", "no_sentinel": "f"}, """
SELECT o_orderkey, CASE WHEN v < 0 THEN 0 WHEN v <= 3000 THEN v END AS clamped, CASE WHEN v BETWEEN -10 AND 50 THEN v END AS bounded,
       CASE WHEN v > -900 THEN v END AS no_sentinel
FROM (SELECT o_orderkey, (o_totalprice - 60000) / 60 AS v FROM orders)""")
def _(spark, sf):
    v = F.col("v")
    return table(spark, sf, "orders").select("o_orderkey", ((F.col("o_totalprice") - 60000) / 60).alias("v")).select(
        "o_orderkey", N.clamp_low_null_high(v, 0, 3000).alias("clamped"), N.null_outside(v, -10, 50).alias("bounded"),
        N.sentinel_to_null(v, -900).alias("no_sentinel"))


@query("time_dimension", {"month_start": "d", "year": "i", "month": "i", "quarter": "i", "semester": "s", "month_name": "s", "is_nino": "b"}, """
SELECT CAST(m AS DATE) AS month_start, YEAR(m) AS year, MONTH(m) AS month, QUARTER(m) AS quarter, CASE WHEN MONTH(m) <= 6 THEN 'A' ELSE 'B' END AS semester,
       ['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre'][MONTH(m)] AS month_name, is_nino
FROM (SELECT UNNEST(GENERATE_SERIES(MAKE_TIMESTAMP(YEAR(MIN(o_orderdate)), 1, 1, 0, 0, 0), MAKE_TIMESTAMP(YEAR(MAX(o_orderdate)), 12, 1, 0, 0, 0), INTERVAL 1 MONTH)) AS m FROM orders)
LEFT JOIN nino ON nino.year = YEAR(m)""")
def _(spark, sf):
    return C.month_calendar(table(spark, sf, "orders"), "o_orderdate", S.nino(spark, sf).select("year", "is_nino"))


# --- feature store ------------------------------------------------------------------------------------
FEATURES = {
    "town_id": "i", "crop_id": "s", "year": "i", "sown_ha": "f", "yield_t_ha": "f", "rain_year": "f", "temp_year": "f", "rain_std": "f",
    "spi_mean": "f", "oni_mean": "f", "rain_anomaly_mean": "f", "is_nino_number": "f", "price_mean": "f", "price_std": "f", "volume_mean": "f", "price_weighted": "f", "price_source": "s",
    "input_index_mean": "f", "input_index_std": "f", "suitability_score": "f", "has_climate": "i", "has_price": "i",
    "rain_year_lag1": "f", "rain_year_lag3": "f", "spi_mean_lag1": "f", "oni_mean_lag3": "f", "price_mean_lag1": "f",
    "yield_t_ha_hist": "f", "production_t_hist": "f", "town_code": "i", "department_code": "i"}
CTES["crop_year_prices"] = """
SELECT * FROM (
  SELECT product_id AS crop_id, YEAR(day) AS year, AVG(price_avg) AS price_mean, STDDEV_SAMP(price_avg) AS price_std, NULL::DOUBLE AS volume_mean,
         NULL::DOUBLE AS price_weighted, 'daily' AS price_source FROM recent_daily GROUP BY ALL
  UNION ALL
  SELECT product_id, year, AVG(price), STDDEV_SAMP(price), AVG(volume), SUM(price * volume) / NULLIF(SUM(CASE WHEN price IS NOT NULL THEN volume END), 0), 'monthly'
  FROM old_monthly GROUP BY ALL)
QUALIFY ROW_NUMBER() OVER (PARTITION BY crop_id, year ORDER BY price_source) = 1"""
CTES["feature_base"] = """
SELECT h.*, t.department, c.rain_year, c.temp_year, c.rain_std, e.spi_mean, e.oni_mean, e.rain_anomaly_mean, e.is_nino_number,
       p.price_mean, p.price_std, p.volume_mean, p.price_weighted, p.price_source, i.input_index_mean, i.input_index_std,
       CASE s.suitability WHEN 'alta' THEN 3 WHEN 'moderada' THEN 2 WHEN 'marginal' THEN 1 WHEN 'no_apta' THEN 0 END AS suitability_score
FROM harvest h JOIN towns t USING (town_id) LEFT JOIN town_year c USING (town_id, year)
LEFT JOIN (SELECT e.year, AVG(spi) AS spi_mean, AVG(oni) AS oni_mean, AVG(rain_anomaly_pct) AS rain_anomaly_mean, CAST(BOOL_OR(is_nino) AS INTEGER) AS is_nino_number
           FROM enso e LEFT JOIN nino n ON n.year = e.year GROUP BY e.year) e USING (year)
LEFT JOIN crop_year_prices p USING (crop_id, year)
LEFT JOIN (SELECT year, AVG(ix) AS input_index_mean, STDDEV_SAMP(ix) AS input_index_std FROM (
             SELECT year, price / NULLIF(AVG(price) OVER (PARTITION BY input_name, region_id), 0) * 100 AS ix FROM inputs) GROUP BY year) i USING (year)
LEFT JOIN suitability s USING (town_id, crop_id)"""


def feature_store(spark, sf, sources=None):
    """Also the input of the yield model. ``sources``: harvest and suitability, if they are at hand."""
    towns = S.towns(spark, sf)
    links = S.products(spark, sf).select("product_id", F.col("product_id").alias("crop_id"))
    harvest, suitability = sources or S.harvest_and_suitability(spark, sf)
    return FS.feature_store(
        harvest, towns, CL.town_years(CL.town_months(S.climate(spark, sf))),
        FS.enso_years(S.enso(spark, sf), S.nino(spark, sf)), P.crop_year_prices(*S.two_price_facts(spark, sf), links),
        FS.input_index_years(S.inputs(spark, sf)), suitability)


@query("crop_year_prices", {"crop_id": "s", "year": "i", "price_mean": "f", "price_std": "f", "volume_mean": "f", "price_weighted": "f", "price_source": "s"}, "SELECT * FROM crop_year_prices")
def _(spark, sf):
    """Price of each crop and year from the daily fact where it has any, else from the monthly one."""
    links = S.products(spark, sf).select("product_id", F.col("product_id").alias("crop_id"))
    return P.crop_year_prices(*S.two_price_facts(spark, sf), links)


@query("feature_store", FEATURES, """
SELECT b.*, CAST(b.rain_year IS NOT NULL AS INTEGER) AS has_climate, CAST(b.price_mean IS NOT NULL AS INTEGER) AS has_price,
       l.rain_year AS rain_year_lag1, l3.rain_year AS rain_year_lag3, l.spi_mean AS spi_mean_lag1, l3.oni_mean AS oni_mean_lag3, l.price_mean AS price_mean_lag1,
       AVG(b.yield_t_ha) OVER w AS yield_t_ha_hist, AVG(b.production_t) OVER w AS production_t_hist,
       DENSE_RANK() OVER (ORDER BY CAST(b.town_id AS VARCHAR)) - 1 AS town_code, DENSE_RANK() OVER (ORDER BY b.department) - 1 AS department_code
FROM feature_base b
LEFT JOIN feature_base l ON l.town_id = b.town_id AND l.crop_id = b.crop_id AND l.year = b.year - 1
LEFT JOIN feature_base l3 ON l3.town_id = b.town_id AND l3.crop_id = b.crop_id AND l3.year = b.year - 3
WINDOW w AS (PARTITION BY b.town_id, b.crop_id ORDER BY b.year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    sources = S.harvest_and_suitability(spark, sf)
    store = feature_store(spark, sf, sources).withColumn("_town", F.col("town_id").cast("string"))
    present = sources[0].select("town_id").distinct()  # codes count the towns that have rows
    towns = materialise(
        S.towns(spark, sf).join(present, "town_id", "left_semi").withColumn("_town", F.col("town_id").cast("string")))
    return store.join(RK.dense_codes(towns, "_town", "town_code"), "_town").join(
        RK.dense_codes(towns, "department", "department_code"), "department")


@query("fact_loading", {"town_id": "i", "crop_id": "s", "month_start": "d", "production_t": "f", "yield_t_ha": "f"}, """
SELECT h.town_id, h.crop_id, MAKE_DATE(h.year, 12, 1) AS month_start, production_t, yield_t_ha
FROM harvest h JOIN towns USING (town_id) JOIN crops USING (crop_id)""")
def _(spark, sf):
    """Annual harvest facts pinned to December, only for towns and crops the dimensions know."""
    kept, _ = J.split_by_reference(S.harvest(spark, sf), S.towns(spark, sf), "town_id")
    kept, _ = J.split_by_reference(kept, S.crops(spark, sf), "crop_id")
    return kept.withColumn("month_start", F.make_date("year", F.lit(12), F.lit(1)))


@query("scenario_projection", {"town_id": "i", "crop_id": "s", "year": "i", "enso": "s", "rain": "s", "shift": "f", "projected": "f",
                               "projected_low": "f", "projected_high": "f"}, """
SELECT p.town_id, p.crop_id, p.year, e.enso, r.rain, s AS shift, predicted + s AS projected, GREATEST(low + s, 0) AS projected_low, high + s AS projected_high
FROM predictions p CROSS JOIN (VALUES ('El Niño', -0.10::DOUBLE), ('La Niña', 0.06), ('Neutral', 0.0)) e(enso, ep)
CROSS JOIN (VALUES ('Déficit', -0.08::DOUBLE), ('Exceso', -0.04), ('Normal', 0.0)) r(rain, rp), LATERAL (SELECT FLOOR(predicted * (ep + rp) * 100 + 0.5) / 100 AS s)""")
def _(spark, sf):
    from cropspark.plans import serving as V

    return V.scenario_projection(S.predictions(spark, sf))
