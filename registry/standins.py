"""The domain tables as derived from the driver's tables: whole tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import rules as R
from cropspark.operators import aggregate as A
from cropspark.operators import windows as W
from cropspark.plans import climate as CL
from cropspark.plans import prices as P
from cropspark.session import materialise
from registry.base import CTES, table

# --- prices -------------------------------------------------------------------------------------------
CTES["quotes"] = """
SELECT s_nationkey AS market_id, p_brand AS product_id, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS price
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey"""
CTES["daily"] = """
SELECT market_id, product_id, day, MIN(price) AS price_min, MAX(price) AS price_max, AVG(price) AS price_avg
FROM quotes GROUP BY ALL"""
CTES["markets"] = """
SELECT n_nationkey AS market_id, n_name AS market, r_name AS department FROM nation JOIN region ON r_regionkey = n_regionkey"""
CTES["products"] = """
SELECT p_brand AS product_id, 'Product ' || p_brand AS product, MAX_BY(p_type, p_partkey) AS product_group FROM part GROUP BY p_brand"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
            .select(F.col("s_nationkey").alias("market_id"), F.col("p_brand").alias("product_id"),
                    F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")))


# Two price facts that share the quotes: what is settled is kept by month, with volumes, what is open by day. The year they meet in has both.
CTES["recent_daily"] = """
SELECT s_nationkey AS market_id, p_brand AS product_id, CAST(l_shipdate AS DATE) AS day, AVG(l_extendedprice / l_quantity) AS price_avg
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' GROUP BY ALL"""
CTES["old_monthly"] = """
SELECT s_nationkey AS market_id, p_brand AS product_id, YEAR(l_shipdate) AS year, MONTH(l_shipdate) AS month, AVG(l_extendedprice / l_quantity) AS price,
       SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS volume
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F' GROUP BY ALL"""


def two_price_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The daily fact of open lines and the monthly fact of settled ones, from one scan: a settled row is summed by month, an open one by day."""
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    is_open = F.col("l_linestatus") == "O"
    facts = materialise(
        line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
        .groupBy(F.col("s_nationkey").alias("market_id"), F.col("p_brand").alias("product_id"), is_open.alias("_open"),
                 F.when(is_open, F.to_date("l_shipdate")).otherwise(F.trunc("l_shipdate", "month")).alias("day"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("volume")))
    recent = facts.where("_open").select("market_id", "product_id", "day", F.col("price").alias("price_avg"))
    return recent, facts.where("NOT _open").select("market_id", "product_id", F.year("day").alias("year"), F.month("day").alias("month"), "price", "volume")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return P.daily_prices(quotes(spark, sf))


def markets(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("market_id"), F.col("n_name").alias("market"), F.col("r_name").alias("department"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("product_id")).agg(
        F.max_by("p_type", "p_partkey").alias("product_group")).withColumn("product", F.concat(F.lit("Product "), F.col("product_id")))


# The daily report needs few, dense series: product = type of part.
CTES["report_prices"] = """
SELECT s_nationkey AS market_id, n_name AS market, r_name AS department, p_type AS product_id, p_type AS product,
       CAST(l_shipdate AS DATE) AS day, AVG(l_extendedprice / l_quantity) AS price_avg
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"""


def report_prices(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    raw = (line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
           .select(F.col("s_nationkey").alias("market_id"), F.col("p_type").alias("product_id"),
                   F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")))
    return P.daily_prices(raw).select("market_id", "product_id", "day", "price_avg").join(
        markets(spark, sf), "market_id").withColumn("product", F.col("product_id"))


# The forecast panel: market = region, product = type of part.
CTES["panel_daily"] = """
SELECT n_regionkey AS market_id, p_type AS product_id, CAST(l_shipdate AS DATE) AS day, AVG(l_extendedprice / l_quantity) AS price_avg
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL"""


def panel_daily(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    raw = (line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
           .join(nation, supplier.s_nationkey == nation.n_nationkey)
           .select(F.col("n_regionkey").alias("market_id"), F.col("p_type").alias("product_id"),
                   F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")))
    return P.daily_prices(raw).select("market_id", "product_id", "day", "price_avg")


# --- territory and crops ------------------------------------------------------------------------------
CTES["towns"] = """
SELECT n_nationkey AS town_id, n_name AS town, r_name AS department, r_regionkey AS region_id, r_name AS region,
       n_nationkey - 12.0 AS lat, n_regionkey * 10.0 - 20.0 AS lon
FROM nation JOIN region ON r_regionkey = n_regionkey"""
CTES["crops"] = """SELECT p_brand AS crop_id, 'Crop ' || p_brand AS crop, MAX_BY(p_type, p_partkey) AS cycle FROM part GROUP BY p_brand"""


def towns(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("town_id"), F.col("n_name").alias("town"), F.col("r_name").alias("department"),
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"),
        (F.col("n_nationkey") - F.lit(12.0)).alias("lat"), (F.col("n_regionkey") * F.lit(10.0) - 20.0).alias("lon"))


def crops(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("crop_id")).agg(F.max_by("p_type", "p_partkey").alias("cycle")).withColumn(
        "crop", F.concat(F.lit("Crop "), F.col("crop_id")))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("region_id"))


# --- harvest ------------------------------------------------------------------------------------------
CTES["lots"] = """
SELECT s_nationkey AS town_id, p_brand AS crop_id, YEAR(l_shipdate) AS year, l_quantity AS sown_ha,
       CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS harvested_ha,
       CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS production_t,
       l_extendedprice / 1000 / l_quantity AS yield_t_ha, l_returnflag AS soil
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey"""
CTES["harvest"] = """
SELECT town_id, crop_id, year, SUM(sown_ha) AS sown_ha, SUM(harvested_ha) AS harvested_ha, SUM(production_t) AS production_t,
       COALESCE(CASE WHEN SUM(harvested_ha) > 0 THEN SUM(production_t) / SUM(harvested_ha) END, AVG(yield_t_ha)) AS yield_t_ha
FROM lots GROUP BY ALL"""
CTES["suitability"] = """
SELECT town_id, crop_id, CASE s WHEN 'Aptitud alta' THEN 'alta' WHEN 'Aptitud media' THEN 'moderada' ELSE 'no_apta' END AS suitability
FROM (SELECT town_id, crop_id, CASE soil WHEN 'A' THEN 'Aptitud alta' WHEN 'N' THEN 'Aptitud media' ELSE 'No apta' END AS s,
             ROW_NUMBER() OVER (PARTITION BY town_id, crop_id ORDER BY COUNT(*) DESC,
               CASE soil WHEN 'A' THEN 'Aptitud alta' WHEN 'N' THEN 'Aptitud media' ELSE 'No apta' END) AS rn
      FROM lots GROUP BY town_id, crop_id, soil) WHERE rn = 1"""


def lots(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    reaped = F.col("l_returnflag") != "R"
    return (line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
            .select(F.col("s_nationkey").alias("town_id"), F.col("p_brand").alias("crop_id"),
                    F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("sown_ha"),
                    F.when(reaped, F.col("l_quantity")).alias("harvested_ha"),
                    F.when(reaped, F.col("l_extendedprice") / 1000).alias("production_t"),
                    (F.col("l_extendedprice") / 1000 / F.col("l_quantity")).alias("yield_t_ha"),
                    F.col("l_returnflag").alias("soil")))


def harvest(spark: SparkSession, sf: str) -> DataFrame:
    return A.harvest_rollup(lots(spark, sf), ["town_id", "crop_id", "year"], "sown_ha", "harvested_ha", "production_t",
                            "yield_t_ha")


def harvest_and_suitability(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both from one aggregate of the lots by soil, so that the fact is read once."""
    sums = materialise(lots(spark, sf).groupBy("town_id", "crop_id", "year", "soil").agg(
        F.sum("sown_ha").alias("sown_ha"), F.sum("harvested_ha").alias("harvested_ha"), F.sum("production_t").alias("production_t"),
        F.sum("yield_t_ha").alias("yield_t_ha"), F.count("yield_t_ha").alias("lots"), F.count(F.lit(1)).alias("n")))
    text = F.when(F.col("soil") == "A", "Aptitud alta").when(F.col("soil") == "N", "Aptitud media").otherwise("No apta")
    counts = sums.groupBy("town_id", "crop_id", text.alias("_class")).agg(F.sum("n").alias("n"))
    classed = A.largest_share(counts, ["town_id", "crop_id"], "_class", "n", "_class")
    return (A.harvest_rollup(sums, ["town_id", "crop_id", "year"], "sown_ha", "harvested_ha", "production_t", "yield_t_ha", "lots"),
            classed.select("town_id", "crop_id", R.suitability_class(F.col("_class")).alias("suitability")))


def suitability(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("soil") == "A", "Aptitud alta").when(F.col("soil") == "N", "Aptitud media").otherwise("No apta")
    classed = A.most_frequent_class(lots(spark, sf).withColumn("_s", text), ["town_id", "crop_id"], "_s", "_class")
    return classed.select("town_id", "crop_id", R.suitability_class(F.col("_class")).alias("suitability"))


# --- climate ------------------------------------------------------------------------------------------
CTES["climate"] = """
SELECT o_custkey AS station_id, c_nationkey AS town_id, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month,
       SUM(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) / 1000 AS rain_mm, AVG(o_totalprice) / 20000 AS temp_mean,
       MAX(o_totalprice) / 12000 AS temp_max, MIN(o_totalprice) / 20000 AS temp_min,
       AVG(CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 40.0 END) AS humidity, AVG(c_acctbal) / 1000 AS sun_hours
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""
CTES["oni"] = """
SELECT year, month, (m - AVG(m) OVER ()) / STDDEV_SAMP(m) OVER () AS oni
FROM (SELECT YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month, AVG(o_totalprice) AS m FROM orders GROUP BY ALL)"""
CTES["rain_indices"] = """
SELECT region_id, year, month, rain_mm,
  CASE WHEN COUNT(rain_mm) OVER w >= 4 AND AVG(rain_mm) OVER w > 0 THEN (rain_mm - AVG(rain_mm) OVER w) / AVG(rain_mm) OVER w * 100 END AS anomaly_pct,
  CASE WHEN COUNT(rain_mm) OVER w >= 4 AND STDDEV_SAMP(rain_mm) OVER w > 0 THEN (rain_mm - AVG(rain_mm) OVER w) / STDDEV_SAMP(rain_mm) OVER w END AS z_score
FROM (SELECT region_id, year, month, AVG(rain_mm) AS rain_mm FROM climate JOIN towns USING (town_id)
      WHERE rain_mm IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY region_id, month)"""
CTES["enso"] = """
SELECT o.year, o.month, r.r_regionkey AS region_id, o.oni,
       CASE WHEN o.oni >= 0.5 THEN 'El Niño' WHEN o.oni <= -0.5 THEN 'La Niña' WHEN o.oni IS NOT NULL THEN 'Neutral' END AS phase,
       i.z_score AS spi, i.anomaly_pct AS rain_anomaly_pct, 1 / (1 + EXP(i.z_score)) AS deficit_probability
FROM oni o CROSS JOIN region r
LEFT JOIN rain_indices i ON i.year = o.year AND i.month = o.month AND i.region_id = r.r_regionkey"""
CTES["nino"] = """
SELECT year, COUNT(*) FILTER (WHERE oni >= 0.5) AS warm_months, COUNT(*) FILTER (WHERE oni >= 0.5) >= 5 AS is_nino FROM oni GROUP BY year"""
CTES["town_month"] = """
SELECT town_id, year, month, AVG(rain_mm) AS rain_mm, AVG(temp_mean) AS temp_mean, MAX(temp_max) AS temp_max,
       MIN(temp_min) AS temp_min, AVG(humidity) AS humidity, AVG(sun_hours) AS sun_hours
FROM climate GROUP BY ALL"""
CTES["town_year"] = """
SELECT town_id, year, CASE WHEN COUNT(rain_mm) >= 10 THEN SUM(rain_mm) END AS rain_year, AVG(temp_mean) AS temp_year,
       MAX(temp_max) AS temp_max_year, MIN(temp_min) AS temp_min_year, AVG(humidity) AS humidity_year, AVG(sun_hours) AS sun_year,
       STDDEV_SAMP(rain_mm) AS rain_std, STDDEV_SAMP(temp_mean) AS temp_std,
       SUM(CASE WHEN month BETWEEN 1 AND 6 THEN rain_mm END) AS rain_half_a, SUM(CASE WHEN month BETWEEN 7 AND 12 THEN rain_mm END) AS rain_half_b,
       AVG(CASE WHEN month BETWEEN 1 AND 6 THEN temp_mean END) AS temp_half_a, AVG(CASE WHEN month BETWEEN 7 AND 12 THEN temp_mean END) AS temp_half_b,
       COUNT(rain_mm) AS rain_months
FROM town_month GROUP BY ALL"""
CTES["risk_rules"] = """
SELECT m.*, t.region_id, e.oni, e.phase, e.spi, e.rain_anomaly_pct, m.year * 12 + m.month AS period,
  CASE WHEN e.spi < -1.5 THEN 3 WHEN e.spi < -1.0 THEN 2 WHEN e.spi < -0.5 THEN 1 ELSE 0 END
  + CASE WHEN e.spi > 1.5 THEN 2 WHEN e.spi > 1.0 THEN 1 ELSE 0 END
  + CASE WHEN ABS(e.rain_anomaly_pct) > 50 THEN 2 WHEN ABS(e.rain_anomaly_pct) > 25 THEN 1 ELSE 0 END
  + CASE WHEN m.temp_max > 38 THEN 2 WHEN m.temp_max > 35 THEN 1 ELSE 0 END
  + CASE WHEN e.phase IN ('El Niño', 'La Niña') THEN 1 ELSE 0 END AS points
FROM town_month m JOIN towns t USING (town_id)
LEFT JOIN enso e ON e.year = m.year AND e.month = m.month AND e.region_id = t.region_id"""
CTES["risk"] = """
SELECT *, CASE WHEN points >= 5 THEN 2 WHEN points >= 2 THEN 1 ELSE 0 END AS risk,
  CASE WHEN spi < -1.0 OR rain_anomaly_pct < -40 THEN 'Sequía severa'
       WHEN spi > 1.0 OR rain_anomaly_pct > 50 THEN 'Exceso de lluvias'
       WHEN temp_max > 36 OR temp_min < 4 THEN 'Estrés térmico'
       WHEN humidity > 80 AND temp_max BETWEEN 22 AND 32 THEN 'Condiciones propicias para plagas (regla)'
       ELSE 'Sin evento crítico' END AS event
FROM risk_rules"""


def climate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    price = F.col("o_totalprice")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .groupBy(F.col("o_custkey").alias("station_id"), F.col("c_nationkey").alias("town_id"),
                     F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
            .agg((F.sum(F.when(F.col("o_orderstatus") != "P", price)) / 1000).alias("rain_mm"),
                 (F.avg(price) / 20000).alias("temp_mean"), (F.max(price) / 12000).alias("temp_max"),
                 (F.min(price) / 20000).alias("temp_min"),
                 F.avg(F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(40.0)).alias("humidity"),
                 (F.avg("c_acctbal") / 1000).alias("sun_hours")))


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("station"))


def oni(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.avg("o_totalprice").alias("m"))
    overall = months.agg(F.struct(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))).scalar()
    return months.select("year", "month", ((F.col("m") - overall["mean"]) / overall["std"]).alias("oni"))


def enso(spark: SparkSession, sf: str) -> DataFrame:
    facts = CL.enso_facts(oni(spark, sf), regions(spark, sf))
    full = CL.with_indices(facts, CL.region_rain_indices(climate(spark, sf), towns(spark, sf)))
    # One row per month and region; most consumers read it more than once.
    return materialise(full.withColumn("deficit_probability", 1 / (1 + F.exp("spi"))))


def nino(spark: SparkSession, sf: str) -> DataFrame:
    return CL.nino_years(oni(spark, sf))


def risk(spark: SparkSession, sf: str) -> DataFrame:
    return CL.risk_months(CL.town_months(climate(spark, sf)), towns(spark, sf), enso(spark, sf))


CTES["alerts"] = """
SELECT town_id, year, month, ['BAJO', 'MEDIO', 'ALTO'][risk + 1] AS level, event, points / 10.0 + humidity / 1000 AS score, year >= 2001 AS is_active
FROM risk"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = risk(spark, sf)
    points = (F.when(F.col("spi") < -1.5, 3).when(F.col("spi") < -1.0, 2).when(F.col("spi") < -0.5, 1).otherwise(0)
              + F.when(F.col("spi") > 1.5, 2).when(F.col("spi") > 1.0, 1).otherwise(0)
              + F.when(F.abs("rain_anomaly_pct") > 50, 2).when(F.abs("rain_anomaly_pct") > 25, 1).otherwise(0)
              + F.when(F.col("temp_max") > 38, 2).when(F.col("temp_max") > 35, 1).otherwise(0)
              + F.when(F.col("phase").isin(K.ENSO_EL_NINO, K.ENSO_LA_NINA), 1).otherwise(0))
    return rows.select("town_id", "year", "month", R.risk_label(F.col("risk")).alias("level"), "event",
                       (points / 10.0 + F.col("humidity") / 1000).alias("score"), (F.col("year") >= 2001).alias("is_active"))


# --- inputs, predictions, logs ------------------------------------------------------------------------
CTES["inputs"] = """
SELECT p_type AS input_name, n_regionkey AS region_id, YEAR(l_shipdate) AS year, MONTH(l_shipdate) AS month,
       AVG(p_retailprice * (1 + l_tax)) AS price
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
GROUP BY ALL"""
CTES["predictions"] = """
SELECT *, predicted * 0.8 AS low, predicted * 1.2 AS high, ABS(yield_t_ha - predicted) AS anomaly_score,
       ABS(yield_t_ha - predicted) > predicted AS is_anomaly, year >= 2000 AS is_holdout
FROM (SELECT town_id, crop_id, year, yield_t_ha,
             AVG(yield_t_ha) OVER (PARTITION BY town_id, crop_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted
      FROM harvest) WHERE predicted IS NOT NULL"""
CTES["runs"] = """
SELECT event_id, event_type AS source, ts AS started_at, ts + INTERVAL 5 MINUTE AS finished_at,
       CASE WHEN value > 30 THEN 'error' ELSE 'ok' END AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS new_rows,
       CAST(ts AS DATE) AS max_day
FROM events"""
CTES["models"] = """
SELECT event_id AS id_version, event_type AS model_name, ts AS trained_at, value AS mae FROM events"""


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_tax")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .groupBy(F.col("p_type").alias("input_name"), F.col("n_regionkey").alias("region_id"),
                     F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
            .agg(F.avg(F.col("p_retailprice") * (1 + F.col("l_tax"))).alias("price")))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The history mean as a stand-in prediction, so that its consumers can be checked with SQL."""
    rows = harvest(spark, sf).select("town_id", "crop_id", "year", "yield_t_ha").withColumn(
        "predicted", W.prior_mean(["town_id", "crop_id"], "year", "yield_t_ha")).where(F.col("predicted").isNotNull())
    gap = F.abs(F.col("yield_t_ha") - F.col("predicted"))
    return rows.withColumns({
        "low": F.col("predicted") * 0.8, "high": F.col("predicted") * 1.2, "anomaly_score": gap,
        "is_anomaly": gap > F.col("predicted"), "is_holdout": F.col("year") >= 2000})


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("source"), F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTE")).alias("finished_at"),
        F.when(F.col("value") > 30, "error").otherwise("ok").alias("status"),
        F.get_json_object("props", "$.k").try_cast("long").alias("new_rows"), F.to_date("ts").alias("max_day"))


def models(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id_version"), F.col("event_type").alias("model_name"), F.col("ts").alias("trained_at"),
        F.to_json(F.struct(F.col("value").alias("mae"), F.struct((F.col("value") / 2).alias("rmse")).alias("test"))).alias("metrics_json"))
