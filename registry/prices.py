"""Price queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from cropspark.operators import windows as W
from cropspark.plans import prices as P
from cropspark.plans import report as RP
from registry import standins as S
from registry.base import CTES, ORACLE, query

REPORT_DAY = date(1998, 8, 23)

CTES["changes"] = """
SELECT d.*, (SELECT MAX_BY(p.price_avg, p.day) FROM daily p WHERE p.market_id = d.market_id AND p.product_id = d.product_id AND p.day < d.day) AS previous,
       (SELECT MAX(p.day) FROM daily p WHERE p.market_id = d.market_id AND p.product_id = d.product_id AND p.day < d.day) AS previous_day,
       (SELECT MAX_BY(p.price_avg, p.day) FROM daily p WHERE p.market_id = d.market_id AND p.product_id = d.product_id AND p.day <= d.day - 7) AS week_ago
FROM daily d"""
CTES["latest_daily"] = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY market_id, product_id ORDER BY day DESC) AS rn FROM daily) WHERE rn = 1"""
CTES["current_prices"] = """
SELECT c.market_id, market, department, c.product_id, product, product_group, c.day, c.price_min, c.price_max, c.price_avg,
       previous, previous_day, CASE WHEN previous > 0 THEN (c.price_avg - previous) / previous * 100 END AS change_day_pct,
       week_ago, CASE WHEN week_ago > 0 THEN (c.price_avg - week_ago) / week_ago * 100 END AS change_week_pct,
       DATE '2001-12-31' - c.day AS days_late
FROM changes c JOIN latest_daily l USING (market_id, product_id, day)
JOIN markets m ON m.market_id = c.market_id JOIN products p ON p.product_id = c.product_id"""
AS_OF = date(2001, 12, 31)


def current(spark, sf):
    return P.current_price(S.daily(spark, sf), S.markets(spark, sf), S.products(spark, sf), F.lit(AS_OF))


CURRENT_COLUMNS = {
    "market_id": "i", "market": "s", "department": "s", "product_id": "s", "product": "s", "product_group": "s", "day": "d",
    "price_avg": "f", "price_min": "f", "price_max": "f", "previous": "f", "previous_day": "d", "change_day_pct": "f",
    "week_ago": "f", "change_week_pct": "f", "days_late": "i"}


@query("current_price", CURRENT_COLUMNS, "SELECT * FROM current_prices")
def _(spark, sf):
    return current(spark, sf)


@query("price_list_sparkline",
       {"market_id": "i", "product_id": "s", "market": "s", "product": "s", "day": "d", "price_avg": "f", "change_day_pct": "f",
        "n_recent": "n", "recent_prices": "s"},
       """
SELECT c.*, n_recent, recent_prices FROM current_prices c LEFT JOIN (
  SELECT market_id, product_id, COUNT(*) AS n_recent,
         STRING_AGG(CAST(CAST(FLOOR(price_avg * 10 + 0.50001) AS BIGINT) AS VARCHAR), ' ' ORDER BY day) AS recent_prices
  FROM daily WHERE day > DATE '2001-12-31' - 240 AND day <= DATE '2001-12-31' GROUP BY ALL) r
  ON r.market_id = c.market_id AND r.product_id = c.product_id
WHERE department = 'ASIA' AND days_late <= 120""")
def _(spark, sf):
    rows = P.price_list(current(spark, sf), S.daily(spark, sf), AS_OF, department="ASIA", max_days_late=120, history_days=240)
    tenths = F.transform("recent_prices", lambda p: F.floor(p * 10 + 0.50001).cast("string"))
    return rows.withColumns({"n_recent": F.size("recent_prices"), "recent_prices": F.array_join(tenths, " ")})


@query("price_filters", {"kind": "s", "value": "s", "place": "i"}, """
SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY value) AS place FROM (SELECT DISTINCT kind, value FROM (
  SELECT 'department' AS kind, department AS value, days_late FROM current_prices
  UNION ALL SELECT 'market', market, days_late FROM current_prices
  UNION ALL SELECT 'product', product, days_late FROM current_prices) WHERE days_late <= 60 AND value IS NOT NULL)""")
def _(spark, sf):
    return P.price_filters(current(spark, sf), 60)


@query("price_lookup", {"market": "s", "product": "s", "day": "d", "price_avg": "f"}, """
SELECT * FROM current_prices WHERE product ILIKE '%brand#1%' OR market ILIKE '%brand#1%' OR department ILIKE '%brand#1%'
ORDER BY day DESC, product, market LIMIT 15""")
def _(spark, sf):
    return P.price_lookup(current(spark, sf), "brand#1")


@query("asof_prev_and_7d", {"market_id": "i", "product_id": "s", "day": "d", "price_avg": "f", "previous": "f", "week_ago": "f",
                            "change_day_pct": "f", "change_week_pct": "f"}, """
SELECT d.market_id, d.product_id, d.day, d.price_avg, p.price_avg AS previous, w.price_avg AS week_ago,
       CASE WHEN p.price_avg > 0 THEN (d.price_avg - p.price_avg) / p.price_avg * 100 END AS change_day_pct,
       CASE WHEN w.price_avg > 0 THEN (d.price_avg - w.price_avg) / w.price_avg * 100 END AS change_week_pct
FROM daily d
LEFT JOIN daily p ON p.market_id = d.market_id AND p.product_id = d.product_id AND p.day =
  (SELECT MAX(x.day) FROM daily x WHERE x.market_id = d.market_id AND x.product_id = d.product_id AND x.day < d.day AND x.day >= d.day - 20)
LEFT JOIN daily w ON w.market_id = d.market_id AND w.product_id = d.product_id AND w.day =
  (SELECT MAX(x.day) FROM daily x WHERE x.market_id = d.market_id AND x.product_id = d.product_id AND x.day <= d.day - 7 AND x.day >= d.day - 40)""")
def _(spark, sf):
    return P.with_changes(S.daily(spark, sf), previous_max_age=20, week_max_age=40)


@query("series_summary", {"market_id": "i", "product_id": "s", "first_value": "f", "last_value": "f", "min_value": "f",
                          "max_value": "f", "n_days": "i", "change_pct": "f"}, """
SELECT market_id, product_id, MIN_BY(price_avg, day) AS first_value, MAX_BY(price_avg, day) AS last_value,
       MIN(price_avg) AS min_value, MAX(price_avg) AS max_value, COUNT(*) AS n_days,
       (MAX_BY(price_avg, day) - MIN_BY(price_avg, day)) / MIN_BY(price_avg, day) * 100 AS change_pct
FROM daily GROUP BY market_id, product_id""")
def _(spark, sf):
    return W.series_summary(S.daily(spark, sf), P.SERIES, "day", "price_avg")


@query("price_series_with_forecast", {"market_id": "i", "product_id": "s", "day": "d", "kind": "s", "price": "f", "p10": "f", "p90": "f"}, """
SELECT market_id, product_id, day, 'observed' AS kind, price_avg AS price, NULL AS p10, NULL AS p90 FROM daily WHERE day >= DATE '2001-06-01'
UNION ALL SELECT market_id, product_id, day + 1, 'forecast', price_avg, price_min, price_max FROM latest_daily""")
def _(spark, sf):
    from cropspark.operators.ranking import latest_per_key

    daily = S.daily(spark, sf)
    naive = latest_per_key(daily, P.SERIES, ["day"]).select(
        *P.SERIES, F.date_add("day", 1).alias("target_day"), F.col("price_avg").alias("price"),
        F.col("price_min").alias("p10"), F.col("price_max").alias("p90"))
    return P.price_series(daily, naive, date(2001, 6, 1))


@query("series_quality", {"market_id": "i", "product_id": "s", "market": "s", "department": "s", "product": "s", "product_group": "s", "first_day": "d", "last_day": "d", "n_days": "i",
                          "error_model_pct": "f1", "error_today_pct": "f1", "improvement_pct": "f1", "n_tests": "i"}, """
WITH steps AS (SELECT product_id, price_avg, LAG(price_avg) OVER w AS a, LAG(price_avg, 2) OVER w AS b FROM daily WINDOW w AS (PARTITION BY market_id, product_id ORDER BY day)),
e AS (SELECT product_id, AVG(ABS(LN(price_avg) - LN((a + b) / 2))) AS m, AVG(ABS(LN(price_avg) - LN(a))) AS n, COUNT(*) AS tests FROM steps WHERE b IS NOT NULL AND product_id <> 'Brand#1' GROUP BY product_id)
SELECT d.*, market, department, product, product_group, FLOOR(m * 1000 + 0.5) / 10 AS error_model_pct, FLOOR(n * 1000 + 0.5) / 10 AS error_today_pct, FLOOR((1 - m / n) * 1000 + 0.5) / 10 AS improvement_pct, tests AS n_tests
FROM (SELECT market_id, product_id, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS n_days FROM daily GROUP BY ALL) d
JOIN markets USING (market_id) JOIN products USING (product_id) LEFT JOIN e USING (product_id)""")
def _(spark, sf):
    """Names, span and backtest of every series; the mean of the last two days stands in for a forecast, and one product was never tested."""
    from pyspark.sql import Window

    daily = S.daily(spark, sf)
    by = Window.partitionBy(*P.SERIES).orderBy("day")
    steps = daily.select("product_id", "price_avg", F.lag("price_avg").over(by).alias("a"), F.lag("price_avg", 2).over(by).alias("b")).where(F.col("b").isNotNull() & (F.col("product_id") != "Brand#1"))
    errors = steps.groupBy("product_id").agg(
        F.avg(F.abs(F.log("price_avg") - F.log((F.col("a") + F.col("b")) / 2))).alias("mae_model"), F.avg(F.abs(F.log("price_avg") - F.log("a"))).alias("mae_naive"), F.count(F.lit(1)).alias("n"))
    return P.series_quality(daily, errors, S.markets(spark, sf), S.products(spark, sf))


@query("price_state", {"max_day": "d", "delay_bdays": "i", "state": "s"}, """
SELECT max_day, delay_bdays, CASE WHEN delay_bdays IS NULL THEN 'sin_datos' WHEN delay_bdays <= 1 THEN 'al_dia'
  WHEN delay_bdays = 2 THEN 'retrasado' ELSE 'desactualizado' END AS state
FROM (SELECT max_day, LEN(LIST_FILTER(GENERATE_SERIES(max_day + INTERVAL 1 DAY, TIMESTAMP '2001-12-31', INTERVAL 1 DAY), lambda x: ISODOW(x) < 6)) AS delay_bdays
      FROM (SELECT CAST(MAX(day) AS TIMESTAMP) AS max_day FROM daily)) s""".replace("SELECT max_day, delay_bdays, CASE", "SELECT CAST(max_day AS DATE) AS max_day, delay_bdays, CASE"))
def _(spark, sf):
    return P.price_state(S.daily(spark, sf), F.lit(AS_OF))


@query("annual_price_stats", {"year": "i", "crop_id": "s", "price_mean": "f", "price_std": "f"}, """
SELECT YEAR(day) AS year, product_group AS crop_id, AVG(price_avg) AS price_mean, STDDEV_SAMP(price_avg) AS price_std
FROM daily JOIN products USING (product_id) GROUP BY ALL""")
def _(spark, sf):
    links = S.products(spark, sf).select("product_id", F.col("product_group").alias("crop_id"))
    return P.annual_prices(S.daily(spark, sf), links)


@query("monthly_price_rollup", {"market": "i", "town_id": "s", "product_key": "s", "year": "i", "month": "i", "price": "f", "volume": "f"}, """
SELECT s_nationkey AS market, CASE WHEN s_acctbal > 1000 THEN n_name END AS town_id, p_brand AS product_key,
       YEAR(l_shipdate) AS year, MONTH(l_shipdate) AS month, AVG(l_extendedprice / l_quantity) AS price,
       SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS volume
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def _(spark, sf):
    from registry.base import table

    line, supplier, part, nation = (table(spark, sf, t) for t in ("lineitem", "supplier", "part", "nation"))
    rows = (line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(F.col("s_nationkey").alias("market"),
                    F.when(F.col("s_acctbal") > 1000, F.col("n_name")).alias("town_id"),
                    F.col("p_brand").alias("product_key"), F.year("l_shipdate").alias("year"),
                    F.month("l_shipdate").alias("month"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                    F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("volume")))
    return P.monthly_prices(rows)


# --- daily report -------------------------------------------------------------------------------------
CTES["report_window"] = """
SELECT r.*, (SELECT MAX_BY(x.price_avg, x.day) FROM report_prices x WHERE x.market_id = r.market_id AND x.product_id = r.product_id
               AND x.day < r.day AND x.day >= r.day - 5) AS previous,
       (SELECT MAX_BY(x.price_avg, x.day) FROM report_prices x WHERE x.market_id = r.market_id AND x.product_id = r.product_id
               AND x.day <= r.day - 7 AND x.day >= r.day - 14) AS week_ago
FROM report_prices r WHERE r.day = DATE '1998-08-23'"""
CTES["report_rows"] = """
SELECT *, (price_avg - previous) / previous * 100 AS change_day_pct, (price_avg - week_ago) / week_ago * 100 AS change_week_pct
FROM report_window"""


def base(spark, sf):
    return RP.report_base(S.report_prices(spark, sf), REPORT_DAY)


@query("coverage", {"active_series": "i", "series_with_data": "i", "active_markets": "i", "markets_with_data": "i"}, """
SELECT COUNT(DISTINCT (market_id, product_id)) AS active_series, COUNT(DISTINCT CASE WHEN day = DATE '1998-08-23' THEN (market_id, product_id) END) AS series_with_data,
       COUNT(DISTINCT market_id) AS active_markets, COUNT(DISTINCT CASE WHEN day = DATE '1998-08-23' THEN market_id END) AS markets_with_data
FROM report_prices WHERE day BETWEEN DATE '1998-08-23' - 30 AND DATE '1998-08-23'""")
def _(spark, sf):
    return RP.coverage(S.report_prices(spark, sf), REPORT_DAY)


def _mover_sql(name: str, change: str, reference: str, rising: bool) -> str:
    sign, order = (">", "DESC") if rising else ("<", "ASC")
    return (f"(SELECT '{name}' AS list, product, market, department, ROUND_EVEN(price_avg, 0) AS price, ROUND_EVEN({reference}, 0) AS before, "
            f"ROUND_EVEN({change}, 1) AS change_pct FROM report_rows WHERE {change} {sign} 0 ORDER BY {change} {order}, product, market LIMIT 8)")


MOVER_COLUMNS = {"list": "s", "product": "s", "market": "s", "department": "s", "price": "f1", "before": "f1", "change_pct": "f1"}


@query("movers_day", MOVER_COLUMNS, " UNION ALL ".join([
    _mover_sql("rises_day", "change_day_pct", "previous", True), _mover_sql("falls_day", "change_day_pct", "previous", False)]))
def _(spark, sf):
    return RP.all_movers(base(spark, sf)).where(F.col("list").endswith("_day"))


@query("movers_7d", MOVER_COLUMNS, " UNION ALL ".join([
    _mover_sql("rises_week", "change_week_pct", "week_ago", True), _mover_sql("falls_week", "change_week_pct", "week_ago", False)]))
def _(spark, sf):
    return RP.all_movers(base(spark, sf)).where(F.col("list").endswith("_week"))


@query("market_gap", {"product": "s", "n_markets": "i", "median": "f", "cheapest_market": "s", "cheapest_price": "f",
                      "dearest_market": "s", "dearest_price": "f", "gap_pct": "f"}, """
SELECT product, COUNT(DISTINCT market_id) AS n_markets, MEDIAN(price_avg) AS median, ARG_MIN(market, (price_avg, market)) AS cheapest_market,
       MIN(price_avg) AS cheapest_price, ARG_MAX(market, (price_avg, market)) AS dearest_market, MAX(price_avg) AS dearest_price,
       (MAX(price_avg) - MIN(price_avg)) / MIN(price_avg) * 100 AS gap_pct
FROM report_rows GROUP BY product HAVING COUNT(DISTINCT market_id) >= 3""")
def _(spark, sf):
    return RP.market_gap(base(spark, sf))


@query("department_summary", {"department": "s", "series": "i", "median_day_pct": "f", "median_week_pct": "f", "rising": "i", "falling": "i"}, """
SELECT department, COUNT(*) AS series, MEDIAN(change_day_pct) AS median_day_pct, MEDIAN(change_week_pct) AS median_week_pct,
       COUNT(*) FILTER (WHERE change_day_pct > 0) AS rising, COUNT(*) FILTER (WHERE change_day_pct < 0) AS falling
FROM report_rows WHERE department IS NOT NULL GROUP BY department""")
def _(spark, sf):
    return RP.departments(base(spark, sf))


@query("zscore_outliers", {"product": "s", "market": "s", "department": "s", "price_avg": "f", "z": "f", "prior_mean": "f"}, """
SELECT * FROM (
  SELECT *, (price_avg - prior_mean) / prior_std AS z FROM (
    SELECT *, AVG(price_avg) OVER w AS prior_mean, STDDEV_SAMP(price_avg) OVER w AS prior_std, COUNT(price_avg) OVER w AS prior_n
    FROM report_prices WHERE day BETWEEN DATE '1998-08-23' - 45 AND DATE '1998-08-23'
    WINDOW w AS (PARTITION BY market_id, product_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
  WHERE day = DATE '1998-08-23' AND prior_n >= 10 AND prior_std > 0)
WHERE ABS(z) >= 3 ORDER BY ABS(z) DESC, product, market LIMIT 10""")
def _(spark, sf):
    return RP.outliers(base(spark, sf))


# The document's lists, by the SQL of each; the document itself is taken apart again for the comparison.
DOCUMENT_SQL = f"""
SELECT 'coverage' AS list, NULL AS name, NULL AS place, series_with_data AS value FROM ({ORACLE["coverage"]})
UNION ALL SELECT list, product, market, change_pct FROM ({ORACLE["movers_day"]})
UNION ALL SELECT list, product, market, change_pct FROM ({ORACLE["movers_7d"]})
UNION ALL SELECT 'market_gap', product, cheapest_market, gap_pct FROM ({ORACLE["market_gap"]})
UNION ALL SELECT 'departments', department, NULL, series FROM ({ORACLE["department_summary"]})
UNION ALL SELECT 'outliers', product, market, z FROM ({ORACLE["zscore_outliers"]})"""


@query("report_document", {"day": "d", "list": "s", "name": "s", "place": "s", "value": "f3"}, f"SELECT DATE '1998-08-23' AS day, q.* FROM ({DOCUMENT_SQL}) q")
def _(spark, sf):
    moved = "ARRAY<STRUCT<product: STRING, market: STRING, change_pct: DOUBLE>>"
    schema = ("coverage STRUCT<series_with_data: LONG>, " + ", ".join(f"{n} {moved}" for n in ("rises_day", "falls_day", "rises_week", "falls_week"))
              + ", market_gap ARRAY<STRUCT<product: STRING, cheapest_market: STRING, gap_pct: DOUBLE>>, departments ARRAY<STRUCT<department: STRING, series: LONG>>"
              + ", outliers ARRAY<STRUCT<product: STRING, market: STRING, z: DOUBLE>>")
    doc = RP.report_document(S.report_prices(spark, sf), REPORT_DAY).select("day", F.from_json("payload", schema).alias("p")).select("day", "p.*")
    shape = "array<struct<list:string,name:string,place:string,value:double>>"
    none = F.lit(None).cast("string")

    def rows(name, *fields):
        return F.transform(name, lambda x: F.struct(F.lit(name).alias("list"), *[(x[f] if f else none).alias(c) for f, c in zip(fields[:2], ("name", "place"))], x[fields[2]].cast("double").alias("value"))).cast(shape)

    movers = [rows(n, "product", "market", "change_pct") for n in ("rises_day", "falls_day", "rises_week", "falls_week")]
    seen = F.array(F.struct(F.lit("coverage").alias("list"), none.alias("name"), none.alias("place"), F.col("coverage.series_with_data").cast("double").alias("value"))).cast(shape)
    every = F.concat(seen, *movers, rows("market_gap", "product", "cheapest_market", "gap_pct"), rows("departments", "department", None, "series"), rows("outliers", "product", "market", "z"))
    return doc.select("day", F.explode(every).alias("r")).select("day", "r.*")


@query("report_pending", {"day": "d", "generated_at": "t", "last_change": "t", "pending": "b"}, """
SELECT m.day, r.generated_at, c.last_change, r.generated_at IS NULL OR COALESCE(c.last_change > r.generated_at, FALSE) AS pending
FROM (SELECT MAX(CAST(ts AS DATE)) AS day FROM events) m
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, MAX(ts) AS generated_at FROM events WHERE event_type = 'view' GROUP BY ALL) r USING (day)
CROSS JOIN (SELECT MAX(finished_at) AS last_change FROM runs WHERE status = 'ok' AND new_rows > 0 AND source IN ('click', 'purchase')) c""")
def _(spark, sf):
    runs = S.runs(spark, sf)
    reports = runs.where(F.col("source") == "view").groupBy(F.col("max_day").alias("day")).agg(F.max("started_at").alias("generated_at"))
    return RP.report_pending(runs.select(F.col("max_day").alias("day")), reports, runs, ["click", "purchase"])


@query("report_dates", {"day": "d", "is_latest": "b"}, """
SELECT day, day = MAX(day) OVER () AS is_latest FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events ORDER BY day DESC LIMIT 30)""")
def _(spark, sf):
    days = S.runs(spark, sf).select(F.col("max_day").alias("day")).distinct()
    latest = RP.report_for(days).select("day", F.lit(True).alias("is_latest"))
    return RP.report_dates(days).join(latest, "day", "left").withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


# --- freshness ----------------------------------------------------------------------------------------
@query("freshness", {"key": "s", "detail": "s"}, """
WITH notices AS (
  SELECT 'prices_late' AS key, 'last price ' || d || ', ' || late || ' business days late' AS detail
  FROM (SELECT d, LEN(LIST_FILTER(GENERATE_SERIES(CAST(d AS TIMESTAMP), TIMESTAMP '2024-02-08', INTERVAL 1 DAY), lambda x: ISODOW(x) < 6)) AS late
        FROM (SELECT MAX(max_day) AS d FROM runs)) WHERE late > 3
  UNION ALL
  SELECT source || '_late', 'last good run ' || strftime(MAX(finished_at), '%Y-%m-%d') FROM runs
  WHERE status = 'ok' AND source IN ('click', 'error', 'purchase') GROUP BY source
  HAVING MAX(finished_at) < TIMESTAMP '2024-02-09 12:00:00' - INTERVAL 10 DAY)
SELECT * FROM notices""")
def _(spark, sf):
    runs = S.runs(spark, sf)
    return P.run_freshness(runs, runs.select(F.col("max_day").alias("day")), datetime(2024, 2, 9, 12), ["click", "error", "purchase"])
