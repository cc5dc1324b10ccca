"""Source formats. Spark turns the driver's tables into documents of each format, and the parsers read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropspark.functions import dates as D
from cropspark.plans import climate as CL
from cropspark.plans import prices as P
from cropspark.sources import parsers as X
from registry import standins as S
from registry.base import CTES, query, table

CTES["customer_days"] = """
SELECT o_custkey AS station_id, YEAR(o_orderdate) AS year, CAST(o_orderdate AS DATE) AS day, MAX(o_totalprice) AS hi, MIN(o_totalprice) AS lo
FROM orders GROUP BY ALL"""


def customer_days(spark, sf):
    return table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day")).agg(
        F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))


@query("parse_grid_days", {"station_id": "i", "day": "d", "temp_max": "f", "temp_min": "f", "rain_mm": "f"}, """
SELECT station_id, day, CASE WHEN hi > 60000 THEN hi END AS temp_max, lo AS temp_min, NULL AS rain_mm FROM customer_days""")
def _(spark, sf):
    """At most the days of a year in one document."""
    days = customer_days(spark, sf)
    key = F.date_format("day", "yyyyMMdd")
    pairs = lambda v: F.map_from_entries(F.collect_list(F.struct(key, v)))
    docs = days.groupBy("station_id", "year").agg(F.to_json(F.struct(F.struct(F.struct(
        pairs(F.when(F.col("hi") > 60000, F.col("hi")).otherwise(-999.0)).alias("T2M_MAX"), pairs(F.col("lo")).alias("T2M_MIN")
    ).alias("parameter")).alias("properties"))).alias("document"))
    return X.grid_days(docs, ["station_id"], "document")


@query("parse_station_days", {"station_id": "i", "year": "i", "month": "i", "temp_mean": "f", "temp_max": "f", "sun_hours": "f"}, """
SELECT station_id, year, MONTH(day) AS month, AVG(lo) AS temp_mean, AVG(CASE WHEN hi > 60000 THEN hi END) AS temp_max, AVG(hi) / 3600 AS sun_hours FROM customer_days GROUP BY ALL""")
def _(spark, sf):
    days = customer_days(spark, sf)
    rows = F.array_sort(F.collect_list(F.struct(
        "day", F.col("lo").alias("mean"), F.when(F.col("hi") > 60000, F.col("hi")).alias("max"), F.col("hi").alias("sun"))))
    docs = days.groupBy("station_id", "year").agg(rows.alias("r"))
    column = lambda c: F.transform("r", lambda x: x[c])
    docs = docs.select("station_id", F.to_json(F.struct(F.struct(
        F.transform("r", lambda x: x["day"].cast("string")).alias("time"), column("mean").alias("temperature_2m_mean"),
        column("max").alias("temperature_2m_max"), column("mean").alias("temperature_2m_min"),
        column("mean").alias("relative_humidity_2m_mean"), column("sun").alias("sunshine_duration")).alias("daily")),
        {"ignoreNullFields": "false"}).alias("document"))
    return CL.daily_to_monthly(X.station_days(docs, ["station_id"], "document"))


@query("parse_indicators", {"indicator_id": "s", "indicator_name": "s", "year": "i", "value": "f"}, """
SELECT CAST(c_nationkey AS VARCHAR) AS indicator_id, n_name AS indicator_name, YEAR(o_orderdate) AS year, AVG(o_totalprice) AS value
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def _(spark, sf):
    """At most one entry per year in one document."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    yearly = (orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
              .groupBy(F.col("c_nationkey").cast("string").alias("id"), "n_name", F.year("o_orderdate").cast("string").alias("date"))
              .agg(F.avg("o_totalprice").alias("value")))
    row = F.struct(F.struct("id", F.col("n_name").alias("value")).alias("indicator"), "date", "value")
    docs = yearly.groupBy("id").agg(F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list(row)), F.lit("]")).alias("document"))
    return X.indicator_values(docs, "document")


@query("parse_crop_statistics", {"crop": "s", "element": "s", "year": "i", "value": "f"}, """
SELECT crop_id AS crop, 'Yield' AS element, year, yield_t_ha AS value FROM harvest""")
def _(spark, sf):
    """One document per town and year: at most one entry per crop."""
    rows = S.harvest(spark, sf).select("town_id", F.lit("Colombia").alias("Area"), F.col("crop_id").alias("Item"), F.lit("Yield").alias("Element"),
                                       F.col("year").cast("string").alias("Year"), F.col("yield_t_ha").cast("string").alias("Value"))
    docs = rows.groupBy("town_id", "Year").agg(F.to_json(F.struct(F.collect_list(
        F.struct("Area", "Item", "Element", "Year", "Value")).alias("data"))).alias("document"))
    return X.crop_statistics(docs, "document")


@query("parse_layers", {"crop": "s", "town_id": "s", "suitability": "s"}, """
SELECT crop_id AS crop, LPAD(CAST(town_id AS VARCHAR), 5, '0') AS town_id, COALESCE(NULLIF(suitability, 'no_apta'), 'Exclusion legal') AS suitability FROM suitability""")
def _(spark, sf):
    """One document per crop: at most one entry per town."""
    rows = S.suitability(spark, sf)
    text = F.coalesce(F.nullif("suitability", F.lit("no_apta")), F.lit("Exclusión legal"))
    entry = F.struct(F.struct(F.col("town_id").cast("string").alias("cod_dane_mpio"), text.alias("aptitud")).alias("attributes"))
    docs = rows.groupBy("crop_id").agg(F.to_json(F.struct(F.collect_list(entry).alias("features"))).alias("document"))
    return X.layer_attributes(docs, "document", F.col("crop_id"))


@query("parse_index_lines", {"year": "i", "month": "i", "oni": "f2", "phase": "s"}, """
SELECT year, month, ROUND(oni, 2) AS oni, CASE WHEN ROUND(oni, 2) >= 0.5 THEN 'El Niño' WHEN ROUND(oni, 2) <= -0.5 THEN 'La Niña' ELSE 'Neutral' END AS phase
FROM oni WHERE year BETWEEN 1996 AND 2000""")
def _(spark, sf):
    lines = S.oni(spark, sf).select(F.format_string("%6d  %3d   26.50 26.10   %.2f ", "year", "month", F.round("oni", 2)).alias("value"))
    header = lines.limit(1).select(F.lit("  YR   MON  TOTAL  CLIM   ANOM").alias("value"))
    return X.index_lines(lines.unionByName(header), "value", 1996, 2000)


@query("parse_price_xml", {"day": "d", "market": "s", "product": "s", "product_key": "s", "department": "s", "town_id": "s", "price_min": "f", "price_max": "f",
                           "price_avg": "f", "source": "s"}, """
SELECT day, market, 'Product ' || product_id AS product, UPPER('Product ' || product_id) AS product_key, CASE department WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE UPPER(department[1:1]) || LOWER(department[2:]) END AS department,
       LPAD(CAST(d.market_id AS VARCHAR), 5, '0') AS town_id, CASE WHEN price_min <= price_avg THEN price_min END AS price_min,
       CASE WHEN price_max >= price_avg THEN price_max END AS price_max, price_avg, 'soap' AS source
FROM daily d JOIN markets USING (market_id) WHERE day >= DATE '1997-03-01' AND price_avg <= 200000""")
def _(spark, sf):
    rows = S.daily(spark, sf).join(S.markets(spark, sf), "market_id")
    text = lambda c: F.col(c).cast("string")
    records = rows.select(F.to_xml(F.struct(
        F.concat(F.lit("product  "), "product_id", F.lit(" *")).alias("artiNombre"), F.lit("FRUTAS").alias("grupNombre"),
        F.upper("department").alias("deptNombre"), F.lpad(text("market_id"), 5, "0").alias("muniId"), F.col("market").alias("muniNombre"),
        F.col("market").alias("fuenNombre"), F.concat(F.col("day").cast("string"), F.lit("T00:00:00-05:00")).alias("enmaFecha"),
        text("price_min").alias("minimoKg"), text("price_max").alias("maximoKg"), text("price_avg").alias("promedioKg"))).alias("xml"))
    return P.normalise_feed(X.price_records(records, "xml", since="1997-03-01"))


@query("parse_bulletins", {"day": "d", "market": "s", "product": "s", "price_avg": "f", "source": "s"}, """
SELECT day, market, 'Type ' || LOWER(product) AS product, price_avg, 'excel' AS source FROM report_prices WHERE price_avg <= 200000""")
def _(spark, sf):
    """One bulletin per day: markets across, products down. A page is bounded by markets times products."""
    prices = S.report_prices(spark, sf)
    names = [r.market for r in S.markets(spark, sf).select("market").orderBy("market").collect()]  # the page's columns
    wide = prices.withColumn("price", F.col("price_avg").cast("string")).groupBy("day", "product").pivot("market", names).agg(F.max("price"))
    cells = [F.lit(x) for n in names for x in (n, None)]
    body = wide.select(F.col("day").cast("string").alias("file"), F.dense_rank().over(_page()).alias("r"), F.array(
        F.concat(F.lit("type  "), F.lower("product"), F.lit("*")), *[x for n in names for x in (F.coalesce(F.col(n), F.lit("n.d.")), F.lit("0.1"))]).alias("cells"))
    title = F.concat(F.lit("Lunes "), F.day("day").cast("string"), F.lit(" de "), F.lower(D.month_name_es(F.month("day"))), F.lit(" de "), F.year("day").cast("string"))
    heads = prices.select("day").distinct().select(F.col("day").cast("string").alias("file"), F.explode(F.array(
        F.struct(F.lit(1).alias("row"), F.array(title).alias("cells")),
        F.struct(F.lit(2).alias("row"), F.array(F.lit("Precio"), *[c.cast("string") for c in cells]).alias("cells")))).alias("h")).select("file", "h.*")
    sheets = heads.unionByName(body.select("file", (F.col("r") + 3).alias("row"), "cells"))
    return P.normalise_bulletin(X.bulletin_to_long(sheets))


def _page():
    from pyspark.sql import Window

    return Window.partitionBy("day").orderBy("product")


@query("parse_land_use", {"town_id": "s", "census_year": "i", "pasture_ha": "f", "fallow_ha": "f", "agricultural_ha": "f", "infrastructure_ha": "f"}, """
SELECT LPAD(CAST(c_custkey AS VARCHAR), 5, '0') AS town_id, 2014 AS census_year, c_acctbal AS pasture_ha, NULL AS fallow_ha, c_acctbal / 2 AS agricultural_ha, c_nationkey AS infrastructure_ha
FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def _(spark, sf):
    code = F.when(F.col("c_mktsegment") == "BUILDING", "Total").otherwise(F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    cells = table(spark, sf, "customer").select(F.array(
        F.lit("05"), F.lit("x"), code, "c_name", F.col("c_acctbal").cast("string"), F.lit("-"), (F.col("c_acctbal") / 2).cast("string"),
        F.col("c_nationkey").cast("string")).alias("cells"))
    return X.land_use(cells, 2014)


#: What each type of part plays: a sub-group's sheet and its kind; the sub-group of LARGE belongs to livestock.
INPUT_SHEETS = {
    "ECONOMY": ("1.2. Fungicidas", "agroquimico"), "STANDARD": ("1.3. Herbicidas", "agroquimico"), "SMALL": ("1.7. Material de propagación", "semilla"),
    "MEDIUM": ("1.8. Bioinsumos", "bioinsumo"), "PROMO": ("1.1. Fertilizantes, enmiendas y acondicionadores de suelo", "fertilizante"), "LARGE": ("2.1. Antibióticos", None)}
#: A department of each region.
REGION_CODES = [("'05", "Andina"), ("8", "Caribe"), ("19", "Pacífico"), ("18", "Amazonía"), ("'50", "Orinoquía")]
_SHEETS = ", ".join(f"('{k}', '{t.split('. ', 1)[1]}', '{kind}')" for k, (t, kind) in INPUT_SHEETS.items() if kind)
_CODES = ", ".join(f"({i}, '{r}')" for i, (_, r) in enumerate(REGION_CODES))


@query("parse_input_sheets", {"year": "i", "month": "i", "region": "s", "kind": "s", "subgroup": "s", "price": "f"}, f"""
SELECT year, month, region, kind, subgroup, AVG(price) AS price
FROM inputs JOIN (VALUES {_SHEETS}) s(input_name, subgroup, kind) USING (input_name) JOIN (VALUES {_CODES}) r(region_id, region) USING (region_id) GROUP BY ALL""")
def _(spark, sf):
    """One sheet per sub-group; the sheet of a livestock group is dropped."""
    names = F.create_map(*[F.lit(x) for k, (t, _) in INPUT_SHEETS.items() for x in (k, t)])
    rows = S.inputs(spark, sf).withColumn("title", F.try_element_at(names, F.col("input_name")))
    code = F.get(F.array(*[F.lit(c) for c, _ in REGION_CODES]), F.col("region_id"))
    body = rows.select(F.col("input_name").alias("file"), (F.lit(20) + F.col("year") * 12 + F.col("month")).alias("row"), F.array(
        F.col("year").cast("string"), D.month_name_es(F.col("month")), F.lit("x"), code, F.col("price").cast("string")).alias("cells"))
    heads = rows.select(F.col("input_name").alias("file"), "title").distinct().select("file", F.explode(F.array(
        F.struct(F.lit(3).alias("row"), F.array("title").alias("cells")),
        F.struct(F.lit(7).alias("row"), F.array(*[F.lit(x) for x in ("Año", "Mes ", "Nombre", "Código departamento", "Precio promedio")]).alias("cells")))).alias("h")).select("file", "h.*")
    return X.input_means(X.input_series(body.unionByName(heads)))
