"""Loads of facts with rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropspark.plans import loading as L
from registry.base import CTES, query, table

# Landed rows: every line is one, under the names of its tables. Some names, months and products are not what the dimensions hold.
CTES["landed_lines"] = """
SELECT l_orderkey, l_linenumber, YEAR(l_shipdate) AS year, MONTH(l_shipdate) AS month, n_name, s_nationkey, r_name, n_regionkey, p_brand, p_type, p_name, l_returnflag, l_linestatus, l_quantity,
       l_extendedprice / l_quantity AS price, p_retailprice * (1 + l_tax) AS input_price
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""
CTES["load_months"] = "SELECT DISTINCT YEAR(o_orderdate) * 12 + MONTH(o_orderdate) AS month_id, YEAR(o_orderdate) AS year, MONTH(o_orderdate) AS month FROM orders"
CTES["load_crops"] = "SELECT DENSE_RANK() OVER (ORDER BY p_type) AS crop_id, LOWER(p_type) AS crop_key, p_type AS crop FROM (SELECT DISTINCT p_type FROM part)"
CTES["monthly_rows"] = """
SELECT year, month, CASE WHEN l_quantity > 1 THEN CASE WHEN l_returnflag = 'R' THEN p_brand ELSE p_type END END AS product, CASE WHEN l_quantity = 50 THEN 'Feria' ELSE n_name END AS market, r_name AS city,
       MIN(price) AS price_min, MAX(price) AS price_max, AVG(price) AS price_avg, SUM(l_quantity) AS volume FROM landed_lines GROUP BY ALL"""
CTES["monthly_loaded"] = """
SELECT m.*, month_id, n_nationkey AS market_id, CASE WHEN product IS NULL THEN 'missing crop_key' WHEN month_id IS NULL THEN 'unknown month' WHEN n_nationkey IS NULL THEN 'unknown market' END AS reason
FROM monthly_rows m LEFT JOIN load_months USING (year, month) LEFT JOIN nation ON n_name = market"""
CTES["soil_rows"] = """
SELECT CASE WHEN l_quantity > 2 THEN s_nationkey + CASE WHEN l_quantity = 49 THEN 1000 ELSE 0 END END AS town_id, CASE WHEN l_linestatus = 'F' THEN p_type ELSE p_brand END AS product,
       CASE l_returnflag WHEN 'A' THEN 'alta' WHEN 'N' THEN 'moderada' ELSE 'no_apta' END AS suitability FROM landed_lines"""
CTES["soil_loaded"] = """
SELECT s.*, crop_id, CASE WHEN town_id IS NULL THEN 'missing town_id' WHEN crop_id IS NULL THEN 'unknown crop' WHEN n_nationkey IS NULL THEN 'unknown town' END AS reason
FROM soil_rows s LEFT JOIN load_crops ON crop_key = LOWER(product) LEFT JOIN nation ON n_nationkey = town_id"""
CTES["census_loaded"] = """
SELECT c_nationkey AS town_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 2014 ELSE 1000 + c_custkey END AS census_year, c_acctbal AS farmed_ha, c_custkey,
       CASE WHEN n_nationkey IS NULL THEN 'unknown town' END AS reason
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey > 0"""
CTES["input_rows"] = "SELECT year, month, p_type AS kind, p_name AS input_name, CASE WHEN l_linestatus = 'F' THEN n_regionkey END AS region_id, input_price AS price FROM landed_lines"
CTES["inputs_loaded"] = "SELECT i.*, month_id, CASE WHEN input_name IS NULL THEN 'missing input_name' WHEN month_id IS NULL THEN 'unknown month' END AS reason FROM input_rows i LEFT JOIN load_months USING (year, month)"


def _lines(spark, sf):
    line, part, supplier, nation, region = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    return (line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
            .join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "n_name", "s_nationkey", "r_name", "n_regionkey", "p_brand", "p_type", "p_name", "l_returnflag",
                    "l_linestatus", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("p_retailprice") * (1 + F.col("l_tax"))).alias("input_price")))


def _months(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select((F.year(day) * 12 + F.month(day)).alias("month_id"), F.year(day).alias("year"), F.month(day).alias("month")).distinct()


def _crops(spark, sf):
    from cropspark.operators import ranks as RK

    types = table(spark, sf, "part").select("p_type").distinct()
    return types.join(RK.dense_codes(types, "p_type", "crop_id", start=1), "p_type").select("crop_id", F.lower("p_type").alias("crop_key"), F.col("p_type").alias("crop"))


def _towns(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("town_id"))


def _monthly(spark, sf):
    quantity = F.col("l_quantity")
    product = F.when(quantity > 1, F.when(F.col("l_returnflag") == "R", F.col("p_brand")).otherwise(F.col("p_type")))
    rows = _lines(spark, sf).groupBy(
        F.col("year").cast("string").alias("year"), F.col("month").cast("string").alias("month"), product.alias("product"),
        F.when(quantity == 50, " Feria").otherwise(F.concat("n_name", F.lit("  "))).alias("market"), F.col("r_name").alias("city")).agg(
        F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.avg("price").alias("price_avg"), F.sum("l_quantity").alias("volume"))
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    markets = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("market_id"), F.col("n_name").alias("market"), F.col("r_name").alias("city"))
    return L.load_monthly_prices(rows, _months(spark, sf), _crops(spark, sf), markets)


def _soil(spark, sf):
    quantity = F.col("l_quantity")
    town = F.when(quantity > 2, F.col("s_nationkey") + F.when(quantity == 49, 1000).otherwise(0))
    text = F.when(F.col("l_returnflag") == "A", "Aptitud alta").when(F.col("l_returnflag") == "N", "Aptitud Media").otherwise("No apta")
    rows = _lines(spark, sf).select(town.alias("town_id"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit(" "), "p_type")).otherwise(F.col("p_brand")).alias("product"), text.alias("suitability"))
    return L.load_soil(rows, _crops(spark, sf), _towns(spark, sf))


def _census(spark, sf):
    year = F.when(F.col("c_mktsegment") == "BUILDING", "s/d").otherwise((1000 + F.col("c_custkey")).cast("string"))
    none = F.lit(None).cast("double")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("town_id"), year.alias("census_year"), F.col("c_acctbal").alias("farmed_ha"), none.alias("pasture_ha"), none.alias("fallow_ha"), none.alias("built_ha"))
    return L.load_census(rows, table(spark, sf, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("town_id")))


def _inputs(spark, sf):
    rows = _lines(spark, sf).select("year", "month", F.col("p_type").alias("kind"), F.col("p_name").alias("input_name"), F.when(F.col("l_linestatus") == "F", F.col("n_regionkey")).alias("region_id"), F.col("input_price").alias("price"))
    return L.load_input_prices(rows, _months(spark, sf))


@query("load_monthly_prices", {"market_id": "i", "crop_id": "i", "month_id": "i", "price_min": "f", "price_max": "f", "price_avg": "f", "volume": "f", "change_type": "s"}, """
SELECT market_id, COALESCE(k.crop_id, (SELECT MAX(crop_id) FROM load_crops) + n.place) AS crop_id, month_id, price_min, price_max, price_avg, volume, 'inserted' AS change_type
FROM monthly_loaded m LEFT JOIN load_crops k ON k.crop_key = LOWER(product)
LEFT JOIN (SELECT key, ROW_NUMBER() OVER (ORDER BY key) AS place FROM (SELECT DISTINCT LOWER(p_brand) AS key FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 1)) n ON n.key = LOWER(product)
WHERE reason IS NULL""")
def _(spark, sf):
    loaded, _ = _monthly(spark, sf)
    return loaded.into(loaded.accepted.limit(0), ["market_id", "crop_id", "month_id"])


@query("load_soil", {"town_id": "i", "crop_id": "i", "suitability": "s"}, "SELECT town_id, crop_id, MAX(suitability) AS suitability FROM soil_loaded WHERE reason IS NULL GROUP BY ALL")
def _(spark, sf):
    return _soil(spark, sf).accepted


@query("load_census", {"town_id": "i", "census_year": "i", "farmed_ha": "f"}, "SELECT town_id, census_year, MAX(farmed_ha) AS farmed_ha FROM census_loaded WHERE reason IS NULL GROUP BY ALL")
def _(spark, sf):
    return _census(spark, sf).accepted


@query("load_input_prices", {"month_id": "i", "kind": "s", "input_name": "s", "region_id": "n", "price": "f"}, """
SELECT month_id, kind, input_name, region_id, MAX(price) AS price FROM inputs_loaded WHERE reason IS NULL GROUP BY ALL""")
def _(spark, sf):
    return _inputs(spark, sf).accepted


def _counts_sql(name: str, rows: str, key: str) -> str:
    return f"""
SELECT '{name}' AS load, reason, COUNT(*) AS n FROM {rows} WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT '{name}', 'accepted', COUNT(*) FROM (SELECT DISTINCT {key} FROM {rows} WHERE reason IS NULL)
UNION ALL SELECT '{name}', 'duplicate', (SELECT COUNT(*) FROM {rows} WHERE reason IS NULL) - (SELECT COUNT(*) FROM (SELECT DISTINCT {key} FROM {rows} WHERE reason IS NULL))"""


@query("load_rejects", {"load": "s", "reason": "s", "n": "i"}, " UNION ALL ".join(_counts_sql(*x) for x in (
    ("monthly_prices", "monthly_loaded", "market_id, LOWER(product), month_id"), ("soil", "soil_loaded", "town_id, crop_id"), ("census", "census_loaded", "town_id, census_year"),
    ("input_prices", "inputs_loaded", "month_id, kind, input_name, region_id"))))
def _(spark, sf):
    """Rows by outcome of the four loads."""
    loads = {"monthly_prices": _monthly(spark, sf)[0], "soil": _soil(spark, sf), "census": _census(spark, sf), "input_prices": _inputs(spark, sf)}
    frames = [loaded.counts.withColumn("load", F.lit(name)) for name, loaded in loads.items()]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
