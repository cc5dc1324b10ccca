"""Functions, conforming, joins and name resolution."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import collections as FC
from cropspark.functions import dates as D
from cropspark.functions import numeric as N
from cropspark.functions import text as T
from cropspark.operators import conform as C
from cropspark.operators import joins as J
from cropspark.operators import quality as QL
from cropspark.operators import ranking as Q
from cropspark.operators import ranks as RK
from cropspark.session import materialise
from registry import standins as S
from registry.base import CTES, query, table

MONTHS = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"


# --- text ---------------------------------------------------------------------------------------------
@query("normalise_text", {"doc_id": "i", "text_key": "s", "name_key": "s", "n_key": "i"}, r"""
SELECT doc_id, MD5(t) AS text_key, MD5(TRIM(REGEXP_REPLACE(STRIP_ACCENTS(REPLACE(UPPER(text), 'ẞ', 'SS')), '[\s\x{00A0}]+', ' ', 'g'))) AS name_key, LENGTH(t) AS n_key
FROM (SELECT *, STRIP_ACCENTS(REGEXP_REPLACE(SPLIT_PART(LOWER(text), '(', 1), '^\s+|\s+$', '', 'g')) AS t FROM documents)""")
def _(spark, sf):
    key = T.normalise_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(key).alias("text_key"), F.md5(T.normalise_name(F.col("text"))).alias("name_key"), F.length(key).alias("n_key"))


@query("canon_title", {"conv_id": "i", "turn": "i", "title": "s", "grouped": "s", "product": "s"}, r"""
SELECT conv_id, turn,
  MD5(ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(LOWER(s), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('de','del','la','las','los','y') THEN w
      ELSE REPLACE(UPPER(w[1:1]), 'ẞ', 'SS') || LOWER(w[2:]) END), ' ')) AS title,
  MD5(CASE WHEN s <> '' AND LOWER(s) <> 'nan' THEN REPLACE(UPPER(s[1:1]), 'ẞ', 'SS') || LOWER(s[2:]) END) AS grouped, MD5(REPLACE(UPPER(p[1:1]), 'ẞ', 'SS') || p[2:]) AS product
FROM (SELECT conv_id, turn, TRIM(REGEXP_REPLACE(text, '\s+', ' ', 'g')) AS s, TRIM(REGEXP_REPLACE(REPLACE(text, '*', ' '), '\s+', ' ', 'g')) AS p FROM conversations)""")
def _(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(T.canon_title(c)).alias("title"), F.md5(T.canon_group(c)).alias("grouped"),
        F.md5(T.canon_product(c)).alias("product"))


@query("csv_guard", {"doc_id": "i", "cell": "s", "guarded": "b"}, r"""
SELECT doc_id, MD5(CASE WHEN REGEXP_MATCHES(g, '[",\n\r]') THEN '"' || REPLACE(g, '"', '""') || '"' ELSE g END) AS cell, g <> text AS guarded
FROM (SELECT *, CASE WHEN REGEXP_MATCHES(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS g FROM documents)""")
def _(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.csv_cell(c)).alias("cell"), (T.csv_guard(c) != c).alias("guarded"))


@query("padded_codes", {"c_custkey": "i", "code": "s", "valid": "s", "prefix": "s"}, r"""
SELECT c_custkey, LPAD(CAST(c_custkey AS VARCHAR), CAST(GREATEST(5, LENGTH(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS code,
       CASE WHEN REGEXP_FULL_MATCH(CAST(c_custkey * 13 AS VARCHAR), '\d{5}') THEN CAST(c_custkey * 13 AS VARCHAR) END AS valid,
       SUBSTRING(LPAD(CAST(c_custkey AS VARCHAR), CAST(GREATEST(5, LENGTH(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0'), 1, 2) AS prefix FROM customer""")
def _(spark, sf):
    code = T.zero_pad(F.col("c_custkey"), 5)
    return table(spark, sf, "customer").select(
        "c_custkey", code.alias("code"), T.valid_code(F.col("c_custkey") * 13).alias("valid"), F.substring(code, 1, 2).alias("prefix"))


@query("decimal_comma", {"c_custkey": "i", "number": "f", "clamped": "i", "id": "n"}, """
SELECT c_custkey, c_acctbal AS number, CAST(LEAST(100, GREATEST(-5, TRUNC(c_acctbal / 50))) AS BIGINT) AS clamped,
       CASE WHEN c_nationkey > 0 THEN c_nationkey END AS id FROM customer""")
def _(spark, sf):
    text = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf, "customer").select(
        "c_custkey", T.decimal_comma(text).alias("number"),
        N.bounded_int((F.col("c_acctbal") / 50).cast("string"), -5, 100, 0).alias("clamped"),
        N.positive_id(F.col("c_nationkey").cast("string")).alias("id"))


@query("rounding_flavours", {"o_orderkey": "i", "even": "f", "away": "f", "up": "f"}, """
SELECT o_orderkey, ROUND_EVEN(o_totalprice * 0.1234567::DOUBLE, 1) AS even, ROUND(o_totalprice * 0.1234567::DOUBLE, 2) AS away, FLOOR(-o_totalprice * 0.1234567::DOUBLE * 10 + 0.5) / 10 AS up FROM orders""")
def _(spark, sf):
    v = F.col("o_totalprice") * 0.1234567
    return table(spark, sf, "orders").select(
        "o_orderkey", N.round_half_even(v, 1).alias("even"), N.round_half_away(v, 2).alias("away"), N.round_half_up(-F.col("o_totalprice") * 0.1234567, 1).alias("up"))


# --- dates --------------------------------------------------------------------------------------------
@query("business_days", {"o_orderkey": "i", "half_open": "i", "after": "i", "next_weekday": "d"}, """
SELECT o_orderkey, LEN(LIST_FILTER(GENERATE_SERIES(d, TIMESTAMP '2001-09-01' - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: ISODOW(x) < 6)) AS half_open,
       LEN(LIST_FILTER(GENERATE_SERIES(d + INTERVAL 1 DAY, TIMESTAMP '2001-09-01', INTERVAL 1 DAY), lambda x: ISODOW(x) < 6)) AS after,
       CAST(LIST_FILTER(GENERATE_SERIES(d, d + INTERVAL 3 DAY, INTERVAL 1 DAY), lambda x: ISODOW(x) < 6)[1] AS DATE) AS next_weekday
FROM (SELECT o_orderkey, DATE_TRUNC('day', o_orderdate) AS d FROM orders)""")
def _(spark, sf):
    d, end = F.to_date("o_orderdate"), F.lit(date(2001, 9, 1))
    return table(spark, sf, "orders").select(
        "o_orderkey", D.business_days_half_open(d, end).alias("half_open"), D.business_days_after(d, end).alias("after"),
        D.business_date(D.business_index(d)).alias("next_weekday"))


@query("spanish_dates", {"o_orderkey": "i", "parsed": "d", "token": "s"}, f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%d') || SUBSTRING({MONTHS}[MONTH(o_orderdate)], 1, 3) || YEAR(o_orderdate) AS token FROM orders""")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    text = F.concat(F.lit("Viernes "), F.day(d).cast("string"), F.lit(" de "), F.lower(D.month_name_es(F.month(d))), F.lit(" de "), F.year(d).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", D.parse_spanish_date(text).alias("parsed"), D.date_token(d).alias("token"))


@query("month_arithmetic", {"o_orderkey": "i", "period": "i", "back_year": "i", "back_month": "i", "season": "f"}, """
SELECT o_orderkey, p AS period, YEAR(o_orderdate + INTERVAL 5 MONTH) AS back_year, MONTH(o_orderdate + INTERVAL 5 MONTH) AS back_month,
       SIN(2 * PI() * DAYOFYEAR(o_orderdate) / 365.25::DOUBLE) AS season
FROM (SELECT *, YEAR(o_orderdate) * 12 + MONTH(o_orderdate) AS p FROM orders)""")
def _(spark, sf):
    period = D.month_index(F.year("o_orderdate"), F.month("o_orderdate"))
    return table(spark, sf, "orders").select(
        "o_orderkey", period.alias("period"), D.month_index_year(period + 5).alias("back_year"),
        D.month_index_month(period + 5).alias("back_month"), D.season_sin(F.dayofyear("o_orderdate"), 365.25).alias("season"))


# --- conforming ---------------------------------------------------------------------------------------
@query("row_hash", {"o_orderkey": "i", "hash": "s"}, """
SELECT o_orderkey, MD5(CONCAT_WS('||', o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'nan' ELSE o_orderstatus END, o_orderpriority)) AS hash FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return rows.select("o_orderkey", C.row_hash(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("hash"))


@query("standardize", {"l_orderkey": "i", "l_linenumber": "i", "quantity": "f", "flag": "s", "l_partkey": "i", "_source_uri": "s"}, """
SELECT l_orderkey, l_linenumber, quantity, flag, l_partkey, 'landing/lineitem' AS _source_uri FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, quantity DESC, flag DESC, l_partkey DESC) AS rn FROM (
    SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity AS quantity, l_returnflag AS flag, l_partkey FROM lineitem
    WHERE l_returnflag <> 'R' AND l_quantity BETWEEN 5 AND 45)) WHERE rn = 1""")
def _(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate",
        F.when(F.col("l_returnflag") == "R", "sin dato").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("flag"), "l_partkey")
    return C.standardize(raw, "lineitem", "landing/lineitem", ["l_orderkey", "l_linenumber", "quantity"], numeric=["quantity"], text=["flag"],
                         critical=["quantity"], ranges={"quantity": (5, 45)}, keys=["l_orderkey", "l_linenumber"], order="l_shipdate",
                         extracted_at=datetime(2026, 1, 1))


_CLEAN = """SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS quantity, TRIM(l_returnflag) AS flag, l_partkey FROM lineitem"""


@query("standardize_report", {"name": "s", "value": "f"}, f"""
WITH clean AS ({_CLEAN}), good AS (SELECT * FROM clean WHERE quantity BETWEEN 5 AND 45),
kept AS (SELECT * FROM good QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1)
SELECT 'read' AS name, COUNT(*)::DOUBLE AS value FROM clean
UNION ALL SELECT 'dropped:missing', COUNT(*) FROM clean WHERE quantity IS NULL OR l_orderkey IS NULL
UNION ALL SELECT 'missing:quantity', COUNT(*) FROM clean WHERE quantity IS NULL
UNION ALL SELECT 'missing:l_orderkey', 0
UNION ALL SELECT 'dropped:range:quantity', COUNT(*) FROM clean WHERE quantity < 5 OR quantity > 45
UNION ALL SELECT 'dropped:duplicate', (SELECT COUNT(*) FROM good) - (SELECT COUNT(*) FROM kept)
UNION ALL SELECT 'kept', COUNT(*) FROM kept
UNION ALL SELECT 'stored rows', COUNT(*) FROM kept UNION ALL SELECT 'stored columns', 8
UNION ALL SELECT 'completeness of ' || c, 100.0 FROM (VALUES ('l_orderkey'), ('l_linenumber'), ('l_shipdate'), ('quantity'), ('l_partkey'), ('_source_uri'), ('_extracted_at')) v(c)
UNION ALL SELECT 'completeness of flag', 100.0 * COUNT(NULLIF(flag, 'N')) / COUNT(*) FROM kept""")
def _(spark, sf):
    """Counts of the conforming chain, observed in the one action that makes its rows, and the report as it is stored."""
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate",
        F.when(F.col("l_returnflag") == "R", "sin dato").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("  "), "l_returnflag", F.lit(" "))).alias("flag"), "l_partkey")
    rows, report = C.standardize_with_report(
        raw, "lineitem", "landing/lineitem", ["l_orderkey", "quantity"], datetime(2026, 1, 1), numeric=["quantity"], text=["flag"],
        critical=["quantity", "l_orderkey"], ranges={"quantity": (5, 45)}, keys=["l_orderkey"], order="l_shipdate")
    materialise(rows)
    counts = spark.createDataFrame([(k, float(v)) for k, v in report.metrics().items()], "name string, value double")
    none = spark.createDataFrame([], QL.REPORT_FIELDS.replace("MAP<STRING, DOUBLE>", "STRING"))
    stored = QL.sync_reports(none, spark.createDataFrame([(report.document(),)], "doc string"), "doc")
    shares = stored.select(F.explode(F.from_json("completeness_pct", "map<string,double>")).alias("name", "value"))
    return counts.unionByName(stored.select(F.lit("stored rows").alias("name"), F.col("rows").cast("double").alias("value"))).unionByName(
        stored.select(F.lit("stored columns").alias("name"), F.col("columns").cast("double").alias("value"))).unionByName(
        shares.select(F.concat(F.lit("completeness of "), "name").alias("name"), "value"))


@query("price_validation", {"l_orderkey": "i", "l_linenumber": "i", "mean": "f", "low": "f", "high": "f"}, """
SELECT l_orderkey, l_linenumber, m AS mean, CASE WHEN lo > 0 AND lo <= m THEN lo END AS low, CASE WHEN hi > 0 AND hi >= m THEN hi END AS high
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS m, l_extendedprice / l_quantity - 200 AS lo,
             CASE WHEN l_returnflag = 'A' THEN 3000.0::DOUBLE ELSE l_extendedprice END AS hi FROM lineitem) WHERE m > 0 AND m <= 20000""")
def _(spark, sf):
    m = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").cast("string").alias("market"),
        F.col("l_partkey").cast("string").alias("product"), m.alias("mean"), (m - 200).alias("low"),
        F.when(F.col("l_returnflag") == "A", 3000.0).otherwise(F.col("l_extendedprice")).alias("high"))
    return C.validate_prices(rows, "day", "market", "product", "low", "high", "mean", ceiling=20000)


_REGIONS = ", ".join(f"('{k}', '{v}')" for k, v in K.DEPARTMENT_REGION.items())


@query("contract_alignment", {"town_id": "i", "town": "s", "altitude": "f", "region_name": "s"}, f"""
SELECT c_custkey AS town_id, c_name AS town, NULL AS altitude, region_name
FROM customer LEFT JOIN (VALUES {_REGIONS}) v(code, region_name) ON code = LPAD(CAST(c_custkey % 100 AS VARCHAR), 2, '0')""")
def _(spark, sf):
    named = C.resolve_aliases(table(spark, sf, "customer"), {"town_id": ["ID_MUNI", "C_CUSTKEY"], "town": ["municipio", "c_name"]})
    aligned = C.align_to_contract(named, {"town_id": "int", "town": "string", "altitude": "double"})
    return C.constant_lookup(aligned.withColumn("_d", T.zero_pad(F.col("town_id") % 100, 2)), "_d", K.DEPARTMENT_REGION, "region_name")


@query("unpivot_indices", {"year": "i", "index_name": "s", "value": "f2"}, """
SELECT year, UNNEST(['quantity', 'price', 'discount']) AS index_name, UNNEST([q, p, d]) AS value
FROM (SELECT YEAR(l_shipdate) AS year, SUM(l_quantity) AS q, AVG(l_extendedprice) AS p, SUM(l_discount) AS d FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.sum("l_discount").alias("discount"))
    return C.melt(wide, ["year"], "index_name", "value")


@query("filter_builder", {"o_orderkey": "i", "o_orderpriority": "s"}, """
SELECT * FROM orders WHERE o_orderstatus = 'F' AND LOWER(o_orderpriority) = '1-urgent' AND o_totalprice <= 200000""")
def _(spark, sf):
    return C.conjunction(table(spark, sf, "orders"), equal={"o_orderstatus": "F", "o_custkey": None},
                         equal_ci={"o_orderpriority": "1-URGENT"}, at_most={"o_totalprice": 200000})


@query("source_cutoff", {"source": "s", "n_rows": "i", "last_day": "d"}, """
SELECT source, COUNT(*) AS n_rows, MAX(d) AS last_day FROM (
  SELECT 'old' AS source, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) < (SELECT MIN(CAST(o_orderdate AS DATE)) FROM orders WHERE YEAR(o_orderdate) >= 1998)
  UNION ALL SELECT 'new', CAST(o_orderdate AS DATE) FROM orders WHERE YEAR(o_orderdate) >= 1998) GROUP BY source""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    newer = rows.where(F.year("d") >= 1998)
    both = C.cut_covered(rows, newer, "d").withColumn("source", F.lit("old")).unionByName(newer.withColumn("source", F.lit("new")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.max("d").alias("last_day"))


@query("surrogate_keys", {"name": "s", "id": "i"}, """
SELECT name, ROW_NUMBER() OVER (ORDER BY name) + (SELECT COUNT(*) FROM nation) AS id
FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT n_name FROM nation))""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    known = nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).alias("id"))
    return RK.assign_surrogate_keys(known, table(spark, sf, "part").select(F.col("p_name").alias("name")), "name", "id")


@query("category_codes", {"value": "s", "code": "i"}, "SELECT value, DENSE_RANK() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT p_name || ' ' || p_brand AS value FROM part)")
def _(spark, sf):
    return RK.dense_codes(table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("value")), "value")


# --- joins --------------------------------------------------------------------------------------------
@query("name_resolution", {"c_custkey": "i", "code": "s"}, """
SELECT c_custkey, CASE WHEN c_acctbal < 7000 THEN CAST(c_nationkey AS VARCHAR) END AS code FROM customer""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    towns = nation.select(F.initcap("n_name").alias("town"), F.col("n_nationkey").cast("string").alias("code"))
    synonyms = nation.select(F.concat(F.lit("Vereda "), "n_nationkey").alias("synonym"), F.col("n_nationkey").cast("string").alias("code"))
    k = F.col("c_nationkey").cast("string")
    name = (F.when(F.col("c_acctbal") < 2000, F.concat(F.lit("  NÁTIÓN_"), k, F.lit(" (Región)")))
            .when(F.col("c_acctbal") < 5000, F.concat(F.lit("nation_"), k))
            .when(F.col("c_acctbal") < 7000, F.concat(F.lit("VEREDA "), k)).otherwise(F.concat(F.lit("Zona "), k)))
    return J.resolve_names(table(spark, sf, "customer").select("c_custkey", name.alias("name")), "name", towns, "town", "code", synonyms)


# A quarter of the points has no coordinates, only a name; some names nobody knows.
CTES["points"] = """SELECT vec_id, CASE WHEN embedding[5] <= 0.08 THEN embedding[1] * 100.0::DOUBLE END AS lat, embedding[2] * 200.0::DOUBLE AS lon,
  CASE WHEN embedding[4] > 0 THEN ABS(embedding[3]) * 3000.0::DOUBLE END AS alt, label FROM embeddings"""
CTES["centres"] = "SELECT label, ROUND(AVG(lat), 6) AS lat, ROUND(AVG(lon), 6) AS lon, ROUND(AVG(alt), 3) AS alt FROM points GROUP BY label"
CTES["pair_costs"] = """
SELECT vec_id, c.label, ABS(c.alt - p.alt) AS climb, 6371.0::DOUBLE * 2 * ATAN2(SQRT(a), SQRT(1 - a)) AS km FROM points p CROSS JOIN centres c,
LATERAL (SELECT POW(SIN((RADIANS(c.lat) - RADIANS(p.lat)) / 2), 2) + COS(RADIANS(p.lat)) * COS(RADIANS(c.lat)) * POW(SIN((RADIANS(c.lon) - RADIANS(p.lon)) / 2), 2) AS a) h"""


@query("nearest_centroid", {"vec_id": "i", "label": "i", "distance_km": "f3", "method": "s"}, """
SELECT vec_id, label, km AS distance_km, CASE WHEN km <= 50 AND COALESCE(climb, 0) <= 400 THEN 'within_radius_and_altitude' ELSE 'nearest_outside' END AS method
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY km + COALESCE(climb, 0) * 0.1::DOUBLE, label) AS rn FROM pair_costs WHERE km IS NOT NULL) WHERE rn = 1
UNION ALL SELECT vec_id, CASE WHEN label < 7 THEN label END, NULL, CASE WHEN label < 7 THEN 'text' ELSE 'unresolved' END FROM points WHERE lat IS NULL""")
def _(spark, sf):
    e = F.col("embedding")
    points = table(spark, sf, "embeddings").select(
        "vec_id", F.when(e[4] <= 0.08, (e[0] * F.lit(100.0)).cast("double")).alias("lat"), (e[1] * F.lit(200.0)).cast("double").alias("lon"),
        F.when(e[3] > 0, F.abs(e[2]) * F.lit(3000.0)).cast("double").alias("alt"), "label",
        F.when(F.col("label") < 4, F.concat(F.lit("  CENTRÓ "), "label", F.lit(" (Región)"))).when(F.col("label") < 7, F.concat(F.lit("Vereda "), "label"))
        .when(F.col("label") < 9, F.concat(F.lit("Zona "), "label")).alias("name"))
    centres = points.groupBy("label").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("alt"), 3).alias("alt")).withColumn(
        "name", F.concat(F.lit("Centro "), "label"))
    synonyms = centres.select(F.concat(F.lit("vereda "), "label").alias("synonym"), F.col("label").cast("string").alias("code"))
    return J.assign_centres(points.drop("label"), centres, "vec_id", "label", "name", "name", synonyms)


@query("fk_rejects", {"accepted": "i", "rejected": "i"}, """
SELECT COUNT(*) FILTER (WHERE s_suppkey IS NOT NULL) AS accepted, COUNT(*) FILTER (WHERE s_suppkey IS NULL) AS rejected FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"))
    return J.reject_counts(orders, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code")), "code")


@query("anti_missing", {"c_custkey": "i", "c_name": "s"}, "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE YEAR(o_orderdate) = 2000)")
def _(spark, sf):
    orders = table(spark, sf, "orders").where(F.year("o_orderdate") == 2000).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left_anti")


@query("key_difference", {"doc_id": "i"}, "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("like_search", {"p_partkey": "i", "p_name": "s", "p_brand": "s"}, """
SELECT * FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%RED%' OR p_type ILIKE '%RED%'""")
def _(spark, sf):
    return C.conjunction(table(spark, sf, "part"), contains_any=(["p_name", "p_brand", "p_type"], "RED"))


@query("two_series_lookup", {"market": "s", "product": "s"}, """
SELECT m.market, p.product FROM markets m CROSS JOIN products p WHERE m.market_id = 3 AND p.product_id = 'Brand#7'""")
def _(spark, sf):
    market = S.markets(spark, sf).where(F.col("market_id") == 3).select("market")
    return market.withColumn("product", S.products(spark, sf).where(F.col("product_id") == "Brand#7").select("product").scalar())


@query("latest_month_lookup", {"town_id": "i", "year": "i", "month": "i", "next_year": "i", "next_month": "i"}, """
SELECT town_id, MAX(year * 12 + month) // 12 - CASE WHEN MAX(year * 12 + month) % 12 = 0 THEN 1 ELSE 0 END AS year,
       CASE WHEN MAX(year * 12 + month) % 12 = 0 THEN 12 ELSE MAX(year * 12 + month) % 12 END AS month,
       YEAR(MAKE_DATE(CAST(MAX(year) AS BIGINT), 1, 1) + TO_MONTHS(CAST(MAX(year * 12 + month) - MAX(year) * 12 AS INTEGER))) AS next_year,
       MONTH(MAKE_DATE(CAST(MAX(year) AS BIGINT), 1, 1) + TO_MONTHS(CAST(MAX(year * 12 + month) - MAX(year) * 12 AS INTEGER))) AS next_month
FROM town_month GROUP BY town_id""")
def _(spark, sf):
    from cropspark.plans import climate as CL

    months = CL.town_months(S.climate(spark, sf)).withColumn("period", D.month_index(F.col("year"), F.col("month")))
    last = months.groupBy("town_id").agg(F.max("period").alias("p"))
    p = F.col("p")
    return last.select("town_id", D.month_index_year(p).alias("year"), D.month_index_month(p).alias("month"),
                       D.month_index_year(p + 1).alias("next_year"), D.month_index_month(p + 1).alias("next_month"))


# --- latest, top and unions ---------------------------------------------------------------------------
@query("latest_per_key", {"user_id": "i", "event_id": "i", "event_type": "s", "value": "f"}, """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, sf):
    return Q.latest_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


@query("union_precedence", {"user_id": "i", "day": "d", "value": "f", "origin": "s"}, """
SELECT user_id, day, value, origin FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, day ORDER BY origin) AS rn FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, MAX(value) AS value, 'active' AS origin FROM events WHERE event_type = 'click' GROUP BY ALL
  UNION ALL SELECT user_id, CAST(ts AS DATE) AS day, MAX(value), 'history' FROM events GROUP BY ALL)) WHERE rn = 1""")
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    active = events.where(F.col("event_type") == "click").groupBy("user_id", "day").agg(F.max("value").alias("value")).withColumn("origin", F.lit("active"))
    history = events.groupBy("user_id", "day").agg(F.max("value").alias("value")).withColumn("origin", F.lit("history"))
    return Q.union_with_precedence([active, history], ["user_id", "day"])


@query("top_by_magnitude", {"c_custkey": "i", "c_acctbal": "f"}, "SELECT * FROM customer ORDER BY ABS(c_acctbal - 5000) DESC, c_custkey LIMIT 10")
def _(spark, sf):
    rows = table(spark, sf, "customer").withColumn("gap", F.col("c_acctbal") - 5000)
    return Q.top_by_magnitude(rows, "gap", 10, ["c_custkey"])


@query("top3_contributions", {"vec_id": "i", "top": "s"}, """
SELECT vec_id, ARRAY_TO_STRING(LIST_TRANSFORM(LIST_SORT(LIST_TRANSFORM(embedding, lambda v, i: {'o': -ABS(v), 'n': i}))[1:3], lambda e: e.n), ' ') AS top FROM embeddings""")
def _(spark, sf):
    items = F.transform("embedding", lambda v, i: F.struct((i + 1).alias("n"), v.alias("v")))
    top = FC.top_by_abs(items, "v", "n", 3)
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(top, lambda e: e["n"].cast("string")), " ").alias("top"))


@query("map_low_columns", {"user_id": "i", "mean_pct": "f", "low_types": "s", "state": "s"}, """
SELECT user_id, mean_pct, low_types, CASE WHEN mean_pct < 80 THEN 'incompleto' WHEN mean_pct < 95 THEN 'parcial' ELSE 'ok' END AS state FROM (
  SELECT user_id, AVG(m) AS mean_pct, STRING_AGG(event_type, ' ' ORDER BY event_type) FILTER (WHERE m < 80) AS low_types
  FROM (SELECT user_id, event_type, MAX(value) AS m FROM events GROUP BY ALL) GROUP BY user_id)""")
def _(spark, sf):
    from cropspark.operators.quality import source_audit

    peaks = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("m"))
    # At most one entry per event type and user.
    reports = peaks.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("pct"),
                                           F.lit(1).alias("rows"), F.lit(0).alias("dups"))
    audited = source_audit(reports, "rows", "dups", "pct")
    return audited.select("user_id", F.col("mean_completeness").alias("mean_pct"),
                          F.when(F.size("low_columns") > 0, F.array_join("low_columns", " ")).alias("low_types"), "state")
