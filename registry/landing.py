"""Readers and writers over real files: the driver's tables are landed in the shared folder in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.operators import quality as QC
from cropspark.operators import ranking as Q
from cropspark.plans import prices as P
from cropspark.session import shared_dir
from cropspark.sources import parsers as X
from cropspark.sources import readers as RD
from cropspark.sources import sinks as SK
from cropspark.streaming import ingest as IN
from registry.base import query, table

#: Rows of a landed page; readers take a page whole.
PAGE = 500


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("read_json_pages", {"form": "s", "c_custkey": "s", "c_name": "s", "c_mktsegment": "s"}, """
SELECT form, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer, (VALUES ('lines'), ('arrays')) f(form)""")
def _(spark, sf):
    """Every customer in pages of JSON lines and in pages of one array each; a missing field stays missing."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    one = F.struct(*rows.columns)
    lines, arrays = _folder(spark, "lines"), _folder(spark, "arrays")
    rows.select(F.to_json(one)).write.option("maxRecordsPerFile", PAGE).text(lines)
    pages = rows.groupBy(F.floor(F.col("c_custkey") / PAGE)).agg(F.to_json(F.collect_list(one)).alias("page"))  # PAGE rows at most
    pages.select("page").write.option("maxRecordsPerFile", 1).text(arrays)
    read = [RD.read_json_rows(spark, p, rows.columns, n == "lines").withColumn("form", F.lit(n)) for n, p in (("lines", lines), ("arrays", arrays))]
    return read[0].unionByName(read[1])


@query("rejected_json", {"record": "s"}, "SELECT 'row ' || CAST(o_orderkey AS VARCHAR) AS record FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    """Finished orders are landed as plain text among JSON lines: each is reported as rejected."""
    path = _folder(spark, "mixed")
    orders = table(spark, sf, "orders")
    broken = F.concat(F.lit("row "), F.col("o_orderkey").cast("string"))
    orders.select(F.when(F.col("o_orderstatus") == "F", broken).otherwise(F.to_json(F.struct("o_orderkey")))).write.option("maxRecordsPerFile", PAGE).text(path)
    return RD.rejected_json(spark, path, ["o_orderkey"], lines=True)


@query("read_csv_text", {"p_partkey": "s", "p_name": "s", "p_brand": "s"}, """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '"' || p_name || '", new' AS p_name, p_brand FROM part""")
def _(spark, sf):
    """A CSV snapshot with quotes and commas; all columns come back as text."""
    path = _folder(spark, "csv")
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit('", new'))
    rows = table(spark, sf, "part").select("p_partkey", quoted.alias("p_name"), "p_brand")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return RD.read_csv_text(spark, path)


@query("snapshot_replaced", {"s_suppkey": "i", "s_name": "s"}, "SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    """A snapshot of other rows is replaced whole; an absent source is none."""
    path = _folder(spark, "snapshot")
    SK.write_snapshot(table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")), path)
    SK.write_snapshot(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path)
    assert RD.read_parquet_or_none(spark, f"{path}-absent") is None
    return RD.read_parquet_or_none(spark, path)


@query("drop_folder", {"key": "s", "name": "s", "region": "s"}, """
SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier""")
def _(spark, sf):
    """Whatever was dropped, CSV and parquet, as one table; columns meet by name."""
    folder = _folder(spark, "drop")
    table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).write.option("header", True).csv(f"{folder}/nations.csv")
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).write.parquet(f"{folder}/suppliers.parquet")
    return RD.read_drop_folder(spark, folder)


@query("read_price_xml", {"artiNombre": "s", "enmaFecha": "s", "muniId": "s", "promedioKg": "f"}, """
SELECT o_orderstatus AS artiNombre, strftime(o_orderdate, '%Y-%m-%d') AS enmaFecha, CAST(o_custkey AS VARCHAR) AS muniId, o_totalprice AS promedioKg
FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01'""")
def _(spark, sf):
    """Orders as an XML price feed, read from a day on."""
    path = _folder(spark, "xml")
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("artiNombre"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("enmaFecha"),
                                             F.col("o_custkey").alias("muniId"), F.col("o_totalprice").alias("promedioKg"))
    rows.write.format("xml").option("rootTag", "landing").option("rowTag", "return").save(path)
    return RD.read_price_xml(spark, path, since="1996-01-01")


#: Markets of a page, about: a day of any size is so many pages, none of which grows with the table.
PAGE_MARKETS = 50
#: Pages of a landed file, some 3 KB each, and the row above each of them: files of a few MB, which the driver can list at any size of the table.
FILE_PAGES = 1000
PAGE_BREAK = "\f"


@query("bulletin_files", {"day": "d", "market": "s", "product": "s", "price": "f"}, """
WITH cells AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey AS market, o_orderpriority AS product, MAX(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT day, 'Plaza ' || CAST(market AS VARCHAR) AS market, product, price FROM cells""")
def _(spark, sf):
    """Crosstab sheets of about ``PAGE_MARKETS`` markets, as many for a day as its markets ask for, landed as CSV, ``FILE_PAGES`` to a file, and read back."""
    path = _folder(spark, "bulletins")
    cells = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("market"), F.col("o_orderpriority").alias("product")).agg(F.max("o_totalprice").alias("price"))
    months = F.array(*[F.lit(m.lower()) for m in K.MONTH_NAMES_ES])
    title = F.concat_ws(" de ", F.day("day"), F.get(months, F.month("day") - 1), F.year("day"))
    pages = cells.groupBy("day").agg(F.ceil(F.count_distinct("market") / PAGE_MARKETS).alias("_pages"))
    cells = cells.join(pages, "day").withColumn("_page", F.pmod(F.xxhash64("market"), F.col("_pages")))
    days = cells.groupBy("day", "_page").agg(F.array_sort(F.collect_set("market")).alias("markets"), F.array_sort(F.collect_set("product")).alias("products"),
                                    F.collect_list(F.struct("product", "market", "price")).alias("prices"))
    row = lambda first, f: F.concat_ws(",", F.lit(first) if isinstance(first, str) else first, F.flatten(F.transform("markets", f)))
    of = lambda p: F.filter("prices", lambda c: (c["product"] == p) & c["market"].isNotNull())
    sold = F.transform("products", lambda p: F.struct(p.alias("product"), F.map_from_entries(F.transform(of(p), lambda c: F.struct(c["market"], c["price"]))).alias("prices")))
    price = lambda s, m: F.coalesce(F.try_element_at(s["prices"], m).cast("string"), F.lit("n.d."))
    body = F.transform(sold, lambda s: row(s["product"], lambda m: F.array(price(s, m), F.lit("0"))))
    lines = F.concat(F.array(F.lit(PAGE_BREAK), F.lit("bulletin"), title, row("Precio", lambda m: F.array(F.concat(F.lit("Plaza "), m.cast("string")), F.lit(""))),
                             row("", lambda m: F.array(F.lit("Precio"), F.lit("Var")))), body)
    days.select(F.array_join(lines, "\n")).write.option("maxRecordsPerFile", FILE_PAGES).text(path)
    return X.bulletin_to_long(RD.read_sheets(spark, path, PAGE_BREAK))


@query("sync_reports", {"source": "s", "rows": "i", "change_type": "s"}, """
SELECT o_orderpriority AS source, COUNT(*) AS rows, CASE WHEN o_orderpriority < '3' THEN 'changed' ELSE 'inserted' END AS change_type FROM orders GROUP BY ALL""")
def _(spark, sf):
    """Reports of every priority as documents among broken and foreign ones; two sources are stored with an older report."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("rows"))
    body = F.struct("source", F.lit("u").alias("uri"), "rows", F.lit(6).alias("columns"), F.create_map(F.lit("a"), F.lit(100.0)).alias("completeness_pct"),
                    F.lit(0).cast("long").alias("key_duplicates"), F.lit("2026-01-02").alias("extracted_at"))
    documents = orders.select(F.explode(F.array(F.to_json(body), F.concat(F.lit("{"), F.col("source")), F.to_json(F.struct("source")))).alias("d"))
    old = orders.where("source < '3'").select("source", F.lit("u").alias("uri"), F.lit(1).cast("long").alias("rows"), F.lit(6).alias("columns"), F.lit("{}").alias("completeness_pct"),
                                             F.lit(0).cast("long").alias("key_duplicates"), F.lit("2026-01-01").alias("extracted_at"))
    return QC.sync_reports(old, documents, "d")


@query("declared_constraints", {"check_name": "s", "passed": "b", "failing_rows": "i"}, """
SELECT check_name, n = 0 AS passed, n AS failing_rows FROM (
  SELECT 'o_totalprice not null' AS check_name, COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS n FROM orders
  UNION ALL SELECT 'o_totalprice in range', COUNT(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 200000) FROM orders
  UNION ALL SELECT 'o_orderpriority length', COUNT(*) FILTER (WHERE LENGTH(o_orderpriority) > 8) FROM orders
  UNION ALL SELECT 'o_orderkey unique', COALESCE((SELECT SUM(c) FROM (SELECT COUNT(*) AS c FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)), 0)
  UNION ALL SELECT 'o_custkey in reference', COUNT(*) FILTER (WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)) FROM orders)""")
def _(spark, sf):
    checks = QC.validate_table(table(spark, sf, "orders"), "orders", ["o_totalprice"], ["o_orderkey"], {"o_totalprice": (1000, 200000)}, {"o_orderpriority": 8},
                               {"o_custkey": (table(spark, sf, "supplier"), "s_suppkey")})
    return checks.withColumnRenamed("check", "check_name")


@query("run_log", {"source": "s", "status": "s", "new_rows": "n", "max_day": "d", "error": "s"}, """
SELECT event_type AS source, 'ok' AS status, COUNT(*) AS new_rows, CAST(MAX(ts) AS DATE) AS max_day, NULL AS error FROM events GROUP BY ALL
UNION ALL SELECT event_type, 'error', NULL, NULL, 'nothing after ' || strftime(MAX(ts), '%Y-%m-%d') FROM events GROUP BY ALL""")
def _(spark, sf):
    """A good run and a failed one of every event type, in the log."""
    log = _folder(spark, "runs")
    types = table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("new_rows"), F.to_date(F.max("ts")).alias("max_day"))
    now, none = F.current_timestamp(), F.lit(None)
    times = [now.alias("started_at"), now.alias("finished_at")]
    good = types.select("source", *times, F.lit("ok").alias("status"), "new_rows", "max_day", none.cast("string").alias("error"))
    bad = types.select("source", *times, F.lit("error").alias("status"), none.cast("long").alias("new_rows"), none.cast("date").alias("max_day"), F.concat(F.lit("nothing after "), F.col("max_day").cast("string")).alias("error"))
    IN.log_runs(good.unionByName(bad), log)
    return spark.read.parquet(log)


@query("spanish_order", {"c_custkey": "i", "name": "s", "place": "i"}, """
SELECT c_custkey, name, ROW_NUMBER() OVER (ORDER BY NULLIF(name, '') NULLS LAST, c_custkey) AS place FROM (SELECT CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS name, c_custkey FROM customer)""")
def _(spark, sf):
    """Places of all customers in Spanish order, blanks last."""
    rows = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("name"), "c_custkey")
    return Q.in_spanish_order(rows, [], "name", ["c_custkey"])


_KEYS = sorted(K.PRODUCT_TO_CROP)
_LINKS = ", ".join(f"({i}, '{k}', '{K.PRODUCT_TO_CROP[k]}')" for i, k in enumerate(_KEYS))


@query("link_to_crop", {"p_partkey": "i", "product_key": "s", "crop_key": "s"}, f"""
SELECT p_partkey, COALESCE(k, 'OTHER') AS product_key, c AS crop_key FROM part LEFT JOIN (VALUES {_LINKS}) v(i, k, c) ON i = p_partkey % {len(_KEYS) + 3}""")
def _(spark, sf):
    """Each part plays a priced product; a few have no link."""
    names = F.array(*[F.lit(k) for k in _KEYS])
    rows = table(spark, sf, "part").select("p_partkey", F.coalesce(F.get(names, (F.col("p_partkey") % (len(_KEYS) + 3)).cast("int")), F.lit("OTHER")).alias("product_key"))
    return P.link_to_crop(rows)


@query("stream_repeats", {"user_id": "i", "event_type": "s", "day": "d", "value": "f"}, """
SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day, value FROM events""")
def _(spark, sf):
    """Every event lands twice in one batch; repeats go, revised values stay."""
    base = _folder(spark, "repeats")
    events = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "value")
    events.unionByName(events).write.parquet(f"{base}/in")
    stream = IN.file_stream(spark, f"{base}/in", events.schema, "parquet", files_per_batch=1_000_000)
    seen = IN.drop_repeats(stream, "day", ["user_id", "event_type"], ["value"])
    IN.run_available(seen, IN.update_sink(f"{base}/out", lambda b: b), f"{base}/checkpoint")
    from cropspark.operators import merge as M

    return M.read_batches(spark, f"{base}/out").drop("batch")
