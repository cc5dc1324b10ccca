"""Landed files of every format, written here by hand."""

import json
from datetime import date, datetime
from glob import glob

import pytest
from pyspark.sql import functions as F

from cropspark.plans import prices as P
from cropspark.session import shared_dir
from cropspark.sources import parsers as X
from cropspark.sources import readers as RD
from cropspark.sources import sinks as SK

def landed_prices(*records):
    """An envelope of price records around the elements that the reader looks for."""
    body = "".join("<return>" + "".join(f"<{k}>{v}</{k}>" for k, v in r.items()) + "</return>" for r in records)
    return f"<landing day='today'><page number='1'>{body}</page></landing>"


def sheet(*rows):
    return "\n".join(",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in r) for r in rows) + "\n"


def test_price_xml_with_date_bound(spark, tmp_path):
    records = [{"artiNombre": "Curuba", "enmaFecha": f"{day}T00:00:00-05:00", "fuenNombre": "Plaza Norte", "muniId": "15001", "promedioKg": str(price)}
               for day, price in (("2024-03-05", 3100), ("2021-11-30", 1750), ("2024-03-01", 2990))]
    (tmp_path / "a.xml").write_text(landed_prices(*records[:2]), encoding="utf-8")
    (tmp_path / "b.xml").write_text(landed_prices(records[2]), encoding="utf-8")
    assert RD.read_price_xml(spark, str(tmp_path)).count() == 3
    kept = RD.read_price_xml(spark, str(tmp_path), since="2024-03-02").collect()
    assert [(r.enmaFecha[:10], r.promedioKg, r.muniId) for r in kept] == [("2024-03-05", "3100", "15001")]


def test_bulletin_of_200_columns(spark, tmp_path):
    markets = [f"Plaza {i}, piso\n{i % 3}" if i % 10 == 0 else f"Plaza {i}" for i in range(100)]
    heads = ["Precio"] + [c for m in markets for c in (m, "")]
    prices = {"Curuba": [500 + i for i in range(100)], "Feijoa": [None if i % 4 else 9000 - i for i in range(100)]}
    rows = [["Boletín"], ["Martes 5 de marzo de 2024"], heads, ["", *["Precio", "Var %"] * 100]]
    rows += [[p, *[c for v in values for c in ("n.d." if v is None else str(v), "0.1")]] for p, values in prices.items()]
    (tmp_path / "b.csv").write_text(sheet(*rows), encoding="utf-8")
    long = X.bulletin_to_long(RD.read_sheets(spark, str(tmp_path / "b.csv")))
    got = {(r["product"], r.market): r.price for r in long.collect()}
    assert got == {(p, m): float(v) for p, values in prices.items() for m, v in zip(markets, values) if v is not None}
    assert {r.day for r in long.collect()} == {date(2024, 3, 5)}
    clean = P.normalise_bulletin(long).collect()
    assert {r.source for r in clean} == {"excel"} and all(r.price_min is None for r in clean)
    assert "Plaza 10, piso 1" in {r.market for r in clean}


def test_sheets_below_a_page_break(spark, tmp_path):
    def page(day, market, price):
        return [["\f"], ["Boletín"], [f"{day} de marzo de 2024"], ["Precio", market, ""], ["", "Precio", "Var %"], ["Curuba", price, "0.1"], ["\f", "7", "0"]]

    (tmp_path / "b.csv").write_text(sheet(*page(5, "A", "500"), *page(6, "B, piso\n\f\n2", "n.d."), *page(6, "C", "700")), encoding="utf-8")
    (tmp_path / "c.csv").write_text(sheet(*page(7, "D", "800")[1:], *page(8, "E", "900")), encoding="utf-8")
    sheets = RD.read_sheets(spark, str(tmp_path), "\f")
    assert sorted(((r.file.rsplit("/")[-1]), r.n, r.last) for r in sheets.groupBy("file").agg(F.count("*").alias("n"), F.max("row").alias("last")).collect()) == [
        (f, 6, 5) for f in ("b.csv#1", "b.csv#2", "b.csv#3", "c.csv#0", "c.csv#1")]
    got = sorted((r.day.day, r.market, r["product"], r.price) for r in X.bulletin_to_long(sheets).collect())
    feeds = [(5, "A"), (6, "B, piso\n\f\n2"), (6, "C"), (7, "D"), (8, "E")]
    assert got == sorted([(d, m, "\f", 7.0) for d, m in feeds] + [(d, m, "Curuba", p) for (d, m), p in zip(feeds, (500.0, None, 700.0, 800.0, 900.0)) if p])


def test_bulletin_files_are_few(spark, tmp_path):
    from registry import load_all

    rows = [(i, i // 2, "1-URGENT", float(i), datetime(2024, 3, 1 + i % 20)) for i in range(3000)] + [(9000, None, "1-URGENT", 5.0, datetime(2024, 3, 1)), (9001, 1, None, 5.0, datetime(2024, 3, 1)),
                                                                                                   (9002, 2, "2-HIGH", 6.0, None), (9003, 0, "2-HIGH", None, datetime(2024, 3, 1))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    before = set(glob(f"{shared_dir(spark)}/bulletins-*"))
    got = load_all()[0]["bulletin_files"](spark, str(tmp_path))
    assert {(int(r.day[-2:]), r.market, r["product"], r.price) for r in got.collect()} == {(1 + i % 20, f"Plaza {i // 2}", "1-URGENT", float(i)) for i in range(3000)}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    (landed,) = set(glob(f"{shared_dir(spark)}/bulletins-*")) - before
    pages = spark.read.text(landed).where(F.col("value") == "\f").count()
    assert pages > 20 and len(glob(f"{landed}/part-*")) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_land_use_sheet(spark):
    rows = [["Areas by town"] + [None] * 7, ["73", "Tolima", "73268", "Espinal", "10.5", "20.25", "30.75", "40"],
            ["73", "Tolima", "73449", "Melgar", "1", "2", "3", "4"], [None, "Sum", None, None, "11.5", "22.25", "33.75", "44"]]
    out = X.land_use(spark.createDataFrame([(r,) for r in rows], "cells array<string>"), 2019).orderBy("town_id").collect()
    assert [(r.town_id, r.pasture_ha, r.fallow_ha, r.agricultural_ha, r.infrastructure_ha) for r in out] == [
        ("73268", 10.5, 20.25, 30.75, 40.0), ("73449", 1.0, 2.0, 3.0, 4.0)]


def test_input_sheets(spark, tmp_path):
    good = ["Título", "1.2. Fungicidas", "", "Año,Mes,Código departamento,Precio promedio,Precio promedio departamento", "2020,Enero,'05,9,100", "2020,enero,5,9,200", "2020,Marzo,99,9,x",
            "Fuente: nota,,,,"]
    (tmp_path / "1.2.csv").write_text("\n".join(good), encoding="utf-8")
    (tmp_path / "2.1.csv").write_text("2.1. Antibióticos\nAño,Mes,Código departamento,Precio promedio\n2020,Enero,05,5\n", encoding="utf-8")
    rows = X.input_series(RD.read_sheets(spark, str(tmp_path)))
    assert [(r.year, r.month, r.region, r.kind, r.subgroup, r.price) for r in X.input_means(rows).collect()] == [
        (2020, 1, "Andina", "agroquimico", "Fungicidas", 150.0)]


def test_index_table(spark, tmp_path):
    (tmp_path / "oni.txt").write_text(" YR  MON  TOTAL CLIM  ANOM\n 1999  12  1 2  3.0\n 2015 11 29.5 26.6  2.6 \n2020 10  25.3  26.5 -1.2\n", encoding="utf-8")
    got = sorted((r.year, r.month, r.oni, r.phase) for r in RD.read_index_table(spark, str(tmp_path / "oni.txt")).collect())
    assert got == [(2015, 11, 2.6, "El Niño"), (2020, 10, -1.2, "La Niña")]


def test_nested_documents(spark, tmp_path):
    grid = {"properties": {"parameter": {"T2M": {"20200101": 20.5, "20200102": -999}, "RH2M": {"20200103": 80}}}}
    station = {"daily": {"time": ["2020-01-01", "2020-01-02"], "temperature_2m_mean": [20, None], "sunshine_duration": [3600, 7200]}}
    bank = [{"page": 1}, [{"indicator": {"id": "A.B", "value": "Name"}, "date": "2020", "value": 1.5}, {"indicator": {"id": "A.B", "value": "Name"}, "date": "x", "value": None}]]
    crops = {"data": [{"Area": "Colombia", "Item": "Maize", "Year": "2020", "Value": "3.5", "Item Code": "56"}]}
    df = spark.createDataFrame([(json.dumps(grid), json.dumps(station), json.dumps(bank), json.dumps(crops))], "g string, s string, b string, c string")
    got = {r.day: (r.temp_mean, r.humidity) for r in X.grid_days(df, [], "g").collect()}
    assert got == {date(2020, 1, 1): (20.5, None), date(2020, 1, 2): (None, None), date(2020, 1, 3): (None, 80.0)}
    assert [(r.temp_mean, r.sunshine_s) for r in X.station_days(df, [], "s").orderBy("day").collect()] == [(20.0, 3600.0), (None, 7200.0)]
    assert [(r.indicator_id, r.year, r.value) for r in X.indicator_values(df, "b").collect()] == [("A.B", 2020, 1.5), ("A.B", None, None)]
    assert [(r.crop, r.item_code, r.year, r.value) for r in X.crop_statistics(df, "c").collect()] == [("Maize", "56", 2020.0, 3.5)]


def test_layers_take_the_crop_from_the_file(spark, tmp_path):
    for name, code in (("PAPA", "5001"), ("PAPA-2", "5002"), ("CAFÉ ALTO", "76001")):
        page = {"features": [{"attributes": {"cod_dane_mpio": code, "aptitud": "Exclusión legal", "other": 1}}]}
        (tmp_path / f"{name}.json").write_text(json.dumps(page, indent=1), encoding="utf-8")
    got = sorted((r.crop, r.town_id, r.suitability) for r in RD.read_layers(spark, str(tmp_path)).collect())
    assert got == [("CAFÉ ALTO", "76001", "Exclusion legal"), ("PAPA", "05001", "Exclusion legal"), ("PAPA", "05002", "Exclusion legal")]


def test_json_rows_and_csv_stay_text(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"a": "01", "b": 2}, {"a": "x"}]), encoding="utf-8")
    assert sorted((r.a, r.b) for r in RD.read_json_rows(spark, str(tmp_path / "r.json"), ["a", "b"]).collect()) == [("01", "2"), ("x", None)]
    (tmp_path / "r.csv").write_text('code,name\n05001,"a ""q"" b"\n', encoding="utf-8")
    assert tuple(RD.read_csv_text(spark, str(tmp_path / "r.csv"), ["code", "name"]).first()) == ("05001", 'a "q" b')


def test_json_arrays_lines_and_rejects(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": "1", "b": 2.5}\n\n{"a": null}\nnot json\n{"a": {"x": [1, "y"]}}\n[1', encoding="utf-8")
    (tmp_path / "array.json").write_text('[{"a": "k"},\n 7, {"b": true}]', encoding="utf-8")
    (tmp_path / "cut.json").write_text('[{"a": "lost"}, {"a": "half', encoding="utf-8")
    (tmp_path / "one.json").write_text('{"a": "single"}', encoding="utf-8")
    (tmp_path / "none.json").write_text("[]", encoding="utf-8")
    got = sorted(((r.a, r.b) for r in RD.read_json_rows(spark, str(tmp_path), ["a", "b"]).collect()), key=str)
    assert got == sorted([("1", "2.5"), (None, None), ('{"x":[1,"y"]}', None), ("k", None), (None, "true"), ("single", None)], key=str)
    bad = {(r.file.rsplit("/", 1)[-1], r.record) for r in RD.rejected_json(spark, str(tmp_path), ["a", "b"]).collect()}
    assert bad == {("lines.json", "not json"), ("lines.json", "[1"), ("array.json", "7"), ("cut.json", '[{"a": "lost"}, {"a": "half')}


def test_parquet_validity(spark, tmp_path):
    assert RD.read_parquet_or_none(spark, str(tmp_path / "absent")) is None
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    assert RD.read_parquet_or_none(spark, str(tmp_path / "bad.parquet")) is None
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    assert RD.read_parquet_or_none(spark, str(tmp_path / "empty")) is None
    spark.range(2).write.parquet(str(tmp_path / "good"))
    assert RD.read_parquet_or_none(spark, str(tmp_path / "good")).count() == 2


def test_one_broken_file_spoils_a_parquet_source(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "mixed"))
    (tmp_path / "mixed" / "part-99999.parquet").write_bytes(b"x" * 100)
    assert RD.read_parquet_or_none(spark, str(tmp_path / "mixed")) is None


def test_drop_folder_unions_formats(spark, tmp_path):
    assert RD.read_drop_folder(spark, str(tmp_path)) is None
    (tmp_path / "a.csv").write_text("x,y\n1,2\n", encoding="utf-8")
    spark.createDataFrame([("3", "4")], "y string, z string").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    got = sorted(((r.x, r.y, r.z) for r in RD.read_drop_folder(spark, str(tmp_path)).collect()), key=str)
    assert got == [("1", "2", None), (None, "3", "4")]


def test_price_fact_prunes_by_month(spark, tmp_path):
    rows = [(1, "a", date(2026, m, 1), 1.0) for m in (1, 2, 3)]
    SK.write_price_fact(spark.createDataFrame(rows, "market_id int, product_id string, day date, price_avg double"), str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).where("year_month = '2026-02'")
    assert back.count() == 1 and len(back.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(year_month" in back._jdf.queryExecution().toString()


def test_csv_export_guards_formulas(spark, tmp_path):
    df = spark.createDataFrame([("=cmd", -1.5, 'say "hi", ok')], "a string, n double, t string").coalesce(1)
    SK.write_csv_export(df, {"a": "Title A", "n": "N", "t": "T"}, str(tmp_path / "x"))
    text = next((tmp_path / "x").glob("*.csv")).read_text(encoding="utf-8").splitlines()
    assert text == ["Title A,N,T", "'=cmd,-1.5,\"say \"\"hi\"\", ok\""]


def test_documents_per_key(spark):
    out = SK.as_documents(spark.createDataFrame([(date(2026, 1, 1), 1, "x")], "day date, a int, b string"), "day").first()
    assert json.loads(out.payload) == {"a": 1, "b": "x"}


def test_relation_reader_needs_a_database(spark):
    """No database may be started here: only the options of a partitioned read are checked, by the driver's refusal."""
    with pytest.raises(Exception):
        RD.read_relation(spark, "jdbc:nosuch://host/db", "SELECT 1 AS id", ("id", 0, 10, 4))
    assert RD.table_or_none(spark, "no_such_table") is None
    spark.range(1).select(F.col("id")).createOrReplaceTempView("some_view")
    assert RD.table_or_none(spark, "some_view").count() == 1


def test_line_files_are_read_in_several_tasks(spark, tmp_path):
    """One file of many lines is split; its rows and rejects are those of the whole-file reader."""
    from cropspark.sources import readers as RD

    path = tmp_path / "big.json"
    path.write_text("".join(f'{{"a": "{i}", "b": "{"x" * 60}"}}\n' if i % 1000 else f"broken {i}\r\n\n" for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        rows = RD.read_json_rows(spark, str(path), ["a", "b"], lines=True)
        assert rows.rdd.getNumPartitions() > 4
        assert rows.selectExpr("count(*) AS n", "sum(CAST(a AS long)) AS s").first() == RD.read_json_rows(spark, str(path), ["a", "b"]).selectExpr("count(*) AS n", "sum(CAST(a AS long)) AS s").first()
        bad = lambda lines: sorted(r.record for r in RD.rejected_json(spark, str(path), ["a", "b"], lines).collect())
        assert bad(True) == bad(False) and len(bad(True)) == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
