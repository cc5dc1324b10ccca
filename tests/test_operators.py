"""Generic operators on hand-made rows."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cropspark.operators import aggregate as A
from cropspark.operators import conform as C
from cropspark.operators import joins as J
from cropspark.operators import merge as M
from cropspark.operators import quality as QC
from cropspark.operators import ranking as Q
from cropspark.operators import ranks as RK
from cropspark.operators import windows as W


# --- conforming ---------------------------------------------------------------------------------------
def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="b"):
        C.require_columns(spark.range(1), ["id", "b"], "feed")


def test_standardize_never_invents_values(spark, rows):
    raw = spark.createDataFrame([("5001", "12", " x ", 1), ("5001", "13", "y", 2), ("5002", "abc", "z", 1), ("5003", "999", "w", 1)],
                                "code string, v string, t string, seq int")
    out = rows(C.standardize(raw, "feed", "uri", ["code", "v"], numeric=["v"], text=["t"], critical=["v"], ranges={"v": (0, 100)},
                             keys=["code"], order="seq", extracted_at=datetime(2026, 1, 1)))
    assert [(r["code"], r["v"], r["t"], r["_source_uri"]) for r in out] == [("5001", 13.0, "y", "uri")]


def test_drop_missing_reports_counts(spark):
    seen = Observation("dropped")
    df = spark.createDataFrame([(1, None), (2, "a"), (None, "b")], "a int, b string")
    assert C.drop_missing(df, ["a", "b"], seen).count() == 1
    assert seen.get == {"rows": 3, "dropped": 2}


def test_aliases_and_contract(spark):
    df = spark.createDataFrame([(1, "x")], "ID_Muni int, Nombre string")
    out = C.align_to_contract(C.resolve_aliases(df, {"town_id": ["codigo", "id_muni"], "town": ["nombre"]}), {"town": "string", "town_id": "string", "alt": "double"})
    assert out.dtypes == [("town", "string"), ("town_id", "string"), ("alt", "double")]
    assert tuple(out.first()) == ("x", "1", None)


def test_sensor_labels_later_rule_wins(spark):
    from cropspark.plans.climate import label_sensor

    df = spark.createDataFrame([("Temperatura",), ("HUMEDAD y temp",), ("radiacion",), ("viento",)], "s string")
    assert [r[0] for r in df.select(label_sensor(F.col("s"))).collect()] == ["temperatura_media_c", "humedad_relativa_pct", "brillo_solar_horas_dia", None]


# --- aggregates ---------------------------------------------------------------------------------------
def test_harvest_rollup(spark, rows):
    df = spark.createDataFrame([("a", 10.0, 10.0, 20.0, 2.0), ("a", 10.0, 10.0, 40.0, 4.0), ("b", None, None, None, None), ("c", 5.0, 0.0, 0.0, 3.0)],
                               "k string, sown double, cut double, tons double, y double")
    got = {r["k"]: r for r in rows(A.harvest_rollup(df, ["k"], "sown", "cut", "tons", "y"))}
    assert got["a"]["y"] == 3.0 and got["a"]["tons"] == 60.0
    assert got["b"]["sown"] is None and got["b"]["y"] is None
    assert got["c"]["y"] == 3.0


def test_combine_blocks(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 2.0, 1), ("a", 4.0, 3.0, 9.0, 2), ("b", None, None, None, 0)], "k string, m double, lo double, hi double, n int")
    assert [tuple(r) for r in A.combine_blocks(df, ["k"], "m", "lo", "hi", "n").collect()] == [("a", 3.0, 0.0, 9.0, 3)]


def test_mode_and_dominant_class(spark):
    df = spark.createDataFrame([("05001", c) for c in ["III", "VI", "II", "VI", None, "II", "VI"]] + [("1", "b"), ("1", "a"), ("1", None)], "k string, c string")
    assert dict(tuple(r) for r in A.most_frequent_class(df, ["k"], "c", "c").collect()) == {"05001": "VI", "1": "a"}


def test_regression_metrics(spark):
    df = spark.createDataFrame([("p", 1.0, 1.0), ("p", 2.0, 2.0), ("s", 1.0, 2.0), ("s", 2.0, 3.0), ("s", 3.0, 4.0), ("s", 4.0, 5.0), ("c", 1.0, 1.0)], "k string, y double, p double")
    got = {r.k: r for r in A.regression_metrics(df, "y", "p", ["k"]).collect()}
    assert (got["p"].mae, got["p"].rmse, got["p"].r2) == (0, 0, 1)
    assert got["s"].mae == 1 and got["s"].n == 4
    assert got["c"].r2 is None


def test_classification_metrics(spark):
    y, p = [0, 0, 1, 2, 2, 2], [0, 1, 1, 2, 0, 2]
    got = A.classification_metrics(spark.createDataFrame(list(zip(y, p)), "y int, p int"), "y", "p").first()
    f1 = [2 * 1 / (2 + 2), 2 * 1 / (1 + 2), 2 * 2 / (3 + 2)]
    assert got.accuracy == pytest.approx(4 / 6)
    assert got.f1_weighted == pytest.approx((2 * f1[0] + f1[1] + 3 * f1[2]) / 6)


def test_completeness_of_empty_and_filled(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, "y")], "a int, b string")
    r = A.completeness(df, ["a"]).first()
    assert r.completeness_pct == {"a": 100.0, "b": 66.67} and r.key_duplicates == 1
    assert A.completeness(df.limit(0)).first().completeness_pct == {"a": 0.0, "b": 0.0}


# --- windows ------------------------------------------------------------------------------------------
def test_calendar_lags_respect_gaps(spark):
    df = spark.createDataFrame([("m", 2019, 100.0), ("m", 2020, 200.0), ("m", 2022, 400.0)], "k string, y int, v double")
    got = {r.y: r for r in df.withColumns({"l1": W.value_at_offset(["k"], "y", "v", -1), "l3": W.value_at_offset(["k"], "y", "v", -3)}).collect()}
    assert (got[2020].l1, got[2022].l1, got[2022].l3) == (100.0, None, 100.0)
    joined = {r.y: r for r in J.shifted_lookup(df, ["k"], "y", ["v"], 1, "_lag1").collect()}
    assert joined[2020].v_lag1 == 100.0 and joined[2022].v_lag1 is None


def test_prior_mean_ignores_missing_and_current(spark):
    df = spark.createDataFrame([("k", 1, 2.0), ("k", 2, None), ("k", 3, 4.0), ("k", 4, 10.0)], "k string, y int, v double")
    assert [r.h for r in df.withColumn("h", W.prior_mean(["k"], "y", "v")).orderBy("y").collect()] == [None, 2.0, 2.0, 3.0]


def test_climatology(spark):
    data = [(1, 2018 + i, 1, v) for i, v in enumerate([60.0, 80.0, 40.0, 90.0, 30.0])] + [(1, 2018, 2, 50.0)]
    df = spark.createDataFrame(data, "region int, year int, month int, rain double")
    got = {(r.month, r.year): r for r in W.climatology(df, ["region", "month"], "rain", 4).collect()}
    assert got[(1, 2021)].anomaly_pct == 50.0 and got[(1, 2021)].z_score > 0 > got[(1, 2022)].z_score
    assert got[(2, 2018)].anomaly_pct is None and got[(2, 2018)].z_score is None


def test_value_before_with_age_bounds(spark):
    days = [date(2026, 1, d) for d in (1, 2, 9, 20)]
    df = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(days)], "k string, day date, v double")
    free = {r.day: r for r in W.with_value_before(df, ["k"], "day", "v", "p", 7).collect()}
    bound = {r.day: r for r in W.with_value_before(df, ["k"], "day", "v", "p", 1, 5).collect()}
    assert (free[days[2]].p, free[days[2]].p_day, free[days[0]].p) == (1.0, days[1], None)
    assert bound[days[1]].p == 0.0 and bound[days[2]].p is None


def test_forward_fill_and_interpolation(spark):
    df = spark.createDataFrame([("s", 0, 1.0, 12), ("s", 6, 7.0, 12)], "k string, i long, v double, stop long")
    filled = [(r.i, r.v) for r in W.forward_fill(df, ["k"], "i", "v", 3, "stop").orderBy("i").collect()]
    assert filled == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0), (6, 7.0), (7, 7.0), (8, 7.0), (9, 7.0)]
    gaps = spark.createDataFrame([("s", 0, None), ("s", 1, 1.0), ("s", 3, 3.0), ("s", 5, None)], "k string, i long, v double")
    assert [(r.i, r.v) for r in W.interpolate(gaps, ["k"], "i", "v").orderBy("i").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 3.0), (5, 3.0)]


def test_rolling_counts_steps_not_rows(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in (0, 1, 2, 9)], "k string, i long, v double")
    got = {r.i: r.m for r in df.withColumn("m", W.rolling(["k"], "i", "v", 3, 2)).collect()}
    assert got == {0: None, 1: 0.5, 2: 1.0, 9: None}


# --- ranks --------------------------------------------------------------------------------------------
def test_exact_quantiles_match_numpy_on_skewed_groups(spark):
    rng = np.random.default_rng(1)
    data = [("hot", float(v)) for v in np.round(rng.lognormal(0, 2, 3000), 2)] + [("cold", float(v)) for v in rng.normal(size=7)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r.g: r for r in RK.exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    assert set(got) == {"hot", "cold", "one"}
    for g in got:
        values = [v for k, v in data if k == g]
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_rows_below_with_ties(spark):
    values = [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: (r.n, r.below, r.total) for r in RK.rows_below(df, [], "v").collect()}
    assert got == {1.0: (2, 0, 6), 2.0: (1, 2, 6), 3.0: (3, 3, 6)}


@pytest.mark.parametrize("ranges", [2, 64, 1024])
def test_rows_below_for_any_number_of_ranges(spark, ranges):
    rng = np.random.default_rng(9)
    values = np.round(rng.exponential(50, 2500), 1)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double").repartition(4)
    got = {r.v: (r.n, r.below) for r in RK.rows_below(df, ["g"], "v", ranges).collect()}
    assert got == {v: (int((values == v).sum()), int((values < v).sum())) for v in set(values.tolist())}


def test_dense_codes_and_surrogate_keys(spark):
    names = [f"n{i:03d}" for i in range(300)]
    shuffled = names * 2
    random.Random(3).shuffle(shuffled)
    df = spark.createDataFrame([(n,) for n in shuffled] + [(None,)], "name string")
    assert {r.name: r.code for r in RK.dense_codes(df, "name").collect()} == {n: i for i, n in enumerate(names)}
    known = spark.createDataFrame([("n005", 7), ("x", 40)], "name string, id int")
    keys = {r.name: r.id for r in RK.assign_surrogate_keys(known, df, "name", "id").collect()}
    assert "n005" not in keys and sorted(keys.values()) == list(range(41, 41 + 299)) and keys["n000"] == 41


# --- latest and top -----------------------------------------------------------------------------------
def test_latest_and_dedupe_are_repeatable(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q")], "k string, o int, v string")
    for n in (1, 3):
        got = {r.k: r.v for r in Q.dedupe_latest(df.repartition(n), ["k"], ["o"]).collect()}
        assert got == {"a": "z", "b": "q"}


def test_union_with_precedence(spark):
    a = spark.createDataFrame([(1, "active")], "k int, o string")
    b = spark.createDataFrame([(1, "history"), (2, "history")], "k int, o string")
    assert {r.k: r.o for r in Q.union_with_precedence([a, b], ["k"]).collect()} == {1: "active", 2: "history"}


# --- joins --------------------------------------------------------------------------------------------
def _nearest_by_force(points, centres):
    out = {}
    for pid, lat, lon, alt in points:
        if lat is None or lon is None:
            out[pid] = None
            continue
        best = None
        for cid, clat, clon, calt in centres:
            a, b, c, d = np.radians([lat, lon, clat, clon])
            h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
            km = 6371.0 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
            climb = 0.0 if alt is None or calt is None else abs(alt - calt)
            best = min(best or (np.inf, None, None), (km + climb * 0.1, cid, km))
        out[pid] = (best[1], best[2])
    return out


def test_nearest_centre_equals_brute_force(spark):
    rng = random.Random(5)
    centres = [(i, rng.uniform(-4, 12), rng.uniform(-79, -67), rng.choice([None, rng.uniform(0, 3000)])) for i in range(40)]
    points = [(i, rng.uniform(-4, 12), rng.uniform(-79, -67), rng.choice([None, rng.uniform(0, 3000)])) for i in range(120)]
    points += [(500, 89.5, 10.0, 0.0), (501, -60.0, 179.9, None), (502, None, -70.0, 1.0), (503, 5.0, -70.0, 9000.0), (504, -90.0, 0.0, 5.0), (505, 5.0, 110.0, None)]
    points += [(600 + i, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([None, rng.uniform(0, 90_000)])) for i in range(80)] + [(700, 5.0, 110.0, None)]
    schema = "{0} int, lat double, lon double, alt double"
    got = {r.p: r for r in J.nearest_centre(spark.createDataFrame(points, schema.format("p")), spark.createDataFrame(centres, schema.format("c")), "p", "c").collect()}
    for pid, want in _nearest_by_force(points, centres).items():
        if want is None:
            assert got[pid].c is None and got[pid].method == "unresolved"
        else:
            assert got[pid].c == want[0] and got[pid].distance_km == pytest.approx(want[1], rel=1e-9)


def test_nearest_centre_in_a_dense_cell(spark):
    """100,000 places and 100,000 centres within one degree, and some far away from all: no cell is all pairs, and every answer is exact."""
    rng = np.random.default_rng(8)
    n = 100_000
    side = lambda: (4 + rng.random(n), -74 + rng.random(n), np.where(rng.random(n) < 0.01, np.nan, rng.random(n) * 3000))
    places, centres = side(), side()
    places[0][:50], places[1][:50] = rng.uniform(-89, 89, 50), rng.uniform(-179, 179, 50)
    frame = lambda s, name: spark.createDataFrame(pd.DataFrame({name: np.arange(n), "lat": s[0], "lon": s[1], "alt": s[2]})).withColumn("alt", F.nullif(F.col("alt"), F.lit(float("nan"))))
    out = J.nearest_centre(frame(places, "p"), frame(centres, "c"), "p", "c")
    got = out.toPandas().set_index("p")
    assert len(got) == n and got["c"].notna().all()
    lat, lon, alt = np.radians(centres[0]), np.radians(centres[1]), centres[2]
    for p in [*range(50), *rng.integers(0, n, 250)]:
        a = np.sin((lat - np.radians(places[0][p])) / 2) ** 2 + np.cos(np.radians(places[0][p])) * np.cos(lat) * np.sin((lon - np.radians(places[1][p])) / 2) ** 2
        cost = 6371.0 * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) + np.nan_to_num(np.abs(alt - places[2][p])) * 0.1
        assert cost[int(got.loc[p, "c"])] <= cost.min() + 1e-9


def test_names_stand_in_for_coordinates(spark):
    points = spark.createDataFrame([(1, 4.0, -74.0, None, "nowhere"), (2, None, None, None, " BOGOTÁ (D.C.)"), (3, None, -74.0, None, "santa fe"), (4, None, None, None, None), (5, float("nan"), 1.0, None, "zzz")],
                                   "p int, lat double, lon double, alt double, name string")
    centres = spark.createDataFrame([(11, 4.1, -74.1, 2600.0, "Bogota"), (12, 10.0, -75.0, 2.0, "Cartagena"), (13, None, None, None, "Lost")], "c int, lat double, lon double, alt double, town string")
    synonyms = spark.createDataFrame([("Santa Fé", "11")], "synonym string, code string")
    got = {r.p: (r.c, r.method) for r in J.assign_centres(points, centres, "p", "c", "name", "town", synonyms).collect()}
    assert got == {1: (11, "within_radius_and_altitude"), 2: (11, "text"), 3: (11, "text"), 4: (None, "unresolved"), 5: (None, "unresolved")}
    none = {r.p: (r.c, r.method) for r in J.assign_centres(points, centres.where("c = 13"), "p", "c", "name", "town", {}).collect()}
    assert set(none.values()) == {(None, "unresolved")}


def test_nearest_centre_ties_and_radius(spark):
    centres = spark.createDataFrame([(2, 4.0, -74.0, 100.0), (1, 4.0, -74.0, 100.0)], "c int, lat double, lon double, alt double")
    points = spark.createDataFrame([(1, 4.1, -74.0, 100.0), (2, 4.1, -74.0, 600.0), (3, 5.0, -74.0, None)], "p int, lat double, lon double, alt double")
    got = {r.p: (r.c, r.method) for r in J.nearest_centre(points, centres, "p", "c").collect()}
    assert got == {1: (1, "within_radius_and_altitude"), 2: (1, "nearest_outside"), 3: (1, "nearest_outside")}


def test_name_resolution_falls_back_to_synonyms(spark):
    towns = spark.createDataFrame([("Medellín", "05001"), ("San Andrés", "88001"), ("San Andres", "05647")], "town string, code string")
    df = spark.createDataFrame([("MEDELLIN (Antioquia)",), ("Santa Fe de Bogotá",), ("san andrés",), ("Nowhere",), (None,)], "name string")
    got = {r.name: r.code for r in J.resolve_names(df, "name", towns, "town", "code").collect()}
    assert got == {"MEDELLIN (Antioquia)": "05001", "Santa Fe de Bogotá": "11001", "san andrés": "88001", "Nowhere": None, None: None}


def test_expand_over_table_of_any_size(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (None, None)], "a int, v array<int>")
    table = spark.range(1500).selectExpr("id AS r", "id % 7 AS s", "'x' AS other")
    got = J.expand_over_table(df, table, ["r", "s"])
    assert got.columns == ["a", "v", "r", "s"] and got.count() == 4500 and got.distinct().count() == 3000
    assert J.expand_over_table(df, table.limit(0), ["r"]).count() == 0


# --- merges -------------------------------------------------------------------------------------------
PRICE = "k int, day date, mean double, low double, high double, origin string"
DAY = date(2026, 1, 1)


def _precedence(spark, stored, new):
    out = M.upsert_by_precedence(spark.createDataFrame(stored, PRICE), spark.createDataFrame(new, PRICE), ["k", "day"], "mean", "low", "high", "origin")
    return {r.k: (r.mean, r.low, r.high, r.origin, r.change_type) for r in out.collect()}


def test_precedence_rules(spark):
    got = _precedence(
        spark,
        [(1, DAY, 10.0, 9.0, 11.0, "soap"), (2, DAY, 10.0, None, None, "excel"), (3, DAY, 10.0, 9.0, 11.0, "soap"), (4, DAY, 10.0, 9.0, 11.0, "soap"), (6, DAY, 1.0, None, None, "excel")],
        [(1, DAY, 20.0, None, None, "excel"), (2, DAY, 20.0, 19.0, 21.0, "soap"), (3, DAY, 10.0, None, None, "soap"), (4, DAY, 12.0, None, 13.0, "soap"),
         (5, DAY, 5.0, None, None, "excel"), (5, DAY, 6.0, None, None, "soap")])
    assert got == {
        1: (10.0, 9.0, 11.0, "soap", "refused"), 2: (20.0, 19.0, 21.0, "soap", "changed"), 3: (10.0, 9.0, 11.0, "soap", "same"),
        4: (12.0, 9.0, 13.0, "soap", "changed"), 5: (6.0, None, None, "soap", "inserted"), 6: (1.0, None, None, "excel", "kept")}


def test_precedence_merge_is_idempotent(spark):
    new = [(i, DAY, float(i), None, None, "soap") for i in range(1, 5)]
    empty = spark.createDataFrame([], PRICE)
    once = M.upsert_by_precedence(empty, spark.createDataFrame(new, PRICE), ["k", "day"], "mean", "low", "high", "origin").drop("change_type")
    twice = M.upsert_by_precedence(once, spark.createDataFrame(new, PRICE), ["k", "day"], "mean", "low", "high", "origin")
    assert {r.change_type for r in twice.collect()} == {"same"}


def test_upsert_matches_missing_keys_and_dedupes_source(spark):
    target = spark.createDataFrame([("a", None, 1), ("b", 1, 2)], "k string, region int, v int")
    source = spark.createDataFrame([("a", None, 5), ("a", None, 4), ("c", 2, 3)], "k string, region int, v int")
    got = {r.k: (r.v, r.change_type) for r in M.upsert(target, source, ["k", "region"], ["v"]).collect()}
    assert got == {"a": (5, "changed"), "b": (2, "kept"), "c": (3, "inserted")}
    assert {r.change_type: r.n for r in M.reconcile(target, source, ["k", "region"]).collect()} == {"changed": 1, "kept": 1, "inserted": 1}


def test_fill_only(spark):
    target = spark.createDataFrame([(1, None, "x"), (2, 5.0, "y"), (3, None, "z")], "k int, v double, o string")
    source = spark.createDataFrame([(1, 9.0), (2, 8.0), (4, 7.0)], "k int, v double")
    assert sorted((r.k, r.v, r.was_matched) for r in M.fill_missing(target, source, ["k"], ["v"]).collect() if r.v is not None) == [(1, 9.0, True), (2, 5.0, True)]


def test_versions_survive_a_failed_write(spark, tmp_path):
    base = str(tmp_path / "t")
    assert M.read_current(spark, base) is None
    assert M.write_version(spark.range(3), base) == 1
    (tmp_path / "t" / "version=2").mkdir()  # a job that died before its success marker
    assert M.read_current(spark, base).count() == 3
    assert M.write_version(M.read_current(spark, base).union(spark.range(2)), base) == 2
    assert M.read_current(spark, base).count() == 5


def test_partition_replace_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, m string").write.partitionBy("m").parquet(path)
    M.replace_partitions(spark.createDataFrame([(9, "b")], "v int, m string"), path, ["m"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "m").collect()) == [(1, "a"), (9, "b")]


def test_model_registry(spark):
    reg = spark.createDataFrame([(1, "m", datetime(2026, 1, 1), '{"mae":2}')], "id_version long, model_name string, trained_at timestamp, metrics_json string")
    out = M.append_model_version(reg, "m", F.lit('{"mae":1}'), F.lit(datetime(2026, 2, 1)))
    assert [(r.id_version, r.metrics_json) for r in M.active_versions(out).collect()] == [(2, '{"mae":1}')]


# --- quality ------------------------------------------------------------------------------------------
def test_declared_constraints(spark):
    df = spark.createDataFrame([(1, "05001", 5.0), (1, "05001", 500.0), (None, "99999", None)], "id int, town string, v double")
    towns = spark.createDataFrame([("05001",)], "code string")
    got = {r.check: (r.passed, r.failing_rows) for r in QC.validate_table(
        df, "m", ["id", "v"], ["id"], {"v": (0, 100)}, {"town": 5}, {"town": (towns, "code")}).collect()}
    assert got == {"id not null": (False, 1), "v not null": (False, 1), "v in range": (False, 1), "town length": (True, 0),
                   "id unique": (False, 2), "town in reference": (False, 1)}


def test_indicator_states(spark):
    one = spark.range(1)
    states = [QC.indicator("i", one.select(F.lit(v).cast("double")), 1, 5).first().state for v in (None, 0.0, 3.0, 6.0)]
    assert states == ["SIN_DATOS", "ALERTA", "OK", "ALERTA"]


def test_missing_months_and_due(spark):
    from cropspark.streaming import ingest as IN

    present = spark.createDataFrame([(2026, 1), (2026, 3)], "year int, month int")
    assert sorted(tuple(r) for r in IN.missing_months(present, "2026-01-01", "2026-04-01").collect()) == [(2026, 2), (2026, 4)]
    fact = spark.createDataFrame([(DAY + timedelta(days=3),)], "day date")
    runs = spark.createDataFrame([("s", "ok", DAY), ("s", "error", DAY + timedelta(days=9))], "source string, status string, max_day date")
    assert IN.newer_data(fact, runs, "s").first().is_due is True
    assert IN.newer_data(fact, runs, "never").first().is_due is True


def test_report_sync_ignores_foreign_and_broken_documents(spark):
    good = '{"source":"s","uri":"u","rows":3,"columns":2,"completeness_pct":{"a":100.0},"key_duplicates":0,"extracted_at":"2026-01-01T00:00:00Z"}'
    docs = spark.createDataFrame([(good,), ('{"other":1}',), ("{broken",)], "d string")
    schema = "source string, uri string, rows long, columns int, completeness_pct string, key_duplicates long, extracted_at string"
    once = QC.sync_reports(spark.createDataFrame([], schema), docs, "d")
    assert [(r.source, r.rows, r.completeness_pct, r.change_type) for r in once.collect()] == [("s", 3, '{"a":100.0}', "inserted")]
    again = QC.sync_reports(once.drop("change_type"), docs, "d")
    assert [r.change_type for r in again.collect()] == ["same"]


def test_standardize_report_counts_every_step(spark):
    """A row counts for the first step it fails; one action makes the rows and all counts, and the document is what the report store takes."""
    raw = spark.createDataFrame(
        [("a", "5", " x ", 1), ("a", "7", "y", 2), ("b", "sin dato", "z", 1), (None, "9", "z", 1), ("c", "-4", None, 1), ("d", "900", "w", 1), ("e", "50", None, 99), ("f", "10", None, 1)],
        "code string, v string, t string, n int")
    cleaned, report = C.standardize_with_report(
        raw, "feed", "uri", ["code", "v"], datetime(2024, 5, 1), numeric=["v", "n"], text=["t"], critical=["code", "v"], ranges={"v": (0, 100), "n": (None, 50)}, keys=["code"], order="n")
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    got = {r.code: (r.v, r.t) for r in cleaned.collect()}
    assert got == {"a": (7.0, "y"), "f": (10.0, None)}
    assert report.metrics() == {
        "read": 8, "dropped:missing": 2, "dropped:range:v": 2, "dropped:range:n": 1, "dropped:duplicate": 1, "missing:code": 1, "missing:v": 1, "kept": 2}
    assert report.completeness()["t"] == 50.0 and report.completeness()["v"] == 100.0
    stored = QC.sync_reports(spark.createDataFrame([], QC.REPORT_FIELDS.replace("MAP<STRING, DOUBLE>", "STRING")), spark.createDataFrame([(report.document(),)], "d string"), "d").first()
    assert (stored.source, stored.rows, stored.columns, stored.key_duplicates) == ("feed", 2, 6, 0)
    same = C.standardize(raw, "feed", "uri", ["code", "v"], numeric=["v", "n"], text=["t"], critical=["code", "v"], ranges={"v": (0, 100), "n": (None, 50)}, keys=["code"], order="n", extracted_at=datetime(2024, 5, 1))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, cleaned.collect()))


def test_standardize_report_of_no_rows(spark):
    raw = spark.createDataFrame([], "code string, v string")
    cleaned, report = C.standardize_with_report(raw, "feed", "uri", ["code"], datetime(2024, 5, 1), critical=["code"], keys=["code"])
    assert cleaned.collect() == [] and report.metrics() == {"read": 0, "dropped:missing": 0, "dropped:duplicate": 0, "missing:code": 0, "kept": 0} and report.completeness() == {}


def test_ordered_ranges_hold_a_hot_group(spark):
    """Running counts, sums and maxima of a group that spans many ranges equal those of one pass over it."""
    rng = np.random.default_rng(4)
    n = 20_000
    df = pd.DataFrame({"g": np.where(rng.random(n) < 0.9, "hot", "g" + pd.Series(rng.integers(0, 50, n)).astype(str)), "o": rng.permutation(n), "v": rng.integers(-50, 50, n)})
    placed = RK.OrderedRanges(spark.createDataFrame(df).repartition(6), ["g"], ["o"], parts=9)
    assert placed.rows.where("g = 'hot'").select("_part").distinct().count() > 5
    got = placed.add(k=("sum", F.lit(1)), m=("total", F.lit(1)), s=("sum", F.col("v")), top=("max", F.col("v"))).rows.toPandas().sort_values("o").reset_index(drop=True)
    want = df.sort_values("o").reset_index(drop=True)
    groups = want.groupby("g")["v"]
    assert (got["k"] == groups.cumcount() + 1).all() and (got["m"] == groups.transform("size")).all()
    assert (got["s"] == groups.cumsum()).all() and (got["top"] == groups.cummax()).all()


def test_holm_of_very_many_pairs(spark):
    from cropspark.operators import stats as ST

    rng = np.random.default_rng(6)
    p = np.round(rng.random(8000) ** 6, 6)
    rows = pd.DataFrame({"comparison": "c", "group1": np.arange(8000) // 100, "group2": np.arange(8000) % 100, "p": p})
    got = ST.holm(spark.createDataFrame(rows).repartition(7), ["comparison"]).toPandas().sort_values(["p", "group1", "group2"])
    raised = np.minimum(1, np.sort(p) * np.arange(8000, 0, -1))
    assert np.allclose(got["p_adjusted"], np.maximum.accumulate(raised)) and (got["significant"] == (got["p_adjusted"] <= 0.05)).all()
    assert list(got.columns) == ["comparison", "group1", "group2", "p", "p_adjusted", "significant"]
    alone = spark.createDataFrame([("x", "a", "b", None), ("x", "a", "c", 0.01), ("y", "a", "b", 0.04)], "comparison string, group1 string, group2 string, p double")
    assert {(r.comparison, r.group2): r.p_adjusted for r in ST.holm(alone, ["comparison"]).collect()} == {("x", "b"): None, ("x", "c"): 0.01, ("y", "b"): 0.04}


def test_range_report(spark):
    df = spark.createDataFrame([(1.0, None), (7.0, None), (None, None)], "a double, b int")
    got = {r.column_name: (r.min, r.max, r.out_of_range, r.passed) for r in QC.range_report(df, {"a": (2, None), "b": (0, 1)}).collect()}
    assert got == {"a": (1.0, 7.0, 1, False), "b": (None, None, 3, False)}
    assert QC.range_report(df, {"a": (0, 7)}).first().passed


def test_places_in_spanish_order(spark):
    names = ["ñame", "nuez", "oca", "Ají", "", " ", None, "ajo", "zanahoria", "Árbol", "arbol"]
    df = spark.createDataFrame([("g", n, i) for i, n in enumerate(names)] + [("h", "x", 99)], "kind string, value string, i int").repartition(4)
    got = Q.in_spanish_order(df, ["kind"], "value", ["i"])
    assert got.columns == ["kind", "value", "i", "place"]
    order = [r.value for r in got.where("kind = 'g'").orderBy("place").collect()]
    assert order == ["Ají", "ajo", "arbol", "Árbol", "nuez", "ñame", "oca", "zanahoria", "", " ", None] and got.where("kind = 'h'").first().place == 1
