"""Golden values of the column functions."""

import unicodedata
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark.functions import collections as FC
from cropspark.functions import dates as D
from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.functions import text as T


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize("function,cases", [
    (T.normalise_name, {"Café": "CAFE", "CAFÉ": "CAFE", "  Plátano  hartón ": "PLATANO HARTON", None: None}),
    (T.normalise_text, {"Bogotá D.C.": "bogota d.c.", "MEDELLÍN (Antioquia)": "medellin", "San Andrés": "san andres", "  Cali  ": "cali"}),
    (T.canon_product, {"Papa negra*": "Papa negra", "Papa  criolla": "Papa criolla", "piña *": "Piña"}),
    (T.product_key, {"Papa negra*": "PAPA NEGRA", "Piña *": "PINA", "Fríjol verde*": "FRIJOL VERDE", "Frijol Verde": "FRIJOL VERDE"}),
    (T.canon_title, {"NORTE DE SANTANDER": "Norte de Santander", "VALLE DEL CAUCA": "Valle del Cauca", "BOGOTÁ, D. C.": "Bogotá D.C.",
                     "BOGOTÁ, D.C.": "Bogotá D.C.", "LA GUAJIRA": "La Guajira", None: None}),
    (T.canon_market, {"Bogotá, D.C., Corabastos": "Bogotá, Corabastos", "Ibagué, \nLa 21": "Ibagué, La 21", "Popayán": "Popayán, Plaza del barrio Bolívar"}),
    (T.canon_group, {"FRUTAS": "Frutas", "TUBERCULOS, RAICES Y PLATANOS": "Tubérculos, raíces y plátanos", "GRANOS": "Granos", None: None, "nan": None}),
    (lambda c: T.zero_pad(c, 5), {"5001": "05001", "123456": "123456", " 7 ": "00007", None: None}),
    (T.valid_code, {"05001": "05001", "5": None, "0500a": None, None: None}),
    (T.decimal_comma, {"4,5": 4.5, "-74,08": -74.08, "x": None, None: None}),
    (T.csv_cell, {"=1+1": "'=1+1", 'a"b': '"a""b"', "a,b": '"a,b"', None: "", "ok": "ok", "-5": "'-5"}),
    (D.parse_spanish_date, {"Viernes 24 de abril de 2026": date(2026, 4, 24), "31 de febrero de 2026": None, "sin fecha": None, None: None}),
    (N.clean_number, {"12.5": 12.5, "abc": None, "NaN": None, None: None}),
    (lambda c: N.bounded_int(c, 1, 50, 7), {"12.9": 12, "99": 50, "-3": 1, "x": 7, None: 7}),
    (N.positive_id, {"12": 12, "0": None, "-1": None, "1.5": None, "x": None}),
    (R.suitability_class, {"Alta": "alta", "Aptitud media": "moderada", "Baja": "marginal", "No apta": "no_apta", "Exclusion legal": "no_apta", None: None}),
    (R.input_type, {"_15_15_15": "Fertilizante", "Urea": "Fertilizante", "herbicida_x": "Plaguicida", "jornal": "Otros"}),
    (R.ordinal_score, {"alta": 3.0, "no_apta": 0.0, "?": None, None: None}),
])
def test_text_cases(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_strip_accents_follows_unicode_decomposition(spark):
    sample = "".join(chr(c) for c in range(0xC0, 0x250)) + "éệが"
    wanted = "".join(c for c in unicodedata.normalize("NFD", sample) if unicodedata.category(c) != "Mn")
    assert apply(spark, T.strip_accents, [sample]) == [wanted]


def test_date_token(spark):
    assert apply(spark, D.date_token, [date(2026, 9, 18), date(2026, 1, 5)], "date") == ["18sep2026", "05ene2026"]


def test_business_days_in_both_conventions(spark):
    start = date(2026, 1, 1)
    pairs = [(start + timedelta(days=i), start + timedelta(days=i + j)) for i in range(9) for j in range(-1, 12)]
    df = spark.createDataFrame(pairs, "a date, b date").select(
        "a", "b", D.business_days_half_open(F.col("a"), F.col("b")).alias("h"), D.business_days_after(F.col("a"), F.col("b")).alias("u"))
    for r in df.collect():
        day = timedelta(days=1)
        assert r.h == (np.busday_count(r.a, r.b) if r.b > r.a else 0)
        assert r.u == (np.busday_count(r.a + day, r.b + day) if r.b > r.a else 0)


def test_business_index_round_trip(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(30)]
    weekdays = [d for d in days if d.weekday() < 5]
    index = apply(spark, D.business_index, weekdays, "date")
    assert index == list(range(index[0], index[0] + len(weekdays)))
    assert apply(spark, lambda c: D.business_date(D.business_index(c)), weekdays, "date") == weekdays


def test_month_index_round_trip(spark):
    got = spark.createDataFrame([(2020, 12), (2021, 1)], "y int, m int").select(D.month_index(F.col("y"), F.col("m")).alias("p")).select(
        D.month_index_year(F.col("p")), D.month_index_month(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(2020, 12), (2021, 1)]


def test_rounding_flavours(spark):
    values = [2.5, 3.5, -2.5]
    assert apply(spark, N.round_half_even, values, "double") == [2.0, 4.0, -2.0]
    assert apply(spark, N.round_half_away, values, "double") == [3.0, 4.0, -3.0]
    assert apply(spark, N.round_half_up, values, "double") == [3.0, 4.0, -2.0]


def test_pct_change_needs_positive_base(spark):
    df = spark.createDataFrame([(110.0, 100.0), (5.0, 0.0), (5.0, None)], "v double, b double")
    assert [r[0] for r in df.select(N.pct_change(F.col("v"), F.col("b"))).collect()] == [10.0, None, None]


def test_bounds(spark):
    assert apply(spark, lambda c: N.clamp_low_null_high(c, 0, 3000), [-5.0, 10.0, 4000.0, None], "double") == [0.0, 10.0, None, None]
    assert apply(spark, lambda c: N.null_outside(c, -10, 50), [-11.0, 50.0, None], "double") == [None, 50.0, None]
    assert apply(spark, lambda c: N.sentinel_to_null(c, -900), [-999.0, -1.0], "double") == [None, -1.0]


def test_haversine(spark):
    df = spark.createDataFrame([(4.711, -74.0721, 6.2442, -75.5812)], "a double, b double, c double, d double")
    km = df.select(N.haversine_km(*[F.col(c) for c in "abcd"])).first()[0]
    assert km == pytest.approx(238.3, abs=1.0)


def test_risk_and_event_rules_ignore_missing_inputs(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None, "Neutral"), (-2.0, -60.0, 39.0, 10.0, 50.0, "El Niño"), (None, None, 25.0, 15.0, 90.0, None)],
        "spi double, anom double, tmax double, tmin double, hum double, phase string")
    got = df.select(R.risk_score(F.col("spi"), F.col("anom"), F.col("tmax"), F.col("phase")),
                    R.event_type(F.col("spi"), F.col("anom"), F.col("tmax"), F.col("tmin"), F.col("hum"))).collect()
    assert [tuple(r) for r in got] == [(0, "Sin evento crítico"), (2, "Sequía severa"), (0, "Condiciones propicias para plagas (regla)")]


def test_confidence_and_phase_and_effect(spark):
    assert apply(spark, R.confidence_class, [0.15, 0.06, 0.03, -0.2, None], "double") == ["alta", "media", "baja", "baja", "baja"]
    assert apply(spark, R.enso_phase, [0.5, -0.5, 0.1, None], "double") == ["El Niño", "La Niña", "Neutral", None]
    assert apply(spark, R.effect_label, [0.005, 0.03, 0.1, 0.14, None], "double") == ["insignificante", "pequeño", "mediano", "grande", "n/d"]
    assert apply(spark, R.flag_number, [True, False, None], "boolean") == [1.0, 0.0, None]
    assert apply(spark, R.freshness_state, [0, 1, 2, 9, None], "int") == ["al_dia", "al_dia", "retrasado", "desactualizado", "sin_datos"]


def test_dose_steps(spark):
    df = spark.createDataFrame([("alta", 0.7), ("marginal", 0.1), ("no_apta", None), (None, None)], "s string, p double")
    assert [r[0] for r in df.select(R.fertiliser_dose(F.col("s"), F.col("p"))).collect()] == [280, 400, 350, 350]


def test_map_and_json_helpers(spark):
    df = spark.createDataFrame([({"a": 100.0, "b": 50.0},), ({},), (None,)], "m map<string,double>")
    got = df.select(FC.map_mean(F.col("m")), F.map_keys(FC.map_below(F.col("m"), 80))).collect()
    assert [tuple(r) for r in got] == [(75.0, ["b"]), (0.0, []), (None, None)]
    assert apply(spark, lambda c: FC.json_number(c, "$.a.b"), ['{"a":{"b":2.5}}', '{"a":1}', "x"]) == [2.5, None, None]


def test_top_by_abs(spark):
    df = spark.createDataFrame([([("a", -3.0), ("b", 2.0), ("c", 3.0), ("d", 0.1)],)], "v array<struct<n:string,x:double>>")
    assert [e["n"] for e in df.select(FC.top_by_abs(F.col("v"), "x", "n", 3).alias("t")).first().t] == ["a", "c", "b"]


def test_spanish_order_puts_blanks_last(spark):
    from cropspark.operators.ranking import spanish_order

    df = spark.createDataFrame([("oro",), ("ñame",), ("",), ("nuez",), ("árbol",)], "v string")
    assert [r[0] for r in df.orderBy(spanish_order("v")).collect()] == ["árbol", "nuez", "ñame", "oro", ""]
