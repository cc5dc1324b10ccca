"""Shapes of physical plans that matter at scale."""

import re
from datetime import date

from pyspark.sql import functions as F

from cropspark.operators import ranking as Q
from cropspark.operators import windows as W
from cropspark.plans import prices as P
from cropspark.plans import report as RP
from cropspark.sources import readers as RD
from cropspark.sources import sinks as SK


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def quotes(spark, hot=0):
    rows = [(1, "a", date(2026, m, d), float(m * d)) for m in (1, 2, 3) for d in range(1, 20)]
    rows += [(9, "hot", date(2026, 1, 5), float(i % 7)) for i in range(hot)]
    return spark.createDataFrame(rows, "market_id int, product_id string, day date, price double")


def test_lookups_share_one_sort_and_one_window_shuffle(spark):
    text = plan(P.with_changes(P.daily_prices(quotes(spark)), last_flag="is_last"))
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(market_id#\d+, product_id#\d+,? \d+\)|Exchange hashpartitioning", text)) == 2
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_a_hot_series_reaches_the_window_as_its_days(spark):
    """A third of all quotes under one series and day: the partial aggregate leaves one row for it before any shuffle."""
    raw = quotes(spark, hot=2000)
    text = plan(P.daily_prices(raw))
    assert text.index("partial_avg") > text.index("Exchange")  # the plan prints the later step first
    assert P.daily_prices(raw).where("product_id = 'hot'").count() == 1
    last = P.with_changes(P.daily_prices(raw)).where("product_id = 'hot'").first()
    assert last.price_max == 6.0 and last.previous is None


def test_latest_row_is_combined_before_the_shuffle(spark):
    text = plan(Q.latest_per_key(quotes(spark), ["market_id"], ["day"]))
    assert "partial_max_by" in text and "Window" not in text


def test_group_means_do_not_use_windows(spark):
    assert "Window" not in plan(W.relative_to_group_mean(quotes(spark), ["product_id"], "price", index="ix"))


def test_report_reads_its_months_only(spark, tmp_path):
    path = str(tmp_path / "fact")
    SK.write_price_fact(P.daily_prices(quotes(spark)), path)
    day = date(2026, 3, 10)
    fact = RD.read_price_fact(spark, path, since=date(2026, 2, 1), until=day)
    text = fact._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year_month" in text and "PushedFilters: [IsNotNull(day), GreaterThanOrEqual(day" in text
    named = fact.withColumns({"market": F.lit("m"), "department": F.lit("d"), "product": F.col("product_id")})
    base = RP.report_base(named, day)
    assert base.first().previous == 27.0
    pruned = re.search(r"ReadSchema: struct<([^>]*)>", base.select("change_day_pct")._jdf.queryExecution().toString()).group(1)
    assert "price_min" not in pruned and "price_max" not in pruned


def test_overall_state_follows_the_worst(spark):
    from cropspark.operators import quality as QC
    from cropspark.plans import serving as V

    sources = spark.createDataFrame([("a", "ok"), ("b", "error")], "source string, last_status string")
    runs = spark.createDataFrame([("x", "ALERTA", 1), ("x", "OK", 2), ("y", "ALERTA", 1), ("z", "SIN_DATOS", 3)], "indicator string, state string, executed_at int")
    models = spark.createDataFrame([(1, "m", 5), (2, "m", 9), (3, "n", 7)], "id_version int, model_name string, trained_at int")
    state = lambda s, i: V.overall_state(s, QC.latest_indicators(i), models).first()
    got = state(sources, runs)
    assert (got.state, got.n_ok, got.n_alert, got.n_without_data, got.checked_at, got.model, got.trained_at) == ("con_errores", 1, 1, 1, 3, "m", 9)
    assert state(sources.where("source = 'a'"), runs).state == "con_alertas" and state(sources.where("source = 'a'"), runs.where("indicator = 'x'")).state == "ok"
    assert state(sources.limit(0), runs.limit(0)).state == "sin_datos"


def test_prediction_answer_keeps_what_is_missing(spark):
    from cropspark.plans import serving as V

    found = spark.createDataFrame([(1, "c", 2030, 2024, 5.0), (2, "c", 2024, 2024, 6.0)], "town_id int, crop_id string, asked_year int, year int, predicted double")
    harvest = spark.createDataFrame([(1, "c", 2024, 4.5)], "town_id int, crop_id string, year int, yield_t_ha double")
    alerts = spark.createDataFrame([(1, 2024, 3, "BAJO", 0.1), (1, 2024, 11, "ALTO", 0.9)], "town_id int, year int, month int, level string, score double")
    models = spark.createDataFrame([(1, "y", '{"mae": 3.0}'), (2, "y", '{"mae": 2.266}'), (9, "other", '{"mae": 1.0}')], "id_version int, model_name string, metrics_json string")
    got = {r.town_id: (r.real, r.risk, r.score, r.typical_error, r.test_error) for r in V.prediction_answer(found, harvest, alerts, models, "y").collect()}
    assert got == {1: (4.5, "ALTO", 0.9, 2.27, None), 2: (None, None, None, 2.27, None)}
    none = V.prediction_answer(found, harvest, alerts, models, "never").collect()
    assert len(none) == 2 and {r.typical_error for r in none} == {None}
