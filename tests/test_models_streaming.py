"""Folds, intervals, forecast panel, models, streaming."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark.functions import dates as D
from cropspark.models import anomalies as AN
from cropspark.models import folds as FO
from cropspark.models import price_forecast as PF
from cropspark.models import seasonal as SE
from cropspark.models import yield_model as YM
from cropspark.operators import merge as M
from cropspark.plans import prices as P
from cropspark.sources import parsers as X
from cropspark.streaming import ingest as IN


def test_year_folds():
    years = [2021, 2019, 2024, 2020, 2022, 2023, 2023]
    folds = FO.year_folds(years)
    assert [v for _, v in folds] == [2022, 2023, 2024] and folds[0][0] == [2019, 2020, 2021]
    assert FO.year_folds(reversed(years)) == folds
    with pytest.raises(ValueError):
        FO.year_folds([2019, 2020, 2021])


def out_of_fold(spark, broken=False):
    rng = np.random.default_rng(4)
    rows = []
    for year in (2021, 2022, 2023):
        for i in range(200):
            y = 10 + rng.normal()
            rows.append((i, i % 2, year, y + (100 if broken and year == 2023 else 0), 10.0))
    return spark.createDataFrame(rows, "town_id int, crop_id int, year int, y double, yhat double")


def test_intervals_are_calibrated_on_other_years(spark):
    years = [2021, 2022, 2023]
    fine = FO.calibrated_intervals(out_of_fold(spark), 2023, years)
    assert 0.70 <= FO.interval_coverage(fine, 2023).first().coverage <= 0.90
    assert fine.where("lo > hi or lo < 0").count() == 0
    broken = FO.calibrated_intervals(out_of_fold(spark, broken=True), 2023, years)
    width = lambda df: df.where("year = 2022").agg(F.avg(F.col("hi") - F.col("lo"))).first()[0]
    assert width(fine) == pytest.approx(width(broken))


def test_baseline_order(spark):
    df = spark.createDataFrame([(1, 2019, 4.0, None), (1, 2020, 6.0, 4.0), (2, 2020, 9.0, None), (1, 2021, 99.0, None), (3, 2021, 50.0, None)],
                               "crop_id int, year int, y double, hist double")
    got = {(r.crop_id, r.year): r.baseline for r in FO.with_baseline(df, F.col("year") < 2021, "y", "hist", "crop_id").collect()}
    assert got[(1, 2020)] == 4.0 and got[(1, 2021)] == 5.0 and got[(3, 2021)] == pytest.approx(19 / 3)


# --- forecast -----------------------------------------------------------------------------------------
def price_history(n=320):
    rng = np.random.default_rng(0)
    days = [d for d in (date(2024, 1, 1) + timedelta(days=i) for i in range(n * 2)) if d.weekday() < 5][:n]
    rows = []
    for market, product in ((1, 10), (2, 10), (1, 11)):
        level = 1000 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(market, product, d, float(v)) for d, v in zip(days, level) if rng.random() > 0.05]
    rows += [(3, 11, d, 500.0) for d in days[:50]] + [(1, 10, date(2024, 1, 6), 1e6)]
    return rows, days


@pytest.fixture(scope="module")
def history(spark):
    rows, days = price_history()
    return spark.createDataFrame(rows, "market_id int, product_id int, day date, price_avg double"), rows, days


def test_panel_drops_weekends_and_short_series(history):
    df, rows, days = history
    panel = PF.panel(df)
    assert {(r.market_id, r.product_id) for r in panel.select("market_id", "product_id").distinct().collect()} == {(1, 10), (2, 10), (1, 11)}
    assert panel.agg(F.max("log_price")).first()[0] < np.log(1e6)


def test_features_and_targets_match_a_dense_panel(spark, history):
    df, rows, days = history
    import pandas as pd

    wide = pd.DataFrame([r for r in rows if r[0] != 3 and r[2].weekday() < 5], columns=["m", "p", "d", "v"]).pivot_table(index="d", columns=["m", "p"], values="v")
    wide.index = pd.to_datetime(wide.index)
    L = np.log(wide.reindex(pd.bdate_range(wide.index.min(), wide.index.max())).ffill(limit=3))
    d1 = L.diff()
    want = {"r5": L - L.shift(5), "vol20": d1.rolling(20, min_periods=10).std(), "dev90": L - L.rolling(90, min_periods=30).mean()}
    want["prod_r5"] = want["r5"].T.groupby(level=1).transform("mean").T
    got = PF.features(PF.panel(df)).withColumn("day", D.business_date(F.col("idx"))).toPandas()
    for name, frame in want.items():
        expected = np.array([frame.loc[pd.Timestamp(r.day), (r.market_id, r.product_id)] for r in got.itertuples()], float)
        np.testing.assert_allclose(got[name].to_numpy(float), expected, atol=1e-9, equal_nan=True)
    lead = PF.lead_targets(PF.panel(df)).where("h = 3").withColumn("day", D.business_date(F.col("idx"))).toPandas()
    ahead = L.shift(-3) - L
    expected = np.array([ahead.loc[pd.Timestamp(r.day), (r.market_id, r.product_id)] for r in lead.itertuples()], float)
    np.testing.assert_allclose(lead["y"].to_numpy(float), expected, atol=1e-9, equal_nan=True)
    assert all(a == np.busday_offset(d, 3) for a, d in zip(lead["target_day"], lead["day"]))


def test_features_do_not_see_the_future(spark, history):
    df, _, days = history
    cut = days[250]
    changed = df.withColumn("price_avg", F.when(F.col("day") > cut, F.col("price_avg") * 3).otherwise(F.col("price_avg")))
    names = ["market_id", "product_id", "idx", *[f for f in PF.FEATURES if f[0] in "rvdp" and f not in ("dow", "doy_sin", "doy_cos", "product_code")]]

    def past(frame):
        rows = PF.features(PF.panel(frame)).where(D.business_date(F.col("idx")) <= F.lit(cut)).select(*names).collect()
        return sorted(tuple(None if v is None else round(v, 9) for v in r) for r in rows)

    assert past(df) == past(changed)


def test_backtest_folds_do_not_leak(history):
    samples = PF.lead_targets(PF.panel(history[0]))
    for fold in range(4):
        train_if, test_if = PF.fold_of(fold)
        last = PF.training_rows(samples).where(train_if).agg(F.max(F.col("idx") + F.col("h"))).first()[0]
        assert last <= samples.where(test_if).agg(F.min("idx")).first()[0] - 1


def test_publication_rule(spark):
    future = spark.createDataFrame([(1, p, h, float(np.log(1000)), 0.1, date(2026, 1, h)) for p in (10, 11, 12) for h in (1, 2)],
                                   "market_id int, product_id int, h int, log_price double, pred double, target_day date")
    errors = spark.createDataFrame([(10, 1, 0, 0, 500, 0.01), (10, None, 0, 1, 1000, 0.02), (11, 1, 0, 0, 500, 0.01), (11, 2, 0, 0, 40, 0.0), (11, None, 0, 1, 540, 0.2), (10, 2, 0, 0, 5, 0.9)],
                                   "product_id int, h int, all_products int, all_horizons int, n long, improvement double")
    residuals = [("p", p, h, v, v) for p in (10, 11) for h in (1, 2) for v in np.linspace(-0.2, 0.2, 50)]
    rows = spark.createDataFrame([(p, h, float(a), float(b)) for _, p, h, a, b in residuals], "product_id int, h int, res double, y double")
    got = {(r.product_id, r.h): r for r in PF.publish(future, PF.expected_improvement(errors), PF.residual_bands(rows)).collect()}
    assert (got[(10, 1)].method, got[(10, 1)].confidence, round(got[(10, 1)].price)) == ("naive", "baja", 1000)
    assert (got[(10, 2)].method, got[(11, 1)].method) == ("naive", "naive")
    assert (got[(11, 2)].method, got[(11, 2)].confidence) == ("trees", "alta")
    assert got[(11, 2)].price == pytest.approx(1000 * np.exp(0.1))
    assert all(r.p10 < r.price < r.p90 for r in got.values())
    assert got[(12, 1)].p10 == pytest.approx(1000 * np.exp(-0.16))
    alone = PF.publish(future, PF.expected_improvement(errors), PF.residual_bands(rows).limit(0)).first()
    assert alone.p10 == pytest.approx(alone.price * np.exp(-0.1))


def test_own_bands_need_forty_residuals(spark):
    rows = [(1, 1, 1.0, 1.0)] * 39 + [(2, 1, -1.0, -1.0)] * 40
    got = {r.product_id: (r.q10, r.q90) for r in PF.residual_bands(spark.createDataFrame(rows, "product_id int, h int, res double, y double")).where("kind = 'model'").collect()}
    assert got[2] == (-1.0, -1.0) and got[1] == (-1.0, 1.0)


def test_seasonal_forecast_follows_the_season(spark):
    def value(i):
        return 100 + 50 * np.sin(2 * np.pi * i / 12)

    rows = [(1, 2018 + i // 12, i % 12 + 1, float(value(i)) if i != 17 else None, 20.0) for i in range(60)] + [(2, 2020, m, 1.0, 1.0) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "town_id int, year int, month int, rain_mm double, temp_mean double")
    out = SE.seasonal_forecast(df).collect()
    assert {r.town_id for r in out} == {1} and len(out) == 12
    rain = sorted((r.year, r.month, r.value) for r in out if r.measure == "rain_mm")
    assert rain[0][:2] == (2023, 1)
    assert [v for _, _, v in rain] == pytest.approx([value(60 + i) for i in range(6)], abs=12)
    assert all(r.value == pytest.approx(20.0) for r in out if r.measure == "temp_mean")


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "maiz", 2020, float(rng.normal(5, 0.5)), float(rng.normal(0, 0.2)), float(rng.normal(0, 0.5))) for i in range(299)]
    rows += [(999, "maiz", 2020, 40.0, 30.0, 35.0)] + [(i, "coco", 2020, 1.0, 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "town_id int, crop_id string, year int, predicted double, change double, deviation double")
    out = AN.isolation_scores(df, trees=100)
    got = {(r.town_id, r.crop_id): r for r in out.collect()}
    maize = [r for r in got.values() if r.crop_id == "maiz"]
    assert got[(999, "maiz")].score == max(r.score for r in maize) and got[(999, "maiz")].is_anomaly
    assert sum(r.is_anomaly for r in maize) == 21
    assert all(not r.is_anomaly and r.score is None for r in got.values() if r.crop_id == "coco")
    again = {(r.town_id, r.crop_id): r.score for r in AN.isolation_scores(df.repartition(7), trees=100).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_yield_model_reports_its_baseline(spark):
    rng = np.random.default_rng(3)
    rows = []
    for town in range(40):
        for year in range(2016, 2023):
            rain = float(rng.normal())
            rows.append((town, town % 3, year, 5 + town % 3 + rain + float(rng.normal(0, 0.1)), None if rng.random() < 0.1 else rain, None))
    df = spark.createDataFrame(rows, "town_id int, crop_id int, year int, yield_t_ha double, rain_year double, spi_mean double")
    from cropspark.plans.features import add_history

    report = YM.train_and_evaluate(add_history(df), [{"maxIter": 10, "maxDepth": 3}])
    got = {r.model: r for r in report.metrics.collect()}
    assert report.test_year == 2022 and got["trees"].mae < got["baseline"].mae
    names = [r.feature for r in report.importances.orderBy("place").collect()]  # town and crop are features, too, by their codes
    assert "rain_year" == names[0] and len(names) == len(set(names)) <= 10 and {"town_code", "crop_code"} <= set(names) and "spi_mean" not in names
    assert {r.year for r in report.predictions.select("year").distinct().collect()} == {2019, 2020, 2021, 2022}
    assert report.predictions.where("lo < 0 or lo > hi").count() == 0


def test_permutation_importance_of_planted_features(spark):
    """The error after the exchange is that of the same exchange by hand; a feature without a part in the prediction costs nothing."""
    import hashlib

    from cropspark.models import trees as TR

    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a double, b double, idle double").withColumn("y", F.col("a") * 3 + F.col("b")).repartition(5)
    got = {r.feature: r.importance for r in TR.permutation_importance(df, ["a", "b", "idle"], ["id"], lambda d: d.withColumn("yhat", F.col("a") * 3 + F.col("b")), "y", "yhat").collect()}
    order = sorted(rows, key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest())
    step = lambda c: np.mean([abs(x[c] - z[c]) for x, z in zip(order, order[1:] + order[:1], strict=True)])
    assert got == pytest.approx({"a": 3 * step(1), "b": step(2), "idle": 0.0})


def test_feature_columns_exclude_what_is_known_after_harvest(spark):
    df = spark.createDataFrame([], "town_id int, year int, sown_ha double, harvested_ha double, production_t double, yield_t_ha double, rain_year double, suitability string")
    assert YM.feature_columns(df) == ["sown_ha", "rain_year"]


def test_backtest_reuse_by_age(spark):
    reg = spark.createDataFrame([(1, "m", datetime(2026, 1, 1), "{}")], "id_version long, model_name string, trained_at timestamp, metrics_json string")
    assert PF.reusable_backtest(reg, "m", datetime(2026, 1, 5)).count() == 1
    assert PF.reusable_backtest(reg, "m", datetime(2026, 1, 9)).count() == 0


# --- streaming ----------------------------------------------------------------------------------------
FIELDS = {f: None for f in X.PRICE_FIELDS}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({**FIELDS, **r}) for r in rows), encoding="utf-8")


def quote(market, product, day, price):
    return {"fuenNombre": market, "artiNombre": product, "enmaFecha": day, "promedioKg": str(price)}


def test_stream_ingest_is_idempotent_and_takes_revisions(spark, tmp_path):
    landing, table, log = tmp_path / "in", str(tmp_path / "fact"), str(tmp_path / "log")

    def transform(batch):
        return P.normalise_feed(batch).select(F.col("market").alias("market_id"), F.col("product_key").alias("product_id"), "day", "price_min", "price_max", "price_avg", "source")

    def run():
        stream = IN.file_stream(spark, str(landing), ", ".join(f"{f} string" for f in X.PRICE_FIELDS), "json")
        IN.run_available(stream, IN.merge_sink(table, log, "feed", transform), str(tmp_path / "checkpoint"))
        spark.catalog.refreshByPath(table)
        return {(r.market_id, r.product_id, r.day): r.price_avg for r in spark.read.parquet(table).collect()}

    land(landing, "a-1.json", [quote("M", "Papa", "2026-01-05", 100), quote("M", "Papa", "2026-01-06", 110)])
    first = run()
    assert first == {("M", "PAPA", date(2026, 1, 5)): 100.0, ("M", "PAPA", date(2026, 1, 6)): 110.0}
    assert run() == first
    land(landing, "a-2.json", [quote("M", "Papa", "2026-01-05", 100), quote("M", "Papa", "2026-01-06", 120), quote("M", "Yuca", "2026-01-01", 5)])
    assert run() == {**first, ("M", "PAPA", date(2026, 1, 6)): 120.0, ("M", "YUCA", date(2026, 1, 1)): 5.0}
    land(landing, "a-3.json", [quote("M", "Papa", "2026-02-01", 7)])
    untouched = {p.name for p in (tmp_path / "fact" / "year_month=2026-01").glob("*.parquet")}
    assert len(run()) == 4
    assert untouched == {p.name for p in (tmp_path / "fact" / "year_month=2026-01").glob("*.parquet")}
    runs = spark.read.parquet(log).orderBy("started_at").collect()
    assert [(r.new_rows, r.status) for r in runs] == [(2, "ok"), (2, "ok"), (1, "ok")]
    assert runs[0].max_day == date(2026, 1, 6)


def test_repeats_are_dropped_but_revisions_pass(spark, tmp_path):
    landing = tmp_path / "in"
    schema = "k string, day date, v double"
    landing.mkdir()
    (landing / "1.json").write_text('{"k":"a","day":"2026-01-05","v":1}\n{"k":"a","day":"2026-01-05","v":1}\n{"k":"a","day":"2026-01-05","v":2}', encoding="utf-8")
    stream = IN.drop_repeats(IN.file_stream(spark, str(landing), schema, "json"), "day", ["k"], ["v"])
    out = str(tmp_path / "out")
    IN.run_available(stream, lambda b, i: b.write.mode("append").parquet(out), str(tmp_path / "c"))
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [1.0, 2.0]


def test_daily_means_count_late_rows(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    table = str(tmp_path / "t")

    def run():
        stream = IN.file_stream(spark, str(landing), "ts timestamp, k string, v double", "json")
        sink = IN.update_sink(table, lambda b: b.select("k", IN.window_day().alias("day"), "mean", "n"))
        IN.run_available(IN.daily_means(stream, "ts", ["k"], "v"), sink, str(tmp_path / "c"), "update")
        return {r.day: (r["mean"], r.n) for r in IN.latest_rows(spark, table, ["k", "day"]).collect()}

    (landing / "1.json").write_text('{"ts":"2026-01-05T10:00:00Z","k":"a","v":1}', encoding="utf-8")
    assert run() == {date(2026, 1, 5): (1.0, 1)}
    (landing / "2.json").write_text('{"ts":"2026-01-05T11:00:00Z","k":"a","v":3}\n{"ts":"2026-01-06T11:00:00Z","k":"a","v":5}', encoding="utf-8")
    assert run() == {date(2026, 1, 5): (2.0, 2), date(2026, 1, 6): (5.0, 1)}


def test_failed_batch_leaves_an_error_row(spark, tmp_path):
    log = str(tmp_path / "log")

    def broken(batch):
        raise ValueError("no such market")

    with pytest.raises(ValueError):
        IN.merge_sink(str(tmp_path / "fact"), log, "feed", broken)(spark.range(1), 0)
    row = spark.read.parquet(log).first()
    assert (row.source, row.status, row.error, row.new_rows) == ("feed", "error", "no such market", None)
    assert row.started_at <= row.finished_at


def test_quotes_of_a_day_add_up_over_files_batches_and_replays(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "sums")
    landing.mkdir()
    quotes = [(m, "p", f"2025-03-0{d}", float(10 * d + k)) for m in (1, 2) for d in (1, 2) for k in range(6)]
    for i in range(4):
        (landing / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("market_id", "product_id", "day", "price"), q))) for q in quotes[i::4]), encoding="utf-8")
    stream = IN.file_stream(spark, str(landing), "market_id int, product_id string, day date, price double", "json", files_per_batch=1)
    sink = IN.quote_sink(table, lambda b: b)
    batches = []
    IN.run_available(stream, lambda b, i: (batches.append(i), sink(b, i), sink(b, i)), str(tmp_path / "c"))
    assert len(batches) == 4
    (tmp_path / "sums" / "batch=99").mkdir()  # begun, never completed
    got = {(r.market_id, r.day.day): (r.price_min, r.price_max, r.price_avg) for r in IN.quoted_days(spark, table).collect()}
    assert got == {(m, d): (10.0 * d, 10.0 * d + 5, 10.0 * d + 2.5) for m in (1, 2) for d in (1, 2)}


def _by_key(stored, incoming):
    both = stored.select("k", "v", "year_month", F.lit(0).alias("new")).unionByName(incoming.select("k", "v", "year_month", F.lit(1).alias("new")))
    last = both.groupBy("k", "year_month").agg(F.max_by("v", "new").alias("v"), F.count_if(F.col("new") == 0).alias("old"), F.max("new").alias("new"), F.min_by("v", "new").alias("was"))
    kind = F.when(F.col("old") == 0, M.INSERTED).when((F.col("new") == 1) & (F.col("v") != F.col("was")), M.CHANGED).otherwise("unchanged")
    return last.select("k", "v", "year_month", kind.alias("change_type"))


def test_a_broken_merge_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k int, v double, year_month string"
    months = {k: f"2025-0{1 + k % 3}" for k in range(9)}

    def rows(*pairs):
        return spark.createDataFrame([(k, v, months[k]) for k, v in pairs], schema)

    def table():
        spark.catalog.refreshByPath(path)
        return {r.k: r.v for r in spark.read.parquet(path).collect()}

    M.merge_touched_partitions(spark, path, rows(*[(k, 1.0) for k in range(9)]), "year_month", _by_key)
    real = M.replace_partitions

    def dies_half_way(df, where, by, cluster=()):
        for folder in (tmp_path / "t").glob("year_month=2025-01"):
            for f in folder.glob("*.parquet"):
                f.unlink()
        raise RuntimeError("lost")

    monkeypatch.setattr(M, "replace_partitions", dies_half_way)
    with pytest.raises(RuntimeError):
        M.merge_touched_partitions(spark, path, rows((0, 5.0), (1, 6.0)), "year_month", _by_key)
    monkeypatch.setattr(M, "replace_partitions", real)
    assert 3 not in table()
    again = M.merge_touched_partitions(spark, path, rows((0, 5.0), (1, 6.0)), "year_month", _by_key)
    assert table() == {**{k: 1.0 for k in range(9)}, 0: 5.0, 1: 6.0}
    assert again.where(F.col("change_type") != "unchanged").count() == 0
    files = {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    M.merge_touched_partitions(spark, path, rows((0, 7.0), (1, 6.0)), "year_month", _by_key)
    kept = {p for p in files if "2025-02" in p or "2025-03" in p}
    assert kept <= {str(p) for p in (tmp_path / "t").rglob("*.parquet")} and table()[0] == 7.0


def test_expired_partitions_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"2025-0{m}") for i, m in enumerate((1, 2, 3, 3))], "i int, month string").write.partitionBy("month").parquet(path)
    assert M.expire_partitions(spark, path, "month", "2025-03") == ["2025-01", "2025-02"]
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == [2, 3]
    assert M.expire_partitions(spark, path, "month", "2025-03") == [] and M.expire_partitions(spark, str(tmp_path / "none"), "month", "x") == []


def test_seasonal_months_count_before_gaps_are_filled(spark):
    few = [(1, 2020 + m // 12, 1 + m % 12, 5.0, 20.0) for m in (0, 6, 12, 18, 25)]
    enough = [(2, 2020 + m // 12, 1 + m % 12, 5.0 + m, 20.0) for m in range(26) if m not in (3, 9)]
    got = SE.seasonal_forecast(spark.createDataFrame(few + enough, "town_id int, year int, month int, rain_mm double, temp_mean double"))
    assert {r.town_id for r in got.select("town_id").distinct().collect()} == {2}


def test_a_single_risk_class_falls_back_to_persistence(spark):
    from cropspark.models import alerts as AL

    rows = [(t, 2024 + m // 12, 1 + m % 12, 1, "rain", float(m)) for t in (1, 2) for m in range(14)]
    samples = spark.createDataFrame(rows, "town_id int, year int, month int, risk int, event string, rain_mm double")
    samples = samples.withColumn("period", F.col("year") * 12 + F.col("month")).withColumn("target", F.when(F.col("period") < F.lit(2025 * 12 + 2), F.lit(1)))
    for c in AL.FEATURES:
        if c not in samples.columns:
            samples = samples.withColumn(c, F.lit(1.0))
    out, metrics = AL.train_and_evaluate(samples)
    assert [(r.model, r.accuracy) for r in metrics.collect()] == [("persistence", 1.0)]
    assert {r.level for r in out.collect()} == {"MEDIO"} and out.where("is_active").count() == 2


def test_batches_are_folded(spark, tmp_path, monkeypatch):
    """500 batches stay few folders; a break between writing and publishing, or before the clean-up, loses and repeats nothing."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    base = str(tmp_path / "table")
    add_up = lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v"), F.max("batch").alias("batch"))
    frame, rows = spark.range(3).selectExpr("id AS k", "id * 10 AS v").coalesce(1), pa.table({"k": [0, 1, 2], "v": [0, 10, 20]})
    total = lambda: {r.k: r.v for r in M.read_batches(spark, base).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    monkeypatch.setattr(M, "FOLD_EVERY", 20)
    monkeypatch.setattr(M, "KEPT_BATCHES", 4)
    publish, most, broken = M._publish, 0, 0
    for batch in range(500):
        if batch == 200:
            def fail(*_):
                raise OSError("killed between write and swap")

            monkeypatch.setattr(M, "_publish", fail)
        if batch % 10:  # as the sink's own, but quicker to make
            pq.write_table(rows, (os.makedirs(f"{base}/batch={batch}") or f"{base}/batch={batch}/part-0.parquet"))
            open(f"{base}/batch={batch}/_SUCCESS", "w").close()
            continue
        try:
            M.write_batch(frame, base, batch, add_up)
        except OSError:
            broken += 1
            assert total() == {k: k * 10 * (batch + 1) for k in range(3)}
            monkeypatch.setattr(M, "_publish", publish)
            M.write_batch(frame, base, batch, add_up)  # the engine writes the batch again
        if batch % 100 == 0:
            assert total() == {k: k * 10 * (batch + 1) for k in range(3)}
        most = max(most, sum(not n.startswith((".", "_")) for n in os.listdir(base)))
    assert broken == 1 and most <= 2 * (20 + 4 + 10) + 2
    assert total() == {k: k * 10 * 500 for k in range(3)}
    M.write_batch(frame, base, 100, add_up)  # long folded: stays as it is
    M.write_batch(frame, base, 499, add_up)
    assert total() == {k: k * 10 * 500 for k in range(3)}
    state = M._manifests(spark, base)
    assert len(state) == 2 and state[-1]["through"] >= 499 - 34 and M.read_batches(spark, str(tmp_path / "none")) is None


def test_folded_roll_up_keeps_last_rows(spark, tmp_path, monkeypatch):
    from cropspark.streaming import ingest as IN

    monkeypatch.setattr(M, "FOLD_EVERY", 3)
    monkeypatch.setattr(M, "KEPT_BATCHES", 1)
    base = str(tmp_path / "days")
    sink = IN.update_sink(base, lambda b: b, ["k"])
    for batch in range(11):
        sink(spark.createDataFrame([(batch % 4, float(batch)), (9, -float(batch))], "k long, mean double"), batch)
    assert M._manifests(spark, base)
    assert {r.k: r["mean"] for r in IN.latest_rows(spark, base, ["k"]).collect()} == {0: 8.0, 1: 9.0, 2: 10.0, 3: 7.0, 9: -10.0}


def test_fitted_smoothing_beats_the_grid(spark):
    """The fit is never worse than the best of the grid, and forecast and error are those of the recursion at the returned parameters."""
    rng = np.random.default_rng(12)
    months = np.arange(60)
    series = [20 + 0.1 * months + 8 * np.sin(months / 12 * 2 * np.pi) + rng.normal(0, s, 60) for s in (0.1, 2.0, 9.0)] + [np.full(60, 5.0), rng.gamma(1.0, 80.0, 60)]
    for y in series:
        grid = np.stack([m.ravel() for m in np.meshgrid(*SE.GRID, indexing="ij")], axis=1)
        found = SE.fitted(y)
        assert SE.smoothed(y, [found])[0][0] <= SE.smoothed(y, grid)[0].min() and all(0 <= p <= 1 for p in found)
    rows = [(t, 2019 + m // 12, m % 12 + 1, float(y[m]), float(-y[m])) for t, y in enumerate(series) for m in range(60)]
    got = SE.seasonal_forecast(spark.createDataFrame(rows, "town_id int, year int, month int, rain_mm double, temp_mean double")).collect()
    assert len(got) == 5 * 2 * 6
    for r in got:
        y, (a, b, g) = (series[r.town_id] if r.measure == "rain_mm" else -series[r.town_id]), (r.alpha, r.beta, r.gamma)
        level, trend, season, sse = y[:12].mean(), (y[12:24].mean() - y[:12].mean()) / 12, list(y[:12] - y[:12].mean()), 0.0
        for t in range(12, 60):
            s, last = season[t % 12], level
            sse += (y[t] - level - trend - s) ** 2
            level = a * (y[t] - s) + (1 - a) * (level + trend)
            trend = b * (level - last) + (1 - b) * trend
            season[t % 12] = g * (y[t] - level) + (1 - g) * s
        value = level + r.horizon * trend + season[(59 + r.horizon) % 12]
        assert r.sse == pytest.approx(sse) and r.value == pytest.approx(max(value, 0) if r.measure == "rain_mm" else value) and r.method == "holt_winters"
