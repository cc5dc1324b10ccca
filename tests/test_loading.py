"""Loads of facts: keys, rejects by reason, repeats."""

from cropspark.operators import loading as LD
from cropspark.operators import merge as M
from cropspark.plans import loading as L


def counts(loaded):
    return {r.reason: r.n for r in loaded.counts.collect()}


def test_first_reason_counts_and_every_row_has_one(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 1, 6.0, 2), ("a", 9, 1.0, 1), ("zz", 9, 1.0, 1), (None, 1, 1.0, 1), ("b", 1, None, 1), ("b", None, 2.0, 1)], "town string, month int, v double, seq int")
    towns = spark.createDataFrame([("a", 10), ("a", 11), ("b", 20), (None, 30)], "name string, town_id int")
    months = spark.createDataFrame([(1, 100)], "m int, month_id int")
    plan = LD.Load(["town_id", "month_id"], ["v"], ["v"], [LD.Reference("unknown town", towns, {"town": "name"}, "town_id"), LD.Reference("unknown month", months, {"month": "m"}, "month_id")], ["seq"])
    loaded = LD.resolve(rows, plan)
    assert [tuple(r) for r in loaded.accepted.collect()] == [(11, 100, 6.0)]  # the last by order; of a repeated name the larger key
    assert counts(loaded) == {"accepted": 1, "duplicate": 1, "unknown month": 2, "unknown town": 2, "missing v": 1}
    rejects = loaded.rejects.collect()
    assert loaded.rejects.columns == ["town", "month", "v", "seq", "reason"] and {(r.town, r.month): r.reason for r in rejects}[("zz", 9)] == "unknown town"
    assert sum(counts(loaded).values()) == rows.count()
    assert counts(LD.resolve(rows.limit(0), plan)) == {"accepted": 0, "duplicate": 0}


def test_loading_again_changes_nothing(spark):
    rows = spark.createDataFrame([("5001", "Pápa ", "Aptitud media"), ("5001", "papa", "Aptitud alta"), ("9999", "papa", "x"), ("5001", "oca", "alta"), (None, "papa", "alta")], "town_id string, product string, suitability string")
    crops = spark.createDataFrame([("papa", 7)], "crop_key string, crop_id int")
    towns = spark.createDataFrame([("5001",)], "town_id string")
    loaded = L.load_soil(rows, crops, towns)
    assert counts(loaded) == {"accepted": 1, "duplicate": 1, "unknown town": 1, "unknown crop": 1, "missing town_id": 1}
    stored = loaded.into(loaded.accepted.limit(0), ["town_id", "crop_id"])
    assert [r.change_type for r in stored.collect()] == [M.INSERTED]
    assert [r.change_type for r in loaded.into(stored.drop("change_type"), ["town_id", "crop_id"]).collect()] == [M.SAME]


def test_new_crops_become_members(spark):
    rows = spark.createDataFrame([("2024", "1", "Ñame", " M ", "C", 1.0, 2.0, 1.5, 9.0), ("2024", "1", "ñame", "M", "C", 1.0, 2.0, 1.7, 9.0), ("2024", "13", "papa", "M", "C", 1.0, 2.0, 1.5, 9.0), ("2024", "1", "", "M", "C", 1.0, 2.0, 1.5, 9.0),
                                  ("x", "1", "papa", "M", "C", 1.0, 2.0, 1.5, None), ("2024", "1", "papa", "N", "C", 1.0, 2.0, 1.5, None)],
                                 "year string, month string, product string, market string, city string, price_min double, price_max double, price_avg double, volume double")
    months = spark.createDataFrame([(2024, 1, 1)], "year int, month int, month_id int")
    crops = spark.createDataFrame([(4, "papa", "Papa", "long")], "crop_id long, crop_key string, crop string, cycle string")
    markets = spark.createDataFrame([(3, "M", "C")], "market_id int, market string, city string")
    loaded, known = L.load_monthly_prices(rows, months, crops, markets)
    assert sorted((r.crop_id, r.crop_key, r.cycle) for r in known.collect()) == [(4, "papa", "long"), (5, "name", None)]
    assert [(r.market_id, r.crop_id, r.month_id, r.price_avg) for r in loaded.accepted.collect()] == [(3, 5, 1, 1.7)]
    assert counts(loaded) == {"accepted": 1, "duplicate": 1, "missing crop_key": 1, "unknown month": 2, "unknown market": 1}


def test_census_and_inputs(spark):
    census = spark.createDataFrame([("1", "s/d", 1.0), ("1", "2014", 2.0), ("2", "2024", 3.0)], "town_id string, census_year string, farmed_ha double")
    for c in ("pasture_ha", "fallow_ha", "built_ha"):
        census = census.selectExpr("*", f"CAST(NULL AS double) AS {c}")
    loaded = L.load_census(census, spark.createDataFrame([("1",)], "town_id string"))
    assert [(r.town_id, r.census_year, r.farmed_ha) for r in loaded.accepted.collect()] == [("1", 2014, 2.0)] and counts(loaded) == {"accepted": 1, "duplicate": 1, "unknown town": 1}
    inputs = spark.createDataFrame([(2024, 1, "f", "urea", None, 5.0), (2024, 1, "f", "urea", None, 5.0), (2024, 1, "f", "urea", 2, 6.0), (2020, 1, "f", "urea", 2, 6.0)], "year int, month int, kind string, input_name string, region_id int, price double")
    loaded = L.load_input_prices(inputs, spark.createDataFrame([(2024, 1, 8)], "year int, month int, month_id int"))
    assert sorted((r.region_id or 0, r.price) for r in loaded.accepted.collect()) == [(0, 5.0), (2, 6.0)] and counts(loaded) == {"accepted": 2, "duplicate": 1, "unknown month": 1}
