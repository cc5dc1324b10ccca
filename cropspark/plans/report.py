"""Daily price report. Input: price fact with market, department and product names, one row per series and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import numeric as N
from cropspark.operators import ranking as Q
from cropspark.operators import windows as W
from cropspark.plans.prices import SERIES
from cropspark.session import materialise

ROW = ["product", "market", "department"]


def history_window(prices: DataFrame, day: date) -> DataFrame:
    """The days the report reads; the bound reaches the scan."""
    return prices.where(F.col("day").between(F.date_sub(F.lit(day), K.REPORT_HISTORY_DAYS), F.lit(day)))


def report_base(prices: DataFrame, day: date) -> DataFrame:
    """Series reporting on the day, with previous (up to 5 days) and week-ago (7 to 14 days) price and prior statistics."""
    window = history_window(prices, day)
    lookups = {"previous": (1, K.REPORT_MAX_PREVIOUS_DAYS), "week_ago": (7, 14)}
    out = W.with_values_before(window, SERIES, "day", "price_avg", lookups)
    out = W.prior_stats(out, SERIES, "day", "price_avg", K.OUTLIER_WINDOW)
    return out.where(F.col("day") == F.lit(day)).withColumns({
        "change_day_pct": N.pct_change(F.col("price_avg"), F.col("previous")),
        "change_week_pct": N.pct_change(F.col("price_avg"), F.col("week_ago")),
    })


def coverage(prices: DataFrame, day: date) -> DataFrame:
    on_day = F.col("day") == F.lit(day)
    active = history_window(prices, day).where(F.col("day") >= F.date_sub(F.lit(day), K.REPORT_ACTIVE_DAYS))
    series = F.struct(*SERIES)
    return active.agg(
        F.count_distinct(series).alias("active_series"), F.count_distinct(F.when(on_day, series)).alias("series_with_data"),
        F.count_distinct("market_id").alias("active_markets"),
        F.count_distinct(F.when(on_day, F.col("market_id"))).alias("markets_with_data"))


def movers(base: DataFrame, change: str, reference: str, rising: bool, k: int = K.REPORT_TOP) -> DataFrame:
    top = Q.signed_top(base, change, k, rising, ["product", "market"])
    return top.select(*ROW, N.round_half_even(F.col("price_avg"), 0).alias("price"),
                      N.round_half_even(F.col(reference), 0).alias("before"),
                      N.round_half_even(F.col(change), 1).alias("change_pct"))


def all_movers(base: DataFrame) -> DataFrame:
    lists = [("rises_day", "change_day_pct", "previous", True), ("falls_day", "change_day_pct", "previous", False),
             ("rises_week", "change_week_pct", "week_ago", True), ("falls_week", "change_week_pct", "week_ago", False)]
    return Q.union_all([
        movers(base, change, ref, rising).withColumn("list", F.lit(name)) for name, change, ref, rising in lists])


def market_gap(base: DataFrame, min_markets: int = K.MIN_GAP_MARKETS) -> DataFrame:
    """Cheapest against dearest market per product, where enough markets report."""
    place = F.struct(*[F.col(c) for c in ("market", "department", "price_avg")])
    groups = base.groupBy("product_id", "product").agg(
        F.count_distinct("market_id").alias("n_markets"), F.median("price_avg").alias("median"),
        F.min_by(place, F.struct("price_avg", "market")).alias("low"),
        F.max_by(place, F.struct("price_avg", "market")).alias("high"),
    ).where(F.col("n_markets") >= min_markets)
    low, high = F.col("low.price_avg"), F.col("high.price_avg")
    return groups.select(
        "product", "n_markets", "median", F.col("low.market").alias("cheapest_market"), low.alias("cheapest_price"),
        F.col("high.market").alias("dearest_market"), high.alias("dearest_price"),
        ((high - low) / low * 100).alias("gap_pct"))


def departments(base: DataFrame) -> DataFrame:
    """Per department: series, median changes, how many rise and fall. At most one row per series comes in."""
    return base.where(F.col("department").isNotNull()).groupBy("department").agg(
        F.count(F.lit(1)).alias("series"), F.median("change_day_pct").alias("median_day_pct"),
        F.median("change_week_pct").alias("median_week_pct"), F.count_if(F.col("change_day_pct") > 0).alias("rising"),
        F.count_if(F.col("change_day_pct") < 0).alias("falling"))


def outliers(base: DataFrame, k: int = K.OUTLIER_TOP) -> DataFrame:
    z = (F.col("price_avg") - F.col("prior_mean")) / F.col("prior_std")
    judged = base.where((F.col("prior_n") >= K.OUTLIER_MIN_OBS) & (F.col("prior_std") > 0)).withColumn("z", z)
    return Q.top_by_magnitude(judged.where(F.abs("z") >= K.OUTLIER_Z), "z", k, ["product", "market"]).select(
        *ROW, "price_avg", "z", "prior_mean")


def report_document(prices: DataFrame, day: date) -> DataFrame:
    """The whole report as one JSON document; every list is bounded by a top-k, the products or the departments."""
    base = materialise(report_base(prices, day))  # one row per reporting series, read by seven lists

    def packed(df: DataFrame, order: list) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))).alias("r")).select(
            F.transform("r", lambda x: x["row"]))

    moved = materialise(all_movers(base))
    parts = {"coverage": coverage(prices, day).select(F.struct("*"))}
    for name in ("rises_day", "falls_day", "rises_week", "falls_week"):
        sign = F.col("change_pct") if name.startswith("falls") else -F.col("change_pct")
        parts[name] = packed(moved.where(F.col("list") == name).drop("list"), [sign.alias("o"), F.col("product").alias("o2")])
    parts["market_gap"] = packed(market_gap(base), [(-F.col("gap_pct")).alias("o"), F.col("product").alias("o2")])
    parts["departments"] = packed(departments(base), [F.col("department").alias("o")])
    parts["outliers"] = packed(outliers(base), [(-F.abs("z")).alias("o"), F.col("product").alias("o2")])
    one = prices.sparkSession.range(1)
    return one.select(F.lit(day).alias("day"), F.to_json(F.struct(
        *[frame.scalar().alias(name) for name, frame in parts.items()])).alias("payload"))


def report_pending(daily: DataFrame, reports: DataFrame, runs: DataFrame, feeds: list[str]) -> DataFrame:
    """Whether the newest day lacks a report, or data changed after it was made."""
    newest = daily.agg(F.max("day").alias("day"))
    changed = runs.where((F.col("status") == "ok") & (F.col("new_rows") > 0) & F.col("source").isin(*feeds)).agg(
        F.max("finished_at")).scalar()
    joined = newest.join(reports, "day", "left").withColumn("last_change", changed)
    pending = F.col("generated_at").isNull() | F.coalesce(F.col("last_change") > F.col("generated_at"), F.lit(False))
    return joined.select("day", "generated_at", "last_change", pending.alias("pending"))


def report_dates(reports: DataFrame, k: int = 30) -> DataFrame:
    return Q.top_rows(reports.select("day"), [F.col("day").desc()], k)


def report_for(reports: DataFrame, day: date | None = None) -> DataFrame:
    """The report of the day, or the latest one."""
    return reports.where(F.col("day") == F.lit(day)) if day else Q.top_rows(reports, [F.col("day").desc()], 1)
