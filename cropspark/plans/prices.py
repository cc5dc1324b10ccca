"""Daily wholesale prices: roll-up, current price, lists, filters, series, freshness, feed normalisers.

Price fact: market_id, product_id, day, price_min, price_max, price_avg (one row per market, product and day).
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import dates as D
from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.functions import text as T
from cropspark.operators import aggregate as A
from cropspark.operators import conform as C
from cropspark.operators import ranking as Q
from cropspark.operators import windows as W

SERIES = ["market_id", "product_id"]


def daily_prices(quotes: DataFrame, price: str = "price") -> DataFrame:
    """Quotes to one row per market, product and day.

    The partial aggregate runs before the shuffle, so a series holding a third of all quotes moves as its days only.
    """
    return quotes.groupBy(*SERIES, "day").agg(
        F.min(price).alias("price_min"), F.max(price).alias("price_max"), F.avg(price).alias("price_avg"))


def with_changes(daily: DataFrame, previous_max_age: int | None = None, week_max_age: int | None = None,
                 last_flag: str | None = None) -> DataFrame:
    """Every day of every series with its previous and 7-day-old price and the percent changes."""
    lookups = {"previous": (1, previous_max_age), "week_ago": (7, week_max_age)}
    out = W.with_values_before(daily, SERIES, "day", "price_avg", lookups, last_flag)
    return out.withColumns({
        "change_day_pct": N.pct_change(F.col("price_avg"), F.col("previous")),
        "change_week_pct": N.pct_change(F.col("price_avg"), F.col("week_ago")),
    })


def current_price(daily: DataFrame, markets: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    """Latest price per series with the previous one, the one at least a week old, changes and days of delay.

    The fact is read once: the latest row is found in the window that looks up the older prices.
    """
    rows = with_changes(daily, last_flag="_is_last").where("_is_last").drop("_is_last")
    return (
        rows.join(markets, "market_id").join(products, "product_id")
        .withColumn("days_late", F.datediff(as_of, F.col("day")))
    )


def price_list(current: DataFrame, daily: DataFrame, as_of: date, department: str | None = None,
               product: str | None = None, max_days_late: int | None = None, history_days: int = 30) -> DataFrame:
    """Current prices under optional filters, each with its last days in order (sparkline)."""
    chosen = C.conjunction(current, equal={"department": department}, equal_ci={"product": product},
                           at_most={"days_late": max_days_late})
    recent = daily.where((F.col("day") > F.date_sub(F.lit(as_of), history_days)) & (F.col("day") <= F.lit(as_of)))
    spark_line = A.ordered_values(recent, SERIES, "day", "price_avg", "recent_prices")
    return chosen.join(spark_line, SERIES, "left")


def price_filters(current: DataFrame, max_days_late: int = 30) -> DataFrame:
    """Values offered as filters: departments, markets and products seen lately, each with its ``place`` in Spanish order."""
    fresh = current.where(F.col("days_late") <= max_days_late)
    kinds = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
        for kind, c in (("department", "department"), ("market", "market"), ("product", "product"))])).alias("v")
    values = fresh.select(kinds).select("v.*").where(F.col("value").isNotNull()).distinct()
    return Q.in_spanish_order(values, ["kind"], "value", ["value"])


def price_lookup(current: DataFrame, wanted: str, k: int = 15) -> DataFrame:
    """Current prices whose product, market or department contains the text; freshest first."""
    found = C.conjunction(current, contains_any=(["product", "market", "department"], wanted))
    return Q.top_rows(found, [F.col("day").desc(), F.col("product"), F.col("market")], k)


def price_series(daily: DataFrame, forecasts: DataFrame, since: date) -> DataFrame:
    """Observed prices since a day, then the forecast rows, one frame with a kind column."""
    seen = daily.where(F.col("day") >= F.lit(since)).select(
        *SERIES, "day", F.lit("observed").alias("kind"), F.col("price_avg").alias("price"),
        F.lit(None).cast("double").alias("p10"), F.lit(None).cast("double").alias("p90"))
    ahead = forecasts.select(*SERIES, F.col("target_day").alias("day"), F.lit("forecast").alias("kind"),
                             "price", "p10", "p90")
    return seen.unionByName(ahead)


def series_quality(daily: DataFrame, errors: DataFrame, markets: DataFrame, products: DataFrame) -> DataFrame:
    """What stands beside a series: names, its first and last day, and how the forecast of its product did in the backtest.

    ``errors`` has one row for each product: ``mae_model`` and ``mae_naive`` (of logarithms, so about relative errors) and ``n`` tests. Products that were
    never tested have no figures.
    """
    spans = daily.groupBy(*SERIES).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days"))
    model, naive = F.col("mae_model"), F.col("mae_naive")
    figures = errors.select(
        "product_id", N.round_half_up(model * 100, 1).alias("error_model_pct"), N.round_half_up(naive * 100, 1).alias("error_today_pct"),
        N.round_half_up((1 - model / F.nullif(naive, F.lit(0.0))) * 100, 1).alias("improvement_pct"), F.col("n").alias("n_tests"))
    return spans.join(markets, "market_id").join(products, "product_id").join(figures, "product_id", "left")


def price_state(daily: DataFrame, as_of: Column) -> DataFrame:
    """Newest day, its delay in business days and the freshness state."""
    newest = daily.agg(F.max("day").alias("max_day"))
    delay = D.business_days_after(F.col("max_day"), as_of)
    return newest.select("max_day", delay.alias("delay_bdays"), R.freshness_state(delay).alias("state"))


def normalise_feed(raw: DataFrame) -> DataFrame:
    """XML price feed (all text) to the price contract: canonical names, validation, alias merge."""
    number = N.clean_number
    town = T.valid_code(F.col("muniId"))
    rows = raw.select(
        F.try_to_date(F.substring("enmaFecha", 1, 10), "yyyy-MM-dd").alias("day"),
        T.canon_market(F.col("fuenNombre")).alias("market"), T.canon_title(F.col("muniNombre")).alias("city"),
        town.alias("town_id"), F.substring(town, 1, 2).alias("department_id"),
        T.canon_title(F.col("deptNombre")).alias("department"), T.canon_product(F.col("artiNombre")).alias("product"),
        T.product_key(F.col("artiNombre")).alias("product_key"), T.canon_group(F.col("grupNombre")).alias("product_group"),
        number(F.col("minimoKg")).alias("price_min"), number(F.col("maximoKg")).alias("price_max"),
        number(F.col("promedioKg")).alias("price_avg"), F.lit("soap").alias("source"))
    return _contract(rows)


def normalise_bulletin(long: DataFrame) -> DataFrame:
    """Daily bulletin in long form (day, market, product, price) to the price contract; means only."""
    named = long.withColumn("_market", T.squeeze_spaces(F.col("market")))
    named = C.exclude_values(named, "_market", K.AGGREGATE_MARKETS)
    none = F.lit(None)
    rows = named.select(
        F.try_to_date(F.substring(F.col("day").cast("string"), 1, 10), "yyyy-MM-dd").alias("day"),
        T.canon_market(F.col("market")).alias("market"), none.cast("string").alias("city"),
        none.cast("string").alias("town_id"), none.cast("string").alias("department_id"),
        none.cast("string").alias("department"), T.canon_product(F.col("product")).alias("product"),
        T.product_key(F.col("product")).alias("product_key"), none.cast("string").alias("product_group"),
        none.cast("double").alias("price_min"), none.cast("double").alias("price_max"),
        N.clean_number(F.col("price")).alias("price_avg"), F.lit("excel").alias("source"))
    return _contract(rows)


CONTRACT = ["day", "market", "city", "town_id", "department_id", "department", "product", "product_key",
            "product_group", "price_min", "price_max", "price_avg", "source"]


def _contract(rows: DataFrame) -> DataFrame:
    valid = C.validate_prices(rows, "day", "market", "product_key", "price_min", "price_max", "price_avg")
    attributes = ["city", "town_id", "department_id", "department", "product", "product_group", "source"]
    # The landed row order is not defined on a cluster; the smallest attribute stands for "the first known one".
    merged = valid.groupBy("market", "product_key", "day").agg(
        *[F.min(c).alias(c) for c in attributes], F.min("price_min").alias("price_min"),
        F.max("price_max").alias("price_max"), F.avg("price_avg").alias("price_avg"))
    return merged.select(*CONTRACT)


def link_to_crop(products: DataFrame, key: str = "product_key") -> DataFrame:
    """Add the crop of each priced product by the reviewed link table."""
    return C.constant_lookup(products, key, K.PRODUCT_TO_CROP, "crop_key")


def annual_prices(daily: DataFrame, links: DataFrame) -> DataFrame:
    """Mean and deviation of prices per linked crop and year."""
    return daily.join(links.where(F.col("crop_id").isNotNull()), "product_id").groupBy(
        F.year("day").alias("year"), "crop_id").agg(
        F.avg("price_avg").alias("price_mean"), F.stddev_samp("price_avg").alias("price_std"))


def crop_year_prices(daily: DataFrame, monthly: DataFrame, links: DataFrame) -> DataFrame:
    """``crop_id, year, price_mean, price_std, volume_mean, price_weighted, price_source`` from both price facts.

    A crop and year that has any daily price takes its figures from the daily fact (which knows no volumes), otherwise from the monthly one: mean and
    deviation of its prices, mean volume, and the mean price weighted by volume. Each fact is reduced to one row per product and year before
    anything is joined; products of one crop are merged from those rows.
    """
    seen = daily.where(F.col("price_avg").isNotNull()).groupBy("product_id", F.year("day").alias("year")).agg(*A.moments("price_avg"))
    rest = monthly.groupBy("product_id", "year").agg(*A.moments("price", "volume"))
    both = seen.withColumn("price_source", F.lit("daily")).unionByName(rest.withColumn("price_source", F.lit("monthly")))
    linked = both.join(links.where(F.col("crop_id").isNotNull()).select("product_id", "crop_id"), "product_id")
    merged = A.merge_moments(linked, ["crop_id", "year", "price_source"], "price_mean", "price_std", "volume_mean", "price_weighted")
    values = ["price_mean", "price_std", "volume_mean", "price_weighted", "price_source"]
    return merged.groupBy("crop_id", "year").agg(F.min_by(F.struct(*values), "price_source").alias("_v")).select("crop_id", "year", "_v.*")  # "daily" < "monthly"


def monthly_prices(rows: DataFrame) -> DataFrame:
    """Monthly mean of prices and sum of volumes; a missing town is a group of its own, all-missing volume stays missing."""
    return rows.groupBy("market", "town_id", "product_key", "year", "month").agg(
        F.avg("price").alias("price"), F.sum("volume").alias("volume"))


def run_freshness(runs: DataFrame, daily: DataFrame, as_of: datetime, stages: list[str]) -> DataFrame:
    """Notices: prices too many business days late, or a stage whose last good run is too old; at most one per 12 hours.

    ``runs`` also holds earlier notices, as source 'notice:<key>'.
    """
    today = D.moment(as_of).cast("date")
    delay = D.business_days_half_open(F.col("max_day"), today)
    late = daily.agg(F.max("day").alias("max_day")).where(delay > K.MAX_PRICE_DELAY_BDAYS).select(
        F.lit("prices_late").alias("key"), F.format_string("last price %s, %d business days late", F.col("max_day").cast("string"), delay).alias("detail"))
    good = runs.where((F.col("status") == "ok") & F.col("source").isin(*stages)).groupBy("source").agg(
        F.max(F.coalesce("finished_at", "started_at")).alias("last_ok"))
    old = good.where(F.col("last_ok") < D.moment(as_of) - F.make_dt_interval(F.lit(K.MAX_STAGE_AGE_DAYS))).select(
        F.concat("source", F.lit("_late")).alias("key"),
        F.concat(F.lit("last good run "), F.date_format("last_ok", "yyyy-MM-dd")).alias("detail"))
    sent = runs.where(F.col("source").startswith("notice:")
                      & (F.col("started_at") > D.moment(as_of) - F.make_dt_interval(hours=F.lit(K.HOURS_BETWEEN_NOTICES)))
                      ).select(F.substring_index("source", "notice:", -1).alias("key"))
    return late.unionByName(old).join(sent, "key", "left_anti")
