"""Daily price forecast, 1 to 10 business days ahead: panel, features, rolling backtest, publication.

The panel stays long. Positions are business-day numbers, so a lag of k days is a range frame and no spine is joined to
every series. A series has at most one row per business day, which bounds every window.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import dates as D
from cropspark.functions import rules as R
from cropspark.models import trees as TR
from cropspark.operators import aggregate as A
from cropspark.operators import windows as W
from cropspark.operators.ranks import dense_codes, exact_quantiles
from cropspark.session import materialise

SERIES = ["market_id", "product_id"]
NOMINAL = ["market_code", "product_code"]
FEATURES = ["h", "dow", "doy_sin", "doy_cos", *[f"r{k}" for k in K.FORECAST_LAGS],
            "vol5", "vol20", "dev20", "dev90", "prod_r5", "prod_r20"]


def panel(daily: DataFrame, min_obs: int = K.FORECAST_MIN_OBS) -> DataFrame:
    """Weekday prices of series with enough observations: log price by business-day number, gaps of up to 3 days filled."""
    weekdays = daily.where(D.is_weekday(F.col("day")) & (F.col("price_avg") > 0)).select(
        *SERIES, D.business_index(F.col("day")).alias("idx"), F.log("price_avg").alias("log_price"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    # Series by day is small next to the quotes behind it, and the panel reads it several times: write it once.
    kept = materialise(weekdays.withColumn("_n", size).where(F.col("_n") >= min_obs).drop("_n"))
    ends = kept.agg(F.struct(F.min("idx").alias("lo"), F.max("idx").alias("hi"))).scalar()
    spanned = kept.withColumns({"panel_start": ends["lo"], "panel_end": ends["hi"]})
    return W.forward_fill(spanned, SERIES, "idx", "log_price", K.FORECAST_FFILL, "panel_end")


def features(rows: DataFrame) -> DataFrame:
    """Returns, volatility, deviation from rolling means, and the product's mean return over its markets."""
    price = F.col("log_price")
    out = rows.withColumns({f"r{k}": price - W.value_at_offset(SERIES, "idx", "log_price", -k) for k in K.FORECAST_LAGS})
    out = out.withColumns({
        "vol5": W.rolling(SERIES, "idx", "r1", 5, 3, "std"), "vol20": W.rolling(SERIES, "idx", "r1", 20, 10, "std"),
        "dev20": price - W.rolling(SERIES, "idx", "log_price", 20, 10), "dev90": price - W.rolling(SERIES, "idx", "log_price", 90, 30)})
    across = out.groupBy("product_id", "idx").agg(F.avg("r5").alias("prod_r5"), F.avg("r20").alias("prod_r20"))
    return out.join(across, ["product_id", "idx"], "left")


def lead_targets(rows: DataFrame, horizon: int = K.FORECAST_HORIZON) -> DataFrame:
    """One row per origin and horizon with the log change to the price that many business days ahead (missing when absent)."""
    ahead = rows.withColumn("_targets", F.array(*[
        F.struct(F.lit(h).alias("h"), (W.value_at_offset(SERIES, "idx", "log_price", h) - F.col("log_price")).alias("y"))
        for h in range(1, horizon + 1)]))
    out = ahead.withColumn("_t", F.explode("_targets")).select(*rows.columns, "_t.h", "_t.y")
    target_day = D.business_date(F.col("idx") + F.col("h"))
    return out.withColumns({
        "target_day": target_day, "dow": F.weekday(target_day), "doy_sin": D.season_sin(F.dayofyear(target_day), 365.25),
        "doy_cos": D.season_cos(F.dayofyear(target_day), 365.25)})


def _position() -> Column:
    return F.col("idx") - F.col("panel_start")


def _length() -> Column:
    return F.col("panel_end") - F.col("panel_start") + 1


def training_rows(samples: DataFrame) -> DataFrame:
    """Every second origin of the last 750 business days, with a known target."""
    start = F.greatest(F.lit(20), _length() - K.FORECAST_LOOKBACK)
    at = _position() - start
    return samples.where((at >= 0) & (F.pmod(at, F.lit(K.FORECAST_STRIDE)) == 0) & F.col("y").isNotNull())


def fold_of(fold: int) -> tuple[Column, Column]:
    """Conditions (training, test) of a backtest fold: a training target lies on or before the cut, test origins after it."""
    cut = _length() - K.BACKTEST_FOLDS * K.BACKTEST_WINDOW + fold * K.BACKTEST_WINDOW - 1
    train = _position() + F.col("h") <= cut
    test = (_position() > cut) & (_position() <= cut + K.BACKTEST_WINDOW) & F.col("y").isNotNull()
    return train, test


@dataclass
class Backtest:
    rows: DataFrame
    errors: DataFrame
    quantiles: DataFrame


def _coded(samples: DataFrame) -> DataFrame:
    """Numeric codes of markets and products; the dimensions are joined, never collected."""
    m = dense_codes(samples, "market_id", "market_code")
    p = dense_codes(samples, "product_id", "product_code")
    return samples.join(m, "market_id").join(p, "product_id")


def prepare(daily: DataFrame, min_obs: int = K.FORECAST_MIN_OBS) -> DataFrame:
    """Samples with features, written once: every fold reads them."""
    coded = _coded(materialise(lead_targets(features(panel(daily, min_obs)))))
    return TR.as_nominal(materialise(TR.with_gap_flags(coded, FEATURES)), NOMINAL)


def backtest(samples: DataFrame, **params) -> Backtest:
    train_all, parts = training_rows(samples), []
    for fold in range(K.BACKTEST_FOLDS):
        train_if, test_if = fold_of(fold)
        train = train_all.where(train_if)
        model = TR.fit_regressor(train, TR.usable(train, FEATURES), "y", NOMINAL, **params)
        scored = model.transform(samples.where(test_if))
        parts.append(materialise(scored.select(*SERIES, "idx", "h", "y", F.col("prediction").alias("pred"), F.lit(fold).alias("fold"))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumns({"res": F.col("y") - F.col("pred"), "err_model": F.abs(F.col("y") - F.col("pred")), "err_naive": F.abs("y")})
    errors = A.error_sets(rows, "product_id", "h", "err_model", "err_naive")
    return Backtest(rows, errors, residual_bands(rows))


def residual_bands(rows: DataFrame) -> DataFrame:
    """p10 and p90 of model and naive residuals per product and horizon (own when enough rows, else the horizon's)."""
    both = rows.select("product_id", "h", F.explode(F.array(
        F.struct(F.lit("model").alias("kind"), F.col("res").alias("res")), F.struct(F.lit("naive").alias("kind"), F.col("y").alias("res")))).alias("r")
    ).select("product_id", "h", "r.*")
    own = exact_quantiles(both, ["kind", "product_id", "h"], "res", {"own10": 0.1, "own90": 0.9})
    overall = exact_quantiles(both, ["kind", "h"], "res", {"all10": 0.1, "all90": 0.9}).drop("n_values")
    enough = F.col("n_values") >= K.MIN_OWN_RESIDUALS
    return own.join(overall, ["kind", "h"]).select(
        "kind", "product_id", "h", F.coalesce(F.when(enough, F.col("own10")), F.col("all10")).alias("q10"),
        F.coalesce(F.when(enough, F.col("own90")), F.col("all90")).alias("q90"), "all10", "all90")


def expected_improvement(errors: DataFrame) -> DataFrame:
    """Improvement per product and horizon when it rests on enough rows, else the product's."""
    cell = errors.where((F.col("all_products") == 0) & (F.col("all_horizons") == 0))
    product = errors.where((F.col("all_products") == 0) & (F.col("all_horizons") == 1)).select(
        "product_id", F.col("improvement").alias("_product"))
    own = F.when(F.col("n") >= K.MIN_PRODUCT_HORIZON_ROWS, F.col("improvement"))
    return cell.join(product, "product_id").select("product_id", "h", F.coalesce(own, F.col("_product")).alias("improvement"))


def publish(future: DataFrame, improvement: DataFrame, bands: DataFrame) -> DataFrame:
    """Future rows (series, h, log_price, pred, target_day) to published prices: the model where it earned it, else naive."""
    rows = future.join(improvement, ["product_id", "h"], "left").withColumn("confidence", R.confidence_class(F.col("improvement")))
    use = F.col("confidence").isin("alta", "media")
    rows = rows.withColumns({"kind": F.when(use, "model").otherwise("naive"), "shift": F.when(use, F.col("pred")).otherwise(F.lit(0.0))})
    # A product outside the backtest has no own band; then the horizon's, else the default.
    overall = bands.groupBy("kind", "h").agg(F.max("all10").alias("_all10"), F.max("all90").alias("_all90"))
    rows = rows.join(bands.drop("all10", "all90"), ["kind", "product_id", "h"], "left").join(overall, ["kind", "h"], "left")
    base = F.exp("log_price")
    q10 = F.coalesce("q10", "_all10", F.lit(K.DEFAULT_BAND[0]))
    q90 = F.coalesce("q90", "_all90", F.lit(K.DEFAULT_BAND[1]))
    return rows.select(
        *SERIES, "target_day", "h", (base * F.exp("shift")).alias("price"), (base * F.exp(F.col("shift") + q10)).alias("p10"),
        (base * F.exp(F.col("shift") + q90)).alias("p90"), F.when(use, "trees").otherwise("naive").alias("method"), "confidence")


def predict(samples: DataFrame, tested: Backtest, **params) -> DataFrame:
    """Fit on all known targets and publish from the last day of the panel."""
    train = training_rows(samples)
    model = TR.fit_regressor(train, TR.usable(train, FEATURES), "y", NOMINAL, **params)
    last = samples.where(F.col("idx") == F.col("panel_end"))
    future = model.transform(last).select(*SERIES, "h", "log_price", "target_day", F.col("prediction").alias("pred"))
    return publish(future, expected_improvement(tested.errors), tested.quantiles)


def reusable_backtest(registry: DataFrame, name: str, as_of: datetime) -> DataFrame:
    """The active version of the model when it is young enough to be used again."""
    from cropspark.operators.merge import active_versions

    oldest = D.moment(as_of) - F.make_dt_interval(F.lit(K.BACKTEST_MAX_AGE_DAYS))
    return active_versions(registry).where((F.col("model_name") == name) & (F.col("trained_at") > oldest))
