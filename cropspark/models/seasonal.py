"""Monthly climate forecast per town: additive Holt-Winters with a 12-month season."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.functions import dates as D
from cropspark.functions.numeric import at_least
from cropspark.operators import windows as W

SEASON = 12


def smoothed(y, parameters):
    """Squared error of the one-step forecasts, and last level, trend and season, for each row (alpha, beta, gamma) of ``parameters``.

    Level and trend begin with the first year's mean and the mean yearly step to the second; the season with the first year's deviations.
    """
    import numpy as np

    a, b, g = np.asarray(parameters, float).T
    first, second = y[:12].mean(), y[12:24].mean()
    level, trend = np.full(a.size, first), np.full(a.size, (second - first) / 12)
    season = np.repeat((y[:12] - first)[:, None], a.size, axis=1)
    sse = np.zeros(a.size)
    for t in range(12, y.size):
        s = season[t % 12].copy()
        error = y[t] - (level + trend + s)
        sse += error * error
        previous = level
        level = a * (y[t] - s) + (1 - a) * (level + trend)
        trend = b * (level - previous) + (1 - b) * trend
        season[t % 12] = g * (y[t] - level) + (1 - g) * s
    return sse, level, trend, season


#: Where the search of the smoothing parameters begins, and the step at which it ends.
GRID = ((0.02, 0.1, 0.25, 0.5, 0.8), (0.0, 0.02, 0.1, 0.3), (0.02, 0.1, 0.25, 0.5, 0.8))
FINEST = 1e-4


def fitted(y) -> tuple[float, float, float]:
    """Alpha, beta and gamma between 0 and 1 with the least squared error: from the best of a grid, all steps along and across the axes are tried at once,
    the best of them is taken, and the step is halved where none is better. Never worse than the grid."""
    import numpy as np

    grid = np.stack([m.ravel() for m in np.meshgrid(*GRID, indexing="ij")], axis=1)
    sse = np.nan_to_num(smoothed(y, grid)[0], nan=np.inf)
    at, least, step = grid[sse.argmin()], sse.min(), 0.1
    moves = np.stack([m.ravel() for m in np.meshgrid(*[(-1.0, 0.0, 1.0)] * 3, indexing="ij")], axis=1)
    while step > FINEST:
        tried = np.clip(at + step * moves, 0, 1)
        sse = np.nan_to_num(smoothed(y, tried)[0], nan=np.inf)
        if sse.min() < least:
            at, least = tried[sse.argmin()], sse.min()
        else:
            step /= 2
    return tuple(at)


def _forecaster(steps: int, parameters: tuple[float, float, float] | None = None):
    """One call per town and measure; its rows are the town's months."""

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("period")
        y = pdf["value"].to_numpy(float)
        chosen = parameters or fitted(y)
        sse, level, trend, season = (x[..., 0] for x in smoothed(y, [chosen]))
        h = np.arange(1, steps + 1)
        ahead = level + h * trend + season[(y.size - 1 + h) % 12]
        method = "holt_winters"
        if not np.isfinite(ahead).all():
            ahead, method = np.full(steps, y[-12:].mean()), "mean_last_12"
        return pd.DataFrame({"town_id": pdf["town_id"].iloc[0], "measure": pdf["measure"].iloc[0], "period": int(pdf["period"].iloc[-1]) + h, "horizon": h,
                             "value": ahead, "method": method, "alpha": chosen[0], "beta": chosen[1], "gamma": chosen[2], "sse": float(sse)})

    return forecast


def seasonal_forecast(months: DataFrame, steps: int = 6, min_months: int = 24, parameters: tuple[float, float, float] | None = None) -> DataFrame:
    """Six months ahead for rain and mean temperature of every town with at least 24 observed months.

    The smoothing parameters are fitted to each series (``fitted``) unless given; they and the squared error stand beside the forecast, as does the
    method, which is ``mean_last_12`` where smoothing gives no number.
    ``months`` has one row per town and month (stations averaged). Months count before gaps are interpolated by Spark.
    """
    long = months.withColumn("period", D.month_index(F.col("year"), F.col("month"))).select("town_id", "period", F.explode(F.array(
        F.struct(F.lit("rain_mm").alias("measure"), F.col("rain_mm").alias("value")),
        F.struct(F.lit("temp_mean").alias("measure"), F.col("temp_mean").alias("value")))).alias("m")).select("town_id", "period", "m.*")
    key = ["town_id", "measure"]
    whole = W.interpolate(long, key, "period", "value")
    sizes = long.groupBy(*key).agg(F.count("value").alias("_n")).where(F.col("_n") >= min_months).drop("_n")
    ready = whole.join(sizes, key, "left_semi").select(*key, F.col("period").cast("int").alias("period"), "value")
    out = ready.groupBy(*key).applyInPandas(
        _forecaster(steps, parameters), "town_id int, measure string, period int, horizon int, value double, method string, alpha double, beta double, gamma double, sse double")
    floor = F.when(F.col("measure") == "rain_mm", at_least(F.col("value"), 0.0)).otherwise(F.col("value"))
    return out.select("town_id", "measure", D.month_index_year(F.col("period")).alias("year"),
                      D.month_index_month(F.col("period")).alias("month"), "horizon", floor.alias("value"), "method", "alpha", "beta", "gamma", "sse")
