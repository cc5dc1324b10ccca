"""Next-month risk: random forest against persistence, split by time."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import dates as D
from cropspark.functions import rules as R
from cropspark.models import trees as TR
from cropspark.operators import aggregate as A
from cropspark.operators import ranking as Q
from cropspark.session import materialise

log = logging.getLogger(__name__)
FEATURES = ["rain_mm", "temp_mean", "temp_max", "temp_min", "humidity", "sun_hours", "oni", "spi", "rain_anomaly_pct",
            "rain_mm_lag1", "rain_anomaly_pct_lag1", "risk", "risk_lag1", "month_sin", "month_cos"]


def time_split(samples: DataFrame, test_months: int = K.ALERT_TEST_MONTHS) -> tuple[DataFrame, DataFrame]:
    """Last months with a known target as test; training rows have their target month before the test begins."""
    known = samples.where(F.col("target").isNotNull())
    last = known.agg(F.max("period")).first()[0]
    if last is None:
        raise ValueError("no month has a following month: nothing to learn from")
    start = last - test_months + 1
    return known.where(F.col("period") + 1 < start), known.where(F.col("period") >= start)


def train_and_evaluate(samples: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """Predictions (history of the test months, inactive; newest month per town, active) and metrics of model and baseline."""
    data = materialise(TR.with_gap_flags(samples, FEATURES))
    train, test = time_split(data)
    if train.select("target").distinct().count() < 2:
        # Nothing to tell apart: the risk of now stands for that of the next month, and the metrics say so.
        log.warning("training months have one class or none: persistence is used")
        kept = F.col("risk").cast("double").alias("prediction"), F.lit(None).cast("double").alias("score")
        metrics = A.classification_metrics(test, "target", "risk").withColumn("model", F.lit("persistence"))
        newest = Q.latest_per_key(data, ["town_id"], ["period"])
        columns = ["town_id", "period", "event", *kept]
        return alert_rows(newest.select(*columns), test.select(*columns)), metrics
    features = TR.usable(train, FEATURES)
    train = train.withColumn("label", F.col("target").cast("double"))
    model = TR.fit_classifier(train, features, "label", **params)
    judged = materialise(model.transform(test).select("town_id", "period", "year", "month", "event", "target", "risk", "prediction", _confidence()))
    metrics = (A.classification_metrics(judged, "target", "prediction").withColumn("model", F.lit("forest"))
               .unionByName(A.classification_metrics(judged, "target", "risk").withColumn("model", F.lit("persistence"))))
    newest = Q.latest_per_key(data, ["town_id"], ["period"])
    current = model.transform(newest).select("town_id", "period", "event", "prediction", _confidence())
    history = judged.select("town_id", "period", "event", "prediction", "score")
    return alert_rows(current, history), metrics


def _confidence():
    from pyspark.ml.functions import vector_to_array

    return F.array_max(vector_to_array("probability")).alias("score")


def alert_rows(current: DataFrame, history: DataFrame) -> DataFrame:
    """Rows for the month after the observed one; the active forecast wins over history for the same town and month."""
    frames = [f.withColumn("is_active", F.lit(active)) for f, active in ((current, True), (history, False))]
    rows = Q.union_with_precedence([f.withColumn("period", F.col("period") + 1) for f in frames], ["town_id", "period"])
    level = R.risk_label(F.col("prediction"))
    return rows.select(
        "town_id", D.month_index_year(F.col("period")).alias("year"), D.month_index_month(F.col("period")).alias("month"),
        level.alias("level"), "event", "score", "is_active",
        F.format_string("Riesgo %s previsto para %s (evento observado: %s).", F.lower(level),
                        F.lower(D.month_name_es(D.month_index_month(F.col("period")))), F.col("event")).alias("description"))
