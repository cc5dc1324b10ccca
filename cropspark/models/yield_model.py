"""Yield model: boosted trees on the difference to the baseline, judged on years they have not seen."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropspark.models import folds as FO
from cropspark.models import trees as TR
from cropspark.operators import aggregate as A
from cropspark.operators.ranks import dense_codes
from cropspark.session import materialise

# Identifiers, the target, and what is only known after the harvest.
NOT_FEATURES = {"town_id", "crop_id", "year", "department", "suitability", "is_nino", "yield_t_ha", "production_t",
                "harvested_ha"}


@dataclass
class YieldReport:
    predictions: DataFrame
    metrics: DataFrame
    coverage: DataFrame
    importances: DataFrame
    params: dict
    test_year: int
    folds: list[dict] = field(default_factory=list)


def feature_columns(df: DataFrame) -> list[str]:
    numeric = {"int", "bigint", "double", "float", "smallint"}
    return [c for c, t in df.dtypes if c not in NOT_FEATURES and t in numeric]


def with_codes(store: DataFrame) -> tuple[DataFrame, list[str]]:
    """Codes of town, department and crop, as far as the store has them; the dimensions are joined, never collected."""
    codes = []
    for column in ("town_id", "department", "crop_id"):
        if column in store.columns:
            code = f"{column.removesuffix('_id')}_code"
            store = store.drop(code).join(dense_codes(store, column, code), column)
            codes.append(code)
    return store, codes


def _fit_predict(df: DataFrame, train_years: list[int], year: int, features: list[str], nominal: list[str], params: dict):
    known = F.col("year").isin(*train_years)
    based = FO.with_baseline(df, known, "yield_t_ha", "yield_t_ha_hist", "crop_id")
    train = based.where(known).withColumn("residual", F.col("yield_t_ha") - F.col("baseline"))
    model = TR.fit_regressor(train, features, "residual", nominal, **params)
    out = model.transform(based.where(F.col("year") == year)).select(
        "town_id", "crop_id", "year", F.col("yield_t_ha").alias("y"), "baseline", (F.col("baseline") + F.col("prediction")).alias("yhat"))
    return model, out


def train_and_evaluate(store: DataFrame, grid: list[dict] | None = None) -> YieldReport:
    """Choose parameters by mean fold error on the years before the last, then predict the last year.

    Every prediction kept comes from a model that has not seen its year.
    """
    store, nominal = with_codes(materialise(store.where(F.col("yield_t_ha").isNotNull())))
    columns = [c for c in feature_columns(store) if c not in nominal]
    df = TR.as_nominal(materialise(TR.with_gap_flags(store, columns)), nominal)
    years = FO.distinct_years(df)
    test_year, seen = years[-1], years[:-1]
    folds = FO.year_folds(seen)
    features = TR.usable(df.where(F.col("year").isin(*folds[0][0])), columns)
    best: tuple[float, dict, list[DataFrame], list[dict]] | None = None
    for params in grid or [{}]:
        parts, details = [], []
        for train_years, year in folds:
            _, out = _fit_predict(df, train_years, year, features, nominal, params)
            out = materialise(out)
            mae = A.regression_metrics(out, "y", "yhat").first()["mae"]
            parts.append(out)
            details.append({"validation_year": year, "mae": mae})
        score = sum(d["mae"] for d in details) / len(details)
        if best is None or score < best[0]:
            best = (score, params, parts, details)
    _, params, parts, details = best
    model, test = _fit_predict(df, seen, test_year, features, nominal, params)
    oof = materialise(test)
    for part in parts:
        oof = oof.unionByName(part)
    bounded = materialise(FO.calibrated_intervals(oof, test_year, [y for _, y in folds] + [test_year]))
    last = bounded.where(F.col("year") == test_year)
    metrics = (A.regression_metrics(last, "y", "yhat").withColumn("model", F.lit("trees"))
               .unionByName(A.regression_metrics(last, "y", "baseline").withColumn("model", F.lit("baseline"))))
    return YieldReport(bounded, metrics, FO.interval_coverage(bounded, test_year), _importances(df, seen, test_year, model, features, nominal), params, test_year, details)


def _importances(df: DataFrame, seen: list[int], year: int, model, features: list[str], nominal: list[str], k: int = 10) -> DataFrame:
    """The k features (``feature, importance, place``) whose exchange between the rows of the test year costs most accuracy."""
    known = F.col("year").isin(*seen)
    rows = FO.with_baseline(df, known, "yield_t_ha", "yield_t_ha_hist", "crop_id").where(F.col("year") == year)
    score = lambda d: model.transform(d).withColumn("_yhat", F.col("baseline") + F.col("prediction"))
    found = TR.permutation_importance(rows, [*features, *nominal], ["town_id", "crop_id", "year"], score, "yield_t_ha", "_yhat", also={f: [f"{f}_gap"] for f in features})
    top = Window.orderBy(F.desc("importance"), "feature")  # a row for each feature
    return found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)
