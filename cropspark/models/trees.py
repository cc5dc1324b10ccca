"""Tree learners on feature columns with gaps.

Spark's trees do not route missing values, so gaps get the median of the training rows and a flag column keeps that they
were gaps. They are never set to 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.operators.ranks import OrderedRanges
from cropspark.session import materialise


def with_gap_flags(df: DataFrame, features: list[str]) -> DataFrame:
    out = df.withColumns({c: F.col(c).cast("double") for c in features})
    return out.withColumns({f"{c}_gap": F.col(c).isNull().cast("double") for c in features})


def usable(train: DataFrame, features: list[str]) -> list[str]:
    """Features with at least one value among the training rows; a median of nothing does not exist."""
    counts = train.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if counts[c] > 0]


def as_nominal(df: DataFrame, codes: list[str]) -> DataFrame:
    """Mark columns of codes from 0 as categories, so that a tree splits their set, not their order."""
    if not codes:
        return df
    top = df.agg(*[F.max(c).alias(c) for c in codes]).first()
    known = {c: {"ml_attr": {"type": "nominal", "name": c, "num_vals": int(top[c] or 0) + 1}} for c in codes}
    return df.withColumns({c: F.col(c).cast("double").alias(c, metadata=known[c]) for c in codes})


def _bins(df: DataFrame, nominal: list[str]) -> int:
    """Spark's default, or as many bins as the largest set of categories."""
    return max([32, *[df.schema[c].metadata["ml_attr"]["num_vals"] for c in nominal]])


def _stages(features: list[str], nominal: list[str]) -> list:
    filled = [f"{c}_filled" for c in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=[*filled, *[f"{c}_gap" for c in features], *nominal], outputCol="features")]


def fit_regressor(train: DataFrame, features: list[str], target: str, nominal: list[str] = (), **params) -> PipelineModel:
    """Gradient-boosted trees with absolute loss; ``nominal`` columns come from :func:`as_nominal`."""
    settings = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42, "maxBins": _bins(train, nominal), **params}
    learner = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", lossType="absolute", **settings)
    return Pipeline(stages=[*_stages(features, list(nominal)), learner]).fit(train)


def fit_classifier(train: DataFrame, features: list[str], target: str, nominal: list[str] = (), **params) -> PipelineModel:
    settings = {"numTrees": 60, "maxDepth": 6, "seed": 42, "maxBins": _bins(train, nominal), **params}
    learner = RandomForestClassifier(featuresCol="features", labelCol=target, predictionCol="prediction", **settings)
    return Pipeline(stages=[*_stages(features, list(nominal)), learner]).fit(train)


def importances(model: PipelineModel, features: list[str], k: int = 10, nominal: list[str] = ()) -> list[tuple[str, float]]:
    """The k most important features; a feature and its gap flag count together."""
    values = model.stages[-1].featureImportances.toArray()
    both = [(f, float(values[i] + values[i + len(features)])) for i, f in enumerate(features)]
    both += [(f, float(values[2 * len(features) + i])) for i, f in enumerate(nominal)]
    return sorted(both, key=lambda x: (-x[1], x[0]))[:k]


def permutation_importance(df: DataFrame, features: list[str], key: list[str], predict: Callable[[DataFrame], DataFrame], y: str, yhat: str, seed: int = 42,
                           also: dict[str, list[str]] | None = None) -> DataFrame:
    """``feature, importance``: how much the mean absolute error of a prediction grows when one feature's values change places.

    Rows stand in the order of a hash of their ``key``; each row's value of the feature is the next row's (the last row's is the first's). Places come
    from ordered ranges and values from an equi-join on them, so no task and no driver sees a whole column. All features are predicted in one pass over
    copies of the rows, of which each has another feature changed; ``also`` names columns that change together with one (its gap flag).
    ``key`` must tell the rows apart.
    """
    moved = {f: [f, *(also or {}).get(f, [])] for f in features}
    columns = list(dict.fromkeys(c for cs in moved.values() for c in cs))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    placed = materialise(OrderedRanges(df.withColumn("_order", order), [], ["_order", *key]).add(_place=("sum", F.lit(1)), _rows=("total", F.lit(1))).rows)
    donors = placed.select((F.when(F.col("_place") == 1, F.col("_rows")).otherwise(F.col("_place") - 1)).alias("_place"), F.struct(*columns).alias("_next"))
    copies = placed.join(donors, "_place").withColumn("_moved", F.explode(F.array(F.lit(""), *[F.lit(f) for f in features])))
    takes = {c: F.col("_moved").isin([f for f, cs in moved.items() if c in cs]) for c in columns}
    changed = copies.withColumns({c: F.when(takes[c], F.col("_next")[c]).otherwise(F.col(c)).alias(c, metadata=df.schema[c].metadata) for c in columns})
    error = materialise(predict(changed).groupBy("_moved").agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae")))  # a row for each feature
    base = error.where("_moved = ''").select("mae").scalar()
    return error.where("_moved <> ''").select(F.col("_moved").alias("feature"), (F.col("mae") - base).alias("importance"))
