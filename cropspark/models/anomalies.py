"""Isolation forest per crop.

A tree of this method grows from at most 256 rows, by its definition. Each tree draws its own from all rows of its crop, those with
the smallest hashes of seed, tree and key; every row is scored. Scoring splits a crop into blocks, so a crop holding a third of all rows is many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.operators import windows as W
from cropspark.operators.ranks import exact_quantiles
from cropspark.session import materialise

INPUTS = ["predicted", "change", "deviation"]
SAMPLE = 256
#: Rows of a crop that a tree chooses its sample from: far more than it takes, so that a hash bound finds enough.
LIKELY = 4 * SAMPLE
BLOCK_ROWS = 50_000


def anomaly_inputs(predictions: DataFrame) -> DataFrame:
    """Prediction, yearly change and deviation from the crop mean. A first year has no change; only inside the forest's
    input vector that counts as 0."""
    rows = predictions.withColumn("change", W.difference_from_previous(["town_id", "crop_id"], "year", "predicted"))
    return W.relative_to_group_mean(rows, ["crop_id"], "predicted", deviation="deviation")


def _grower(trees: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        """All trees of one crop at once, level by level, as complete binary trees in heap order."""
        import numpy as np

        drawn = [g[INPUTS].to_numpy(float) for _, g in pdf.sort_values(["tree", "pick"]).groupby("tree")]
        size = min(map(len, drawn))
        values = np.stack([d[:size] for d in drawn])
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        rng = np.random.default_rng(seed)
        node = np.zeros((trees, size), dtype=np.int64)
        inner, total = 2 ** depth - 1, 2 ** (depth + 1) - 1
        feature = np.zeros((trees, inner), dtype=np.int64)
        threshold = np.full((trees, inner), np.inf)  # an unsplit node sends all rows left
        tree = np.repeat(np.arange(trees)[:, None], size, axis=1)
        for level in range(depth):
            start, width = 2 ** level - 1, 2 ** level
            cell = tree * width + (node - start)
            pick = rng.integers(0, values.shape[2], size=(trees, width))
            lo, hi = np.full(trees * width, np.inf), np.full(trees * width, -np.inf)
            v = np.take_along_axis(values, pick[tree, node - start][:, :, None], axis=2)[:, :, 0]
            np.minimum.at(lo, cell.ravel(), v.ravel())
            np.maximum.at(hi, cell.ravel(), v.ravel())
            lo, hi = lo.reshape(trees, width), hi.reshape(trees, width)
            wide = hi > lo  # false where no row or only equal values arrived
            low, span = np.where(wide, lo, 0.0), np.where(wide, hi, 0.0) - np.where(wide, lo, 0.0)
            cut = np.where(wide, low + rng.random((trees, width)) * span, np.inf)
            feature[:, start:start + width], threshold[:, start:start + width] = pick, cut
            node = 2 * node + 1 + (v > cut[tree, node - start])
        count = np.zeros((trees, 2 ** depth))
        np.add.at(count, (tree.ravel(), (node - inner).ravel()), 1)

        def expected(n):
            n = np.maximum(n, 0.0)
            safe = np.maximum(n, 3.0)
            return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))

        # Path length of a leaf: splits on its way plus what its remaining rows would still need.
        path = np.zeros((trees, total))
        for i in range(inner):
            split = np.isfinite(threshold[:, i]).astype(float)
            path[:, 2 * i + 1], path[:, 2 * i + 2] = path[:, i] + split, path[:, i] + split
        leaf = path[:, inner:] + expected(count)
        return pd.DataFrame({"crop_id": [pdf["crop_id"].iloc[0]], "depth": [depth], "norm": [float(expected(np.array([float(size)]))[0])],
                             "feature": [feature.ravel().tolist()], "threshold": [threshold.ravel().tolist()], "leaf": [leaf.ravel().tolist()]})

    return grow


def _scorer(trees: int):
    def score(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = rows[["town_id", "crop_id", "year"]].copy()
        if rows.empty or forest.empty:
            out["score"] = np.nan
            return out
        f = forest.iloc[0]
        depth, inner = int(f["depth"]), 2 ** int(f["depth"]) - 1
        feature = np.asarray(f["feature"]).reshape(trees, inner)
        threshold = np.asarray(f["threshold"]).reshape(trees, inner)
        leaf = np.asarray(f["leaf"]).reshape(trees, inner + 1)
        x = rows[INPUTS].to_numpy(float)
        total = np.zeros(len(x))
        for t in range(trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
            total += leaf[t, node - inner]
        out["score"] = 2.0 ** (-(total / trees) / max(float(f["norm"]), 1e-9))
        return out

    return score


def isolation_scores(inputs: DataFrame, trees: int = K.ANOMALY_TREES, share: float = K.ANOMALY_SHARE,
                     min_rows: int = K.ANOMALY_MIN_ROWS, seed: int = 42) -> DataFrame:
    """Score every row of crops with enough rows and flag the most isolated share per crop; others get no score."""
    key = ["town_id", "crop_id", "year"]
    # The input is read by the samples, the block sizes and the scoring. Only a first year's change may be missing, and counts as none.
    whole = materialise(inputs.select(*key, *INPUTS))
    rows = whole.withColumn("change", F.coalesce("change", F.lit(0.0))).where(F.col("predicted").isNotNull() & F.col("deviation").isNotNull())
    sizes = rows.groupBy("crop_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    unit = 1_000_000_007
    within = F.ceil(F.lit(float(LIKELY * unit)) / F.col("n"))
    likely = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *key), F.lit(unit)) < within)
    drawn = rows.join(sizes, "crop_id").select(*key, *INPUTS, F.explode(likely).alias("tree")).withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "tree", *key), F.lit(unit)))
    order = Window.partitionBy("crop_id", "tree").orderBy("pick", *key)  # about LIKELY rows
    sample = drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE)
    forest = sample.select("crop_id", "tree", "pick", *INPUTS).groupBy("crop_id").applyInPandas(
        _grower(trees, seed),
        "crop_id string, depth int, norm double, feature array<int>, threshold array<double>, leaf array<double>")
    blocks = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS))
    split = rows.join(blocks, "crop_id").withColumn("block", F.pmod(F.xxhash64(*key), F.col("blocks"))).drop("n", "blocks")
    copies = forest.join(blocks, "crop_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("n", "blocks")
    scores = split.groupBy("crop_id", "block").cogroup(copies.groupBy("crop_id", "block")).applyInPandas(
        _scorer(trees), "town_id int, crop_id string, year int, score double")
    scores = materialise(scores)
    judged = flag_isolated(scores, key, share)
    return whole.select(*key).join(judged, key, "left").withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))


def flag_isolated(scores: DataFrame, key: list[str], share: float = K.ANOMALY_SHARE) -> DataFrame:
    """Flag the rows of each crop whose score is beyond the exact quantile that leaves ``share`` above it."""
    limit = exact_quantiles(scores, ["crop_id"], "score", {"limit": 1 - share}).drop("n_values")
    return scores.join(limit, "crop_id").select(*key, "score", (F.col("score") > F.col("limit")).alias("is_anomaly"))
