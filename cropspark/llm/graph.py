"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import forget, scratch, written


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of a link ``a, b``: the smallest id that links lead to.

    Each round takes the smallest label among the neighbours (combined before the shuffle, so a hub costs one row a task) and then the
    label's own label, which halves the length of chains. Rounds are written in the shared folder.
    """
    spark = links.sparkSession
    edges = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels, folder = edges.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")), None
    while True:
        near = edges.join(labels, edges["a"] == labels["id"]).groupBy("b").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["id"] == near["b"], "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        target = hooked.select(F.col("id").alias("t"), F.col("component").alias("jump"))
        path = scratch(spark)
        moved = written(hooked.join(target, hooked["component"] == target["t"], "left").select("id", "was", F.least("component", F.coalesce("jump", "component")).alias("component")), path)
        labels = moved.select("id", "component")
        if folder:
            forget(spark, folder)
        folder = path
        if moved.filter("component <> was").isEmpty():
            return labels
