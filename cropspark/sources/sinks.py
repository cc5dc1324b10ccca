"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.functions.text import csv_guard


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_price_fact(df: DataFrame, path: str) -> None:
    """Price fact partitioned by month and sorted by series, so date bounds prune folders and series bounds row groups."""
    monthly = df.withColumn("year_month", F.date_format("day", "yyyy-MM"))
    (monthly.repartitionByRange("year_month", "product_id", "market_id")
     .sortWithinPartitions("year_month", "product_id", "market_id", "day")
     .write.mode("overwrite").partitionBy("year_month").parquet(path))


def export_columns(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Chosen columns with their titles; text that a spreadsheet would run is neutralised."""
    text = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[(csv_guard(F.col(c)) if c in text else F.col(c)).alias(title) for c, title in titles.items()])


def write_csv_export(df: DataFrame, titles: dict[str, str], path: str) -> None:
    (export_columns(df, titles).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def as_documents(df: DataFrame, key: str, name: str = "payload") -> DataFrame:
    """One JSON document per key."""
    body: Column = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    return df.select(key, body.alias(name))
