"""File stream of prices into a table by month, late data, run log, daily roll-up as a stream.

The merge sink takes daily rows, a later one revising an earlier one. It is exactly-once because the merge is idempotent: a replayed batch
finds its rows already stored and changes nothing. Single quotes, of which a day may have some in any number of batches, go to
``quote_sink``, which keeps sums that add up. The file source remembers paths, so a republished file needs a new name (with its publication time).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropspark.operators import merge as M

LATE_DAYS = "7 days"
FACT_KEY = ["market_id", "product_id", "day"]


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "json", pattern: str | None = None, files_per_batch: int = 10,
                **options: str) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def drop_repeats(stream: DataFrame, day: str, key: list[str], values: list[str]) -> DataFrame:
    """Drop rows already seen within the last seven days of event time.

    The values belong to the identity: a revised price for a known day is not a repeat. The watermark bounds the state.
    """
    timed = stream.withColumn("_event", F.col(day).cast("timestamp")).withWatermark("_event", LATE_DAYS)
    return timed.dropDuplicatesWithinWatermark([*key, *values, "_event"]).drop("_event")


def merge_sink(table: str, log: str, source: str, transform: Callable[[DataFrame], DataFrame]):
    """foreachBatch function: transform the batch, merge it by precedence into the months it touches, append to the run log."""

    def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        merged = M.upsert_by_precedence(stored, incoming, FACT_KEY, "price_avg", "price_min", "price_max", "source")
        return _with_month(merged)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, started = batch.sparkSession, datetime.now(UTC)
        try:
            merged = M.merge_touched_partitions(spark, table, _with_month(transform(batch)), "year_month", merge, ["product_id", "market_id"])
            changed = F.col("change_type").isin(M.INSERTED, M.CHANGED)
            seen = merged.agg(F.count_if(changed).alias("new_rows"), F.max("day").alias("max_day")).first()
        except Exception as error:
            log_run(spark, log, source, started, "error", error=str(error)[:500])
            raise
        log_run(spark, log, source, started, "ok", seen.new_rows, seen.max_day)

    return write


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("year_month", F.date_format("day", "yyyy-MM"))


RUN_FIELDS = "source string, started_at timestamp, finished_at timestamp, status string, new_rows long, max_day date, error string"


def log_run(spark: SparkSession, log: str, source: str, started: datetime, status: str, new_rows: int | None = None,
            max_day=None, error: str | None = None) -> None:
    """Append one closed run."""
    log_runs(spark.createDataFrame([(source, started, datetime.now(UTC), status, new_rows, max_day, error)], RUN_FIELDS), log)


def log_runs(runs: DataFrame, log: str) -> None:
    """Append closed runs (``RUN_FIELDS``), as one file: a log has few rows at a time."""
    runs.coalesce(1).write.mode("append").parquet(log)


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived since the last run, then stop."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_means(stream: DataFrame, event_time: str, keys: list[str], value: str) -> DataFrame:
    """Tumbling one-day means; the watermark lets late rows of seven days still count."""
    return stream.withWatermark(event_time, LATE_DAYS).groupBy(F.window(event_time, "1 day"), *keys).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def window_day(window: str = "window"):
    """Day of a one-day window; windows start at midnight UTC whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(F.col(f"{window}.start")) / 86400).cast("int"))


def quote_sink(table: str, transform: Callable[[DataFrame], DataFrame]):
    """foreachBatch function for single quotes (market_id, product_id, day, price): each batch keeps its own sums of a day."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = transform(batch).groupBy(*FACT_KEY).agg(
            F.sum("price").alias("total"), F.count("price").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
        M.write_batch(sums, table, batch_id, _add_up)

    return write


def _add_up(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*FACT_KEY).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("batch").alias("batch"))


def quoted_days(spark: SparkSession, table: str) -> DataFrame:
    """Daily price rows from the sums of all batches."""
    return M.read_batches(spark, table).groupBy(*FACT_KEY).agg(
        F.min("low").alias("price_min"), F.max("high").alias("price_max"), (F.sum("total") / F.sum("n")).alias("price_avg"))


def update_sink(table: str, select: Callable[[DataFrame], DataFrame], keys: list[str] | None = None):
    """foreachBatch function for update mode: each batch keeps the rows it changed. Folded batches keep the last row of each of the ``keys``."""

    def last(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")

    def write(batch: DataFrame, batch_id: int) -> None:
        M.write_batch(select(batch), table, batch_id, last if keys else None)

    return write


def latest_rows(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Each key's row of the last batch that changed it."""
    rows = M.read_batches(spark, table)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*values), "batch")
    return rows.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def newer_data(fact: DataFrame, runs: DataFrame, stage: str) -> DataFrame:
    """Whether the stage has to run again: the fact's newest day against the newest day of the stage's last good run."""
    done = runs.where((F.col("source") == stage) & (F.col("status") == "ok")).agg(F.max("max_day")).scalar()
    return fact.agg(F.max("day").alias("max_day")).select(
        "max_day", done.alias("done_day"), (done.isNull() | (F.col("max_day") > done)).alias("is_due"))


def missing_months(present: DataFrame, first: str, last: str) -> DataFrame:
    """Months of the span without a landed partition (year, month)."""
    span = present.sparkSession.range(1).select(F.explode(F.sequence(
        F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("m"))
    return span.select(F.year("m").alias("year"), F.month("m").alias("month")).join(
        present.select("year", "month").distinct(), ["year", "month"], "left_anti")


def reprocess_window(raw: DataFrame, day: str, as_of, days: int = 7) -> DataFrame:
    """Rows of the last days, read again on every run so that late and revised rows arrive."""
    return raw.where(F.col(day) >= F.date_sub(F.lit(str(as_of)[:10]).cast("date"), days))

