"""Helpers of the corpus operators: written stages in the shared folder, word and shingle hashes, exact offsets."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cropspark.session import shared_dir

#: Bytes of text that one step of a task holds at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # what is written needs its shuffle files no more
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``scratch`` that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_offsets(df: DataFrame, order: list[str], size: str, start: str, row: str, parts: int | None = None) -> DataFrame:
    """Add the exact sum of ``size`` (column ``start``) and the number (``row``) of all rows before each row.

    The rows are cut into ordered ranges, each range is summed by itself, and the totals of the ranges, one row each, are summed over
    each other. No task sees more than its range; the range is written first, so that a task run again finds the same rows.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_size"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_size_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn(start, F.sum(size).over(running) - F.col(size)).withColumn(row, (F.row_number().over(inside) - 1).cast("long"))
        .join(bases, "_part")
        .withColumn(start, F.col(start) + F.col("_size_before")).withColumn(row, F.col(row) + F.col("_rows_before"))
        .drop("_part", "_size_before", "_rows_before"))


def utf8(text: Column) -> Column:
    """Bytes of the text, a missing text as an empty one."""
    return F.coalesce(text, F.lit("")).cast("binary")


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold at most ``limit`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


#: What lets go of anything a worker keeps from task to task.
AT_START: list[Callable[[], None]] = []


def tidy(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """A task function that gives its memory back to the system at its end: a worker that waits for its next task holds little. What other tasks
    have left for their like goes at the start, unless it is to ``keep``."""

    def tidied(batches: Iterator) -> Iterator:
        for release in [] if keep else AT_START:
            release()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all texts, A-Z lower-cased, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()], bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words, and the bounds of each text's runs; a shorter text is one run, an empty one none."""
    n = np.diff(bounds)
    runs = np.where(n >= length, n - length + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(ends[-1], np.uint64)
    full = n >= length
    if full.any():
        chained = mix(words)
        for k in range(1, length):
            chained = mix(chained[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
        starts = np.repeat(bounds[:-1][full], runs[full]) + _ramp(runs[full])
        out[np.repeat(ends[:-1][full], runs[full]) + _ramp(runs[full])] = chained[starts]
    for i in np.flatnonzero(~full & (n > 0)):
        value = mix(words[bounds[i] : bounds[i] + 1])
        for w in words[bounds[i] + 1 : bounds[i + 1]]:
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + w)
        out[ends[i]] = mix(value + np.uint64(n[i]))[0]
    return out, ends


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[starts[i] : starts[i] + lengths[i]]`` of every i, one after the other."""
    return flat[np.repeat(starts, lengths) + _ramp(lengths)]
