"""Readers. Text sources are read as text and cast later with try_cast, so a bad value becomes missing, never an error."""

from __future__ import annotations

import logging
import re
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropspark.operators.ranking import union_all
from cropspark.sources import parsers as P


log = logging.getLogger(__name__)
#: Spark's error conditions of a path without data, and its messages about a file that is no parquet.
MISSING = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}
UNREADABLE = "CANNOT_READ_FILE_FOOTER|is not a Parquet file|FAILED_READ_FILE.*CANNOT_READ"


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _json_elements(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Each record of the landed documents as text: an array's elements, or a document's lines. A broken array is one record."""
    if lines:
        return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("record")).where(F.trim("value") != "")
    docs = read_documents(spark, path)
    listed = F.from_json("document", "array<string>")
    is_array = F.startswith(F.ltrim("document"), F.lit("["))
    records = F.when(is_array, F.coalesce(listed, F.array("document"))).otherwise(F.split("document", r"\r?\n"))
    return docs.select("file", F.explode(records).alias("record")).where(F.trim("record") != "")


def _parsed(spark: SparkSession, path: str, columns: list[str], lines: bool) -> DataFrame:
    schema = T.StructType([*_text_schema(columns).fields, T.StructField("_broken", T.StringType())])
    read = F.from_json("record", schema, {"columnNameOfCorruptRecord": "_broken"})
    rows = _json_elements(spark, path, lines).withColumn("_r", read)
    return rows.withColumn("_bad", F.col("_r").isNull() | F.col("_r._broken").isNotNull() | ~F.startswith(F.ltrim("record"), F.lit("{")))


def read_json_rows(spark: SparkSession, path: str, columns: list[str], lines: bool = False) -> DataFrame:
    """Landed arrays or lines of JSON objects, all fields as text.

    Where every file holds ``lines``, a file of any size is read in as many tasks as it has splits. An array begins and ends with its file, so files that
    may be arrays are read whole by one task each: a landed page is small. Records that are no object are in ``rejected_json``.
    """
    return _parsed(spark, path, columns, lines).where(~F.col("_bad")).select(*[F.col(f"_r.{c}").alias(c) for c in columns])


def rejected_json(spark: SparkSession, path: str, columns: list[str], lines: bool = False) -> DataFrame:
    """``file, record`` of what ``read_json_rows`` can't read; a broken array is one record, so none of its rows count."""
    return _parsed(spark, path, columns, lines).where("_bad").select("file", "record")


def read_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(_text_schema(columns)).csv(path) if columns else reader.csv(path)


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A usable parquet source, or None, so that it is fetched again, when it is missing or empty or any of its files has no readable footer.
    Other errors are raised, those of damaged pages when they are read: part of a source is never taken for the whole."""
    try:
        df = spark.read.option("mergeSchema", True).parquet(path)
        return None if df.isEmpty() else df
    except (PySparkException, Py4JJavaError) as error:
        told = str(error)
        missing = isinstance(error, PySparkException) and error.getCondition() in MISSING
        if missing or re.search(UNREADABLE, told):
            log.warning("no usable parquet at %s: %s", path, "; ".join(re.findall(r"\[[A-Z_]{8,}.*", told)[:3]) or told[:200])
            return None
        raise


def read_price_xml(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Price feed: ``return`` elements of the landed envelopes."""
    rows = spark.read.format("xml").option("rowTag", "return").schema(_text_schema(P.PRICE_FIELDS)).load(path)
    return P.since_day(rows, since)


def read_index_table(spark: SparkSession, path: str, first_year: int = 2000, last_year: int | None = None) -> DataFrame:
    return P.index_lines(spark.read.text(path), "value", first_year, last_year)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: its path and its whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("document"))


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """Suitability layers, one ``<crop>.json`` file per crop (or page of it: ``<crop>-<n>.json``)."""
    docs = read_documents(spark, path)
    name = F.regexp_extract(F.url_decode("file"), r"([^/]+?)(?:-\d+)?\.json$", 1)
    return P.layer_attributes(docs, "document", name)


def read_sheets(spark: SparkSession, path: str, page_break: str | None = None) -> DataFrame:
    """Headerless sheets landed as CSV to (file, row, cells), all as wide as the widest row could be.

    A row has at most one cell more than delimiters; lines that a quote leaves open belong to the row begun before. Each file is read
    whole by one task, as its row order asks: a landed file is small. The driver keeps a list of all files, so sheets that are many are
    landed many to a file, each below a row of ``page_break`` alone (``number_rows``).
    """
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("held"), F.lit(0).alias("most"))

    def count(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def line(acc: Column, text: Column) -> Column:
        held = acc["held"] + count(text, ",")
        odd = (acc["open"] + count(text, '"')) % 2
        return F.struct(odd.alias("open"), F.when(odd == 1, held).otherwise(0).alias("held"), F.greatest(acc["most"], held).alias("most"))

    wide = F.aggregate(F.split("document", "\n"), start, line, lambda acc: acc["most"])
    width = (read_documents(spark, path).agg(F.max(wide)).first()[0] or 0) + 1
    raw = (spark.read.schema(_text_schema([f"c{i}" for i in range(width)])).option("multiLine", True).option("escape", '"').csv(path)
           .withColumns({"_file": F.input_file_name(), "_order": F.monotonically_increasing_id()}))
    return P.number_rows(raw, page_break=page_break)


def read_drop_folder(spark: SparkSession, folder: str) -> DataFrame | None:
    """Union of whatever CSV and parquet files were dropped; columns are matched by name."""
    frames = []
    for suffix, load in (("csv", lambda p: read_csv_text(spark, p)), ("parquet", lambda p: spark.read.parquet(p))):
        try:
            frames.append(load(f"{folder}/*.{suffix}"))
        except AnalysisException:
            continue
    if not frames:
        return None
    return union_all([f.select(*[F.col(c).cast("string").alias(c) for c in f.columns]) for f in frames])


def read_relation(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None,
                  properties: dict[str, str] | None = None) -> DataFrame:
    """A relational query over JDBC; with (column, low, high, n) it is read by n tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS q").options(**(properties or {}))
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def read_price_fact(spark: SparkSession, path: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """Price fact by month; day bounds also bound the month folders, so other months are not opened."""
    df = spark.read.parquet(path)
    month = F.col("year_month").cast("string")
    if since:
        df = df.where((F.col("day") >= F.lit(since)) & (month >= since.strftime("%Y-%m")))
    if until:
        df = df.where((F.col("day") <= F.lit(until)) & (month <= until.strftime("%Y-%m")))
    return df
