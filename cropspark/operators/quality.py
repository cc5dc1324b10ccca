"""Data-quality checks. Each check is one row; checks of one table share one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.functions import collections as C
from cropspark.functions import rules as R
from cropspark.operators.ranking import latest_per_key

CHECK_COLUMNS = ["module", "check", "passed", "failing_rows"]


def _checks(df: DataFrame, module: str, counts: dict[str, Column]) -> DataFrame:
    """Failing-row counts by check name, in one aggregate, then one row each."""
    names = list(counts)
    wide = df.agg(*[counts[n].cast("long").alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("failing_rows"))
        for i, n in enumerate(names)])).alias("r")
    return wide.select(rows).select(
        F.lit(module).alias("module"), "r.check", (F.col("r.failing_rows") == 0).alias("passed"), "r.failing_rows")


def not_null(columns: list[str]) -> dict[str, Column]:
    return {f"{c} not null": F.count_if(F.col(c).isNull()) for c in columns}


def in_range(bounds: dict[str, tuple[float | None, float | None]]) -> dict[str, Column]:
    out = {}
    for c, (low, high) in bounds.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        # A column without any value has nothing to be in range: all rows fail, an empty table as one.
        out[f"{c} in range"] = F.when(F.count(c) == 0, F.greatest(F.count(F.lit(1)), F.lit(1))).otherwise(F.count_if(bad))
    return out


def range_report(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """``column_name, low, high, min, max, out_of_range, passed`` for each bounded column, from one pass; a column without values has no range to be in."""
    failing = in_range(bounds)
    wide = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), failing[f"{c} in range"].alias("out_of_range")).alias(f"_{i}") for i, c in enumerate(bounds)])
    number = lambda v: F.lit(v).cast("double")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), number(low).alias("low"), number(high).alias("high"), F.col(f"_{i}").alias("r")) for i, (c, (low, high)) in enumerate(bounds.items())])).alias("v")
    return wide.select(rows).select("v.column_name", "v.low", "v.high", "v.r.*").withColumn("passed", F.col("out_of_range") == 0)


def latest_indicators(runs: DataFrame, key: str = "indicator", moment: str = "executed_at") -> DataFrame:
    """The last run of each indicator."""
    return latest_per_key(runs, [key], [moment])


def coherent(low: str, mean: str, high: str) -> dict[str, Column]:
    bad = (F.col(low) > F.col(mean)) | (F.col(mean) > F.col(high)) | (F.col(low) > F.col(high))
    return {f"{low} <= {mean} <= {high}": F.count_if(bad)}


def in_set(column: str, allowed: list) -> dict[str, Column]:
    return {f"{column} in set": F.count_if(~F.col(column).isin(*allowed))}


def matches(column: str, pattern: str) -> dict[str, Column]:
    return {f"{column} matches pattern": F.count_if(~F.col(column).rlike(pattern))}


def no_double_space(column: str) -> dict[str, Column]:
    return {f"{column} single spaces": F.count_if(F.col(column).contains("  "))}


def max_length(limits: dict[str, int]) -> dict[str, Column]:
    return {f"{c} length": F.count_if(F.length(c) > n) for c, n in limits.items()}


def row_checks(df: DataFrame, module: str, *groups: dict[str, Column]) -> DataFrame:
    merged: dict[str, Column] = {}
    for group in groups:
        merged.update(group)
    return _checks(df, module, merged)


def unique_check(df: DataFrame, module: str, keys: list[str]) -> DataFrame:
    """All rows that share their key with another row count as failing."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _checks(counts, module, {f"{','.join(keys)} unique": F.sum(F.when(F.col("_n") > 1, F.col("_n")))})


def reference_check(df: DataFrame, module: str, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """Rows whose code the reference table lacks; missing codes are not judged here. Codes are counted before the join."""
    codes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    known = reference.select(F.col(reference_column).alias(column)).distinct()
    return _checks(codes.join(known, column, "left_anti"), module, {f"{column} in reference": F.sum("_n")})


def type_check(df: DataFrame, module: str, types: dict[str, str]) -> DataFrame:
    """Declared against actual types: a property of the schema, no data is read."""
    actual = dict(df.dtypes)
    rows = [(module, f"{c} is {t}", actual.get(c) == t, int(actual.get(c) != t)) for c, t in types.items()]
    return df.sparkSession.createDataFrame(rows, "module string, check string, passed boolean, failing_rows long")


def audit_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("module").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def validate_table(df: DataFrame, module: str, not_null_columns: list[str] = (), keys: list[str] = (),
                   bounds: dict | None = None, lengths: dict | None = None,
                   references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """The declared constraints of a table as checks."""
    out = row_checks(df, module, not_null(list(not_null_columns)), in_range(bounds or {}), max_length(lengths or {}))
    if keys:
        out = out.unionByName(unique_check(df, module, list(keys)))
    for column, (table, name) in (references or {}).items():
        out = out.unionByName(reference_check(df, module, column, table, name))
    return out


def indicator(name: str, value: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """A one-value query with its thresholds and state."""
    return value.toDF("value").select(
        F.lit(name).alias("indicator"), F.col("value").cast("double").alias("value"),
        R.threshold_state(F.col("value"), F.lit(low).cast("double"), F.lit(high).cast("double")).alias("state"))


def source_audit(reports: DataFrame, rows: str, duplicates: str, completeness: str, low_below: float = 80) -> DataFrame:
    """Mean completeness, columns below the limit and the resulting state per report."""
    share = F.col(duplicates) / F.nullif(F.col(rows), F.lit(0))
    mean = C.map_mean(F.col(completeness))
    return reports.withColumns({
        "mean_completeness": mean, "low_columns": F.array_sort(F.map_keys(C.map_below(F.col(completeness), low_below))),
        "state": R.completeness_state(F.col(rows), share, mean),
    })


def resolve_rate(df: DataFrame, code: str, warn_above: float = 5.0) -> DataFrame:
    missing = F.count_if(F.col(code).isNull())
    pct = missing / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100
    return df.agg(F.count(F.lit(1)).alias("total"), missing.alias("unresolved"), pct.alias("unresolved_pct"),
                  (pct > warn_above).alias("warn"))


REPORT_FIELDS = ("source STRING, uri STRING, rows LONG, columns INT, completeness_pct MAP<STRING, DOUBLE>, key_duplicates LONG, "
                 "extracted_at STRING")


def sync_reports(stored: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """Upsert extraction reports (JSON documents) by source; broken JSON and documents of another kind are ignored."""
    from cropspark.operators.merge import upsert

    parsed = documents.select(F.from_json(document, REPORT_FIELDS).alias("r")).select("r.*")
    valid = parsed.where(F.col("source").isNotNull() & F.col("rows").isNotNull() & F.col("completeness_pct").isNotNull())
    packed = valid.withColumn("completeness_pct", F.to_json("completeness_pct"))
    return upsert(stored, packed, ["source"], ["extracted_at"])
