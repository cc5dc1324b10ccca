"""Cleaning and conforming: required columns, coercion, ranges, dedupe, provenance."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import numeric as N
from cropspark.functions import text as T
from cropspark.operators.ranking import dedupe_latest


def require_columns(df: DataFrame, required: Iterable[str], source: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"[{source}] missing required columns: {missing}")
    return df


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: N.clean_number(F.col(c)) for c in columns if c in df.columns})


def coerce_text(df: DataFrame, columns: Iterable[str], upper: bool = False) -> DataFrame:
    def clean(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        return F.upper(text) if upper else text

    return df.withColumns({c: clean(c) for c in columns if c in df.columns})


def drop_missing(df: DataFrame, critical: list[str], observe: Observation | None = None) -> DataFrame:
    """Drop rows with a missing critical value; the observation reports rows read and rows dropped."""
    if observe is not None:
        complete = F.lit(True)
        for c in critical:
            complete = complete & F.col(c).isNotNull()
        df = df.observe(observe, F.count(F.lit(1)).alias("rows"), F.count_if(~complete).alias("dropped"))
    return df.dropna(subset=critical)


def keep_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df


def resolve_aliases(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Rename to each target the first of its candidate names the frame has, whatever the letter case."""
    by_lower = {c.lower(): c for c in df.columns}
    renames = {}
    for target, names in candidates.items():
        found = next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)
        if found and found != target:
            renames[found] = target
    return df.withColumnsRenamed(renames)


def align_to_contract(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Columns of the contract, in its order; absent ones are missing values of the stated type."""
    return df.select(*[
        F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in contract.items()
    ])


def add_provenance(df: DataFrame, source_uri: str, extracted_at: datetime | None = None) -> DataFrame:
    moment = F.lit(extracted_at) if extracted_at is not None else F.current_timestamp()
    return df.withColumns({"_source_uri": F.lit(source_uri), "_extracted_at": moment})


def row_hash(columns: list[str], missing: str = "nan") -> Column:
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]))


def standardize(
    df: DataFrame,
    source: str,
    source_uri: str,
    required: list[str],
    numeric: list[str] = (),
    text: list[str] = (),
    critical: list[str] = (),
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
    keys: list[str] | None = None,
    order: str | None = None,
    extracted_at: datetime | None = None,
) -> DataFrame:
    """The standard chain for a landed source."""
    out = coerce_text(coerce_numeric(require_columns(df, required, source), numeric), text)
    if critical:
        out = drop_missing(out, list(critical))
    for column, (low, high) in (ranges or {}).items():
        out = keep_range(out, column, low, high)
    if keys:
        out = dedupe_latest(out, keys, [order] if order else [])
    return add_provenance(out, source_uri, extracted_at)


class ExtractionReport:
    """What a conformed source was read from and what became of its rows; known once an action has run over the conformed rows.

    The counts are observed on the way through that action: nothing is read a second time.
    """

    def __init__(self, source: str, uri: str, extracted_at: datetime, columns: list[str], steps: list[str]):
        self.source, self.uri, self.extracted_at, self.columns, self.steps = source, uri, extracted_at, columns, steps
        self.on_entry, self.on_exit = Observation(), Observation()

    def metrics(self) -> dict[str, int]:
        """Rows read, rows dropped by each step in its order (``missing``, ``range:<column>``, ``duplicate``), missing values of each critical
        column, and rows kept."""
        first, last = self.on_entry.get, self.on_exit.get
        dropped = {step: first[f"s{i}"] for i, step in enumerate(self.steps)}
        dropped["duplicate"] = first["rows"] - sum(dropped.values()) - last["rows"]
        missing = {k: v for k, v in first.items() if k.startswith("missing:")}
        return {"read": first["rows"], **{f"dropped:{k}": v for k, v in dropped.items()}, **missing, "kept": last["rows"]}

    def completeness(self) -> dict[str, float]:
        """Percent of the kept rows that have a value, by column; nothing of no rows."""
        last = self.on_exit.get
        return {c: 100.0 * last[f"c{i}"] / last["rows"] for i, c in enumerate(self.columns) if last["rows"]}

    def document(self) -> str:
        """The report as the JSON document that ``quality.sync_reports`` stores; a conformed source has no repeated keys left."""
        return json.dumps({
            "source": self.source, "uri": self.uri, "rows": self.metrics()["kept"], "columns": len(self.columns), "completeness_pct": self.completeness(),
            "key_duplicates": 0, "extracted_at": self.extracted_at.isoformat(timespec="seconds"), "steps": self.metrics()}, ensure_ascii=False)


def standardize_with_report(
    df: DataFrame,
    source: str,
    source_uri: str,
    required: list[str],
    extracted_at: datetime,
    numeric: list[str] = (),
    text: list[str] = (),
    critical: list[str] = (),
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
    keys: list[str] | None = None,
    order: str | None = None,
) -> tuple[DataFrame, ExtractionReport]:
    """``standardize``, and a report that counts what each step drops.

    A row counts for the first step it fails: a missing critical value, then the ranges in their order (a missing value is out of range, as in
    ``keep_range``), then a later row of the same key.
    """
    out = coerce_text(coerce_numeric(require_columns(df, required, source), numeric), text)
    alive, failed, steps = F.lit(True), [], []
    if critical:
        whole = F.lit(True)
        for c in critical:
            whole = whole & F.col(c).isNotNull()
        alive, steps, failed = whole, ["missing"], [~whole]
    for column, (low, high) in (ranges or {}).items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(column) >= low)
        if high is not None:
            inside = inside & (F.col(column) <= high)
        inside = F.coalesce(inside, F.lit(False))
        steps, failed, alive = [*steps, f"range:{column}"], [*failed, alive & ~inside], alive & inside
    names = [*out.columns, "_source_uri", "_extracted_at"]
    report = ExtractionReport(source, source_uri, extracted_at, names, steps)
    out = out.observe(
        report.on_entry, F.count(F.lit(1)).alias("rows"), *[F.count_if(x).alias(f"s{i}") for i, x in enumerate(failed)],
        *[F.count_if(F.col(c).isNull()).alias(f"missing:{c}") for c in critical]).where(alive)
    if keys:
        out = dedupe_latest(out, keys, [order] if order else [])
    out = add_provenance(out, source_uri, extracted_at)
    return out.observe(report.on_exit, F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)]), report


def validate_prices(df: DataFrame, day: str, market: str, product: str, low: str, high: str, mean: str,
                    ceiling: float = K.MAX_PRICE_KG) -> DataFrame:
    """Keep credible price rows; a minimum or maximum that contradicts the mean becomes missing."""
    kept = df.where(
        F.col(day).isNotNull() & (F.coalesce(F.col(market), F.lit("")) != "")
        & (F.coalesce(F.col(product), F.lit("")) != "") & (F.col(mean) > 0) & (F.col(mean) <= ceiling)
    )
    return kept.withColumns({
        low: F.when((F.col(low) > 0) & (F.col(low) <= F.col(mean)), F.col(low)),
        high: F.when((F.col(high) > 0) & (F.col(high) >= F.col(mean)), F.col(high)),
    })


def exclude_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Drop the listed values; rows without a value stay."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def month_calendar(df: DataFrame, day: str, nino_years: DataFrame | None = None) -> DataFrame:
    """Every month between the first and the last year of the data, with its calendar attributes."""
    span = df.agg(F.year(F.min(day)).alias("lo"), F.year(F.max(day)).alias("hi"))
    months = span.select(F.explode(F.sequence(
        F.make_date("lo", F.lit(1), F.lit(1)), F.make_date("hi", F.lit(12), F.lit(1)), F.expr("interval 1 month"))).alias("month_start"))
    from cropspark.functions import dates as D

    out = months.select(
        "month_start", F.year("month_start").alias("year"), F.month("month_start").alias("month"),
        F.quarter("month_start").alias("quarter"), D.semester(F.month("month_start")).alias("semester"),
        D.month_name_es(F.month("month_start")).alias("month_name"),
    )
    return out if nino_years is None else out.join(nino_years, "year", "left")


def constant_lookup(df: DataFrame, key: str, mapping: dict[str, str], name: str) -> DataFrame:
    """Add the constant a fixed map gives for the key; unknown keys get none."""
    return df.withColumn(name, T._lookup(mapping, F.col(key)))


def melt(df: DataFrame, ids: list[str], names: str, values: str) -> DataFrame:
    columns = [c for c in df.columns if c not in ids]
    return df.unpivot(ids, columns, names, values)


def pivot_readings(df: DataFrame, keys: list[str], sensor: str, kinds: list[str], value: str) -> DataFrame:
    """Readings to one row per key with mean, maximum and minimum per kind (kinds are fixed, so no extra scan)."""
    return df.groupBy(*keys).pivot(sensor, kinds).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))


def conjunction(df: DataFrame, equal: dict | None = None, equal_ci: dict | None = None,
                contains_any: tuple[list[str], str] | None = None, at_most: dict | None = None) -> DataFrame:
    """Filter by the given conditions only: exact, case-insensitive, text found in any column, upper bound."""
    for column, wanted in (equal or {}).items():
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    for column, wanted in (equal_ci or {}).items():
        if wanted is not None:
            df = df.where(F.lower(F.col(column)) == wanted.lower())
    if contains_any and contains_any[1]:
        columns, wanted = contains_any
        found = F.lit(False)
        for column in columns:
            found = found | F.col(column).ilike(f"%{wanted}%")
        df = df.where(found)
    for column, bound in (at_most or {}).items():
        if bound is not None:
            df = df.where(F.col(column) <= bound)
    return df


def cut_covered(older: DataFrame, newer: DataFrame, day: str) -> DataFrame:
    """Rows of the older source before the first day the newer one covers."""
    first = newer.agg(F.min(day)).scalar()
    return older.where(F.col(day) < first)
