"""Landed documents to rows. Each parser takes a frame with the document in a text column, so any reader can feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.functions import dates as D
from cropspark.functions import numeric as N
from cropspark.functions import rules as R
from cropspark.functions import text as T
from cropspark.operators import conform as C
from cropspark import constants as K

PRICE_FIELDS = ["artiNombre", "grupNombre", "deptNombre", "muniId", "muniNombre", "fuenNombre", "enmaFecha", "minimoKg",
                "maximoKg", "promedioKg"]

# --- fixed values: parameter names of the daily grid and station services, input sub-groups ------------------------
GRID_PARAMETERS = {"T2M": "temp_mean", "T2M_MAX": "temp_max", "T2M_MIN": "temp_min", "PRECTOTCORR": "rain_mm",
                   "RH2M": "humidity", "ALLSKY_SFC_SW_DWN": "radiation"}
GRID_SENTINEL = -900
DAILY_VARIABLES = {"temperature_2m_mean": "temp_mean", "temperature_2m_max": "temp_max", "temperature_2m_min": "temp_min",
                   "relative_humidity_2m_mean": "humidity", "sunshine_duration": "sunshine_s"}
CROP_STATISTICS = {"Area": "country", "Item": "crop", "Item Code": "item_code", "Element": "element",
                   "Element Code": "element_code", "Year": "year", "Unit": "unit", "Value": "value", "Flag": "flag"}
INPUT_SUBGROUPS = {
    "fertilizantes, enmiendas y acondicionadores de suelo": "fertilizante", "fungicidas": "agroquimico",
    "herbicidas": "agroquimico", "insecticidas, acaricidas y nematicidas": "agroquimico",
    "insecticidas, plaguicidas y repelentes": "agroquimico",
    "coadyuvantes, molusquicidas, reguladores fisiológicos y otros": "agroquimico", "material de propagación": "semilla",
    "bioinsumos": "bioinsumo", "elementos agropecuarios": "otros", "empaques agropecuarios": "otros",
}


def price_records(df: DataFrame, xml: str, since: str | None = None) -> DataFrame:
    """One XML ``return`` record per row to its ten text fields; rows before the day are dropped."""
    schema = ", ".join(f"{f} STRING" for f in PRICE_FIELDS)
    rows = df.select(F.from_xml(F.col(xml), schema).alias("r")).select("r.*")
    return since_day(rows, since)


def since_day(rows: DataFrame, since: str | None) -> DataFrame:
    return rows if since is None else rows.where(F.substring("enmaFecha", 1, 10) >= since)


def index_lines(df: DataFrame, line: str = "value", first_year: int = 2000, last_year: int | None = None) -> DataFrame:
    """Whitespace-delimited lines ``YR MON TOTAL CLIM ANOM`` to months with index and phase. The header does not parse."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    rows = df.select(F.get(parts, 0).try_cast("int").alias("year"), F.get(parts, 1).try_cast("int").alias("month"),
                     F.get(parts, 4).try_cast("double").alias("oni"))
    rows = C.keep_range(rows.where(F.col("month").between(1, 12)), "year", first_year, last_year)
    return rows.withColumn("phase", R.enso_phase(F.col("oni")))


def grid_days(df: DataFrame, ids: list[str], document: str) -> DataFrame:
    """``{parameter: {YYYYMMDD: value}}`` to one row per day; the sentinel is missing."""
    series = F.from_json(F.get_json_object(document, "$.properties.parameter"), "MAP<STRING, MAP<STRING, DOUBLE>>")
    days = F.array_distinct(F.flatten(F.transform(F.map_values("_s"), lambda m: F.map_keys(m))))
    rows = df.select(*ids, series.alias("_s")).select(*ids, "_s", F.explode(days).alias("_d"))
    values = [
        N.sentinel_to_null(F.try_element_at(F.try_element_at(F.col("_s"), F.lit(p)), F.col("_d")), GRID_SENTINEL).alias(c)
        for p, c in GRID_PARAMETERS.items()]
    return rows.select(*ids, F.try_to_date("_d", "yyyyMMdd").alias("day"), *values)


def station_days(df: DataFrame, ids: list[str], document: str) -> DataFrame:
    """``{"daily": {"time": [...], variable: [...]}}`` to one row per day."""
    fields = ", ".join(f"{v}: ARRAY<DOUBLE>" for v in DAILY_VARIABLES)
    daily = F.from_json(F.get_json_object(document, "$.daily"), f"STRUCT<time: ARRAY<STRING>, {fields}>")
    none = F.array().cast("array<double>")  # a variable the document lacks
    columns = [F.col("d.time").alias("time"), *[F.coalesce(F.col(f"d.{v}"), none).alias(v) for v in DAILY_VARIABLES]]
    rows = df.select(*ids, daily.alias("d")).select(*ids, *columns).select(
        *ids, F.explode(F.arrays_zip("time", *DAILY_VARIABLES)).alias("r"))
    return rows.select(*ids, F.try_to_date("r.time", "yyyy-MM-dd").alias("day"),
                       *[F.col(f"r.{v}").alias(c) for v, c in DAILY_VARIABLES.items()])


def indicator_values(df: DataFrame, document: str, alias: str | None = None) -> DataFrame:
    """``[meta, [rows]]`` of one indicator to long rows."""
    row = "STRUCT<indicator: STRUCT<id: STRING, value: STRING>, date: STRING, value: DOUBLE>"
    rows = F.from_json(F.get_json_object(document, "$[1]"), f"ARRAY<{row}>")
    out = df.select(*([alias] if alias else []), F.explode(rows).alias("r"))
    return out.select(*([alias] if alias else []), F.col("r.indicator.id").alias("indicator_id"),
                      F.col("r.indicator.value").alias("indicator_name"), F.col("r.date").try_cast("int").alias("year"),
                      F.col("r.value").alias("value"))


def crop_statistics(df: DataFrame, document: str) -> DataFrame:
    """``{"data": [...]}`` with the service's column titles renamed."""
    fields = ", ".join(f"`{c}`: STRING" for c in CROP_STATISTICS)
    rows = F.from_json(F.col(document), f"STRUCT<data: ARRAY<STRUCT<{fields}>>>")
    out = df.select(F.explode(rows["data"]).alias("r")).select("r.*").withColumnsRenamed(CROP_STATISTICS)
    return C.coerce_numeric(out, ["year", "value"])


def layer_attributes(df: DataFrame, document: str, crop: Column) -> DataFrame:
    """``{"features": [{"attributes": {...}}]}`` of one crop's layer to suitability rows."""
    rows = F.from_json(F.col(document), "STRUCT<features: ARRAY<STRUCT<attributes: STRUCT<cod_dane_mpio: STRING, aptitud: STRING>>>>")
    out = df.select(crop.alias("crop"), F.explode(rows["features"]).alias("r"))
    return out.select(T.zero_pad(F.col("r.attributes.cod_dane_mpio"), 5).alias("town_id"), "crop",
                      F.regexp_replace("r.attributes.aptitud", "Exclusi.n", "Exclusion").alias("suitability"))


def bulletin_to_long(cells: DataFrame) -> DataFrame:
    """Crosstab bulletins (file, row from 0, cells) to day, market, product, price.

    Row 1 holds the date, row 2 the market in every second column, rows from 4 on the products. Cells that are no number
    (n.d., category and note rows) give no row. One bulletin is a page; each file's header meets only its own rows. Spark takes
    exploded cells for no more than their rows, so its size check would send millions of them through the driver: hence the hint.
    """
    head = cells.groupBy("file").agg(
        F.max(F.when(F.col("row") == 1, F.get("cells", F.lit(0)))).alias("title"),
        F.max(F.when(F.col("row") == 2, F.col("cells"))).alias("markets"))
    body = cells.where(F.col("row") >= 4).select("file", F.get("cells", F.lit(0)).alias("product"), F.posexplode("cells").alias("col", "cell"))
    rows = body.where((F.col("col") % 2 == 1) & F.col("product").isNotNull()).join(head.hint("merge"), "file")
    return rows.select(D.parse_spanish_date(F.col("title")).alias("day"), F.get("markets", F.col("col")).alias("market"),
                       "product", N.clean_number(F.col("cell")).alias("price")).where(
        F.col("price").isNotNull() & F.col("market").isNotNull())


def land_use(cells: DataFrame, census_year: int) -> DataFrame:
    """Fixed-position sheet: rows with a valid five-digit code in position 2, areas in positions 4 to 7."""
    names = ["pasture_ha", "fallow_ha", "agricultural_ha", "infrastructure_ha"]
    code = T.valid_code(F.get("cells", F.lit(2)))
    return cells.where(code.isNotNull()).select(
        code.alias("town_id"), F.lit(census_year).alias("census_year"),
        *[N.clean_number(F.get("cells", F.lit(4 + i))).alias(n) for i, n in enumerate(names)])


def input_series(cells: DataFrame) -> DataFrame:
    """Sheets of input-price series (file, row, cells) to monthly rows.

    The first ten rows hold the sub-group title, the first fifteen the heading row that starts with 'Año'; sheets of other
    sub-groups (livestock) are dropped, columns are found by their heading.
    """
    first = F.trim(F.get("cells", F.lit(0)))
    title = F.when((F.col("row") < 10) & first.rlike(r"^\d+\.\d+\."), F.regexp_replace(first, r"^\d+\.\d+\.\s*", ""))
    heading = (F.col("row") < 15) & (F.lower(first) == "año")
    sheets = cells.groupBy("file").agg(
        F.min_by(title, F.when(title.isNotNull(), F.col("row"))).alias("subgroup"),
        F.min(F.when(heading, F.col("row"))).alias("head_row"),
        F.min_by(F.transform("cells", lambda c: F.trim(c)), F.when(heading, F.col("row"))).alias("heads"))
    kinds = F.create_map(*[F.lit(x) for kv in INPUT_SUBGROUPS.items() for x in kv])
    sheets = sheets.withColumn("kind", F.try_element_at(kinds, F.lower(F.trim("subgroup")))).where(F.col("kind").isNotNull())

    def cell(*names: str) -> Column:
        position = F.coalesce(*[F.nullif(F.array_position("heads", n), F.lit(0)) for n in names])
        return F.get("cells", (position - 1).cast("int"))

    rows = cells.join(sheets, "file").where(F.col("row") > F.col("head_row"))
    months = F.array(*[F.lit(m.lower()) for m in K.MONTH_NAMES_ES])
    month = F.nullif(F.array_position(months, F.lower(F.trim(cell("Mes")))), F.lit(0))
    out = rows.select(
        "file", cell("Año").try_cast("int").alias("year"), month.cast("int").alias("month"),
        T.zero_pad(F.regexp_extract(cell("Código departamento"), r"(\d+)", 1), 2).alias("department_id"), "subgroup", "kind",
        N.clean_number(cell("Precio promedio departamento", "Precio promedio")).alias("price"))
    return C.constant_lookup(out.where(F.col("price") > 0).dropna(subset=["year", "month"]), "department_id", K.DEPARTMENT_REGION, "region")


def input_means(rows: DataFrame) -> DataFrame:
    """Mean price per month, region, kind and sub-group."""
    return rows.where(F.col("region").isNotNull()).groupBy("year", "month", "region", "kind", "subgroup").agg(F.avg("price").alias("price"))


def number_rows(df: DataFrame, file: str = "_file", order: str = "_order", page_break: str | None = None) -> DataFrame:
    """Row number within a landed sheet. A sheet is read whole by one task, so its order is the file's order.

    With ``page_break`` a file holds sheets one below the other: a row of that cell alone begins the next sheet and belongs to none, and
    ``file`` is ``<file>#<n>`` for the n-th sheet from 1 (0 for rows before the first break).
    """
    by_file = Window.partitionBy(file).orderBy(order)
    cells = [c for c in df.columns if c not in (file, order)]
    name = F.col(file)
    if page_break is not None:
        begins = (F.col(cells[0]) == page_break) & F.coalesce(*cells[1:], F.lit(None).cast("string")).isNull()
        df = df.withColumn("_begins", F.coalesce(begins, F.lit(False)))
        df = df.withColumn("_page", F.count_if("_begins").over(by_file)).where(~F.col("_begins"))
        by_file, name = Window.partitionBy(file, "_page").orderBy(order), F.concat_ws("#", file, "_page")
    return df.select(name.alias("file"), (F.row_number().over(by_file) - 1).alias("row"), F.array(*cells).alias("cells"))
