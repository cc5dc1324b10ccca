"""Joins beyond the plain equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import numeric as N
from cropspark.functions import text as T
from cropspark.operators.ranking import dedupe_latest
from cropspark.session import materialise


def split_by_reference(df: DataFrame, reference: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose code exists in the reference, and the rejects (a missing code is a reject)."""
    codes = reference.select(column).distinct()
    return df.join(codes, column, "left_semi"), df.join(codes, column, "left_anti")


def reject_counts(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Accepted and rejected rows in one pass. Rows are counted per code first, so a hot code shuffles as one row."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    known = reference.select(column).distinct().withColumn("_known", F.lit(True))
    return counts.join(known, column, "left").agg(
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("rejected"))


def expand_over(df: DataFrame, values: list, name: str) -> DataFrame:
    """Every row once per value of a short fixed list (an explode, no join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def expand_over_table(df: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Every row once per row of a dimension of any size: an equi-join on a block number.

    Rows are spread over as many blocks as there are shuffle partitions, by a hash of all they hold; the dimension is copied into each
    block. It stays a frame, and Spark broadcasts it only if it is small enough.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = df.withColumn("_block", F.pmod(F.xxhash64(*df.columns), F.lit(blocks)))
    right = table.select(*columns).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return left.join(right, "_block").select(*df.columns, *columns)


def resolve_names(df: DataFrame, name: str, towns: DataFrame, town_name: str, code: str,
                  synonyms: DataFrame | dict[str, str] | None = None, town_code: str | None = None) -> DataFrame:
    """Code of a free-text place name: the official list first, then synonyms. A repeated name takes its last code. ``town_code`` names the
    list's column where it differs from ``code``."""
    keyed = df.withColumn("_key", T.normalise_text(F.col(name)))
    official = towns.select(T.normalise_text(F.col(town_name)).alias("_key"), F.col(town_code or code).cast("string").alias("_official"))
    official = dedupe_latest(official.where(F.col("_key") != ""), ["_key"], ["_official"])
    out = keyed.join(official, "_key", "left")
    synonyms = K.TOWN_SYNONYMS if synonyms is None else synonyms
    if isinstance(synonyms, dict):
        plain = {T_key(k): v for k, v in synonyms.items()}
        fallback = T._lookup(plain, F.col("_key"))
        return out.withColumn(code, F.coalesce("_official", fallback)).drop("_key", "_official")
    extra = synonyms.select(T.normalise_text(F.col("synonym")).alias("_key"), F.col("code").alias("_synonym"))
    extra = dedupe_latest(extra, ["_key"], ["_synonym"])
    return out.join(extra, "_key", "left").withColumn(code, F.coalesce("_official", "_synonym")).drop(
        "_key", "_official", "_synonym")


def T_key(name: str) -> str:
    return name.lower().split("(")[0].strip().translate(str.maketrans(T.ACCENTED, T.PLAIN))


def shifted_lookup(df: DataFrame, keys: list[str], position: str, columns: list[str], back: int, suffix: str) -> DataFrame:
    """Columns of the same key exactly ``back`` steps earlier, by a self-join on the shifted key."""
    earlier = df.select(*keys, (F.col(position) + back).alias(position), *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return df.join(earlier, [*keys, position], "left")


#: Cell widths of the centre tree in degrees, each a quarter of the one before; altitude is cut as well from the third on, where it costs as much.
CELLS = tuple(45.0 / 4**k for k in range(8))
_FLAT = 2
#: A cell with so few centres is not split further.
FEW = 8


def _cost(p: str, c: str) -> tuple[Column, Column, Column]:
    """Penalised distance (great circle plus 0.1 km per metre of altitude difference; a missing altitude costs nothing), distance and climb."""
    distance = N.haversine_km(F.col(f"{p}.lat"), F.col(f"{p}.lon"), F.col(f"{c}.lat"), F.col(f"{c}.lon"))
    climb = F.abs(F.col(f"{c}.alt") - F.col(f"{p}.alt"))
    return distance + F.coalesce(climb, F.lit(0.0)) * K.ALTITUDE_KM_PER_M, distance, climb


def _on_sphere(df: DataFrame) -> DataFrame:
    """Latitude within 90 and longitude within 180 degrees of the same point, whatever multiples the data hold."""
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(F.radians("lat"))))))
    beyond = F.cos(F.radians("lat")) < 0
    return df.withColumns({"_lat": lat, "_lon": F.pmod(F.col("lon") + F.when(beyond, 360.0).otherwise(180.0), F.lit(360.0)) - 180})


def _cell(level: int | Column) -> dict[str, Column]:
    """Number of the cell at a level; finest numbers are shifted, so that cells nest exactly. Missing altitudes have cells of their own."""
    finest, last = CELLS[-1], len(CELLS) - 1
    shift = 2 * (F.lit(last) - level)
    up = lambda c: F.floor(c / F.pow(F.lit(2.0), shift)).cast("long")
    high = F.when(level < _FLAT, F.lit(0)).otherwise(up(F.floor(F.col("alt") / (finest * _KM_A_DEGREE / K.ALTITUDE_KM_PER_M))))
    return {"_y": up(F.floor(F.col("_lat") / finest)), "_x": up(F.floor((F.col("_lon") + 180) / finest)),
            "_z": F.when(F.col("alt").isNull(), F.lit(None).cast("long")).otherwise(high)}


_KM_A_DEGREE = N.EARTH_RADIUS_KM * 3.141592653589793 / 180


def nearest_centre(points: DataFrame, centres: DataFrame, point_id: str, centre_id: str) -> DataFrame:
    """Centre with the least penalised distance of each point; exact, ties go to the smaller id. The distance returned is the unpenalised one.

    Both sides carry lat, lon, alt; points at one place are one search, centres at one place one centre. The centres form a tree of nested cells of
    latitude, longitude and altitude that is as deep as the densest of them asks for (``FEW``). A place goes down it level by level: of the cells
    that are still open it keeps those whose box may be nearer than the nearest known centre (each cell knows one of its own). So a dense cell
    is split until it holds few centres, a place far from all centres looks at few cells as well, and no cell is ever all pairs. The upper two levels
    have at most 2 x 32 and 2 x 512 cells and are broadcast; below, cells and places meet in joins on the cell.
    """
    place = ["lat", "lon", "alt"]
    has_place = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    placed = points.where(has_place)
    targets = materialise(_on_sphere(centres.where(has_place).groupBy(*place).agg(F.min(centre_id).alias(centre_id))))
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(CELLS) - 1))).alias("_level")
    key = ["_y", "_x", "_z"]
    box = [f(c).alias(f"{c}_{n}") for c in ("_lat", "_lon", "alt") for n, f in (("low", F.min), ("high", F.max))]
    cells = materialise(
        targets.select("*", levels).withColumns(_cell(F.col("_level"))).groupBy("_level", *key)
        .agg(*box, F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*place), centre_id).alias("c")))
    most = dict(cells.groupBy("_level").agg(F.max("n")).collect())  # a row for each level
    if not most:
        return points.select(point_id, F.lit(None).cast(centres.schema[centre_id].dataType).alias(centre_id), F.lit(None).cast("double").alias("distance_km"), F.lit("unresolved").alias("method"))
    depth = next((level for level in sorted(most) if most[level] <= FEW), len(CELLS) - 1)
    open_ = _on_sphere(placed.select(*place).distinct()).withColumns({"_id": F.struct(*place)}).select(F.struct(*place, "_lat", "_lon", "_id").alias("p"), F.lit(0).cast("long").alias("_up_y"), F.lit(0).cast("long").alias("_up_x"), F.lit(0).cast("long").alias("_up_z"))
    none = F.lit(-(1 << 40))  # cells of missing altitudes are below those of missing altitudes only
    for level in range(depth + 1):
        above = {"_up_y": F.floor(F.col("_y") / 4), "_up_x": F.floor(F.col("_x") / 4), "_up_z": F.when(F.col("_z").isNull(), none).otherwise(F.lit(0) if level <= _FLAT else F.floor(F.col("_z") / 4))}
        if level == 0:
            above = dict.fromkeys(above, F.lit(0).cast("long"))
        here = cells.where(F.col("_level") == level).withColumns(above)
        pairs = open_.join(F.broadcast(here) if level < _FLAT else here, ["_up_y", "_up_x", "_up_z"])
        # No centre of a box is nearer than its latitudes, its longitudes (as the nearest meridian, or the pole) and its altitudes allow.
        over = F.greatest(F.lit(0.0), F.col("_lat_low") - F.col("p._lat"), F.col("p._lat") - F.col("_lat_high"))
        east, west = F.pmod(F.col("_lon_low") - F.col("p._lon"), F.lit(360.0)), F.pmod(F.col("p._lon") - F.col("_lon_high"), F.lit(360.0))
        aside = F.when(F.col("p._lon").between(F.col("_lon_low"), F.col("_lon_high")), 0.0).otherwise(F.least(east, west, F.lit(90.0)))
        meridian = F.degrees(F.asin(F.cos(F.radians("p._lat")) * F.sin(F.radians(aside))))
        climb = F.greatest(F.lit(0.0), F.col("alt_low") - F.col("p.alt"), F.col("p.alt") - F.col("alt_high"))
        climb = F.when(F.col("alt_low").isNull() | F.col("p.alt").isNull(), 0.0).otherwise(climb)
        least = F.greatest(over, meridian) * _KM_A_DEGREE + climb * K.ALTITUDE_KM_PER_M
        judged = pairs.select("p", *key, least.alias("_least"), _cost("p", "c")[0].alias("_known"))
        by_place = Window.partitionBy("p._id")
        kept = judged.withColumn("_best", F.min("_known").over(by_place)).where(F.col("_least") * (1 - 1e-9) - 1e-6 <= F.col("_best"))
        open_ = kept.select("p", F.col("_y").alias("_up_y"), F.col("_x").alias("_up_x"), F.coalesce("_z", none).alias("_up_z"))
    leaves = targets.withColumns(_cell(F.lit(depth))).select(F.struct(centre_id, *place).alias("c"), F.col("_y").alias("_up_y"), F.col("_x").alias("_up_x"), F.coalesce("_z", none).alias("_up_z"))
    cost, km, climb = _cost("p", "c")
    choice = F.struct(cost.alias("cost"), F.col(f"c.{centre_id}").alias(centre_id), km.alias("km"), climb.alias("climb"))
    best = open_.join(leaves, ["_up_y", "_up_x", "_up_z"]).groupBy(F.col("p._id").alias("_id")).agg(F.min(choice).alias("_best"))
    found = placed.select(point_id, F.struct(*place).alias("_id")).join(best, "_id").select(point_id, "_best")
    climb = F.coalesce(F.col("_best.climb"), F.lit(0.0))
    inside = (F.col("_best.km") <= K.JOIN_RADIUS_KM) & (climb <= K.JOIN_MAX_ALTITUDE_M)
    return points.select(point_id).join(found, point_id, "left").select(
        point_id, F.col(f"_best.{centre_id}").alias(centre_id), F.col("_best.km").alias("distance_km"),
        F.when(F.col("_best").isNull(), "unresolved").when(inside, "within_radius_and_altitude")
        .otherwise("nearest_outside").alias("method"))


def assign_centres(points: DataFrame, centres: DataFrame, point_id: str, centre_id: str, point_name: str, centre_name: str,
                   synonyms: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """``nearest_centre``; a point without coordinates is looked up by its name instead (method ``text``), and stays unresolved if nothing has it.

    Only the points without coordinates take part in the look-up, and each name once.
    """
    near = nearest_centre(points, centres, point_id, centre_id)
    lost = near.where(F.col("method") == "unresolved").select(point_id)
    names = points.join(lost, point_id, "left_semi").select(point_id, F.col(point_name).alias("_name"))
    codes = resolve_names(names.select("_name").where(F.col("_name").isNotNull()).distinct(), "_name", centres, centre_name, "_code", synonyms, centre_id)
    named = names.join(codes.where(F.col("_code").isNotNull()), "_name").select(point_id, F.col("_code").cast(centres.schema[centre_id].dataType).alias("_code"))
    return near.join(named.dropDuplicates([point_id]), point_id, "left").select(
        point_id, F.coalesce(centre_id, "_code").alias(centre_id), "distance_km",
        F.when((F.col("method") == "unresolved") & F.col("_code").isNotNull(), "text").otherwise(F.col("method")).alias("method"))
