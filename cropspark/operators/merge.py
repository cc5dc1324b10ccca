"""Merging new rows into a stored table, on plain files.

Each merge is one full outer join on the key: it yields the new state of every row and what happened to it. Large facts are
partitioned by month and only the touched months are read and rewritten. Small tables are written whole as a new version;
readers take the newest complete one, so a failed job leaves the table as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.operators.ranking import dedupe_latest
from cropspark.session import materialise

INSERTED, CHANGED, SAME, KEPT, REFUSED = "inserted", "changed", "same", "kept", "refused"


def _paired(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))
    new = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys]).alias("_new"))
    condition = None
    for k in keys:  # a missing key part equals a missing key part
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        condition = same if condition is None else condition & same
    joined = old.alias("o").join(new.alias("n"), condition, "full_outer")
    return joined.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], "_old", "_new")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Insert new keys, replace all other columns of known keys. Repeated source keys: the last by ``order`` counts."""
    values = [c for c in target.columns if c not in keys]
    pairs = _paired(target, dedupe_latest(source.select(*target.columns), keys, list(order)), keys)
    state = (F.when(F.col("_old").isNull(), INSERTED).when(F.col("_new").isNull(), KEPT)
             .when(F.col("_old").eqNullSafe(F.col("_new")), SAME).otherwise(CHANGED))
    row = F.coalesce("_new", "_old")
    return pairs.select(*keys, *[row[c].alias(c) for c in values], state.alias("change_type"))


def upsert_by_precedence(target: DataFrame, source: DataFrame, keys: list[str], mean: str, low: str, high: str,
                         origin: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """Upsert in which a row changes only if the new origin ranks at least as high as the stored one.

    A new missing minimum or maximum keeps the stored one; identical rows count as unchanged. Several source rows for one
    key: the highest-ranked origin counts, then the largest row.
    """
    ranks = ranks or K.SOURCE_RANK

    def rank(c: Column) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(0))

    values = [mean, low, high, origin]
    incoming = source.select(*keys, *values).withColumn("_rank", rank(F.col(origin)))
    incoming = dedupe_latest(incoming, keys, ["_rank"]).drop("_rank")
    pairs = _paired(target.select(*keys, *values), incoming, keys)
    old, new = F.col("_old"), F.col("_new")
    merged = F.struct(new[mean].alias(mean), F.coalesce(new[low], old[low]).alias(low),
                      F.coalesce(new[high], old[high]).alias(high), new[origin].alias(origin))
    state = (F.when(old.isNull(), INSERTED).when(new.isNull(), KEPT)
             .when(rank(new[origin]) < rank(old[origin]), REFUSED)
             .when(old.eqNullSafe(merged), SAME).otherwise(CHANGED))
    row = F.when(F.col("change_type").isin(INSERTED, CHANGED), merged).otherwise(old)
    return pairs.withColumn("change_type", state).select(
        *keys, *[row[c].alias(c) for c in values], "change_type")


def fill_missing(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fill missing values of existing rows from a second source; nothing is overwritten and nothing added."""
    filler = dedupe_latest(source.select(*keys, *columns), keys).withColumnsRenamed({c: f"_{c}" for c in columns})
    joined = target.join(filler.withColumn("_match", F.lit(True)), keys, "left")
    others = [c for c in target.columns if c not in keys and c not in columns]
    return joined.select(*keys, *others, *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in columns],
                         F.col("_match").isNotNull().alias("was_matched"))


def fill_dimension(target: DataFrame, source: DataFrame, key: str, fill: str, order: list[str] = ()) -> DataFrame:
    """Add unknown keys; for known ones only a missing attribute is filled, names are never changed."""
    incoming = dedupe_latest(source.select(*target.columns), [key], list(order))
    pairs = _paired(target, incoming, [key])
    others = [c for c in target.columns if c not in (key, fill)]
    old, new = F.col("_old"), F.col("_new")
    return pairs.select(key, *[F.when(old.isNotNull(), old[c]).otherwise(new[c]).alias(c) for c in others],
                        F.coalesce(old[fill], new[fill]).alias(fill))


def latest_attributes(target: DataFrame, source: DataFrame, key: str, columns: list[str], day: str,
                      checked: str, valid: DataFrame) -> DataFrame:
    """Upsert a dimension by name: the latest source row wins, its missing values keep the stored ones, and a code
    unknown to the reference table becomes missing."""
    latest = dedupe_latest(source.select(key, day, *columns), [key], [day])
    codes = valid.select(F.col(checked).alias("_code")).distinct()
    latest = latest.join(codes, F.col(checked) == F.col("_code"), "left").withColumn(checked, F.col("_code"))
    pairs = _paired(target.select(key, *columns), latest.select(key, *columns), [key])
    return pairs.select(key, *[F.coalesce(F.col("_new")[c], F.col("_old")[c]).alias(c) for c in columns])


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def reconcile(target: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Count new, changed, identical and vanished rows of a full snapshot against the stored table."""
    merged = upsert(target, snapshot, keys)
    return change_counts(merged)


def _folder(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the complete versions of a stored table, in order."""
    path, fs = _folder(spark, base)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(marker):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    known = versions(spark, base)
    return spark.read.parquet(f"{base}/version={known[-1]}") if known else None


def write_version(df: DataFrame, base: str, partition_by: list[str] = ()) -> int:
    """Write the table's next version. The old one stays until it is retired, so a plan may read it meanwhile."""
    known = versions(df.sparkSession, base)
    number = (known[-1] + 1) if known else 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{base}/version={number}")
    return number


def replace_partitions(df: DataFrame, path: str, partition_by: list[str], cluster_by: list[str] = ()) -> None:
    """Overwrite only the partitions that occur in ``df``.

    With ``cluster_by`` rows are first ranged by partition and these columns: a task then writes few partitions, a large
    partition is written by several tasks, and files cover narrow key ranges.
    """
    if cluster_by:
        order = [*partition_by, *cluster_by]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)


def merge_touched_partitions(spark: SparkSession, path: str, incoming: DataFrame, partition: str,
                             merge: Callable[[DataFrame, DataFrame], DataFrame], cluster_by: list[str] = ()) -> DataFrame:
    """Merge into a partitioned table, reading only the partitions the new rows fall into and rewriting those that change.

    ``merge(stored, incoming)`` returns the new rows of those partitions with ``change_type``; its result is also returned.
    The new rows are written whole beside the table before any of its files is replaced, and removed after. A run that finds such rows
    first finishes the run that left them, so a break at any point loses nothing. A repeated run finds its rows stored and changes nothing.
    """
    staged = f"{path.rstrip('/')}.staged"
    _apply_staged(spark, staged, path, partition, cluster_by)
    incoming = materialise(incoming)
    if exists(spark, path):
        touched = [r[0] for r in incoming.select(partition).distinct().collect()]  # months: bounded by the calendar
        stored = spark.read.parquet(path).where(F.col(partition).isin(*touched))
    else:
        stored = incoming.limit(0)
    merged = materialise(merge(stored, incoming))
    dirty = [r[0] for r in merged.where(F.col("change_type").isin(INSERTED, CHANGED)).select(partition).distinct().collect()]
    if dirty:
        merged.where(F.col(partition).isin(*dirty)).drop("change_type").write.mode("overwrite").parquet(staged)
        _apply_staged(spark, staged, path, partition, cluster_by)
    return merged


def _apply_staged(spark: SparkSession, staged: str, path: str, partition: str, cluster_by: list[str]) -> None:
    """Replace the table's partitions by complete staged rows, if there are any; doing it again gives the same table."""
    folder, fs = _folder(spark, staged)
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
        replace_partitions(spark.read.parquet(staged), path, [partition], cluster_by)
        spark.catalog.refreshByPath(path)
    if fs.exists(folder):
        fs.delete(folder, True)


def expire_partitions(spark: SparkSession, path: str, partition: str, first_kept: str) -> list[str]:
    """Remove the partition folders whose value, as text, is below the first one to keep; gives the values removed."""
    folder, fs = _folder(spark, path)
    gone = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name, _, value = status.getPath().getName().partition("=")
        if name == partition and value < first_kept:
            fs.delete(status.getPath(), True)
            gone.append(value)
    spark.catalog.refreshByPath(path)
    return sorted(gone)


#: Batch folders that may stand beside the folded rows before they are folded; the newest ones stay, because the engine may write its last batch
#: again. Folders of the fold before last are removed, so a reader that has begun keeps its files, and there are never more than ``MOST_FOLDERS``.
FOLD_EVERY, KEPT_BATCHES = 50, 10
MOST_FOLDERS = 2 * (FOLD_EVERY + KEPT_BATCHES) + 2


def _manifests(spark: SparkSession, base: str) -> list[dict]:
    """What has been folded, oldest first: ``version``, ``folder`` and the last batch it holds (``through``)."""
    folder, fs = _folder(spark, f"{base}/_manifest")
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        if status.getPath().getName().endswith(".json"):
            stream = fs.open(status.getPath())
            found.append(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return sorted(found, key=lambda m: m["version"])


def _publish(spark: SparkSession, base: str, manifest: dict) -> None:
    """Readers see the new manifest from one moment to the next: it is written under another name and renamed."""
    folder, fs = _folder(spark, f"{base}/_manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(folder)
    draft = path(folder, f"{manifest['version']}.draft")
    stream = fs.create(draft, True)
    stream.writeBytes(json.dumps(manifest))
    stream.close()
    fs.rename(draft, path(folder, f"{manifest['version']:09d}.json"))


def _batches(spark: SparkSession, base: str) -> dict[int, str]:
    """Folders of all complete batches by their number."""
    path, fs = _folder(spark, base)
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")] if fs.exists(path) else []
    return {int(p.getName()[6:]): str(p) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def write_batch(df: DataFrame, base: str, batch_id: int, combine: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Rows of one batch in a folder of their own: a batch that comes again replaces itself. Now and then older batches are folded."""
    spark = df.sparkSession
    done = _manifests(spark, base)
    if done and batch_id <= done[-1]["through"]:
        return  # its rows are folded already
    df.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
    through = done[-1]["through"] if done else -1
    if sum(b > through for b in _batches(spark, base)) >= FOLD_EVERY + KEPT_BATCHES:
        fold_batches(spark, base, combine)


def fold_batches(spark: SparkSession, base: str, combine: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Fold all complete batches but the newest ``KEPT_BATCHES`` into one base folder.

    ``combine`` reduces the rows of several batches to rows that stand for them (sums, or the last of each key); it keeps ``batch``, the last batch
    a row stands for. The base is written whole, then a manifest names it, then what the manifest before the last named is removed. A run that
    breaks off leaves the manifest before it, under which all rows are still there, and the next run does the work again.
    """
    done, batches = _manifests(spark, base), _batches(spark, base)
    last = done[-1] if done else {"version": 0, "folder": None, "through": -1}
    waiting = sorted(b for b in batches if b > last["through"])[:-KEPT_BATCHES]
    if not waiting:
        return
    rows = _rows_of(spark, base, last["folder"], [batches[b] for b in waiting])
    folder = f"{base}/folded-{last['version'] + 1}"
    (combine(rows) if combine else rows).write.mode("overwrite").parquet(folder)
    _publish(spark, base, {"version": last["version"] + 1, "folder": folder, "through": waiting[-1]})
    path, fs = _folder(spark, base)
    gone = [m["folder"] for m in done[:-1]] + [p for b, p in batches.items() if b <= last["through"]]
    for name in [*gone, *[f"{base}/_manifest/{m['version']:09d}.json" for m in done[:-1]]]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), True)


def _rows_of(spark: SparkSession, base: str, folder: str | None, batches: list[str]) -> DataFrame | None:
    parts = [spark.read.parquet(folder)] if folder else []
    parts += [spark.read.option("basePath", base).parquet(*batches).withColumn("batch", F.col("batch").cast("long"))] if batches else []
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def read_batches(spark: SparkSession, base: str) -> DataFrame | None:
    """Rows of all complete batches with ``batch``; None before the first. The manifest says which are folded; later ones are read beside."""
    done = _manifests(spark, base)
    last = done[-1] if done else {"folder": None, "through": -1}
    return _rows_of(spark, base, last["folder"], [p for b, p in sorted(_batches(spark, base).items()) if b > last["through"]])


def retain_since(df: DataFrame, moment: str, now: Column, days: int) -> DataFrame:
    """Rows not older than the retention span."""
    return df.where(F.col(moment) >= now - F.make_dt_interval(F.lit(days)))


def append_model_version(registry: DataFrame, name: str, metrics: Column, trained_at: Column) -> DataFrame:
    """One new registry row; the active version is the latest per name, so no stored row has to change."""
    top = registry.agg(F.coalesce(F.max("id_version"), F.lit(0)).alias("t"))
    new = top.select((F.col("t") + 1).cast("long").alias("id_version"), F.lit(name).alias("model_name"),
                     trained_at.alias("trained_at"), metrics.alias("metrics_json"))
    return registry.select("id_version", "model_name", "trained_at", "metrics_json").unionByName(new)


def active_versions(registry: DataFrame) -> DataFrame:
    from cropspark.operators.ranking import latest_per_key

    return latest_per_key(registry, ["model_name"], ["id_version"])
