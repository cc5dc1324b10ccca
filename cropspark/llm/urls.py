"""URL filter with a cascade of Bloom filters.

Level 1 holds the listed keys; level 2 those keys of the corpus that level 1 wrongly lets through; level 3 the listed ones that level 2
wrongly holds back, and so on until a level makes no mistake. Over the keys the levels were built on, all keys of the corpus, the answer is
exact, and asking is arithmetic on a constant array in the scan itself: no join, no shuffle of pages.

Everything is DataFrame functions. A filter is summed on the executors (bit_or by word); its words, ``BITS`` bits for each listed key, come to
the driver as a constant. That is done for at most ``MOST_LISTED`` keys; a longer list is looked up by a join instead, with equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import written

#: Bits and hashes for each key, on the first level and on the others.
BITS, HASHES = (10, 4), (5, 3)
MOST_LISTED = 500_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    bits: int
    hashes: int
    number: int
    words: list[int] = field(default_factory=list)

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        place = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        words = place.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect()  # bits / 64 rows at most
        found = {r["w"]: r["v"] for r in words}
        self.words = [found.get(w, 0) for w in range(self.bits // 64)]
        return self

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded into one constant
        tests = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in self.places(key)]
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found


class Cascade:
    """Exact membership of the keys of ``universe`` in ``listed`` (both with a column ``key``)."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        inside = written(universe.join(listed.distinct(), "key", "left_semi").distinct())
        outside = universe.join(inside, "key", "left_anti").distinct()
        self.levels: list[Level] = []
        n = inside.count()
        while n:
            k = 1 if self.levels else 0
            bits = -(-max(64, n * BITS[k]) // 64) * 64
            level = Level(bits, HASHES[k], len(self.levels)).fill(inside)
            self.levels.append(level)
            inside, outside = written(outside.filter(level.holds(F.col("key")))), inside
            n = inside.count()

    def holds(self, key: Column) -> Column:
        found = None
        for level in reversed(self.levels):
            found = level.holds(key) if found is None else level.holds(key) & ~found
        return F.lit(False) if found is None else found


def _candidates(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Keys of all rules that could fit: ends of the host with as many labels as a rule has, starts of the path as long as a rule's."""
    labels, out = F.split(host, r"\."), []
    depths, sizes = sorted({r[0].count(".") + 1 for r in rules}), sorted({len(r[1]) for r in rules})
    for n in depths:
        end = F.array_join(F.slice(labels, -n, n), ".")
        out += [F.when((F.size(labels) >= n) & (F.length(path) >= size), F.concat(end, F.substring(path, 1, size))) for size in sizes]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def alias_urls(pages: DataFrame) -> DataFrame:
    """Urls (column ``key``) that lead to a host and path which a shorter url of the corpus, or one first in order of text, has, too."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.concat(host, path).alias("place"), F.col("url").alias("key")).filter("place <> ''").distinct()
    first = seen.groupBy("place").agg(F.min(F.struct(F.length("key").alias("n"), F.col("key").alias("first"))).alias("f"), F.count("*").alias("many")).filter("many > 1")
    return seen.join(first, "place").filter(F.col("key") != F.col("f.first")).select("key")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    A rule ``(host, path, verdict)`` fits its host and all subdomains where the path begins with the rule's; the longest wins (of equally
    long ones the last in order of text). Without a rule the verdict is ``block`` if the url is among ``listed``, by default those of
    ``alias_urls``, so that one url of each host and path stays, else ``allow``. A missing url, or one without ``://``, has an empty host and path, no rule and is allowed.
    Pages are judged one by one; repeated rows give repeated results.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("url").alias("key"))
    parsed = parsed.withColumn("keys", _candidates(F.col("host"), F.col("path"), rules))
    spark = pages.sparkSession
    spans = parsed.select(F.explode("keys").alias("key")).distinct()
    known = {v: Cascade(spans, spark.createDataFrame([(h + p,) for h, p, w in rules if w == v], "key string")) for v in ("allow", "block")}
    fits = F.filter("keys", lambda k: known["allow"].holds(k) | known["block"].holds(k))
    rule = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    parsed = parsed.withColumn("rule", rule)
    listed = (alias_urls(pages) if listed is None else listed).select("key").distinct()
    if listed.count() <= MOST_LISTED:
        blocked = Cascade(parsed.filter("key IS NOT NULL").select("key").distinct(), listed).holds(F.col("key"))
    else:
        parsed = parsed.join(listed.withColumn("_listed", F.lit(True)), "key", "left")
        blocked = F.col("_listed").isNotNull()
    verdict = F.when(F.col("rule").isNull(), F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")).when(known["allow"].holds(F.col("rule")), "allow").otherwise("block")
    return parsed.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


ORACLE_SQL = f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parsed AS (
  SELECT page_id, url, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM parsed
), numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY host || path ORDER BY length(url), url) AS n FROM ruled
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path <> '' AND n > 1 THEN 'block' ELSE 'allow' END AS verdict
FROM numbered
"""
