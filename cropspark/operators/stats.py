"""Comparison of groups: Welch, Levene, Kruskal-Wallis, Mann-Whitney with Holm.

Everything is sums over groups and distinct values, so samples of any size stay distributed. ``by`` names the comparison a
row belongs to (at least one column), so several comparisons run in one plan. Tail probabilities are column expressions, too: continued fractions
and series, folded over a sequence of terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.functions import rules as R
from cropspark.operators.ranks import OrderedRanges, average_rank, below_of_counts, exact_quantiles, rows_below
from cropspark.session import materialise

MIN_PER_GROUP = 3


def independent_units(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One mean per key combination: the unit that may be compared."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(value))


def valid_groups(df: DataFrame, by: list[str], group: str, value: str, at_least: int = MIN_PER_GROUP) -> DataFrame:
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"))
    keep = sizes.where(F.col("_n") >= at_least).drop("_n")
    return df.where(F.col(value).isNotNull()).join(keep, [*by, group], "left_semi")


def _one_way(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Classic F on a value column, for Levene."""
    groups = df.groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    n, m = F.col("n"), F.col("m")
    between = F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)
    within = F.sum((n - 1) * F.col("v"))
    k = F.count(F.lit(1))
    return groups.groupBy(*by).agg(
        (between / (k - 1) / F.nullif(within / (F.sum(n) - k), F.lit(0.0))).alias("levene_w"),
        (k - 1).alias("levene_df1"), (F.sum(n) - k).alias("levene_df2"))


def welch_anova(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Welch's F with its degrees of freedom, and eta squared, from size, mean and variance per group."""
    groups = (
        df.where(F.col(value).isNotNull()).groupBy(*by, group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
        .where(F.col("n") >= MIN_PER_GROUP)
    )
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    w = n / F.nullif(v, F.lit(0.0))
    sums = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n_total"), F.sum(w).alias("w"), F.sum(w * m).alias("wm"),
        F.sum(w * m * m).alias("wmm"), F.sum(1 / (n - 1)).alias("a"), F.sum(w / (n - 1)).alias("aw"),
        F.sum(w * w / (n - 1)).alias("aww"), F.sum(n * m).alias("nm"), F.sum(n * m * m).alias("nmm"),
        F.sum((n - 1) * v).alias("within"))
    k, W = F.col("k"), F.col("w")
    spread = F.col("a") - 2 * F.col("aw") / W + F.col("aww") / (W * W)
    numerator = (F.col("wmm") - F.col("wm") * F.col("wm") / W) / (k - 1)
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n_total")
    f_value = numerator / (1 + 2 * (k - 2) / (k * k - 1) * spread)
    too_few = F.raise_error(F.lit("at least 2 groups with enough values are needed"))
    return sums.select(
        *by, F.when(k >= 2, k).otherwise(too_few.cast("long")).alias("n_groups"), "n_total", f_value.alias("welch_f"),
        (k - 1).cast("double").alias("welch_df1"), ((k * k - 1) / (3 * spread)).alias("welch_df2"),
        (between / F.nullif(between + F.col("within"), F.lit(0.0))).alias("eta2"))


def levene(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Levene's W on absolute deviations from the exact group median."""
    kept = materialise(valid_groups(df, by, group, value).select(*by, group, value))
    medians = exact_quantiles(kept, [*by, group], value, {"_median": 0.5}).drop("n_values")
    deviations = kept.join(medians, [*by, group]).withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    return _one_way(deviations, by, group, "_dev")


def kruskal(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, and epsilon squared."""
    kept = materialise(valid_groups(df, by, group, value).select(*by, group, value))
    ranked = rows_below(kept, by, value)
    ties = ranked.groupBy(*by).agg(F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"), F.max("total").alias("N"))
    per_value = kept.groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("c"))
    ranks = ranked.select(*by, value, average_rank().alias("r"))
    sums = (per_value.join(ranks, [*by, value]).groupBy(*by, group)
            .agg(F.sum(F.col("c") * F.col("r")).alias("R"), F.sum("c").alias("n")))
    total = sums.groupBy(*by).agg(F.sum(F.col("R") * F.col("R") / F.col("n")).alias("S"), F.count(F.lit(1)).alias("k"))
    joined = total.join(ties, by)
    N = F.col("N").cast("double")
    raw = 12 / (N * (N + 1)) * F.col("S") - 3 * (N + 1)
    h = raw / F.nullif(1 - F.col("ties") / (N * N * N - N), F.lit(0.0))
    return joined.select(*by, h.alias("kruskal_h"), (F.col("k") - 1).alias("kruskal_df"),
                         (h * (N + 1) / (N * N - 1)).alias("epsilon2"))


def mann_whitney(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Two-sided Mann-Whitney U and z (continuity and tie corrected) for every pair of factor levels.

    By definition the result has all pairs of levels. Distinct values with counts, not rows, are copied to the pairs of their level.
    """
    kept = materialise(valid_groups(df, by, group, value).select(*by, group, value))
    counts = kept.groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("c"))
    levels = kept.select(*by, group).distinct()
    a, b = levels.withColumnRenamed(group, "group1"), levels.withColumnRenamed(group, "group2")
    pairs = a.join(b, by).where(F.col("group1") < F.col("group2"))
    member = pairs.withColumn(group, F.explode(F.array("group1", "group2")))
    spread = counts.join(member, [*by, group])
    keys = [*by, "group1", "group2"]
    weighted = spread.groupBy(*keys, value).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col(group) == F.col("group1"), F.col("c")).otherwise(0)).alias("n1"))
    ranked = below_of_counts(weighted, keys, value)
    per_pair = ranked.groupBy(*keys).agg(
        F.sum(F.col("n1") * average_rank()).alias("R1"), F.sum("n1").alias("N1"), F.sum(F.col("n") - F.col("n1")).alias("N2"),
        F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"))
    n1, n2 = F.col("N1").cast("double"), F.col("N2").cast("double")
    u1 = F.col("R1") - n1 * (n1 + 1) / 2
    N = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12 * (N + 1 - F.col("ties") / (N * (N - 1))))
    u = F.greatest(u1, n1 * n2 - u1)
    z = (u - n1 * n2 / 2 - 0.5) / F.nullif(sigma, F.lit(0.0))
    return per_pair.select(*keys, u1.alias("u1"), z.alias("z"))


def holm(df: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Holm-adjusted p-values over the pairs of one comparison, of which there may be very many: places, numbers of pairs and the running maximum of
    the raised p-values come from ordered ranges, so no comparison is ever in one task."""
    is_test = F.col(p).isNotNull().cast("long")  # a pair without p is no test
    ordered = OrderedRanges(df, by, [p, "group1", "group2"]).add(_place=("sum", is_test), _pairs=("total", is_test))
    ordered.rows = ordered.rows.withColumn("_step", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (F.col("_pairs") - F.col("_place") + 1) * F.col(p))))
    return ordered.add(p_adjusted=("max", F.col("_step"))).rows.withColumn("significant", F.col("p_adjusted") <= 0.05).drop("_part", "_place", "_pairs", "_step")


# Coefficients of Lanczos's approximation of the gamma function (g = 7, nine terms).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for values of at least 0.5."""
    z = a - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + 7.5
    return F.lit(math.log(2 * math.pi) / 2) + (z + 0.5) * F.log(t) - t + F.log(total)


def _steps(size: Column) -> Column:
    """Terms that surely suffice: they grow with the root of the parameter."""
    return F.sequence(F.lit(1), F.least(F.lit(20_000), F.ceil(F.sqrt(size) * 8) + 80).cast("int"))


def _not_zero(c: Column) -> Column:
    return F.when(F.abs(c) < 1e-300, 1e-300).otherwise(c)


def _number(result: Column, *given: Column) -> Column:
    """The result where all that is given is a number."""
    ok = F.lit(True)
    for c in given:
        ok = ok & c.isNotNull() & ~F.isnan(c)
    return F.when(ok, result)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function, its continued fraction folded over a sequence of terms."""

    def lower(x: Column, a: Column, b: Column) -> Column:
        def term(acc: Column, j: Column) -> Column:
            m = F.floor(j / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            part = F.when(j % 2 == 0, even).otherwise(odd)
            d, c = 1 / _not_zero(1 + part * acc["d"]), _not_zero(1 + part / acc["c"])
            return F.struct(d.alias("d"), c.alias("c"), (acc["f"] * d * c).alias("f"))

        start = F.struct(F.lit(0.0).alias("d"), F.lit(1.0).alias("c"), F.lit(1.0).alias("f"))
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        return front / (a * F.aggregate(_steps(F.greatest(a, b)), start, term, lambda acc: acc["f"]))

    inside = F.when(x < (a + 1) / (a + b + 2), lower(x, a, b)).otherwise(1 - lower(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function: the lower one's series up to ``a + 1``, a continued fraction beyond."""

    def in_series(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (a + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    def in_fraction(acc: Column, i: Column) -> Column:
        part, b = -i * (i - a), x + 1 - a + 2 * i
        d, c = 1 / _not_zero(part * acc["d"] + b), _not_zero(b + part / acc["c"])
        return F.struct(d.alias("d"), c.alias("c"), (acc["h"] * d * c).alias("h"))

    front, steps = F.exp(-x + a * F.log(x) - log_gamma(a)), _steps(F.greatest(a, F.lit(1.0)))
    series = F.aggregate(steps, F.struct((1 / a).alias("term"), (1 / a).alias("total")), in_series, lambda acc: acc["total"])
    first = 1 / _not_zero(x + 1 - a)
    fraction = F.aggregate(steps, F.struct(first.alias("d"), F.lit(1e300).alias("c"), first.alias("h")), in_fraction, lambda acc: acc["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f)."""
    f, df1, df2 = f.cast("double"), df1.cast("double"), df2.cast("double")
    return _number(F.when(f <= 0, 1.0).otherwise(incomplete_beta(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)), f, df1, df2)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi squared > x)."""
    x, df = x.cast("double"), df.cast("double")
    return _number(upper_gamma(df / 2, x / 2), x, df)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > z); 1 below 0."""
    return _number(F.when(z <= 0, 1.0).otherwise(upper_gamma(F.lit(0.5), z * z / 2)), z)


def compare_groups(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """All statistics of a comparison with p-values, effect label and stars."""
    df = materialise(df.select(*by, group, value))
    out = welch_anova(df, by, group, value).join(kruskal(df, by, group, value), by).join(levene(df, by, group, value), by)
    out = out.withColumns({
        "welch_p": f_tail(F.col("welch_f"), F.col("welch_df1"), F.col("welch_df2")),
        "kruskal_p": chi2_tail(F.col("kruskal_h"), F.col("kruskal_df")),
        "levene_p": f_tail(F.col("levene_w"), F.col("levene_df1"), F.col("levene_df2")),
    })
    return out.withColumns({"effect": R.effect_label(F.col("eta2")), "stars": R.significance_stars(F.col("welch_p"))})


def pairwise_holm(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    pairs = mann_whitney(df, by, group, value).withColumn("p", normal_two_sided(F.col("z")))
    return holm(pairs, by)
