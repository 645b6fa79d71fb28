"""Rank statistics and densities that the reports use."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str | Column, by: Sequence[str] = ()) -> Column:
    """Rank from 1; ties share the mean of theirs."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)]))
    return F.rank().over(w.orderBy(v)) + (F.count("*").over(w.partitionBy(*([F.col(c) for c in by] or [F.lit(0)]), v)) - 1) / 2.0


def wilcoxon(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank sums of the differences other than zero: w_plus, w_minus, n."""
    d = df.select(*by, (F.col(b) - F.col(a)).alias("d")).where("d <> 0")
    r = d.withColumn("r", average_rank(F.abs("d"), by))
    return r.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"))


def mann_whitney(df: DataFrame, value: str, group: str, first, by: Sequence[str] = ()) -> DataFrame:
    """U of the first group against the rest: u, n1, n2."""
    r = df.where(F.col(value).isNotNull()).withColumn("__r", average_rank(value, by)).withColumn("__1", (F.col(group) == F.lit(first)).cast("double"))
    got = r.groupBy(*by).agg(F.sum(F.col("__r") * F.col("__1")).alias("s"), F.sum("__1").alias("n1"), F.sum(1 - F.col("__1")).alias("n2"))
    return got.select(*by, (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))


def mann_whitney_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p by the normal approximation with continuity correction."""
    mean, sd = n1 * n2 / 2, math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return math.erfc(max(0.0, abs(u - mean) - 0.5) / sd / math.sqrt(2))


def p_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def density(df: DataFrame, value: str, points: int = 101, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid over the range; values go to 1/16 bandwidth bins first, so that cost doesn't grow with the rows a grid point."""
    s = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).where("sd > 0")
    s = s.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    joined = df.join(s, list(by)) if by else df.crossJoin(F.broadcast(s))  # one row
    binned = joined.groupBy(*by, F.rint(F.col(value) / (F.col("bw") / 16)).alias("b"), "lo", "hi", "bw", "n").agg(F.count("*").alias("c"), F.avg(value).alias("x"))
    grid = binned.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / (points - 1))
    k = F.exp(-0.5 * F.pow((F.col("at") - F.col("x")) / F.col("bw"), F.lit(2))) / (F.lit(math.sqrt(2 * math.pi)) * F.col("bw"))
    return grid.groupBy(*by, "g", "at").agg(F.sum(F.col("c") * k / F.col("n")).alias("density"))


def circular_copies(df: DataFrame, x: str, y: str, lim: tuple[float, float]) -> DataFrame:
    """Points of a unit torus with their copies one period away, within limits."""
    shift = F.array(*[F.lit(float(k)) for k in (-1, 0, 1)])
    out = df.withColumn("__dx", F.explode(shift)).withColumn("__dy", F.explode(shift)).withColumns({x: F.col(x) + F.col("__dx"), y: F.col(y) + F.col("__dy")})
    return out.where(F.col(x).between(*lim) & F.col(y).between(*lim)).drop("__dx", "__dy")


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal value, by a rational approximation of the error function (7 digits)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.least(poly * F.exp(-x * x), F.lit(1.0))


def wilcoxon_p(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """The signed-rank sums with z and the two-sided p of the normal approximation, corrected for continuity."""
    got = wilcoxon(df, a, b, by)
    n = F.col("n").cast("double")
    mean, sd = n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    z = F.try_divide(F.greatest(F.abs(F.col("w_plus") - mean) - 0.5, F.lit(0.0)), sd)
    return got.withColumn("z", z).withColumn("p", normal_tail(F.col("z")))


def mann_whitney_test(df: DataFrame, value: str, group: str, first, by: Sequence[str] = ()) -> DataFrame:
    """U with z and the two-sided p of the normal approximation, corrected for continuity."""
    got = mann_whitney(df, value, group, first, by)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)), F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    return got.withColumn("z", z).withColumn("p", normal_tail(F.col("z")))


def format_p(p: Column) -> Column:
    """In words: `p < 0.001`, or three digits, with stars."""
    text = F.when(p < 0.001, F.lit("p < 0.001")).otherwise(F.concat(F.lit("p = "), F.format_string("%.3f", p)))
    return F.trim(F.concat(text, F.lit(" "), p_stars(p)))


def phase_histogram(df: DataFrame, phase: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Shares of phases in [0, 1) by equal bins of the circle."""
    n = F.least(F.floor(F.col(phase) * bins), F.lit(bins - 1)).cast("long")
    got = df.where(F.col(phase).between(0, 1)).groupBy(*by, n.alias("bin")).agg(F.count("*").alias("count"))
    return got.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)]))))
