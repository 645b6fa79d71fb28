"""Tensors with named dimensions as long tables: one column a dimension and `value`. Reductions group by the dimensions that are left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AGGS = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def dims(stack: DataFrame) -> list[str]:
    return [c for c in stack.columns if c != "value"]


def others(stack: DataFrame, *dim: str) -> list[str]:
    return [c for c in dims(stack) if c not in dim]


def reduce(stack: DataFrame, how: str, *dim: str, q: float | None = None) -> DataFrame:
    """Over the named dimensions; deviations are of the population."""
    agg = F.percentile("value", F.lit(q)) if how == "quantile" else AGGS[how]("value")
    return stack.groupBy(*others(stack, *dim)).agg(agg.alias("value"))


def idxmax(stack: DataFrame, dim: str, largest: bool = True) -> DataFrame:
    """The first coordinate of the extreme value along a dimension."""
    v = F.col("value") if largest else -F.col("value")
    return stack.where("value IS NOT NULL").groupBy(*others(stack, dim)).agg(F.max_by(dim, F.struct(v, -F.col(dim))).alias(dim))


def along(stack: DataFrame, dim: str):
    return Window.partitionBy(*others(stack, dim)).orderBy(dim)


def sel_between(stack: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Closed ranges of coordinates."""
    for c, (lo, hi) in ranges.items():
        stack = stack.where(F.col(c).between(lo, hi))
    return stack


def sel_pairs(stack: DataFrame, pairs: DataFrame) -> DataFrame:
    """The given combinations of coordinates."""
    return stack.join(pairs, [c for c in pairs.columns if c in stack.columns], "left_semi")


def combine(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Broadcasting arithmetic: aligned on the dimensions that both have."""
    shared = [c for c in dims(left) if c in dims(right)]
    both = left.join(right.withColumnRenamed("value", "__b"), shared) if shared else left.crossJoin(right.withColumnRenamed("value", "__b"))
    a, b = F.col("value"), F.col("__b")
    return both.withColumn("value", {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]).drop("__b")


def zscore(stack: DataFrame, dim: str) -> DataFrame:
    """By the population's deviation along a dimension; without one, missing."""
    w = Window.partitionBy(*others(stack, dim))
    return stack.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))


def zscore_rolling(stack: DataFrame, dim: str, n: int) -> DataFrame:
    """By mean and deviation of the n samples before each one."""
    w = along(stack, dim).rowsBetween(-n, -1)
    out = stack.withColumn("__n", F.count("value").over(w)).withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w)))
    return out.where(F.col("__n") == n).drop("__n")


def reset_baseline(stack: DataFrame, dim: str, lo: float, hi: float) -> DataFrame:
    """Less the median of a range of the dimension."""
    w = Window.partitionBy(*others(stack, dim))
    base = F.percentile(F.when(F.col(dim).between(lo, hi), F.col("value")), F.lit(0.5)).over(w)
    return stack.withColumn("value", F.col("value") - base)


def extend(stack: DataFrame, dim: str, step: float, pre: int = 0, post: int = 0, fill: float | None = None) -> DataFrame:
    """Coordinates added before and after a regular dimension."""
    keys = others(stack, dim)
    edge = stack.groupBy(*keys).agg(F.min(dim).alias("a"), F.max(dim).alias("b"))
    more = lambda c, n, sign: edge.select(*keys, F.explode(F.expr(f"transform(sequence(1, {n}), i -> {c} + {sign} * i * {float(step)}D)")).alias(dim), F.lit(fill).cast("double").alias("value"))
    for c, n, sign in (("a", pre, -1), ("b", post, 1)):
        if n:
            stack = stack.unionByName(more(c, n, sign).select(*stack.columns))
    return stack


def histogram_along(stack: DataFrame, dim: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of values at each coordinate of a dimension."""
    n = F.least(F.floor((F.col("value") - F.lit(float(lo))) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    return stack.where(F.col("value").between(lo, hi)).groupBy(dim, n.alias("bin")).agg(F.count("*").alias("count"))


def groupby_labels(stack: DataFrame, dim: str, labels: DataFrame, name: str, how: str = "mean") -> DataFrame:
    """A dimension's coordinates (dim, name) grouped by labels."""
    rest = others(stack, dim)
    return stack.join(labels.select(dim, name), dim).groupBy(name, *rest).agg(AGGS[how]("value").alias("value"))


def apply_shift(stack: DataFrame, shifts: DataFrame, by: str, on: str) -> DataFrame:
    """Each row's samples moved by its own number of steps; only what all rows still have stays, numbered from 0."""
    n = stack.withColumn("__i", F.row_number().over(Window.partitionBy(*others(stack, on)).orderBy(on)) - 1).join(shifts.select(by, "shift"), by)
    moved = n.withColumn("__i", F.col("__i") + F.col("shift"))
    size = stack.groupBy(by).agg(F.count_distinct(on).alias("__n")).join(shifts.select(by, "shift"), by).agg(F.max("shift").alias("__lo"), F.min(F.col("shift") + F.col("__n")).alias("__hi"))
    kept = moved.crossJoin(F.broadcast(size)).where("__i >= __lo AND __i < __hi")  # one row
    return kept.withColumn(on, (F.col("__i") - F.col("__lo")).cast("double")).select(*stack.columns)


def stackup(parts: dict, dim: str) -> DataFrame:
    """Stacks along a new dimension."""
    import functools

    return functools.reduce(DataFrame.unionByName, [df.withColumn(dim, F.lit(k)) for k, df in parts.items()])


def split_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with a dense id of their group, and a registry's worth of keys in the same columns."""
    return df.withColumn("group_id", F.dense_rank().over(Window.orderBy(*by)) - 1)


# --- shapes -------------------------------------------------------------------------------------------------------


def from_wide(df: DataFrame, index: str, columns: Sequence[str], name: str) -> DataFrame:
    """A wide table as a tensor of two dimensions."""
    return df.unpivot([index], list(columns), name, "value")


def to_wide(stack: DataFrame, dim: str, coords: Sequence) -> DataFrame:
    """A column for each given coordinate of a dimension."""
    return stack.groupBy(*others(stack, dim)).pivot(dim, list(coords)).agg(F.first("value"))


def transpose(stack: DataFrame, *order: str) -> DataFrame:
    return stack.select(*order, "value")


def rename_dim(stack: DataFrame, old: str, new: str) -> DataFrame:
    return stack.withColumnRenamed(old, new)


def replace_dim(stack: DataFrame, old: str, new: str, mapping: DataFrame) -> DataFrame:
    """Coordinates by a table (old, new)."""
    return stack.join(mapping.select(old, F.col(new).alias("__new")), old).drop(old).withColumnRenamed("__new", new)


def shift_coord(stack: DataFrame, **by: float) -> DataFrame:
    return stack.withColumns({c: F.col(c) + F.lit(float(x)) for c, x in by.items()})


def reset_coord(stack: DataFrame, dim: str = "time", q: float = 0.0) -> DataFrame:
    """A dimension's coordinates from its place q (0 its least, 1 its largest), the same for the whole tensor."""
    edge = stack.agg((F.min(dim) + (F.max(dim) - F.min(dim)) * F.lit(float(q))).alias("__at"))
    return stack.crossJoin(F.broadcast(edge)).withColumn(dim, F.col(dim) - F.col("__at")).drop("__at")  # one row


def isel(stack: DataFrame, dim: str, *positions: int) -> DataFrame:
    """Coordinates by their place in order, from 0."""
    at = stack.select(dim).distinct().withColumn("__i", F.row_number().over(Window.orderBy(dim)) - 1).where(F.col("__i").isin(*positions))
    return stack.join(at.select(dim), dim, "left_semi")


def sel_centered(stack: DataFrame, dim: str, center: float, length: float) -> DataFrame:
    return sel_between(stack, **{dim: (center - length / 2, center + length / 2)})


def sample(stack: DataFrame, dim: str, n: int, seed: int = 0) -> DataFrame:
    """n coordinates of a dimension, by the hash of each."""
    some = stack.select(dim).distinct().orderBy(F.xxhash64(F.col(dim), F.lit(seed)), dim).limit(n)
    return stack.join(some, dim, "left_semi")


# --- along a dimension --------------------------------------------------------------------------------------------


def cumsum(stack: DataFrame, dim: str) -> DataFrame:
    return stack.withColumn("value", F.sum("value").over(along(stack, dim).rowsBetween(Window.unboundedPreceding, 0)))


def diff(stack: DataFrame, dim: str) -> DataFrame:
    """From each coordinate to the next one, which names it."""
    w = along(stack, dim)
    return stack.withColumn("__p", F.lag("value").over(w)).withColumn("__n", F.lag(dim).over(w)).where("__n IS NOT NULL").withColumn("value", F.col("value") - F.col("__p")).drop("__p", "__n")


def gradient(stack: DataFrame, dim: str) -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = along(stack, dim)
    a, b, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    return stack.withColumn("value", F.when(F.lag(dim).over(w).isNull(), b - v).when(F.lead(dim).over(w).isNull(), v - a).otherwise((b - a) / 2))


def elementwise(stack: DataFrame, f) -> DataFrame:
    return stack.withColumn("value", f(F.col("value")))


def clip(stack: DataFrame, lo: float, hi: float) -> DataFrame:
    return elementwise(stack, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))))


def log10(stack: DataFrame, least: float | None = None) -> DataFrame:
    """Values under `least` count as it; without one, those that aren't above zero are missing."""
    return elementwise(stack, lambda v: F.log10(F.greatest(v, F.lit(float(least)))) if least else F.when(v > 0, F.log10(v)))


def where(stack: DataFrame, condition) -> DataFrame:
    """Values that don't meet a condition are missing."""
    return stack.withColumn("value", F.when(condition, F.col("value")))


def dropna(stack: DataFrame, dim: str, how: str = "any") -> DataFrame:
    """Coordinates of a dimension at which some (any) or all values are missing go."""
    w = Window.partitionBy(dim)
    return stack.withColumn("__n", F.count("value").over(w)).withColumn("__all", F.count("*").over(w)).where("__n = __all" if how == "any" else "__n > 0").drop("__n", "__all")


def hann_weights(n: int) -> list[float]:
    """A symmetric Hann window of n points."""
    import math

    return [1.0] if n == 1 else [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]


def mean_rolling(stack: DataFrame, dim: str, n: int) -> DataFrame:
    """Means of n neighbours under a Hann window, centred (of an even number one more lies before); at the ends what there is of it."""
    w, weights = along(stack, dim), hann_weights(n)
    at = [(k - n // 2, g) for k, g in enumerate(weights) if g > 0]
    cols = {f"__{i}": (F.lag("value", -k).over(w) if k < 0 else F.lead("value", k).over(w) if k else F.col("value")) for i, (k, _) in enumerate(at)}
    out = stack.withColumns(cols)
    top = sum((F.coalesce(F.col(f"__{i}"), F.lit(0.0)) * g for i, (_, g) in enumerate(at)), F.lit(0.0))
    low = sum((F.when(F.col(f"__{i}").isNotNull(), F.lit(g)).otherwise(0.0) for i, (_, g) in enumerate(at)), F.lit(0.0))
    return out.withColumn("value", F.try_divide(top, low)).drop(*cols)


def extent(stack: DataFrame, dim: str = "time") -> DataFrame:
    """One row: start, stop, the number of coordinates and their mean step."""
    got = stack.agg(F.min(dim).alias("start"), F.max(dim).alias("stop"), F.count_distinct(dim).alias("n"))
    return got.withColumn("period", F.try_divide(F.col("stop") - F.col("start"), F.col("n") - 1))


def downsample(stack: DataFrame, dim: str, factor: int) -> DataFrame:
    """Every factor-th coordinate of each row."""
    n = F.row_number().over(along(stack, dim)) - 1
    return stack.withColumn("__i", n).where(F.pmod("__i", F.lit(factor)) == 0).drop("__i")


def interp(stack: DataFrame, dim: str, at: DataFrame) -> DataFrame:
    """Linear interpolation at the coordinates of a table with that one column; outside a row's extent there is none."""
    from .joins import interpolate_at

    keys = others(stack, dim)
    ext = stack.groupBy(*keys).agg(F.min(dim).alias("__a"), F.max(dim).alias("__b"))
    grid = ext.crossJoin(F.broadcast(at.select(F.col(dim).cast("double").alias("__g")))) if not keys else ext.withColumn("__k", F.lit(1)).join(at.select(F.col(dim).cast("double").alias("__g"), F.lit(1).alias("__k")), "__k").drop("__k")
    got = interpolate_at(grid.where("__g BETWEEN __a AND __b").drop("__a", "__b"), stack, left_time="__g", right_time=dim, value="value", by=keys)
    return got.withColumnRenamed("__g", dim).select(*stack.columns)


def upsample(stack: DataFrame, dim: str, hz: float) -> DataFrame:
    """Linear interpolation at a rate from each row's first coordinate; the last one is left out."""
    from .joins import interpolate_at

    keys, step = others(stack, dim), 1000.0 / hz
    ext = stack.groupBy(*keys).agg(F.min(dim).alias("__a"), F.max(dim).alias("__b"))
    n = F.ceil((F.col("__b") - F.col("__a")) / step - 1e-9) - 1
    each = ext.where(n >= 0).select(*keys, "__a", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("__i"))
    grid = each.select(*keys, (F.col("__a") + F.col("__i") * step).alias("__g"))
    got = interpolate_at(grid, stack, left_time="__g", right_time=dim, value="value", by=keys)
    return got.withColumnRenamed("__g", dim).select(*stack.columns)


def sample_to_ms(stack: DataFrame, hz: float, dim: str = "sample", new: str = "time") -> DataFrame:
    return stack.withColumn(dim, F.col(dim) / F.lit(float(hz)) * 1000.0).withColumnRenamed(dim, new)


def ms_to_sample(stack: DataFrame, hz: float, dim: str = "time", new: str = "sample") -> DataFrame:
    return stack.withColumn(dim, F.rint(F.col(dim) * F.lit(hz / 1000.0)).cast("long")).withColumnRenamed(dim, new)


def snip(stack: DataFrame, marks: DataFrame, pre: float, post: float, n: int, dim: str = "time", new: str = "sample", mark: str = "mark") -> DataFrame:
    """The samples of [mark + pre, mark + post) around each mark, numbered from 0; marks without all n of them go."""
    from .joins import range_join

    keys = others(stack, dim)
    by = [c for c in keys if c in marks.columns]
    wins = marks.select(*by, F.col(mark).alias("__m"), (F.col(mark) + pre).alias("__a"), (F.col(mark) + post).alias("__b"))
    hit = range_join(stack, wins, time=dim, start="__a", stop="__b", by=by)
    w = Window.partitionBy(*keys, "__m")
    got = hit.withColumn(new, (F.row_number().over(w.orderBy(dim)) - 1).cast("long")).withColumn("__n", F.count("*").over(w))
    return got.where(F.col("__n") == n).select(*keys, F.col("__m").alias(mark), new, "value")


# --- kernels ------------------------------------------------------------------------------------------------------


def _kernel(stack: DataFrame, dim: str, f, *more, **args) -> DataFrame:
    return f(stack.withColumnRenamed(dim, "time"), *more, key=tuple(others(stack, dim)), **args)


def apply(stack: DataFrame, dim: str, f) -> DataFrame:
    """f(coordinates, values) along a dimension gives as many values."""
    from .signals import apply_traces

    got = _kernel(stack, dim, apply_traces, lambda t, v, r: {"time": t, "value": f(t, v)}, "time double, value double")
    return got.withColumnRenamed("time", dim).select(*stack.columns)


def filter_pass(stack: DataFrame, kind: str, hz, dim: str = "time", order: int = 2) -> DataFrame:
    from .signals import filter_pass as run

    return _kernel(stack, dim, run, kind, hz, order).withColumnRenamed("time", dim).select(*stack.columns)


def find_peaks(stack: DataFrame, dim: str = "time", negative: bool = False, **limits) -> DataFrame:
    """Peaks along a dimension, for each of the others: the coordinate, height, prominence and width."""
    from .signals import find_peaks as run

    return _kernel(stack, dim, run, negative, **limits).withColumnRenamed("time", dim)


def spectrogram(stack: DataFrame, segment: int, overlap: int, dim: str = "time") -> DataFrame:
    """In decibels; a further dimension freq."""
    from .signals import spectrogram as run

    return _kernel(stack, dim, run, segment, overlap).withColumnRenamed("time", dim)


# --- files --------------------------------------------------------------------------------------------------------


def store(stack: DataFrame, path: str, dim: str) -> None:
    """Parquet, a folder for each coordinate of a dimension, so that reading some of them reads no more."""
    stack.write.mode("overwrite").partitionBy(dim).parquet(path)


def load(spark, path: str, gain: float | None = None, **sel) -> DataFrame:
    """Coordinates by value or, as a pair, by closed range; the values by a gain."""
    got = spark.read.parquet(path)
    for c, x in sel.items():
        got = got.where(F.col(c).between(*x) if isinstance(x, tuple) else F.col(c) == F.lit(x))
    return elementwise(got, lambda v: v * F.lit(float(gain))) if gain is not None else got
