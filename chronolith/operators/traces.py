"""Traces: sampled signals as a long table (trace_idx, time, value) beside a registry of one row a trace.

Windows over a trace are partitioned by trace_idx, so that all of these run per trace without another shuffle once partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import interpolate_at, range_join

KEY = ("trace_idx",)


def along(key: Sequence[str] = KEY, order: str = "time"):
    return Window.partitionBy(*key).orderBy(order)


def whole(key: Sequence[str] = KEY):
    return Window.partitionBy(*key)


def centred(n: int, key: Sequence[str] = KEY, order: str = "time"):
    """A centred frame of n samples; of an even number one more lies before."""
    return along(key, order).rowsBetween(-(n // 2), n - n // 2 - 1)


# --- shapes -------------------------------------------------------------------------------------------------------


def from_wide(df: DataFrame, time: str, cols: Sequence[str], key: str = "trace_idx") -> DataFrame:
    """Columns of a wide table as traces."""
    return df.unpivot([time], list(cols), key, "value").withColumnRenamed(time, "time")


def to_wide(traces: DataFrame, names: Sequence, key: str = "trace_idx") -> DataFrame:
    return traces.groupBy("time").pivot(key, list(names)).agg(F.first("value"))


def pack(traces: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row a trace: t0, period and its values in time order."""
    got = traces.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("__s"))
    n = F.size("__s")
    first, last = F.col("__s")[0]["time"], F.element_at("__s", -1)["time"]
    return got.select(*key, first.alias("t0"), F.try_divide(last - first, n - 1).alias("period"), F.transform("__s", lambda x: x["value"]).alias("values"))


def unpack(packed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return packed.select(*key, "t0", "period", F.posexplode("values").alias("i", "value")).select(*key, (F.col("t0") + F.col("i") * F.col("period")).alias("time"), "value")


def merge_reg(traces: DataFrame, reg: DataFrame, key: str = "trace_idx") -> DataFrame:
    return traces.join(reg, key)


def valid_extent(traces: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """First and last time with a value."""
    some = F.col("value").isNotNull()
    return traces.groupBy(*key).agg(F.min(F.when(some, F.col("time"))).alias("first_valid"), F.max(F.when(some, F.col("time"))).alias("last_valid"))


def sampling(traces: DataFrame, key: Sequence[str] = KEY, atol: float = 1e-6) -> DataFrame:
    """period (mean step), and whether all steps are the same."""
    step = traces.withColumn("__d", F.col("time") - F.lag("time").over(along(key)))
    return step.groupBy(*key).agg(F.avg("__d").alias("period"), (F.max("__d") - F.min("__d") <= F.lit(atol)).alias("regular"), F.min("time").alias("start"), F.max("time").alias("stop"), F.count("*").alias("n"))


def drop_empty(traces: DataFrame, how: str = "all", key: Sequence[str] = KEY) -> DataFrame:
    """Traces without any value (how=all), or with a missing one (any), go."""
    some = F.count("value").over(whole(key))
    return traces.withColumn("__n", some).withColumn("__all", F.count("*").over(whole(key))).where("__n > 0" if how == "all" else "__n = __all").drop("__n", "__all")


def drop_missing(traces: DataFrame, how: str = "any") -> DataFrame:
    """Times at which any (or all) traces lack a value go."""
    w = Window.partitionBy("time")
    return traces.withColumn("__n", F.count("value").over(w)).withColumn("__all", F.count("*").over(w)).where("__n = __all" if how == "any" else "__n > 0").drop("__n", "__all")


def drop_tight(traces: DataFrame) -> DataFrame:
    """Only the times between the latest first and the earliest last value of all traces."""
    ext = valid_extent(traces).agg(F.max("first_valid").alias("__a"), F.min("last_valid").alias("__b"))
    return traces.join(F.broadcast(ext), F.col("time").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")  # one row


def crop(traces: DataFrame, lo: float, hi: float, reset: bool = False) -> DataFrame:
    out = traces.where(F.col("time").between(lo, hi))
    return out.withColumn("time", F.col("time") - F.lit(float(lo))) if reset else out


def shift_time(traces: DataFrame, shifts: DataFrame | float, key: str = "trace_idx") -> DataFrame:
    if isinstance(shifts, DataFrame):
        return traces.join(shifts.select(key, F.col("shift").alias("__s")), key).withColumn("time", F.col("time") + F.col("__s")).drop("__s")
    return traces.withColumn("time", F.col("time") + F.lit(float(shifts)))


def combine(left: DataFrame, right: DataFrame, op: str, key: Sequence[str] = KEY) -> DataFrame:
    """Two sets of traces, sample by sample; a sample that one lacks is missing. op: + - * / // % and comparisons."""
    a, b = F.col("value"), F.col("__b")
    ops = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "//": F.floor(F.try_divide(a, b)).cast("double"), "%": a - F.floor(F.try_divide(a, b)) * b, "==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}
    both = left.join(right.select(*key, "time", F.col("value").alias("__b")), [*key, "time"], "full")
    return both.withColumn("value", ops[op]).drop("__b")


# --- by groups of traces ------------------------------------------------------------------------------------------

AGGS = {
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "std": lambda c: F.stddev_samp(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "sum": lambda c: F.sum(c),
    "var": lambda c: F.var_samp(c),
    "count": lambda c: F.count(c),
}


def groupby_mix(traces: DataFrame, reg: DataFrame, by: Sequence[str], how: str, key: str = "trace_idx") -> DataFrame:
    """Traces of the same registry values, mixed sample by sample. The registry is the smaller side; the planner decides by its size."""
    return traces.join(reg.select(key, *by), key).groupBy(*by, "time").agg(AGGS[how]("value").alias("value"))


def invariant_columns(reg: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row a group with the metadata that all its traces share; other columns are null."""
    rest = [c for c in reg.columns if c not in by]
    return reg.groupBy(*by).agg(*[F.when(F.count_distinct(c) == 1, F.first(c, ignorenulls=True)).alias(c) for c in rest])


def reduce(traces: DataFrame, how: str, key: Sequence[str] = KEY, q: float | None = None) -> DataFrame:
    """One value a trace (or, with key=('time',), one a time)."""
    agg = F.percentile("value", F.lit(q)) if how == "quantile" else AGGS[how]("value")
    return traces.groupBy(*key).agg(agg.alias(how))


def idxmax(traces: DataFrame, key: Sequence[str] = KEY, largest: bool = True) -> DataFrame:
    """The earliest time of the extreme value."""
    v = F.col("value") if largest else -F.col("value")
    return traces.where("value IS NOT NULL").groupBy(*key).agg(F.max_by("time", F.struct(v, -F.col("time"))).alias("idxmax" if largest else "idxmin"))


# --- element-wise and along time ----------------------------------------------------------------------------------


def elementwise(traces: DataFrame, f) -> DataFrame:
    return traces.withColumn("value", f(F.col("value")))


def clip(traces: DataFrame, lo: float, hi: float) -> DataFrame:
    return elementwise(traces, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))))


def log10(traces: DataFrame) -> DataFrame:
    """Null for values that aren't above zero."""
    return elementwise(traces, lambda v: F.when(v > 0, F.log10(v)))


def gradient(traces: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = along(key)
    a, b, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    return traces.withColumn("value", F.when(F.lag("time").over(w).isNull(), b - v).when(F.lead("time").over(w).isNull(), v - a).otherwise((b - a) / 2))


def diff(traces: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return traces.withColumn("value", F.col("value") - F.lag("value").over(along(key)))


def cumsum(traces: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    run = F.sum("value").over(along(key).rowsBetween(Window.unboundedPreceding, 0))
    return traces.withColumn("value", F.when(F.col("value").isNotNull(), run))


def unwrap(traces: DataFrame, period: float = 1.0, key: Sequence[str] = KEY) -> DataFrame:
    """Jumps of more than half a period between neighbours are taken for wraps; a jump of exactly half is none."""
    w, p = along(key), F.lit(float(period))
    d = F.col("value") - F.lag("value").over(w)
    fix = F.when(F.abs(d) > p / 2, -p * F.floor(d / p + 0.5)).otherwise(F.lit(0.0))
    return traces.withColumn("__f", fix).withColumn("value", F.col("value") + F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def rolling(traces: DataFrame, n: int, how: str, key: Sequence[str] = KEY) -> DataFrame:
    """A centred window of n samples; at the ends what there is of it."""
    return traces.withColumn("value", AGGS[how]("value").over(centred(n, key)))


def rolling_gaussian(traces: DataFrame, std_samples: float, key: Sequence[str] = KEY) -> DataFrame:
    """Means weighted by a Gaussian of the given deviation in samples, over int(4 * deviation) samples."""
    n = max(1, int(4 * std_samples))
    half = n // 2
    mid = (n - 1) / 2
    terms = [(math.exp(-0.5 * ((k + half - mid) / std_samples) ** 2), k) for k in range(-half, n - half)]
    w = along(key)
    at = lambda k: F.col("value") if k == 0 else (F.lag("value", -k).over(w) if k < 0 else F.lead("value", k).over(w))
    cols = {f"__{i}": at(k) for i, (_, k) in enumerate(terms)}
    out = traces.withColumns(cols)
    top = sum((F.coalesce(F.col(f"__{i}"), F.lit(0.0)) * g for i, (g, _) in enumerate(terms)), F.lit(0.0))
    low = sum((F.when(F.col(f"__{i}").isNotNull(), F.lit(g)).otherwise(0.0) for i, (g, _) in enumerate(terms)), F.lit(0.0))
    return out.withColumn("value", F.try_divide(top, low)).drop(*cols)


def zscore(traces: DataFrame, key: Sequence[str] = KEY, ddof: int = 1) -> DataFrame:
    sd = (F.stddev_samp if ddof else F.stddev_pop)("value").over(whole(key))
    return traces.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(whole(key)), sd))


def zscore_rolling(traces: DataFrame, n: int, key: Sequence[str] = KEY) -> DataFrame:
    w = centred(n, key)
    return traces.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w)))


def normalize_by_quantiles(traces: DataFrame, lo: float = 0.05, hi: float = 0.95, win: tuple[float, float] | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """(x - q_lo) / (q_hi - q_lo), with quantiles of the whole trace or of a window of it. One aggregate a trace is joined back."""
    base = traces.where(F.col("time").between(*win)) if win else traces
    q = base.groupBy(*key).agg(F.percentile("value", F.lit(lo)).alias("__lo"), F.percentile("value", F.lit(hi)).alias("__hi"))
    return traces.join(q, list(key)).withColumn("value", F.try_divide(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def histograms(traces: DataFrame, lo: float, hi: float, bins: int, density: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    width = (hi - lo) / bins
    n = F.least(F.floor((F.col("value") - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("long")
    got = traces.where(F.col("value").between(lo, hi)).groupBy(*key, n.alias("bin")).agg(F.count("*").alias("count"))
    return got.withColumn("density", F.col("count") / (F.sum("count").over(whole(key)) * F.lit(width))) if density else got


def downsample_factor(traces: DataFrame, factor: int, offset: int = 0, key: Sequence[str] = KEY) -> DataFrame:
    """Every factor-th sample."""
    return traces.withColumn("__i", F.row_number().over(along(key)) - 1).where(F.pmod(F.col("__i") - offset, F.lit(factor)) == 0).drop("__i")


def resample(traces: DataFrame, period: float, key: Sequence[str] = KEY, start: float | None = None, stop: float | None = None) -> DataFrame:
    """Linear interpolation on a grid of the given period over each trace's extent."""
    ext = traces.where("value IS NOT NULL").groupBy(*key).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    a = F.lit(float(start)) if start is not None else F.col("a")
    b = F.lit(float(stop)) if stop is not None else F.col("b")
    n = F.floor((b - a) / F.lit(float(period)) + 1e-9)
    grid = ext.where(n >= 0).select(*key, a.alias("__a"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i")).select(*key, (F.col("__a") + F.col("i") * F.lit(float(period))).alias("grid"))
    got = interpolate_at(grid, traces, left_time="grid", right_time="time", value="value", by=key)
    return got.withColumnRenamed("grid", "time")


def interp(traces: DataFrame, times: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Values at given times (a table with the key and time); beyond the ends the edge value."""
    return interpolate_at(times.withColumnRenamed("time", "grid"), traces, left_time="grid", right_time="time", value="value", by=key, clamp=True).withColumnRenamed("grid", "time")


def extract_windows(traces: DataFrame, wins: DataFrame, by: Sequence[str] = (), align: str | None = "ref") -> DataFrame:
    """Samples of each trace inside each window of its series, edges included, re-referenced."""
    hit = range_join(traces, wins, time="time", by=by, closed="both")
    return hit.withColumn("time", F.col("time") - F.col(align)) if align else hit


def is_local_peak(key: Sequence[str] = KEY) -> Column:
    w = along(key)
    v = F.col("value")
    return F.coalesce((v >= F.lag("value").over(w)) & (v >= F.lead("value").over(w)), F.lit(False))


# --- many series together -----------------------------------------------------------------------------------------


def from_series_resampled(series: DataFrame, key: Sequence[str] = KEY, period: float | None = None, unit: float = 1.0) -> DataFrame:
    """Series of different sampling on one grid: from their first time, floored to a unit, to their last, a period apart
    (by default half the smallest step of any, rounded up); outside of its own extent a series has no value."""
    step = series.withColumn("__d", F.col("time") - F.lag("time").over(along(key)))
    whole_ = step.agg(F.min("__d").alias("d"), (F.floor(F.min("time") / F.lit(float(unit))) * F.lit(float(unit))).alias("a"), F.max("time").alias("b"))
    whole_ = whole_.select("a", "b", (F.lit(float(period)) if period else F.ceil(F.col("d") / 2).cast("double")).alias("p"))
    n = F.floor((F.col("b") - F.col("a")) / F.col("p") + 1e-9)
    grid = series.select(*key).distinct().crossJoin(F.broadcast(whole_))  # one row
    grid = grid.select(*key, "a", "p", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i")).select(*key, (F.col("a") + F.col("i") * F.col("p")).alias("grid"))
    return interpolate_at(grid, series, left_time="grid", right_time="time", value="value", by=key).withColumnRenamed("grid", "time")


def concat(parts: dict, name: str = "part") -> DataFrame:
    """Sets of traces as one, with the key of each part as a column that belongs to the trace's key."""
    import functools

    return functools.reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def concat_aligned(parts: dict, name: str = "part", key: Sequence[str] = KEY) -> DataFrame:
    """The same, at all times that any of them has; a trace without a sample there has a missing one."""
    both = concat(parts, name)
    times = both.select("time").distinct()
    every = both.select(name, *key).distinct().withColumn("__k", F.lit(1)).join(times.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return every.join(both, [name, *key, "time"], "left")


def unique_sorted(reg: DataFrame, col: str, order: Sequence = ()) -> DataFrame:
    """Distinct values with their place: the preferred ones first, the others after them in order."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col)) if order else F.lit(0)
    got = reg.select(col).where(F.col(col).isNotNull()).distinct().withColumn("__p", F.when(place > 0, place).otherwise(F.lit(len(order) + 1)))
    return got.withColumn("place", (F.row_number().over(Window.orderBy("__p", col)) - 1).cast("long")).drop("__p")


def histograms2d(traces: DataFrame, tbins: tuple[float, float, int], vbins: tuple[float, float, int], key: Sequence[str] = KEY) -> DataFrame:
    """Counts of each trace by time and value; bins are half open and the last one closed."""
    out = traces
    for c, name, (lo, hi, n) in (("time", "tbin", tbins), ("value", "vbin", vbins)):
        out = out.where(F.col(c).between(lo, hi)).withColumn(name, F.least(F.floor((F.col(c) - F.lit(float(lo))) / F.lit((hi - lo) / n)), F.lit(n - 1)).cast("long"))
    return out.groupBy(*key, "tbin", "vbin").agg(F.count("*").alias("count"))


def to_wins(traces: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The extent of each trace's values as a window, its reference at the start."""
    ext = valid_extent(traces, key)
    return ext.select(*key, F.col("first_valid").alias("start"), F.col("last_valid").alias("stop"), F.col("first_valid").alias("ref"))


def crop_centered(traces: DataFrame, duration: float, key: Sequence[str] = KEY) -> DataFrame:
    """The middle part of each trace's extent."""
    w = whole(key)
    mid = (F.min("time").over(w) + F.max("time").over(w)) / 2
    return traces.withColumn("__m", mid).where(F.abs(F.col("time") - F.col("__m")) <= F.lit(duration / 2)).drop("__m")


def lookup(traces: DataFrame, times: DataFrame, key: Sequence[str] = KEY, time: str = "at") -> DataFrame:
    """The value of each trace at its own time, linearly between samples; beyond the ends the edge value."""
    return interpolate_at(times, traces, left_time=time, right_time="time", value="value", by=key, clamp=True)


def extract_resampled(traces: DataFrame, wins: DataFrame, period: float, on: Sequence[str] = (), key: Sequence[str] = KEY, win: str = "win_idx") -> DataFrame:
    """Each trace on a regular grid over each window that shares the columns `on` (all windows without any), times from the window's reference."""
    reg = traces.select(*key, *[c for c in on if c not in key]).distinct()
    own = wins.select(win, "start", "stop", "ref", *on)
    pairs = reg.join(own, list(on)) if on else reg.withColumn("__k", F.lit(1)).join(own.withColumn("__k", F.lit(1)), "__k").drop("__k")
    n = F.floor((F.col("stop") - F.col("start")) / F.lit(float(period)) + 1e-9)
    grid = pairs.where(n >= 0).select(*key, win, "start", "ref", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("__i"))
    grid = grid.select(*key, win, "ref", (F.col("start") + F.col("__i") * F.lit(float(period))).alias("grid"))
    got = interpolate_at(grid, traces, left_time="grid", right_time="time", value="value", by=key)
    return got.select(*key, win, (F.col("grid") - F.col("ref")).alias("time"), "value")


def zscore_by_middle(traces: DataFrame, reference_ms: float, key: Sequence[str] = KEY) -> DataFrame:
    """By mean and population deviation of a window in the middle of each trace, so that all chunks of a recording are scaled alike."""
    ext = traces.groupBy(*key).agg(((F.min("time") + F.max("time")) / 2).alias("__m"))
    near = traces.join(ext, list(key)).where(F.abs(F.col("time") - F.col("__m")) <= F.lit(reference_ms / 2))
    stats = near.groupBy(*key).agg(F.avg("value").alias("__a"), F.stddev_pop("value").alias("__s"))
    return traces.join(stats, list(key)).withColumn("value", F.try_divide(F.col("value") - F.col("__a"), F.col("__s"))).drop("__a", "__s")


def wrapped(traces: DataFrame, period: float) -> DataFrame:
    """Lines cut at whole periods: the row that each sample falls on, and its time within the row."""
    row = F.floor(F.col("time") / F.lit(float(period)))
    return traces.withColumn("row", row.cast("long")).withColumn("time", F.col("time") - row * F.lit(float(period)))
