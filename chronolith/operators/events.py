"""Events: columns event_id, ref_time (start_time, stop_time) and metadata; sequences, counts, rolling measures and look-ups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import asof, interpolate_at, range_join
from .numbering import number_rows
from .windows import _keys


def ordered(by: Sequence[str], *order: str):
    return Window.partitionBy(*_keys(by)).orderBy(*order)


def round_times(events: DataFrame, cols: Sequence[str] = ("ref_time",), decimals: int = 0) -> DataFrame:
    """Half to even."""
    return events.withColumns({c: F.bround(c, decimals) for c in cols})


def to_wins(events: DataFrame) -> DataFrame:
    """Windows of the events; missing edges are the reference."""
    edge = lambda c: F.coalesce(F.col(c), F.col("ref_time")) if c in events.columns else F.col("ref_time")
    rest = [c for c in events.columns if c not in ("ref_time", "start_time", "stop_time")]
    return events.select(*rest, edge("start_time").alias("start"), edge("stop_time").alias("stop"), F.col("ref_time").alias("ref"))


def inter_event_intervals(events: DataFrame, by: Sequence[str] = (), first: str = "ref_time", second: str = "ref_time", order: Sequence[str] = ("ref_time", "event_id")) -> DataFrame:
    return events.withColumn("interval", F.lead(second).over(ordered(by, *order)) - F.col(first))


def intervals_between_channels(events: DataFrame, first_ch, second_ch, by: Sequence[str] = (), col: str = "channel", order: Sequence[str] = ("ref_time", "event_id")) -> DataFrame:
    """From events of one channel to the next one, where that is of the other channel."""
    w = ordered(by, *order)
    out = events.withColumn("__n", F.lead(col).over(w)).withColumn("interval", F.lead("ref_time").over(w) - F.col("ref_time"))
    return out.where((F.col(col) == F.lit(first_ch)) & (F.col("__n") == F.lit(second_ch))).drop("__n")


def time_to_closest(events: DataFrame, by: Sequence[str] = (), start: str = "ref_time", stop: str = "ref_time", order: Sequence[str] = ("ref_time", "event_id")) -> DataFrame:
    """The smaller of the gaps to the neighbours; at the ends the one there is."""
    w = ordered(by, *order)
    return events.withColumn("to_closest", F.least(F.abs(F.lead(start).over(w) - F.col(stop)), F.abs(F.col(start) - F.lag(stop).over(w))))


def counts_in_bins(events: DataFrame, lo: float, hi: float, step: float, by: Sequence[str] = (), time: str = "ref_time") -> DataFrame:
    """Counts of all regular bins of [lo, hi), zero where none; the last bin is closed."""
    n = math.ceil((hi - lo) / step) - 1
    top = lo + n * step
    own = events.where(F.col(time).between(lo, top)).withColumn("bin", F.least(F.floor((F.col(time) - F.lit(float(lo))) / F.lit(float(step))), F.lit(n - 1)).cast("long"))
    got = own.groupBy(*by, "bin").agg(F.count("*").alias("count"))
    keys = events.select(*by).distinct() if by else events.sparkSession.range(1).select(F.lit(1).alias("__one"))
    every = keys.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select(*by, "bin")
    return every.join(got, [*by, "bin"], "left").fillna({"count": 0})


def histogram2d(events: DataFrame, tbins: tuple[float, float, int], vbins: tuple[float, float, int], value: str = "amplitude", time: str = "ref_time", by: Sequence[str] = ()) -> DataFrame:
    """Counts by time and value; bins are half open and the last one closed."""
    out = events
    for c, name, (lo, hi, n) in ((time, "tbin", tbins), (value, "vbin", vbins)):
        out = out.where(F.col(c).between(lo, hi)).withColumn(name, F.least(F.floor((F.col(c) - F.lit(float(lo))) / F.lit((hi - lo) / n)), F.lit(n - 1)).cast("long"))
    return out.groupBy(*by, "tbin", "vbin").agg(F.count("*").alias("count"))


def regular_grid(keys: DataFrame, lo: float, hi: float, step: float) -> DataFrame:
    """Grid times lo, lo + step, ... below hi for each row of `keys`."""
    n = math.ceil((hi - lo) / step)
    return keys.withColumn("grid_time", F.explode(F.expr(f"transform(sequence(0L, {n - 1}L), i -> {float(lo)}D + i * {float(step)}D)")))


def rolling(events: DataFrame, keys: DataFrame, lo: float, hi: float, step: float, win: float, aggs: Sequence[Column], by: Sequence[str] = (), time: str = "ref_time", value: str | None = None) -> DataFrame:
    """Aggregates of the events in a closed window around each grid time, by a bucketed range join; grid times without events stay."""
    grid = regular_grid(keys, lo, hi, step).withColumns({"start": F.col("grid_time") - win / 2, "stop": F.col("grid_time") + win / 2})
    cols = [time, value] if value else [time]
    hit = range_join(events.select(*by, *cols), grid, time=time, by=by, closed="both", width=max(win, step))
    got = hit.groupBy(*by, "grid_time").agg(*aggs)
    return regular_grid(keys, lo, hi, step).join(got, [*by, "grid_time"], "left")


def count_rolling(events: DataFrame, keys: DataFrame, lo: float, hi: float, step: float, win: float, by: Sequence[str] = (), time: str = "ref_time") -> DataFrame:
    return rolling(events, keys, lo, hi, step, win, [F.count("*").alias("count")], by, time).fillna({"count": 0})


def rate_rolling_box(events: DataFrame, keys: DataFrame, lo: float, hi: float, step: float, win: float, by: Sequence[str] = (), time: str = "ref_time") -> DataFrame:
    """Events a second."""
    return count_rolling(events, keys, lo, hi, step, win, by, time).withColumn("rate", F.col("count") / F.lit(win / 1000.0))


def mean_rolling(events: DataFrame, keys: DataFrame, lo: float, hi: float, step: float, win: float, value: str, by: Sequence[str] = (), nmin: int = 1, time: str = "ref_time") -> DataFrame:
    """Means of windows with `nmin` values or more; missing values don't count."""
    return rolling(events, keys, lo, hi, step, win, [F.when(F.count(value) >= nmin, F.avg(value)).alias("mean")], by, time, value)


def quantile_rolling(events: DataFrame, keys: DataFrame, lo: float, hi: float, step: float, win: float, value: str, quantiles: dict[str, float], by: Sequence[str] = (), nmin: int = 1, time: str = "ref_time") -> DataFrame:
    """Exact quantiles with linear interpolation.

    Events are dealt to stretches of grid times, with half a window to either side, and a kernel takes each stretch's windows from its
    sorted events, so that an event is copied to two stretches at most and not to all windows that hold it.
    """
    count, per, half = math.ceil((hi - lo) / step), max(64, math.ceil(win / step)), win / 2
    names, shares = list(quantiles), list(quantiles.values())
    at = lambda t: F.floor((t - F.lit(float(lo))) / F.lit(float(step * per)))
    own = events.where(F.col(value).isNotNull()).select(*by, F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"))
    dealt = own.withColumn("__no", F.explode(F.sequence(at(F.col("__t") - half), at(F.col("__t") + half))))
    packed = dealt.groupBy(*by, "__no").agg(F.array_sort(F.collect_list(F.struct("__t", "__v"))).alias("__s"))
    packed = packed.select(*by, "__no", F.transform("__s", lambda x: x["__t"]).alias("__t"), F.transform("__s", lambda x: x["__v"]).alias("__v"))
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, times, found = [], [], []
            for i, no in enumerate(batch.column(n).to_pylist()):
                t, v = (batch.column(n + 1 + j)[i].values.to_numpy(zero_copy_only=False) for j in range(2))
                k = np.arange(max(0, no * per), min(count, (no + 1) * per))
                grid = lo + k * step
                first, last = np.searchsorted(t, grid - half, "left"), np.searchsorted(t, grid + half, "right")
                for g, a, b in zip(grid.tolist(), first.tolist(), last.tolist(), strict=True):
                    if b - a >= max(1, nmin):
                        rows.append(i)
                        times.append(g)
                        found.append(np.quantile(v[a:b], shares))
            which = pa.array(rows, pa.int64())
            cols = np.array(found).reshape(-1, len(shares)).T
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(which) for j in range(n)), pa.array(times, pa.float64()), *(pa.array(c, pa.float64()) for c in cols)], [*by, "grid_time", *names])

    schema = T.StructType([*(packed.schema[c] for c in by), *(T.StructField(c, T.DoubleType()) for c in ("grid_time", *names))])
    return regular_grid(keys, lo, hi, step).join(packed.mapInArrow(run, schema), [*by, "grid_time"], "left")


def iqr_rolling(events: DataFrame, keys: DataFrame, lo: float, hi: float, step: float, win: float, value: str, by: Sequence[str] = (), nmin: int = 1) -> DataFrame:
    return quantile_rolling(events, keys, lo, hi, step, win, value, {"low": 0.25, "mid": 0.5, "high": 0.75}, by, nmin).withColumn("iqr", F.col("high") - F.col("low"))


def rate_rolling_gauss(events: DataFrame, keys: DataFrame, lo: float, hi: float, step: float, sigma: float, by: Sequence[str] = (), time: str = "ref_time", width: float = 5.0) -> DataFrame:
    """Rate in Hz under a Gaussian kernel cut at `width` sigmas."""
    d = (F.col("grid_time") - F.col(time)) / F.lit(float(sigma))
    kernel = F.sum(F.exp(-0.5 * d * d)) / F.lit(math.sqrt(2 * math.pi) * sigma) * 1000.0
    return rolling(events, keys, lo, hi, step, 2 * width * sigma, [kernel.alias("rate")], by, time).fillna({"rate": 0.0})


def lookup(events: DataFrame, samples: DataFrame, by: Sequence[str] = (), time: str = "ref_time", sample_time: str = "time", value: str = "value", name: str = "value", clamp: bool = False) -> DataFrame:
    """A signal's value at each event, linearly interpolated."""
    return interpolate_at(events, samples, left_time=time, right_time=sample_time, value=value, by=by, name=name, clamp=clamp)


def nearest_value(events: DataFrame, samples: DataFrame, by: Sequence[str] = (), time: str = "ref_time", sample_time: str = "time", value: str = "value", name: str = "value") -> DataFrame:
    return asof(events, samples, left_time=time, right_time=sample_time, value=value, by=by, direction="nearest", name=name)


def sample_uniformly(events: DataFrame, on: str, lo: float, hi: float, count: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The events nearest to `count` evenly spaced values, each once; of two as near the one of smaller id."""
    step = (hi - lo) / max(1, count - 1)
    goals = F.expr(f"transform(sequence(0, {count - 1}), i -> {float(lo)}D + i * {step!r}D)")
    each = events.where(F.col(on).isNotNull()).withColumn("__g", F.explode(goals))
    best = each.groupBy(*by, "__g").agg(F.min_by("event_id", F.struct(F.abs(F.col(on) - F.col("__g")), F.col("event_id"))).alias("event_id"))
    return events.join(best.select(*by, "event_id").distinct(), [*by, "event_id"], "left_semi")


def locate_within(events: DataFrame, wins: DataFrame, by: Sequence[str] = (), time: str = "ref_time") -> DataFrame:
    """All events with win_idx, category and delay of the window of their series that holds them; null where none does."""
    cols = [c for c in ("win_idx", "cat", "ref", "start", "stop") if c in wins.columns]
    hit = range_join(events, wins.where("stop > start").select(*by, *cols), time=time, by=by, how="left")
    return hit.withColumn("delay", F.col(time) - F.col("ref")).drop("ref", "start", "stop")


def crop(events: DataFrame, lo: float, hi: float, time: str = "ref_time", reset: bool = False) -> DataFrame:
    out = events.where(F.col(time).between(lo, hi))
    return out.withColumn(time, F.col(time) - F.lit(float(lo))) if reset else out


def extract(events: DataFrame, wins: DataFrame, by: Sequence[str] = (), time: str = "ref_time", align: str | None = None, copy: Sequence[str] = ()) -> DataFrame:
    """The events inside windows of their series, with columns of the window, times re-referenced to it."""
    own = wins.where("stop > start").select(*by, "start", "stop", "ref", "win_idx", *copy)
    hit = range_join(events, own, time=time, by=by)
    if align:
        hit = hit.withColumn(time, F.col(time) - F.col(align))
    return hit.drop("start", "stop", "ref")


def shift_time(events: DataFrame, shift: Column | float, cols: Sequence[str] = ("ref_time",)) -> DataFrame:
    s = shift if isinstance(shift, Column) else F.lit(float(shift))
    return events.withColumns({c: F.col(c) + s for c in cols})


def combine(a: DataFrame, b: DataFrame, order: Sequence[str] = ("ref_time",)) -> DataFrame:
    """Both, numbered anew in order."""
    both = a.drop("event_id").unionByName(b.drop("event_id"), allowMissingColumns=True)
    return number_rows(both, order, "event_id")


def global_win(events: DataFrame, by: Sequence[str] = (), time: str = "ref_time") -> DataFrame:
    return events.groupBy(*by).agg(F.min(time).alias("start"), F.max(time).alias("stop"))
