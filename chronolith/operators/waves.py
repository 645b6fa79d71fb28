"""Waveforms: templates and their peaks, sharp events with their matches, lags of best correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import correlation as C
from . import signals as G
from .joins import neighbours, range_join

# --- templates ----------------------------------------------------------------------------------------------------


def closest_peak(peaks: DataFrame, times: DataFrame, by: Sequence[str] = (), peak: str = "peak", time: str = "time") -> DataFrame:
    """Each time with the nearest peak of its series, of two equally near ones the earlier."""
    marks = peaks.select(*by, F.col(peak).cast("double").alias("__at"), F.col(peak).cast("double").alias("__v"))
    n = neighbours(times, marks, left_time=time, right_time="__at", value="__v", by=by)
    t = F.col(time)
    near = F.when(F.col("t1").isNull() | (t - F.col("t0") <= F.col("t1") - t), F.col("t0")).otherwise(F.col("t1"))
    return n.withColumn(peak, near).drop("t0", "v0", "t1", "v1")


def template_peaks(traces: DataFrame, template: DataFrame, size: int, method: str = "pearson", key: Sequence[str] = ("trace_idx",), span: int = 100) -> DataFrame:
    """Peaks of a template's scores over each trace, at least half a template apart: time (the offset), height, prominence, width."""
    scores = C.slide_template(traces, template, method, key)
    return G.find_peaks(scores.select(*key, F.col("offset").cast("double").alias("time"), F.col("score").alias("value")), key=key, distance=max(1, size // 2), span=span)


def find_template(traces: DataFrame, template: DataFrame, size: int, method: str = "pearson", key: Sequence[str] = ("trace_idx",), height: tuple = (float("-inf"), float("inf")), width: tuple = (float("-inf"), float("inf")), prominence: tuple = (float("-inf"), float("inf")), span: int = 100) -> DataFrame:
    """Where a template occurs: peaks of its scores, `valid` by their ranges, and `null_cdf`, the share of the peaks of the
    trace turned upside down that are at least as high, as narrow and as prominent."""
    found = template_peaks(traces, template, size, method, key, span)
    noise = template_peaks(traces.withColumn("value", -F.col("value")), template, size, method, key, span)
    found = found.withColumn("valid", F.col("height").between(*height) & F.col("width").between(*width) & F.col("prominence").between(*prominence))
    turned = lambda df: df.withColumn("narrow", -F.col("width"))
    return dominance(turned(found), turned(noise), ("height", "narrow", "prominence"), key, ("time",)).drop("narrow")


def dominance(this: DataFrame, null: DataFrame, cols: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`null_cdf`: the share of the null rows of the same series that are at least as large in all features.

    Both sides are dealt by the series, and one with many rows by blocks of its own rows as well, so that no null sample is compared in one task.
    """
    a = this.withColumn("__id", F.struct(*by, *order))
    b = null.select(*by, *[F.col(c).alias(f"__{c}") for c in cols])
    total = b.groupBy(*by).agg(F.count("*").alias("__total"))
    hit = a.select("__id", *by, *cols).join(b, list(by))
    for c in cols:
        hit = hit.where(F.col(f"__{c}") >= F.col(c))
    n = hit.groupBy("__id").agg(F.count("*").alias("__n"))
    out = a.join(n, "__id", "left").join(total, list(by), "left")
    return out.withColumn("null_cdf", F.try_divide(F.coalesce("__n", F.lit(0)).cast("double"), F.col("__total"))).drop("__id", "__n", "__total")


def cut_waves(traces: DataFrame, marks: DataFrame, pre: float, post: float, hz=None, by: Sequence[str] = ("trace_idx",), mark: str = "mark") -> DataFrame:
    """The samples around each mark, times from it, band-passed each for itself if `hz` is given."""
    wins = marks.select(*by, F.col(mark), (F.col(mark) + pre).alias("__a"), (F.col(mark) + post).alias("__b"))
    cut = range_join(traces, wins, time="time", start="__a", stop="__b", by=by).drop("__a", "__b").withColumn("time", F.col("time") - F.col(mark))
    return G.filter_pass(cut, "band", hz, key=(*by, mark)) if hz else cut.select(*by, mark, "time", "value")


def shift_residual(traces: DataFrame, offsets: DataFrame, n: int, key: str = "trace_idx") -> DataFrame:
    """For each set of offsets (set_no, trace, dx samples around the circle of n, dy) the mean deviation over traces that is left. Traces have i from 0."""
    moved = traces.join(offsets, key).select("set_no", F.pmod(F.col("i") + F.col("dx"), F.lit(n)).alias("i"), (F.col("value") + F.col("dy")).alias("v"))
    return moved.groupBy("set_no", "i").agg(F.stddev_pop("v").alias("s")).groupBy("set_no").agg(F.avg("s").alias("score"))


# --- sharp events -------------------------------------------------------------------------------------------------

#: Columns whose logarithm counts, and the sign that they must have for one.
LOGS = {"duration": 1, "amplitude": -1, "speed": -1, "ref_speed": -1, "start_acc": -1, "stop_acc": 1, "acc_diff": 1}


def add_details(events: DataFrame) -> DataFrame:
    """Duration, differences, times from the reference, and logarithms of what has the sign that it should."""
    out = events.withColumns({"duration": F.col("stop_time") - F.col("start_time"), "acc_diff": F.col("stop_acc") - F.col("start_acc"), "ref_to_stop": F.col("stop_time") - F.col("ref_time"), "ref_to_start": F.col("start_time") - F.col("ref_time")})
    return out.withColumns({f"{c}_log": F.when(F.col(c) * s > 0, F.log10(F.abs(c))) for c, s in LOGS.items() if c in out.columns})


def add_isi(events: DataFrame, by: Sequence[str] = (), time: str = "ref_time") -> DataFrame:
    """isi_next and isi_prev."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(time)
    return events.withColumns({"isi_next": F.lead(time).over(w) - F.col(time), "isi_prev": F.col(time) - F.lag(time).over(w)})


def assign_matches(events: DataFrame, path: DataFrame, cols: Sequence[str] = ("ref_time",), key: str = "event_id", name: str = "match") -> DataFrame:
    """Each event with its partner of a matching (event0, event1), either way round, the partner's columns and their differences."""
    ways = path.select(F.col("event0").alias(key), F.col("event1").alias(name)).union(path.select("event1", "event0"))
    partner = events.select(F.col(key).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    out = events.join(ways, key, "left").join(partner, name, "left")
    return out.withColumns({f"{name}_{c}_diff": F.col(f"{name}_{c}") - F.col(c) for c in cols})


def drop_missing_matches(events: DataFrame, key: str = "event_id", name: str = "match") -> DataFrame:
    """Partners that aren't among the events any more are null; `is_match_valid` tells."""
    there = events.select(F.col(key).alias(name)).distinct().withColumn("is_match_valid", F.lit(True))
    out = events.join(there, name, "left").withColumn("is_match_valid", F.coalesce("is_match_valid", F.lit(False)))
    return out.withColumn(name, F.when(F.col("is_match_valid"), F.col(name)))


def simplified_channels(events: DataFrame, by: Sequence[str] = (), probe: str = "probe", channel: str = "channel") -> DataFrame:
    """`channel` from 0 by the order of (probe, channel) in a recording; the old one is channel_true."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(probe, channel)
    known = events.select(*by, probe, channel).distinct().withColumn("__new", (F.row_number().over(w) - 1).cast("long"))
    return events.join(known, [*by, probe, channel]).withColumnRenamed(channel, "channel_true").withColumnRenamed("__new", channel)


def is_lead(events: DataFrame, name: str = "match") -> DataFrame:
    """Whether an event comes before its partner."""
    return events.withColumn("is_lead", F.coalesce(F.col(f"{name}_ref_time_diff") > 0, F.lit(False)))


def extract_sharp_events(traces: DataFrame, band: tuple[float, float], reference_ms: float, chunk_ms: float, key: Sequence[str] = ("trace_idx",), rate: float = 1000.0, edge_ms: float = 1000.0) -> DataFrame:
    """Sharp negative events of whole recordings, in chunks, with their amplitude in deviations of a window in the middle of the
    recording, and `null_cdf` by the events of that window turned upside down."""
    ext = traces.groupBy(*key).agg(((F.min("time") + F.max("time")) / 2).alias("__m"))
    middle = traces.join(ext, list(key)).where(F.col("time").between(F.col("__m") - reference_ms / 2, F.col("__m") + reference_ms / 2)).drop("__m")
    spread = middle.groupBy(*key).agg(F.stddev_pop("value").alias("__sd"))
    sizes = lambda df: df.withColumns({f"__abs_{c}": F.abs(c) for c in ("start_acc", "stop_acc", "ref_speed")})
    null = sizes(G.sharp_negative_events(middle.withColumn("value", -F.col("value")), band, key))
    found = sizes(G.sharp_negative_events(traces, band, key, chunk_ms, rate, edge_ms))
    cols = [f"__abs_{c}" for c in ("start_acc", "stop_acc", "ref_speed")]
    told = dominance(found, null, cols, key, ("ref_time",)).drop(*cols)
    return told.join(spread, list(key)).withColumn("amplitude_zscored", F.try_divide("amplitude", "__sd")).drop("__sd")


# --- lags of best correlation -------------------------------------------------------------------------------------


def clip_extreme_lags(best: DataFrame, by: Sequence[str] = (), lag: str = "best_lag") -> DataFrame:
    """Without the least and the largest lag, which a short range makes too frequent."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return best.withColumn("__a", F.min(lag).over(w)).withColumn("__b", F.max(lag).over(w)).where(F.col(lag).isNotNull() & (F.col(lag) != F.col("__a")) & (F.col(lag) != F.col("__b"))).drop("__a", "__b")


def sel_corr_quantiles(best: DataFrame, lo: float = 0.0, hi: float = 1.0, by: Sequence[str] = (), value: str = "best_corr") -> DataFrame:
    """Correlations within quantiles of their series, edges included."""
    q = best.groupBy(*by).agg(F.percentile(value, F.lit(lo)).alias("__lo"), F.percentile(value, F.lit(hi)).alias("__hi"))
    both = best.join(q, list(by)) if by else best.crossJoin(F.broadcast(q))  # one row
    return both.where(F.col(value).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def best_lag_shares(best: DataFrame, by: Sequence[str], q: float = 0.75, lag: str = "best_lag", value: str = "best_corr") -> DataFrame:
    """Of each series the shares of lags among its better correlations, extreme lags left out."""
    return C.lag_histogram(sel_corr_quantiles(clip_extreme_lags(best, by, lag), q, 1.0, by, value), by, lag)


def to_diagonal(corr: DataFrame, time: str = "time", lag: str = "lag") -> DataFrame:
    """Correlations by lag and time as by two times: (time0, time1)."""
    return corr.withColumn("time1", F.col(time) + F.col(lag)).withColumnRenamed(time, "time0").drop(lag)
