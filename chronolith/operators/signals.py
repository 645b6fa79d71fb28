"""Signal processing of traces: each trace is one group of an Arrow-batched kernel, so traces run side by side.

A recording too long for one task is worked on in chunks of time (`chunk_ms`): each chunk takes a margin of its neighbours' samples
along, as long as the kernel reaches, and only what lies in the chunk itself is kept. Whatever the length of a trace, a task holds one
chunk and its margins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K

#: Default frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "beta": (10.0, 30.0), "gamma": (30.0, 80.0)}


def _key_schema(traces: DataFrame, key: Sequence[str]) -> str:
    return ", ".join(f"{c} {traces.schema[c].dataType.simpleString()}" for c in key)


def in_chunks(traces: DataFrame, chunk_ms: float, margin_ms: float) -> DataFrame:
    """Samples with the number of each chunk that they belong to, or lie in the margin of."""
    at = lambda t: F.floor(t / F.lit(float(chunk_ms)))
    return traces.withColumn("chunk", F.explode(F.sequence(at(F.col("time") - F.lit(float(margin_ms))), at(F.col("time") + F.lit(float(margin_ms))))))


def apply_traces(traces: DataFrame, f: Callable[[np.ndarray, np.ndarray, float], dict], out: str, key: Sequence[str] = ("trace_idx",), chunk_ms: float | None = None, margin_ms: float = 0.0, time: str = "time") -> DataFrame:
    """f(times, values, rate in Hz) of each trace, in time order, gives the columns of `out`.

    Traces are packed into arrays by the engine, so that a Python worker takes many of them in one Arrow batch. With `chunk_ms` f sees a
    chunk and its margins at a time, and rows whose `time` lies in the margins are left out.
    """
    if chunk_ms:
        some = in_chunks(traces.select(*key, "time", "value"), chunk_ms, margin_ms)
        got = apply_traces(some, f, out, (*key, "chunk"))
        return got.where(F.floor(F.col(time) / F.lit(float(chunk_ms))) == F.col("chunk")).drop("chunk")
    names = [x.split() for x in out.split(", ")]
    types = {"double": pa.float64(), "string": pa.string(), "long": pa.int64()}
    sorted_samples = F.array_sort(F.collect_list(F.struct("time", "value")))
    packed = traces.select(*key, "time", "value").groupBy(*key).agg(sorted_samples.alias("__s"))
    packed = packed.select(*key, F.transform("__s", lambda x: x["time"].cast("double")).alias("__t"), F.transform("__s", lambda x: x["value"].cast("double")).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t_col, v_col = batch.column(len(key)), batch.column(len(key) + 1)
            ends = np.r_[0, np.cumsum(t_col.value_lengths().to_numpy(zero_copy_only=False))]
            t_all, v_all = (c.flatten().to_numpy(zero_copy_only=False) for c in (t_col, v_col))
            parts: list[list] = [[] for _ in names]
            sizes = []
            for a, b in zip(ends, ends[1:], strict=False):
                t, v = t_all[a:b], v_all[a:b]
                got = f(t, v, 1000.0 / np.median(np.diff(t)) if len(t) > 1 else 1.0)
                for column, (name, _) in zip(parts, names, strict=True):
                    column.append(got[name])
                sizes.append(len(got[names[0][0]]))
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            keys = [batch.column(i).take(rows) for i in range(len(key))]
            flat = [pa.array([x for p in column for x in p], pa.string()) if kind == "string" else pa.array(np.concatenate([np.asarray(p, float) for p in column]) if column else [], types[kind], from_pandas=True) for column, (_, kind) in zip(parts, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, *flat], [*key, *(n for n, _ in names)])

    return packed.mapInArrow(run, f"{_key_schema(traces, key)}, {out}")


def margin_of(rate: float, hz, kind: str, order: int = 2) -> float:
    """The margin in ms that a zero-phase filter needs at a sampling rate."""
    return 1000.0 * K.settling(rate, hz, kind, order) / rate


def filter_pass(traces: DataFrame, kind: str, hz, order: int = 2, key: Sequence[str] = ("trace_idx",), chunk_ms: float | None = None, rate: float = 1000.0) -> DataFrame:
    """low, high or band pass, Butterworth, zero phase. In chunks the margin follows from the filter at the given rate."""
    margin = margin_of(rate, hz, kind, order) if chunk_ms else 0.0
    return apply_traces(traces, lambda t, v, r: {"time": t, "value": K.pass_filter(v, r, hz, kind, order)}, "time double, value double", key, chunk_ms, margin)


def low_pass(traces: DataFrame, hz: float, **more) -> DataFrame:
    return filter_pass(traces, "low", hz, **more)


def high_pass(traces: DataFrame, hz: float, **more) -> DataFrame:
    return filter_pass(traces, "high", hz, **more)


def band_pass(traces: DataFrame, lo: float, hi: float, **more) -> DataFrame:
    return filter_pass(traces, "band", (lo, hi), **more)


def spectrogram(traces: DataFrame, size: int = 256, overlap: int = 128, window: str = "hann", db: bool = True, key: Sequence[str] = ("trace_idx",)) -> DataFrame:
    """(time of the segment's centre in ms, freq, value)."""

    def f(t, v, r):
        n = min(size, len(v))
        w = K.hann(n) if window == "hann" else K.tukey(n)
        freq, at, p = K.segments_power(v, r, n, min(overlap, n - 1), w)
        p = K.decibels(p) if db else p
        return {"time": np.repeat(t[0] + at * 1000, len(freq)), "freq": np.tile(freq, len(at)), "value": p.ravel()}

    return apply_traces(traces, f, "time double, freq double, value double", key)


def wavelet(traces: DataFrame, freqs: Sequence[float], key: Sequence[str] = ("trace_idx",)) -> DataFrame:
    def f(t, v, r):
        return {"time": np.tile(t, len(freqs)), "freq": np.repeat(freqs, len(t)), "value": K.wavelet(v, r, np.asarray(freqs, float)).ravel()}

    return apply_traces(traces, f, "time double, freq double, value double", key)


def welch(traces: DataFrame, size: int = 256, db: bool = False, key: Sequence[str] = ("trace_idx",)) -> DataFrame:
    def f(t, v, r):
        freq, p = K.welch(v, r, size)
        return {"freq": freq, "value": K.decibels(p) if db else p}

    return apply_traces(traces, f, "freq double, value double", key)


def band_power(traces: DataFrame, bands: dict[str, tuple[float, float]] | None = None, size: int = 256, key: Sequence[str] = ("trace_idx",)) -> DataFrame:
    def f(t, v, r):
        got = K.band_power(v, r, bands or BANDS, size)
        return {"band": list(got), "power": list(got.values())}

    return apply_traces(traces, f, "band string, power double", key)


def sliding(traces: DataFrame, length_ms: float, step_ms: float, f: Callable[[np.ndarray, float], dict[str, float]], name: str = "feature", key: Sequence[str] = ("trace_idx",), chunk_ms: float | None = None, origin: float | None = None) -> DataFrame:
    """Features of sliding windows, at the window's centre. Windows begin with the trace, or at whole steps from `origin`, as they must in chunks."""
    if chunk_ms and origin is None:
        raise ValueError("windows of chunks need an origin")

    def run(t, v, r):
        n, step = max(1, round(length_ms * r / 1000)), max(1, round(step_ms * r / 1000))
        first = 0 if origin is None or not len(t) else int(-round((t[0] - origin) * r / 1000) % step)
        out = [(t[s] + (t[s + n - 1] - t[s]) / 2, k, x) for s in range(first, len(v) - n + 1, step) for k, x in f(v[s : s + n], r).items()]
        return {"time": [o[0] for o in out], name: [o[1] for o in out], "value": [o[2] for o in out]}

    return apply_traces(traces, run, f"time double, {name} string, value double", key, chunk_ms, length_ms)


def band_power_rolling(traces: DataFrame, length_ms: float, step_ms: float, bands: dict[str, tuple[float, float]] | None = None, size: int = 256, key: Sequence[str] = ("trace_idx",), chunk_ms: float | None = None, origin: float | None = None) -> DataFrame:
    return sliding(traces, length_ms, step_ms, lambda v, r: K.band_power(v, r, bands or BANDS, size), "band", key, chunk_ms, origin)


def welch_rolling(traces: DataFrame, length_ms: float, step_ms: float, size: int = 256, key: Sequence[str] = ("trace_idx",), chunk_ms: float | None = None, origin: float | None = None) -> DataFrame:
    """Power densities of sliding windows: time of the centre, freq, value."""
    got = sliding(traces, length_ms, step_ms, lambda v, r: {repr(float(k)): x for k, x in zip(*K.welch(v, r, size), strict=True)}, "freq", key, chunk_ms, origin)
    return got.withColumn("freq", F.col("freq").cast("double"))


def default_welch_size(length_ms: float, rate: float, lowest_hz: float = 0.5) -> int:
    """Samples of a Welch segment: two cycles of the lowest frequency, or the whole window if it is shorter."""
    return max(1, round(min(length_ms, 2000.0 / lowest_hz) * rate / 1000))


def hilbert(traces: DataFrame, hz: tuple[float, float] | None = None, key: Sequence[str] = ("trace_idx",)) -> DataFrame:
    """real, imag, power, and phase in [0, 1)."""

    def f(t, v, r):
        x = K.pass_filter(v, r, hz, "band") if hz else v - np.nanmean(v)
        z = K.analytic(np.nan_to_num(x))
        return {"time": t, "re": z.real, "im": z.imag, "power": np.abs(z) ** 2, "phase": np.mod(np.angle(z) / (2 * np.pi), 1.0)}

    return apply_traces(traces, f, "time double, re double, im double, power double, phase double", key)


def find_peaks(traces: DataFrame, negative: bool = False, key: Sequence[str] = ("trace_idx",), **limits) -> DataFrame:
    """time, height, prominence and width (in samples) of each peak, or trough."""

    def f(t, v, r):
        got = K.find_peaks(-v if negative else v, **limits)
        return {"time": t[got["idx"]], "height": -got["height"] if negative else got["height"], "prominence": got["prominence"], "width": got["width"]}

    return apply_traces(traces, f, "time double, height double, prominence double, width double", key)


def find_sharp_waves(traces: DataFrame, low_hz: float, factor: int, height: float = 2.0, prominence: float = 1.0, width: float | None = None, key: Sequence[str] = ("trace_idx",)) -> DataFrame:
    """Low-passed, decimated and z-scored, then troughs."""

    def f(t, v, r):
        x = K.pass_filter(v, r, low_hz, "low")[::factor]
        z = -(x - np.nanmean(x)) / np.nanstd(x) if np.nanstd(x) > 0 else np.zeros(len(x))
        got = K.find_peaks(z, height=height, prominence=prominence, width=width)
        return {"time": t[::factor][got["idx"]], "height": got["height"], "prominence": got["prominence"]}

    return apply_traces(traces, f, "time double, height double, prominence double", key)


def sharp_negative_events(traces: DataFrame, band: tuple[float, float], key: Sequence[str] = ("trace_idx",), chunk_ms: float | None = None, rate: float = 1000.0, edge_ms: float = 1000.0) -> DataFrame:
    """Start, reference and stop of sharp negative deflections: a trough of acceleration, of speed, and a peak of acceleration in a row.

    In chunks an event belongs to the chunk of its reference; the margin is the filter's, and `edge_ms` more for the event's edges.
    """

    def f(t, v, r):
        x = K.pass_filter(v, r, band, "band")
        speed = np.gradient(x)
        acc = np.gradient(speed)
        up = lambda y: K.find_peaks(y, height=0.0)["idx"]
        kinds = [(up(-acc), "start", acc), (up(-speed), "ref", speed), (up(acc), "stop", acc)]
        all_marks = sorted((int(i), k, float(y[i])) for idx, k, y in kinds for i in idx)
        out = [(a, b, c) for a, b, c in zip(all_marks, all_marks[1:], all_marks[2:], strict=False) if (a[1], b[1], c[1]) == ("start", "ref", "stop")]
        at = lambda j: t[[o[j][0] for o in out]] if out else np.zeros(0)
        return {"start_time": at(0), "ref_time": at(1), "stop_time": at(2), "start_acc": [o[0][2] for o in out], "ref_speed": [o[1][2] for o in out], "stop_acc": [o[2][2] for o in out], "amplitude": x[[o[1][0] for o in out]] if out else np.zeros(0)}

    return apply_traces(traces, f, "start_time double, ref_time double, stop_time double, start_acc double, ref_speed double, stop_acc double, amplitude double", key, chunk_ms, margin_of(rate, band, "band") + edge_ms if chunk_ms else 0.0, "ref_time")


def merge_sandwiched(wins: DataFrame, by: Sequence[str], max_length: float = float("inf"), only: str | None = None, col: str = "cat") -> DataFrame:
    """Short windows between two of one other category are merged into them until none is left. Order decides, so a series is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "stop"], kind="stable")
        a, b, c = K.merge_sandwiched(pdf["start"].to_numpy(float), pdf["stop"].to_numpy(float), pdf[col].to_numpy(object), max_length, only)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(a) for k in by})
        return out.assign(start=a, stop=b, **{col: c})

    return wins.select(*by, "start", "stop", col).groupBy(*by).applyInPandas(run, f"{_key_schema(wins, by)}, start double, stop double, {col} string")


def match_events(pairs: DataFrame, by: Sequence[str], ahead: int = 1000) -> DataFrame:
    """The heaviest order-preserving one-to-one matching among candidate pairs (event0, t0, event1, t1, score) of each series.

    A series is cut wherever all pairs so far lie before all later ones in both times: a chain is the best one on each side
    of such a cut, so that what one task holds is a stretch without a cut and not a recording.
    """
    cols = ["event0", "t0", "event1", "t1", "score"]
    w = Window.partitionBy(*by).orderBy("t0", "t1")
    upto = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min("t1").over(w.rowsBetween(1, Window.unboundedFollowing))
    cut = pairs.select(*by, *cols).withColumn("__cut", F.coalesce((upto < after) & (F.col("t0") < F.lead("t0").over(w)), F.lit(False)).cast("int"))
    part = F.coalesce(F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    packed = cut.withColumn("__part", part).groupBy(*by, "__part").agg(F.array_sort(F.collect_list(F.struct(F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), "event0", "event1", F.col("score").cast("double").alias("score")))).alias("__s"))
    field = lambda c: F.transform("__s", lambda x: x[c])
    flat = packed.select(*by, "__s", field("t0").alias("__t0"), field("t1").alias("__t1"), field("score").alias("__w"))
    n = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(n + i) for i in range(3)]
            ends = np.r_[0, np.cumsum(arrays[0].value_lengths().to_numpy(zero_copy_only=False))]
            t0, t1, score = (x.flatten().to_numpy(zero_copy_only=False) for x in arrays)
            kept = [K.best_path(t0[a:b], t1[a:b], score[a:b], ahead) for a, b in zip(ends, ends[1:], strict=False)]
            places = pa.array([k.tolist() for k in kept], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), places], [*by, "__s", "__kept"])

    schema = T.StructType([f for f in flat.schema.fields if f.name in (*by, "__s")]).add("__kept", T.ArrayType(T.IntegerType()))
    found = flat.mapInArrow(run, schema).select(*by, "__s", F.explode("__kept").alias("__i"))
    return found.select(*by, *[F.col("__s")[F.col("__i")][c].alias(c) for c in cols])


def candidate_pairs(a: DataFrame, b: DataFrame, lag: tuple[float, float], by: Sequence[str], width: float) -> DataFrame:
    """Events of two channels whose time difference lies in a band: a join on time buckets."""
    left = a.select(*by, F.col("event_id").alias("event0"), F.col("ref_time").alias("t0"), F.col("score").alias("s0"), (F.col("ref_time") + lag[0]).alias("__lo"), (F.col("ref_time") + lag[1]).alias("__hi"))
    from .joins import range_join

    right = b.select(*by, F.col("event_id").alias("event1"), F.col("ref_time").alias("t1"), F.col("score").alias("s1"))
    return range_join(right, left, time="t1", start="__lo", stop="__hi", by=by, closed="both", width=width).drop("__lo", "__hi")


def group_pulses(wins: DataFrame, by: Sequence[str], max_interval: float, precision: float) -> DataFrame:
    """Pulses with the number of their train."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "stop"], kind="stable")
        return pdf.assign(train=K.pulse_trains(pdf["start"].to_numpy(float), (pdf["stop"] - pdf["start"]).to_numpy(float), max_interval, precision))

    cols = [*by, "start", "stop"]
    return wins.select(*cols).groupBy(*by).applyInPandas(run, f"{_key_schema(wins, by)}, start double, stop double, train long")
