"""Correlations of packed traces: each trace, or pair of traces, is a row of arrays, and a kernel takes many rows in one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .signals import apply_traces

#: Points that a template has at most: it is one row, which is sent to all executors.
TEMPLATE_POINTS = 1 << 16


def numbered(traces: DataFrame, key: Sequence[str] = ("trace_idx",)) -> DataFrame:
    """Samples with their number from 0 in time order."""
    return traces.withColumn("i", (F.row_number().over(Window.partitionBy(*key).orderBy("time")) - 1).cast("long"))


def lagged_sums(x: np.ndarray, y: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sums of x[i] * y[i + lag] for each lag from low to high; by the Fourier transform where that is less work. Lags without any pair have none (NaN)."""
    n, m = len(x), len(y)
    lags = np.arange(low, high + 1)
    if n * len(lags) > 1 << 16:
        size = 1 << int(n + m - 1).bit_length()
        whole = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
        out = whole[lags % size]
    else:
        out = np.array([x[max(0, -k) : max(0, min(n, m - k))] @ y[max(0, k) : max(0, min(m, n + k))] for k in lags])
    return np.where((lags < m) & (lags > -n), out, np.nan)


def _centred(v: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Values less their mean, missing ones zero; their sum of squares, and how many there are."""
    known = ~np.isnan(v)
    c = np.where(known, v - (v[known].mean() if known.any() else 0.0), 0.0)
    return c, float(c @ c), int(known.sum())


def auto_corr(traces: DataFrame, max_lag: int, key: Sequence[str] = ("trace_idx",), ddof: int = 1) -> DataFrame:
    """Correlation of a trace with itself at lags 0..max_lag, over var * n; with ddof 1 lag 0 is (n - 1) / n."""

    def f(t, v, r):
        c, squares, n = _centred(v)
        norm = squares / (n - ddof) * n if n > ddof and squares > 0 else np.nan
        sums = lagged_sums(c, c, 0, min(max_lag, len(v) - 1))
        return {"lag": np.arange(len(sums)), "corr": sums / norm}

    got = apply_traces(traces, f, "lag double, corr double", key)
    return got.withColumn("lag", F.col("lag").cast("long"))


def _pair_arrays(traces: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """left, right and the values of both in time order."""
    packed = traces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("__s")).select(key, F.transform("__s", lambda s: s["value"].cast("double")).alias("v"))
    a = pairs.select("left", "right").join(packed.select(F.col(key).alias("left"), F.col("v").alias("x")), "left")
    return a.join(packed.select(F.col(key).alias("right"), F.col("v").alias("y")), "right").select("left", "right", "x", "y")


def _over_pairs(both: DataFrame, f: Callable[[np.ndarray, np.ndarray], tuple], names: Sequence[str], types: Sequence[str]) -> DataFrame:
    """f(x, y) of each pair gives columns of equal length."""
    arrow = {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.r_[0, np.cumsum(batch.column(i).value_lengths().to_numpy(zero_copy_only=False))] for i in (2, 3)]
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            found = [f(x[a:b], y[c:d]) for a, b, c, d in zip(ends[0], ends[0][1:], ends[1], ends[1][1:], strict=False)]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(z[0]) for z in found]))
            flat = [pa.array(np.concatenate([np.asarray(z[i], float if t == "double" else np.int64) for z in found]) if found else [], arrow[t], from_pandas=True) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *flat], ["left", "right", *names])

    schema = T.StructType([both.schema["left"], both.schema["right"], *(T.StructField(n, T.LongType() if t == "long" else T.DoubleType()) for n, t in zip(names, types, strict=True))])
    return both.mapInArrow(run, schema)


def cross_corr(traces: DataFrame, pairs: DataFrame, max_lag: int, key: str = "trace_idx", pearson: bool = True) -> DataFrame:
    """Correlation of pairs (left, right) of traces at lags -max_lag..max_lag: sum of x[i] * y[i + lag], centred and over sqrt(var * var) * n if pearson."""

    def f(x, y):
        low, high = max(-max_lag, 1 - len(x)), min(max_lag, len(y) - 1)
        if not pearson:
            return np.arange(low, high + 1), lagged_sums(np.nan_to_num(x), np.nan_to_num(y), low, high)
        (a, s, n), (b, q, m) = _centred(x), _centred(y)
        norm = np.sqrt(s / (n - 1) * q / (m - 1)) * n if n > 1 and m > 1 and s > 0 and q > 0 else np.nan
        return np.arange(low, high + 1), lagged_sums(a, b, low, high) / norm

    return _over_pairs(_pair_arrays(traces, pairs, key), f, ["lag", "corr"], ["long", "double"])


def _row_corr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row of x with the same row of y; pairs with a missing value don't count."""
    known = ~(np.isnan(x) | np.isnan(y))
    n = known.sum(axis=1)
    x, y = np.where(known, x, 0.0), np.where(known, y, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.where(known, x - (x.sum(axis=1) / n)[:, None], 0.0)
        b = np.where(known, y - (y.sum(axis=1) / n)[:, None], 0.0)
        return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def cross_corr_rolling(traces: DataFrame, pairs: DataFrame, lags: Sequence[int], win: int, step: int, key: str = "trace_idx") -> DataFrame:
    """Pearson correlation of pairs within sliding windows of `win` samples, `step` apart, with the right trace shifted by each lag."""
    lags = [int(k) for k in lags]

    def f(x, y):
        out: list[list] = [[], [], []]
        if len(x) >= win and len(y) >= win:
            u, v = (np.lib.stride_tricks.sliding_window_view(z, win) for z in (x, y))
            starts = np.arange(0, len(u), step)
            for k in lags:
                own = np.flatnonzero((starts + k >= 0) & (starts + k < len(v)))
                for at in np.array_split(own, 1 + len(own) * win // (1 << 20)):
                    out[0].append(at)
                    out[1].append(np.full(len(at), k))
                    out[2].append(_row_corr(u[starts[at]], v[starts[at] + k]))
        return tuple(np.concatenate(z) if z else np.zeros(0) for z in out)

    got = _over_pairs(_pair_arrays(traces, pairs, key), f, ["win_no", "lag", "corr"], ["long", "long", "double"])
    return got.withColumn("center", F.col("win_no") * step + (win - 1) / 2)


def sliding_products(traces: DataFrame, pairs: DataFrame, lags: Sequence[int], win: int, step: int, kernel: Sequence[float] | None = None, key: str = "trace_idx") -> DataFrame:
    """Sums of products of pairs within sliding windows, the right trace shifted by each lag, weighted over the window by a kernel; windows
    that aren't whole at some lag have no value at any."""
    lags = [int(k) for k in lags]
    weights = np.ones(win) if kernel is None else np.asarray(kernel, float)
    if len(weights) != win:
        raise ValueError("a kernel is as long as the window")

    def f(x, y):
        if len(x) < win or len(y) < win:
            return tuple(np.zeros(0) for _ in range(3))
        u, v = (np.lib.stride_tricks.sliding_window_view(np.nan_to_num(z), win) for z in (x, y))
        no = np.arange(0, -(-len(u) // step))
        starts = no * step
        able = (starts + min(*lags, 0) >= 0) & (starts + max(*lags, 0) < len(v))
        no, starts = no[able], starts[able]
        found = [np.einsum("nw,nw,w->n", u[starts], v[starts + k], weights) for k in lags]
        return np.tile(no, len(lags)), np.repeat(lags, len(no)), np.concatenate(found) if found else np.zeros(0)

    return _over_pairs(_pair_arrays(traces, pairs, key), f, ["win_no", "lag", "product"], ["long", "long", "double"])


def pairs_within(reg: DataFrame, by: Sequence[str], key: str = "trace_idx", itself: bool = False) -> DataFrame:
    """(left, right) of all traces that share the columns `by`, each pair once; with `itself` each trace with itself as well."""
    a, b = reg.select(F.col(key).alias("left"), *by), reg.select(F.col(key).alias("right"), *by)
    both = a.join(b, list(by))
    return both.where("left <= right" if itself else "left < right").select("left", "right")


def best_lag(corr: DataFrame, by: Sequence[str], lag: str = "lag", value: str = "corr") -> DataFrame:
    """The lag of the largest value; of equal ones the smallest lag."""
    got = corr.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(lag)).alias("l"))).alias("__b"))
    return got.select(*by, (-F.col("__b.l")).alias("best_lag"), F.col("__b.v").alias("best_corr"))


def slide_template(traces: DataFrame, template: DataFrame, method: str = "pearson", key: Sequence[str] = ("trace_idx",), precision: np.ndarray | None = None) -> DataFrame:
    """Scores of a template (k from 0, t and optionally var) at each whole offset of each trace: pearson, corr, wmse, wmse_l1, or
    fullcov, the squared distance under a precision matrix of the template's size.

    The template becomes one row of TEMPLATE_POINTS at most, more are an error; it is sent to the packed traces.
    """
    points = F.array_sort(F.collect_list(F.struct("k", F.col("t").cast("double").alias("t"), (F.col("var").cast("double") if "var" in template.columns else F.lit(1.0)).alias("var"))))
    one = template.agg(points.alias("__p")).select(F.when(F.size("__p") > TEMPLATE_POINTS, F.raise_error(F.lit("the template is too long"))).otherwise(F.col("__p")).alias("__p"))
    one = one.select(F.transform("__p", lambda z: z["t"]).alias("__t"), F.transform("__p", lambda z: z["var"]).alias("__var"))
    packed = traces.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("__s")).select(*key, F.transform("__s", lambda z: z["value"].cast("double")).alias("__v"))

    def score(x: np.ndarray, t: np.ndarray, var: np.ndarray) -> np.ndarray:
        if method == "pearson":
            return _row_corr(x, np.broadcast_to(t, x.shape))
        if method == "corr":
            return np.nansum(x * t, axis=1)
        if method == "fullcov":
            return -np.einsum("ni,ij,nj->n", x - t, precision, x - t) / len(t)
        known = ~np.isnan(x)
        d = np.where(known, x - t, 0.0)
        return -(d * d / var if method == "wmse" else np.abs(d) / np.sqrt(var)).sum(axis=1) / len(t)

    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, t, var = (batch.column(n + j)[i].values.to_numpy(zero_copy_only=False) for j in range(3))
                if not len(t) or len(v) < len(t):
                    continue
                view = np.lib.stride_tricks.sliding_window_view(v, len(t))
                size = max(1, (1 << 20) // len(t))
                found = np.concatenate([score(view[a : a + size], t, var) for a in range(0, len(view), size)])
                rows = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(rows) for j in range(n)), pa.array(np.arange(len(found))), pa.array(found, from_pandas=True)], [*key, "offset", "score"])

    schema = T.StructType([*(packed.schema[c] for c in key), T.StructField("offset", T.LongType()), T.StructField("score", T.DoubleType())])
    return packed.crossJoin(F.broadcast(one)).mapInArrow(run, schema)  # one row


def _in_blocks(df: DataFrame, key: str | None, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows packed into arrays, one row for each Arrow batch."""
    picked = df.select(*([F.col(key)] if key else []), *[F.col(c).cast("double").alias(c) for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                offsets = pa.array([0, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, batch.column(i)) for i in range(batch.num_columns)], list(names))

    return picked.mapInArrow(run, T.StructType([T.StructField(n, T.ArrayType(f.dataType)) for n, f in zip(names, picked.schema.fields, strict=True)]))


def dominance_cdf(this: DataFrame, null: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """The share of null rows that are at least as large in all features.

    A stated query set against all of a null sample: a comparison in every feature has no key to deal by, so that blocks of rows of the one meet
    blocks of the other, and a kernel compares all of two blocks.
    """
    d, sides = len(cols), 1 << 8
    a = _in_blocks(this, key, cols, ["__key", *[f"__a{i}" for i in range(d)]])
    b = _in_blocks(null, None, cols, [f"__b{i}" for i in range(d)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, *values = (batch.column(i)[row].values for i in range(2 * d + 1))
                x, y = (np.stack([v.to_numpy(zero_copy_only=False) for v in values[k : k + d]], axis=1) for k in (0, d))
                n = [(y[None] >= x[s : s + sides, None]).all(axis=2).sum(axis=1) for s in range(0, len(x), sides)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(n).astype(np.int64))], [key, "__n"])

    counted = a.crossJoin(b).mapInArrow(run, T.StructType([this.schema[key], T.StructField("__n", T.LongType())])).groupBy(key).agg(F.sum("__n").alias("__n"))
    total = null.agg(F.count("*").alias("__total"))
    got = this.select(key).distinct().join(counted, key, "left").crossJoin(F.broadcast(total))  # one row
    return got.select(key, F.try_divide(F.coalesce("__n", F.lit(0)).cast("double"), F.col("__total")).alias("cdf"))


def lag_histogram(best: DataFrame, by: Sequence[str] = (), lag: str = "best_lag") -> DataFrame:
    """Counts and shares of unit-wide bins of lags."""
    got = best.groupBy(*by, F.floor(lag).alias("lag")).agg(F.count("*").alias("count"))
    w = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)]))
    return got.withColumn("share", F.col("count") / F.sum("count").over(w))
