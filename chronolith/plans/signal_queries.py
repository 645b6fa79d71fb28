"""Queries of traces, correlations, signals, states, spikes and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timeunits as T
from ..operators import correlation as C
from ..operators import signals as G
from ..operators import spikes as P
from ..operators import stack as N
from ..operators import states as D
from ..operators import stats as Y
from ..operators import traces as X
from ..operators import windows as W
from .adapters import ev, spikes, table, tr, tr_reg, units, wbetween, wship
from . import kernel_sql as Q
from .registry import query

BY_GRP = "SELECT grp, time, {} AS value FROM tr JOIN tr_reg USING (trace_idx) GROUP BY grp, time"


def _mixed(how: str):
    return lambda spark, d: X.groupby_mix(tr(spark, d), tr_reg(spark, d), ["grp"], how)


for _how, _sql in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)"), ("std", "stddev_samp(value)"), ("max", "max(value)")):
    _f = _mixed(_how)
    _f.__name__ = f"x_groupby_{_how}"
    query(BY_GRP.format(_sql), "value")(_f)


@query(", q AS (SELECT trace_idx, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM tr GROUP BY trace_idx)\nSELECT trace_idx, time, (value - lo) / (hi - lo) AS value FROM tr JOIN q USING (trace_idx) WHERE hi > lo", "value")
def x_normalize_quantiles(spark, d):
    return X.normalize_by_quantiles(tr(spark, d)).where("value IS NOT NULL")


@query("SELECT trace_idx, time, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM tr WINDOW w AS (PARTITION BY trace_idx)", "value")
def x_zscore(spark, d):
    return X.zscore(tr(spark, d))


CENTRED = "OVER (PARTITION BY trace_idx ORDER BY time ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"


@query(f"SELECT trace_idx, time, (value - avg(value) {CENTRED.format(5, 5)}) / stddev_samp(value) {CENTRED.format(5, 5)} AS value FROM tr", "value")
def x_zscore_rolling(spark, d):
    return X.zscore_rolling(tr(spark, d), 11)


@query(f"SELECT trace_idx, time, avg(value) {CENTRED.format(3, 2)} AS value FROM tr", "value")
def x_mean_rolling(spark, d):
    return X.rolling(tr(spark, d), 6, "mean")


@query(f"SELECT trace_idx, time, quantile_cont(value, 0.5) {CENTRED.format(3, 2)} AS value FROM tr", "value")
def x_median_rolling(spark, d):
    return X.rolling(tr(spark, d), 6, "median")


@query(f"SELECT trace_idx, time, stddev_samp(value) {CENTRED.format(3, 3)} AS value FROM tr", "value")
def x_std_rolling(spark, d):
    return X.rolling(tr(spark, d), 7, "std")


@query(f"SELECT trace_idx, time, sum(value) {CENTRED.format(2, 2)} AS value FROM tr", "value")
def x_sum_rolling(spark, d):
    return X.rolling(tr(spark, d), 5, "sum")


@query("SELECT trace_idx, time, CASE WHEN lag(time) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(time) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS value FROM tr WINDOW w AS (PARTITION BY trace_idx ORDER BY time)", "value")
def x_gradient(spark, d):
    return X.gradient(tr(spark, d))


@query("SELECT trace_idx, time, value - lag(value) OVER (PARTITION BY trace_idx ORDER BY time) AS value FROM tr", "value")
def x_diff(spark, d):
    return X.diff(tr(spark, d))


@query("SELECT trace_idx, time, sum(value) OVER (PARTITION BY trace_idx ORDER BY time ROWS UNBOUNDED PRECEDING) AS value FROM tr", "value")
def x_cumsum(spark, d):
    return X.cumsum(tr(spark, d))


@query("""
, p AS (SELECT trace_idx, time, value * 3 - floor(value * 3) AS value FROM tr),
f AS (SELECT *, value - lag(value) OVER (PARTITION BY trace_idx ORDER BY time) AS dd FROM p)
SELECT trace_idx, time, value + sum(CASE WHEN abs(dd) > 0.5 THEN -floor(dd + 0.5) ELSE 0 END) OVER (PARTITION BY trace_idx ORDER BY time ROWS UNBOUNDED PRECEDING) AS value FROM f""", "value")
def x_unwrap(spark, d):
    wrapped = X.elementwise(tr(spark, d), lambda v: v * 3 - F.floor(v * 3))
    return X.unwrap(wrapped)


@query("SELECT trace_idx, least(floor((value + 1) / 0.1), 19)::BIGINT AS bin, count(*) AS count FROM tr WHERE value BETWEEN -1 AND 1 GROUP BY ALL")
def x_hist(spark, d):
    return X.histograms(tr(spark, d), -1, 1, 20)


@query("""
, g AS (SELECT trace_idx, unnest(range(0, 91)) * 0.7 AS g FROM (SELECT DISTINCT trace_idx FROM tr))
SELECT g.trace_idx, g.g AS time, a.value + (b.value - a.value) * (g.g - floor(g.g)) AS value FROM g JOIN tr a ON a.trace_idx = g.trace_idx AND a.time = floor(g.g) JOIN tr b ON b.trace_idx = g.trace_idx AND b.time = least(floor(g.g) + 1, 63)""", "time value")
def x_resample(spark, d):
    return X.resample(tr(spark, d), 0.7)


@query("SELECT trace_idx, time, value FROM tr WHERE (time::BIGINT) % 4 = 0", "value")
def x_downsample(spark, d):
    return X.downsample_factor(tr(spark, d), 4)


@query(", w AS (SELECT trace_idx, 10.0 + trace_idx % 5 AS a, 20.0 + trace_idx % 7 AS b FROM tr_reg)\nSELECT trace_idx, time - a AS time, value FROM tr JOIN w USING (trace_idx) WHERE time BETWEEN a AND b", "time value")
def x_extract_windows(spark, d):
    k = F.col("trace_idx")
    w = tr_reg(spark, d).select("trace_idx", (10.0 + k % 5).alias("start"), (20.0 + k % 7).alias("stop"), (10.0 + k % 5).alias("ref"))
    return X.extract_windows(tr(spark, d), w, ["trace_idx"]).select("trace_idx", "time", "value")


@query("SELECT trace_idx, arg_max(time, value) AS idxmax FROM tr GROUP BY trace_idx", "idxmax")
def x_idxmax(spark, d):
    return X.idxmax(tr(spark, d))


@query("SELECT trace_idx, quantile_cont(value, 0.9) AS quantile FROM tr GROUP BY trace_idx", "quantile")
def x_quantile(spark, d):
    return X.reduce(tr(spark, d), "quantile", q=0.9)


@query("SELECT trace_idx, min(time) AS start, max(time) AS stop, count(*) AS n FROM tr GROUP BY trace_idx", "start stop")
def x_sampling(spark, d):
    return X.sampling(tr(spark, d)).where("regular").select("trace_idx", "start", "stop", "n")


@query("SELECT trace_idx, time, a.value - b.value AS value FROM tr a JOIN (SELECT trace_idx, time, value FROM (SELECT trace_idx, time, avg(value) OVER (PARTITION BY time) AS value FROM tr)) b USING (trace_idx, time)", "value")
def x_subtract(spark, d):
    mean = tr(spark, d).withColumn("value", F.avg("value").over(Window.partitionBy("time")))
    return X.combine(tr(spark, d), mean, "-")


@query("SELECT trace_idx, time, log10(value) AS value FROM tr WHERE value > 0", "value")
def x_log10(spark, d):
    return X.log10(tr(spark, d)).where("value IS NOT NULL")


# --- correlation --------------------------------------------------------------------------------------------------

NUMBERED = ", n AS (SELECT trace_idx, time::BIGINT AS i, value - avg(value) OVER w AS c, var_samp(value) OVER w AS v, count(*) OVER w AS n FROM tr WINDOW w AS (PARTITION BY trace_idx))"
PAIRS = ", p AS (SELECT trace_idx AS \"left\", trace_idx + 1 AS \"right\" FROM tr_reg WHERE trace_idx + 1 IN (SELECT trace_idx FROM tr_reg))"


@query(NUMBERED + "\nSELECT a.trace_idx, b.i - a.i AS lag, sum(a.c * b.c) / max(a.v * a.n) AS corr FROM n a JOIN n b ON a.trace_idx = b.trace_idx AND b.i - a.i BETWEEN 0 AND 20 GROUP BY ALL", "corr")
def c_autocorr(spark, d):
    return C.auto_corr(tr(spark, d), 20)


def _pairs(spark, d):
    """Each trace and the next one."""
    k = F.col("trace_idx")
    own = tr_reg(spark, d).select(k.alias("left"), (k + 1).alias("right"))
    return own.join(tr_reg(spark, d).select(k.alias("right")), "right", "left_semi").select("left", "right")


CROSS = NUMBERED + PAIRS + ", x AS (SELECT p.left, p.right, b.i - a.i AS lag, sum(a.c * b.c) / (sqrt(max(a.v) * max(b.v)) * max(a.n)) AS corr FROM p JOIN n a ON a.trace_idx = p.left JOIN n b ON b.trace_idx = p.right AND b.i - a.i BETWEEN -10 AND 10 GROUP BY ALL)"


@query(CROSS + "\nSELECT * FROM x", "corr")
def c_cross_corr_pairs(spark, d):
    return C.cross_corr(tr(spark, d), _pairs(spark, d), 10).select("left", "right", "lag", "corr")


@query(CROSS + "\nSELECT \"left\", \"right\", arg_max(lag, corr) AS best_lag, max(corr) AS best_corr FROM x GROUP BY ALL", "best_corr")
def c_best_lag(spark, d):
    return C.best_lag(C.cross_corr(tr(spark, d), _pairs(spark, d), 10), ["left", "right"])


@query(PAIRS + """
, w AS (SELECT unnest(range(0, 7)) AS win_no), l AS (SELECT unnest([-2, 0, 3]) AS lag),
x AS (SELECT p.left, p.right, win_no, lag, corr(a.value, b.value) AS corr, count(*) AS n FROM p, w, l, tr a, tr b WHERE a.trace_idx = p.left AND a.time BETWEEN win_no * 8 AND win_no * 8 + 15 AND b.trace_idx = p.right AND b.time = a.time + lag GROUP BY ALL)
SELECT "left", "right", win_no, lag::BIGINT AS lag, corr, win_no * 8 + 7.5 AS center FROM x WHERE n = 16""", "corr center")
def c_cross_corr_rolling(spark, d):
    got = C.cross_corr_rolling(tr(spark, d), _pairs(spark, d), [-2, 0, 3], 16, 8)
    return got.select("left", "right", F.col("win_no").cast("long").alias("win_no"), "lag", "corr", "center")


@query(", t AS (SELECT time::BIGINT AS k, value AS t FROM tr WHERE trace_idx = 0 AND time < 8), x AS (SELECT trace_idx, time::BIGINT - k AS \"offset\", corr(value, t) AS score, count(*) AS n FROM tr, t GROUP BY ALL)\nSELECT trace_idx, \"offset\", score FROM x WHERE n = 8 AND \"offset\" >= 0", "score")
def c_template_pearson(spark, d):
    t = tr(spark, d, below=1).where("time < 8").select(F.col("time").cast("long").alias("k"), F.col("value").alias("t"))
    return C.slide_template(tr(spark, d), t).select("trace_idx", "offset", "score")


@query(", t AS (SELECT time::BIGINT AS k, value AS t, 0.5 AS v FROM tr WHERE trace_idx = 0 AND time < 8), x AS (SELECT trace_idx, time::BIGINT - k AS \"offset\", -avg((value - t) ** 2 / v) AS score, count(*) AS n FROM tr, t GROUP BY ALL)\nSELECT trace_idx, \"offset\", score FROM x WHERE n = 8 AND \"offset\" >= 0", "score")
def c_template_wmse(spark, d):
    t = tr(spark, d, below=1).where("time < 8").select(F.col("time").cast("long").alias("k"), F.col("value").alias("t"), F.lit(0.5).alias("var"))
    return C.slide_template(tr(spark, d), t, "wmse").select("trace_idx", "offset", "score")


@query(", f AS (SELECT trace_idx, max(value) AS a, max(abs(value)) AS b FROM tr GROUP BY trace_idx), z AS (SELECT * FROM f)\nSELECT f.trace_idx, count(z.trace_idx) / (SELECT count(*) FROM z)::DOUBLE AS cdf FROM f LEFT JOIN z ON z.a >= f.a AND z.b >= f.b GROUP BY f.trace_idx", "cdf")
def c_null_cdf(spark, d):
    f = tr(spark, d).groupBy("trace_idx").agg(F.max("value").alias("a"), F.max(F.abs("value")).alias("b"))
    return C.dominance_cdf(f, f, ["a", "b"], "trace_idx")


# --- kernels ------------------------------------------------------------------------------------------------------


@query(Q.SAMPLES + Q.filtered("xs", "low", 100.0, "y") + "\nSELECT trace_idx, i::DOUBLE AS time, v AS value FROM y", "value")
def k_lowpass(spark, d):
    return G.low_pass(tr(spark, d), 100.0)


@query(Q.SAMPLES + Q.filtered("xs", "high", 100.0, "y") + "\nSELECT trace_idx, i::DOUBLE AS time, v AS value FROM y", "value")
def k_highpass(spark, d):
    return G.high_pass(tr(spark, d), 100.0)


@query(Q.SAMPLES + Q.filtered("xs", "band", (50.0, 200.0), "y") + "\nSELECT trace_idx, i::DOUBLE AS time, v AS value FROM y", "value")
def k_bandpass(spark, d):
    return G.band_pass(tr(spark, d), 50.0, 200.0)


@query(Q.SAMPLES + Q.filtered("xs", "band", (50.0, 200.0), "y") + "\nSELECT trace_idx, i::DOUBLE AS time, v AS value FROM y", "value")
def k_bandpass_chunked(spark, d):
    """The same in chunks of 16 samples and their margins."""
    return G.filter_pass(tr(spark, d), "band", (50.0, 200.0), chunk_ms=16.0)


@query(Q.SAMPLES + Q.segments("xs", 32, 16, "g") + "\nSELECT trace_idx, freq::DOUBLE AS freq, avg(p) AS value FROM g GROUP BY trace_idx, freq", "value", 8)
def k_welch(spark, d):
    return G.welch(tr(spark, d), 32)


BANDS = {"low": (0.0, 100.0), "high": (100.0, 400.0)}


@query(Q.SAMPLES + Q.segments("xs", 32, 16, "g") + ", m AS (SELECT trace_idx, k, avg(p) AS p FROM g GROUP BY trace_idx, k)" + Q.bands("m", 32, BANDS, "q") + "\nSELECT trace_idx, band, power FROM q", "power")
def k_band_power(spark, d):
    return G.band_power(tr(spark, d), BANDS, 32)


#: Windows of 32 samples every 8, each a series of its own.
SLIDING = Q.SAMPLES + ", ws AS (SELECT trace_idx * 1000 + w AS win, trace_idx, w, i - w * 8 AS i, v FROM xs, (SELECT unnest(range(0, 5)) AS w) WHERE i BETWEEN w * 8 AND w * 8 + 31)"
ROLLING = SLIDING + Q.segments("ws", 16, 8, "g", "win") + ", m AS (SELECT win, k, freq, avg(p) AS p FROM g GROUP BY win, k, freq)"
ROLLED = ROLLING + Q.bands("m", 16, BANDS, "q", "win") + "\nSELECT win // 1000 AS trace_idx, (win % 1000 * 8 + 15.5)::DOUBLE AS time, band, power AS value FROM q"


@query(ROLLED, "value")
def k_band_power_rolling(spark, d):
    return G.band_power_rolling(tr(spark, d), 32.0, 8.0, BANDS, 16)


@query(ROLLED, "value")
def k_sliding_power_chunked(spark, d):
    """The same in chunks of 20 ms."""
    return G.band_power_rolling(tr(spark, d), 32.0, 8.0, BANDS, 16, chunk_ms=20.0, origin=0.0)


@query(ROLLING + "\nSELECT win // 1000 AS trace_idx, (win % 1000 * 8 + 15.5)::DOUBLE AS time, freq::DOUBLE AS freq, p AS value FROM m", "value", 8)
def k_welch_rolling(spark, d):
    return G.welch_rolling(tr(spark, d), 32.0, 8.0, 16)


@query(Q.SAMPLES + Q.segments("xs", 16, 8, "g") + "\nSELECT trace_idx, (seg * 8 + 8)::DOUBLE AS time, freq::DOUBLE AS freq, p > 1e-12 AS some, CASE WHEN p > 1e-12 THEN 10 * log10(p) END AS value FROM g", "value")
def k_spectrogram(spark, d):
    """In decibels; segments without any power at a frequency have no value."""
    got = G.spectrogram(tr(spark, d), 16, 8)
    return got.withColumn("some", F.col("value") > -120).withColumn("value", F.when(F.col("value") > -120, F.col("value")))


@query(Q.SAMPLES + Q.wavelet("xs", [50.0, 100.0, 200.0], "w") + "\nSELECT trace_idx, i::DOUBLE AS time, freq, v AS value FROM w", "value")
def k_wavelet(spark, d):
    return G.wavelet(tr(spark, d), [50.0, 100.0, 200.0])


@query(Q.SAMPLES + Q.hilbert("xs", 64, "h") + "\nSELECT trace_idx, i::DOUBLE AS time, re, im, re * re + im * im AS power, cos(atan2(im, re)) AS c, sin(atan2(im, re)) AS s FROM h", "re im power c s")
def k_hilbert_phase(spark, d):
    """The phase as a point of the circle, which has no seam."""
    got = G.hilbert(tr(spark, d))
    turn = F.col("phase") * (2 * math.pi)
    return got.withColumns({"c": F.cos(turn), "s": F.sin(turn)}).drop("phase")


@query(Q.SAMPLES + Q.peaks("xs", "k", 0.1, 3) + "\nSELECT trace_idx, i::DOUBLE AS time, v AS height, prominence, width FROM k WHERE prominence >= 0.05", "height prominence width")
def k_find_peaks(spark, d):
    return G.find_peaks(tr(spark, d), height=0.1, distance=3, prominence=0.05)


@query(Q.SAMPLES + Q.filtered("xs", "low", 200.0, "y") + ", z AS (SELECT trace_idx, i // 2 AS i, -(v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM y WHERE i % 2 = 0 WINDOW w AS (PARTITION BY trace_idx))" + Q.peaks("z", "k", 1.0) + "\nSELECT trace_idx, i * 2::DOUBLE AS time, v AS height, prominence FROM k WHERE prominence >= 0.5", "height prominence")
def k_sharp_waves(spark, d):
    return G.find_sharp_waves(tr(spark, d), 200.0, 2, height=1.0, prominence=0.5)


def _gradient(src: str, out: str) -> str:
    w = "OVER (PARTITION BY trace_idx ORDER BY i)"
    return f", {out} AS (SELECT trace_idx, i, CASE WHEN lag(i) {w} IS NULL THEN lead(v) {w} - v WHEN lead(i) {w} IS NULL THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END AS v FROM {src})"


def _maxima(src: str, sign: str) -> str:
    return f"SELECT trace_idx, i, s FROM (SELECT trace_idx, i, v AS s, {sign}v AS v, {sign}lag(v) OVER w AS p, {sign}lead(v) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY trace_idx ORDER BY i)) WHERE v > p AND v > n AND v >= 0"


SHARP = Q.SAMPLES + Q.filtered("xs", "band", (20.0, 300.0), "yy") + _gradient("yy", "sp") + _gradient("sp", "ac") + f"""
, mk AS (SELECT *, 'start' AS kind FROM ({_maxima("ac", "-")}) UNION ALL SELECT *, 'ref' FROM ({_maxima("sp", "-")}) UNION ALL SELECT *, 'stop' FROM ({_maxima("ac", "")})),
sq AS (SELECT *, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(i) OVER w AS i1, lead(i, 2) OVER w AS i2, lead(s) OVER w AS s1, lead(s, 2) OVER w AS s2 FROM mk WINDOW w AS (PARTITION BY trace_idx ORDER BY i, kind))
SELECT sq.trace_idx, sq.i::DOUBLE AS start_time, i1::DOUBLE AS ref_time, i2::DOUBLE AS stop_time, s AS start_acc, s1 AS ref_speed, s2 AS stop_acc, yy.v AS amplitude FROM sq JOIN yy ON yy.trace_idx = sq.trace_idx AND yy.i = i1 WHERE kind = 'start' AND k1 = 'ref' AND k2 = 'stop'"""


@query(SHARP, "start_acc ref_speed stop_acc amplitude")
def k_sharp_events(spark, d):
    return G.sharp_negative_events(tr(spark, d), (20.0, 300.0))


@query(SHARP, "start_acc ref_speed stop_acc amplitude")
def k_sharp_events_chunked(spark, d):
    return G.sharp_negative_events(tr(spark, d), (20.0, 300.0), chunk_ms=32.0, edge_ms=64.0)


@query("SELECT a.trace_idx, a.time, sum(b.value * exp(-0.5 * ((b.time - a.time + 0.5) / 2.0) ** 2)) / sum(exp(-0.5 * ((b.time - a.time + 0.5) / 2.0) ** 2)) AS value FROM tr a JOIN tr b ON a.trace_idx = b.trace_idx AND b.time - a.time BETWEEN -4 AND 3 GROUP BY ALL", "value")
def k_rolling_gaussian(spark, d):
    return X.rolling_gaussian(tr(spark, d), 2.0)


@query()
def k_match_events(spark, d):
    """Views and purchases of one user, matched in order."""
    own = ev(spark, d).select("event_id", "rec_id", "cat", "ref_time", F.col("amplitude").alias("score"))
    pairs = G.candidate_pairs(own.where("cat = 'view'").drop("cat"), own.where("cat = 'purchase'").drop("cat"), (-12 * T.HOUR, 12 * T.HOUR), ["rec_id"], 24 * T.HOUR)
    return G.match_events(pairs.withColumn("score", F.col("s0") + F.col("s1")), ["rec_id"])


@query()
def k_mixture_states(spark, d):
    """Daily revenue by return flag in two states."""
    daily = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("rec_id"), F.col("l_shipdate").alias("time")).agg(F.sum("l_extendedprice").alias("value"))
    return D.classify_by_mixture(daily, by=["rec_id"], labels=("low", "high"))


@query("""
, pass(n, rec_id, start, stop, cat, changed) AS (
    SELECT 0, rec_id, start, stop, cat, true FROM wbetween
    UNION ALL
    SELECT n + 1, rec_id, min(start), max(stop), cat, bool_or(hit) FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT n, rec_id, start, stop, cat, any_hit AS hit, CASE WHEN cat = lag(cat) OVER w AND start <= lag(stop) OVER w THEN 0 ELSE 1 END AS fresh FROM (
                SELECT n, rec_id, start, stop, CASE WHEN hit THEN later ELSE cat END AS cat, bool_or(hit) OVER (PARTITION BY rec_id) AS any_hit FROM (
                    SELECT *, coalesce(earlier = later AND cat <> later AND stop - start < 172800000, false) AS hit FROM (
                        SELECT *, lag(cat) OVER v AS earlier, lead(cat) OVER v AS later FROM pass WHERE changed WINDOW v AS (PARTITION BY rec_id ORDER BY start, stop))))
            WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)))
    GROUP BY n, rec_id, cat, run)
SELECT rec_id, start, stop, cat FROM (SELECT *, max(n) OVER (PARTITION BY rec_id) AS last FROM pass) WHERE n = last""", "start stop", 4)
def w_merge_sandwiched(spark, d):
    return G.merge_sandwiched(wbetween(spark, d), ["rec_id"], 48 * T.HOUR)


@query("""
, o AS (SELECT rec_id, start, stop, row_number() OVER (PARTITION BY rec_id ORDER BY start, stop) AS r FROM wbetween),
st(rec_id, r, start, stop, train, expected) AS (
    SELECT rec_id, r, start, stop, 0::BIGINT, NULL::DOUBLE FROM o WHERE r = 1
    UNION ALL
    SELECT rec_id, r, start, stop, train + fresh, CASE WHEN fresh = 1 THEN NULL ELSE gap END FROM (
        SELECT o.rec_id, o.r, o.start, o.stop, s.train, o.start - s.start AS gap,
            CASE WHEN abs((o.stop - o.start) - (s.stop - s.start)) > 3600000 OR o.start - s.start > 86400000 OR coalesce(abs(o.start - s.start - s.expected) > 3600000, false) THEN 1 ELSE 0 END AS fresh
        FROM st s JOIN o ON o.rec_id = s.rec_id AND o.r = s.r + 1))
SELECT rec_id, start, stop, train FROM st""", "start stop", 4)
def d_group_pulses(spark, d):
    return G.group_pulses(wbetween(spark, d), ["rec_id"], 24 * T.HOUR, T.HOUR)


# --- states, pulses, statistics -----------------------------------------------------------------------------------


@query("SELECT win_idx, cat = 'view' AND stop - start <= 36000000 AS is_pulse FROM wbetween")
def d_label_pulses(spark, d):
    return D.label_pulses(wbetween(spark, d), ["rec_id"], cat="view", max_length=10 * T.HOUR).select("win_idx", "is_pulse")


@query("SELECT rec_id, floor(start)::BIGINT AS start, floor(stop)::BIGINT AS stop FROM wbetween")
def d_encode_decode(spark, d):
    """Breaks as text and back."""
    whole = wbetween(spark, d).withColumns({"start": F.floor("start").cast("double"), "stop": F.floor("stop").cast("double")})
    return D.decode_breaks(D.encode_breaks(whole, ["rec_id"]), ["rec_id"]).select("rec_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query(", p AS (SELECT * FROM (VALUES (0, 3600000.0), (1, 21600000.0), (2, 86400000.0)) AS v(i, p)), x AS (SELECT win_idx, p, row_number() OVER (PARTITION BY win_idx ORDER BY abs(stop - start - p), i) AS r FROM wbetween, p)\nSELECT win_idx, p AS protocol FROM x WHERE r = 1", "protocol")
def d_match_protocol(spark, d):
    return wbetween(spark, d).select("win_idx", D.match_protocol(F.col("stop") - F.col("start"), [T.HOUR, 6 * T.HOUR, T.DAY]).alias("protocol"))


@query("SELECT rec_id, count(*) FILTER (cat = 'view') AS view, count(*) FILTER (cat = 'purchase') AS purchase FROM wbetween GROUP BY rec_id HAVING count(*) FILTER (cat IN ('view', 'purchase')) > 0")
def d_period_counts(spark, d):
    return D.period_counts(wbetween(spark, d).where("cat IN ('view', 'purchase')"), ["rec_id"], ["view", "purchase"])


@query("SELECT rec_id, cat, win_idx FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, cat ORDER BY stop - start DESC, start) AS r FROM wbetween) WHERE r = 1")
def d_largest_by_cat(spark, d):
    return D.largest_by_cat(wbetween(spark, d), ["rec_id"]).select("rec_id", "cat", "win_idx")


@query("SELECT rec_id, count(*) FILTER (cat <> p) AS switches FROM (SELECT rec_id, cat, lag(cat) OVER (PARTITION BY rec_id ORDER BY start, stop) AS p FROM wbetween) GROUP BY rec_id")
def d_switch_counts(spark, d):
    return D.switch_counts(wbetween(spark, d), ["rec_id"])


@query("SELECT trace_idx, time, 'q' || (floor((value * 3 - floor(value * 3)) * 4)::BIGINT + 1) AS phase FROM tr")
def d_phase_class(spark, d):
    p = X.elementwise(tr(spark, d), lambda v: v * 3 - F.floor(v * 3))
    return p.select("trace_idx", "time", D.classify_phase(F.col("value")).alias("phase"))


@query("""
, m AS (SELECT win_idx, rec_id, start + (stop - start) * 0.5 AS t FROM wbetween WHERE cat = 'view'),
s AS (SELECT rec_id, t AS start, lead(t) OVER w AS stop, row_number() OVER w - 1 AS cycle_idx FROM m WINDOW w AS (PARTITION BY rec_id ORDER BY t))
SELECT s.rec_id, cycle_idx, s.start, s.stop, min((b.start + b.stop) / 2) AS ref FROM s JOIN wbetween b ON b.rec_id = s.rec_id AND b.cat = 'purchase' AND s.stop > b.start AND b.stop > s.start WHERE s.stop IS NOT NULL GROUP BY ALL HAVING count(*) = 1""", "start stop ref", 4)
def d_cycle_windows(spark, d):
    return D.cycle_windows(wbetween(spark, d), ["rec_id"], "view", "purchase").select("rec_id", F.col("cycle_idx").cast("long").alias("cycle_idx"), "start", "stop", "ref")


@query("""
, c AS (SELECT trace_idx, time, value - quantile_cont(value, 0.5) OVER (PARTITION BY trace_idx) AS value FROM tr)
SELECT trace_idx, time, value - quantile_cont(value, 0.5) OVER (PARTITION BY time) AS value FROM c""", "value")
def d_common_reference(spark, d):
    return P.common_reference(tr(spark, d), sample="time", channel="trace_idx").select("trace_idx", "time", "value")


@query("""
, p AS (SELECT trace_idx, avg(value) FILTER (time < 32) AS a, avg(value) FILTER (time >= 32) AS b FROM tr GROUP BY trace_idx),
x AS (SELECT grp, b - a AS dd FROM p JOIN tr_reg USING (trace_idx) WHERE b <> a),
r AS (SELECT grp, dd, rank() OVER (PARTITION BY grp ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY grp, abs(dd)) - 1) / 2.0 AS r FROM x)
SELECT grp, sum(CASE WHEN dd > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN dd < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, count(*) AS n FROM r GROUP BY grp""", "w_plus w_minus")
def d_wilcoxon(spark, d):
    half = lambda c: F.avg(F.when(c, F.col("value")))
    p = tr(spark, d).groupBy("trace_idx").agg(half(F.col("time") < 32).alias("a"), half(F.col("time") >= 32).alias("b"))
    return Y.wilcoxon(p.join(tr_reg(spark, d), "trace_idx"), "a", "b", ["grp"])


@query("""
, r AS (SELECT o_orderpriority, o_orderstatus, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS r FROM orders)
SELECT o_orderpriority, (sum(r) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'F') * (count(*) FILTER (o_orderstatus = 'F') + 1) / 2.0)::DOUBLE AS u, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F') AS n2 FROM r GROUP BY o_orderpriority""", "u")
def d_mannwhitney_u(spark, d):
    return Y.mann_whitney(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", ["o_orderpriority"])


@query("""
, s AS (SELECT cat, min(amplitude) AS lo, max(amplitude) AS hi, stddev_samp(amplitude) * count(amplitude) ** -0.2 AS bw, count(amplitude) AS n FROM ev GROUP BY cat),
b AS (SELECT cat, round_even(amplitude / (bw / 16), 0) AS b, lo, hi, bw, n, count(*) AS c, avg(amplitude) AS m FROM ev JOIN s USING (cat) GROUP BY cat, b, lo, hi, bw, n)
SELECT cat, g::INT AS g, lo + (hi - lo) * g / 100 AS x, sum(c * exp(-0.5 * ((lo + (hi - lo) * g / 100 - m) / bw) ** 2) / (sqrt(2 * pi()) * bw) / n) AS density FROM b, (SELECT unnest(range(0, 101)) AS g) GROUP BY cat, g, lo, hi""", "x density")
def d_density(spark, d):
    return Y.density(ev(spark, d), "amplitude", by=["cat"]).withColumnRenamed("at", "x")


# --- spikes and catalog -------------------------------------------------------------------------------------------


@query("SELECT u.unit_id, count(s.event_id) AS count FROM units u LEFT JOIN spikes s USING (unit_id) GROUP BY u.unit_id")
def p_unit_counts(spark, d):
    return P.unit_counts(spikes(spark, d), units(spark, d)).select("unit_id", "count")


@query("SELECT unit_id, least(floor(isi / 600000), 47)::BIGINT AS bin, count(*) AS count FROM (SELECT unit_id, ref_time - lag(ref_time) OVER (PARTITION BY unit_id ORDER BY ref_time, event_id) AS isi FROM spikes) WHERE isi BETWEEN 0 AND 28800000 GROUP BY ALL")
def p_isi_hist(spark, d):
    return P.isi_histogram(spikes(spark, d), 600_000.0, 48)


@query("SELECT unit_id, floor(ref_time / 86400000)::BIGINT AS bin, count(*) AS count, count(*) / 86400.0 AS rate FROM spikes GROUP BY ALL", "rate")
def p_activity(spark, d):
    return P.activity(spikes(spark, d), T.DAY, rate=True)


@query("SELECT event_id, unit_id % 3 AS unit_id FROM spikes")
def p_mua(spark, d):
    return P.multi_unit(spikes(spark, d), units(spark, d), "probe").select("event_id", "unit_id")


@query("SELECT unit_id, count(*) AS count, quantile_cont(ref_time, 0.05) AS q05, quantile_cont(ref_time, 0.95) AS q95, quantile_cont(ref_time, 0.95) - quantile_cont(ref_time, 0.05) AS active FROM spikes GROUP BY unit_id", "q05 q95 active", 5)
def p_cell_props(spark, d):
    return P.cell_props(spikes(spark, d))


@query("SELECT event_id FROM spikes WHERE unit_id % 3 = 1")
def p_sel_units(spark, d):
    return P.sel_units(spikes(spark, d), units(spark, d), "probe = 1")[0].select("event_id")


@query("SELECT c_mktsegment, count(*) AS n, c_mktsegment || ' (' || count(*) || ')' AS label, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS group_no FROM customer GROUP BY c_mktsegment")
def r_group_experiments(spark, d):
    reg = table(spark, d, "customer").withColumnRenamed("c_custkey", "exp_name")
    return P.group_experiments(reg, ["c_mktsegment"])


@query("SELECT a.n_regionkey AS rec, a.n_nationkey AS ch0, b.n_nationkey AS ch1, CASE WHEN a.n_nationkey % 2 = b.n_nationkey % 2 THEN 'ipsi' ELSE 'contra' END AS kind FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def r_channel_pairs(spark, d):
    p = table(spark, d, "nation").select(F.col("n_regionkey").alias("rec"), F.col("n_nationkey").alias("ch"), (F.col("n_nationkey") % 2).alias("side"))
    return P.channel_pairs(p, "rec", "ch", "side").select("rec", "ch0", "ch1", "kind")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def r_missing_outputs(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return P.missing_outputs(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT cat, rec_id, start, stop FROM (SELECT DISTINCT ON (start, stop, rec_id) cat, rec_id, start, stop, win_idx FROM wship ORDER BY start, stop, rec_id, win_idx)", "start stop")
def w_drop_duplicates(spark, d):
    return W.drop_duplicates(wship(spark, d), ["rec_id"]).select("cat", "rec_id", "start", "stop")


# --- tensors ------------------------------------------------------------------------------------------------------


@query("SELECT trace_idx, stddev_pop(value) AS value FROM tr GROUP BY trace_idx", "value")
def n_reduce_std(spark, d):
    return N.reduce(tr(spark, d), "std", "time")


@query("SELECT time, arg_max(trace_idx, value) AS trace_idx FROM tr GROUP BY time", "time")
def n_idxmax(spark, d):
    return N.idxmax(tr(spark, d), "trace_idx")


@query("SELECT trace_idx, time, a.value - m.value AS value FROM tr a JOIN (SELECT time, avg(value) AS value FROM tr GROUP BY time) m USING (time)", "time value")
def n_broadcast_subtract(spark, d):
    return N.combine(tr(spark, d), N.reduce(tr(spark, d), "mean", "trace_idx"), "-").select("trace_idx", "time", "value")


@query("SELECT trace_idx, time, value - quantile_cont(value, 0.5) FILTER (time BETWEEN 0 AND 15) OVER (PARTITION BY trace_idx) AS value FROM tr", "value")
def n_reset_baseline(spark, d):
    return N.reset_baseline(tr(spark, d), "time", 0, 15)


@query("SELECT grp, time, stddev_pop(value) AS value FROM tr JOIN tr_reg USING (trace_idx) GROUP BY grp, time", "value")
def n_groupby_std(spark, d):
    return N.groupby_labels(tr(spark, d), "trace_idx", tr_reg(spark, d), "grp", "std")


@query("SELECT time, least(floor((value + 1) / 0.25), 7)::BIGINT AS bin, count(*) AS count FROM tr WHERE value BETWEEN -1 AND 1 GROUP BY ALL", "time")
def n_histogram_along(spark, d):
    return N.histogram_along(tr(spark, d), "time", -1, 1, 8)


@query("SELECT trace_idx, time + trace_idx % 3 - 2 AS time, value FROM tr WHERE time + trace_idx % 3 BETWEEN 2 AND 63", "time value")
def n_apply_shift(spark, d):
    shifts = tr_reg(spark, d).select("trace_idx", (F.col("trace_idx") % 3).alias("shift"))
    return N.apply_shift(tr(spark, d), shifts, "trace_idx", "time")
