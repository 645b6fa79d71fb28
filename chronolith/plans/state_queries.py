"""Queries of waveforms, sharp events, states of two signals, trains by protocol, lags of best correlation."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timeunits as T
from ..operators import correlation as C
from ..operators import extraction as X
from ..operators import signals as G
from ..operators import states as D
from ..operators import waves as V
from . import kernel_sql as Q
from .adapters import ev, table, tr, tr_reg, wbetween, wpurchase
from .registry import query
from .signal_queries import BANDS, CROSS, ROLLING, SHARP, _pairs

POWER = ROLLING + Q.bands("m", 16, BANDS, "q", "win") + "\nSELECT win // 1000 AS trace_idx, (win % 1000 * 8 + 15.5)::DOUBLE AS time, band, power AS value FROM q WHERE band <> 'total' AND win // 1000 % 2 = 1"

# --- templates ----------------------------------------------------------------------------------------------------


@query(", p AS (SELECT rec_id, ref_time AS peak FROM ev WHERE cat = 'purchase')\nSELECT event_id, arg_min(peak, (abs(peak - ref_time), peak)) AS peak FROM ev JOIN p USING (rec_id) WHERE cat = 'view' GROUP BY event_id", "peak")
def v_closest_peak(spark, d):
    e = ev(spark, d).select("event_id", "rec_id", "cat", "ref_time")
    peaks = e.where("cat = 'purchase'").select("rec_id", F.col("ref_time").alias("peak"))
    got = V.closest_peak(peaks, e.where("cat = 'view'"), ["rec_id"], time="ref_time")
    return got.where("peak IS NOT NULL").select("event_id", "peak")


def _template(spark, d):
    return tr(spark, d, below=1).where("time < 8").select(F.col("time").cast("long").alias("k"), F.col("value").alias("t"))


SCORES = ", t AS (SELECT time::BIGINT AS k, value AS t FROM tr WHERE trace_idx = 0 AND time < 8), sa AS (SELECT trace_idx, time::BIGINT - k AS i, corr({}value, t) AS v, count(*) AS n FROM tr, t GROUP BY trace_idx, i), {} AS (SELECT trace_idx, i, v FROM sa WHERE n = 8 AND i >= 0)"
FOUND = SCORES.format("", "sc") + Q.peaks("sc", "k1", distance=4)


@query(FOUND + "\nSELECT trace_idx, i::DOUBLE AS time, v AS height, prominence, width FROM k1", "time height prominence width")
def v_template_peaks(spark, d):
    return V.template_peaks(tr(spark, d), _template(spark, d), 8, span=None)


@query(FOUND + SCORES.format("-", "sn").replace(", t AS", ", t2 AS").replace("sa AS", "sb AS").replace("FROM tr, t GROUP", "FROM tr, t2 GROUP").replace("FROM sa", "FROM sb") + Q.peaks("sn", "k2", distance=4) + """
, nn AS (SELECT trace_idx, count(*) AS total FROM k2 GROUP BY trace_idx)
SELECT k1.trace_idx, k1.i::DOUBLE AS time, k1.v AS height, k1.prominence, k1.width, k1.v BETWEEN 0.5 AND 1 AS valid, count(k2.i) / max(total)::DOUBLE AS null_cdf FROM k1 LEFT JOIN nn USING (trace_idx) LEFT JOIN k2 ON k2.trace_idx = k1.trace_idx AND k2.v >= k1.v AND k2.width <= k1.width AND k2.prominence >= k1.prominence GROUP BY k1.trace_idx, k1.i, k1.v, k1.prominence, k1.width""", "time height prominence width null_cdf")
def v_find_template(spark, d):
    return V.find_template(tr(spark, d), _template(spark, d), 8, height=(0.5, 1.0), span=None)


@query(", t AS (SELECT time::BIGINT AS k, value AS t FROM tr WHERE trace_idx = 0 AND time < 3), p(a, b, w) AS (VALUES (0, 0, 2.0::DOUBLE), (1, 1, 2.0), (2, 2, 1.0), (0, 1, 0.5), (1, 0, 0.5)), dd AS (SELECT trace_idx, time::BIGINT - k AS o, k, value - t AS d FROM tr, t WHERE time - k BETWEEN 0 AND 61)\nSELECT x.trace_idx, x.o AS \"offset\", -sum(x.d * w * y.d) / 3 AS score FROM dd x JOIN p ON x.k = p.a JOIN dd y ON y.trace_idx = x.trace_idx AND y.o = x.o AND y.k = p.b GROUP BY x.trace_idx, x.o", "score")
def v_template_fullcov(spark, d):
    precision = np.array([[2.0, 0.5, 0.0], [0.5, 2.0, 0.0], [0.0, 0.0, 1.0]])
    return C.slide_template(tr(spark, d), _template(spark, d).where("k < 3"), "fullcov", precision=precision)


@query(", m AS (SELECT unnest([10, 30, 50]) AS mark)\nSELECT trace_idx, mark::DOUBLE AS mark, time - mark AS time, value FROM tr, m WHERE time >= mark - 5 AND time < mark + 10", "mark time value")
def v_cut_waves(spark, d):
    marks = tr_reg(spark, d).select("trace_idx", F.explode(F.array(F.lit(10.0), F.lit(30.0), F.lit(50.0))).alias("mark"))
    return V.cut_waves(tr(spark, d), marks, -5, 10)


@query(", m AS (SELECT trace_idx * 100 + mark AS trace_idx, time - mark + 20 AS time, value, mark FROM tr, (SELECT unnest([20, 40]) AS mark) WHERE time >= mark - 20 AND time < mark + 20), xs AS (SELECT trace_idx, time::BIGINT AS i, value AS v FROM m)" + Q.filtered("xs", "band", (50.0, 200.0), "y") + "\nSELECT trace_idx // 100 AS trace_idx, (trace_idx % 100)::DOUBLE AS mark, i - 20.0 AS time, v AS value FROM y", "mark time value")
def v_cut_and_filter(spark, d):
    marks = tr_reg(spark, d).select("trace_idx", F.explode(F.array(F.lit(20.0), F.lit(40.0))).alias("mark"))
    return V.cut_waves(tr(spark, d), marks, -20, 20, (50.0, 200.0))


@query(", o AS (SELECT trace_idx, s AS set_no, (trace_idx * 7 + s * 3) % 5 AS dx, (trace_idx % 3) * 0.1 * s AS dy FROM tr_reg, (SELECT unnest(range(0, 4)) AS s)), m AS (SELECT set_no, (time::BIGINT + dx) % 64 AS i, value + dy AS v FROM tr JOIN o USING (trace_idx))\nSELECT set_no, avg(s) AS score FROM (SELECT set_no, i, stddev_pop(v) AS s FROM m GROUP BY set_no, i) GROUP BY set_no", "score")
def v_shift_residual(spark, d):
    k = F.col("trace_idx")
    o = tr_reg(spark, d).select(k, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("set_no"))
    o = o.select(k, "set_no", F.pmod(k * 7 + F.col("set_no") * 3, F.lit(5)).alias("dx"), (F.pmod(k, F.lit(3)) * 0.1 * F.col("set_no")).alias("dy"))
    return V.shift_residual(tr(spark, d).withColumn("i", F.col("time").cast("long")), o, 64)


# --- sharp events -------------------------------------------------------------------------------------------------

LAST = SHARP.rpartition("\nSELECT")
EVENTS = LAST[0] + ", se AS (SELECT" + LAST[2] + ")"


def _sharp(spark, d):
    return G.sharp_negative_events(tr(spark, d), (20.0, 300.0))


@query(EVENTS + "\nSELECT trace_idx, ref_time, stop_time - start_time AS duration, stop_acc - start_acc AS acc_diff, stop_time - ref_time AS ref_to_stop, start_time - ref_time AS ref_to_start, CASE WHEN stop_time > start_time THEN log10(stop_time - start_time) END AS duration_log, CASE WHEN amplitude < 0 THEN log10(-amplitude) END AS amplitude_log, CASE WHEN ref_speed < 0 THEN log10(-ref_speed) END AS ref_speed_log, CASE WHEN stop_acc > 0 THEN log10(stop_acc) END AS stop_acc_log FROM se", "duration acc_diff ref_to_stop ref_to_start duration_log amplitude_log ref_speed_log stop_acc_log", 5)
def v_event_details(spark, d):
    names = "trace_idx ref_time duration acc_diff ref_to_stop ref_to_start duration_log amplitude_log ref_speed_log stop_acc_log".split()
    return V.add_details(_sharp(spark, d)).select(*names)


@query("SELECT event_id, lead(ref_time) OVER w - ref_time AS isi_next, ref_time - lag(ref_time) OVER w AS isi_prev FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY ref_time)", "isi_next isi_prev")
def v_event_isi(spark, d):
    return V.add_isi(ev(spark, d), ["rec_id"]).select("event_id", "isi_next", "isi_prev")


PATH = ", o AS (SELECT event_id, rec_id, ref_time, amplitude, row_number() OVER (PARTITION BY rec_id ORDER BY ref_time) AS r FROM ev), pt AS (SELECT a.event_id AS event0, b.event_id AS event1 FROM o a JOIN o b ON a.rec_id = b.rec_id AND b.r = a.r + 1 WHERE a.r % 3 = 1), bo AS (SELECT event0 AS event_id, event1 AS \"match\" FROM pt UNION ALL SELECT event1, event0 FROM pt)"


def _path(spark, d):
    """Every first of three events of a user with the second."""
    w = Window.partitionBy("rec_id").orderBy("ref_time")
    o = ev(spark, d).select("event_id", F.lead("event_id").over(w).alias("event1"), F.row_number().over(w).alias("r"))
    return o.where("r % 3 = 1 AND event1 IS NOT NULL").select(F.col("event_id").alias("event0"), "event1")


@query(PATH + "\nSELECT e.event_id, coalesce(\"match\", -1) AS \"match\", p.ref_time AS match_ref_time, p.ref_time - e.ref_time AS match_ref_time_diff, p.amplitude - e.amplitude AS match_amplitude_diff, coalesce(p.ref_time > e.ref_time, false) AS is_lead FROM ev e LEFT JOIN bo USING (event_id) LEFT JOIN ev p ON p.event_id = \"match\"", "match_ref_time match_ref_time_diff match_amplitude_diff")
def v_assign_matches(spark, d):
    got = V.is_lead(V.assign_matches(ev(spark, d), _path(spark, d), ["ref_time", "amplitude"]))
    return got.select("event_id", F.coalesce("match", F.lit(-1)).alias("match"), "match_ref_time", "match_ref_time_diff", "match_amplitude_diff", "is_lead")


@query(PATH + ", q AS (SELECT event_id, \"match\" FROM ev LEFT JOIN bo USING (event_id) WHERE amplitude > 30)\nSELECT event_id, coalesce(\"match\" IN (SELECT event_id FROM q), false) AS is_match_valid, CASE WHEN \"match\" IN (SELECT event_id FROM q) THEN \"match\" ELSE -1 END AS \"match\" FROM q")
def v_drop_missing_matches(spark, d):
    got = V.drop_missing_matches(V.assign_matches(ev(spark, d), _path(spark, d), []).where("amplitude > 30"))
    return got.select("event_id", "is_match_valid", F.coalesce("match", F.lit(-1)).alias("match"))


@query("SELECT s_suppkey AS event_id, s_nationkey AS channel_true, dense_rank() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_nationkey % 2, s_nationkey) - 1 AS channel FROM supplier")
def v_simplified_channels(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("event_id"), (F.col("s_nationkey") % 3).alias("rec"), (F.col("s_nationkey") % 2).alias("probe"), F.col("s_nationkey").alias("channel"))
    return V.simplified_channels(s, ["rec"]).select("event_id", "channel_true", "channel")


#: The same tables of the traces turned upside down, under names that end in 0.
NULLS = EVENTS.replace("value AS v FROM tr)", "-value AS v FROM tr)")
for name in ("xs", "yy_n", "yy_e", "yy_f", "yy_r", "yy_b", "yy", "sp", "ac", "mk", "sq", "se"):
    NULLS = re.sub(rf"(?<![\w.']){name}(?=[ (.)])", f"{name}0", NULLS)


@query(EVENTS + NULLS + """
, sd AS (SELECT trace_idx, stddev_pop(value) AS sd FROM tr GROUP BY trace_idx), nt AS (SELECT trace_idx, count(*) AS total FROM se0 GROUP BY trace_idx)
SELECT se.trace_idx, se.ref_time, se.amplitude / max(sd) AS amplitude_zscored, count(se0.ref_time) / max(total)::DOUBLE AS null_cdf FROM se JOIN sd USING (trace_idx) LEFT JOIN nt USING (trace_idx)
LEFT JOIN se0 ON se0.trace_idx = se.trace_idx AND abs(se0.start_acc) >= abs(se.start_acc) AND abs(se0.stop_acc) >= abs(se.stop_acc) AND abs(se0.ref_speed) >= abs(se.ref_speed) GROUP BY se.trace_idx, se.ref_time, se.amplitude""", "amplitude_zscored null_cdf")
def v_extract_sharp_events(spark, d):
    got = V.extract_sharp_events(tr(spark, d), (20.0, 300.0), 64.0, 32.0, edge_ms=64.0)
    return got.select("trace_idx", "ref_time", "amplitude_zscored", "null_cdf")


# --- lags of best correlation -------------------------------------------------------------------------------------

BEST = CROSS + ", be AS (SELECT \"left\", \"right\", arg_max(lag, corr) AS best_lag, max(corr) AS best_corr FROM x GROUP BY \"left\", \"right\")"


def _best(spark, d):
    return C.best_lag(C.cross_corr(tr(spark, d), _pairs(spark, d), 10), ["left", "right"])


@query(BEST + "\nSELECT \"left\", best_lag FROM be WHERE best_lag > (SELECT min(best_lag) FROM be) AND best_lag < (SELECT max(best_lag) FROM be)")
def c_clip_extreme_lags(spark, d):
    return V.clip_extreme_lags(_best(spark, d)).select("left", "best_lag")


@query(BEST + "\nSELECT \"left\", best_corr FROM be WHERE best_corr >= (SELECT quantile_cont(best_corr, 0.25) FROM be) AND best_corr <= (SELECT quantile_cont(best_corr, 0.75) FROM be)", "best_corr")
def c_sel_corr_quantiles(spark, d):
    return V.sel_corr_quantiles(_best(spark, d), 0.25, 0.75).select("left", "best_corr")


@query(BEST + ", gb AS (SELECT grp, best_lag, best_corr FROM be JOIN tr_reg ON trace_idx = \"left\"), cl AS (SELECT * FROM gb QUALIFY best_lag > min(best_lag) OVER (PARTITION BY grp) AND best_lag < max(best_lag) OVER (PARTITION BY grp)), se AS (SELECT * FROM cl QUALIFY best_corr >= quantile_cont(best_corr, 0.5) OVER (PARTITION BY grp))\nSELECT grp, best_lag AS lag, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY grp) AS share FROM se GROUP BY grp, best_lag", "share")
def c_best_lag_shares(spark, d):
    own = _best(spark, d).join(tr_reg(spark, d), F.col("left") == F.col("trace_idx")).select("grp", "best_lag", "best_corr")
    return V.best_lag_shares(own, ["grp"], 0.5).select("grp", F.col("lag").cast("long").alias("lag"), "count", "share")


@query(", n AS (SELECT trace_idx, time, value FROM tr)" + "\nSELECT trace_idx, time AS time0, time + l AS time1, value * l AS value FROM n, (SELECT unnest([-1, 0, 2]) AS l)", "time0 time1 value")
def c_to_diagonal(spark, d):
    lags = tr(spark, d).withColumn("lag", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(2)))).withColumn("value", F.col("value") * F.col("lag"))
    return V.to_diagonal(lags).select("trace_idx", "time0", "time1", "value")


@query(BEST + ", c AS (SELECT best_lag AS lag, count(*) AS n FROM be GROUP BY best_lag)\nSELECT arg_max(lag, (n, lag)) FILTER (lag < -2) AS neg_mode, arg_max(lag, (n, -lag)) FILTER (lag > 2) AS pos_mode FROM c")
def c_lag_modes(spark, d):
    return D.lag_modes(_best(spark, d), 2)


@query(CROSS + "\nSELECT \"left\", arg_max(lag, (corr, -lag)) AS interval FROM x WHERE lag BETWEEN 3 AND 9 GROUP BY \"left\"")
def c_estimate_interval(spark, d):
    return D.estimate_interval(C.cross_corr(tr(spark, d), _pairs(spark, d), 10), 3, 9, ["left"])


@query(BEST + "\nSELECT best_lag AS lag, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM be GROUP BY best_lag", "share")
def c_lag_histogram(spark, d):
    got = C.lag_histogram(_best(spark, d))
    return got.select(F.col("lag").cast("long").alias("lag"), "count", "share")


@query(CROSS + "\nSELECT \"left\", max(corr) FILTER (lag = -4) AS lead_ch0, max(corr) FILTER (lag = 6) AS lead_ch1 FROM x WHERE lag IN (-4, 6) GROUP BY \"left\"", "lead_ch0 lead_ch1")
def c_lead_signals(spark, d):
    corr = C.cross_corr(tr(spark, d), _pairs(spark, d), 10).withColumn("time", F.lit(0.0))
    modes = corr.select("left").distinct().selectExpr("left", "-4L AS neg_mode", "6L AS pos_mode")
    return D.lead_signals(corr, modes, ["left"]).select("left", "lead_ch0", "lead_ch1")


@query("SELECT trace_idx, time, value / quantile_cont(value, 0.999) OVER (PARTITION BY trace_idx) AS value FROM tr", "value")
def x_scale_by_quantile(spark, d):
    return D.scale_by_quantile(tr(spark, d), 0.999, ["trace_idx"]).select("trace_idx", "time", "value")


WEIGHTED = ", p AS (SELECT trace_idx AS \"left\", trace_idx + 1 AS \"right\" FROM tr_reg WHERE trace_idx + 1 IN (SELECT trace_idx FROM tr_reg)), w AS (SELECT unnest(range(0, 7)) AS win_no), l AS (SELECT unnest([-2, 0, 3]) AS lag)"


@query(WEIGHTED + "\nSELECT p.left, p.right, win_no, lag::BIGINT AS lag, sum(a.value * b.value * (1 + (a.time - win_no * 8) / 16)) AS product FROM p, w, l, tr a, tr b WHERE a.trace_idx = p.left AND a.time BETWEEN win_no * 8 AND win_no * 8 + 15 AND b.trace_idx = p.right AND b.time = a.time + lag AND win_no * 8 - 2 >= 0 AND win_no * 8 + 18 <= 63 GROUP BY ALL", "product")
def c_sliding_products(spark, d):
    """Products under a rising kernel, only of windows that are whole at all lags."""
    return C.sliding_products(tr(spark, d), _pairs(spark, d), [-2, 0, 3], 16, 8, [1 + k / 16 for k in range(16)])


@query(", p AS (SELECT a.trace_idx AS \"left\", b.trace_idx AS \"right\" FROM tr_reg a JOIN tr_reg b ON a.grp = b.grp AND a.trace_idx % 20 = b.trace_idx % 20 AND a.trace_idx <= b.trace_idx), w AS (SELECT unnest(range(0, 3)) AS win_no)\nSELECT p.left, p.right, win_no, corr(a.value, b.value) AS corr FROM p, w, tr a, tr b WHERE a.trace_idx = p.left AND a.time BETWEEN win_no * 16 AND win_no * 16 + 31 AND b.trace_idx = p.right AND b.time = a.time GROUP BY ALL", "corr")
def c_corr_rolling_within(spark, d):
    """Windows of 32 samples of all traces of one group and remainder, each with itself too."""
    reg = tr_reg(spark, d).withColumn("m", F.pmod("trace_idx", F.lit(20)))
    pairs = C.pairs_within(reg, ["grp", "m"], itself=True)
    return C.cross_corr_rolling(tr(spark, d), pairs, [0], 32, 16).select("left", "right", "win_no", "corr")


# --- states -------------------------------------------------------------------------------------------------------

STATE_RUNS = """
, sr AS (SELECT trace_idx, time, CASE WHEN value > 0 THEN 'rem' ELSE 'sws' END AS cat FROM tr),
sf AS (SELECT *, CASE WHEN cat IS DISTINCT FROM lag(cat) OVER (PARTITION BY trace_idx ORDER BY time) THEN 1 ELSE 0 END AS n FROM sr),
sg AS (SELECT *, sum(n) OVER (PARTITION BY trace_idx ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM sf),
ru AS (SELECT trace_idx, cat, min(time) AS start, max(time) + 1 AS stop FROM sg GROUP BY trace_idx, cat, run),
pass(n, trace_idx, start, stop, cat, changed) AS (
    SELECT 0, trace_idx, start, stop, cat, true FROM ru
    UNION ALL
    SELECT n + 1, trace_idx, min(start), max(stop), cat, bool_or(hit) FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY trace_idx ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT n, trace_idx, start, stop, cat, any_hit AS hit, CASE WHEN cat = lag(cat) OVER w AND start <= lag(stop) OVER w THEN 0 ELSE 1 END AS fresh FROM (
                SELECT n, trace_idx, start, stop, CASE WHEN hit THEN later ELSE cat END AS cat, bool_or(hit) OVER (PARTITION BY trace_idx) AS any_hit FROM (
                    SELECT *, coalesce(earlier = later AND cat <> later AND stop - start < 2, false) AS hit FROM (
                        SELECT *, lag(cat) OVER v AS earlier, lead(cat) OVER v AS later FROM pass WHERE changed WINDOW v AS (PARTITION BY trace_idx ORDER BY start, stop))))
            WINDOW w AS (PARTITION BY trace_idx ORDER BY start, stop)))
    GROUP BY n, trace_idx, cat, run),
st AS (SELECT trace_idx, start, stop, cat FROM (SELECT *, max(n) OVER (PARTITION BY trace_idx) AS last FROM pass) WHERE n = last)"""


@query(STATE_RUNS + "\nSELECT * FROM st", "start stop")
def d_states_by_threshold(spark, d):
    return D.states_by_threshold(tr(spark, d), 0.0, 2.0, ["trace_idx"])


def _two(spark, d):
    """Amplitude and hour of the day of the users' events as two signals; clicks stand for the quiet state."""
    h = F.col("ref_time") / T.HOUR
    return ev(spark, d).select("event_id", "rec_id", (F.col("amplitude") / 10).alias("a"), (h - F.floor(h / 24) * 24).alias("b"), F.when(F.col("cat") == "click", "sws").otherwise("rem").alias("rem_state"))


@query(", two AS (SELECT event_id, rec_id, amplitude / 10 AS a, ref_time / 3600000 - floor(ref_time / 86400000) * 24 AS b, cat = 'click' AS q FROM ev), ce AS (SELECT rec_id, avg(a) AS ca, avg(b) AS cb FROM two WHERE q GROUP BY rec_id)\nSELECT event_id, CASE WHEN q THEN 'sws' WHEN (b - cb) * 1.2 + cb < a THEN 'lead_ch0' WHEN (a - ca) * 1.2 + ca < b THEN 'lead_ch1' ELSE 'x' END AS lead FROM two JOIN ce USING (rec_id)")
def d_lead_states(spark, d):
    return D.lead_states(_two(spark, d), "a", "b", ["rec_id"]).select("event_id", "lead")


@query()
def d_smooth_states(spark, d):
    return D.smooth_states(wbetween(spark, d), ["rec_id"], ((("click", "error"), 10 * T.HOUR), (("view",), 20 * T.HOUR)))


@query("SELECT b.win_idx, b.start - t AS start, b.stop - t AS stop FROM wbetween b JOIN (SELECT rec_id, (min(start) + max(stop)) / 2 AS t FROM wbetween WHERE cat <> 'view' GROUP BY rec_id) USING (rec_id)", "start stop", 4)
def d_cycles_aligned(spark, d):
    w = wbetween(spark, d)
    return D.cycles_aligned(w, D.cycle_centers(w, ["rec_id"], "view"), ["rec_id"]).select("win_idx", "start", "stop")


@query("SELECT rec_id, sum(stop - start) FILTER (cat = 'view') / sum(stop - start) AS view, sum(stop - start) FILTER (cat = 'click') / sum(stop - start) AS click FROM wbetween WHERE cat IN ('view', 'click') GROUP BY rec_id", "view click")
def d_period_shares(spark, d):
    return D.period_shares(wbetween(spark, d), ["rec_id"], ["view", "click"])


@query("SELECT p.win_idx AS analysis_idx, p.start + i * 1800000.0 - p.ref AS time, b.cat FROM (SELECT *, unnest(range(0, floor((stop - start) / 1800000.0 + 0.5)::BIGINT + 1)) AS i FROM wpurchase) p LEFT JOIN wbetween b ON b.rec_id = p.rec_id AND p.start + i * 1800000.0 >= b.start AND p.start + i * 1800000.0 < b.stop", "time")
def d_state_grid(spark, d):
    a = wpurchase(spark, d).select("rec_id", F.col("win_idx").alias("analysis_idx"), "start", "stop", "ref")
    return D.state_grid(wbetween(spark, d), a, T.HOUR / 2, ["rec_id"]).select("analysis_idx", "time", "cat")


# --- trains -------------------------------------------------------------------------------------------------------

STEPS = "(VALUES (0, 3600000.0::DOUBLE), (1, 10800000.0), (2, 43200000.0), (3, 129600000.0)) AS q(i, p)"
PROTOCOL = [T.HOUR, 3 * T.HOUR, 12 * T.HOUR, 36 * T.HOUR]


def _pulses(spark, d):
    """A pulse of an hour or three from each view on, by its amplitude."""
    return ev(spark, d).where("cat = 'view'").select("event_id", "rec_id", F.col("ref_time").alias("start"), (F.col("ref_time") + F.when(F.col("amplitude") > 50, 3 * T.HOUR).otherwise(T.HOUR)).alias("stop"))


@query(f"""
, pu AS (SELECT rec_id, ref_time AS start, ref_time + CASE WHEN amplitude > 50 THEN 10800000.0 ELSE 3600000.0 END AS stop FROM ev WHERE cat = 'view'),
pg AS (SELECT *, stop - start AS l, start - lag(stop) OVER w AS pr, lead(start) OVER w - stop AS ne, row_number() OVER w AS r FROM pu WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)),
pm AS (SELECT rec_id, start, stop, r, (SELECT arg_min(p, (abs(l - p), i)) FROM {STEPS}) AS l, CASE WHEN pr IS NULL THEN 'inf'::DOUBLE ELSE (SELECT arg_min(p, (abs(pr - p), i)) FROM {STEPS}) END AS pr, CASE WHEN ne IS NULL THEN 'inf'::DOUBLE ELSE (SELECT arg_min(p, (abs(ne - p), i)) FROM {STEPS}) END AS ne FROM pg),
go(rec_id, r, train, l, gap) AS (
    SELECT rec_id, r, 1::BIGINT, l, ne FROM pm WHERE r = 1
    UNION ALL
    SELECT m.rec_id, m.r, CASE WHEN m.l <> g.l OR m.pr <> g.gap OR g.gap >= 129600000 THEN g.train + 1 ELSE g.train END, CASE WHEN m.l <> g.l OR m.pr <> g.gap OR g.gap >= 129600000 THEN m.l ELSE g.l END, CASE WHEN m.l <> g.l OR m.pr <> g.gap OR g.gap >= 129600000 THEN m.ne ELSE g.gap END
    FROM go g JOIN pm m ON m.rec_id = g.rec_id AND m.r = g.r + 1)
SELECT rec_id, start, stop, train FROM go JOIN pm USING (rec_id, r)""", "start stop", 3)
def d_protocol_trains(spark, d):
    return D.protocol_trains(_pulses(spark, d).drop("event_id"), ["rec_id"], PROTOCOL, 36 * T.HOUR)


@query("SELECT win_idx, printf('%.0f s pulses every %.0f s', 3600.0, round_even((stop - start) / 3600000, 0) * 3600.0) AS text FROM wbetween")
def d_protocol_text(spark, d):
    whole = F.rint((F.col("stop") - F.col("start")) / T.HOUR) * T.HOUR
    return wbetween(spark, d).select("win_idx", D.protocol_text(whole, F.lit(T.HOUR)).alias("text"))


@query("SELECT b.rec_id, p.win_idx AS train, b.cat, row_number() OVER (PARTITION BY b.rec_id, p.win_idx, b.cat ORDER BY b.start - p.ref, b.stop - p.ref) - 1 AS period_id, b.start - p.ref AS start, b.stop - p.ref AS stop FROM wbetween b JOIN wpurchase p ON b.rec_id = p.rec_id AND b.stop > p.start AND p.stop > b.start WHERE b.cat IN ('view', 'click')", "start stop")
def d_periods_by_train(spark, d):
    trains = wpurchase(spark, d).select("rec_id", F.col("win_idx").alias("train"), "start", "stop", "ref")
    return D.periods_by_train(wbetween(spark, d).drop("win_idx"), trains, ["rec_id"], ("view", "click"))


@query("SELECT event_id, rec_id IN (3, 5, 8) AS noisy FROM ev WHERE cat = 'view'")
def d_label_listed(spark, d):
    listed = spark.sql("SELECT explode(array(3L, 5L, 8L, 8L)) AS rec_id")
    return D.label_listed(_pulses(spark, d), listed, ["rec_id"], "noisy").select("event_id", "noisy")


@query("SELECT p.event_id, s - 900000 AS start, s + 900000 AS stop, c_mktsegment AS segment FROM (SELECT event_id, rec_id, ref_time + CASE WHEN amplitude > 50 THEN 10800000.0 ELSE 3600000.0 END AS s FROM ev WHERE cat = 'view') p LEFT JOIN customer ON c_custkey = rec_id", "start stop")
def d_analysis_windows(spark, d):
    reg = table(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"), F.col("c_mktsegment").alias("segment"))
    return D.analysis_windows(_pulses(spark, d), reg, T.HOUR / 2, on="rec_id").select("event_id", "start", "stop", "segment")


@query("SELECT event_id, CASE WHEN x < 0 THEN x + ceil(-x - 0.5) WHEN x >= 0.5 THEN x - floor(x + 0.5) ELSE x END AS diff FROM (SELECT event_id, amplitude / 20 - 2 AS x FROM ev)", "diff")
def d_phase_difference(spark, d):
    return ev(spark, d).select("event_id", D.phase_difference(F.col("amplitude") / 20, F.lit(2.0)).alias("diff"))


@query("SELECT rec_id, min(start) AS start, max(stop) AS stop FROM wbetween WHERE cat <> 'view' GROUP BY rec_id", "start stop")
def d_hull_without(spark, d):
    return D.hull_without(wbetween(spark, d), ["rec_id"], "view")


@query("SELECT rec_id, win_idx FROM (SELECT *, coalesce(start - lag(stop) OVER w, 'inf'::DOUBLE) AS p, coalesce(lead(start) OVER w - stop, 'inf'::DOUBLE) AS n FROM wpurchase WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)) WHERE p >= 7200000 AND n >= 7200000 AND abs(stop - start - 25200000) <= 1000")
def d_collect_pulses(spark, d):
    return D.collect_pulses(wpurchase(spark, d), ["rec_id"], 2 * T.HOUR, 7 * T.HOUR, 1000.0).select("rec_id", "win_idx")


@query(", q AS (SELECT trace_idx, (quantile_cont(value, 0.99) + quantile_cont(value, 0.1)) / 2 AS t FROM tr GROUP BY trace_idx), o AS (SELECT trace_idx, time, CASE WHEN value > t THEN 'on' ELSE 'off' END AS cat FROM tr JOIN q USING (trace_idx)), f AS (SELECT *, CASE WHEN cat IS DISTINCT FROM lag(cat) OVER (PARTITION BY trace_idx ORDER BY time) THEN 1 ELSE 0 END AS n FROM o), g AS (SELECT *, sum(n) OVER (PARTITION BY trace_idx ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM f)\nSELECT trace_idx, cat, count(*) AS count, min(time) - 0.5 AS start, max(time) + 0.5 AS stop FROM g GROUP BY trace_idx, cat, run", "start stop")
def d_light_windows(spark, d):
    return D.light_windows(tr(spark, d), ["trace_idx"]).select("trace_idx", "cat", "count", "start", "stop")


@query("SELECT trace_idx, time, coalesce(last_value(CASE WHEN value > 0 THEN value END IGNORE NULLS) OVER (PARTITION BY trace_idx ORDER BY time ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN value > 0 THEN value END IGNORE NULLS) OVER (PARTITION BY trace_idx ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM tr", "value")
def x_fill_not_positive(spark, d):
    return D.fill_not_positive(tr(spark, d), by=["trace_idx"]).select("trace_idx", "time", "value")


@query(", tp AS (SELECT rec_id, win_idx % 4 AS train, start, stop FROM wbetween)\nSELECT rec_id, train, count(*) AS pulses, quantile_cont(stop - start, 0.5) AS pulse_length, quantile_cont(nx, 0.5) AS interval, min(start) AS start, max(stop) AS stop FROM (SELECT *, lead(start) OVER (PARTITION BY rec_id, train ORDER BY start) - start AS nx FROM tp) GROUP BY rec_id, train", "pulse_length interval start stop", 3)
def d_train_protocol(spark, d):
    w = wbetween(spark, d).select("rec_id", (F.col("win_idx") % 4).alias("train"), "start", "stop")
    return D.train_protocol(w, ["rec_id"])



# --- whole recordings ---------------------------------------------------------------------------------------------

MATCHED = """
, pr AS (SELECT a.rec_id, a.ref_time AS t0, b.ref_time AS t1, a.amplitude + b.amplitude AS s, row_number() OVER (PARTITION BY a.rec_id ORDER BY a.ref_time, b.ref_time DESC) AS r FROM ev a JOIN ev b ON a.rec_id = b.rec_id AND a.cat = 'view' AND b.cat = 'purchase' AND b.ref_time - a.ref_time BETWEEN {} AND {} {}),
dp(rec_id, r, st) AS (
    SELECT rec_id, r, [{{'t0': t0, 't1': t1, 'w': s}}] FROM pr WHERE r = 1
    UNION ALL
    SELECT p.rec_id, p.r, list_append(d.st, {{'t0': p.t0, 't1': p.t1, 'w': p.s + coalesce(list_max(list_transform(list_filter(d.st, lambda x: x.t0 < p.t0 AND x.t1 < p.t1), lambda x: x.w)), 0)}}) FROM dp d JOIN pr p ON p.rec_id = d.rec_id AND p.r = d.r + 1)
SELECT rec_id, list_max(list_transform(st, lambda x: x.w)) AS total FROM (SELECT *, max(r) OVER (PARTITION BY rec_id) AS last FROM dp) WHERE r = last"""


@query(MATCHED.format(-43200000, 43200000, ""), "total", 4)
def k_match_total(spark, d):
    """What the heaviest matching of each user's views and purchases weighs; which of several it is may be open."""
    own = ev(spark, d).select("event_id", "rec_id", "cat", "ref_time", F.col("amplitude").alias("score"))
    pairs = G.candidate_pairs(own.where("cat = 'view'").drop("cat"), own.where("cat = 'purchase'").drop("cat"), (-12 * T.HOUR, 12 * T.HOUR), ["rec_id"], 24 * T.HOUR)
    return G.match_events(pairs.withColumn("score", F.col("s0") + F.col("s1")), ["rec_id"]).groupBy("rec_id").agg(F.sum("score").alias("total"))


@query(MATCHED.format(-259200000, 259200000, "AND (a.amplitude >= 60 OR b.amplitude >= 60)"), "total", 4)
def m_extract_matches(spark, d):
    """Views and purchases up to three days apart, one of them at least large."""
    e = ev(spark, d).where("cat IN ('view', 'purchase')").select("rec_id", F.when(F.col("cat") == "view", 0).otherwise(1).alias("channel"), "event_id", "ref_time", F.col("amplitude").alias("score"), F.when(F.col("amplitude") >= 60, 0.01).otherwise(0.5).alias("null_cdf"))
    return X.extract_matches(e, (-3 * T.DAY, 3 * T.DAY), ["rec_id"]).groupBy("rec_id").agg(F.sum("score").alias("total"))


@query(POWER, "value")
def m_extract_power(spark, d):
    """Power of what has none yet: the traces of odd number."""
    done = tr_reg(spark, d).where("trace_idx % 2 = 0")
    return X.extract_power(tr(spark, d), {"low": (0.0, 100.0), "high": (100.0, 400.0)}, 32.0, 8.0, lowest_hz=125.0, chunk_ms=20.0, done=done)


@query("SELECT l_orderkey, (greatest(avg(l_quantity), avg(l_discount * 100), avg(l_tax * 100)) + least(avg(l_quantity), avg(l_discount * 100), avg(l_tax * 100))) / 2 AS lightness FROM lineitem GROUP BY l_orderkey", "lightness")
def d_lightness(spark, d):
    pixels = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("r"), (F.col("l_discount") * 100).alias("g"), (F.col("l_tax") * 100).alias("b"))
    return D.lightness(pixels, ["l_orderkey"])
