"""Queries of scalars, events, traces, spikes, clocks, the catalog and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeunits as T
from ..functions.win import Win
from ..operators import events as E
from ..operators import select as S
from ..operators import signals as G
from ..operators import spikes as P
from ..operators import stats as Y
from ..operators import traces as X
from .adapters import ev, spikes, table, tr, tr_reg, units
from .registry import query

# --- values on the driver -----------------------------------------------------------------------------------------


def _rows(spark, found: dict):
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


@query("""SELECT * FROM (VALUES ('start_s', 3600.0), ('stop_s', 9000.5), ('length', 5400500.0), ('mid', 6300250.0), ('empty', 0.0), ('before_start', 2600000.0), ('after_stop', 9950500.0), ('contains_edge', 1.0), ('inside', 1.0), ('touching', 0.0),
('quantile', 4950125.0), ('relative', 0.5), ('grown', 7400500.0), ('shrunk', 3400500.0), ('left', 400000.0), ('right', 3000500.0), ('pieces', 3.0), ('fitted', 500000.0), ('clipped', 4000000.0), ('taken', 1000000.0), ('rounded', 3.0), ('loose', 3.0), ('samples', 162015.0), ('stride', 30.0), ('text', 9000500.0), ('days', 93784500.0)) AS v(name, value)""")
def t_window_values(spark, d):
    """What a single window says, as a value on the driver."""
    w = Win(3_600_000.0, 9_000_500.0)
    rest = w.subtract(Win(4_000_000.0, 6_000_000.0))
    part = w.samples(30.0, 1.0)
    return _rows(spark, {
        "start_s": w.in_units().start, "stop_s": w.in_units().stop, "length": w.length, "mid": w.mid, "empty": w.is_empty, "before_start": w.before(900_000, 100_000).start, "after_stop": w.after(900_000, 50_000).stop, "contains_edge": w.contains(9_000_500),
        "inside": Win(4e6, 5e6).contained_in(w), "touching": w.overlaps(Win(9_000_500, 1e7)), "quantile": w.quantile_time(0.25), "relative": w.relative_time(w.mid), "grown": w.expand(1e6).length, "shrunk": w.shrink(1e6).length, "left": rest[0].length,
        "right": rest[1].length, "pieces": len(w.split(1_800_000)), "fitted": Win(0, 1000).shift_to_fit(Win(500_000, 1e6)).start, "clipped": Win(0, 4e6).clip(w).stop, "taken": w.take_centred(1e6).length, "rounded": w.rounded(3_600_000).stop / 3_600_000,
        "loose": w.rounded(3_600_000, "floor_ceil").stop / 3_600_000, "samples": part.stop - part.start, "stride": part.step, "text": Win.from_str(w.to_str()).assert_positive().stop, "days": Win.from_str("01:00 - 1d 02:03:04.5").stop,
    })


@query("SELECT * FROM (VALUES ('period', 0.03333333333333333), ('rate', 30000.0), ('stride', 30.0), ('matched', 1000.0), ('matched_odd', 967.741935483871), ('divides', 1.0), ('not_divides', 0.0), ('adjusted', 30000.0003), ('whole', 2.0), ('ms', 93784005.0)) AS v(name, value)", "value", 4)
def t_sampling_values(spark, d):
    r = T.SamplingRate(30_000.0)
    whole = spark.range(1).select(r.whole_periods(F.lit(2.01)).alias("x")).first()[0]
    return _rows(spark, {"period": r.period, "rate": T.SamplingRate.from_period(r.period).hz, "stride": r.stride(1000), "matched": r.match_load_hz(1000), "matched_odd": r.match_load_hz(970), "divides": r.divides(1000), "not_divides": r.divides(970), "adjusted": r.adjusted().hz, "whole": whole, "ms": T.ms(days=1, hours=2, minutes=3, seconds=4, milliseconds=5)})


@query("SELECT event_id, r + s AS solar, r + s - s AS back, r + s - 25200000 AS circ FROM (SELECT event_id, (epoch_us(ts) - 1704067200000000) / 1000.0 AS r, 3600000.0 * (user_id % 24) AS s FROM events)", "solar back circ")
def t_clocks(spark, d):
    """A recording's times on the sun's clock and back; each user's recording begins at an hour of its own."""
    e = ev(spark, d).withColumn("s", F.pmod("rec_id", F.lit(24)) * T.HOUR)
    solar = T.to_clock("ref_time", "s")
    return e.select("event_id", solar.alias("solar"), T.from_clock(solar, "s").alias("back"), T.to_clock("ref_time", F.col("s") - 7 * T.HOUR).alias("circ"))


# --- selections ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, rec_id FROM ev WHERE amplitude > 50 AND cat <> 'view'")
def s_mask(spark, d):
    return ev(spark, d).where((F.col("amplitude") > 50) & ~(F.col("cat") == "view")).select("event_id", "rec_id")


@query("SELECT event_id FROM ev WHERE cat = 'view' AND rec_id IN (1, 2, 3)")
def s_masks_together(spark, d):
    e = ev(spark, d)
    return S.sel_in(S.sel_match(e, cat="view"), rec_id=[1, 2, 3]).select("event_id")


# --- events -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round_even(ref_time / 10, 0) * 10 AS ref_time FROM ev", "ref_time")
def e_round(spark, d):
    """To tens of milliseconds."""
    return E.round_times(ev(spark, d), decimals=-1).select("event_id", "ref_time")


@query("SELECT event_id, ref_time - 5 AS start, ref_time AS stop, ref_time AS ref FROM ev", "start stop ref")
def e_to_wins(spark, d):
    return E.to_wins(ev(spark, d).withColumn("start_time", F.col("ref_time") - 5)).select("event_id", "start", "stop", "ref")


@query("SELECT event_id, ref_time - 432000000.0 AS ref_time FROM ev WHERE ref_time BETWEEN 432000000 AND 864000000", "ref_time")
def e_crop(spark, d):
    return E.crop(ev(spark, d), 5 * T.DAY, 10 * T.DAY, reset=True).select("event_id", "ref_time")


@query("SELECT event_id, ref_time + rec_id AS ref_time FROM ev", "ref_time")
def e_shift(spark, d):
    return E.shift_time(ev(spark, d), F.col("rec_id").cast("double")).select("event_id", "ref_time")


@query(", b AS (SELECT rec_id, ref_time, cat FROM ev WHERE cat = 'view' UNION ALL SELECT rec_id, ref_time + 0.5, 'later' FROM ev WHERE cat = 'purchase')\nSELECT row_number() OVER (ORDER BY ref_time, rec_id) - 1 AS event_id, rec_id, cat FROM b")
def e_combine(spark, d):
    e = ev(spark, d).select("event_id", "rec_id", "ref_time", "cat")
    later = e.where("cat = 'purchase'").withColumns({"ref_time": F.col("ref_time") + 0.5, "cat": F.lit("later")})
    return E.combine(e.where("cat = 'view'"), later, ("ref_time", "rec_id")).select("event_id", "rec_id", "cat")


@query("SELECT rec_id, min(ref_time) AS start, max(ref_time) AS stop FROM ev GROUP BY rec_id", "start stop")
def e_global_win(spark, d):
    return E.global_win(ev(spark, d), ["rec_id"])


@query(", p AS (SELECT rec_id, ref_time AS t, amplitude AS v FROM ev WHERE cat = 'purchase')\nSELECT event_id, arg_min(v, (abs(t - ref_time), t)) AS level FROM ev JOIN p USING (rec_id) WHERE cat = 'view' GROUP BY event_id", "level")
def e_nearest(spark, d):
    s = ev(spark, d).where("cat = 'purchase'").select("rec_id", F.col("ref_time").alias("time"), F.col("amplitude").alias("value"))
    got = E.nearest_value(ev(spark, d).where("cat = 'view'").select("event_id", "rec_id", "ref_time"), s, ["rec_id"], name="level")
    return got.where("level IS NOT NULL").select("event_id", "level")


# --- traces -------------------------------------------------------------------------------------------------------


@query("SELECT trace_idx, min(time) AS first, count(*) AS n FROM tr GROUP BY trace_idx", "first")
def x_summary(spark, d):
    """Where each trace begins and how many samples it has."""
    got = X.sampling(tr(spark, d))
    return got.select("trace_idx", F.col("start").alias("first"), "n")


@query(", o AS (SELECT trace_idx, time * (1 + trace_idx % 2) AS time, value FROM tr WHERE trace_idx < 20), g AS (SELECT DISTINCT trace_idx, i::DOUBLE AS time FROM o, (SELECT unnest(range(0, 127)) AS i))\nSELECT g.trace_idx, g.time, CASE WHEN a.value IS NOT NULL THEN a.value ELSE (b.value + c.value) / 2 END AS value FROM g LEFT JOIN o a ON a.trace_idx = g.trace_idx AND a.time = g.time LEFT JOIN o b ON b.trace_idx = g.trace_idx AND b.time = g.time - 1 AND g.trace_idx % 2 = 1 LEFT JOIN o c ON c.trace_idx = g.trace_idx AND c.time = g.time + 1 AND g.trace_idx % 2 = 1", "time value")
def x_from_series_resampled(spark, d):
    """Series at 1 and 0.5 kHz on one grid of half a millisecond, rounded up."""
    k = F.col("trace_idx")
    return X.from_series_resampled(tr(spark, d, below=20).withColumn("time", F.col("time") * (1 + F.pmod(k, F.lit(2)))))


@query(", c AS (SELECT 'a' AS part, trace_idx, time, value FROM tr WHERE time < 10 UNION ALL SELECT 'b', trace_idx, time, value FROM tr WHERE time >= 5 AND time < 12), k AS (SELECT part, trace_idx, t::DOUBLE AS time FROM (SELECT DISTINCT part, trace_idx FROM c), (SELECT unnest(range(0, 12)) AS t))\nSELECT part, trace_idx, time, value FROM k LEFT JOIN c USING (part, trace_idx, time)", "time value")
def x_concat_aligned(spark, d):
    t = tr(spark, d)
    return X.concat_aligned({"a": t.where("time < 10"), "b": t.where("time >= 5 AND time < 12")})


@query("SELECT c_mktsegment, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END, c_mktsegment) - 1 AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def x_unique_sorted(spark, d):
    return X.unique_sorted(table(spark, d, "customer"), "c_mktsegment", ["MACHINERY", "AUTOMOBILE"])


@query("SELECT trace_idx, least(floor(time / 8), 7)::BIGINT AS tbin, least(floor((value + 1) / 0.5), 3)::BIGINT AS vbin, count(*) AS count FROM tr WHERE time BETWEEN 0 AND 64 AND value BETWEEN -1 AND 1 GROUP BY ALL")
def x_histograms2d(spark, d):
    return X.histograms2d(tr(spark, d), (0, 64, 8), (-1, 1, 4))


@query("SELECT trace_idx, min(time) FILTER (value > 0) AS start, max(time) FILTER (value > 0) AS stop, min(time) FILTER (value > 0) AS ref FROM tr GROUP BY trace_idx", "start stop ref")
def x_to_wins(spark, d):
    return X.to_wins(X.elementwise(tr(spark, d), lambda v: F.when(v > 0, v)))


@query("SELECT trace_idx, time, value FROM tr WHERE abs(time - 31.5) <= 10", "time value")
def x_crop_centered(spark, d):
    return X.crop_centered(tr(spark, d), 20)


@query(", g AS (SELECT trace_idx, least(greatest(trace_idx % 70 - 2.5, 0), 63) AS p, trace_idx % 70 - 2.5 AS q FROM tr_reg)\nSELECT g.trace_idx, g.q::DOUBLE AS place, a.value + (coalesce(b.value, a.value) - a.value) * (p - floor(p)) AS value FROM g JOIN tr a ON a.trace_idx = g.trace_idx AND a.time = floor(p) LEFT JOIN tr b ON b.trace_idx = g.trace_idx AND b.time = floor(p) + 1", "place value")
def x_lookup(spark, d):
    """A time of its own for each trace, some of them beyond its ends."""
    at = tr_reg(spark, d).select("trace_idx", (F.pmod("trace_idx", F.lit(70)) - 2.5).alias("at"))
    return X.lookup(tr(spark, d), at).select("trace_idx", F.col("at").alias("place"), "value")


@query(", w AS (SELECT * FROM (VALUES (0, 2.0, 9.0, 5.0), (1, 8.5, 20.0, 10.0)) AS w(win_idx, start, stop, ref)), g AS (SELECT trace_idx, win_idx, ref, start + i * 0.5 AS t FROM tr_reg, (SELECT *, unnest(range(0, floor((stop - start) / 0.5)::BIGINT + 1)) AS i FROM w))\nSELECT g.trace_idx, win_idx, t - ref AS time, a.value + (b.value - a.value) * (t - floor(t)) AS value FROM g JOIN tr a ON a.trace_idx = g.trace_idx AND a.time = floor(t) JOIN tr b ON b.trace_idx = g.trace_idx AND b.time = floor(t) + 1", "time value")
def x_extract_resampled(spark, d):
    wins = spark.sql("SELECT * FROM VALUES (0, 2.0D, 9.0D, 5.0D), (1, 8.5D, 20.0D, 10.0D) AS w(win_idx, start, stop, ref)")
    return X.extract_resampled(tr(spark, d), wins, 0.5)


@query(", s AS (SELECT trace_idx, avg(value) AS a, stddev_pop(value) AS s FROM tr WHERE abs(time - 31.5) <= 16 GROUP BY trace_idx)\nSELECT trace_idx, time, (value - a) / s AS value FROM tr JOIN s USING (trace_idx)", "value")
def x_zscore_by_middle(spark, d):
    return X.zscore_by_middle(tr(spark, d), 32.0)


@query("SELECT trace_idx, floor(time / 24)::BIGINT AS \"row\", time - floor(time / 24) * 24 AS time, value FROM tr", "time value")
def x_wrapped(spark, d):
    return X.wrapped(tr(spark, d), 24.0)


@query("SELECT a.trace_idx, a.time, a.value > b.value AS more, a.value = b.value AS same, a.value <= b.value AS at_most FROM tr a JOIN (SELECT trace_idx, time, CASE WHEN time % 2 = 0 THEN value ELSE 0 END AS value FROM tr) b USING (trace_idx, time)", "time")
def x_compare(spark, d):
    a, b = tr(spark, d), X.elementwise(tr(spark, d), lambda v: F.when(F.col("time") % 2 == 0, v).otherwise(0.0))
    told = lambda op, name: X.combine(a, b, op).withColumnRenamed("value", name)
    key = ["trace_idx", "time"]
    return told(">", "more").join(told("==", "same"), key).join(told("<=", "at_most"), key)


@query("SELECT a.trace_idx, a.time, floor(a.value / b.value) AS whole, a.value - floor(a.value / b.value) * b.value AS rest, a.value / b.value AS ratio FROM tr a JOIN (SELECT trace_idx, time, abs(value) + 0.1 AS value FROM tr) b USING (trace_idx, time)", "time whole rest ratio")
def x_divide(spark, d):
    a, b = tr(spark, d), X.elementwise(tr(spark, d), lambda v: F.abs(v) + 0.1)
    told = lambda op, name: X.combine(a, b, op).withColumnRenamed("value", name)
    key = ["trace_idx", "time"]
    return told("//", "whole").join(told("%", "rest"), key).join(told("/", "ratio"), key)


@query("SELECT trace_idx, time, CASE WHEN value < 0 THEN 0.5 ELSE power(10, sqrt(value * value)) END AS value FROM tr", "time value")
def x_math(spark, d):
    """Negative ones missing and filled; squares, roots and powers of ten of the others."""
    kept = X.elementwise(tr(spark, d), lambda v: F.when(v >= 0, F.pow(F.lit(10.0), F.sqrt(v * v))))
    return kept.fillna({"value": 0.5})


@query(", m AS (SELECT trace_idx, time, CASE WHEN time >= trace_idx % 4 AND time < 60 + trace_idx % 4 THEN value END AS value FROM tr)\nSELECT trace_idx, time, value FROM m WHERE time BETWEEN 3 AND 59", "time value")
def x_drop_tight(spark, d):
    k = F.pmod("trace_idx", F.lit(4))
    cut = tr(spark, d).withColumn("value", F.when((F.col("time") >= k) & (F.col("time") < 60 + k), F.col("value")))
    return X.drop_tight(cut)


@query(", m AS (SELECT trace_idx, time, CASE WHEN trace_idx % 7 <> 0 OR time % 5 <> 0 THEN value END AS value FROM tr)\nSELECT trace_idx, time, value FROM m WHERE time NOT IN (SELECT time FROM m WHERE value IS NULL)", "time value")
def x_drop_missing(spark, d):
    holed = tr(spark, d).withColumn("value", F.when((F.col("trace_idx") % 7 != 0) | (F.col("time") % 5 != 0), F.col("value")))
    return X.drop_missing(holed)


@query("SELECT trace_idx, time + trace_idx * 10 AS time, value FROM tr", "time value")
def x_shift_each(spark, d):
    shifts = tr_reg(spark, d).select("trace_idx", (F.col("trace_idx") * 10).cast("double").alias("shift"))
    return X.shift_time(tr(spark, d), shifts)


@query("SELECT trace_idx, time FROM (SELECT trace_idx, time, value >= lag(value) OVER w AND value >= lead(value) OVER w AS p FROM tr WINDOW w AS (PARTITION BY trace_idx ORDER BY time)) WHERE p", "time")
def x_local_peaks(spark, d):
    return tr(spark, d).withColumn("p", X.is_local_peak()).where("p").select("trace_idx", "time")


@query("SELECT trace_idx, time, value FROM tr", "time value")
def x_pack_unpack(spark, d):
    """Traces packed into arrays and back."""
    return X.unpack(X.pack(tr(spark, d)))


@query("SELECT trace_idx, time, sum(value) OVER w AS total, stddev_samp(value) OVER w AS spread FROM tr WINDOW w AS (PARTITION BY trace_idx ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "time total spread")
def x_rolling_sum_std(spark, d):
    a = X.rolling(tr(spark, d), 5, "sum").withColumnRenamed("value", "total")
    return a.join(X.rolling(tr(spark, d), 5, "std").withColumnRenamed("value", "spread"), ["trace_idx", "time"])


@query("SELECT trace_idx, w * 8 + 7.5 AS time, 'mean' AS feature, avg(value) AS value FROM tr, (SELECT unnest(range(0, 7)) AS w) WHERE time BETWEEN w * 8 AND w * 8 + 15 GROUP BY trace_idx, w UNION ALL SELECT trace_idx, w * 8 + 7.5, 'peak', max(value) FROM tr, (SELECT unnest(range(0, 7)) AS w) WHERE time BETWEEN w * 8 AND w * 8 + 15 GROUP BY trace_idx, w", "time value")
def k_sliding_features(spark, d):
    """Any features of sliding windows, in chunks."""
    return G.sliding(tr(spark, d), 16.0, 8.0, lambda v, r: {"mean": float(v.mean()), "peak": float(v.max())}, chunk_ms=20.0, origin=0.0)


# --- spikes and clocks --------------------------------------------------------------------------------------------


@query("SELECT event_id, dense_rank() OVER (ORDER BY unit_id % 3, unit_id) - 1 AS unit_id FROM spikes")
def p_renumber(spark, d):
    own = units(spark, d).where("unit_id < 99")
    return P.renumber_units(spikes(spark, d), own, ["probe", "unit_id"])[0].select("event_id", "unit_id")


@query(", b AS (SELECT 0 AS part, event_id, unit_id FROM spikes WHERE cat = 'view' UNION ALL SELECT 1, event_id, unit_id FROM spikes WHERE cat = 'click')\nSELECT part, event_id, dense_rank() OVER (ORDER BY part, unit_id) - 1 AS unit_id FROM b")
def p_concat(spark, d):
    s = spikes(spark, d)
    return P.concat_spikes([s.where("cat = 'view'"), s.where("cat = 'click'")]).select("part", "event_id", "unit_id")


@query("SELECT event_id FROM spikes WHERE ref_time BETWEEN 432000000 AND 864000000")
def p_crop(spark, d):
    return P.crop_spikes(spikes(spark, d), 5 * T.DAY, 10 * T.DAY).select("event_id")


@query("SELECT unit_id, probe FROM units WHERE unit_id IN (SELECT unit_id FROM spikes)")
def p_drop_silent(spark, d):
    return P.drop_silent(spikes(spark, d), units(spark, d)).select("unit_id", "probe")


@query("SELECT event_id FROM spikes WHERE unit_id NOT IN (SELECT unit_id FROM units WHERE unit_id % 2 = 0)")
def p_orphans(spark, d):
    return P.orphans(spikes(spark, d), units(spark, d).where("unit_id % 2 = 0")).select("event_id")


@query("SELECT unit_id, least(floor(isi / 600000), 47)::BIGINT AS bin, count(*) / sum(count(*)) OVER (PARTITION BY unit_id) AS share FROM (SELECT unit_id, ref_time - lag(ref_time) OVER (PARTITION BY unit_id ORDER BY ref_time, event_id) AS isi FROM spikes) WHERE isi BETWEEN 0 AND 28800000 GROUP BY unit_id, bin", "share")
def p_isi_shares(spark, d):
    return P.isi_histogram(spikes(spark, d), 600_000.0, 48, pmf=True).select("unit_id", "bin", "share")


@query("SELECT unit_id, arg_max(site, (n, -site)) AS best_site FROM (SELECT unit_id, event_id % 7 AS site, count(*) AS n FROM spikes GROUP BY ALL) GROUP BY unit_id")
def p_best_site(spark, d):
    return P.cell_props(spikes(spark, d).withColumn("site", F.col("event_id") % 7), "site").select("unit_id", "best_site")


@query("SELECT event_id, (ref_time + 100) * 30000::DOUBLE / (30000::DOUBLE + unit_id % 3) AS ref_time FROM spikes", "ref_time", 3)
def p_probe_clock(spark, d):
    s = P.shift_spikes(spikes(spark, d), 100).withColumn("probe", F.col("unit_id") % 3)
    rates = spark.range(3).select(F.col("id").alias("probe"), (30000.0 + F.col("id")).alias("rate"))
    return P.to_probe_clock(s, rates, 30000.0).select("event_id", "ref_time")


@query("SELECT n, 1000.0 * n + 7 AS common FROM (SELECT unnest(range(0, 40)) AS n)", "common")
def p_common_onsets(spark, d):
    """Two probes' onsets a second apart, one of them late once: an even grid."""
    each = spark.range(40).select(F.col("id").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("probe"))
    late = F.when((F.col("n") == 20) & (F.col("probe") == 1), 9.0).otherwise(0.0)
    return P.common_onsets(each.withColumn("time", F.col("n") * 1000.0 + 6.9 + 0.2 * F.col("probe") + late), step=1000.0)


@query("""
, s AS (SELECT i, i * 86400000.0 AS x0, i * 86400000.0 + (i * i) * 50.0 AS y0, (i + 1) * 86400000.0 AS x1, (i + 1) * 86400000.0 + (i + 1) * (i + 1) * 50.0 AS y1 FROM (SELECT unnest(range(2, 20)) AS i))
SELECT event_id, y0 + (ref_time - x0) * ((y1 - y0) / (x1 - x0)) AS synced FROM ev JOIN s ON i = least(greatest(floor(ref_time / 86400000), 2), 19)""", "synced", 3)
def p_sync_clock(spark, d):
    """A clock that drifts by its own pace each day, known from the third to the twenty-first."""
    i = F.col("id")
    onsets = spark.range(2, 21).select((i * T.DAY).alias("local"), (i * T.DAY + i * i * 50.0).alias("common"))
    return P.sync_clock(ev(spark, d).select("event_id", "ref_time"), onsets, time="ref_time").select("event_id", "synced")


@query("SELECT event_id, (epoch_us(ts) - f) / 1000.0 AS time FROM events JOIN (SELECT user_id, min(epoch_us(ts)) AS f FROM events GROUP BY user_id) USING (user_id)", "time")
def p_frame_times(spark, d):
    e = ev(spark, d).select("event_id", "rec_id", F.rint(F.col("ref_time") * 1000).cast("long").alias("stamp"))
    first = e.groupBy("rec_id").agg(F.min("stamp").alias("first"))
    return P.frame_times(e, first, ["rec_id"]).select("event_id", "time")


@query("SELECT trace_idx, time, value > p AS rise FROM (SELECT trace_idx, time, value, lag(value) OVER (PARTITION BY trace_idx ORDER BY time) AS p FROM tr) WHERE value > p", "time")
def p_rising_edges(spark, d):
    got = P.rising_edges(tr(spark, d), ["trace_idx"], order="time")
    return got.select("trace_idx", "time", F.lit(True).alias("rise"))


# --- catalog ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, e AS event, CASE e WHEN 'half' THEN 45000000.0 + o_orderkey % 60 * 1000 ELSE 0.0 END AS ref_time FROM orders, (SELECT unnest(['o_orderdate', 'half']) AS e)", "ref_time")
def r_clock_events(spark, d):
    o = table(spark, d, "orders").withColumn("half", F.expr("o_orderdate + make_dt_interval(0, 12, 30, o_orderkey % 60)"))
    return P.clock_events(o, ["o_orderdate", "half"], "o_orderkey")


@query("SELECT n_nationkey, i AS line_no, CASE i WHEN 0 THEN 'light on' ELSE 'light off' END AS \"desc\", n_nationkey * 60000.0 + i * 3600000 AS ref_time FROM nation, (SELECT unnest([0, 1]) AS i)", "ref_time")
def r_timestamps(spark, d):
    at = lambda i: F.format_string("%02d:%02d:00", F.lit(i), F.col("n_nationkey"))
    reg = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("light on: "), at(0), F.lit("\n light off : "), at(1), F.lit("\n\n")).alias("notes"))
    return P.timestamps_from_text(reg, "notes", "n_nationkey")


@query("SELECT c_custkey, c_mktsegment || ', ' || c_nationkey AS \"desc\" FROM customer")
def r_short_description(spark, d):
    return P.short_description(table(spark, d, "customer").withColumn("none", F.lit("")), ["c_mktsegment", "none", "c_nationkey"], "c_custkey")


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 7 = 0) AS incomplete, count(*) FILTER (c_custkey % 5 = 0 AND c_custkey % 3 = 0) AS without_probe FROM customer")
def r_quality(spark, d):
    k = F.col("c_custkey")
    reg = table(spark, d, "customer").select(F.when(k % 7 != 0, k).alias("path"), F.when(k % 5 != 0, k).alias("probe0"), F.lit("x").alias("side0"), F.when(k % 3 != 0, k).alias("probe1"), F.lit("y").alias("side1"))
    return P.quality(reg, ["path"], [("probe0", "side0"), ("probe1", "side1")])


@query("SELECT CASE WHEN a % 2 = 1 AND b % 2 = 0 THEN b ELSE a END AS \"first\", CASE WHEN a % 2 = 1 AND b % 2 = 0 THEN a ELSE b END AS second, CASE WHEN a % 2 = 1 AND b % 2 = 0 THEN -l ELSE l END AS lag, a * 0.1 + l AS corr FROM (SELECT x.n_nationkey AS a, y.n_nationkey AS b, l FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey, (SELECT unnest([-2, 0, 3]) AS l))", "corr")
def r_lead_first(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("ch0"))
    pairs = n.join(n.withColumnRenamed("ch0", "ch1"), F.col("ch0") < F.col("ch1"))
    area = lambda c: F.when(F.col(c) % 2 == 0, "CLA").otherwise("OT")
    corr = pairs.withColumn("lag", F.explode(F.array(F.lit(-2), F.lit(0), F.lit(3)))).withColumn("corr", F.col("ch0") * 0.1 + F.col("lag"))
    return P.lead_first(pairs.withColumns({"area0": area("ch0"), "area1": area("ch1")}), corr, "CLA")


@query("SELECT rec_id FROM (SELECT rec_id, count(*) AS n FROM (SELECT user_id AS rec_id FROM events WHERE event_type IN ('view', 'click')) GROUP BY rec_id) WHERE n >= 2")
def r_bilateral(spark, d):
    probes = ev(spark, d).select("rec_id", F.when(F.col("cat").isin("view", "click"), "cla-left").otherwise("ot").alias("probe"))
    return P.is_bilateral(probes, "CLA", "rec_id")


@query("SELECT exp_name, i AS probe_no, p AS probe, s AS side FROM (SELECT c_custkey AS exp_name, 0 AS i, c_mktsegment AS p, 'L' AS s FROM customer UNION ALL SELECT c_custkey, 1, 'second', 'R' FROM customer WHERE c_custkey % 2 = 0)")
def r_unpivot_probes(spark, d):
    reg = table(spark, d, "customer").select(F.col("c_custkey").alias("exp_name"), F.col("c_mktsegment").alias("probe0"), F.lit("L").alias("side0"), F.when(F.col("c_custkey") % 2 == 0, "second").alias("probe1"), F.lit("R").alias("side1"))
    return P.unpivot_probes(reg, 2).select("exp_name", "probe_no", "probe", "side")


@query(", p AS (SELECT trace_idx % 10 AS rec, trace_idx, time, CASE WHEN sqrt((value * 60) ** 2 + (value * 80) ** 2) <= 100 THEN sqrt((value * 60) ** 2 + (value * 80) ** 2) END AS value FROM tr), q AS (SELECT rec, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM p GROUP BY rec)\nSELECT trace_idx, time, (value - a) / (b - a) AS value FROM p JOIN q USING (rec)", "time value")
def r_eye_opening(spark, d):
    v = F.col("value")
    points = tr(spark, d).select((F.col("trace_idx") % 10).alias("rec"), "trace_idx", "time", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (v * 60).alias("x1"), (v * 80).alias("y1"))
    return P.eye_opening(points, ["rec"]).select("trace_idx", "time", "value")


@query(", m AS (SELECT trace_idx, time, quantile_cont(value, 0.5) OVER (PARTITION BY trace_idx ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM tr)\nSELECT trace_idx, time, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS value FROM m WINDOW w AS (PARTITION BY trace_idx)", "time value")
def r_normal_luminance(spark, d):
    return P.normal_luminance(tr(spark, d), ["trace_idx"], smooth=5).select("trace_idx", "time", "value")


@query("SELECT grp, time, max(value) AS beta_max, avg(value) AS beta_mean FROM tr JOIN tr_reg USING (trace_idx) GROUP BY grp, time", "time beta_max beta_mean")
def r_strongest_channel(spark, d):
    return P.strongest_channel(tr(spark, d).join(tr_reg(spark, d), "trace_idx"), ["grp"])


# --- statistics ---------------------------------------------------------------------------------------------------

TAIL = "least((((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-z * z / 2), 1.0)"


@query(f"""
, p AS (SELECT trace_idx, avg(value) FILTER (time < 32) AS a, avg(value) FILTER (time >= 32) AS b FROM tr GROUP BY trace_idx),
x AS (SELECT grp, b - a AS dd FROM p JOIN tr_reg USING (trace_idx) WHERE b <> a),
r AS (SELECT grp, dd, rank() OVER (PARTITION BY grp ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY grp, abs(dd)) - 1) / 2.0 AS r FROM x),
s AS (SELECT grp, sum(CASE WHEN dd > 0 THEN r ELSE 0 END)::DOUBLE AS w, count(*)::DOUBLE AS n FROM r GROUP BY grp),
z AS (SELECT grp, greatest(abs(w - n * (n + 1) / 4) - 0.5, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s)
SELECT grp, z, {TAIL} AS p FROM (SELECT grp, z, 1 / (1 + 0.3275911 * z / sqrt(2)) AS t FROM z)""", "z p")
def d_wilcoxon_p(spark, d):
    half = lambda c: F.avg(F.when(c, F.col("value")))
    p = tr(spark, d).groupBy("trace_idx").agg(half(F.col("time") < 32).alias("a"), half(F.col("time") >= 32).alias("b"))
    return Y.wilcoxon_p(p.join(tr_reg(spark, d), "trace_idx"), "a", "b", ["grp"]).select("grp", "z", "p")


@query(f"""
, r AS (SELECT o_orderpriority, o_orderstatus, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS r FROM orders),
u AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS n1, count(*) FILTER (o_orderstatus <> 'F')::DOUBLE AS n2, sum(r) FILTER (o_orderstatus = 'F')::DOUBLE - n1 * (n1 + 1) / 2 AS u FROM r GROUP BY o_orderpriority),
z AS (SELECT o_orderpriority, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM u)
SELECT o_orderpriority, z, {TAIL} AS p FROM (SELECT o_orderpriority, z, 1 / (1 + 0.3275911 * z / sqrt(2)) AS t FROM z)""", "z p")
def d_mannwhitney_p(spark, d):
    return Y.mann_whitney_test(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", ["o_orderpriority"]).select("o_orderpriority", "z", "p")


@query("SELECT event_id, CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', p) END || CASE WHEN p < 0.001 THEN ' ***' WHEN p < 0.01 THEN ' **' WHEN p < 0.05 THEN ' *' ELSE '' END AS text FROM (SELECT event_id, event_id % 1000 / 1000.0 + 0.00025 AS p FROM ev)")
def d_format_p(spark, d):
    return ev(spark, d).select("event_id", Y.format_p(F.col("event_id") % 1000 / 1000.0 + 0.00025).alias("text"))


@query("SELECT cat, least(floor(x * 8), 7)::BIGINT AS bin, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY cat) AS share FROM (SELECT cat, ref_time / 86400000 - floor(ref_time / 86400000) AS x FROM ev) GROUP BY cat, bin", "share")
def d_phase_histogram(spark, d):
    day = F.col("ref_time") / T.DAY
    return Y.phase_histogram(ev(spark, d).withColumn("x", day - F.floor(day)), "x", 8, ["cat"])


@query("SELECT event_id, x + dx AS x, y + dy AS y FROM (SELECT event_id, amplitude / 1000 AS x, ref_time / 2678400000 AS y FROM ev), (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE x + dx BETWEEN -0.5 AND 1.5 AND y + dy BETWEEN -0.5 AND 1.5", "x y")
def d_circular_copies(spark, d):
    own = ev(spark, d).select("event_id", (F.col("amplitude") / 1000).alias("x"), (F.col("ref_time") / 2678400000).alias("y"))
    return Y.circular_copies(own, "x", "y", (-0.5, 1.5))




# --- sources and streams ------------------------------------------------------------------------------------------


def _raw(spark, d):
    """The traces as channels of a recording of 30 kHz."""
    return tr(spark, d).select(F.col("trace_idx").alias("channel"), F.col("time").cast("long").alias("i"), "value")


@query(", w AS (SELECT * FROM (VALUES (0, 0.2, 1.0, 0.5), (1, 0.5, 1.5, 1.0)) AS w(win_idx, start, stop, ref)), r AS (SELECT win_idx, ref::DOUBLE AS ref, round_even(start * 30, 0)::BIGINT AS a, round_even(stop * 30, 0)::BIGINT AS b FROM w)\nSELECT win_idx, trace_idx AS channel, time / 30.0 - ref AS time, value FROM tr JOIN r ON time >= a AND time < b AND (time::BIGINT - a) % 3 = 0 WHERE trace_idx IN (1, 4, 9)", "time value")
def x_load_windows(spark, d):
    from ..sources.recordings import load_windows

    wins = spark.sql("SELECT * FROM VALUES (0, 0.2D, 1.0D, 0.5D), (1, 0.5D, 1.5D, 1.0D) AS w(win_idx, start, stop, ref)")
    return load_windows(_raw(spark, d), wins, 30_000.0, 10_000.0, [1, 4, 9])


@query("SELECT 'a' AS probe, time::BIGINT AS i, trace_idx AS global_channel FROM tr WHERE trace_idx < 5 UNION ALL SELECT 'b', time::BIGINT, trace_idx + 5 FROM tr WHERE trace_idx < 3")
def x_union_probes(spark, d):
    from ..sources.recordings import union_probes

    raw = _raw(spark, d)
    got = union_probes({"a": raw.where("channel < 5"), "b": raw.where("channel < 3")})
    return got.select("probe", "i", F.col("global_channel").cast("long").alias("global_channel"))


@query("SELECT user_id AS rec, count(*) AS files, min(event_id) AS n_samples, min(epoch_us(ts)) AS first_stamp, max(epoch_us(ts)) - min(epoch_us(ts)) <= 2400000000000 AS agrees FROM events GROUP BY user_id")
def r_joint_recording(spark, d):
    from ..sources.recordings import joint_recording

    stamp = F.rint(F.col("ref_time") * 1000).cast("long") + 1704067200000000
    files = ev(spark, d).select(F.col("rec_id").alias("rec"), F.col("event_id").alias("n_samples"), F.lit(30000.0).alias("rate"), stamp.alias("first_stamp"), F.timestamp_micros(stamp).alias("opened"))
    return joint_recording(files, ["rec"], 2_400_000.0).drop("rate")


def _stamped(spark, d):
    """Instants that don't depend on the session's zone."""
    return ev(spark, d).select("cat", F.col("rec_id").alias("user_id"), F.timestamp_micros(F.rint(F.col("ref_time") * 1000).cast("long") + 1704067200000000).alias("ts"))


@query("SELECT cat, start / 1000.0 AS start, count(*) AS count FROM (SELECT cat, floor(ref_time / 21600000) * 21600000 AS start FROM ev) GROUP BY cat, start", "start")
def s_tumbling(spark, d):
    """The streaming count over a table at rest."""
    from ..streaming.streams import tumbling_counts

    got = tumbling_counts(_stamped(spark, d), "ts", "6 hours", ["cat"])
    return got.select("cat", ((F.unix_micros("start") - 1704067200000000) / 1e6).alias("start"), "count")


@query("SELECT cat, (floor(ref_time / 21600000) - k) * 21600.0 AS start, count(*) AS count FROM ev, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL", "start")
def s_sliding(spark, d):
    """Windows of a day every six hours."""
    from ..streaming.streams import tumbling_counts

    got = tumbling_counts(_stamped(spark, d), "ts", "24 hours", ["cat"], slide="6 hours")
    return got.select("cat", ((F.unix_micros("start") - 1704067200000000) / 1e6).alias("start"), "count")


@query("""
, f AS (SELECT rec_id, ref_time, CASE WHEN ref_time - lag(ref_time) OVER w < 21600000 THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY ref_time)),
g AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY ref_time ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT rec_id, min(ref_time) / 1000 AS start, max(ref_time) / 1000 + 21600 AS stop, count(*) AS count FROM g GROUP BY rec_id, run""", "start stop", 3)
def s_sessions(spark, d):
    from ..streaming.streams import sessions

    got = sessions(_stamped(spark, d), "ts", "6 hours", ["user_id"])
    second = lambda c: (F.unix_micros(c) - 1704067200000000) / 1e6
    return got.select(F.col("user_id").alias("rec_id"), second("start").alias("start"), second("stop").alias("stop"), "count")
