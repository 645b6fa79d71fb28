"""Queries of time units, selections, windows and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeunits as T
from ..operators import events as E
from ..operators import select as S
from ..operators import windows as W
from .adapters import ev, table, wbetween, wpurchase, wship
from .registry import query

H = T.HOUR

# --- time ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, floor(ref_time / 1000) * 1000 AS floor_s, ceil(ref_time / 1000) * 1000 AS ceil_s, round_even(ref_time / 60000, 0) * 60000 AS round_min, ref_time - floor(ref_time / 86400000) * 86400000 AS rem_day FROM ev", "floor_s ceil_s round_min rem_day")
def t_ms_rounding(spark, d):
    t = "ref_time"
    return ev(spark, d).select("event_id", T.ms_floor(t, "seconds").alias("floor_s"), T.ms_ceil(t, "seconds").alias("ceil_s"), T.ms_round(t, "minutes").alias("round_min"), T.ms_remainder(t, "days").alias("rem_day"))


@query("""
, v AS (SELECT event_id, floor(ref_time / 1000)::BIGINT AS s, floor(ref_time - floor(ref_time / 1000) * 1000)::BIGINT AS p FROM ev)
SELECT event_id, printf('%02d:%02d', s // 3600, (s // 60) % 60) || CASE WHEN s % 60 = 0 AND p = 0 THEN '' ELSE printf(':%02d', s % 60) END || CASE WHEN p > 0 THEN printf('.%03d', p) ELSE '' END AS txt FROM v""")
def t_ms_to_str(spark, d):
    return ev(spark, d).select("event_id", T.ms_to_str("ref_time").alias("txt"))


@query("SELECT event_id, floor(ref_time) AS back FROM ev", "back")
def t_str_to_ms(spark, d):
    """Text and back: to the millisecond below."""
    return ev(spark, d).select("event_id", T.str_to_ms(T.ms_to_str("ref_time", strip=False, show_days=True)).alias("back"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000.0 AS solar, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000.0 - 25200000 AS circ FROM events", "solar circ")
def t_solar_circ(spark, d):
    return table(spark, d, "events").select("event_id", T.solar_offset("ts").alias("solar"), T.circ_offset("ts").alias("circ"))


@query("SELECT event_id, round_even(30.0 * ref_time / 1000, 0)::BIGINT AS idx, round_even(30.0 * ref_time / 1000, 0) / 30.0 * 1000 AS at_ms FROM ev", "at_ms")
def t_ms_to_idcs(spark, d):
    rate = T.SamplingRate(30.0)
    out = ev(spark, d).select("event_id", rate.ms_to_idcs("ref_time").alias("idx"))
    return out.withColumn("at_ms", rate.idcs_to_ms("idx"))


# --- selections ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, rec_id, cat FROM ev WHERE cat = 'purchase' OR rec_id = 7")
def s_match_any(spark, d):
    return S.sel_match(ev(spark, d), how="any", cat="purchase", rec_id=7).select("event_id", "rec_id", "cat")


@query("SELECT event_id FROM ev WHERE NOT (cat = 'purchase' AND rec_id = 7)")
def s_match_invert(spark, d):
    return S.sel_match(ev(spark, d), invert=True, cat="purchase", rec_id=7).select("event_id")


@query("SELECT event_id, amplitude FROM ev WHERE amplitude BETWEEN 10 AND 50 AND ref_time BETWEEN 86400000 AND 864000000", "amplitude")
def s_between_closed(spark, d):
    return S.sel_between(ev(spark, d), amplitude=(10.0, 50.0), ref_time=(86400000.0, 864000000.0)).select("event_id", "amplitude")


@query("SELECT event_id, cat FROM ev WHERE cat NOT IN ('purchase', 'view')")
def s_isin_invert(spark, d):
    return S.sel_in(ev(spark, d), invert=True, cat=["purchase", "view"]).select("event_id", "cat")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def s_rows_invert(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.sel_rows(table(spark, d, "orders").select("o_orderkey"), rows, "o_orderkey", invert=True)


@query("SELECT c_custkey AS cust, s_suppkey AS supp, c_nationkey AS nation FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def s_registry_match(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return S.natural_match(c, s, left_ref="cust", right_ref="supp").select("cust", "supp", "nation")


@query("SELECT cat, rec_id, count(*) AS count FROM ev GROUP BY cat, rec_id")
def s_value_counts(spark, d):
    return S.value_counts(ev(spark, d), "cat", "rec_id")


# --- constructing windows -----------------------------------------------------------------------------------------


@query("SELECT win_idx, (start + stop) / 2 - 500 AS start, (start + stop) / 2 + 1500 AS stop, (start + stop) / 2 AS ref FROM wship", "start stop ref")
def w_around(spark, d):
    return W.around(wship(spark, d), -500, 1500).select("win_idx", "start", "stop", "ref")


@query("SELECT event_id, name, ref_time + a AS start, ref_time + b AS stop, ref_time AS ref FROM ev, (VALUES ('pre', -10.0, 0.0), ('post', 0.0, 10.0)) AS n(name, a, b) WHERE cat = 'purchase'", "start stop ref")
def w_around_multiple(spark, d):
    marks = ev(spark, d).where("cat = 'purchase'").select("event_id", F.col("ref_time").alias("time"))
    return W.build_around_multiple(marks, {"pre": (-10, 0), "post": (0, 10)})


@query("SELECT * FROM (SELECT rec_id, ref_time AS start, lead(ref_time) OVER w AS stop, ref_time AS ref, cat AS start_cat, lead(cat) OVER w AS stop_cat FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY ref_time)) WHERE stop IS NOT NULL", "start stop ref")
def w_between_meta(spark, d):
    return W.build_between(ev(spark, d).select("rec_id", "cat", F.col("ref_time").alias("time")), by=["rec_id"])


@query("SELECT win_idx, k::BIGINT AS slide, start + k * 5184000000.0 AS start, start + k * 5184000000.0 + 7776000000.0 AS stop FROM (SELECT *, unnest(range(0, 1 + greatest(-1, floor((stop - start - 7776000000.0) / 5184000000.0))::BIGINT)) AS k FROM wship)", "start stop")
def w_sliding(spark, d):
    return W.build_sliding(wship(spark, d), 90 * T.DAY, 60 * T.DAY).select("win_idx", "slide", "start", "stop")


@query("""
, f AS (SELECT conv_id, turn, role, CASE WHEN role <> lag(role) OVER w OR lag(role) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT conv_id, role AS cat, count(*) AS count, min(turn) - 0.5 AS start, max(turn) + 0.5 AS stop FROM g GROUP BY conv_id, role, run""", "start stop")
def w_runs(spark, d):
    return W.runs(table(spark, d, "conversations"), "turn", "role", by=["conv_id"]).drop("ref")


@query("SELECT n_nationkey AS key, n_name AS cat, n_nationkey * 60000.0 AS start, n_nationkey * 60000.0 + 3600000.0 AS stop FROM nation", "start stop")
def w_from_text(spark, d):
    """Windows written as text and read back."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("cat"), (F.col("n_nationkey") * 60000.0).alias("start"))
    text = W.to_text(n.withColumn("stop", F.col("start") + 3600000.0), by=["key"])
    return W.from_text(text, "text").drop("ref")


@query("SELECT win_idx, 'pre' AS \"when\", start - 1000 AS start, start AS stop FROM wship UNION ALL SELECT win_idx, 'post', stop, stop + 2000 FROM wship", "start stop")
def w_before_after(spark, d):
    return W.before_after(wship(spark, d), 1000, 2000).select("win_idx", "when", "start", "stop")


@query("SELECT win_idx, row_number() OVER (ORDER BY start, stop, ref, win_idx) - 1 AS nth FROM wship WHERE rec_id = 7")
def w_reset_index(spark, d):
    own = wship(spark, d).where("rec_id = 7").withColumnRenamed("win_idx", "old")
    return W.reset_index(own, sort_by=("start", "stop", "ref", "old")).select(F.col("old").alias("win_idx"), F.col("win_idx").alias("nth"))


# --- set operations -----------------------------------------------------------------------------------------------


@query("SELECT win_idx, greatest(start, -8e11) AS start, least(stop, -7e11) AS stop FROM wship WHERE greatest(start, -8e11) <= least(stop, -7e11)", "start stop")
def w_crop(spark, d):
    return W.crop(wship(spark, d), -8e11, -7e11).select("win_idx", "start", "stop")


UNION_SQL = """
, f AS (SELECT rec_id, start, stop, win_idx, CASE WHEN start > max(stop) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM wship),
g AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM f),
u AS (SELECT rec_id, min(start) AS start, max(stop) AS stop, count(*) AS merged FROM g GROUP BY rec_id, run)"""


@query(UNION_SQL + "\nSELECT rec_id, start, stop, merged FROM u", "start stop")
def w_merge_overlap(spark, d):
    return W.merge_overlap(wship(spark, d), ["rec_id"]).select("rec_id", "start", "stop", "merged")


@query(UNION_SQL + ", h AS (SELECT rec_id, stop AS start, lead(start) OVER (PARTITION BY rec_id ORDER BY start, stop) AS stop FROM u)\nSELECT rec_id, start, stop FROM h WHERE stop > start", "start stop")
def w_invert(spark, d):
    return W.invert(wship(spark, d), ["rec_id"])


@query(UNION_SQL + ", h AS (SELECT rec_id, stop AS start, lead(start) OVER (PARTITION BY rec_id ORDER BY start, stop) AS stop FROM u), c AS (SELECT rec_id, cat, start, stop FROM wship UNION ALL SELECT rec_id, 'unknown', start, stop FROM h WHERE stop > start)\nSELECT rec_id, cat, count(*) AS n, sum(stop - start) AS total FROM c GROUP BY rec_id, cat", "total")
def w_complement(spark, d):
    return W.complement(wship(spark, d), ["rec_id"]).groupBy("rec_id", "cat").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("total"))


@query("""
, f AS (SELECT *, CASE WHEN start <= lag(stop) OVER w AND cat = lag(cat) OVER w THEN 0 ELSE 1 END AS n FROM wbetween WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)),
g AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT rec_id, cat, min(start) AS start, max(stop) AS stop FROM g GROUP BY rec_id, cat, run""", "start stop")
def w_merge_tight(spark, d):
    return W.merge_tight(wbetween(spark, d), ["rec_id"], same="cat").select("rec_id", "cat", "start", "stop")


@query("SELECT win_idx FROM (SELECT win_idx, lead(start) OVER (PARTITION BY rec_id ORDER BY start, stop, win_idx) AS n, stop FROM wship) WHERE n IS NULL OR n >= stop")
def w_drop_overlap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id").orderBy("start", "stop", "win_idx")
    return wship(spark, d).withColumn("n", F.lead("start").over(w)).where("n IS NULL OR n >= stop").select("win_idx")


@query("SELECT win_idx AS main_win_idx, k::BIGINT AS tile, start + k * 7776000000.0 AS start, start + (k + 1) * 7776000000.0 AS stop FROM (SELECT *, unnest(range(0, ceil((stop - start) / 7776000000.0)::BIGINT - 1)) AS k FROM wship)", "start stop")
def w_split(spark, d):
    return W.split(wship(spark, d), 90 * T.DAY).select("main_win_idx", "tile", "start", "stop")


@query("SELECT win_idx, coalesce(sum(stop - start) OVER (PARTITION BY rec_id ORDER BY start, stop, win_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM wbetween", "start", 4)
def w_defrag(spark, d):
    return W.defrag(wbetween(spark, d), ["rec_id"]).select("win_idx", "start")


@query("SELECT win_idx, start + win_idx % 10 AS start, stop + win_idx % 10 AS stop FROM wship", "start stop", 4)
def w_shift(spark, d):
    w = wship(spark, d)
    shifts = w.select("win_idx", (F.col("win_idx") % 10).cast("double").alias("shift"))
    return W.shift_time(w, shifts).select("win_idx", "start", "stop")


@query(", l AS (SELECT rec_id, quantile_cont(stop - start, 0.5) AS m FROM wbetween GROUP BY rec_id)\nSELECT win_idx, start AS start, start + (stop - start) * m / (stop - start) AS stop FROM wbetween JOIN l USING (rec_id) WHERE stop > start", "start stop", 4)
def w_force_uniform(spark, d):
    return W.force_uniform(wbetween(spark, d).where("stop > start"), ["rec_id"]).select("win_idx", "start", "stop")


@query("SELECT win_idx, min(ref - start) OVER (PARTITION BY rec_id) AS pre, min(stop - ref) OVER (PARTITION BY rec_id) AS post FROM wpurchase", "pre post")
def w_minimum_common(spark, d):
    return W.crop_to_minimum_common(wpurchase(spark, d), ["rec_id"]).select("win_idx", (F.col("ref") - F.col("start")).alias("pre"), (F.col("stop") - F.col("ref")).alias("post"))


@query("SELECT b.win_idx, p.win_idx AS cut_win_idx, greatest(b.start, p.start) - p.ref AS start, least(b.stop, p.stop) - p.ref AS stop FROM wbetween b JOIN wpurchase p ON b.rec_id = p.rec_id AND b.stop > p.start AND p.stop > b.start", "start stop")
def w_extract(spark, d):
    return W.extract(wbetween(spark, d), wpurchase(spark, d), ["rec_id"], align="ref").select("win_idx", "cut_win_idx", "start", "stop")


@query("SELECT rec_id, edge FROM (SELECT rec_id, start AS edge FROM wship UNION SELECT rec_id, stop FROM wship)", "edge")
def w_edges(spark, d):
    return W.edges(wship(spark, d), ["rec_id"])


@query("SELECT win_idx, start, least(stop, -7.5e11) AS stop FROM wship WHERE least(stop, -7.5e11) > start UNION ALL SELECT win_idx, greatest(start, -7.4e11), stop FROM wship WHERE stop > greatest(start, -7.4e11)", "start stop")
def w_subtract(spark, d):
    return W.subtract(wship(spark, d).select("win_idx", "start", "stop"), -7.5e11, -7.4e11)


@query("SELECT win_idx, floor(start / 3600000) * 3600000 AS start, ceil(stop / 3600000) * 3600000 AS stop FROM wpurchase", "start stop")
def w_round_edges(spark, d):
    return W.round_edges(wpurchase(spark, d), H, "floor_ceil").select("win_idx", "start", "stop")


# --- joins --------------------------------------------------------------------------------------------------------

HELD = "FROM ev e JOIN wpurchase w ON e.rec_id = w.rec_id AND e.ref_time {} w.start AND e.ref_time {} w.stop"


@query("SELECT e.event_id, w.win_idx, e.ref_time - w.ref AS delay " + HELD.format(">=", "<"), "delay")
def w_classify_left(spark, d):
    e = ev(spark, d).select("event_id", "rec_id", "ref_time")
    return W.classify_events(e, wpurchase(spark, d), "ref_time", ["rec_id"]).select("event_id", "win_idx", "delay")


@query("SELECT e.event_id, w.win_idx, e.ref_time - w.start AS delay_from_start, e.ref_time - w.stop AS delay_from_stop " + HELD.format(">", "<="), "delay_from_start delay_from_stop")
def w_classify_right(spark, d):
    e = ev(spark, d).select("event_id", "rec_id", "ref_time")
    return W.classify_events(e, wpurchase(spark, d), "ref_time", ["rec_id"], refs=["start", "stop"], right=True).select("event_id", "win_idx", "delay_from_start", "delay_from_stop")


@query("SELECT e.event_id, coalesce(w.win_idx, -1) AS w_win_idx, w.cat AS w_cat, e.ref_time - w.ref AS delay FROM ev e LEFT JOIN wbetween w ON e.rec_id = w.rec_id AND e.ref_time >= w.start AND e.ref_time < w.stop", "delay")
def w_annotate_events(spark, d):
    e = ev(spark, d).select("event_id", "rec_id", "ref_time")
    return W.annotate_events(e, wbetween(spark, d), "ref_time", ["rec_id"], prefix="w_").select("event_id", F.coalesce("w_win_idx", F.lit(-1)).alias("w_win_idx"), "w_cat", "delay")


MEET = "FROM wbetween b JOIN wpurchase p ON b.rec_id = p.rec_id AND b.stop > p.start AND p.stop > b.start"


@query(f"SELECT b.win_idx, p.win_idx AS other_win_idx, greatest(b.start, p.start) - p.ref AS start, least(b.stop, p.stop) - p.ref AS stop {MEET}", "start stop")
def w_classify_windows_crop(spark, d):
    return W.classify_windows(wbetween(spark, d), wpurchase(spark, d), ["rec_id"]).select("win_idx", "other_win_idx", "start", "stop")


@query(f"SELECT b.win_idx, p.win_idx AS other_win_idx, b.start - p.start AS start, b.stop - p.start AS stop {MEET}", "start stop")
def w_classify_windows_keep(spark, d):
    return W.classify_windows(wbetween(spark, d), wpurchase(spark, d), ["rec_id"], align="start", edges="keep").select("win_idx", "other_win_idx", "start", "stop")


@query(f"SELECT b.win_idx, p.win_idx AS other_win_idx, b.start - p.ref AS start {MEET} WHERE b.start >= p.start AND b.stop <= p.stop", "start")
def w_classify_windows_drop(spark, d):
    return W.classify_windows(wbetween(spark, d), wpurchase(spark, d), ["rec_id"], edges="drop").select("win_idx", "other_win_idx", "start")


@query("SELECT b.rec_id, b.win_idx, EXISTS (SELECT 1 FROM wpurchase p WHERE p.rec_id = b.rec_id AND b.start >= p.start AND b.stop <= p.stop) AS contained FROM wbetween b")
def w_contained_in_others(spark, d):
    return W.contained_in_others(wbetween(spark, d), wpurchase(spark, d), ["rec_id"])


@query("SELECT b.win_idx FROM wbetween b WHERE EXISTS (SELECT 1 FROM wpurchase p WHERE p.rec_id = b.rec_id AND b.start >= p.start AND b.stop <= p.stop)")
def w_within_any(spark, d):
    return W.is_within_any(wbetween(spark, d), wpurchase(spark, d), ["rec_id"]).select("win_idx")


@query("SELECT e.event_id, w.cat AS state FROM ev e LEFT JOIN wbetween w ON e.rec_id = w.rec_id AND e.ref_time > w.start AND e.ref_time <= w.stop")
def w_generate_cat(spark, d):
    t = ev(spark, d).select("event_id", "rec_id", F.col("ref_time").alias("time"))
    return W.generate_cat(wbetween(spark, d).withColumnRenamed("cat", "state"), t, by=["rec_id"], col="state", closed="right").select("event_id", "state")


@query("SELECT e.event_id, w.win_idx, e.ref_time - w.ref AS time FROM ev e JOIN wpurchase w ON e.rec_id = w.rec_id AND e.ref_time BETWEEN w.start AND w.stop", "time")
def w_crop_signal(spark, d):
    s = ev(spark, d).select("event_id", "rec_id", F.col("ref_time").alias("time"))
    return W.crop_signal(s, wpurchase(spark, d), by=["rec_id"]).select("event_id", "win_idx", "time")


# --- measures -----------------------------------------------------------------------------------------------------


@query("SELECT cat, sum(stop - start) AS total FROM wship GROUP BY cat", "total")
def w_total_by_cat(spark, d):
    return W.total_by(wship(spark, d), "cat")


@query("SELECT rec_id, least(min(start), min(stop)) AS start, greatest(max(start), max(stop)) AS stop FROM wship GROUP BY rec_id", "start stop")
def w_global_win_grouped(spark, d):
    return W.global_win(wship(spark, d), "rec_id")


@query("SELECT win_idx, lead(start) OVER (PARTITION BY rec_id ORDER BY ref, start, stop) - stop AS interval FROM wbetween", "interval")
def w_inter_intervals(spark, d):
    return W.inter_intervals(wbetween(spark, d), ["rec_id"]).select("win_idx", "interval")


@query("SELECT win_idx, i AS interval FROM (SELECT win_idx, cat, lead(cat) OVER w AS n, lead(ref) OVER w - ref AS i FROM wbetween WHERE cat IN ('view', 'purchase') WINDOW w AS (PARTITION BY rec_id ORDER BY ref, start, stop)) WHERE cat = 'view' AND n = 'purchase'", "interval")
def w_inter_intervals_by(spark, d):
    return W.inter_intervals_by(wbetween(spark, d), "view", "purchase", ["rec_id"]).select("win_idx", "interval")


@query("SELECT win_idx, coalesce(start - lag(stop) OVER w, 'inf'::DOUBLE) >= 3600000 AND coalesce(lead(start) OVER w - stop, 'inf'::DOUBLE) >= 3600000 AS isolated FROM wpurchase WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)")
def w_isolated(spark, d):
    return W.is_isolated(wpurchase(spark, d), H, ["rec_id"]).select("win_idx", "isolated")


@query("SELECT cat, least(floor((stop - start) / 86400000.0), 119)::BIGINT AS bin, count(*) AS count FROM wship WHERE stop - start BETWEEN 0 AND 120 * 86400000.0 GROUP BY ALL")
def w_hist_length_by(spark, d):
    return W.histogram(wship(spark, d), F.col("stop") - F.col("start"), 0, 120 * T.DAY, 120, ["cat"]).select("cat", "bin", "count")


@query("""
, s AS (SELECT rec_id, start, stop, cat, lag(stop) OVER w AS p, lag(cat) OVER w AS c FROM wbetween WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop))
SELECT rec_id, max(stop - start) - min(stop - start) <= 1e-8 AS are_uniform, bool_and(coalesce(cat <> c, true)) AS are_alternating, bool_and(coalesce(start >= p, true)) AS are_exclusive, bool_and(start = round(start) AND stop = round(stop)) AS are_integer, bool_and(coalesce(start = p, true)) AS are_tight FROM s GROUP BY rec_id""")
def w_flags(spark, d):
    return W.set_flags(wbetween(spark, d), ["rec_id"])


@query("SELECT win_idx FROM (SELECT win_idx, cat, lag(cat) OVER w AS p, lead(cat) OVER w AS n FROM wbetween WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)) WHERE p = n AND cat <> n")
def w_sandwiched(spark, d):
    return wbetween(spark, d).withColumn("s", W.is_sandwiched(["rec_id"])).where("s").select("win_idx")


# --- events -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, lead(ref_time) OVER (PARTITION BY rec_id ORDER BY ref_time, event_id) - ref_time AS interval FROM ev", "interval")
def e_inter_event(spark, d):
    return E.inter_event_intervals(ev(spark, d), ["rec_id"]).select("event_id", "interval")


@query("SELECT event_id, i AS interval FROM (SELECT event_id, cat, lead(cat) OVER w AS n, lead(ref_time) OVER w - ref_time AS i FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY ref_time, event_id)) WHERE cat = 'view' AND n = 'purchase'", "interval")
def e_between_channels(spark, d):
    return E.intervals_between_channels(ev(spark, d), "view", "purchase", ["rec_id"], col="cat").select("event_id", "interval")


@query("SELECT event_id, least(abs(lead(ref_time) OVER w - ref_time), abs(ref_time - lag(ref_time) OVER w)) AS to_closest FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY ref_time, event_id)", "to_closest")
def e_closest(spark, d):
    return E.time_to_closest(ev(spark, d), ["rec_id"]).select("event_id", "to_closest")


@query(", b AS (SELECT unnest(range(0, 29)) AS bin), k AS (SELECT DISTINCT cat FROM ev), n AS (SELECT cat, least(floor(ref_time / 86400000), 28)::BIGINT AS bin, count(*) AS c FROM ev WHERE ref_time BETWEEN 0 AND 29 * 86400000.0 GROUP BY ALL)\nSELECT cat, bin, coalesce(c, 0) AS count FROM k CROSS JOIN b LEFT JOIN n USING (cat, bin)")
def e_counts_bins(spark, d):
    return E.counts_in_bins(ev(spark, d), 0, 30 * T.DAY, T.DAY, ["cat"])


@query("SELECT least(floor(ref_time / 86400000), 29)::BIGINT AS tbin, least(floor(amplitude / 10), 9)::BIGINT AS vbin, count(*) AS count FROM ev WHERE ref_time BETWEEN 0 AND 30 * 86400000.0 AND amplitude BETWEEN 0 AND 100 GROUP BY ALL")
def e_hist2d(spark, d):
    return E.histogram2d(ev(spark, d), (0, 30 * T.DAY, 30), (0, 100, 10))


GRID = ", k AS (SELECT DISTINCT cat FROM ev), g AS (SELECT cat, unnest(range(0, 120))::DOUBLE * 21600000.0 AS grid_time FROM k)"


def _keys(spark, d):
    return ev(spark, d).select("cat").distinct()


@query(GRID + "\nSELECT g.cat, g.grid_time, count(e.ref_time) AS count FROM g LEFT JOIN ev e ON e.cat = g.cat AND e.ref_time BETWEEN g.grid_time - 43200000.0 AND g.grid_time + 43200000.0 GROUP BY ALL", "grid_time")
def e_count_rolling(spark, d):
    return E.count_rolling(ev(spark, d), _keys(spark, d), 0, 30 * T.DAY, 6 * H, 24 * H, ["cat"])


@query(GRID + "\nSELECT g.cat, g.grid_time, count(e.ref_time) / 86400.0 AS rate FROM g LEFT JOIN ev e ON e.cat = g.cat AND e.ref_time BETWEEN g.grid_time - 43200000.0 AND g.grid_time + 43200000.0 GROUP BY ALL", "grid_time rate")
def e_rate_box(spark, d):
    return E.rate_rolling_box(ev(spark, d), _keys(spark, d), 0, 30 * T.DAY, 6 * H, 24 * H, ["cat"]).drop("count")


@query(GRID + "\nSELECT g.cat, g.grid_time, CASE WHEN count(amplitude) >= 3 THEN avg(amplitude) END AS mean FROM g LEFT JOIN ev e ON e.cat = g.cat AND e.ref_time BETWEEN g.grid_time - 43200000.0 AND g.grid_time + 43200000.0 GROUP BY ALL", "grid_time mean")
def e_mean_rolling(spark, d):
    return E.mean_rolling(ev(spark, d), _keys(spark, d), 0, 30 * T.DAY, 6 * H, 24 * H, "amplitude", ["cat"], nmin=3)


@query(GRID + "\nSELECT g.cat, g.grid_time, quantile_cont(amplitude, 0.25) AS low, quantile_cont(amplitude, 0.5) AS mid, quantile_cont(amplitude, 0.75) AS high, quantile_cont(amplitude, 0.75) - quantile_cont(amplitude, 0.25) AS iqr FROM g LEFT JOIN ev e ON e.cat = g.cat AND e.ref_time BETWEEN g.grid_time - 43200000.0 AND g.grid_time + 43200000.0 GROUP BY ALL", "grid_time low mid high iqr")
def e_iqr_rolling(spark, d):
    return E.iqr_rolling(ev(spark, d), _keys(spark, d), 0, 30 * T.DAY, 6 * H, 24 * H, "amplitude", ["cat"])


@query(GRID + "\nSELECT g.cat, g.grid_time, coalesce(sum(exp(-0.5 * ((g.grid_time - e.ref_time) / 3600000.0) ** 2)), 0) / (sqrt(2 * pi()) * 3600000.0) * 1000 * 3600 AS rate FROM g LEFT JOIN ev e ON e.cat = g.cat AND e.ref_time BETWEEN g.grid_time - 18000000.0 AND g.grid_time + 18000000.0 GROUP BY ALL", "grid_time rate")
def e_rate_gauss(spark, d):
    """Events an hour."""
    got = E.rate_rolling_gauss(ev(spark, d), _keys(spark, d), 0, 30 * T.DAY, 6 * H, H, ["cat"])
    return got.withColumn("rate", F.col("rate") * 3600)


@query("""
, s AS (SELECT rec_id, ref_time AS t, amplitude AS v, NULL::BIGINT AS event_id, 0 AS g FROM ev WHERE cat = 'purchase' UNION ALL SELECT rec_id, ref_time, NULL, event_id, 1 FROM ev WHERE cat = 'view'),
n AS (SELECT *, last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER b AS t0, last_value(CASE WHEN g = 0 THEN v END IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER a AS t1, last_value(CASE WHEN g = 0 THEN v END IGNORE NULLS) OVER a AS v1 FROM s
  WINDOW b AS (PARTITION BY rec_id ORDER BY t, g ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY rec_id ORDER BY t DESC, g ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END AS level FROM n WHERE g = 1""", "level")
def e_lookup(spark, d):
    s = ev(spark, d).where("cat = 'purchase'").select("rec_id", F.col("ref_time").alias("time"), F.col("amplitude").alias("value"))
    return E.lookup(ev(spark, d).where("cat = 'view'").select("event_id", "rec_id", "ref_time"), s, ["rec_id"], name="level").select("event_id", "level")


@query("SELECT v.event_id, p.amplitude AS level FROM (SELECT * FROM ev WHERE cat = 'view') v ASOF LEFT JOIN (SELECT * FROM ev WHERE cat = 'purchase') p ON v.rec_id = p.rec_id AND v.ref_time >= p.ref_time", "level")
def e_asof(spark, d):
    from ..operators.joins import asof

    s = ev(spark, d).where("cat = 'purchase'").select("rec_id", F.col("ref_time").alias("time"), F.col("amplitude").alias("value"))
    v = ev(spark, d).where("cat = 'view'").select("event_id", "rec_id", "ref_time")
    return asof(v, s, left_time="ref_time", right_time="time", value="value", by=["rec_id"], name="level").select("event_id", "level")


@query(", g AS (SELECT unnest(range(0, 10)) * (100.0 / 9) AS g)\nSELECT DISTINCT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY g ORDER BY abs(amplitude - g), event_id) AS r FROM ev CROSS JOIN g) WHERE r = 1")
def e_sample_uniform(spark, d):
    return E.sample_uniformly(ev(spark, d), "amplitude", 0, 100, 10).select("event_id")


@query("SELECT e.event_id, w.win_idx, w.wcat, e.ref_time - w.ref AS ref_time FROM ev e JOIN wpurchase w ON e.rec_id = w.rec_id AND e.ref_time >= w.start AND e.ref_time < w.stop", "ref_time")
def e_extract_align(spark, d):
    return E.extract(ev(spark, d), wpurchase(spark, d), ["rec_id"], align="ref", copy=["wcat"]).select("event_id", "win_idx", "wcat", "ref_time")


@query("SELECT e.event_id, coalesce(w.win_idx, -1) AS win_idx, e.ref_time - w.ref AS delay FROM ev e LEFT JOIN wpurchase w ON e.rec_id = w.rec_id AND e.ref_time >= w.start AND e.ref_time < w.stop", "delay")
def e_locate_within(spark, d):
    return E.locate_within(ev(spark, d), wpurchase(spark, d), ["rec_id"]).select("event_id", F.coalesce("win_idx", F.lit(-1)).alias("win_idx"), "delay")


@query("SELECT w.win_idx, count(*) AS n, avg(e.ref_time - w.ref) AS mean_delay, avg(e.amplitude) AS mean_value " + HELD.format(">=", "<") + " GROUP BY w.win_idx", "mean_delay mean_value")
def flagship(spark, d):
    """For every purchase, the same user's events from an hour before to six hours after it."""
    hit = W.classify_events(ev(spark, d), wpurchase(spark, d), "ref_time", ["rec_id"])
    return hit.groupBy("win_idx").agg(F.count("*").alias("n"), F.avg("delay").alias("mean_delay"), F.avg("amplitude").alias("mean_value"))
