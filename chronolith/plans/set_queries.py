"""Queries of further window operators, tensors and keyed collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeunits as T
from ..operators import stack as N
from ..operators import windows as W
from ..operators.keyed import Keyed
from .adapters import ev, table, tr, tr_reg, wbetween, wpurchase, wship
from .registry import query

# --- windows ------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn::DOUBLE AS start, n::DOUBLE AS stop, role AS start_state, r AS stop_state FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS n, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n IS NOT NULL AND (r <> role OR n - turn <> 1)")
def w_transitions(spark, d):
    return W.transitions(table(spark, d, "conversations"), "turn", "role", 1.0, ["conv_id"]).drop("ref")


@query("SELECT win_idx FROM wship WHERE stop - start BETWEEN 86400000 AND 864000000")
def w_sel_length(spark, d):
    return W.sel_length_between(wship(spark, d), T.DAY, 10 * T.DAY).select("win_idx")


HOURS = ", h AS (SELECT rec_id, t * 43200000.0 AS time FROM (SELECT DISTINCT rec_id FROM ev), (SELECT unnest(range(0, 60)) AS t))"


def _hours(spark, d):
    each = F.explode(F.sequence(F.lit(0), F.lit(59)))
    return ev(spark, d).select("rec_id").distinct().withColumn("t", each).select("rec_id", (F.col("t") * 43200000.0).alias("time"))


@query(HOURS + "\nSELECT h.rec_id, h.time, count(p.win_idx) > 0 AS contained FROM h LEFT JOIN wpurchase p ON p.rec_id = h.rec_id AND h.time BETWEEN p.start AND p.stop GROUP BY ALL", "time")
def w_contain_any(spark, d):
    return W.contain(wpurchase(spark, d), _hours(spark, d), by=["rec_id"])


@query(HOURS + "\nSELECT h.rec_id, h.time, count(*) FILTER (h.time BETWEEN p.start AND p.stop) = count(p.win_idx) AS contained FROM h LEFT JOIN wpurchase p ON p.rec_id = h.rec_id GROUP BY ALL", "time")
def w_contain_all(spark, d):
    return W.contain(wpurchase(spark, d), _hours(spark, d), by=["rec_id"], how="all")


@query("SELECT win_idx, start BETWEEN 432000000 AND 864000000 AND stop BETWEEN 432000000 AND 864000000 AS contained FROM wbetween")
def w_contained_in(spark, d):
    return W.contained_in(wbetween(spark, d), 5 * T.DAY, 10 * T.DAY).select("win_idx", "contained")


@query("SELECT win_idx, stop > 432000000 AND start < 864000000 AS contained FROM wbetween")
def w_meets(spark, d):
    return W.contained_in(wbetween(spark, d), 5 * T.DAY, 10 * T.DAY, fully=False).select("win_idx", "contained")


@query("SELECT win_idx, rec_id, start - ref AS start, stop - ref AS stop, 0.0 AS ref FROM wship", "start stop ref")
def w_relative(spark, d):
    return W.relative_to_ref(wship(spark, d)).drop("cat")


@query("SELECT cat, count(*) AS n, sum(stop - start) AS total, min(stop - start) AS shortest, quantile_cont(stop - start, 0.5) AS median, max(stop - start) AS longest, min(start) AS first, max(stop) AS last FROM wship GROUP BY cat", "total shortest median longest first last", 3)
def w_describe(spark, d):
    return W.describe(wship(spark, d), ["cat"])


@query("""
, f AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY rec_id, cat ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM wship),
g AS (SELECT *, sum(n) OVER (PARTITION BY rec_id, cat ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT rec_id, cat, min(start) AS start, max(stop) AS stop, arg_min(win_idx, (start, stop, win_idx)) AS win_idx FROM g GROUP BY rec_id, cat, run""", "start stop")
def w_merge_overlap_by_cat(spark, d):
    return W.merge_overlap_by(wship(spark, d), ["rec_id"], same_cat=True).drop("ref")


@query("""
, x AS (SELECT rec_id, start, stop, cat, lead(start) OVER w AS n, lead(cat) OVER w AS c FROM wpurchase JOIN (SELECT event_id AS win_idx, CASE WHEN amplitude > 50 THEN 'high' ELSE 'low' END AS cat FROM ev) USING (win_idx) WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop))
SELECT rec_id, stop AS start, n AS stop, cat AS prev_cat, c AS next_cat FROM x WHERE n > stop""", "start stop")
def w_gaps_between(spark, d):
    own = ev(spark, d).select(F.col("event_id").alias("win_idx"), F.when(F.col("amplitude") > 50, "high").otherwise("low").alias("cat"))
    return W.gaps_between(wpurchase(spark, d).join(own, "win_idx").select("rec_id", "start", "stop", "cat"), ["rec_id"], ["cat"])


@query("SELECT e.event_id, w.p + e.ref_time - w.start AS ref_time FROM ev e JOIN (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM wbetween WHERE cat = 'view') w ON e.rec_id = w.rec_id AND e.ref_time >= w.start AND e.ref_time < w.stop", "ref_time", 3)
def w_defrag_events(spark, d):
    return W.defrag_events(wbetween(spark, d).where("cat = 'view'").select("rec_id", "start", "stop"), ev(spark, d).select("event_id", "rec_id", "ref_time"), "ref_time", ["rec_id"]).select("event_id", "ref_time")


@query("SELECT win_idx, other, greatest(start, s) AS start, least(stop, t) AS stop FROM wbetween b JOIN (SELECT win_idx AS other, rec_id, start AS s, stop AS t FROM wpurchase) p ON b.rec_id = p.rec_id AND b.stop > s AND t > b.start", "start stop")
def w_crop_to_multiple(spark, d):
    p = wpurchase(spark, d).select("rec_id", "start", "stop")
    keyed = W.extract(wbetween(spark, d), wpurchase(spark, d), ["rec_id"]).select("win_idx", F.col("cut_win_idx").alias("other"), "start", "stop")
    cut = W.crop_to_multiple(wbetween(spark, d), p, ["rec_id"]).select("win_idx", "start", "stop")
    return keyed.join(cut.distinct(), ["win_idx", "start", "stop"], "left_semi")


@query("SELECT win_idx, start - 1000 AS start, stop + 1000 AS stop FROM wship", "start stop")
def w_expand(spark, d):
    return W.expand(wship(spark, d), 1000).select("win_idx", "start", "stop")


@query("SELECT win_idx, start + 500 AS start, stop - 250 AS stop FROM wship", "start stop")
def w_change(spark, d):
    return W.change(W.shrink(wship(spark, d), 250), 250, 0).select("win_idx", "start", "stop")


@query("SELECT win_idx, start / 1000 AS start, stop / 1000 AS stop, ref / 1000 AS ref FROM wship", "start stop ref")
def w_scale(spark, d):
    return W.scale(wship(spark, d), 0.001).select("win_idx", "start", "stop", "ref")


@query("SELECT win_idx, CASE cat WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE cat END AS cat FROM wship")
def w_rename_cat(spark, d):
    return W.rename_cat(wship(spark, d), {"1-URGENT": "urgent", "5-LOW": "low"}).select("win_idx", "cat")


@query("SELECT 'a' AS part, win_idx, start FROM wship UNION ALL SELECT 'b', win_idx, start FROM wpurchase", "start")
def w_concat(spark, d):
    return W.concat({"a": wship(spark, d).select("win_idx", "start"), "b": wpurchase(spark, d).select("win_idx", "start")}, "part")


@query("SELECT win_idx, round_even(start * 0.03, 0)::BIGINT AS start, round_even(stop * 0.03, 0)::BIGINT AS stop FROM wpurchase")
def w_ms_to_sample(spark, d):
    return W.ms_to_sample(wpurchase(spark, d), 30.0).select("win_idx", "start", "stop")


@query("SELECT win_idx, round_even(start * 0.03, 0) / 30.0 * 1000 + 5 AS start, round_even(stop * 0.03, 0) / 30.0 * 1000 + 5 AS stop FROM wpurchase", "start stop")
def w_sample_to_ms(spark, d):
    return W.sample_to_ms(W.ms_to_sample(wpurchase(spark, d), 30.0), 30.0, 5).select("win_idx", "start", "stop")


@query("SELECT win_idx, least(greatest(start, 432000000), 864000000) AS start, least(greatest(stop, 432000000), 864000000) AS stop FROM wbetween", "start stop")
def w_clip(spark, d):
    return W.clip(wbetween(spark, d), 5 * T.DAY, 10 * T.DAY).select("win_idx", "start", "stop")


@query("SELECT win_idx, i, start + i * 7200000.0 AS time FROM (SELECT *, unnest(range(0, floor((stop - start) / 7200000.0 + 0.5)::BIGINT + 1)) AS i FROM wpurchase)", "time")
def w_grid(spark, d):
    return W.grid(wpurchase(spark, d), 2 * T.HOUR).select("win_idx", "i", "time")


@query("SELECT win_idx, 'before' AS k, start - 1500 AS start, start - 500 AS stop FROM wship UNION ALL SELECT win_idx, 'after', stop + 500, stop + 1500 FROM wship UNION ALL SELECT win_idx, 'centered', (start + stop) / 2 - 500, (start + stop) / 2 + 500 FROM wship", "start stop")
def w_before_after_centered(spark, d):
    w = wship(spark, d).select("win_idx", "start", "stop")
    return W.concat({"before": W.before(w, 1000, 500), "after": W.after(w, 1000, 500), "centered": W.centered(w, 1000)}, "k").select("win_idx", "k", "start", "stop")


@query("SELECT event_id, ref_time - 10 AS start, ref_time + 20 AS stop, ref_time AS ref FROM ev", "start stop ref")
def w_build_around(spark, d):
    return W.build_around(ev(spark, d).select("event_id", F.col("ref_time").alias("time")), -10, 20)


@query("SELECT e.event_id, w.win_idx FROM ev e JOIN ev x ON false JOIN wpurchase w ON true")
def w_classify_no_events(spark, d):
    return W.classify_events(ev(spark, d).where("false").select("event_id", "rec_id", "ref_time"), wpurchase(spark, d), "ref_time", ["rec_id"]).select("event_id", "win_idx")


TIGHT = "SELECT e.id AS event_id, w.id AS win_idx, e.t - w.ref AS delay FROM (VALUES ('x', 150.0), ('y', 250.0), ('o', 0.0), ('p', 400.0)) AS e(id, t) JOIN (VALUES ('a', 50.0, 150.0, 100.0), ('b', 150.0, 250.0, 200.0), ('c', 250.0, 350.0, 300.0)) AS w(id, start, stop, ref) ON e.t {} w.start AND e.t {} w.stop"


def _tight(spark):
    e = spark.sql("SELECT * FROM VALUES ('x', 150.0D), ('y', 250.0D), ('o', 0.0D), ('p', 400.0D) AS e(event_id, t)")
    return e, spark.sql("SELECT * FROM VALUES ('a', 50.0D, 150.0D, 100.0D), ('b', 150.0D, 250.0D, 200.0D), ('c', 250.0D, 350.0D, 300.0D) AS w(win_idx, start, stop, ref)")


@query(TIGHT.format(">=", "<"), "delay")
def w_tight_edges_left(spark, d):
    """An event on a shared edge belongs to the window that begins there."""
    e, w = _tight(spark)
    return W.classify_events(e, w, "t").select("event_id", "win_idx", "delay")


@query(TIGHT.format(">", "<="), "delay")
def w_tight_edges_right(spark, d):
    e, w = _tight(spark)
    return W.classify_events(e, w, "t", right=True).select("event_id", "win_idx", "delay")


@query("SELECT * FROM (VALUES ('night', 0.0, 21600000.0, 0.0), ('day', 21600000.0, 64800000.0, 21600000.0)) AS v(cat, start, stop, ref)", "start stop ref")
def w_from_dict(spark, d):
    return W.from_dict(spark, {"night": (0, 6 * T.HOUR), "day": (6 * T.HOUR, 18 * T.HOUR)})


@query("SELECT win_idx, start + (stop - start) * 0.25 AS early, (start + stop) / 2 AS middle FROM wship", "early middle")
def w_places(spark, d):
    return wship(spark, d).select("win_idx", W.relative(0.25).alias("early"), W.relative("mid").alias("middle"))


@query("SELECT win_idx FROM wship WHERE ref BETWEEN start AND stop")
def w_ref_inside(spark, d):
    return wship(spark, d).where(F.col("ref").between(F.col("start"), F.col("stop"))).select("win_idx")


@query("SELECT rec_id, time, arg_max(cat, (start, stop)) AS cat FROM (SELECT h.rec_id, h.a + i * 43200000.0 AS time, b.cat, b.start, b.stop FROM (SELECT rec_id, min(start) AS a, max(stop) AS z FROM wbetween GROUP BY rec_id) h JOIN (SELECT unnest(range(0, 100)) AS i) ON h.a + i * 43200000.0 <= z LEFT JOIN wbetween b ON b.rec_id = h.rec_id AND h.a + i * 43200000.0 BETWEEN b.start AND b.stop) GROUP BY rec_id, time", "time")
def w_generate_cat_grid(spark, d):
    return W.generate_cat_grid(wbetween(spark, d), T.DAY / 2, ["rec_id"])


# --- tensors ------------------------------------------------------------------------------------------------------

ALONG = "OVER (PARTITION BY trace_idx ORDER BY time {})"


@query("SELECT trace_idx, time, sum(value) " + ALONG.format("ROWS UNBOUNDED PRECEDING") + " AS value FROM tr", "time value")
def n_cumsum(spark, d):
    return N.cumsum(tr(spark, d), "time")


@query(f"SELECT * FROM (SELECT trace_idx, time, value - lag(value) {ALONG.format('')} AS value FROM tr) WHERE value IS NOT NULL", "time value")
def n_diff(spark, d):
    return N.diff(tr(spark, d), "time")


@query("SELECT trace_idx, time, CASE WHEN time = 0 THEN lead(value) OVER w - value WHEN time = 63 THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS value FROM tr WINDOW w AS (PARTITION BY trace_idx ORDER BY time)", "time value")
def n_gradient(spark, d):
    return N.gradient(tr(spark, d), "time")


@query("SELECT trace_idx, time, log10(greatest(abs(least(greatest(value, -0.5), 0.5)), 0.01)) AS value FROM tr", "time value")
def n_clip_abs_log(spark, d):
    return N.log10(N.elementwise(N.clip(tr(spark, d), -0.5, 0.5), F.abs), 0.01)


@query(", m AS (SELECT trace_idx, time, CASE WHEN value > -1.5 THEN value END AS value FROM tr), k AS (SELECT time FROM m GROUP BY time HAVING count(value) = count(*))\nSELECT trace_idx, time, value FROM m WHERE time IN (SELECT time FROM k)", "time value")
def n_where_dropna(spark, d):
    return N.dropna(N.where(tr(spark, d), F.col("value") > -1.5), "time")


@query("SELECT trace_idx AS unit, time - 31.5 + 4 AS place, value FROM tr", "place value")
def n_rename_reset_shift(spark, d):
    s = N.shift_coord(N.reset_coord(tr(spark, d), "time", 0.5), time=4)
    return N.transpose(N.rename_dim(N.rename_dim(s, "time", "place"), "trace_idx", "unit"), "place", "unit")


@query("SELECT grp AS label, trace_idx % 7 AS m, time, value FROM tr JOIN tr_reg USING (trace_idx)", "time value")
def n_replace_dim(spark, d):
    both = tr(spark, d).withColumn("m", F.col("trace_idx") % 7)
    return N.replace_dim(both, "trace_idx", "label", tr_reg(spark, d).select("trace_idx", F.col("grp").alias("label"))).select("label", "m", "time", "value")


@query("SELECT trace_idx, time, value FROM tr WHERE time IN (0, 5, 63) AND trace_idx IN (SELECT trace_idx FROM tr_reg ORDER BY trace_idx LIMIT 3)", "time value")
def n_isel(spark, d):
    return N.isel(N.isel(tr(spark, d), "time", 0, 5, 63), "trace_idx", 0, 1, 2)


@query("SELECT trace_idx, time, value FROM tr WHERE time BETWEEN 27 AND 37", "time value")
def n_sel_centered(spark, d):
    return N.sel_centered(tr(spark, d), "time", 32, 10)


HANN = ", w(k, g) AS (SELECT i - 2, 0.5 - 0.5 * cos(2 * pi() * i / 4) FROM (SELECT unnest(range(0, 5)) AS i))"


@query(HANN + "\nSELECT a.trace_idx, a.time, sum(b.value * g) / sum(g) AS value FROM tr a JOIN w ON true JOIN tr b ON a.trace_idx = b.trace_idx AND b.time = a.time + k WHERE g > 0 GROUP BY ALL", "time value")
def n_mean_rolling(spark, d):
    return N.mean_rolling(tr(spark, d), "time", 5)


@query("SELECT min(time) AS start, max(time) AS stop, count(DISTINCT time) AS n, (max(time) - min(time)) / (count(DISTINCT time) - 1) AS period FROM tr", "start stop period")
def n_extent(spark, d):
    return N.extent(tr(spark, d))


@query("SELECT trace_idx, time, value FROM tr WHERE time % 4 = 0", "time value")
def n_downsample(spark, d):
    return N.downsample(tr(spark, d), "time", 4)


@query("SELECT a.trace_idx, a.time + f AS time, a.value + (coalesce(b.value, a.value) - a.value) * f AS value FROM tr a LEFT JOIN tr b ON a.trace_idx = b.trace_idx AND b.time = a.time + 1, (SELECT unnest([0.0, 0.5]) AS f) WHERE a.time + f < 63", "time value")
def n_upsample(spark, d):
    return N.upsample(tr(spark, d), "time", 2000.0)


@query(", g AS (SELECT k * 1.25 AS t FROM (SELECT unnest(range(0, 40)) AS k))\nSELECT a.trace_idx, t::DOUBLE AS time, a.value + (coalesce(b.value, 0) - a.value) * (t - a.time) AS value FROM g JOIN tr a ON a.time = floor(t) LEFT JOIN tr b ON b.trace_idx = a.trace_idx AND b.time = a.time + 1", "time value")
def n_interp(spark, d):
    return N.interp(tr(spark, d), "time", spark.range(40).select((F.col("id") * 1.25).alias("time")))


@query("SELECT trace_idx, round_even(time / 30.0 * 1000 * 0.03, 0)::BIGINT AS sample, value FROM tr", "value")
def n_sample_ms(spark, d):
    ms = N.sample_to_ms(N.rename_dim(tr(spark, d), "time", "sample"), 30.0)
    return N.ms_to_sample(ms, 30.0)


@query(", m AS (SELECT unnest([-2, 0, 10, 40, 60]) AS mark)\nSELECT trace_idx, mark::DOUBLE AS mark, (time - mark + 3)::BIGINT AS sample, value FROM tr, m WHERE time >= mark - 3 AND time < mark + 5 AND mark >= 3 AND mark <= 59", "mark value")
def n_snip(spark, d):
    marks = spark.sql("SELECT cast(m AS double) AS mark FROM (SELECT explode(array(-2, 0, 10, 40, 60)) AS m)")
    return N.snip(tr(spark, d), marks, -3, 5, 8)


@query("SELECT trace_idx, time, value FROM tr", "time value")
def n_wide_and_back(spark, d):
    names = [float(k) for k in range(64)]
    wide = N.to_wide(tr(spark, d), "time", names)
    wide = wide.toDF("trace_idx", *map(str, range(64)))
    long = N.from_wide(wide, "trace_idx", [str(x) for x in range(64)], "time")
    return long.select("trace_idx", F.col("time").cast("double").alias("time"), "value")


@query("SELECT a.trace_idx, a.time, sum(b.value) AS value FROM tr a JOIN tr b ON a.trace_idx = b.trace_idx AND b.time >= a.time GROUP BY ALL", "time value")
def n_apply(spark, d):
    """What is left of each row's sum from a coordinate on."""
    return N.apply(tr(spark, d), "time", lambda t, v: v[::-1].cumsum()[::-1])


@query("SELECT trace_idx, time, (value - lag(m) OVER w) / lag(s) OVER w AS value FROM (SELECT *, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s, count(*) OVER f AS n FROM tr WINDOW f AS (PARTITION BY trace_idx ORDER BY time ROWS 9 PRECEDING)) WINDOW w AS (PARTITION BY trace_idx ORDER BY time) QUALIFY lag(n) OVER w = 10", "time value")
def n_zscore_rolling(spark, d):
    return N.zscore_rolling(tr(spark, d), "time", 10)


@query("SELECT trace_idx, time, value FROM tr UNION ALL SELECT trace_idx, t::DOUBLE, NULL FROM tr_reg, (SELECT unnest([-2, -1, 64, 65, 66]) AS t)", "time value")
def n_extend(spark, d):
    return N.extend(tr(spark, d), "time", 1.0, 2, 3)


@query("SELECT 'x' AS part, trace_idx, time, value FROM tr UNION ALL SELECT 'y', trace_idx, time, value * 2 FROM tr", "time value")
def n_stackup(spark, d):
    return N.stackup({"x": tr(spark, d), "y": N.elementwise(tr(spark, d), lambda v: v * 2)}, "part").select("part", "trace_idx", "time", "value")


@query("SELECT trace_idx, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value, time FROM tr WINDOW w AS (PARTITION BY trace_idx)", "time value")
def n_zscore(spark, d):
    return N.zscore(tr(spark, d), "time")


# --- keyed collections --------------------------------------------------------------------------------------------


def _orders(spark, d) -> Keyed:
    """One entry a customer with its orders' days and prices."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), T.epoch_ms("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    return Keyed(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), o)


DAYS = "(epoch_us(o_orderdate) - 1704067200000000) / 1000.0"


@query(f"SELECT o_custkey AS key, {DAYS} AS time, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5", "time value")
def y_sel(spark, d):
    return _orders(spark, d).sel("nation < 5").data


@query("SELECT c_custkey AS key, c_nationkey AS nation, c_mktsegment AS segment, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL", "top")
def y_summary(spark, d):
    got = _orders(spark, d).summary(n=F.count("*"), top=F.max("value"))
    return got.fillna({"n": 0})


@query(f"SELECT o_custkey AS key, {DAYS} AS time, o_totalprice AS value, c_nationkey AS nation, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey", "time value")
def y_flat(spark, d):
    return _orders(spark, d).flat()


@query("SELECT dense_rank() OVER (ORDER BY c_mktsegment, c_nationkey) - 1 AS key, c_mktsegment, c_nationkey, count(*) AS n, CASE WHEN count(DISTINCT c_custkey) = 1 THEN min(c_custkey) ELSE -1 END AS c_custkey FROM customer GROUP BY c_mktsegment, c_nationkey")
def y_from_split(spark, d):
    """Groups of customers; a group of one keeps its customer."""
    split = Keyed.from_split(table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_mktsegment", "c_nationkey"])
    return split.summary(n=F.count("*")).select("key", "c_mktsegment", "c_nationkey", "n", F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey"))


@query(f"SELECT o_custkey AS key, {DAYS} + o_custkey AS time, o_totalprice AS value FROM orders WHERE {DAYS} BETWEEN -8e11 AND -7e11", "time value", 3)
def y_crop_shift(spark, d):
    k = _orders(spark, d)
    return k.crop(-8e11, -7e11).shift_time(k.reg.select("key", F.col("key").alias("shift"))).data


@query("SELECT a.c_custkey AS \"left\", b.s_suppkey AS \"right\", c_nationkey AS nation FROM customer a JOIN supplier b ON c_nationkey = s_nationkey")
def y_combine(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return _orders(spark, d).combine(Keyed(s, s), ["nation"])


@query("SELECT 'a/' || c_custkey AS key, 'a' AS \"outer\", c_nationkey AS nation FROM customer UNION ALL SELECT 'b/' || s_suppkey, 'b', s_nationkey FROM supplier")
def y_concat(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    c = _orders(spark, d).reg.select("key", "nation")
    return Keyed.concat({"a": Keyed(c, c), "b": Keyed(s, s)}).reg


@query("SELECT time, max(value) FILTER (trace_idx = 0) AS \"0\", max(value) FILTER (trace_idx = 1) AS \"1\" FROM tr WHERE trace_idx < 2 GROUP BY time", "time")
def y_side_by_side(spark, d):
    """Two entries' values side by side."""
    k = Keyed(tr_reg(spark, d).withColumnRenamed("trace_idx", "key"), tr(spark, d).withColumnRenamed("trace_idx", "key")).sel("key < 2")
    return k.side_by_side("time", "value", [0, 1])


@query("SELECT o_custkey AS key, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY o_custkey", "median", 4)
def y_apply(spark, d):
    import pandas as pd

    return _orders(spark, d).apply(lambda p: pd.DataFrame({"key": [p["key"].iloc[0]], "median": [p["value"].median()]}), "key long, median double")


@query("SELECT t.trace_idx AS key, w.k AS win_idx, t.time - w.ref AS time, t.value FROM tr t JOIN (VALUES (0, 2.0, 9.0, 5.0), (1, 8.5, 20.0, 10.0)) AS w(k, a, b, ref) ON t.time BETWEEN a AND b", "time value")
def y_extract(spark, d):
    wins = spark.sql("SELECT * FROM VALUES (0, 2.0D, 9.0D, 5.0D), (1, 8.5D, 20.0D, 10.0D) AS w(win_idx, start, stop, ref)")
    k = Keyed(tr_reg(spark, d).withColumnRenamed("trace_idx", "key"), tr(spark, d).withColumnRenamed("trace_idx", "key"))
    return k.extract(wins).select("key", "win_idx", "time", "value")


@query("SELECT row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey) - 1 AS key, c_nationkey AS nation FROM customer")
def y_rekey(spark, d):
    return _orders(spark, d).rekey(["segment", "nation", "key"]).reg.select("key", "nation")
