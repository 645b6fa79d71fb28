"""Golden cases of windows and events, and properties of the set operations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import timeunits as T
from chronolith.operators import events as E
from chronolith.operators import joins as J
from chronolith.operators import select as S
from chronolith.operators import windows as W

WIN = "win_idx string, start double, stop double, ref double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def wins(spark, data, schema=WIN):
    return spark.createDataFrame(data, schema)


def test_sampling_rate():
    assert T.SamplingRate.from_period(1.0).hz == 1000 and T.SamplingRate(1.0).period == 1000
    assert T.SamplingRate(30000).stride(1000) == 30 and T.SamplingRate(30000).divides(1000) and not T.SamplingRate(1000).divides(300)
    with pytest.raises(ValueError):
        T.SamplingRate(0)


def test_time_text(spark):
    cases = [("01:02", 3720000.0), ("1d 00:00:01.5", 86401500.0), ("10:00:00", 36000000.0), ("rubbish", None), ("", None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").withColumn("v", T.str_to_ms("t"))
    assert {r.t: r.v for r in df.collect()} == dict(cases)
    one = spark.createDataFrame([(90061001.0,), (-60000.0,), (0.0,)], "v double")
    assert [r[0] for r in one.select(T.ms_to_str("v", show_days=True)).collect()] == ["1d 01:01:01.001", "-00:01", "00:00"]


def test_build_around(spark):
    marks = spark.createDataFrame([(0,), (1,), (2,)], "time long")
    assert rows(W.build_around(marks, -1, 10), "start", "stop", "ref") == [(-1, 10, 0), (0, 11, 1), (1, 12, 2)]
    assert W.build_around_multiple(marks, {"pre": (-10, 0), "post": (0, 10)}).count() == 6


def test_build_between(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "time long, other string")
    assert W.build_between(t).count() == 2 and W.build_between(t, start=0).count() == 3
    whole = W.build_between(t, start=0, stop=4)
    assert whole.columns == ["start", "stop", "ref", "start_other", "stop_other"] and whole.count() == 4


def test_runs(spark):
    v = spark.createDataFrame([(i, x) for i, x in enumerate([0, 0, 0, 1, 1, 1, 0, 2, 2, 2])], "pos long, value long")
    got = W.runs(v, "pos", "value").groupBy("cat").agg(F.sum(F.col("stop") - F.col("start")).alias("n"))
    assert rows(got, "cat", "n") == [(0, 4), (1, 3), (2, 3)]


LABELLED = [("z", 50.0, 150.0, 100.0), ("a", 150.0, 250.0, 200.0), ("k", 250.0, 350.0, 300.0)]


@pytest.mark.parametrize(("right", "want"), [(False, [("x", "b"), ("y", "c")]), (True, [("x", "a"), ("y", "b")])])
def test_tight_edges(spark, right, want):
    w = wins(spark, [(n, c - 50, c + 50, c) for n, c in (("a", 100.0), ("b", 200.0), ("c", 300.0))])
    e = spark.createDataFrame([("x", 150.0), ("y", 250.0)], "event_id string, time double")
    assert rows(W.classify_events(e, w, right=right), "event_id", "win_idx") == want


def test_classify(spark):
    w = wins(spark, LABELLED)
    e = spark.createDataFrame([(1, 75.0), (2, 200.0), (3, 325.0), (4, 0.0), (5, 400.0), (6, None)], "event_id long, time double")
    assert rows(W.classify_events(e, w), "event_id", "win_idx", "delay") == [(1, "z", -25), (2, "a", 0), (3, "k", 25)]
    assert W.classify_events(e.limit(0), w, refs=["start", "stop"]).columns[-2:] == ["delay_from_start", "delay_from_stop"]
    wide = wins(spark, [(n, c - 100, c + 100, c) for n, c in (("a", 100.0), ("b", 200.0), ("c", 300.0))])
    two = spark.createDataFrame([("x", 150.0), ("y", 250.0)], "event_id string, time double")
    assert W.classify_events(two, wide).count() == 4


def made(spark, n=150, keys=3, seed=2):
    r = random.Random(seed)
    data = [(i, r.randrange(keys), (a := float(r.randrange(300))), a + r.choice([0.0, 1.0, 5.0, 40.0]), a) for i in range(n)]
    return data, spark.createDataFrame(data, "win_idx long, k long, start double, stop double, ref double")


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_joins_against_nested_loops(spark, width):
    a, da = made(spark)
    b, db = made(spark, seed=3)
    got = rows(J.overlap_join(da, db, by=["k"], width=width), "win_idx", "other_win_idx")
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] > y[2] and y[3] > x[2])
    points = da.select("k", F.col("win_idx").alias("p"), F.col("start").alias("t"))
    for closed, inside in (("left", lambda t, s, e: s <= t < e), ("right", lambda t, s, e: s < t <= e), ("both", lambda t, s, e: s <= t <= e)):
        got = rows(J.range_join(points, db, time="t", by=["k"], closed=closed, width=width), "p", "win_idx")
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and inside(x[2], y[2], y[3]))


def test_union_and_gaps(spark):
    data, df = made(spark)
    union, gaps = W.merge_overlap(df, ["k"]).collect(), W.invert(df, ["k"]).collect()
    for k in range(3):
        covered = {x for w in data if w[1] == k for x in range(int(w[2]), int(w[3]))}
        assert sum(u.stop - u.start for u in union if u.k == k) == len(covered)
        lo, hi = min(w[2] for w in data if w[1] == k), max(w[3] for w in data if w[1] == k)
        assert sum(g.stop - g.start for g in gaps if g.k == k) == hi - lo - len(covered)
    again = W.invert(W.invert(df, ["k"], -10, 1000), ["k"], -10, 1000)
    want = W.merge_overlap(df.where("stop > start"), ["k"])
    assert sum(r.stop - r.start for r in again.collect()) == sum(r.stop - r.start for r in want.collect())


def test_split_drops_the_last_whole_tile(spark):
    w = wins(spark, [("a", 0.0, 30.0, 0.0), ("b", 0.0, 35.0, 0.0)])
    assert rows(W.split(w, 10), "main_win_idx", "start") == [("a", 0), ("a", 10), ("b", 0), ("b", 10), ("b", 20)]
    assert W.split(w, 10, inclusive=True).count() == 6


def test_defrag_is_tight(spark):
    _, df = made(spark)
    flags = W.set_flags(W.defrag(df.where("stop > start"), ["k"]).withColumn("cat", F.lit("x")), ["k"]).collect()
    assert all(f.are_tight and f.are_exclusive for f in flags)


def test_text_round_trip_and_errors(spark):
    df = spark.createDataFrame([("x: 00:01 - 00:02\ny: 1d 00:00 - 1d 00:00:01.250",)], "text string")
    assert rows(W.from_text(df, "text"), "cat", "start", "stop") == [("x", 60000, 120000), ("y", 86400000, 86401250)]
    with pytest.raises(Exception, match="not a window"):
        W.from_text(spark.createDataFrame([("no colon",)], "text string"), "text").collect()


def test_interpolation_and_asof(spark):
    s = spark.createDataFrame([(0.0, 0.0), (10.0, 100.0), (20.0, 0.0)], "time double, value double")
    t = spark.createDataFrame([(1, -5.0), (2, 0.0), (3, 2.5), (4, 10.0), (5, 15.0), (6, 25.0)], "event_id long, ref_time double")
    assert rows(E.lookup(t, s), "event_id", "value") == [(1, None), (2, 0), (3, 25), (4, 100), (5, 50), (6, None)]
    assert [v for _, v in rows(E.lookup(t, s, clamp=True), "event_id", "value")] == [0, 0, 25, 100, 50, 0]
    assert [v for _, v in rows(E.nearest_value(t, s), "event_id", "value")] == [0, 0, 0, 100, 100, 0]


def test_selections(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "b", math.nan)], "id long, c string, v double")
    assert rows(S.sel_match(df, c=None), "id") == [(2,)] and rows(S.sel_match(df, c="a", invert=True), "id") == [(2,), (3,)]
    assert rows(S.sel_between(df, v=(1.0, 2.0)), "id") == [(1,), (2,)] and rows(S.sel_in(df, c=["a", "b"], invert=True), "id") == [(2,)]


def test_single_interval():
    from chronolith.functions.win import Win

    w = Win(10, 40)
    assert (w.length, w.mid, w.contains(40), w.overlaps(Win(40, 50)), w.overlaps(Win(39, 50))) == (30, 25, True, False, True)
    assert w.grid(10) == [10, 20, 30, 40] and w.split(15) == [Win(10, 25), Win(25, 40)]
    assert w.subtract(Win(20, 30)) == (Win(10, 20), Win(30, 40)) and w.clip(Win(50, 60)) == Win(50, 50)
    assert w.shift_to_fit(Win(0, 35)) == Win(5, 35) and Win(11, 39).rounded(10, "floor_ceil") == w
    assert w.samples(30000, 1000) == slice(300, 1200, 30) and w.take_centred(10) == Win(20, 30)
    with pytest.raises(ValueError):
        w.shift_to_fit(Win(0, 1))


def test_extend_and_rolling_scores(spark):
    from chronolith.operators import stack as N

    s = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(5)], "k string, t double, value double")
    assert rows(N.extend(s, "t", 1.0, 2, 1, 0.0), "t") == [(float(i),) for i in range(-2, 6)]
    got = rows(N.zscore_rolling(s, "t", 2), "t", "value")
    assert [t for t, _ in got] == [2, 3, 4] and got[0][1] == pytest.approx(3.5 / 0.5**0.5)
