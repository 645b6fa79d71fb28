"""What must hold on recordings and tables of any size: chunks, levels of buckets, stretches, skewed lengths."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import kernels as K
from chronolith.functions import timeunits as T
from chronolith.functions.win import Win
from chronolith.operators import correlation as C
from chronolith.operators import joins as J
from chronolith.operators import signals as G
from chronolith.operators import stack as N
from chronolith.operators import states as D
from chronolith.operators import windows as W
from chronolith.operators.keyed import Keyed
from chronolith.operators.numbering import number_rows


def recording(spark, n=6000, traces=2, seed=4):
    r = np.random.default_rng(seed)
    rows = [(k, float(i), float(v)) for k in range(traces) for i, v in enumerate(r.normal(size=n).cumsum() * 0.1 + r.normal(size=n))]
    return spark.createDataFrame(rows, "trace_idx long, time double, value double")


def values(df, *cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize(("kind", "hz"), [("low", 40.0), ("high", 5.0), ("band", (5.0, 40.0))])
def test_filters_in_chunks_are_those_of_the_whole(spark, kind, hz):
    rec = recording(spark)
    whole, parts = (np.array(sorted(map(tuple, df.select("trace_idx", "time", "value").collect()))) for df in (G.filter_pass(rec, kind, hz), G.filter_pass(rec, kind, hz, chunk_ms=700.0)))
    assert np.abs(whole - parts).max() < 1e-9


def test_windows_and_events_in_chunks_are_those_of_the_whole(spark):
    rec = recording(spark)
    f = lambda v, r: {"mean": float(v.mean())}
    whole = values(G.sliding(rec, 500.0, 130.0, f), "trace_idx", "time", "value")
    assert values(G.sliding(rec, 500.0, 130.0, f, chunk_ms=800.0, origin=0.0), "trace_idx", "time", "value") == whole
    cols = ("trace_idx", "start_time", "ref_time", "stop_time")
    events = values(G.sharp_negative_events(rec, (5.0, 40.0)), *cols)
    assert values(G.sharp_negative_events(rec, (5.0, 40.0), chunk_ms=900.0), *cols) == events and len(events) > 50


def test_one_long_interval_among_short_ones_widens_no_bucket(spark):
    short = [(k, float(10 * k), 10.0 * k + 1) for k in range(2000)]
    wins = spark.createDataFrame([*short, (9999, 0.0, 1e6)], "win long, start double, stop double")
    scale = J._scale(wins.select(J._length("start", "stop"))).first()
    assert scale[J.UNIT] < 20 and scale[J.TOP] >= 2
    points = spark.range(500).select(F.col("id").alias("p"), (F.col("id") * 40.0 + 0.5).alias("t"))
    got = {(r.p, r.win) for r in J.range_join(points, wins, time="t").collect()}
    assert got == {(p, w) for p in range(500) for w, a, b in [*short, (9999, 0.0, 1e6)] if a <= p * 40 + 0.5 < b}
    left = J.range_join(points.withColumn("t", F.col("t") + 1e6), wins, time="t", how="left")
    assert left.count() == 500 and left.where("win IS NOT NULL").count() == 0


def test_overlaps_of_very_different_lengths(spark):
    r = random.Random(3)
    some = lambda n, k: [(i, (a := r.uniform(0, 1e5)), a + 10 ** r.uniform(-2, 4.5)) for i in range(k, k + n)]
    a, b = some(150, 0), some(150, 1000)
    left, right = (spark.createDataFrame(x, "win_idx long, start double, stop double") for x in (a, b))
    got = [(x.win_idx, x.other_win_idx) for x in J.overlap_join(left, right).collect()]
    assert sorted(got) == sorted((i, j) for i, s, e in a for j, t, f in b if e > t and f > s) and len(got) > 500


def test_numbers_by_stretches(spark):
    r = random.Random(1)
    rows = [(r.choice([None, float(r.randint(0, 40)), 1e9]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "x double, k long").repartition(5)
    got = sorted((x.n, x.x, x.k) for x in number_rows(df, ("x", "k"), "n").collect())
    assert [g[0] for g in got] == list(range(500))
    assert [(g[1], g[2]) for g in got] == sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1]))
    assert number_rows(df.limit(0), ("x",), "n").count() == 0


def test_peaks_take_linear_time():
    x = np.random.default_rng(2).normal(size=200_000)
    began = time.time()
    found = K.find_peaks(x, distance=3, prominence=0.5)
    assert len(found["idx"]) > 20_000 and time.time() - began < 10


def test_matching_by_stretches_is_that_of_the_whole(spark):
    r = random.Random(6)
    rows = []
    for rec in range(4):
        t = 0.0
        for k in range(60):
            t += r.choice([1.0, 2.0, 400.0])
            rows += [(rec, k * 10 + j, t, 5000 + k * 10 + j, t + r.uniform(-4, 4), r.uniform(0.1, 1)) for j in range(r.randint(1, 3))]
    df = spark.createDataFrame(rows, "rec long, event0 long, t0 double, event1 long, t1 double, score double")
    got = {x.rec: x.total for x in G.match_events(df, ["rec"]).groupBy("rec").agg(F.sum("score").alias("total")).collect()}
    for rec in range(4):
        own = np.array([(x[2], x[4], x[5]) for x in rows if x[0] == rec])
        assert abs(got[rec] - own[K.best_path(own[:, 0], own[:, 1], own[:, 2]), 2].sum()) < 1e-9


def test_lagged_sums_by_either_way():
    r = np.random.default_rng(5)
    x, y = r.normal(size=3000), r.normal(size=2500)
    few, many = C.lagged_sums(x, y, -5, 5), C.lagged_sums(x, y, -40, 40)
    assert np.allclose(few, many[35:46]) and np.allclose(few, [sum(x[i] * y[i + k] for i in range(3000) if 0 <= i + k < 2500) for k in range(-5, 6)])


def test_mixture_of_a_histogram(spark):
    r = np.random.default_rng(8)
    x = np.r_[r.normal(0, 1, 4000), r.normal(8, 2, 2000)]
    df = spark.createDataFrame([(0, float(v)) for v in x] + [(1, None), (1, 5.0)], "rec long, value double")
    got = D.classify_by_mixture(df, by=["rec"], labels=("low", "high"))
    told = np.array([(s.value, s.state == "high") for s in got.where("rec = 0").collect()])
    assert abs(told[:, 1].sum() - 2000) < 100 and told[told[:, 1] == 0, 0].max() < 6
    assert {s.state for s in got.where("rec = 1").collect()} <= {"low", "high", None}


def test_single_windows_as_text():
    w = Win(3_600_000.0, 93_784_500.0)
    assert w.to_str() == "01:00:00 - 1d 02:03:04.500" and Win.from_str(w.to_str()) == w
    with pytest.raises(ValueError):
        Win.from_str("01:00")
    with pytest.raises(ValueError):
        Win(2, 1).assert_positive()
    assert T.ms(hours=1) == Win.from_str("00:00 - 01:00").length


def test_tensors_and_collections_on_disk(spark, tmp_path):
    stack = spark.createDataFrame([(k, float(t), k + t / 10) for k in range(3) for t in range(4)], "unit long, time double, value double")
    N.store(stack, str(tmp_path / "stack"), "unit")
    back = N.load(spark, str(tmp_path / "stack"), gain=2.0, unit=1, time=(1.0, 2.0))
    assert values(back, "time", "value") == [(1.0, 2.2), (2.0, 2.4)]
    keyed = Keyed.from_split(stack.withColumn("even", F.col("unit") % 2 == 0), ["unit"])
    keyed.store(str(tmp_path / "keyed"))
    again = Keyed.load(spark, str(tmp_path / "keyed"))
    assert again.reg.select("unit", "even").orderBy("unit").collect() == [(0, True), (1, False), (2, True)]
    assert [r.value for r in again.get(2).orderBy("time").collect()] == [2.0, 2.1, 2.2, 2.3]
    assert set(again.simplify().reg.columns) == {"key", "unit", "even"}


def test_gaps_and_transitions_of_nothing(spark):
    none = spark.createDataFrame([], "win_idx long, start double, stop double, ref double, cat string")
    assert W.gaps_between(none, keep=["cat"]).count() == 0 and W.contain(none, none.select(F.col("start").alias("time"))).count() == 0
    assert W.transitions(none, "start", "cat", 1.0).count() == 0 and W.merge_overlap_by(none).count() == 0
