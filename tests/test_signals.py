"""Signal kernels on signals whose answers are known, state machines, sources, streams and the entry module."""

import importlib
import itertools
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import kernels as K
from chronolith.operators import signals as G
from chronolith.operators import states as D
from chronolith.sources import recordings as R
from chronolith.streaming import streams


def test_filters_pass_and_stop():
    t = np.arange(4000) / 1000
    low, high = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 200 * t)
    mid = slice(500, -500)
    assert np.abs(K.pass_filter(low + high, 1000, 40, "low") - low)[mid].max() < 0.02
    assert np.abs(K.pass_filter(low + high, 1000, 40, "high") - high)[mid].max() < 0.02
    assert np.abs(K.pass_filter(low + high, 1000, (2, 20), "band") - low)[mid].max() < 0.05


def test_butterworth_is_half_power_at_its_edge():
    b, a = K.butterworth(100.0, 1000.0, "low")
    z = np.exp(-1j * 2 * np.pi * 100 / 1000)
    assert abs(abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) - 2**-0.5) < 1e-9 and abs(b.sum() / a.sum() - 1) < 1e-9


def test_blocked_filter_is_the_recursion():
    r = np.random.default_rng(0)
    b, a = K.butterworth((50.0, 120.0), 1000.0, "band")
    x, state = r.normal(size=300), r.normal(size=4)
    want, s = [], state.copy()
    for v in x:
        y = b[0] * v + s[0]
        s = np.r_[s[1:], 0] + b[1:] * v - a[1:] * y
        want.append(y)
    assert np.allclose(K._filtered(b, a, x, state), want)


def test_spectra():
    t = np.arange(8000) / 1000
    f, p = K.welch(3 * np.sin(2 * np.pi * 50 * t), 1000, 1000)
    assert f[np.argmax(p)] == 50 and abs(p.sum() * f[1] - 4.5) < 0.01
    power = K.band_power(np.sin(2 * np.pi * 50 * t), 1000, {"in": (40, 60), "out": (100, 200)}, 1000)
    assert power["in"] > 0.4 and power["out"] < 1e-3
    assert abs(K.simpson(np.arange(6.0) ** 2, 1.0) - 125 / 3) < 1e-9 and abs(K.simpson(np.arange(5.0) ** 2, 1.0) - 64 / 3) < 1e-9
    assert np.argmax(K.wavelet(np.sin(2 * np.pi * 50 * t[:2000]), 1000, np.array([25.0, 50.0, 100.0])).mean(axis=1)) == 1
    assert np.allclose(np.angle(K.analytic(np.cos(2 * np.pi * 4 * np.arange(100) / 100)))[0], 0)


def test_peaks():
    x = np.array([0, 2, 0, 1, 1, 1, 0, 5, 4, 4.5, 0.0])
    assert K.local_maxima(x).tolist() == [1, 4, 7, 9]
    prom, *_ = K.prominences(x, np.array([1, 4, 7, 9]))
    assert prom.tolist() == [2, 1, 5, 0.5]
    assert K.find_peaks(x, distance=3)["idx"].tolist() == [1, 4, 7] and K.find_peaks(x, prominence=1.5)["idx"].tolist() == [1, 7]


def test_best_path_is_the_heaviest_chain():
    r = np.random.default_rng(4)
    for _ in range(40):
        n = int(r.integers(1, 9))
        t0, t1, w = r.integers(0, 5, n).astype(float), r.integers(0, 5, n).astype(float), r.random(n)
        got = K.best_path(t0, t1, w)
        best = max(sum(w[list(c)]) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(a < b for a, b in itertools.pairwise(sorted(t0[i] for i in c))) and [t1[i] for i in sorted(c, key=lambda i: t0[i])] == sorted({t1[i] for i in c}))
        assert abs(w[got].sum() - best) < 1e-12


def test_merge_sandwiched():
    edge = np.arange(7.0)
    a, b, c = K.merge_sandwiched(edge[:-1], edge[1:], np.array(list("abacca"), object))
    assert list(c) == ["a", "c", "a"] or list(c) == ["a"]
    assert a[0] == 0 and b[-1] == 6


@pytest.mark.parametrize(("cats", "want"), [("a", "a"), ("aa", "a"), ("ab", "ab"), ("aabbc", "abc"), ("abca", "abca")])
def test_touching_windows_merge_though_none_is_sandwiched(cats, want):
    edge = np.arange(len(cats) + 1.0)
    a, b, c = K.merge_sandwiched(edge[:-1], edge[1:], np.array(list(cats), object))
    assert "".join(c) == want and (a[0], b[-1]) == (0, len(cats)) and (a[1:] == b[:-1]).all()
    a, b, c = K.merge_sandwiched(edge[:-1] * 2, edge[:-1] * 2 + 1, np.array(list(cats), object))  # apart
    assert "".join(c) == cats


def test_sharp_events_come_in_order(spark):
    t = np.arange(2000.0)
    v = -np.exp(-0.5 * ((t % 500 - 250) / 10) ** 2)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "trace_idx long, time double, value double")
    got = G.sharp_negative_events(df, (1.0, 100.0)).collect()
    assert len(got) >= 3 and all(r.start_time < r.ref_time < r.stop_time for r in got)


def test_mixture(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.r_[r.normal(0, 1, 200), r.normal(9, 1, 200)])], "time long, value double")
    got = D.classify_by_mixture(df, rounds=8).groupBy("state").agg(F.max("time").alias("hi"), F.min("time").alias("lo"), F.count("*").alias("n"))
    assert {x.state: (x.n, x.lo >= 200 or x.hi < 200) for x in got.collect()} == {"sws": (200, True), "rem": (200, True)}


def test_interleaved_recording_round_trip(spark, tmp_path):
    R.register_sources(spark)
    path = str(tmp_path / "a.bin")
    data = np.arange(3 * 500, dtype=np.int64) % 97
    rows = [(i // 3, i % 3, float(v)) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "i long, channel int, value double")
    assert R.write_interleaved(df, path, 3, 500, 1.0, chunk=100) == 500
    got = spark.read.format("interleaved_int16").options(path=path, n_channels="3", chunk="300").load()
    assert sorted(map(tuple, got.collect())) == rows
    some = got.where("i >= 120 AND i < 130 AND channel = 2")
    assert sorted(map(tuple, some.collect())) == [r for r in rows if 120 <= r[0] < 130 and r[1] == 2]
    R.write_spikeglx_meta(str(tmp_path / "a.meta"), 3, 500, 30000.0)
    meta = R.SpikeGlxMeta.read(str(tmp_path / "a.meta"))
    assert (meta.n_channels, meta.n_samples, meta.rate, len(meta.microvolts)) == (3, 500, 30000.0, 3)


def test_neuralynx(spark, tmp_path):
    R.register_sources(spark)
    head = b"######## header\r\n-ADBitVolts 0.000001\r\n-AcqEntName CSC7\r\n".ljust(R.HEADER_BYTES, b"\0")
    records = np.zeros(3, R.NCS_RECORD)
    records["timestamp"], records["channel"], records["freq"], records["valid"] = [0, 512000, 1024000], 7, 1000, [512, 512, 100]
    records["samples"] = np.arange(512)
    path = tmp_path / "c.ncs"
    path.write_bytes(head + records.tobytes())
    assert R.neuralynx_header(str(path))["AcqEntName"] == "CSC7"
    got = spark.read.format("neuralynx_ncs").options(path=str(path), chunk="300").load().orderBy("i").collect()
    assert len(got) == 1124 and got[1123].value == pytest.approx(99.0) and got[600].timestamp_us == 512000 + 88 * 1000
    events = np.zeros(2, R.NEV_RECORD)
    events["timestamp"], events["ttl"], events["text"] = [5, 6], [1, 0], [b"on", b"off"]
    (tmp_path / "e.nev").write_bytes(head + events.tobytes())
    assert [(r.timestamp_us, r.ttl, r.text) for r in spark.read.format("neuralynx_nev").option("path", str(tmp_path / "e.nev")).load().collect()] == [(5, 1, "on"), (6, 0, "off")]


def test_sorter_output_and_tracking(spark, tmp_path):
    R.register_sources(spark)
    np.save(tmp_path / "spike_times.npy", np.array([[30], [60]]))
    np.save(tmp_path / "spike_clusters.npy", np.array([1, 2]))
    (tmp_path / "cluster_group.tsv").write_text("cluster_id\tgroup\n1\tgood\n3\tnoise\n")
    spikes, units = R.load_kilosort(spark, str(tmp_path), 30000.0)
    assert sorted((r.unit_id, r.ref_time) for r in spikes.collect()) == [(1, 1.0), (2, 2.0)]
    assert sorted((r.unit_id, r.group) for r in units.collect()) == [(1, "good"), (2, None), (3, "noise")]
    (tmp_path / "t.csv").write_text("scorer,s,s,s\nbodyparts,eye,eye,eye\ncoords,x,y,likelihood\n0,1,2,0.5\n1,3,4,0.6\n")
    got = R.load_tracking(spark, str(tmp_path / "t.csv")).orderBy("frame").collect()
    assert [(r.frame, r.time, r.part, r.x, r.y) for r in got] == [(0, 0, "eye", 1, 2), (1, 20, "eye", 3, 4)]


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{i}:00", "a" if i < 3 else "b") for i in range(6)]
    spark.createDataFrame(rows, "k long, t string, v string").selectExpr("k", "cast(t as timestamp) t", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k long, t timestamp, v string").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        for _ in range(120):
            time.sleep(0.5)
            if spark.table(name).count():
                break
        q.stop()
        return spark.table(name).collect()

    assert {(r.k, r["count"]) for r in run(streams.tumbling_counts(stream(), "t", "2 minutes", ["k"], late="0 seconds"), "tumbling")} == {(1, 2)}
    assert [(r.cat, r["count"]) for r in run(streams.value_runs(stream(), "k", "t", "v"), "runs")] == [("a", 3)]


def test_entry_and_oracles_name_the_same_queries(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


ORACLES = ["w_classify_left", "w_extract", "w_invert", "e_lookup", "e_iqr_rolling", "x_resample", "c_autocorr", "d_cycle_windows", "p_isi_hist"]
ORACLES += "k_bandpass k_bandpass_chunked k_welch k_wavelet k_hilbert_phase k_find_peaks k_sharp_events k_match_total w_merge_sandwiched w_contain_all w_gaps_between n_upsample n_snip y_from_split v_find_template v_assign_matches c_cross_corr_rolling d_protocol_trains d_state_grid x_extract_resampled p_sync_clock s_sessions d_mannwhitney_p m_extract_power".split()


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, small, name):
    import duckdb

    from chronolith import plans

    got = plans.queries()[name](spark, small).toPandas()
    db = duckdb.connect()
    for f in os.listdir(small):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    want = db.sql(plans.oracle_sql()[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns) and len(got) == len(want)
    key = lambda df: sorted(json.dumps([None if x != x or x is None else x for x in r], default=str) for r in df[order].astype(object).itertuples(index=False))
    assert key(got) == key(want)
