"""States and cycles, pulses and trains, phases: sequences of labelled windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import overlap_join
from .windows import _keys, series


def _mixture_of(counts: np.ndarray, x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """(weight, mean, deviation) of k Gaussians over values x that occur `counts` times, in order of their mean, by expectation-maximisation."""
    total = counts.sum()
    at = np.cumsum(counts)
    mean = np.array([x[min(len(x) - 1, np.searchsorted(at, total * (i + 0.5) / k))] for i in range(k)])
    spread = max(float(np.sqrt(np.average((x - np.average(x, weights=counts)) ** 2, weights=counts))), 1e-9)
    weight, sd = np.full(k, 1 / k), np.full(k, spread / k)
    for _ in range(rounds):
        dens = weight / sd * np.exp(-0.5 * ((x[:, None] - mean) / sd) ** 2)
        whole = dens.sum(axis=1, keepdims=True)
        r = np.where(whole > 0, dens / np.where(whole > 0, whole, 1), 1 / k) * counts[:, None]
        a = np.maximum(r.sum(axis=0), 1e-12)
        new = (r * x[:, None]).sum(axis=0) / a
        weight, sd = a / total, np.sqrt(np.maximum((r * x[:, None] ** 2).sum(axis=0) / a - new**2, 1e-12))
        moved, mean = np.abs(new - mean).max(), new
        if moved < 1e-9 * max(1.0, np.abs(mean).max()):
            break
    order = np.argsort(mean, kind="stable")
    return np.stack([weight[order], mean[order], sd[order]], axis=1)


def classify_by_mixture(samples: DataFrame, value: str = "value", by: Sequence[str] = (), labels: Sequence[str] = ("sws", "rem"), rounds: int = 200, log10: bool = False, bins: int = 4096) -> DataFrame:
    """A mixture of as many Gaussians as labels, fitted by expectation-maximisation per series; components in order of their mean.

    It is fitted to a histogram of each series (`bins` counts with the mean of the values in each), so that the rounds are one task's
    work on a table of a fixed size, whatever the number of samples, and no parameter passes the driver.
    """
    x = F.log10(value) if log10 else F.col(value).cast("double")
    k = len(labels)
    rows = samples.withColumn("__x", F.when(F.col(value) > 0, x) if log10 else x)
    keys = list(by) or ["__all"]
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    ext = rows.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).where("__lo IS NOT NULL")
    at = F.floor((F.col("__x") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300)) * (bins - 1))
    hist = rows.join(ext, keys).where("__x IS NOT NULL").groupBy(*keys, at.alias("__b")).agg(F.count("*").cast("double").alias("c"), F.avg("__x").alias("x"))
    packed = hist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "c"))).alias("h"))
    packed = packed.select(*keys, F.transform("h", lambda z: z["x"]).alias("x"), F.transform("h", lambda z: z["c"]).alias("c"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_mixture_of(np.array(c), np.array(v), k, rounds).ravel().tolist() for v, c in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(found, pa.list_(pa.float64()))], [*keys, "__p"])

    schema = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in keys)
    own = rows.join(packed.mapInArrow(fit, f"{schema}, __p array<double>"), keys, "left")
    p = lambda i, j: F.col("__p")[3 * i + j]
    dens = lambda i: F.log(p(i, 0)) - F.log(p(i, 2)) - 0.5 * F.pow((F.col("__x") - p(i, 1)) / p(i, 2), F.lit(2))
    best = F.array_max(F.array(*[F.struct(dens(i).alias("d"), F.lit(-i).alias("i")) for i in range(k)]))["i"]
    names = F.array(*[F.lit(x) for x in labels])
    return own.withColumn("state", F.when(F.col("__x").isNotNull(), F.element_at(names, 1 - best))).drop("__x", "__p", "__all")


def fill_not_positive(samples: DataFrame, value: str = "value", by: Sequence[str] = (), order: str = "time") -> DataFrame:
    """Values that aren't above zero take the last one that is, or at the start the next."""
    good = F.when(F.col(value) > 0, F.col(value))
    w = Window.partitionBy(*_keys(by)).orderBy(order)
    back = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(good, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return samples.withColumn(value, F.coalesce(back, ahead))


def threshold_labels(value: Column, threshold: float, below: str = "sws", above: str = "rem") -> Column:
    return F.when(value > F.lit(float(threshold)), F.lit(above)).when(value.isNotNull(), F.lit(below))


def estimate_interval(corr: DataFrame, lo: float, hi: float, by: Sequence[str], lag: str = "lag", value: str = "corr") -> DataFrame:
    """The lag in [lo, hi] of the largest correlation."""
    return corr.where(F.col(lag).between(lo, hi)).groupBy(*by).agg(F.max_by(lag, F.struct(F.col(value), -F.col(lag))).alias("interval"))


def lag_modes(best: DataFrame, min_lag: float, by: Sequence[str] = (), lag: str = "best_lag") -> DataFrame:
    """The most frequent lag below -min_lag (of equals the largest) and above min_lag (the smallest)."""
    counts = best.groupBy(*by, lag).agg(F.count("*").alias("n"))
    neg, pos = F.col(lag) < -min_lag, F.col(lag) > min_lag
    return counts.groupBy(*by).agg(F.max_by(F.when(neg, F.col(lag)), F.when(neg, F.struct("n", lag))).alias("neg_mode"), F.max_by(F.when(pos, F.col(lag)), F.when(pos, F.struct(F.col("n"), -F.col(lag)))).alias("pos_mode"))


def cycle_windows(wins: DataFrame, by: Sequence[str], split_cat: str, inner_cat: str, align: float = 0.5) -> DataFrame:
    """Cycles between consecutive points in the windows of one category that hold exactly one window of the other."""
    point = F.col("start") + (F.col("stop") - F.col("start")) * F.lit(align)
    w = Window.partitionBy(*_keys(by)).orderBy("t")
    marks = wins.where(F.col("cat") == split_cat).select(*by, point.alias("t"))
    spans = marks.select(*by, F.col("t").alias("start"), F.lead("t").over(w).alias("stop"), (F.row_number().over(w) - 1).alias("cycle_idx")).where("stop IS NOT NULL")
    inner = wins.where(F.col("cat") == inner_cat).select(*by, F.col("start"), F.col("stop"))
    hit = overlap_join(spans, inner, by=by).groupBy(*by, "cycle_idx", "start", "stop").agg(F.count("*").alias("n"), F.min((F.col("other_start") + F.col("other_stop")) / 2).alias("ref"))
    return hit.where("n = 1").drop("n")


def period_counts(wins: DataFrame, by: Sequence[str], cats: Sequence[str], col: str = "cat", length: bool = False) -> DataFrame:
    """A column a category: how many windows of it a cycle has, or how long they are; zero where none."""
    piv = wins.groupBy(*by).pivot(col, list(cats))
    got = piv.agg(F.sum(F.col("stop") - F.col("start"))) if length else piv.agg(F.count(F.lit(1)))
    return got.fillna(0, subset=list(cats))


def largest_by_cat(wins: DataFrame, by: Sequence[str], col: str = "cat") -> DataFrame:
    """The longest window of each category and cycle; of equals the earliest."""
    w = Window.partitionBy(*by, col).orderBy(F.desc(F.col("stop") - F.col("start")), "start")
    return wins.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def hull_without(wins: DataFrame, by: Sequence[str], cat: str) -> DataFrame:
    """The hull of each cycle's windows of all but one category."""
    return wins.where(F.col("cat") != cat).groupBy(*by).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def switch_counts(wins: DataFrame, by: Sequence[str], col: str = "cat") -> DataFrame:
    """How often the category changes within a cycle."""
    w = series(by)
    return wins.withColumn("__s", F.when(F.col(col) != F.lag(col).over(w), 1).otherwise(0)).groupBy(*by).agg(F.sum("__s").alias("switches"))


# --- pulses -------------------------------------------------------------------------------------------------------


def label_pulses(wins: DataFrame, by: Sequence[str], cat: str = "on", max_length: float = 120_000.0, valid: tuple[float, float] | None = None) -> DataFrame:
    """is_pulse (short, of the given category, inside the valid time) and a running pulse number by start."""
    hit = (F.col("cat") == cat) & (F.col("stop") - F.col("start") <= F.lit(max_length))
    if valid:
        hit &= (F.col("start") >= valid[0]) & (F.col("stop") <= valid[1])
    out = wins.withColumn("is_pulse", hit)
    n = F.sum(F.when(F.col("is_pulse"), 1).otherwise(0)).over(series(by).rowsBetween(Window.unboundedPreceding, 0)) - 1
    return out.withColumn("pulse", F.when(F.col("is_pulse"), n))


def encode_breaks(wins: DataFrame, by: Sequence[str]) -> DataFrame:
    """The edges of alternating windows as one text, ':' between them."""
    got = wins.groupBy(*by).agg(F.array_sort(F.collect_set("start")).alias("a"), F.max("stop").alias("z"))
    return got.select(*by, F.concat_ws(":", F.transform("a", lambda x: x.cast("long").cast("string")), F.col("z").cast("long").cast("string")).alias("encoded"))


def decode_breaks(encoded: DataFrame, by: Sequence[str], start_on: bool = True) -> DataFrame:
    """Alternating on and off windows between the breaks of a text."""
    parts = encoded.select(*by, F.posexplode(F.split("encoded", ":")).alias("i", "t")).withColumn("start", F.col("t").cast("double"))
    w = Window.partitionBy(*_keys(by)).orderBy("i")
    cat = F.when(F.pmod(F.col("i"), F.lit(2)) == (0 if start_on else 1), "on").otherwise("off")
    return parts.select(*by, "i", "start", F.lead("start").over(w).alias("stop"), cat.alias("cat")).where("stop IS NOT NULL")


def match_protocol(value: Column, protocol: Sequence[float]) -> Column:
    """The nearest of a fixed list of lengths, the first of equals; an infinite or missing length has none."""
    near = F.array_min(F.array(*[F.struct(F.abs(value - F.lit(float(p))).alias("d"), F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(protocol)]))
    return F.when(value.isNotNull() & (value < F.lit(float("inf"))), near["p"])


def train_protocol(pulses: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row a train: pulses, median length and interval, and its hull."""
    w = Window.partitionBy(*by, "train").orderBy("start")
    own = pulses.withColumn("__i", F.lead("start").over(w) - F.col("start"))
    return own.groupBy(*by, "train").agg(F.count("*").alias("pulses"), F.percentile(F.col("stop") - F.col("start"), F.lit(0.5)).alias("pulse_length"), F.percentile("__i", F.lit(0.5)).alias("interval"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def collect_pulses(wins: DataFrame, by: Sequence[str], isolation: float, length: float, precision: float) -> DataFrame:
    """Pulses of about one length that stand alone."""
    w = series(by)
    out = wins.withColumn("__p", F.col("start") - F.lag("stop").over(w)).withColumn("__n", F.lead("start").over(w) - F.col("stop"))
    some = (F.coalesce("__p", F.lit(float("inf"))) >= isolation) & (F.coalesce("__n", F.lit(float("inf"))) >= isolation)
    return out.where(some & (F.abs(F.col("stop") - F.col("start") - length) <= precision)).drop("__p", "__n")


# --- phases -------------------------------------------------------------------------------------------------------


def classify_phase(phase: Column, labels: Sequence[str] = ("q1", "q2", "q3", "q4")) -> Column:
    """The part of [0, 1) that a phase lies in; exactly 1 has none."""
    n = len(labels)
    return F.when((phase >= 0) & (phase < 1), F.element_at(F.array(*[F.lit(x) for x in labels]), (F.floor(phase * n) + 1).cast("int")))


def phase_difference(actual: Column, expected: Column) -> Column:
    """The difference wrapped into [-0.5, 0.5)."""
    d = actual - expected
    return d - F.floor(d + 0.5)


def light_windows(lum: DataFrame, by: Sequence[str], value: str = "value", order: str = "time", high_q: float = 0.99, low_q: float = 0.1) -> DataFrame:
    """On and off runs by a threshold midway between two quantiles."""
    from .windows import runs

    q = lum.groupBy(*by).agg(((F.percentile(value, F.lit(high_q)) + F.percentile(value, F.lit(low_q))) / 2).alias("__t"))
    on = lum.join(q, list(by)) if by else lum.crossJoin(F.broadcast(q))  # one row
    return runs(on.withColumn("cat", F.when(F.col(value) > F.col("__t"), "on").otherwise("off")).drop("__t"), order, "cat", by)


# --- states of two signals ----------------------------------------------------------------------------------------


def states_by_threshold(samples: DataFrame, threshold: float, max_detour: float, by: Sequence[str] = (), value: str = "value", order: str = "time", period: float = 1.0) -> DataFrame:
    """Runs above (rem) and below (sws) a threshold; short ones between two of the other kind are merged into them."""
    from .signals import merge_sandwiched
    from .windows import runs

    own = samples.withColumn("cat", F.when(F.col(value) > F.lit(float(threshold)), "rem").otherwise("sws"))
    return merge_sandwiched(runs(own, order, "cat", by, mid=False, include_right=True), by, max_detour)


def lead_states(samples: DataFrame, col0: str, col1: str, by: Sequence[str] = (), state: str = "rem_state", slope: float = 1.2) -> DataFrame:
    """`lead`: sws where the state is; lead_ch0 or lead_ch1 where one signal outgrows the other by the slope, measured from the
    centre of all sws samples; else x."""
    sws = samples.where(F.col(state) == "sws").groupBy(*by).agg(F.avg(col0).alias("__c0"), F.avg(col1).alias("__c1"))
    both = samples.join(sws, list(by)) if by else samples.crossJoin(F.broadcast(sws))  # one row
    over = lambda a, ca, b: (F.col(b) - F.col(f"__c{1 - ca}")) * slope + F.col(f"__c{1 - ca}") < F.col(a)
    lead = F.when(F.col(state) == "sws", "sws").when(over(col0, 0, col1), "lead_ch0").when(over(col1, 1, col0), "lead_ch1").otherwise("x")
    return both.withColumn("lead", lead).drop("__c0", "__c1")


def lead_signals(corr: DataFrame, modes: DataFrame, by: Sequence[str], time: str = "time", lag: str = "lag", value: str = "corr") -> DataFrame:
    """The correlation at a series' two modal lags beside each other, by time: lead_ch0 (the negative one) and lead_ch1."""
    own = corr.join(modes, list(by)).where((F.col(lag) == F.col("neg_mode")) | (F.col(lag) == F.col("pos_mode")))
    return own.groupBy(*by, time).agg(F.max(F.when(F.col(lag) == F.col("neg_mode"), F.col(value))).alias("lead_ch0"), F.max(F.when(F.col(lag) == F.col("pos_mode"), F.col(value))).alias("lead_ch1"))


def scale_by_quantile(samples: DataFrame, q: float = 0.999, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Values over a high quantile of their series."""
    top = samples.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("__q"))
    both = samples.join(top, list(by)) if by else samples.crossJoin(F.broadcast(top))  # one row
    return both.withColumn(value, F.try_divide(F.col(value), F.col("__q"))).drop("__q")


def smooth_states(wins: DataFrame, by: Sequence[str], steps: Sequence[tuple[Sequence[str], float]] = ((("x",), 15_000.0), (("lead_ch0", "lead_ch1"), 5_000.0)), col: str = "cat") -> DataFrame:
    """Sandwiched windows of given categories, shorter than a length, are merged, step after step until none is left."""
    import pandas as pd

    from ..functions import kernels as K

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "stop"], kind="stable")
        a, b, c = pdf["start"].to_numpy(float), pdf["stop"].to_numpy(float), pdf[col].to_numpy(object)
        before = -1
        while before != len(c):
            before = len(c)
            for cats, most in steps:
                a, b, c = K.merge_sandwiched(a, b, c, most, cats)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(a) for k in by}).assign(start=a, stop=b, **{col: c})

    keys = ", ".join(f"{k} {wins.schema[k].dataType.simpleString()}" for k in by)
    return wins.select(*by, "start", "stop", col).groupBy(*by).applyInPandas(run, f"{keys}, start double, stop double, {col} string")


def cycles_aligned(wins: DataFrame, times: DataFrame, by: Sequence[str], time: str = "t") -> DataFrame:
    """Windows of each cycle from the cycle's own time; cycles without one go."""
    both = wins.join(times.select(*by, F.col(time).alias("__t")), list(by))
    return both.withColumns({c: F.col(c) - F.col("__t") for c in ("start", "stop", "ref") if c in wins.columns}).drop("__t")


def cycle_centers(wins: DataFrame, by: Sequence[str], cat: str = "sws") -> DataFrame:
    """The middle of the hull of each cycle's windows of all but one category."""
    return hull_without(wins, by, cat).select(*by, ((F.col("start") + F.col("stop")) / 2).alias("t"))


def period_shares(wins: DataFrame, by: Sequence[str], cats: Sequence[str], col: str = "cat") -> DataFrame:
    """How the length of the given categories in a cycle is shared out among them."""
    lengths = period_counts(wins.where(F.col(col).isin(*cats)), by, cats, col, length=True)
    total = sum((F.col(c) for c in cats), F.lit(0.0))
    return lengths.select(*by, *[F.try_divide(F.col(c), total).alias(c) for c in cats])


def state_grid(wins: DataFrame, analysis: DataFrame, period: float, by: Sequence[str] = (), col: str = "cat", key: str = "analysis_idx") -> DataFrame:
    """The state on a regular grid over each analysis window, times from its reference; where no window is there is none."""
    from .joins import range_join
    from .windows import grid

    at = grid(analysis.select(*by, key, "start", "stop", F.col("ref").alias("__ref")), period).select(*by, key, "__ref", "time")
    hit = range_join(at, wins.select(*by, "start", "stop", col), time="time", by=by, how="left")
    return hit.select(*by, key, (F.col("time") - F.col("__ref")).alias("time"), col)


# --- trains by protocol -------------------------------------------------------------------------------------------


def protocol_trains(wins: DataFrame, by: Sequence[str], protocol: Sequence[float], max_interval: float) -> DataFrame:
    """Pulses with the number of their train, from 1. Lengths and gaps count as the nearest of the protocol. A new train begins with another
    length, with a gap other than the one after the train's first pulse, or where that is too long."""
    import numpy as np
    import pandas as pd

    w = series(by)
    gap = lambda x: F.coalesce(match_protocol(x, protocol), F.lit(float("inf")))
    own = wins.select(*by, "start", "stop", match_protocol(F.col("stop") - F.col("start"), protocol).alias("length"), gap(F.col("start") - F.lag("stop").over(w)).alias("prev"), gap(F.lead("start").over(w) - F.col("stop")).alias("next"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "stop"], kind="stable")
        train, length, interval, out = 0, None, None, []
        for own_length, prev, nxt in zip(pdf["length"], pdf["prev"], pdf["next"], strict=True):
            if length is None or own_length != length or prev != interval or interval >= max_interval:
                train, length, interval = train + 1, own_length, nxt
            out.append(train)
        return pdf[[*by, "start", "stop"]].assign(train=np.array(out, int))

    keys = ", ".join(f"{k} {wins.schema[k].dataType.simpleString()}" for k in by)
    return own.groupBy(*by).applyInPandas(run, f"{keys}, start double, stop double, train long")


def protocol_text(interval: Column, length: Column) -> Column:
    """Interval and pulse length in words, in seconds."""
    return F.format_string("%.0f s pulses every %.0f s", length / 1000.0, interval / 1000.0)


def periods_by_train(wins: DataFrame, trains: DataFrame, by: Sequence[str], cats: Sequence[str] = ("rem", "sws"), edges: str = "keep", key: str = "train") -> DataFrame:
    """Windows of some categories that each train's window meets, whole or cropped, with the train and a number within it."""
    from .windows import classify_windows

    own = wins.where(F.col("cat").isin(*cats))
    got = classify_windows(own, trains.select(*by, key, "start", "stop", "ref"), by, edges=edges)
    n = F.row_number().over(Window.partitionBy(*by, f"other_{key}", "cat").orderBy("start", "stop")) - 1
    return got.select(*by, F.col(f"other_{key}").alias(key), "cat", n.cast("long").alias("period_id"), "start", "stop")


def label_listed(pulses: DataFrame, listed: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """`name`: whether a pulse is in a list of keys."""
    return pulses.join(listed.select(*on).distinct().withColumn(name, F.lit(True)), list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def analysis_windows(pulses: DataFrame, registry: DataFrame, length: float, align: str = "stop", on: str = "exp_name") -> DataFrame:
    """A window of a length around a place of each pulse, with what the registry says of its experiment."""
    at = {"start": F.col("start"), "stop": F.col("stop"), "ref": F.col("ref"), "mid": (F.col("start") + F.col("stop")) / 2}[align]
    own = pulses.withColumn("__at", at)
    return own.withColumns({"start": F.col("__at") - length / 2, "stop": F.col("__at") + length / 2, "ref": F.col("__at")}).drop("__at").join(registry, on, "left")


def lightness(pixels: DataFrame, by: Sequence[str], channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Lightness of each frame's mean colour: the middle of its strongest and weakest channel."""
    mean = pixels.groupBy(*by).agg(*[F.avg(c).alias(c) for c in channels])
    return mean.select(*by, ((F.greatest(*channels) + F.least(*channels)) / 2).alias("lightness"))
