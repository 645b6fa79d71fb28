"""Spikes as facts (event_id, unit_id, ref_time) and units as a dimension; the catalog of recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import number_rows


def sel_units(spikes: DataFrame, units: DataFrame, condition: Column | str) -> tuple[DataFrame, DataFrame]:
    """Units by a condition, and only their spikes."""
    own = units.where(condition)
    return spikes.join(own.select("unit_id"), "unit_id", "left_semi"), own


def orphans(spikes: DataFrame, units: DataFrame) -> DataFrame:
    """Spikes of units that aren't there."""
    return spikes.join(units, "unit_id", "left_anti")


def unit_counts(spikes: DataFrame, units: DataFrame) -> DataFrame:
    """Spikes of each unit, zero for silent ones."""
    return units.join(spikes.groupBy("unit_id").agg(F.count("*").alias("count")), "unit_id", "left").fillna({"count": 0})


def drop_silent(spikes: DataFrame, units: DataFrame) -> DataFrame:
    return units.join(spikes.select("unit_id").distinct(), "unit_id", "left_semi")


def renumber_units(spikes: DataFrame, units: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Unit ids from 0 in the given order, in both tables."""
    new = number_rows(units, order, "__new")
    moved = spikes.join(new.select("unit_id", "__new"), "unit_id").withColumn("unit_id", F.col("__new")).drop("__new")
    return moved, new.withColumn("unit_id", F.col("__new")).drop("__new")


def cell_props(spikes: DataFrame, site: str | None = None) -> DataFrame:
    """count, q05 and q95 of time, active duration, and the most frequent site (of equals the smallest)."""
    q = lambda p: F.percentile("ref_time", F.lit(p))
    out = spikes.groupBy("unit_id").agg(F.count("*").alias("count"), q(0.05).alias("q05"), q(0.95).alias("q95")).withColumn("active", F.col("q95") - F.col("q05"))
    if site:
        sites = spikes.groupBy("unit_id", site).agg(F.count("*").alias("n")).groupBy("unit_id").agg(F.max_by(site, F.struct(F.col("n"), -F.col(site))).alias("best_site"))
        out = out.join(sites, "unit_id")
    return out


def isi_histogram(spikes: DataFrame, width: float, bins: int, pmf: bool = False) -> DataFrame:
    """Histogram of inter-spike intervals of each unit."""
    w = Window.partitionBy("unit_id").orderBy("ref_time", "event_id")
    gap = spikes.withColumn("isi", F.col("ref_time") - F.lag("ref_time").over(w)).where(F.col("isi").between(0, width * bins))
    got = gap.groupBy("unit_id", F.least(F.floor(F.col("isi") / F.lit(float(width))), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("count"))
    return got.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("unit_id"))) if pmf else got


def activity(spikes: DataFrame, width: float, rate: bool = False) -> DataFrame:
    """Spikes of each unit in bins of time; as rates in Hz if asked for."""
    got = spikes.groupBy("unit_id", F.floor(F.col("ref_time") / F.lit(float(width))).alias("bin")).agg(F.count("*").alias("count"))
    return got.withColumn("rate", F.col("count") / F.lit(width / 1000.0)) if rate else got


def multi_unit(spikes: DataFrame, units: DataFrame, by: str) -> DataFrame:
    """All units of one property as one."""
    return spikes.join(units.select("unit_id", by), "unit_id").withColumn("unit_id", F.col(by)).drop(by)


def concat_spikes(parts: Sequence[DataFrame]) -> DataFrame:
    """Union with unit ids made distinct: a dense number over (part, unit)."""
    import functools

    both = functools.reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    ids = number_rows(both.select("part", "unit_id").distinct(), ("part", "unit_id"), "gid")
    return both.join(ids, ["part", "unit_id"]).drop("unit_id").withColumnRenamed("gid", "unit_id")


def crop_spikes(spikes: DataFrame, lo: float, hi: float) -> DataFrame:
    return spikes.where(F.col("ref_time").between(lo, hi))


# --- catalog ------------------------------------------------------------------------------------------------------


def unpivot_probes(registry: DataFrame, n: int = 4, key: str = "exp_name") -> DataFrame:
    """One row a probe from the columns probe0.., side0.., ch0.. of an experiment's row; empty ones go."""
    parts = F.array(*[F.struct(F.lit(i).alias("probe_no"), *[F.col(f"{c}{i}").cast("string").alias(c) for c in ("probe", "side", "ch") if f"{c}{i}" in registry.columns]) for i in range(n) if f"probe{i}" in registry.columns])
    return registry.select(key, F.inline(parts)).where("probe IS NOT NULL")


def is_bilateral(probes: DataFrame, area: str, key: str = "exp_name") -> DataFrame:
    """Experiments with two probes or more in an area."""
    own = probes.where(F.lower("probe").contains(area.lower()))
    return own.groupBy(key).agg(F.count("*").alias("n")).where("n >= 2").select(key)


def group_experiments(registry: DataFrame, by: Sequence[str], key: str = "exp_name") -> DataFrame:
    """Groups by descending size (then by label), with their label and count."""
    got = registry.groupBy(*by).agg(F.count(key).alias("n"))
    label = F.concat_ws(" ", *by)
    return got.withColumn("label", F.concat(label, F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).withColumn("group_no", (F.row_number().over(Window.orderBy(F.desc("n"), *by)) - 1).cast("long"))


def channel_pairs(probes: DataFrame, key: str, channel: str, side: str) -> DataFrame:
    """All pairs i < j of a recording's channels, with whether they lie on one side."""
    b = probes.select(F.col(key), F.col(channel).alias("ch1"), F.col(side).alias("side1"))
    pairs = probes.select(F.col(key), F.col(channel).alias("ch0"), F.col(side).alias("side0")).join(b, key).where("ch0 < ch1")
    return pairs.withColumn("kind", F.when(F.col("side0") == F.col("side1"), "ipsi").otherwise("contra"))


def missing_outputs(wanted: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """The work that isn't done yet."""
    return wanted.join(done, list(on), "left_anti")


def common_reference(samples: DataFrame, sample: str = "i", channel: str = "channel", value: str = "value") -> DataFrame:
    """Each channel less its own median, and each sample less the median over channels."""
    own = samples.groupBy(channel).agg(F.percentile(value, F.lit(0.5)).alias("__c"))
    flat = samples.join(own, channel).withColumn(value, F.col(value) - F.col("__c")).drop("__c")
    return flat.withColumn(value, F.col(value) - F.percentile(value, F.lit(0.5)).over(Window.partitionBy(sample)))


def rising_edges(samples: DataFrame, by: Sequence[str], value: str = "value", order: str = "i") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return samples.withColumn("__d", F.col(value) - F.lag(value).over(w)).where("__d > 0").drop("__d")


# --- clocks -------------------------------------------------------------------------------------------------------


def shift_spikes(spikes: DataFrame, by: float) -> DataFrame:
    return spikes.withColumn("ref_time", F.col("ref_time") + F.lit(float(by)))


def to_probe_clock(spikes: DataFrame, rates: DataFrame, reference: float, on: str = "probe") -> DataFrame:
    """Times that were taken at a reference rate, by each probe's own rate (probe, rate)."""
    return spikes.join(rates.select(on, F.col("rate").alias("__r")), on).withColumn("ref_time", F.col("ref_time") * F.lit(float(reference)) / F.col("__r")).drop("__r")


def common_onsets(onsets: DataFrame, probe: str = "probe", order: str = "n", time: str = "time", step: float | None = None) -> DataFrame:
    """Sync onsets on the common clock: the mean over probes of each onset, rounded; with `step` an even grid from the first if any gap differs."""
    mean = onsets.groupBy(order).agg(F.rint(F.avg(time)).alias("common"))
    if step is None:
        return mean
    gap = F.col("common") - F.lag("common").over(Window.orderBy(order))
    told = mean.withColumn("__g", gap).agg(F.min("common").alias("__a"), F.min(order).alias("__o"), F.max(F.when(F.col("__g").isNotNull(), (F.col("__g") != F.lit(float(step))).cast("int"))).alias("__off"))
    even = F.col("__a") + (F.col(order) - F.col("__o")) * F.lit(float(step))
    return mean.crossJoin(F.broadcast(told)).withColumn("common", F.when(F.col("__off") == 1, even).otherwise(F.col("common"))).select(order, "common")  # one row


def sync_clock(times: DataFrame, onsets: DataFrame, by: Sequence[str] = (), time: str = "time", local: str = "local", common: str = "common") -> DataFrame:
    """Times of a probe's clock on the common one: linear between the onsets around them, and beyond the first or last at that segment's pace."""
    from .joins import neighbours

    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(local)
    seg = onsets.select(*by, F.col(local).cast("double").alias("__x0"), F.col(common).cast("double").alias("__y0"), F.lead(local).over(w).cast("double").alias("__x1"), F.lead(common).over(w).cast("double").alias("__y1"), F.row_number().over(w).cast("double").alias("__no"))
    seg = seg.where("__x1 IS NOT NULL")
    at = neighbours(times, seg.select(*by, "__x0", "__no"), left_time=time, right_time="__x0", value="__no", by=by)
    own = at.withColumn("__no", F.coalesce("v0", F.lit(1.0))).drop("t0", "v0", "t1", "v1")
    t = F.col(time)
    line = F.col("__y0") + (t - F.col("__x0")) * F.try_divide(F.col("__y1") - F.col("__y0"), F.col("__x1") - F.col("__x0"))
    return own.join(seg, [*by, "__no"]).withColumn("synced", line).drop("__no", "__x0", "__x1", "__y0", "__y1")


def frame_times(frames: DataFrame, first: DataFrame, by: Sequence[str], stamp: str = "stamp") -> DataFrame:
    """Frames (by, n, stamp in microseconds) on the recording's clock, whose first stamp is given (by, first): time in ms."""
    return frames.join(first.select(*by, F.col("first").alias("__f")), list(by)).withColumn("time", (F.col(stamp) - F.col("__f")) / 1000.0).drop("__f")


# --- more of the catalog ------------------------------------------------------------------------------------------


def clock_events(registry: DataFrame, cols: Sequence[str], key: str = "exp_name") -> DataFrame:
    """Wall-clock columns (timestamps) as events: ms since midnight of their day."""
    parts = F.array(*[F.struct(F.lit(c).alias("event"), ((F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)) * 1000.0).alias("ref_time")) for c in cols])
    return registry.select(key, F.inline(parts)).where("ref_time IS NOT NULL")


def timestamps_from_text(registry: DataFrame, col: str, key: str = "exp_name", time: str = "ref_time") -> DataFrame:
    """Lines of `description: time` in a text column as events, in order."""
    from ..functions.timeunits import str_to_ms

    lines = registry.select(key, F.posexplode(F.split(col, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return lines.select(key, F.col("line_no").cast("long").alias("line_no"), F.trim(F.regexp_extract("line", r"^([^:]*):", 1)).alias("desc"), str_to_ms(F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).alias(time))


def short_description(registry: DataFrame, cols: Sequence[str], key: str = "exp_name") -> DataFrame:
    """The columns that aren't empty, in words."""
    return registry.select(key, F.concat_ws(", ", *[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in cols]).alias("desc"))


def quality(registry: DataFrame, required: Sequence[str], probes: Sequence[Sequence[str]]) -> DataFrame:
    """One row: rows, rows that lack a required column, and rows without any complete set of probe columns."""
    lacks = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    some = F.lit(False)
    for own in probes:
        whole = F.lit(True)
        for c in own:
            whole &= ~lacks(c)
        some |= whole
    missing = F.lit(False)
    for c in required:
        missing |= lacks(c)
    return registry.agg(F.count("*").alias("n"), F.count(F.when(missing, 1)).alias("incomplete"), F.count(F.when(~some, 1)).alias("without_probe"))


def lead_first(pairs: DataFrame, corr: DataFrame, preferred: str, area: str = "area") -> DataFrame:
    """Correlations of channel pairs with the preferred area first: where the second one is of it and the first is not, channels swap and lags change sign."""
    swap = (F.col(f"{area}1") == preferred) & (F.col(f"{area}0") != preferred)
    both = corr.join(pairs, ["ch0", "ch1"]).withColumn("__s", swap)
    pick = lambda a, b: F.when(F.col("__s"), F.col(b)).otherwise(F.col(a))
    return both.select(pick("ch0", "ch1").alias("first"), pick("ch1", "ch0").alias("second"), F.when(F.col("__s"), -F.col("lag")).otherwise(F.col("lag")).alias("lag"), "corr")


def eye_opening(points: DataFrame, by: Sequence[str], most: float = 100.0) -> DataFrame:
    """The distance of two tracked points (x0, y0, x1, y1) in each frame; larger ones than `most` are missing, the others lie between their 5 % and 95 % quantiles."""
    d = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    own = points.withColumn("value", F.when(d <= most, d))
    q = own.groupBy(*by).agg(F.percentile("value", F.lit(0.05)).alias("__a"), F.percentile("value", F.lit(0.95)).alias("__b"))
    return own.join(q, list(by)).withColumn("value", F.try_divide(F.col("value") - F.col("__a"), F.col("__b") - F.col("__a"))).drop("__a", "__b")


def normal_luminance(lum: DataFrame, by: Sequence[str], smooth: int | None = None, order: str = "time", value: str = "value") -> DataFrame:
    """Luminance between its least and largest value, after a rolling median of a few frames if asked for."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-((smooth or 1) // 2), (smooth or 1) - (smooth or 1) // 2 - 1)
    own = lum.withColumn(value, F.percentile(value, F.lit(0.5)).over(w)) if smooth else lum
    whole = Window.partitionBy(*by)
    return own.withColumn(value, F.try_divide(F.col(value) - F.min(value).over(whole), F.max(value).over(whole) - F.min(value).over(whole)))


def strongest_channel(beta: DataFrame, by: Sequence[str], order: str = "time", value: str = "value") -> DataFrame:
    """Of several channels' power at each time the largest and the mean."""
    return beta.groupBy(*by, order).agg(F.max(value).alias("beta_max"), F.avg(value).alias("beta_mean"))
