"""Sets of time windows: columns win_idx, start, stop, ref and any metadata, in milliseconds. `by` partitions a set into series.

Every function takes and returns DataFrames; order within a series is (start, stop, ref) unless said otherwise.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeunits import ms_to_str, str_to_ms
from .joins import overlap_join, range_join
from .numbering import number_rows

START, STOP, REF = F.col, F.col, F.col
LENGTH = "stop - start"


def _keys(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def series(by: Sequence[str] = (), *order: str | Column):
    """The window specification of a series in order."""
    return Window.partitionBy(*_keys(by)).orderBy(*(order or [c for c in ("start", "stop")]))


def relative(q: str | float, start: str = "start", stop: str = "stop") -> Column:
    """The time at a relative place: start, stop, mid, ref, zero or a fraction."""
    named = {"start": F.col(start), "stop": F.col(stop), "zero": F.lit(0.0), "ref": F.col("ref")}
    if isinstance(q, str) and q in named:
        return named[q]
    return F.col(start) + (F.col(stop) - F.col(start)) * F.lit(0.5 if q == "mid" else float(q))


# --- constructors -------------------------------------------------------------------------------------------------


def build_around(marks: DataFrame, pre: float, post: float, time: str = "time") -> DataFrame:
    """One window a mark: start = mark + pre, stop = mark + post, ref = mark."""
    t = F.col(time)
    rest = [c for c in marks.columns if c not in (time, "start", "stop", "ref")]
    return marks.select(*rest, (t + F.lit(float(pre))).alias("start"), (t + F.lit(float(post))).alias("stop"), t.cast("double").alias("ref"))


def build_around_multiple(marks: DataFrame, wins: dict[str, tuple[float, float]], time: str = "time", col: str = "name") -> DataFrame:
    """Marks times named windows."""
    named = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in wins.items()])
    each = marks.withColumn("__w", F.explode(named))
    rest = [c for c in marks.columns if c != time]
    t = F.col(time)
    return each.select(*rest, F.col("__w.k").alias(col), (t + F.col("__w.a")).alias("start"), (t + F.col("__w.b")).alias("stop"), t.cast("double").alias("ref"))


def around(wins: DataFrame, pre: float, post: float, q: str | float = "mid", old: str | None = None) -> DataFrame:
    """New windows relative to a place in the old ones; `old` keeps those edges under a prefix."""
    out = wins.withColumn("__at", relative(q))
    if old:
        out = out.withColumns({f"{old}{c}": F.col(c) for c in ("start", "stop", "ref") if c in wins.columns})
    return out.withColumns({"start": F.col("__at") + F.lit(float(pre)), "stop": F.col("__at") + F.lit(float(post)), "ref": F.col("__at")}).drop("__at")


def centered(wins: DataFrame, duration: float, q: str | float = "mid") -> DataFrame:
    return around(wins, -duration / 2, duration / 2, q)


def before(wins: DataFrame, duration: float, offset: float = 0, q: str | float = "start") -> DataFrame:
    return around(wins, -duration - offset, -offset, q)


def after(wins: DataFrame, duration: float, offset: float = 0, q: str | float = "stop") -> DataFrame:
    return around(wins, offset, offset + duration, q)


def before_after(wins: DataFrame, pre: float, post: float, col: str = "when") -> DataFrame:
    """Windows before the start and after the stop of each, told apart by `col`."""
    rest = [c for c in wins.columns if c not in ("start", "stop", "ref")]
    a, b = F.col("start"), F.col("stop")
    both = F.array(F.struct(F.lit("pre").alias(col), (a - pre).alias("start"), a.alias("stop"), a.alias("ref")), F.struct(F.lit("post").alias(col), b.alias("start"), (b + post).alias("stop"), b.alias("ref")))
    return wins.select(*rest, F.inline(both))


def build_sliding(df: DataFrame, length: float, step: float, start: str = "start", stop: str = "stop", keep_rest: bool = False) -> DataFrame:
    """Windows of one length, a step apart, inside each row's [start, stop). The last partial ones are dropped, or clipped."""
    a, b = F.col(start), F.col(stop)
    span = (b - a) if keep_rest else (b - a - F.lit(float(length)))
    n = F.ceil(span / F.lit(float(step))) - 1 if keep_rest else F.floor(span / F.lit(float(step)))
    each = df.where(n >= 0).select(*[c for c in df.columns if c not in ("start", "stop", "ref")], a.alias("__a"), b.alias("__b"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("slide"))
    s = F.col("__a") + F.col("slide") * F.lit(float(step))
    return each.withColumns({"start": s, "stop": F.least(s + F.lit(float(length)), F.col("__b"))}).withColumn("ref", (F.col("start") + F.col("stop")) / 2).drop("__a", "__b")


def build_between(times: DataFrame, time: str = "time", by: Sequence[str] = (), start: float | None = None, stop: float | None = None) -> DataFrame:
    """Windows between consecutive times; other columns come twice, as start_ and stop_. Outer edges may be added."""
    meta = [c for c in times.columns if c != time and c not in by]
    rows = times.select(*by, *meta, F.col(time).cast("double").alias(time))
    for edge in (start, stop):
        if edge is not None:
            keys = rows.select(*by).distinct() if by else rows.limit(1).select(F.lit(1).alias("__one"))
            rows = rows.unionByName(keys.select(*by, F.lit(float(edge)).alias(time)), allowMissingColumns=True)
    w = Window.partitionBy(*_keys(by)).orderBy(time)
    nxt = rows.select(*by, F.col(time).alias("start"), F.lead(time).over(w).alias("stop"), F.col(time).alias("ref"), *[F.col(c).alias(f"start_{c}") for c in meta], *[F.lead(c).over(w).alias(f"stop_{c}") for c in meta])
    return nxt.where(F.col("stop").isNotNull())


def runs(values: DataFrame, order: str, value: str, by: Sequence[str] = (), period: float | None = None, mid: bool = True, include_right: bool = False) -> DataFrame:
    """Gaps and islands: a window for each run of one value. With a period a gap in time ends a run and edges move by half a period."""
    w = Window.partitionBy(*_keys(by)).orderBy(order)
    new = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True))
    if period:
        new |= F.coalesce(F.col(order) - F.lag(order).over(w) > F.lit(1.5 * period), F.lit(False))
    flagged = values.withColumn("__n", F.when(new, 1).otherwise(0)).withColumn("__run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = float(period or 1.0)
    edge = step / 2 if mid else 0.0
    got = flagged.groupBy(*by, "__run", F.col(value).alias("cat")).agg(F.min(order).alias("__a"), F.max(order).alias("__b"), F.count("*").alias("count"))
    right = step / 2 if mid else (0.0 if not include_right else step)
    return got.select(*by, "cat", "count", (F.col("__a").cast("double") - edge).alias("start"), (F.col("__b").cast("double") + right).alias("stop"), (F.col("__a").cast("double") - edge).alias("ref"))


def from_text(df: DataFrame, text: str, split: str = "\n", col: str = "cat") -> DataFrame:
    """Lines of `cat: a - b`, with times as text, as windows; a line without a colon or without two times is an error."""
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.explode(F.split(text, split)).alias("__line")).where(F.trim("__line") != "")
    parts = F.split(F.regexp_extract("__line", r"^[^:]*:\s*(.*)$", 1), r"\s+-\s+")
    bad = ~F.col("__line").rlike(r"^[^:]+:\s*\S.*\s-\s+\S")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a window: "), F.col("__line")))).otherwise(F.trim(F.regexp_extract("__line", r"^([^:]*):", 1)))
    return lines.select(*rest, checked.alias(col), str_to_ms(parts[0]).alias("start"), str_to_ms(parts[1]).alias("stop"), str_to_ms(parts[0]).alias("ref"))


def to_text(wins: DataFrame, by: Sequence[str] = (), split: str = "\n", col: str = "cat") -> DataFrame:
    """The lines of each series, in order; a series' windows are one text, so it is meant for small sets."""
    line = F.concat(F.col(col).cast("string"), F.lit(": "), ms_to_str("start", strip=False, show_days=True), F.lit(" - "), ms_to_str("stop", strip=False, show_days=True))
    got = wins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "stop", line.alias("line")))).alias("__l"))
    return got.select(*by, F.array_join(F.transform("__l", lambda x: x["line"]), split).alias("text"))


def from_dict(spark: SparkSession, wins: dict[str, tuple[float, float]], col: str = "cat") -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b), float(a)) for k, (a, b) in wins.items()], f"{col} string, start double, stop double, ref double")


def concat(parts: dict, name: str = "cycle_idx") -> DataFrame:
    """Union with the key of each part as a column."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def reset_index(wins: DataFrame, by: Sequence[str] = (), sort_by: Sequence[str] = ("start", "stop", "ref")) -> DataFrame:
    if not by:
        return number_rows(wins.drop("win_idx"), sort_by, "win_idx")
    return wins.withColumn("win_idx", (F.row_number().over(Window.partitionBy(*_keys(by)).orderBy(*sort_by)) - 1).cast("long"))


def scale(wins: DataFrame, factor: float, cols: Sequence[str] = ("start", "stop", "ref")) -> DataFrame:
    return wins.withColumns({c: F.col(c) * F.lit(float(factor)) for c in cols})


def rename_cat(wins: DataFrame, renaming: dict, col: str = "cat") -> DataFrame:
    """Values by a mapping; those that it lacks stay."""
    table = F.create_map(*[F.lit(x) for kv in renaming.items() for x in kv])
    return wins.withColumn(col, F.coalesce(F.try_element_at(table, F.col(col)), F.col(col)))


def generate_cat(wins: DataFrame, times: DataFrame, time: str = "time", by: Sequence[str] = (), col: str = "cat", closed: str = "left") -> DataFrame:
    """The category at each time, null where no window is."""
    return range_join(times, wins.select(*by, "start", "stop", col), time=time, by=by, closed=closed, how="left").drop("start", "stop")


def generate_cat_grid(wins: DataFrame, period: float, by: Sequence[str] = (), col: str = "cat", fill: str | None = None) -> DataFrame:
    """A regular grid over each series with its category; on a shared edge the later window wins."""
    hull = wins.groupBy(*by).agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    grid = hull.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / F.lit(float(period))))).alias("i"), "a").select(*by, (F.col("a") + F.col("i") * F.lit(float(period))).alias("time"))
    hit = range_join(grid, wins.select(*by, "start", "stop", col), time="time", by=by, closed="both", how="left")
    got = hit.groupBy(*by, "time").agg(F.max_by(col, F.struct("start", "stop")).alias(col))
    return got.fillna({col: fill}) if fill else got


# --- set operations -----------------------------------------------------------------------------------------------


def merge_overlap(wins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The union over time of each series; touching windows merge, and one inside another doesn't end a chain."""
    w = series(by)
    upto = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > upto, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = wins.withColumn("__i", island).groupBy(*by, "__i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("merged"))
    return got.drop("__i").withColumn("ref", F.col("start"))


def merge_tight(wins: DataFrame, by: Sequence[str] = (), same: str | None = None, take: str = "first") -> DataFrame:
    """Runs of windows that share an edge (and a category) become one, with the metadata of the first or last."""
    w = series(by)
    tight = F.col("start") <= F.lag("stop").over(w)
    if same:
        tight &= F.col(same).eqNullSafe(F.lag(same).over(w))
    island = F.sum(F.when(F.coalesce(tight, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    meta = [c for c in wins.columns if c not in (*by, "start", "stop", "win_idx")]
    pick = F.min_by if take == "first" else F.max_by
    got = wins.withColumn("__i", island).groupBy(*by, "__i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *[pick(c, F.struct("start", "stop")).alias(c) for c in meta])
    return got.drop("__i")


def invert(wins: DataFrame, by: Sequence[str] = (), start: float | None = None, stop: float | None = None, drop_empty: bool = True) -> DataFrame:
    """The gaps that no window covers, with outer edges if given."""
    merged = merge_overlap(wins, by).select(*by, "start", "stop")
    if start is not None or stop is not None:
        keys = merged.select(*by).distinct() if by else merged.limit(1).select(F.lit(1).alias("__one"))
        for edge in (start, stop):
            if edge is not None:
                merged = merged.unionByName(keys.select(*by, F.lit(float(edge)).alias("start"), F.lit(float(edge)).alias("stop")))
    w = series(by)
    gaps = merged.select(*by, F.col("stop").alias("start"), F.lead("start").over(w).alias("stop")).where("stop IS NOT NULL")
    return gaps.where("stop > start") if drop_empty else gaps


def complement(wins: DataFrame, by: Sequence[str] = (), cat: str = "unknown", start: float | None = None, stop: float | None = None) -> DataFrame:
    """The windows and their gaps, which get a category of their own."""
    gaps = invert(wins, by, start, stop).withColumn("cat", F.lit(cat)).withColumn("ref", F.col("start"))
    return wins.unionByName(gaps, allowMissingColumns=True)


def crop(wins: DataFrame, a: float, b: float, reset: bool = False) -> DataFrame:
    """Clipped to [a, b]; windows that touch an edge stay, with no length."""
    out = wins.withColumns({"start": F.greatest("start", F.lit(float(a))), "stop": F.least("stop", F.lit(float(b)))}).where("start <= stop")
    return out.withColumns({c: F.col(c) - F.lit(float(a)) for c in ("start", "stop", "ref") if c in wins.columns}) if reset else out


def crop_to_multiple(wins: DataFrame, others: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each window clipped by every other set's window that it meets, in as many pieces."""
    pairs = overlap_join(wins, others.select(*by, "start", "stop"), by=by)
    return pairs.withColumns({"start": F.greatest("start", "other_start"), "stop": F.least("stop", "other_stop")}).drop("other_start", "other_stop")


def extract(wins: DataFrame, outer: DataFrame, by: Sequence[str] = (), align: str | None = None, copy: Sequence[str] = ()) -> DataFrame:
    """Intersections with the outer windows of the same series; `cut_win_idx` names the outer one, `align` re-references times to it."""
    pairs = overlap_join(wins, outer, by=by)
    out = pairs.withColumns({"start": F.greatest("start", "other_start"), "stop": F.least("stop", "other_stop")}).withColumnRenamed("other_win_idx", "cut_win_idx")
    if align:
        at = {"start": F.col("other_start"), "stop": F.col("other_stop"), "ref": F.col("other_ref") if "ref" in outer.columns else F.col("other_start")}[align]
        out = out.withColumn("__at", at).withColumns({c: F.col(c) - F.col("__at") for c in ("start", "stop", "ref") if c in wins.columns}).drop("__at")
    for c in copy:
        out = out.withColumn(c, F.col(f"other_{c}"))
    return out.drop(*[c for c in out.columns if c.startswith("other_")])


def split(wins: DataFrame, length: float, align: str = "left", inclusive: bool = False) -> DataFrame:
    """Tiles of one length inside each window. As the end is left out of the grid, a whole multiple loses its last tile unless `inclusive`."""
    n = F.floor((F.col("stop") - F.col("start")) / F.lit(float(length)))
    exact = (F.col("stop") - F.col("start")) == n * F.lit(float(length))
    last = n - 1 if inclusive else F.when(exact, n - 2).otherwise(n - 1)
    room = (F.col("stop") - F.col("start")) - (last + 1) * F.lit(float(length))
    shift = {"left": F.lit(0.0), "right": room, "mid": room / 2}[align]
    each = wins.where(last >= 0).withColumn("__s", shift).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    a = F.col("start") + F.col("__s") + F.col("tile") * F.lit(float(length))
    return each.withColumn("start", a).withColumn("stop", F.col("start") + F.lit(float(length))).withColumn("ref", F.col("start")).withColumnRenamed("win_idx", "main_win_idx").drop("__s")


def shift_time(wins: DataFrame, shifts: DataFrame | float, on: str = "win_idx", col: str = "shift", drop_missing: bool = True) -> DataFrame:
    """All times moved, by a number or by each window's own shift."""
    if not isinstance(shifts, DataFrame):
        return wins.withColumns({c: F.col(c) + F.lit(float(shifts)) for c in ("start", "stop", "ref") if c in wins.columns})
    out = wins.join(shifts.select(on, F.col(col).alias("__s")), on, "inner" if drop_missing else "left")
    return out.withColumns({c: F.col(c) + F.coalesce("__s", F.lit(0.0)) for c in ("start", "stop", "ref") if c in wins.columns}).drop("__s")


def defrag(wins: DataFrame, by: Sequence[str] = (), start: float = 0) -> DataFrame:
    """Gaps closed: each window follows the one before it."""
    w = series(by).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.sum(F.expr(LENGTH)).over(w), F.lit(0.0)) + F.lit(float(start))
    return wins.withColumn("__new", new).withColumns({"stop": F.col("__new") + F.expr(LENGTH), "ref": F.col("__new") + F.col("ref") - F.col("start"), "start": F.col("__new")}).drop("__new")


def defrag_events(wins: DataFrame, events: DataFrame, time: str = "time", by: Sequence[str] = (), start: float = 0) -> DataFrame:
    """Times on the axis where gaps are closed; those in gaps go."""
    w = series(by).rowsBetween(Window.unboundedPreceding, -1)
    moved = wins.select(*by, "start", "stop", (F.coalesce(F.sum(F.expr(LENGTH)).over(w), F.lit(0.0)) + F.lit(float(start))).alias("__new"))
    hit = range_join(events, moved, time=time, by=by)
    return hit.withColumn(time, F.col(time) - F.col("start") + F.col("__new")).drop("start", "stop", "__new")


def is_overlapping(by: Sequence[str] = ()) -> Column:
    """Whether the next window of the series begins before this one ends."""
    return F.coalesce(F.lead("start").over(series(by)) < F.col("stop"), F.lit(False))


def drop_overlap(wins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return wins.withColumn("__o", is_overlapping(by)).where("NOT __o").drop("__o")


def drop_empty(wins: DataFrame) -> DataFrame:
    return wins.where("stop > start")


def drop_duplicates(wins: DataFrame, by: Sequence[str] = (), order: str = "win_idx") -> DataFrame:
    """One window of each (start, stop): the first by `order`."""
    w = Window.partitionBy(*_keys(by), "start", "stop").orderBy(order)
    return wins.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def prev_cat(by: Sequence[str] = (), col: str = "cat") -> Column:
    return F.lag(col).over(series(by))


def next_cat(by: Sequence[str] = (), col: str = "cat") -> Column:
    return F.lead(col).over(series(by))


def is_sandwiched(by: Sequence[str] = (), col: str = "cat", max_length: float | None = None, cat: str | None = None) -> Column:
    """Between two windows of one other category, optionally short or of a given category."""
    hit = (prev_cat(by, col) == next_cat(by, col)) & (F.col(col) != next_cat(by, col))
    if max_length is not None:
        hit &= F.expr(LENGTH) < F.lit(float(max_length))
    if cat is not None:
        hit &= F.col(col) == F.lit(cat)
    return F.coalesce(hit, F.lit(False))


# --- predicates and measures --------------------------------------------------------------------------------------


def set_flags(wins: DataFrame, by: Sequence[str] = (), col: str = "cat", atol: float = 1e-8) -> DataFrame:
    """One row a series: are_uniform, are_alternating, are_exclusive, are_integer, are_tight."""
    w = series(by)
    step = wins.select(*by, "start", "stop", F.lag("stop").over(w).alias("__p"), F.lag(col).over(w).alias("__c"), F.col(col).alias("__cat"))
    whole = lambda c: F.col(c) == F.rint(c)
    return step.groupBy(*by).agg(
        (F.max(F.expr(LENGTH)) - F.min(F.expr(LENGTH)) <= F.lit(atol)).alias("are_uniform"),
        F.every(F.coalesce(F.col("__cat") != F.col("__c"), F.lit(True))).alias("are_alternating"),
        F.every(F.coalesce(F.col("start") >= F.col("__p"), F.lit(True))).alias("are_exclusive"),
        F.every(whole("start") & whole("stop")).alias("are_integer"),
        F.every(F.coalesce(F.col("start") == F.col("__p"), F.lit(True))).alias("are_tight"),
    )


def is_within_any(wins: DataFrame, outer: DataFrame, by: Sequence[str] = (), key: str = "win_idx") -> DataFrame:
    """Windows that lie within some outer one, edges included."""
    o = outer.select(*by, F.col("start").alias("__a"), F.col("stop").alias("__b"))
    hit = range_join(wins.select(*by, key, "start", "stop"), o, time="start", start="__a", stop="__b", by=by, closed="both").where("stop <= __b")
    return wins.join(hit.select(*by, key).distinct(), [*by, key], "left_semi")


def contained_in_others(wins: DataFrame, outer: DataFrame, by: Sequence[str] = (), fully: bool = True, how: str = "any", key: str = "win_idx") -> DataFrame:
    """key and `contained`: whether any (or all) outer windows of the series hold the window, wholly or in part. Without outer ones: any is false, all true."""
    o = outer.select(*by, F.col("start").alias("__a"), F.col("stop").alias("__b"))
    rows = wins.select(*by, key, "start", "stop")
    if fully:
        hit = range_join(rows, o, time="start", start="__a", stop="__b", by=by, closed="both").where("stop <= __b")
    else:
        hit = overlap_join(rows, o.withColumnsRenamed({"__a": "start", "__b": "stop"}), by=by)
    held = hit.groupBy(*by, key).agg(F.count("*").alias("__n"))
    out = rows.join(held, [*by, key], "left").fillna({"__n": 0})
    if how == "any":
        return out.select(*by, key, (F.col("__n") > 0).alias("contained"))
    sizes = outer.groupBy(*by).agg(F.count("*").alias("__all")) if by else outer.agg(F.count("*").alias("__all"))
    out = out.join(sizes, list(by), "left") if by else out.crossJoin(F.broadcast(sizes))  # one row
    return out.select(*by, key, (F.col("__n") == F.coalesce("__all", F.lit(0))).alias("contained"))


def force_uniform(wins: DataFrame, by: Sequence[str] = (), length: float | None = None) -> DataFrame:
    """All windows of one length (by default the series' median), scaled around their reference."""
    goal = F.lit(float(length)) if length is not None else F.percentile(F.expr(LENGTH), F.lit(0.5)).over(Window.partitionBy(*_keys(by)))
    f = F.try_divide(F.col("__goal"), F.expr(LENGTH))
    return wins.withColumn("__goal", goal).withColumns({"start": F.col("ref") - (F.col("ref") - F.col("start")) * f, "stop": F.col("ref") + (F.col("stop") - F.col("ref")) * f}).drop("__goal")


def crop_to_minimum_common(wins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every window as long on both sides of its reference as the shortest one of the series."""
    w = Window.partitionBy(*_keys(by))
    out = wins.withColumn("__l", F.min(F.col("ref") - F.col("start")).over(w)).withColumn("__r", F.min(F.col("stop") - F.col("ref")).over(w))
    return out.withColumns({"start": F.col("ref") - F.col("__l"), "stop": F.col("ref") + F.col("__r")}).drop("__l", "__r")


def edges(wins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct edges."""
    return wins.select(*by, F.explode(F.array("start", "stop")).alias("edge")).distinct()


def total_by(wins: DataFrame, *by: str) -> DataFrame:
    return wins.groupBy(*by).agg(F.sum(F.expr(LENGTH)).alias("total"))


def global_win(wins: DataFrame, *by: str) -> DataFrame:
    return wins.groupBy(*by).agg(F.least(F.min("start"), F.min("stop")).alias("start"), F.greatest(F.max("start"), F.max("stop")).alias("stop"))


def classify_events(events: DataFrame, wins: DataFrame, time: str = "time", by: Sequence[str] = (), refs: Sequence[str] = ("ref",), right: bool = False, how: str = "inner") -> DataFrame:
    """Events with each window that holds them, [start, stop) or with `right` (start, stop], and their delay from its reference columns."""
    hit = range_join(events, wins.where("stop > start"), time=time, by=by, closed="right" if right else "left", how=how)
    names = {r: "delay" if len(refs) == 1 else f"delay_from_{r}" for r in refs}
    return hit.withColumns({n: F.col(time) - F.col(r) for r, n in names.items()})


def annotate_events(events: DataFrame, wins: DataFrame, time: str = "time", by: Sequence[str] = (), prefix: str = "", drop: bool = False, right: bool = False) -> DataFrame:
    """All events (or, with `drop`, those inside) with the metadata of their window, under a prefix."""
    named = wins.select(*by, *[F.col(c) if c in ("start", "stop") else F.col(c).alias(f"{prefix}{c}") for c in wins.columns if c not in by])
    out = classify_events(events, named, time, by, (f"{prefix}ref",), right, "inner" if drop else "left")
    return out.drop("start", "stop")


def classify_windows(wins: DataFrame, others: DataFrame, by: Sequence[str] = (), align: str = "ref", edges: str = "crop") -> DataFrame:
    """Windows with each other window that they meet, times re-referenced to it. edges: crop, keep, or drop those that reach out."""
    pairs = overlap_join(wins, others, by=by)
    if edges == "drop":
        pairs = pairs.where("start >= other_start AND stop <= other_stop")
    if edges == "crop":
        pairs = pairs.withColumns({"start": F.greatest("start", "other_start"), "stop": F.least("stop", "other_stop")})
    at = F.col(f"other_{align}") if align in ("start", "stop", "ref") else relative(align, "other_start", "other_stop")
    return pairs.withColumn("__at", at).withColumns({c: F.col(c) - F.col("__at") for c in ("start", "stop", "ref")}).drop("__at")


def inter_intervals(wins: DataFrame, by: Sequence[str] = (), first: str = "stop", second: str = "start", sort_by: str = "ref", shift: int = 1) -> DataFrame:
    """From `first` of each window to `second` of the one `shift` further."""
    w = Window.partitionBy(*_keys(by)).orderBy(sort_by, "start", "stop")
    return wins.withColumn("interval", F.lead(second, shift).over(w) - F.col(first))


def inter_intervals_by(wins: DataFrame, cat0: str, cat1: str, by: Sequence[str] = (), col: str = "cat", first: str = "ref", second: str = "ref", sort_by: str = "ref") -> DataFrame:
    """Intervals of cat0 followed at once by cat1, among the windows of the two."""
    w = Window.partitionBy(*_keys(by)).orderBy(sort_by, "start", "stop")
    own = wins.where(F.col(col).isin(cat0, cat1)).withColumn("__n", F.lead(col).over(w)).withColumn("interval", F.lead(second).over(w) - F.col(first))
    return own.where((F.col(col) == cat0) & (F.col("__n") == cat1)).drop("__n")


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal bins over [lo, hi], the last one closed; only bins with rows."""
    width = (hi - lo) / bins
    bin_no = F.least(F.floor((F.col("__v") - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("long")
    got = df.withColumn("__v", value).where(F.col("__v").between(lo, hi)).withColumn("bin", bin_no)
    return got.groupBy(*by, "bin").agg(F.count("*").alias("count")).withColumn("bin_lo", F.lit(float(lo)) + F.col("bin") * F.lit(width))


def intervals_around(wins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """to_prev, to_next and to_closest: gaps to the neighbours; infinite at the ends."""
    w = series(by)
    inf = F.lit(float("inf"))
    out = wins.withColumns({"to_prev": F.coalesce(F.col("start") - F.lag("stop").over(w), inf), "to_next": F.coalesce(F.lead("start").over(w) - F.col("stop"), inf)})
    return out.withColumn("to_closest", F.least("to_prev", "to_next"))


def is_isolated(wins: DataFrame, at_least: float, by: Sequence[str] = ()) -> DataFrame:
    return intervals_around(wins, by).withColumn("isolated", F.col("to_closest") >= F.lit(float(at_least)))


def change(wins: DataFrame, pre: float = 0, post: float = 0) -> DataFrame:
    return wins.withColumns({"start": F.col("start") + F.lit(float(pre)), "stop": F.col("stop") + F.lit(float(post))})


def expand(wins: DataFrame, duration: float) -> DataFrame:
    return change(wins, -duration, duration)


def shrink(wins: DataFrame, duration: float) -> DataFrame:
    return change(wins, duration, -duration)


def ms_to_sample(wins: DataFrame, hz: float) -> DataFrame:
    """Edges as sample numbers, rounded half to even."""
    return wins.withColumns({c: F.rint(F.col(c) * F.lit(hz / 1000.0)).cast("long") for c in ("start", "stop", "ref") if c in wins.columns})


def sample_to_ms(wins: DataFrame, hz: float, tstart: float = 0) -> DataFrame:
    return wins.withColumns({c: F.col(c) / F.lit(hz) * 1000.0 + F.lit(float(tstart)) for c in ("start", "stop", "ref") if c in wins.columns})


def round_edges(wins: DataFrame, scale_ms: float, how: str = "round") -> DataFrame:
    """Edges to a time scale: round, floor, ceil, floor_ceil (outwards) or ceil_floor (inwards)."""
    f = {"round": F.rint, "floor": F.floor, "ceil": F.ceil}
    a, b = how.split("_") if "_" in how else (how, how)
    to = lambda c, h: f[h](F.col(c) / F.lit(float(scale_ms))).cast("double") * F.lit(float(scale_ms))
    return wins.withColumns({"start": to("start", a), "stop": to("stop", b)})


def clip(wins: DataFrame, a: float, b: float) -> DataFrame:
    """Both edges moved into [a, b]; a window outside becomes an edge point."""
    into = lambda c: F.least(F.greatest(F.col(c), F.lit(float(a))), F.lit(float(b)))
    return wins.withColumns({"start": into("start"), "stop": into("stop")})


def subtract(wins: DataFrame, a: float, b: float) -> DataFrame:
    """What is left of each window before and after [a, b]."""
    rest = [c for c in wins.columns if c not in ("start", "stop")]
    parts = F.array(F.struct(F.col("start"), F.least("stop", F.lit(float(a))).alias("stop")), F.struct(F.greatest("start", F.lit(float(b))).alias("start"), F.col("stop")))
    return wins.select(*rest, F.inline(parts)).where("stop > start")


def grid(wins: DataFrame, step: float, inclusive: bool = True) -> DataFrame:
    """Times from start, a step apart; the stop belongs to the grid if `inclusive`."""
    n = F.floor((F.col("stop") - F.col("start")) / F.lit(float(step)) + F.lit(0.5 if inclusive else 0.0)) if inclusive else F.ceil((F.col("stop") - F.col("start")) / F.lit(float(step))) - 1
    return wins.where(n >= 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long")))).withColumn("time", F.col("start") + F.col("i") * F.lit(float(step)))


def crop_signal(samples: DataFrame, wins: DataFrame, time: str = "time", by: Sequence[str] = (), reset: str | None = "ref") -> DataFrame:
    """The samples inside each window, edges included, re-referenced to its ref."""
    hit = range_join(samples, wins, time=time, by=by, closed="both")
    return hit.withColumn(time, F.col(time) - relative(reset)) if reset else hit


def transitions(values: DataFrame, order: str, value: str, period: float, by: Sequence[str] = ()) -> DataFrame:
    """A window from the last sample of one state to the first of the next, where the value changes or the time leaps."""
    w = Window.partitionBy(*_keys(by)).orderBy(order)
    nxt = values.select(*by, F.col(order).cast("double").alias("start"), F.lead(order).over(w).cast("double").alias("stop"), F.col(value).alias("start_state"), F.lead(value).over(w).alias("stop_state"))
    leap = F.abs(F.col("stop") - F.col("start") - period) > 1e-8 + 1e-5 * abs(period)
    return nxt.where(F.col("stop").isNotNull() & (leap | ~F.col("start_state").eqNullSafe(F.col("stop_state")))).withColumn("ref", (F.col("start") + F.col("stop")) / 2)


def sel_length_between(wins: DataFrame, lo: float = float("-inf"), hi: float = float("inf")) -> DataFrame:
    """A closed range of lengths."""
    return wins.where(F.expr(LENGTH).between(lo, hi))


def contain(wins: DataFrame, times: DataFrame, time: str = "time", by: Sequence[str] = (), how: str = "any") -> DataFrame:
    """The distinct times and `contained`: whether any (or all) windows of the series hold them, edges included."""
    at = times.select(*by, time).distinct()
    held = range_join(at, wins.select(*by, "start", "stop"), time=time, by=by, closed="both").groupBy(*by, time).agg(F.count("*").alias("__n"))
    out = at.join(held, [*by, time], "left").fillna({"__n": 0})
    if how == "any":
        return out.select(*by, time, (F.col("__n") > 0).alias("contained"))
    sizes = wins.groupBy(*by).agg(F.count("*").alias("__all"))
    out = out.join(sizes, list(by), "left") if by else out.crossJoin(F.broadcast(sizes))  # one row
    return out.select(*by, time, (F.col("__n") == F.coalesce("__all", F.lit(0))).alias("contained"))


def contained_in(wins: DataFrame, a: float, b: float, fully: bool = True) -> DataFrame:
    """`contained`: whether a window lies in [a, b], or with fully=False meets it."""
    inside = F.col("start").between(a, b) & F.col("stop").between(a, b)
    return wins.withColumn("contained", inside if fully else (F.col("stop") > a) & (F.col("start") < b))


def gaps_between(wins: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The gaps of each series with columns of the windows before and after it, as prev_ and next_."""
    merged = invert(wins, by)
    before_it = wins.select(*by, F.col("stop").alias("start"), *[F.col(c).alias(f"prev_{c}") for c in keep], F.struct("start", *keep).alias("__s"))
    last = before_it.groupBy(*by, "start").agg(*[F.max_by(f"prev_{c}", "__s").alias(f"prev_{c}") for c in keep])
    after_it = wins.select(*by, F.col("start").alias("stop"), *[F.col(c).alias(f"next_{c}") for c in keep], F.struct("stop", *keep).alias("__s"))
    first = after_it.groupBy(*by, "stop").agg(*[F.min_by(f"next_{c}", "__s").alias(f"next_{c}") for c in keep])
    return merged.join(last, [*by, "start"], "left").join(first, [*by, "stop"], "left").select(*by, "start", "stop", *[f"{p}_{c}" for c in keep for p in ("prev", "next")])


def merge_overlap_by(wins: DataFrame, by: Sequence[str] = (), same_cat: bool = False, cat: str = "cat") -> DataFrame:
    """The union over time with the metadata of the earliest window; with `same_cat` only windows of one category merge."""
    keys = [*by, cat] if same_cat else list(by)
    w = series(keys)
    upto = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > upto, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    meta = [c for c in wins.columns if c not in (*keys, "start", "stop")]
    first = F.struct("start", "stop", *[c for c in meta if c == "win_idx"])
    got = wins.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *[F.min_by(c, first).alias(c) for c in meta])
    return got.drop("__i")


def relative_to_ref(wins: DataFrame) -> DataFrame:
    """Edges from the reference, which becomes zero."""
    return wins.withColumns({"start": F.col("start") - F.col("ref"), "stop": F.col("stop") - F.col("ref"), "ref": F.lit(0.0)})


def describe(wins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a series: how many windows, their total, shortest, median and longest length, and their hull."""
    n = F.expr(LENGTH)
    return wins.groupBy(*by).agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.min(n).alias("shortest"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("longest"), F.min("start").alias("first"), F.max("stop").alias("last"))


def defrag_samples(wins: DataFrame, samples: DataFrame, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Samples on the axis where gaps are closed; those at a window's stop go with the next one."""
    return defrag_events(wins, samples, time, by)
