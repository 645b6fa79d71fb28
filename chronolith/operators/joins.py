"""Range, overlap and as-of joins as equi-joins on time buckets, so that no plan has a nested loop over two large sides.

A point has one bucket and an interval all it touches; pairs meet in a bucket and the exact predicate decides. The buckets'
width is the intervals' median length. Intervals much longer than that would touch very many, so they are dealt to buckets
of a higher level, each level's FACTOR times as wide as the one below; points are dealt to as many levels as there are. The
median and the number of levels are one row, computed with the join and not before it. An overlapping
pair is kept only in the bucket where its later start lies, so it comes out once. `by` columns join the bucket as keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, LEVEL, UNIT, TOP = "__bucket", "__level", "__unit", "__top"
#: Buckets that an interval touches at most on its level, but for one, and how much wider each level's buckets are.
SPREAD, FACTOR = 16, 64


def _length(start: str, stop: str) -> Column:
    return F.when(F.col(stop) >= F.col(start), (F.col(stop) - F.col(start)).cast("double"))


def _sizes(lengths: DataFrame) -> DataFrame:
    """One row of a one-column table of lengths: `h`, how many have each power of two as their size, sorted, `total` and `longest`.

    Counts and a maximum come out the same whatever the order of rows, and so does all that follows from them: both sides of a join must
    agree on the buckets even if each computes them for itself.
    """
    n = F.col("__n")
    power = F.floor(F.log2(F.greatest(n, F.lit(2.0**-20)))).cast("int")
    each = lengths.toDF("__n").where(n.isNotNull()).groupBy(power.alias("p")).agg(F.count("*").alias("k"), F.max(n).alias("b"))
    return each.agg(F.array_sort(F.collect_list(F.struct("p", "k"))).alias("h"), F.coalesce(F.sum("k"), F.lit(0)).alias("total"), F.coalesce(F.max("b"), F.lit(0.0)).alias("longest"))


#: The power of two of the median length, and the mean length by powers of two, from above.
MEDIAN = "pow(2D, aggregate(h, named_struct('seen', 0L, 'p', -20), (s, x) -> named_struct('seen', s.seen + x.k, 'p', CASE WHEN 2 * s.seen < total THEN x.p ELSE s.p END), s -> s.p))"
MEAN = "CASE WHEN total > 0 THEN aggregate(h, 0D, (s, x) -> s + x.k * pow(2D, x.p + 1)) / total ELSE 0D END"


def _scale(lengths: DataFrame) -> DataFrame:
    """One row: the unit of the buckets' width, and the highest level, which is 3 at most."""
    unit = F.greatest(F.expr(MEDIAN), F.col("longest") / F.lit(float(SPREAD * FACTOR**3)))
    got = _sizes(lengths).select(unit.alias(UNIT), "longest")
    return got.select(UNIT, F.greatest(F.lit(0), F.ceil(F.log(F.greatest("longest", F.lit(1e-9)) / (F.col(UNIT) * SPREAD)) / F.log(F.lit(float(FACTOR))))).cast("int").alias(TOP))


def _scaled(df: DataFrame, scale: DataFrame | float) -> DataFrame:
    if isinstance(scale, DataFrame):
        return df.crossJoin(F.broadcast(scale))  # one row
    return df.withColumns({UNIT: F.lit(float(scale)), TOP: F.lit(0)})


def _width(level: Column | str = LEVEL) -> Column:
    return F.col(UNIT) * F.pow(F.lit(float(FACTOR)), level)


def _level(start: str, stop: str) -> Column:
    """The lowest level on which an interval touches few buckets."""
    n = F.greatest((F.col(stop) - F.col(start)).cast("double"), F.lit(1e-9)) / (F.col(UNIT) * SPREAD)
    return F.least(F.col(TOP), F.greatest(F.lit(0), F.ceil(F.log(n) / F.log(F.lit(float(FACTOR)))).cast("int")))


def _touched(start: Column, stop: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / _width()), F.floor(stop / _width())))


def _renamed(df: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") if c in by else F.col(c) for c in df.columns])


def range_join(points: DataFrame, wins: DataFrame, *, time: str, start: str = "start", stop: str = "stop", by: Sequence[str] = (), closed: str = "left", how: str = "inner", width: float | None = None) -> DataFrame:
    """Points with the intervals that hold them. closed: left [start, stop), right (start, stop], both [start, stop].

    Columns other than `by` must have different names on the two sides. A left join keeps points that no interval holds; it has one level of
    buckets, so wide that all intervals together touch no more than a few times their number.
    """
    by = list(by)
    t, a, b = F.col(time), F.col(start), F.col(stop)
    inside = {"left": (t >= a) & (t < b), "right": (t > a) & (t <= b), "both": (t >= a) & (t <= b)}[closed]
    wins = wins.where(a.isNotNull() & b.isNotNull() & (b >= a))
    if how == "inner":
        scale = width or _scale(wins.select(_length(start, stop)))
        p = _scaled(points, scale).withColumn(LEVEL, F.explode(F.sequence(F.lit(0), F.col(TOP))))
        w = _scaled(wins, scale).withColumn(LEVEL, _level(start, stop))
    else:
        scale = width or _sizes(wins.select(_length(start, stop))).select(F.greatest(F.expr(MEDIAN), F.expr(MEAN) / 4).alias(UNIT), F.lit(0).alias(TOP))
        p, w = (_scaled(x, scale).withColumn(LEVEL, F.lit(0)) for x in (points, wins))
    p = p.withColumn(BUCKET, F.floor(t / _width())).drop(UNIT, TOP)
    w = w.withColumn(BUCKET, _touched(a, b)).drop(UNIT, TOP)
    keys = [*by, LEVEL, BUCKET]
    w = _renamed(w, keys, "__w_")
    on = inside
    for c in keys:
        on &= F.col(c) == F.col(f"__w_{c}")
    return p.join(w, on, how).drop(LEVEL, BUCKET, *(f"__w_{c}" for c in keys))


def overlap_join(left: DataFrame, right: DataFrame, *, by: Sequence[str] = (), right_prefix: str = "other_", width: float | None = None, touching: bool = False) -> DataFrame:
    """Pairs of overlapping intervals; columns of the right side get a prefix. Touching edges don't overlap unless asked for.

    A pair meets on the higher one of its levels, so that each interval is dealt to its own level and those above.
    """
    by = list(by)
    n = _length("start", "stop")
    scale = width or _scale(left.select(n).union(right.select(n)))
    a, b = F.col("start"), F.col("stop")

    def dealt(df: DataFrame) -> DataFrame:
        own = _scaled(df.where(a.isNotNull() & b.isNotNull() & (b >= a)), scale).withColumn("__own", _level("start", "stop"))
        return own.withColumn(LEVEL, F.explode(F.sequence(F.col("__own"), F.col(TOP)))).withColumn(BUCKET, _touched(a, b))

    l, r = dealt(left), dealt(right).drop(UNIT, TOP)  # noqa: E741
    r = r.select(*[F.col(c).alias(f"{right_prefix}{c}") for c in r.columns])
    c, d = F.col(f"{right_prefix}start"), F.col(f"{right_prefix}stop")
    meets = (b >= c) & (d >= a) if touching else (b > c) & (d > a)
    on = meets & (F.col(LEVEL) == F.greatest(F.col("__own"), F.col(f"{right_prefix}__own"))) & (F.col(BUCKET) == F.floor(F.greatest(a, c) / _width()))
    keys = [*by, LEVEL, BUCKET]
    for k in keys:
        on &= F.col(k) == F.col(f"{right_prefix}{k}")
    return l.join(r, on).drop(UNIT, TOP, "__own", f"{right_prefix}__own", LEVEL, BUCKET, *(f"{right_prefix}{k}" for k in keys))


def neighbours(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right sample at or before it (t0, v0) and the first at or after it (t1, v1): one union, one sort."""
    by = list(by)
    cols = [c for c in left.columns if c not in by]
    l = left.select(*by, F.struct(*cols).alias("__row"), F.col(left_time).cast("double").alias("__t"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__g"))  # noqa: E741
    r = right.where(F.col(value).isNotNull() & F.col(right_time).isNotNull())
    r = r.select(*by, F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(right_time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__g"))
    both = l.unionByName(r)
    sample = F.when(F.col("__g") == 0, F.struct("__t", "__v"))
    keys = [F.col(c) for c in by] or [F.lit(0)]
    back = Window.partitionBy(*keys).orderBy("__t", "__g").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("__t"), "__g").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__p", F.last(sample, ignorenulls=True).over(back)).withColumn("__n", F.last(sample, ignorenulls=True).over(ahead))
    rows = found.where("__g = 1")
    return rows.select(*by, *[F.col(f"__row.{c}").alias(c) for c in cols], F.col("__p.__t").alias("t0"), F.col("__p.__v").alias("v0"), F.col("__n.__t").alias("t1"), F.col("__n.__v").alias("v1"))


def asof(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, value: str, by: Sequence[str] = (), direction: str = "backward", name: str = "value") -> DataFrame:
    """The value of the last (backward), next (forward) or nearest sample; of two equally near ones the earlier."""
    n = neighbours(left, right, left_time=left_time, right_time=right_time, value=value, by=by)
    t = F.col(left_time)
    nearest = F.when(F.col("t1").isNull() | (t - F.col("t0") <= F.col("t1") - t), F.col("v0")).otherwise(F.col("v1"))
    chosen = {"backward": F.col("v0"), "forward": F.col("v1"), "nearest": nearest}[direction]
    return n.withColumn(name, chosen).drop("t0", "v0", "t1", "v1")


def interpolate_at(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, value: str, by: Sequence[str] = (), clamp: bool = False, name: str = "value") -> DataFrame:
    """Linear interpolation of samples at the left rows' times; null outside the samples, or the edge value with `clamp`."""
    n = neighbours(left, right, left_time=left_time, right_time=right_time, value=value, by=by)
    t, t0, v0, t1, v1 = (F.col(c) for c in (left_time, "t0", "v0", "t1", "v1"))
    line = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * F.try_divide(t - t0, t1 - t0))
    out = F.coalesce(line, v0, v1) if clamp else line
    return n.withColumn(name, out).drop("t0", "v0", "t1", "v1")
