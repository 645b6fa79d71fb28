"""Consecutive numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stretches of the first order column's range that are numbered side by side.
STRETCHES = 4096


def number_rows(df: DataFrame, order: Sequence[str], name: str, stretches: int = STRETCHES) -> DataFrame:
    """`name`: each row's place from 0 in the given order.

    Rows are dealt by even stretches of the first column's range, numbered within theirs and moved on by the number of
    rows in the stretches before, which is a table of no more rows than there are stretches. A first column that isn't a
    number has no stretches; its table is numbered as one, so that it should be a small one.
    """
    first = order[0]
    if not isinstance(df.schema[first].dataType, T.NumericType):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    x = F.col(first).cast("double")
    ext = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    place = F.coalesce(F.floor(F.try_divide(x - F.col("__lo"), F.col("__hi") - F.col("__lo")) * (stretches - 1)), F.lit(0))
    # missing values come first, as they do in an order
    dealt = df.crossJoin(F.broadcast(ext)).withColumn("__at", F.when(x.isNull(), F.lit(-1)).otherwise(place).cast("long")).drop("__lo", "__hi")  # one row
    counts = dealt.groupBy("__at").agg(F.count("*").alias("__n"))
    before = counts.select("__at", F.coalesce(F.sum("__n").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__at").orderBy(*order)) - 1
    numbered = dealt.withColumn("__own", own).join(F.broadcast(before), "__at")  # as many rows as stretches at most
    return numbered.withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__at", "__own", "__before")
