"""Predicates and selections over named columns: equality, closed ranges and membership, combined by all or any."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _combined(parts: list[Column], how: str, invert: bool) -> Column:
    if how not in ("all", "any"):
        raise ValueError("how is all or any")
    whole = functools.reduce(operator.and_ if how == "all" else operator.or_, parts) if parts else F.lit(how == "all")
    whole = F.coalesce(whole, F.lit(False))
    return ~whole if invert else whole


def is_match(*, how: str = "all", invert: bool = False, **values) -> Column:
    """Columns equal to values; None or NaN asks for a missing one."""
    missing = lambda v: v is None or isinstance(v, float) and math.isnan(v)
    return _combined([F.coalesce(F.col(c).isNull() if missing(v) else F.col(c) == F.lit(v), F.lit(False)) for c, v in values.items()], how, invert)


def is_between(*, how: str = "all", invert: bool = False, **ranges) -> Column:
    """Columns within closed ranges."""
    return _combined([F.coalesce(F.col(c).between(lo, hi), F.lit(False)) for c, (lo, hi) in ranges.items()], how, invert)


def is_in(*, how: str = "all", invert: bool = False, **values) -> Column:
    return _combined([F.coalesce(F.col(c).isin(list(v)), F.lit(False)) for c, v in values.items()], how, invert)


def sel_match(df: DataFrame, *, how: str = "all", invert: bool = False, drop: bool = False, **values) -> DataFrame:
    out = df.where(is_match(how=how, invert=invert, **values))
    return out.drop(*values) if drop else out


def sel_between(df: DataFrame, *, how: str = "all", invert: bool = False, **ranges) -> DataFrame:
    return df.where(is_between(how=how, invert=invert, **ranges))


def sel_in(df: DataFrame, *, how: str = "all", invert: bool = False, **values) -> DataFrame:
    return df.where(is_in(how=how, invert=invert, **values))


def sel_rows(df: DataFrame, rows: DataFrame, on: str, invert: bool = False) -> DataFrame:
    """Rows whose id is (not) among those of another table; the ids aren't collected."""
    return df.join(rows.select(on).distinct(), on, "left_anti" if invert else "left_semi")


def natural_match(left: DataFrame, right: DataFrame, *, left_ref: str, right_ref: str, how: str = "inner", on: Sequence[str] | None = None, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """Two registries joined on all columns they share, or `on`, with both ids under new names."""
    keys = list(on) if on else [c for c in left.columns if c in right.columns and c not in (left_id, right_id)]
    a, b = left.withColumnRenamed(left_id, left_ref), right.withColumnRenamed(right_id, right_ref)
    more = [c for c in b.columns if c not in keys and c in a.columns]
    for c in more:
        b = b.withColumnRenamed(c, f"{c}_right")
    return a.join(b, keys, how)


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("count"))


def sort_values(df: DataFrame, *cols: str, ascending: bool = True) -> DataFrame:
    """Sorted with missing values last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in cols))


def sample_rows(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))
