"""Keyed collections: a registry of one row a key, and one long table of all entries' rows with the key beside them.

An entry is never a table of its own, so what holds for one holds for all in one plan; `apply` is a group per key.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import range_join
from .numbering import number_rows


@dataclass(frozen=True)
class Keyed:
    reg: DataFrame
    data: DataFrame
    key: str = "key"

    # --- making and taking apart ---

    @classmethod
    def from_parts(cls, parts: dict, key: str = "key") -> Keyed:
        """Tables by name."""
        data = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(key, F.lit(k)) for k, df in parts.items()])
        spark = data.sparkSession
        return cls(spark.createDataFrame([(k,) for k in parts], [key]), data, key)

    @classmethod
    def from_split(cls, df: DataFrame, by: Sequence[str], key: str = "key") -> Keyed:
        """Groups of equal `by`, numbered in their order; the registry keeps what all rows of a group share."""
        groups = number_rows(df.select(*by).distinct(), by, key)
        rest = [c for c in df.columns if c not in by]
        shared = df.groupBy(*by).agg(*[F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.first(c, ignorenulls=True)).alias(c) for c in rest])
        same = functools.reduce(lambda a, c: a & c, [F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in by])
        join = lambda left: left.alias("__l").join(groups.alias("__r"), same).select(*[F.col(f"__l.{c}") for c in left.columns], F.col(f"__r.{key}"))
        return cls(join(shared), join(df), key)

    def flat(self) -> DataFrame:
        """All rows with their key and the registry's columns; a name on both sides comes from the registry."""
        own = [c for c in self.data.columns if c not in self.reg.columns or c == self.key]
        return self.data.select(*own).join(self.reg, self.key)

    def store(self, path: str) -> None:
        """Parquet: the registry, and the rows in a folder for each key."""
        self.reg.write.mode("overwrite").parquet(f"{path}/reg")
        self.data.write.mode("overwrite").partitionBy(self.key).parquet(f"{path}/data")

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "key") -> Keyed:
        return cls(spark.read.parquet(f"{path}/reg"), spark.read.parquet(f"{path}/data"), key)

    # --- selections ---

    def sel(self, condition: Column | str) -> Keyed:
        """Entries by a condition on the registry."""
        own = self.reg.where(condition)
        return Keyed(own, self.data.join(own.select(self.key), self.key, "left_semi"), self.key)

    def get(self, key) -> DataFrame:
        return self.data.where(F.col(self.key) == F.lit(key)).drop(self.key)

    def rekey(self, order: Sequence[str]) -> Keyed:
        """Keys from 0 in the given order of the registry."""
        new = number_rows(self.reg, order, "__new")
        move = lambda df: df.drop(self.key).withColumnRenamed("__new", self.key)
        return Keyed(move(new), move(self.data.join(new.select(self.key, "__new"), self.key)), self.key)

    def simplify(self) -> Keyed:
        """Registry columns that are the same in all rows go."""
        rest = [c for c in self.reg.columns if c != self.key]
        told = self.reg.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in rest]).first() if rest else {}
        return Keyed(self.reg.select(self.key, *[c for c in rest if told[c] > 1]), self.data, self.key)

    # --- functions over entries ---

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Keyed:
        """f over the long table; it must keep the key."""
        return Keyed(self.reg, f(self.data), self.key)

    def apply(self, f, schema: str) -> DataFrame:
        """f(pandas table) of each entry: one group a key, so an entry must fit one task."""
        return self.data.groupBy(self.key).applyInPandas(f, schema)

    def summary(self, **aggs: Column) -> DataFrame:
        """One row an entry: aggregates of its rows beside the registry."""
        return self.reg.join(self.data.groupBy(self.key).agg(*[a.alias(n) for n, a in aggs.items()]), self.key, "left")

    def side_by_side(self, index: str, value: str, keys: Sequence) -> DataFrame:
        """A column for each key: the entries' values by a common index."""
        return self.data.groupBy(index).pivot(self.key, list(keys)).agg(F.first(value))

    def combine(self, other: Keyed, on: Sequence[str], left_ref: str = "left", right_ref: str = "right") -> DataFrame:
        """Pairs of entries whose registries agree: the keys of both sides and the shared columns."""
        a = self.reg.select(F.col(self.key).alias(left_ref), *on)
        return a.join(other.reg.select(F.col(other.key).alias(right_ref), *on), list(on))

    @classmethod
    def concat(cls, parts: dict, outer: str = "outer") -> Keyed:
        """Collections of one kind as one: the key becomes text `outer/key`. Registries must agree in their columns."""
        whole = lambda pick: functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [pick(d).withColumn(outer, F.lit(k)).withColumn(d.key, F.concat(F.lit(f"{k}/"), F.col(d.key).cast("string"))) for k, d in parts.items()])
        key = next(iter(parts.values())).key
        return cls(whole(lambda d: d.reg), whole(lambda d: d.data).drop(outer), key)

    # --- over time ---

    def crop(self, lo: float, hi: float, time: str = "time") -> Keyed:
        return self.map(lambda d: d.where(F.col(time).between(lo, hi)))

    def shift_time(self, shifts: DataFrame | float, time: str = "time") -> Keyed:
        """By a number, or by each key's own (key, shift)."""
        if not isinstance(shifts, DataFrame):
            return self.map(lambda d: d.withColumn(time, F.col(time) + F.lit(float(shifts))))
        own = shifts.select(self.key, F.col("shift").cast("double").alias("__s"))
        return self.map(lambda d: d.join(own, self.key).withColumn(time, F.col(time) + F.col("__s")).drop("__s"))

    def extract(self, wins: DataFrame, time: str = "time", by: Sequence[str] = (), align: str | None = "ref") -> DataFrame:
        """The rows of each entry inside each window (of the same entry if `by` has the key), re-referenced."""
        hit = range_join(self.data, wins, time=time, by=by, closed="both")
        return hit.withColumn(time, F.col(time) - F.col(align)) if align else hit
