"""Queries with their SQL twins. Doubles are rounded alike on both sides (sums of times in ms to four decimals), since sums depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a query by its function's name; `sql` may begin with further tables of the WITH, after a comma."""

    def add(f):
        names = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names}) if names else df

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            more, _, last = sql.rpartition("\nSELECT") if sql.lstrip().startswith(",") else ("", "", sql.strip().removeprefix("SELECT"))
            swap = " REPLACE (" + ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names) + ")" if names else ""
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if 'UNION ALL' in more else ''}{SQL.strip()}{more} SELECT *{swap} FROM (SELECT{last if last.startswith((' ', chr(10))) else ' ' + last}) AS q"
        return f

    return add
