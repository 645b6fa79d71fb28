"""Whole recordings to results: power, sharp events and their matches, for what isn't there yet.

A recording is never one task's work: samples come in chunks with margins, and what is asked for is what the results lack.
Results are written a folder for each recording, so that a run adds its own and replaces no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signals as G
from . import waves as V


def still_missing(samples: DataFrame, done: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """The samples of recordings that have no result."""
    return samples if done is None else samples.join(done.select(*key).distinct(), list(key), "left_anti")


def extract_power(samples: DataFrame, bands: dict[str, tuple[float, float]], window_ms: float = 10_000.0, step_ms: float = 1_000.0, rate: float = 1000.0, key: Sequence[str] = ("trace_idx",), chunk_ms: float = 3_600_000.0, origin: float = 0.0, lowest_hz: float = 0.5, done: DataFrame | None = None) -> DataFrame:
    """Power of bands in sliding windows, at their centres."""
    size = G.default_welch_size(window_ms, rate, lowest_hz)
    own = still_missing(samples, done, key)
    return G.band_power_rolling(own, window_ms, step_ms, bands, size, key, chunk_ms, origin).where(F.col("band") != "total")


def extract_events(samples: DataFrame, band: tuple[float, float], rate: float = 1000.0, key: Sequence[str] = ("trace_idx",), chunk_ms: float = 3_600_000.0, reference_ms: float = 3_600_000.0, edge_ms: float = 1000.0, done: DataFrame | None = None) -> DataFrame:
    """Sharp negative events with their null share, and their number within the recording by time."""
    return V.extract_sharp_events(still_missing(samples, done, key), band, reference_ms, chunk_ms, key, rate, edge_ms)


def extract_matches(events: DataFrame, lag: tuple[float, float], by: Sequence[str], max_null: float = 0.05, width: float | None = None, done: DataFrame | None = None, channel: str = "channel") -> DataFrame:
    """Pairs of events of channels 0 and 1 of each recording: within a lag, at least one of them no noise, in order and one to one."""
    own = still_missing(events, done, by).select(*by, channel, "event_id", "ref_time", "score", "null_cdf")
    side = lambda c: own.where(F.col(channel) == c).drop(channel)
    pairs = G.candidate_pairs(side(0), side(1), lag, by, width or max(abs(lag[0]), abs(lag[1])) * 2)
    quiet = own.where(F.col("null_cdf") <= max_null).select(*by, F.col("event_id").alias("__id"))
    sure = lambda c: pairs.join(quiet.withColumnRenamed("__id", c), [*by, c], "left_semi")
    both = sure("event0").unionByName(sure("event1")).distinct()
    return G.match_events(both.withColumn("score", F.col("s0") + F.col("s1")), by)


def write_results(results: DataFrame, path: str, by: str) -> None:
    """A folder for each recording; those of other recordings stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
