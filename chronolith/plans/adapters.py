"""The test tables as events, windows and traces, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeunits import HOUR, epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("rec_id"), F.col("event_type").alias("cat"), F.col("value").alias("amplitude"), epoch_ms("ts").alias("ref_time"))


def wship(spark: SparkSession, d: str) -> DataFrame:
    """One window an order, from its first to its last shipping day."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("win_idx"), F.col("o_custkey").alias("rec_id"), F.col("o_orderpriority").alias("cat"), epoch_ms("a").alias("start"), epoch_ms("b").alias("stop"), epoch_ms("o_orderdate").alias("ref"))


def wpurchase(spark: SparkSession, d: str, pre: float = -HOUR, post: float = 6 * HOUR) -> DataFrame:
    """One window around each purchase."""
    t = F.col("ref_time")
    return ev(spark, d).where("cat = 'purchase'").select(F.col("event_id").alias("win_idx"), "rec_id", F.col("cat").alias("wcat"), (t + pre).alias("start"), (t + post).alias("stop"), t.alias("ref"))


def wbetween(spark: SparkSession, d: str) -> DataFrame:
    """One window between each user's consecutive events, with the category of the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id").orderBy("ref_time", "event_id")
    own = ev(spark, d).select(F.col("event_id").alias("win_idx"), "rec_id", "cat", F.col("ref_time").alias("start"), F.lead("ref_time").over(w).alias("stop"), F.col("ref_time").alias("ref"))
    return own.where("stop IS NOT NULL")


def tr(spark: SparkSession, d: str, below: int | None = None) -> DataFrame:
    """Each vector as a trace of 1 ms samples; `below` names the first traces where an operator's pairs are the point."""
    e = table(spark, d, "embeddings")
    e = e.where(F.col("vec_id") < below) if below else e
    return e.select(F.col("vec_id").alias("trace_idx"), F.posexplode("embedding").alias("i", "v")).select("trace_idx", F.col("i").cast("double").alias("time"), F.col("v").cast("double").alias("value"))


def tr_reg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("trace_idx"), F.col("label").cast("long").alias("grp"))


def spikes(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).select("event_id", F.pmod("rec_id", F.lit(16)).cast("long").alias("unit_id"), "ref_time", "cat")


def units(spark: SparkSession, d: str) -> DataFrame:
    """The units that have spikes and one that is silent."""
    own = spikes(spark, d).select("unit_id").distinct()
    return own.union(spark.range(99, 100).toDF("unit_id")).withColumn("probe", F.pmod("unit_id", F.lit(3)))


#: The same in SQL, for use in a WITH.
SQL = """
ev AS (SELECT event_id, user_id AS rec_id, event_type AS cat, value AS amplitude, (epoch_us(ts) - 1704067200000000) / 1000.0 AS ref_time FROM events),
wship AS (SELECT o_orderkey AS win_idx, o_custkey AS rec_id, o_orderpriority AS cat, (epoch_us(a) - 1704067200000000) / 1000.0 AS start,
    (epoch_us(b) - 1704067200000000) / 1000.0 AS stop, (epoch_us(o_orderdate) - 1704067200000000) / 1000.0 AS ref
    FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
wpurchase AS (SELECT event_id AS win_idx, rec_id, cat AS wcat, ref_time - 3600000.0 AS start, ref_time + 21600000.0 AS stop, ref_time AS ref FROM ev WHERE cat = 'purchase'),
wbetween AS (SELECT * FROM (SELECT event_id AS win_idx, rec_id, cat, ref_time AS start, lead(ref_time) OVER (PARTITION BY rec_id ORDER BY ref_time, event_id) AS stop, ref_time AS ref FROM ev) WHERE stop IS NOT NULL),
tr AS (SELECT vec_id AS trace_idx, (i - 1)::DOUBLE AS time, v::DOUBLE AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
tr_reg AS (SELECT vec_id AS trace_idx, label::BIGINT AS grp FROM embeddings),
spikes AS (SELECT event_id, (rec_id % 16)::BIGINT AS unit_id, ref_time, cat FROM ev),
units AS (SELECT unit_id, unit_id % 3 AS probe FROM (SELECT DISTINCT unit_id FROM spikes UNION ALL SELECT 99))
"""
