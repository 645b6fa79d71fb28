"""What the training-data operators share: text columns, checkpoints and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders whose files go when the driver's process ends.
_LEFT: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where `spark.checkpoint.dir` names none, a session on one machine takes a
    temporary one, and a cluster is refused: a folder of one machine would be lost to the others."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """What the session left in `path` goes with the driver's process; DataFrames that read it are of use until then."""

    def remove() -> None:
        with contextlib.suppress(Exception):  # the engine may be gone already
            remove_folder(spark, path)

    if path not in _LEFT:
        _LEFT.add(path)
        atexit.register(remove)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through files in the shared folder that the cluster names; they go at the end of the process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    remove_at_exit(spark, context._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_with(df: DataFrame, **more: str) -> T.StructType:
    """The schema of `df` and further columns, given as name and SQL type."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in more.items())])


def hex64(value: Column) -> Column:
    """A long as 16 lowercase hex digits, as if it were unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def text_slices(texts: list, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive (start, stop) ranges whose texts together have about `most` characters; every range has one text or more."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Keys of more than a HOT-th of all rows are sent to all executors; there are fewer than HOT of them.
HOT = 10_000


def join_by_size(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of a table that has one row a key and `n`, how many of the `total` rows have it.

    Rows of frequent keys, of which there can't be more than HOT, meet the table where they are; the others in an exchange.
    """
    bound = total // HOT + 1
    more = [c for c in table.columns if c not in (key, "n")]
    hot = F.broadcast(table.where(F.col("n") > bound).select(key, *[F.col(c).alias(f"{c}_hot") for c in more], F.lit(True).alias("is_hot")))
    met = rows.join(hot, key, "left")
    often = met.where("is_hot").select(*rows.columns, *[F.col(f"{c}_hot").alias(c) for c in more])
    rest = met.where("is_hot IS NULL").select(*rows.columns).join(table.where(F.col("n") <= bound).select(key, *more), key, "left")
    return often.union(rest.select(*rows.columns, *more))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each end of an edge (u, v) the smallest node that it reaches.

    Alternates two star contractions. In the first, each node hands its larger neighbours to the smallest node it
    knows; in the second, its smaller ones. Each is a minimum with map-side combine and an equi-join, so that a node with
    very many edges is met by the adaptive skew join and never gathered. Each round is checkpointed and ends once no
    edge changed. Nulls and loops in `edges` are left out.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    nodes = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = checkpointed(nodes.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = checkpointed(small.union(low.select("u", "low")).toDF("u", "v").distinct())
        if (then := state(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).toDF("node", "component").distinct()
