"""Recording formats as Spark data sources.

A recording is a long table (i, channel, value): sample number, channel and value, in microvolts where the format has a gain. Sources are
read in ranges of samples, one partition each, and take filters on `i` and `channel` as the ranges and channels that they read at all.
Files lie on a file system that all executors mount, since samples are read at byte offsets.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Samples of all channels in a partition.
CHUNK = 1 << 20
#: Fixed values of the Neuralynx formats.
HEADER_BYTES = 16 * 1024
NCS_SAMPLES = 512
NCS_RECORD = np.dtype([("timestamp", "<u8"), ("channel", "<u4"), ("freq", "<u4"), ("valid", "<u4"), ("samples", "<i2", NCS_SAMPLES)])
NEV_RECORD = np.dtype([("stx", "<i2"), ("pkt_id", "<i2"), ("pkt_data_size", "<i2"), ("timestamp", "<u8"), ("event_id", "<i2"), ("ttl", "<i2"), ("crc", "<i2"), ("dummy1", "<i2"), ("dummy2", "<i2"), ("extra", "<i4", 8), ("text", "S128")])


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class _Bounds:
    """The range of samples and the channels that pushed filters leave."""

    def __init__(self):
        self.low, self.high, self.channels = 0, None, None

    def take(self, f) -> bool:
        column = f.attribute if hasattr(f, "attribute") else None
        if column == ("i",):
            v = getattr(f, "value", None)
            if isinstance(f, EqualTo):
                self.low, self.high = max(self.low, v), v + 1 if self.high is None else min(self.high, v + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, v + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                top = v + isinstance(f, LessThanOrEqual)
                self.high = top if self.high is None else min(self.high, top)
            else:
                return False
            return True
        if column == ("channel",) and isinstance(f, (EqualTo, In)):
            own = set(f.value if isinstance(f, In) else [f.value])
            self.channels = own if self.channels is None else self.channels & own
            return True
        return False

    def ranges(self, n: int, chunk: int) -> list[Range]:
        top = n if self.high is None else min(n, self.high)
        return [Range(a, min(top, a + chunk)) for a in range(max(0, self.low), top, chunk)]


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.bounds = options, _Bounds()

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if not self.bounds.take(f):
                yield f


def _long_batches(block: np.ndarray, start: int, channels: Sequence[int], stride: int = 1) -> Iterator[pa.RecordBatch]:
    """A (samples, channels) block as rows, a bounded number at a time."""
    step = max(1, (1 << 16) // max(1, block.shape[1]))
    for a in range(0, len(block), step):
        part = block[a : a + step]
        i = np.repeat(np.arange(start + a * stride, start + (a + len(part)) * stride, stride, dtype=np.int64), part.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(np.asarray(channels, np.int32), len(part))), pa.array(part.ravel().astype(np.float64))], ["i", "channel", "value"])


class InterleavedSource(DataSource):
    """int16 samples, channel by channel within each sample. Options: path, n_channels, gains (JSON list of microvolts a bit), offset, stride, chunk."""

    @classmethod
    def name(cls) -> str:
        return "interleaved_int16"

    def schema(self) -> str:
        return "i long, channel int, value double"

    def reader(self, schema):
        return InterleavedReader(self.options)


class InterleavedReader(_RangeReader):
    def _shape(self) -> tuple[str, int, int]:
        path, n = self.options["path"], int(self.options["n_channels"])
        return path, n, os.path.getsize(path) // (2 * n)

    def partitions(self):
        _, n, samples = self._shape()
        return self.bounds.ranges(samples, max(1, int(self.options.get("chunk", CHUNK)) // n)) or [Range(0, 0)]

    def read(self, part: Range):
        path, n, _ = self._shape()
        stride = int(self.options.get("stride", 1))
        gains = np.array(json.loads(self.options.get("gains", "null")) or [1.0] * n)
        own = [c for c in range(n) if self.bounds.channels is None or c in self.bounds.channels]
        start = -(-part.start // stride) * stride
        if not own or start >= part.stop:
            return
        data = np.memmap(path, "<i2", "r", shape=(os.path.getsize(path) // (2 * n), n))
        yield from _long_batches(data[start : part.stop : stride, own] * gains[own], start, own, stride)


def neuralynx_header(path: str) -> dict[str, str]:
    """The text header: -Key value lines."""
    with open(path, "rb") as f:
        text = f.read(HEADER_BYTES).rstrip(b"\0").decode("iso-8859-1")
    return {m[1]: m[2].strip().strip('"') for m in re.finditer(r"^\s*-(\S+)[ \t]*(.*?)\s*$", text, re.M)}


def _records(path: str, kind: np.dtype) -> np.memmap:
    size = os.path.getsize(path) - HEADER_BYTES
    if size % kind.itemsize:
        raise ValueError(f"{path} doesn't hold whole records")
    return np.memmap(path, kind, "r", offset=HEADER_BYTES, shape=(size // kind.itemsize,))


class NeuralynxContinuous(DataSource):
    """.ncs: records of 512 samples. With `uneven` (the default) each record's own count of valid samples is read, else all but the last are whole."""

    @classmethod
    def name(cls) -> str:
        return "neuralynx_ncs"

    def schema(self) -> str:
        return "i long, channel int, value double, timestamp_us double"

    def reader(self, schema):
        return NeuralynxContinuousReader(self.options)


class NeuralynxContinuousReader(_RangeReader):
    def _valid(self) -> np.ndarray:
        return np.r_[0, np.cumsum(_records(self.options["path"], NCS_RECORD)["valid"].astype(np.int64))]

    def partitions(self):
        return self.bounds.ranges(int(self._valid()[-1]), int(self.options.get("chunk", CHUNK))) or [Range(0, 0)]

    def read(self, part: Range):
        path = self.options["path"]
        records, ends = _records(path, NCS_RECORD), self._valid()
        microvolts = float(neuralynx_header(path).get("ADBitVolts", "1e-6").split()[0]) * 1e6
        first, last = np.searchsorted(ends, [part.start, part.stop], side="right") - 1
        for k in range(int(first), min(int(last) + 1, len(records))):
            r = records[k]
            a, b = max(part.start, int(ends[k])), min(part.stop, int(ends[k + 1]))
            if a >= b or self.bounds.channels is not None and int(r["channel"]) not in self.bounds.channels:
                continue
            at = np.arange(a - int(ends[k]), b - int(ends[k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(np.full(b - a, r["channel"], np.int32)), pa.array(r["samples"][at] * microvolts), pa.array(float(r["timestamp"]) + at * 1e6 / max(1, int(r["freq"])))], ["i", "channel", "value", "timestamp_us"])


class NeuralynxEvents(DataSource):
    """.nev: one row an event record."""

    @classmethod
    def name(cls) -> str:
        return "neuralynx_nev"

    def schema(self) -> str:
        return "timestamp_us long, event_id int, ttl int, text string"

    def reader(self, schema):
        return NeuralynxEventsReader(self.options)


class NeuralynxEventsReader(_RangeReader):
    def partitions(self):
        return self.bounds.ranges(len(_records(self.options["path"], NEV_RECORD)), 1 << 16) or [Range(0, 0)]

    def read(self, part: Range):
        r = _records(self.options["path"], NEV_RECORD)[part.start : part.stop]
        text = [x.split(b"\0")[0].decode("iso-8859-1") for x in r["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(r["timestamp"].astype(np.int64)), pa.array(r["event_id"].astype(np.int32)), pa.array(r["ttl"].astype(np.int32)), pa.array(text, pa.string())], ["timestamp_us", "event_id", "ttl", "text"])


class NpyColumns(DataSource):
    """Arrays of one length as columns. Options: paths (JSON {column: file}); all columns are doubles, with their position i."""

    @classmethod
    def name(cls) -> str:
        return "npy_columns"

    def schema(self) -> str:
        return "i long, " + ", ".join(f"{c} double" for c in json.loads(self.options["paths"]))

    def reader(self, schema):
        return NpyReader(self.options)


class NpyReader(_RangeReader):
    def _arrays(self) -> dict[str, np.ndarray]:
        return {c: np.load(p, mmap_mode="r").reshape(-1) for c, p in json.loads(self.options["paths"]).items()}

    def partitions(self):
        sizes = {len(a) for a in self._arrays().values()}
        if len(sizes) != 1:
            raise ValueError("the arrays aren't of one length")
        return self.bounds.ranges(sizes.pop(), int(self.options.get("chunk", CHUNK))) or [Range(0, 0)]

    def read(self, part: Range):
        cols = [pa.array(np.asarray(a[part.start : part.stop], np.float64)) for a in self._arrays().values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.start, part.stop)), *cols], ["i", *json.loads(self.options["paths"])])


def register_sources(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (InterleavedSource, NeuralynxContinuous, NeuralynxEvents, NpyColumns):
        spark.dataSource.register(source)


# --- metadata -----------------------------------------------------------------------------------------------------


@dataclass
class SpikeGlxMeta:
    """What a .meta file says of its .bin: channels saved, rate, microvolts a bit of each saved channel (0 for the sync channel)."""

    raw: dict[str, str]

    @classmethod
    def read(cls, path: str) -> SpikeGlxMeta:
        with open(path) as f:
            return cls(dict(line.strip().lstrip("~").split("=", 1) for line in f if "=" in line))

    @property
    def prefix(self) -> str:
        return "im" if self.raw.get("typeThis", "imec") == "imec" else "ni"

    @property
    def n_channels(self) -> int:
        return int(self.raw["nSavedChans"])

    @property
    def n_samples(self) -> int:
        return int(self.raw["fileSizeBytes"]) // (2 * self.n_channels)

    @property
    def rate(self) -> float:
        return float(self.raw[f"{self.prefix}SampRate"])

    @property
    def channel_ids(self) -> list[int]:
        saved = self.raw.get("snsSaveChanSubset", "all")
        if saved == "all":
            return list(range(self.n_channels))
        return [i for part in saved.split(",") for i in (range(int(part.split(":")[0]), int(part.split(":")[-1]) + 1))]

    @property
    def microvolts(self) -> list[float]:
        """By position among the saved channels."""
        volts = float(self.raw[f"{self.prefix}AiRangeMax"]) / int(self.raw.get("imMaxInt", 512) if self.prefix == "im" else self.raw.get("niMaxInt", 32768))
        if self.prefix == "ni":
            return [volts * 1e6 / float(self.raw.get("niMNGain", 1) or 1)] * self.n_channels
        rows = [e.split() for e in re.findall(r"\(([^()]*)\)", self.raw.get("imroTbl", ""))[1:]]
        ap = {int(r[0]): float(r[3]) if len(r) > 4 else 80.0 for r in rows}
        lf = {int(r[0]): (float(r[4]) or 1.0) if len(r) > 4 else 1.0 for r in rows}
        n_ap = len(ap)
        out = []
        for c in self.channel_ids:
            gain = ap[c] if c in ap else lf.get(c - n_ap)
            out.append(volts * 1e6 / gain if gain else 0.0)
        return out

    def load(self, spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
        own = {"path": path, "n_channels": str(self.n_channels), "gains": json.dumps(self.microvolts), "stride": str(stride)}
        return spark.read.format("interleaved_int16").options(**own).load()


def load_open_ephys(spark: SparkSession, folder: str, stream: int = 0) -> tuple[DataFrame, float]:
    """A binary recording's continuous stream and its rate, from structure.oebin beside it."""
    with open(os.path.join(folder, "structure.oebin")) as f:
        own = json.load(f)["continuous"][stream]
    gains = [c.get("bit_volts", 1.0) for c in own["channels"]]
    path = os.path.join(folder, "continuous", own["folder_name"], "continuous.dat")
    options = {"path": path, "n_channels": str(own["num_channels"]), "gains": json.dumps(gains)}
    return spark.read.format("interleaved_int16").options(**options).load(), float(own["sample_rate"])


def load_interpolated(spark: SparkSession, meta_path: str, bin_path: str) -> DataFrame:
    """A re-clocked recording: JSON with its channels (and gains), and interleaved samples."""
    with open(meta_path) as f:
        meta = json.load(f)
    n = len(meta.get("all_channel_ids") or meta["valid_channels"])
    return spark.read.format("interleaved_int16").options(path=bin_path, n_channels=str(n), gains=json.dumps(meta.get("microvolts"))).load()


def union_probes(parts: dict[str, DataFrame]) -> DataFrame:
    """Several probes as one recording: global channel ids, dense over (probe, channel)."""
    from pyspark.sql import Window

    import functools

    both = functools.reduce(DataFrame.unionByName, [df.withColumn("probe", F.lit(p)) for p, df in parts.items()])
    ids = both.select("probe", "channel").distinct().withColumn("global_channel", F.row_number().over(Window.orderBy("probe", "channel")) - 1)
    return both.join(ids, ["probe", "channel"])


def load_windows(samples: DataFrame, wins: DataFrame, rate: float, load_hz: float | None = None, channels: Sequence[int] | None = None, key: str = "win_idx") -> DataFrame:
    """The samples (channel, i, value) of each window, every stride-th from the window's first, times from its reference.

    Only the channels and the sample range that the windows span are read: both are filters on the source.
    """
    from ..functions.timeunits import SamplingRate
    from ..operators.joins import range_join

    clock = SamplingRate(rate)
    stride = clock.stride(load_hz) if load_hz else 1
    own = wins.select(key, clock.ms_to_idcs("start").alias("__a"), clock.ms_to_idcs("stop").alias("__b"), F.col("ref").alias("__ref"))
    some = samples.where(F.col("channel").isin(list(channels))) if channels is not None else samples
    cut = range_join(some, own, time="i", start="__a", stop="__b").where(F.pmod(F.col("i") - F.col("__a"), F.lit(stride)) == 0)
    return cut.select(key, "channel", (clock.idcs_to_ms("i") - F.col("__ref")).alias("time"), "value")


def joint_recording(headers: DataFrame, by: Sequence[str], tolerance_s: float = 1.0) -> DataFrame:
    """Files (by, n_samples, rate, first_stamp in microseconds, opened as a timestamp) as one recording: as many samples as all have,
    the earliest stamp, and `agrees`: whether their rates are one and they were opened within the tolerance."""
    opened = F.max(F.unix_micros(F.col("opened").cast("timestamp"))) - F.min(F.unix_micros(F.col("opened").cast("timestamp")))
    agrees = (F.min("rate") == F.max("rate")) & (opened <= F.lit(tolerance_s * 1e6))
    return headers.groupBy(*by).agg(F.count("*").alias("files"), F.min("n_samples").alias("n_samples"), F.min("first_stamp").alias("first_stamp"), F.first("rate").alias("rate"), agrees.alias("agrees"))


# --- tables -------------------------------------------------------------------------------------------------------


def load_kilosort(spark: SparkSession, folder: str, rate: float) -> tuple[DataFrame, DataFrame]:
    """Spikes (event_id, unit_id, ref_time in ms) and units, from sorter output; unit tables are joined outer on their id."""
    at = lambda name: os.path.join(folder, name)
    paths = {"t": at("spike_times.npy"), "unit": at("spike_clusters.npy")} | ({"amplitude": at("amplitudes.npy")} if os.path.exists(at("amplitudes.npy")) else {})
    raw = spark.read.format("npy_columns").option("paths", json.dumps(paths)).load()
    more = ["amplitude"] if "amplitude" in paths else []
    spikes = raw.select(F.col("i").alias("event_id"), F.col("unit").cast("long").alias("unit_id"), (F.col("t") / rate * 1000.0).alias("ref_time"), *more)
    units = spikes.select("unit_id").distinct()
    for name in ("cluster_group.tsv", "cluster_KSLabel.tsv", "cluster_info.tsv"):
        if os.path.exists(at(name)):
            table = spark.read.csv(at(name), sep="\t", header=True)
            key = "cluster_id" if "cluster_id" in table.columns else "id"
            table = table.withColumnRenamed(key, "unit_id").withColumn("unit_id", F.col("unit_id").cast("long"))
            for c in table.columns:
                if c != "unit_id" and c in units.columns:
                    table = table.withColumnRenamed(c, f"{c}_ks")
            units = units.join(table, "unit_id", "full")
    return spikes, units


def load_jrclust(spark: SparkSession, path: str, factor: float = 1.0) -> DataFrame:
    """Spikes from csv: time in s, cluster, site. Clusters that aren't above zero go."""
    raw = spark.read.csv(path, schema="t double, unit_id long, best_site long")
    return raw.where("unit_id > 0").select("unit_id", (F.col("t") * 1000.0 * factor).alias("ref_time"), "best_site")


def load_tracking(spark: SparkSession, path: str, rate: float = 50.0) -> DataFrame:
    """Tracked points from csv with three header rows (scorer, part, coordinate) as rows: frame, time, part, x, y, likelihood."""
    head = [r[0].split(",") for r in spark.read.text(path).limit(3).collect()]
    names = [f"{p}|{c}" for p, c in zip(head[1][1:], head[2][1:], strict=True)]
    schema = ", ".join(["frame double", *(f"`{n}` double" for n in names)])
    raw = spark.read.csv(path, schema=schema, mode="DROPMALFORMED").where("frame IS NOT NULL")
    parts = list(dict.fromkeys(n.split("|")[0] for n in names))
    each = F.array(*[F.struct(F.lit(p).alias("part"), *[F.col(f"`{p}|{c}`").alias(c) for c in ("x", "y", "likelihood")]) for p in parts])
    return raw.select(F.col("frame").cast("long").alias("frame"), (F.col("frame") / rate * 1000.0).alias("time"), F.inline(each))


def load_registry(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A catalog of experiments from csv, parquet or (where the reader for it is installed) a spreadsheet; rows without a name go."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        table = spark.createDataFrame(pd.read_excel(path, sheet_name=sheet or 0).astype(str))
    else:
        table = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return table.where(F.col("exp_name").isNotNull() & (F.col("exp_name") != ""))


# --- sinks --------------------------------------------------------------------------------------------------------


def store(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A table for later reads, laid out by its keys so that they prune."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_interleaved(samples: DataFrame, path: str, n_channels: int, n_samples: int, microvolts: float, chunk: int = 1 << 16) -> int:
    """Writes (i, channel, value) as interleaved int16, each chunk of samples at its own place; gives the number of samples.

    Executors make the chunks' bytes, and the driver, which alone opens the file, takes one of their partitions after the other.
    """

    def block(pdf):
        import pandas as pd

        a, b = int(pdf["i"].min()), int(pdf["i"].max()) + 1
        rows = np.zeros((b - a, n_channels), np.int16)
        rows[pdf["i"].to_numpy() - a, pdf["channel"].to_numpy()] = np.clip(np.rint(pdf["value"].to_numpy() / microvolts), -32768, 32767)
        return pd.DataFrame({"a": [a], "n": [b - a], "rows": [rows.tobytes()]})

    own = samples.withColumn("__c", F.floor(F.col("i") / chunk)).groupBy("__c").applyInPandas(block, "a long, n long, rows binary")
    total = 0
    with open(path, "wb") as f:
        f.truncate(2 * n_channels * n_samples)
        for r in own.toLocalIterator():
            f.seek(2 * n_channels * r.a)
            f.write(r.rows)
            total += r.n
    return total


def write_spikeglx_meta(path: str, n_channels: int, n_samples: int, rate: float, ai_range: float = 0.6, gain: float = 500.0) -> None:
    rows = "".join(f"({i} 0 0 {gain:g} 250 1)" for i in range(n_channels - 1))
    meta = {"typeThis": "imec", "nSavedChans": n_channels, "fileSizeBytes": 2 * n_channels * n_samples, "imSampRate": rate, "imAiRangeMax": ai_range, "imMaxInt": 512, "snsSaveChanSubset": "all", "imroTbl": f"(0,{n_channels - 1}){rows}"}
    with open(path, "w") as f:
        f.write("".join(f"{k}={v}\n" for k, v in meta.items()))
