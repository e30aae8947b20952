"""Recordings: a Python data source for dense interleaved float32 signals, electrode layouts, and the catalogue.

A recording is a folder with signal1.bin (sample-major float32, microvolts) and sensorLayout.xml; a load takes one of
them or a folder of many, of which parts of a night follow one another by suffix and start. The source reads a range of samples a task, by
their index, so that no chunk ever loses its place. Filters on night, suffix, recording, channel, epoch and first_sample
are taken over by the source: recordings, ranges and channels that they leave out are neither planned nor decoded. Files
are read where the path says, by any file system that pyarrow knows; a path without a scheme must be seen by all machines.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = r"(\w+)-(\d+)([a-z]?)_(\d{8})_(\d{6})\.mff$"
SIGNAL = "signal1.bin"
#: Channel counts tried in order.
CHANNEL_COUNTS = (257, 260, 256, 261, 259, 258, 269)
COMPARE = {ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.EqualTo: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.IsNotNull: lambda a, b: a is not None}


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def text_of(path: str) -> str | None:
    at, inner = store(path)
    if at.get_file_info(inner).type != fs.FileType.File:
        return None
    with at.open_input_file(inner) as f:
        return f.read().decode("utf-8", "replace")


def channel_count(values: int) -> int:
    """The first count that divides the number of values, else the first of all."""
    return next((n for n in CHANNEL_COUNTS if values % n == 0), CHANNEL_COUNTS[0])


def layout_names(path: str) -> list[str]:
    """Names from the layout: E and number where there is none."""
    import xml.etree.ElementTree as ET

    names, found = [], text_of(f"{path}/sensorLayout.xml")
    for sensor in (e for e in ET.fromstring(found).iter() if e.tag.rpartition("}")[2] == "sensor") if found else ():
        part = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in sensor}
        if part.get("name") or part.get("type", "0") == "0":
            names.append(part.get("name") or f"E{part.get('number', len(names) + 1)}")
    return names


def channel_names(path: str, n: int) -> list[str]:
    """The layout's names, cut or filled up with AUX to n."""
    names = layout_names(path)[:n]
    return names + [f"AUX{i}" for i in range(len(names), n)]


def sampling_rate(path: str, default: float = 250.0) -> float:
    """From info1.xml or info.xml, if it lies between 100 and 2000."""
    for name in ("info1.xml", "info.xml"):
        found = re.search(r"<(?:\w+:)?sampRate>\s*([0-9.]+)", text_of(f"{path}/{name}") or "")
        if found and 100 <= float(found[1]) <= 2000:
            return float(found[1])
    return default


def found_recordings(path: str) -> list[str]:
    """path itself, if it is a recording, or the recordings in it, by night, suffix and start."""
    at, inner = store(path)
    if path.rstrip("/").endswith(".mff") or at.get_file_info(f"{inner}/{SIGNAL}").type == fs.FileType.File:
        return [path.rstrip("/")]
    names = [i.base_name for i in at.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.Directory and re.search(NAME, i.base_name)]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names, key=lambda n: (int(re.search(NAME, n)[2]), re.search(NAME, n).groups()[2:], n))]


@dataclass
class Recording:
    """What a header tells: n channels, total samples, and the samples of the night's parts before it."""

    path: str
    night: int | None
    suffix: str | None
    n: int
    total: int
    rate: float
    before: int = 0

    @classmethod
    def opened(cls, path: str, options: dict) -> Recording | None:
        at, inner = store(f"{path}/{SIGNAL}")
        info = at.get_file_info(inner)
        if info.type != fs.FileType.File:
            if options.get("missing", "error") == "skip":
                return None
            raise FileNotFoundError(f"{path} has no {SIGNAL}")
        name, values = re.search(NAME, path), info.size // 4
        n = int(options.get("channel_count") or channel_count(values))
        return cls(path, int(name[2]) if name else None, name[3] if name else None, n, values // n, float(options.get("sfreq") or sampling_rate(path)))

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]


@dataclass
class Samples(InputPartition):
    recording: Recording
    names: list[str]
    first: int
    last: int
    begin: int
    epoch: int


FIELDS = [("night", pa.int32()), ("suffix", pa.string()), ("recording", pa.string()), ("channel", pa.string()), ("epoch", pa.int32()), ("first_sample", pa.int64()), ("night_sample", pa.int64()), ("sfreq", pa.float64()), ("samples", pa.list_(pa.float64()))]
SCHEMA = "night int, suffix string, recording string, channel string, epoch int, first_sample long, night_sample long, sfreq double, samples array<double>"


def epochs_of(part: Samples, wanted) -> Iterator[pa.RecordBatch]:
    """A row an epoch and wanted channel; one epoch is held at a time."""
    r, picks = part.recording, [i for i, c in enumerate(part.names) if wanted(c)]
    if not picks or part.first >= part.last:
        return
    at, inner = store(f"{r.path}/{SIGNAL}")
    with at.open_input_file(inner) as f:
        for a in range(part.first, part.last, part.epoch):
            raw = f.read_at(4 * r.n * min(part.epoch, part.last - a), 4 * r.n * a)
            block = np.frombuffer(raw, "<f4").reshape(-1, r.n)
            k = len(picks)
            samples = pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * len(block), pa.array(block[:, picks].T.astype(float).reshape(-1)))
            same = [r.night, r.suffix, r.name, None, (a - part.begin) // part.epoch, a, r.before + a, r.rate]
            columns = [pa.array([part.names[i] for i in picks]) if c == "channel" else pa.array([v] * k, t) for (c, t), v in zip(FIELDS, same, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, samples], [c for c, _ in FIELDS])


class RecordingReader(DataSourceReader):
    PUSHED = ("night", "suffix", "recording", "channel", "epoch", "first_sample")

    def __init__(self, options: dict):
        self.options = dict(options)
        known = [r for p in found_recordings(options["path"]) if (r := Recording.opened(p, self.options))]
        before: dict[Any, int] = {}
        for r in known:  # parts of a night are in order
            r.before = before.get(r.night, 0) if r.night is not None else 0
            before[r.night] = r.before + r.total
        self.recordings = known
        wanted = options.get("channels")
        self.tests: dict[str, list] = {"channel": [(ds.In, wanted.split(","))] if wanted is not None else []}

    def holds(self, column: str, value) -> bool:
        return all(value is not None and COMPARE[kind](value, v) for kind, v in self.tests.get(column, ()))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())  # a negation has none
            column = name[0] if len(name) == 1 else ""
            value = getattr(f, "value", None)
            known = isinstance(f, ds.IsNotNull) or (value is not None and not (isinstance(f, ds.In) and None in value))
            if column in self.PUSHED and type(f) in COMPARE and known:
                self.tests.setdefault(column, []).append((type(f), value))
            else:
                yield f

    def partitions(self):
        out = []
        for r in self.recordings:
            if not all(self.holds(c, getattr(r, k)) for c, k in (("night", "night"), ("suffix", "suffix"), ("recording", "name"))):
                continue
            begin, end = int(self.options.get("start", 0)), min(r.total, int(self.options.get("stop", r.total)))
            epoch = max(1, int(float(self.options.get("epoch_seconds", 30)) * r.rate))
            names, most = channel_names(r.path, r.n), max(1, int(self.options.get("epochs_per_task", 20)))
            # places of epochs that the filters leave, in runs of at most `most`
            low, high = self.bounds("epoch", 0, max(0, -(-(end - begin) // epoch)))
            a, b = self.bounds("first_sample", 0, max(0, end))
            low, high = max(low, -(-(a - begin) // epoch)), min(high, -(-(b - begin) // epoch))
            run = []
            for k in [*(k for k in range(low, high) if self.holds("epoch", k) and self.holds("first_sample", begin + k * epoch)), None]:
                if run and (k is None or k != run[-1] + 1 or len(run) == most):
                    out.append(Samples(r, names, begin + run[0] * epoch, min(end, begin + (run[-1] + 1) * epoch), begin, epoch))
                    run = []
                if k is not None:
                    run.append(k)
        return out or [Samples(Recording("", None, None, 1, 0, 1.0), [], 0, 0, 0, 1)]

    def bounds(self, column: str, low: int, high: int) -> tuple[int, int]:
        """The half-open range that comparisons leave."""
        for kind, v in self.tests.get(column, ()):
            if kind in (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo):
                low = max(low, math.floor(v) + 1 if kind is ds.GreaterThan else math.ceil(v))
            if kind in (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo):
                high = min(high, math.ceil(v) if kind is ds.LessThan else math.floor(v) + 1)
        return low, high

    def read(self, part: Samples):
        yield from epochs_of(part, lambda c: self.holds("channel", c))


class GrowingReader(DataSourceStreamReader):
    """Whole epochs that recordings have gained; an offset tells each recording's samples, so that each comes once."""

    def __init__(self, options: dict):
        self.options = dict(options)
        wanted = options.get("channels")
        self.wanted = None if wanted is None else wanted.split(",")

    def opened(self, path: str) -> tuple[Recording | None, int]:
        """A file that grows does not tell its channels: the option or the layout must."""
        n = self.options.get("channel_count") or len(layout_names(path))
        if not n:
            raise ValueError(f"{path} has no layout: channel_count must be given")
        r = Recording.opened(path, self.options | {"channel_count": n, "missing": "skip"})
        return r, max(1, int(float(self.options.get("epoch_seconds", 30)) * r.rate)) if r else 1

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        opened = {p.rpartition("/")[2]: self.opened(p) for p in found_recordings(self.options["path"])}
        return {name: r.total // epoch * epoch for name, (r, epoch) in opened.items() if r}

    def partitions(self, start: dict, end: dict):
        out, per_task = [], max(1, int(self.options.get("epochs_per_task", 20)))
        for path in found_recordings(self.options["path"]):
            r, epoch = self.opened(path)
            done, to = start.get(path.rpartition("/")[2], 0), end.get(path.rpartition("/")[2], 0)
            if r:
                out += [Samples(r, channel_names(path, r.n), a, min(a + per_task * epoch, to), 0, epoch) for a in range(done, to, per_task * epoch)]
        return out

    def read(self, part: Samples):
        yield from epochs_of(part, lambda c: self.wanted is None or c in self.wanted)

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


class RecordingSource(DataSource):
    """spark.read or spark.readStream .format("recording").load(path); options channels, start, stop, epoch_seconds,
    epochs_per_task, channel_count, sfreq, missing (error or skip: recordings without a signal file)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)


def write_signals(rows: DataFrame, folder: str) -> None:
    """A recording in `folder` for each name of rows (recording, place, values): its values, interleaved, in the order of place.

    One task writes a file, a row at a time, under a name of its own, and gives it its place when it is whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inner = store(folder)
        out = name = temporary = None
        done: list[str] = []

        def close() -> None:
            if out:
                out.close()
                at.move(temporary, f"{inner}/{name}/{SIGNAL}")
                done.append(name)

        for batch in batches:
            for recording, values in zip(batch.column("recording").to_pylist(), batch.column("values"), strict=True):
                if recording != name:
                    close()
                    name, temporary = recording, f"{inner}/{recording}/.{uuid.uuid4().hex}"
                    at.create_dir(f"{inner}/{name}")
                    out = at.open_output_stream(temporary)
                out.write(values.values.to_numpy().astype("<f4").tobytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["recording"])

    one = rows.repartition("recording").sortWithinPartitions("recording", "place").select("recording", "values")
    one.mapInArrow(write, "recording string").write.format("noop").mode("overwrite").save()


def layout(spark: SparkSession, file: str) -> DataFrame:
    """name, number, x, y, z of the electrodes of a layout (type 0), on the unit sphere."""
    from noctua.operators.channels import unit_sphere

    raw = spark.read.format("xml").option("rowTag", "sensor").schema("name string, number int, type int, x double, y double, z double").load(file)
    named = raw.filter("type = 0").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("E"), F.col("number"))))
    return unit_sphere(named.select("name", "number", "x", "y", "z"))


def catalog(paths: DataFrame) -> DataFrame:
    """night, suffix, start_ts, path, name of the recordings among paths (path, source: its place in the order of folders).

    Names that do not match are left out; of a night's equal parts the one of the first folder stays.
    """
    part = lambda k: F.regexp_extract("path", NAME, k)
    found = paths.filter(F.col("path").rlike(NAME)).select(
        part(2).cast("int").alias("night"), part(3).alias("suffix"), F.to_timestamp_ntz(F.concat(part(4), part(5)), F.lit("yyyyMMddHHmmss")).alias("start_ts"), "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "source",
    )
    w = W.Window.partitionBy("night", "suffix", "start_ts").orderBy("source", "name")
    return found.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def write_nights(df: DataFrame, path: str, slots: int = 64) -> None:
    """Rows by night; nights that are there are replaced, others stay.

    Folders are slots of nights (a hash; a column of what is read), so that they do not grow with the nights. A slot is
    written again with its other nights; df is computed twice where there are nights already. `slots` is that of the first write.
    """
    placed = df.withColumn("slot", F.pmod(F.xxhash64(F.col("night").cast("string")), F.lit(slots)))
    try:
        there = df.sparkSession.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # none or without rows
            raise
    else:
        if "slot" not in there.columns:
            raise ValueError(f"{path} has nights that write_nights did not write")
        touched = [r.slot for r in placed.select("slot").distinct().collect()]  # `slots` numbers at most
        new = placed.select(F.col("night").alias("_night")).distinct()
        others = there.filter(F.col("slot").isin(touched)).join(new, F.col("night").eqNullSafe(F.col("_night")), "left_anti")
        placed = placed.unionByName(others.withColumn("slot", F.col("slot").cast("long")), allowMissingColumns=True)
    placed.hint("rebalance", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)
