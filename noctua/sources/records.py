"""Recordings in the European data format and its 24-bit kin: a header, then records of all channels, channel after channel.

The source reads one file or all of a folder, a run of whole records a task; a record left unfinished is left out. Samples
are calibrated by their channel's header; each channel has its own rate. Filters on recording, channel and record are
taken over by the source: other files, channels and records are neither planned nor decoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from noctua.sources.recording import RecordingReader, store

#: The header's fields before and in the list of channels, name and width in bytes.
HEAD = {"version": 8, "patient": 80, "recording": 80, "date": 8, "time": 8, "bytes": 8, "reserved": 44, "records": 8, "seconds": 8, "channels": 4}
CHANNEL = {"label": 16, "transducer": 80, "unit": 8, "low": 8, "high": 8, "digital_low": 8, "digital_high": 8, "prefilter": 80, "samples": 8, "reserved": 32}
ANNOTATIONS = ("EDF Annotations", "BDF Annotations")
WIDTH = {True: 3, False: 2}  # bytes a sample, by whether the file is of the 24-bit kind

SCHEMA = "recording string, channel string, record long, first_sample long, sfreq double, unit string, samples array<double>"
TYPES = [("recording", pa.string()), ("channel", pa.string()), ("record", pa.int64()), ("first_sample", pa.int64()), ("sfreq", pa.float64()), ("unit", pa.string()), ("samples", pa.list_(pa.float64()))]


@dataclass
class Channel:
    label: str
    unit: str
    samples: int
    at: int
    gain: float
    base: float


@dataclass
class File:
    """What a header tells; size: bytes of a record, at: where the first one starts."""

    path: str
    width: int
    at: int
    size: int
    records: int
    seconds: float
    channels: list[Channel]

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]

    @classmethod
    def opened(cls, path: str) -> File:
        where, inner = store(path)
        total = where.get_file_info(inner).size
        with where.open_input_file(inner) as f:
            raw = f.read(256)
            head = cut(raw, HEAD, 1)
            try:
                n = int(head["channels"][0])
                rest = cut(f.read(256 * n), CHANNEL, n)
                width, counts = WIDTH[raw[:1] == b"\xff"], [int(v) for v in rest["samples"]]
                scale = [[float(v) for v in rest[c]] for c in ("low", "high", "digital_low", "digital_high")]
                told, seconds, at = int(head["records"][0]), float(head["seconds"][0]), int(head["bytes"][0])
            except ValueError as wrong:
                raise ValueError(f"{path}: the header is not one of this format") from wrong
        channels, place = [], 0
        for i, (low, high, least, most) in enumerate(zip(*scale, strict=True)):
            gain = (high - low) / (most - least) if most != least else 1.0
            channels.append(Channel(rest["label"][i], rest["unit"][i], counts[i], place, gain, low - least * gain))
            place += counts[i] * width
        whole = max(0, total - at) // place if place else 0
        return cls(path, width, at, place, whole if told < 0 else min(told, whole), seconds, channels)


def cut(raw: bytes, fields: dict[str, int], n: int) -> dict[str, list[str]]:
    out, at = {}, 0
    for name, width in fields.items():
        out[name] = [raw[at + i * width : at + (i + 1) * width].decode("latin-1").strip(" \0") for i in range(n)]
        at += n * width
    return out


def decoded(raw: np.ndarray, width: int) -> np.ndarray:
    """Little-endian two's complement of 2 or 3 bytes along the last axis, as int32."""
    b = raw.reshape(*raw.shape[:-1], -1, width).astype(np.int32)
    value = sum(b[..., k] << 8 * k for k in range(width))
    sign = 1 << 8 * width - 1
    return (value ^ sign) - sign


def encoded(values: np.ndarray) -> bytes:
    """Whole numbers as 24 bits each."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


@dataclass
class Records(InputPartition):
    file: File | None
    first: int
    last: int


class RecordsReader(RecordingReader):
    PUSHED = ("recording", "channel", "record")

    def __init__(self, options: dict):
        self.options = dict(options)
        at, inner = store(options["path"])
        paths = [options["path"]]
        if at.get_file_info(inner).type == fs.FileType.Directory:
            names = sorted(i.base_name for i in at.get_file_info(fs.FileSelector(inner)) if i.base_name.lower().endswith((".bdf", ".edf")))
            paths = [f"{options['path'].rstrip('/')}/{n}" for n in names]
        self.paths, self.tests = paths, {}

    def partitions(self):
        out, most = [], max(1, int(self.options.get("records_per_task", 600)))
        for path in (p for p in self.paths if self.holds("recording", p.rpartition("/")[2])):
            file = File.opened(path)
            low, high = self.bounds("record", 0, file.records)
            out += [Records(file, a, min(a + most, high)) for a in range(low, high, most)]
        return out or [Records(None, 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        file = part.file
        picks = [c for c in file.channels if c.label not in ANNOTATIONS and self.holds("channel", c.label)] if file else []
        if not picks:
            return
        where, inner = store(file.path)
        with where.open_input_file(inner) as f:
            for k in (k for k in range(part.first, part.last) if self.holds("record", k)):
                raw = np.frombuffer(f.read_at(file.size, file.at + k * file.size), np.uint8)
                rows = {c: [] for c, _ in TYPES}
                for c in picks:
                    samples = decoded(raw[c.at : c.at + c.samples * file.width], file.width) * c.gain + c.base
                    rate = c.samples / file.seconds if file.seconds > 0 else None
                    for name, v in zip(rows, (file.name, c.label, k, k * c.samples, rate, c.unit, samples), strict=True):
                        rows[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in TYPES], [c for c, _ in TYPES])


class RecordsSource(DataSource):
    """spark.read.format("records").load(path of a file or a folder); option records_per_task."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordsSource)


def header(channels: list[str], samples: int, records: int, seconds: float, low: float, high: float) -> bytes:
    """The head of a 24-bit file whose channels are alike."""
    n = len(channels)
    one = {"version": "\xffBIOSEMI", "date": "01.01.20", "time": "22.00.00", "bytes": 256 * (n + 1), "reserved": "24BIT", "records": records, "seconds": f"{seconds:.6g}", "channels": n}
    each = {"unit": "uV", "low": f"{low:.6g}", "high": f"{high:.6g}", "digital_low": -(1 << 23), "digital_high": (1 << 23) - 1, "samples": samples}
    text = "".join(str(one.get(c, "")).ljust(w)[:w] for c, w in HEAD.items())
    for c, w in CHANNEL.items():
        text += "".join(str(channels[i] if c == "label" else each.get(c, "")).ljust(w)[:w] for i in range(n))
    return text.encode("latin-1")


def write_records(rows: DataFrame, folder: str, channels: list[str], seconds: float, low: float, high: float) -> None:
    """A 24-bit file in `folder` for each name of rows (recording, place, values): a row is a record, its values channel
    after channel, in the order of place. Values beyond low and high are cut to them.

    One task writes a file, a record at a time, under a name of its own, and gives it its place when it is whole.
    """
    gain = (high - low) / ((1 << 24) - 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inner = store(folder)
        out = name = temporary = None
        done: list[str] = []

        def close() -> None:
            if out:
                out.close()
                at.move(temporary, f"{inner}/{name}")
                done.append(name)

        for batch in batches:
            columns = (batch.column("recording").to_pylist(), batch.column("records").to_pylist(), batch.column("values"))
            for recording, n, values in zip(*columns, strict=True):
                x = values.values.to_numpy()
                if recording != name:
                    close()
                    name, temporary = recording, f"{inner}/.{uuid.uuid4().hex}"
                    at.create_dir(inner)
                    out = at.open_output_stream(temporary)
                    out.write(header(channels, len(x) // len(channels), n, seconds, low, high))
                out.write(encoded(np.rint((np.clip(x, low, high) - low) / gain).astype(np.int64) - (1 << 23)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["recording"])

    counted = rows.join(rows.groupBy("recording").agg(F.count("*").alias("records")), "recording")
    typed = counted.select("recording", "place", "records", F.col("values").cast("array<double>").alias("values"))
    one = typed.repartition("recording").sortWithinPartitions("recording", "place").select("recording", "records", "values")
    one.mapInArrow(write, "recording string").write.format("noop").mode("overwrite").save()
