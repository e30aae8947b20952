"""Feature bundles: a data source that writes features and their header as one thing, or not at all.

Tasks write Parquet files into a folder of the job's own; only when all are done are they moved to their place, and then the
header (what was measured, the columns, the rows a file) is put beside them. A reader takes the files that the header names, so
that what a job that broke off has left, or a job that runs, is never read. An overwrite swaps the header; the old files go last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from noctua.sources.recording import store

HEADER = "header.json"
#: What a header tells beside the columns.
TOLD = ("file_path", "channel", "sfreq", "n_channels")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.told = {k: options[k] for k in TOLD if k in options}
        self.job = uuid.uuid4().hex

    def pending(self) -> tuple[fs.FileSystem, str, str]:
        at, inner = store(self.path)
        return at, inner, f"{inner}/.pending-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        at, _, pending = self.pending()
        at.create_dir(pending)
        name, rows = f"part-{uuid.uuid4().hex}.parquet", 0  # a task that is tried again has another name
        kind = to_arrow_schema(self.schema)
        with at.open_output_stream(f"{pending}/{name}") as out, pq.ParquetWriter(out, kind) as file:
            for batch in batches:
                file.write_table(pa.Table.from_batches([batch]).cast(kind))
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        at, inner, pending = self.pending()
        known = header_of(self.path)
        files = {m.file: m.rows for m in messages if m}
        for name in files:
            at.move(f"{pending}/{name}", f"{inner}/{name}")
        old = known["files"] if known else {}
        header = self.told | {"columns": self.schema.names, "files": files if self.overwrite else old | files}
        with at.open_output_stream(f"{pending}-header") as out:
            out.write(json.dumps(header).encode())
        at.move(f"{pending}-header", f"{inner}/{HEADER}")  # from here on the new files count
        for name in old if self.overwrite else ():
            at.delete_file(f"{inner}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        at, _, pending = self.pending()
        if at.get_file_info(pending).type == fs.FileType.Directory:
            at.delete_dir(pending)


def header_of(path: str) -> dict | None:
    at, inner = store(f"{path}/{HEADER}")
    if at.get_file_info(inner).type != fs.FileType.File:
        return None
    with at.open_input_file(inner) as f:
        return json.loads(f.read())


class BundleSource(DataSource):
    """df.write.format("feature_bundle").mode("append" or "overwrite").option("channel", ...).save(path)."""

    @classmethod
    def name(cls) -> str:
        return "feature_bundle"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BundleSource)


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, features) of a bundle: the files that its header names, none other."""
    header = header_of(path)
    if header is None:
        raise FileNotFoundError(f"{path} has no {HEADER}")
    held = [f"{path}/{name}" for name, rows in header["files"].items() if rows] or [f"{path}/{name}" for name in header["files"]][:1]
    return header, spark.read.parquet(*held)
