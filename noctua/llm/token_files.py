"""Token ids of whole texts in binary files, and back.

Documents are ranged over partitions by doc_id, null first; each task writes its documents in order as rows of a
Parquet table in the shared folder. A row is a shard: the doc_ids, the number of ids of each, and one Simple-8b stream
of all their ids; `part` and `first` place it. Parquet is the container so that Spark commits the files (a lost
executor's half-written ones never count) and any store that Spark reads will do.

Null and empty texts have the end id only. Repeated rows are written each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.llm import simple8b
from noctua.llm.shared import parts
from noctua.llm.tokens import encoder

SHARD_TOKENS = 1 << 18
CHUNK_TEXTS = 256
SHARDS = "part int, seq int, first long, n_tokens long, doc_ids array<bigint>, lengths array<int>, ids binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the files of docs (doc_id, text) to path."""
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        seq = first = held = 0
        ids: list[int | None] = []
        streams: list[bytes] = []

        def flush() -> pa.RecordBatch:
            lengths = [len(s) // 4 for s in streams]
            stream = simple8b.encode(np.frombuffer(b"".join(streams), "<u4"))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([stream], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "first", "n_tokens", "doc_ids", "lengths", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_TEXTS):
                some = batch.slice(at, CHUNK_TEXTS)
                for doc_id, raw in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    streams.append(raw + end)
                    held += len(raw) // 4 + 1
                    if held >= SHARD_TOKENS:
                        yield flush()
                        seq, first, held = seq + 1, first + held, 0
                        ids.clear()
                        streams.clear()
        if ids:
            yield flush()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts(docs), F.col("doc_id").asc_nulls_first())
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(shards, SHARDS).write.parquet(path)


def placed_shards(spark, path: str) -> DataFrame:
    """The shards with the number of ids before each; one sum a part meets in one place."""
    shards = spark.read.schema(SHARDS).parquet(path)
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("first")).alias("at"), "doc_ids", "lengths", "ids")


def read_token_files(spark, path: str) -> DataFrame:
    """A row a document: doc_id, start (ids of all documents before it), n_tokens, ids (array), ids_crc32."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = simple8b.decode(row["ids"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = values.tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                for at in range(0, len(crc), 1024):
                    cut = slice(at, at + 1024)
                    flat = pa.array(values[ends[at] - lengths[at] : ends[cut][-1]].astype(np.int64))
                    splits = np.concatenate([[0], np.cumsum(lengths[cut])]).astype(np.int32)
                    columns = [pa.array(row["doc_ids"][cut], pa.int64()), pa.array(row["at"] + (ends - lengths)[cut]), pa.array(lengths[cut]), pa.ListArray.from_arrays(splits, flat), pa.array(crc[cut], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return placed_shards(spark, path).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids array<bigint>, ids_crc32 long")


def read_token_digests(spark, path: str) -> DataFrame:
    """As read_token_files, without the ids: their CRCs are taken where they are decoded."""
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, doc_ids, lengths, stream in pdf.itertuples(index=False):
                raw, lengths = simple8b.decode(stream).astype("<u4").tobytes(), np.asarray(lengths, np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(list(doc_ids), "Int64") if len(doc_ids) else [], "start": at + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    return placed_shards(spark, path).mapInPandas(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
