"""Best-fit packing by minimum bin slack, over the counts of lengths.

There are at most `capacity` lengths, so that the packing is planned on their counts alone, whatever the corpus: a bin
takes the longest length left, a bitset subset-sum program over the available lengths finds the fullest feasible rest,
and the combination is removed as many times as the counts allow. Pieces then get their places by their rank within
their length, counted in hash buckets so that one length may hold any share of the pieces.

Null and empty texts have the end id only. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.llm.shared import parts, stored
from noctua.llm.tokens import encoder

CHUNK_TEXTS = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths (each at most as often as counts has it) whose sum is the largest up to room."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length else 0
        times = 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
            left, times = left - take, times * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(length to how often, number of bins) of each kind of bin."""
    counts, plan = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        kind: dict[int, int] = {longest: 1}
        for length in fullest(capacity - longest, {k: v for k, v in rest.items() if v}):
            kind[length] = kind.get(length, 0) + 1
        bins = min(counts[k] // n for k, n in kind.items())
        plan.append((kind, bins))
        for k, n in kind.items():
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
    return plan


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Each text's ids and the end id, cut only where they are more than capacity."""
    end = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(tokenizer).encode, 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_TEXTS):
                some, rows = batch.slice(at, CHUNK_TEXTS), []
                for doc_id, raw in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    raw += end
                    for k, b in enumerate(range(0, len(raw), step)):
                        part = raw[b : b + step]
                        rows.append((doc_id, k, b // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack(made: DataFrame, capacity: int) -> DataFrame:
    """made, a row a piece with its length, with sequence_id and offset. Other columns stay."""
    spark = made.sparkSession
    counts = {r.length: r["count"] for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    given, used, sequence = [], dict.fromkeys(counts, 0), 0
    for kind, bins in minimum_bin_slack(counts, capacity):
        offset = 0
        for length, n in kind.items():
            given.append((length, used[length], used[length] + n * bins, n, sequence, offset))
            used[length] += n * bins
            offset += n * length
        sequence += bins
    given = spark.createDataFrame(given or [], "length long, low long, high long, times long, sequence long, at long")
    given = given.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "times", "sequence", "at"))).alias("given"))

    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts(made))).cast("int")
    dealt = made.withColumn("_bucket", bucket)
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = W.Window.partitionBy("length").orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.row_number().over(inside) - 1)
    ranked = ranked.join(F.broadcast(given), "length")  # a row a length
    mine = F.element_at(F.filter("given", lambda g: (g["low"] <= F.col("_rank")) & (F.col("_rank") < g["high"])), 1)
    ranked = ranked.withColumn("_g", mine).drop("given")
    nth = F.col("_rank") - F.col("_g.low")
    sequence_id = F.col("_g.sequence") + F.floor(nth / F.col("_g.times")).cast("long")
    offset = F.col("_g.at") + nth % F.col("_g.times") * F.col("length")
    return ranked.select(*made.columns, sequence_id.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32 (and ids, if wanted), sequence_id, offset."""
    return pack(stored(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
