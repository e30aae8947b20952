"""Importance resampling towards a target: array-scored weights and an exact cut in the histogram of whole scores.

Features are the runs of one to three words of a text, repeats counted; a feature's bucket is its CRC-32 modulo BUCKETS.
The target's and the source's counts a bucket give an array of BUCKETS whole gains, the only thing that is broadcast; a
document's weight is the sum of the gains at its features' buckets. The weight and a seeded Gumbel term, both whole, are
its score, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

The draw does not sort the documents. One histogram counts the documents of each whole score; counts summed from the top
(range by range, one sum a partition meeting in one place) give each score's rank offset and the cutoff, the lowest score
of which a document is drawn. Only documents at or above it are looked at again: row_number in the order of doc_id within
each surviving score, plus the score's offset, is the rank. Seeded terms part equal texts over thousands of scores, so
that a score holds few documents, whatever group of copies there is.

Null and empty texts have no features and weight 0. Documents with fewer than `least_words` words are scored and never
drawn. Ties go to the smaller doc_id, null last, then to fewer features; a null doc_id is seeded by "42:" alone. Repeated
rows each count and are each ranked, in some order among equals. An empty target gives the gains of its zero counts; empty documents give an empty
result. Columns other than doc_id and text are not read, so that names cannot clash. A text is read in runs of RUN_WORDS words, the last two of each taken
along, so that a very long text takes no more memory than its bytes and one run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.llm.shared import running_total, stored
from noctua.llm.words import slices

BUCKETS = 10000
RUN_WORDS = 1 << 15
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Fixed values of the draw's contract: fewest words, draws in a hundred.
LEAST_WORDS, PERCENT = 20, 5


def features(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them) of each run of words of a text."""
    found = (m.group() for m in WORDS.finditer((text or "").encode("utf-8", "replace").lower()))
    last: list[bytes] = []
    while run := list(islice(found, RUN_WORDS)):
        words = last + run
        one = list(map(crc32, words))
        more = [b" " + w for w in words[1:]]
        two = list(map(crc32, more, one))
        three = list(map(crc32, more[1:], two))
        old = len(last)
        new = one[old:] + two[max(0, old - 1) :] + three[max(0, old - 2) :]
        yield len(run), np.array(new, np.uint32) % BUCKETS
        last = words[-2:]


def bucket_counts(df: DataFrame) -> np.ndarray:
    """How many features each bucket holds: BUCKETS sums a task, BUCKETS sums in the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for _, buckets in features(text):
                    n += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["bucket", "n"])

    out = [0] * BUCKETS
    for r in df.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return np.array(out, np.int64)


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares), a bucket."""
    t, s = target.astype(np.float64), source.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, text in enumerate(batch.column(1).to_pylist()):
                for new, buckets in features(text):
                    n[i] += len(buckets)
                    words[i] += new
                    weight[i] += shipped.value[buckets].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")
    digest = F.sha2(F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return made.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share))))


def ranked(rows: DataFrame, total: int) -> tuple[DataFrame, int | None]:
    """(ranked, cutoff): those of rows (with score, doc_id, n_features) from the cutoff up, with rank; beyond total it is null."""
    histogram = rows.groupBy("score").agg(F.count("*").alias("n"))
    offsets = stored(running_total(histogram, [F.col("score").desc()], "n", "above", "histogram"), "offsets")
    surviving = offsets.filter(F.col("above") < total).select("score", "above")
    cutoff = surviving.agg(F.min("score")).first()[0]
    inside = W.Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    rank = F.col("above") + F.row_number().over(inside)
    kept = rows.filter(F.col("score") >= F.lit(cutoff).cast("long")).join(surviving, "score")
    return kept.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= total, F.col("rank"))).drop("above"), cutoff


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row a document: doc_id, n_features, n_words, weight, score, rank (null where it is not drawn).

    percent of the documents with least_words words or more are drawn; target has the texts to resemble.
    """
    rows = stored(scored(docs, gains(bucket_counts(target), bucket_counts(docs))), "scores")
    able = F.col("n_words") >= least_words
    total = percent * rows.filter(able).count() // 100
    top, cutoff = ranked(rows.filter(able), total)
    # no join puts the two together again: a row is on one side of the cutoff
    rest = rows if cutoff is None else rows.filter(~able | (F.col("score") < cutoff))
    return top.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
