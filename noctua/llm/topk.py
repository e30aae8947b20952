"""Exact top-k search by integer inner product with multi-resolution segment statistics.

Vectors are turned by an orthogonal transform, the eigenvectors of the corpus' second moments, so that the energy that
there is comes together in the first places, and cut into segments. A segment is summed up by its mean and deviation.
By Cauchy-Schwarz the inner product of two segments of length l is at most l * (mean * mean + deviation * deviation),
which is the lower bound of their squared distance turned round. Bounds go from few segments to many (LEVELS), each for
the pairs that the one before left, then the exact product of the whole-number vectors for the pairs that are left; a
pair is left out only if its bound is below the query's floor, so that the result is exact. The floor is the k-th best
score among SEEDS vectors, and then the k-th best so far.

Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of different lengths count
as padded with zeros. Repeated ids are separate candidates, but no row with the query's own id is a candidate. A
query with fewer than k candidates gets all. Sums are exact while below 2**53. Empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.llm.shared import passing, shared_dir, stored

#: Segments in 64ths of a vector's width; a level of 48 is half single places and half pairs of places.
LEVELS = (4, 16, 32, 48)
QUERY_BLOCK = 8192
CANDIDATES = 2048
SEEDS = 4096
LANES, PAIRS = 512, 1 << 14
SLACK = 1e-9  # of the product of the norms, for the rounding of bounds


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, an array of whole numbers as doubles; without the vectors that take no part."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    finite = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def second_moments(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of the outer products of all vectors; a task sends one matrix of width x width."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            for at in range(0, len(pdf), CANDIDATES):
                m = matrix(list(pdf["v"].iloc[at : at + CANDIDATES]), width)
                total += m.T @ m
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    rows = vectors.mapInPandas(sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((width, width))
    for r in rows.collect():  # width x width numbers
        out[r.i, r.j] = r.x
    return out


def turned(moments: np.ndarray) -> np.ndarray:
    """Eigenvectors as columns, the largest first."""
    finite = moments if np.isfinite(moments).all() else np.eye(len(moments))
    return np.linalg.eigh(finite)[1][:, ::-1].copy()


def edges(width: int, level: int) -> np.ndarray:
    """Begins of a level's segments: equal ones, or (from 33 of 64 on) single places first and pairs after."""
    n = max(1, min(width, width * level // 64))
    if 2 * n <= width:
        return np.arange(n) * width // n
    return np.unique(np.concatenate([np.arange(2 * n - width), np.arange(2 * n - width, width, 2)]))


def statistics(m: np.ndarray, level: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of the length: a product of rows is a bound."""
    begin = edges(m.shape[1], level)
    n = np.diff(np.append(begin, m.shape[1]))
    total, squares = np.add.reduceat(m, begin, 1), np.add.reduceat(m * m, begin, 1)
    return np.concatenate([total / np.sqrt(n), np.sqrt(np.maximum(squares - total * total / n, 0))], 1)


class Block:
    """Queries with their statistics, and the k best found for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors**2).sum(1))
        t = vectors @ rotation
        self.rotation, self.levels = rotation, [statistics(t, level) for level in LEVELS]
        self.floor = floor.copy()
        self.best, self.best_ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.tested = self.exact = 0

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        norm, t = np.sqrt((c**2).sum(1)), c @ self.rotation
        others = [statistics(t, level) for level in LEVELS]
        for at in range(0, len(self.ids), LANES):
            lanes = slice(at, at + LANES)
            alive, row, col = self.ids[lanes, None] != ids[None, :], None, None
            self.tested += int(alive.sum())
            slack = SLACK * (1 + self.norm[lanes, None] * norm[None, :])
            for own, other in zip((x[lanes] for x in self.levels), others, strict=True):  # coarse to fine
                if row is None:
                    alive &= own @ other.T >= self.floor[lanes, None] - slack
                    if 4 * np.count_nonzero(alive) < alive.size:  # few pairs left: their bounds alone
                        row, col = np.nonzero(alive)
                else:
                    bound = np.concatenate([np.einsum("ij,ij->i", own[row[a : a + PAIRS]], other[col[a : a + PAIRS]]) for a in range(0, len(row), PAIRS)] or [np.zeros(0)])
                    ok = bound >= self.floor[lanes][row] - slack[row, col]
                    row, col = row[ok], col[ok]
            row, col = np.nonzero(alive) if row is None else (row, col)
            self.exact += len(row)
            begin = np.searchsorted(row, np.arange(alive.shape[0] + 1))
            for i in np.flatnonzero(np.diff(begin)):
                some, k = col[begin[i] : begin[i + 1]], at + i
                score, found = np.append(self.best[k], c[some] @ self.vectors[k]), np.append(self.best_ids[k], ids[some])
                order = np.lexsort((found, -score))[: self.k]
                self.best[k], self.best_ids[k] = score[order], found[order]
                self.floor[k] = max(self.floor[k], self.best[k, -1])


def floors(ids: np.ndarray, vectors: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the seeds, which are candidates like others; -inf where there are fewer."""
    out = np.full(len(ids), -np.inf)
    for at in range(0, len(ids), 512):
        score = np.where(ids[at : at + 512, None] != seed_ids[None, :], vectors[at : at + 512] @ seeds.T, -np.inf)
        if score.shape[1] >= k:
            out[at : at + 512] = np.partition(score, -k, 1)[:, -k]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries; both tables as quantised() gives them.

    Queries go in blocks of QUERY_BLOCK: one at a time is shipped, searched by all tasks, written and let go. A task
    keeps k rows a query only.
    """
    spark = vectors.sparkSession
    vectors, queries = stored(vectors, "vectors"), stored(queries.dropDuplicates(), "queries")
    kind, path = "query_id long, vec_id long, score long", f"{shared_dir(spark)}/noctua/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], kind).write.parquet(path)
    passing(spark, path)
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    if n and width:
        rotation = turned(second_moments(vectors, width))
        some = vectors.sample(min(1.0, SEEDS / n), 5).limit(SEEDS).toPandas()  # a bounded sample: only floors come from it
        seed_ids, seeds = some["vec_id"].to_numpy(np.int64), matrix(list(some["v"]), width)
        blocks = queries.repartition(-(-queries.count() // QUERY_BLOCK) or 1).mapInPandas(lambda b: query_blocks(b, width), "ids binary, m binary")
        for row in stored(blocks, "query-blocks").toLocalIterator():
            ids = np.frombuffer(row.ids, "<i8")
            own = np.frombuffer(row.m, "<f8").reshape(len(ids), width)
            shipped = spark.sparkContext.broadcast((ids, own, floors(ids, own, seed_ids, seeds, k)))

            def search(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
                ids, own, floor = shipped.value
                block = Block(ids, own, rotation, floor, k)
                for pdf in batches:
                    for at in range(0, len(pdf), CANDIDATES):
                        block.meet(pdf["vec_id"].to_numpy()[at : at + CANDIDATES], matrix(list(pdf["v"].iloc[at : at + CANDIDATES]), width))
                r, c = np.nonzero(np.isfinite(block.best))
                yield pd.DataFrame({"query_id": ids[r], "vec_id": block.best_ids[r, c], "score": block.best[r, c].astype(np.int64)})

            vectors.mapInPandas(search, kind).write.mode("append").parquet(path)
            shipped.destroy()
    found = spark.read.schema(kind).parquet(path)
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Packs a task's queries into rows of at most QUERY_BLOCK vectors."""
    ids, rows = [], []

    def flush():
        return pd.DataFrame({"ids": [np.array(ids, "<i8").tobytes()], "m": [matrix(rows, width).astype("<f8").tobytes()]})

    for pdf in batches:
        for i, v in zip(pdf["vec_id"], pdf["v"], strict=True):
            ids.append(i)
            rows.append(v)
            if len(ids) == QUERY_BLOCK:
                yield flush()
                ids.clear()
                rows.clear()
    if ids:
        yield flush()
