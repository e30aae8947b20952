"""A slot for a trained model: windows of an epoch go to it in Arrow batches, class probabilities come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.operators.epoching import sliding
from noctua.operators.events import argmax
from noctua.schema import EVENT_WINDOW


def predict(segments: DataFrame, keys: list[str], model: Callable[[np.ndarray], np.ndarray], size: int = EVENT_WINDOW, step: int = EVENT_WINDOW) -> DataFrame:
    """keys, win, proba, cls: model takes windows x samples and gives windows x classes. Null and short epochs have no windows."""
    windows = segments.select(*keys, F.posexplode(sliding(F.col("samples"), size, step)).alias("win", "w"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            proba = np.asarray(model(x), float)
            splits = np.arange(0, proba.size + 1, proba.shape[1], dtype=np.int32)
            out = pa.ListArray.from_arrays(splits, pa.array(proba.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*keys, "win", "proba"])

    return windows.mapInArrow(run, f"{schema}, proba array<double>").withColumn("cls", argmax(F.col("proba")))


def roi_groups(electrodes: DataFrame, k: int = 25, seed: int = 42) -> DataFrame:
    """name, roi: k-means groups of electrode places, the largest first; no more electrodes than k: each its own group."""
    if electrodes.limit(k + 1).count() <= k:
        ranked = electrodes.select("name", F.dense_rank().over(_order("name")).alias("roi"))
        return ranked.withColumn("roi", F.col("roi") - 1)
    rows = VectorAssembler(inputCols=["x", "y", "z"], outputCol="_v").transform(electrodes)
    found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_g").fit(rows).transform(rows)
    sizes = found.groupBy("_g").agg(F.count("*").alias("n"))  # k rows
    named = sizes.select("_g", (F.row_number().over(_order(F.desc("n"), "_g")) - 1).alias("roi"))
    return found.join(F.broadcast(named), "_g").select("name", "roi")


def _order(*columns):
    from pyspark.sql import window as W

    return W.Window.partitionBy(F.lit(0)).orderBy(*columns)
