"""Microstates of whole recordings: one segmentation of all samples of all epochs, so that a state means the same in each.

Modified k-means, in which polarity does not count. A round scans the stored epochs once: a task adds up the outer
products of its samples a state, these sums meet a row of the matrix at a time, and a state's new map is the leading
vector of its matrix. Samples move once, when epochs are put together; the driver sees one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.sources.folders import Tables

#: Recordings whose maps are broadcast to the scans (about 8 KB each at 257 channels and 4 states); more are joined.
BROADCAST_RECORDINGS = 4096
#: Recordings whose sums a task holds before it passes them on (k matrices of channels x channels each).
SUMS_HELD = 8


def epoch_matrices(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order, n, field (array of samples a channel, by channel name): the epochs that have all their recording's
    channels, whole and finite; channels are cut to the shortest. segments: keys, order, channel, samples."""
    x = segments.select(*keys, order, "channel", "samples")
    sound = F.col("samples").isNotNull() & F.forall("samples", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    stacked = x.groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("_s"), F.min(F.size("samples")).alias("n"), F.bool_and(sound).alias("_sound"), F.count("*").alias("_c"))
    whole = x.groupBy(*keys).agg(F.count_distinct("channel").alias("_all"))
    fit = stacked.join(whole, keys).filter("_sound and n > 0 and _c = _all and _c > 1")
    return fit.select(*keys, order, "n", F.transform("_s", lambda s: F.slice(s["samples"], 1, F.col("n")).cast("array<double>")).alias("field"))


def matrix(field) -> np.ndarray:
    """Channels x samples, each sample less its mean over channels."""
    x = np.stack(list(field)).astype(float)
    return x - x.mean(0)


def first_maps(epochs: DataFrame, keys: list[str], order: str, k: int, seed: int) -> DataFrame:
    """keys, state, map: k samples of a recording, spread over up to k of its epochs, the same however rows are dealt."""
    w = W.Window.partitionBy(*keys).orderBy(F.xxhash64(F.col(order), F.lit(seed)), order)
    chosen = epochs.select(*keys, order).withColumn("_e", F.row_number().over(w)).filter(F.col("_e") <= k)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for *key, e, field in pdf[[*keys, "_e", "field"]].itertuples(index=False):
                x = matrix(field)
                x = x[:, np.linalg.norm(x, axis=0) > 0]
                places = np.unique(np.linspace(0, x.shape[1] - 1, k).astype(int)) if x.shape[1] else []
                rows += [(*key, j, e, x[:, p] / np.linalg.norm(x[:, p])) for j, p in enumerate(places)]
            yield pd.DataFrame(rows, columns=[*keys, "_j", "_e", "map"])

    told = epochs.join(chosen, [*keys, order]).select(*keys, "_e", "field")
    some = told.mapInPandas(pick, f"{types(epochs, keys)}, _j int, _e int, map array<double>")
    by = W.Window.partitionBy(*keys).orderBy("_j", "_e")
    return some.withColumn("state", F.row_number().over(by) - 1).filter(F.col("state") < k).select(*keys, "state", "map")


def types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def with_maps(epochs: DataFrame, maps: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Epochs beside their recording's maps, in the order of states."""
    side = maps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "map"))), lambda m: m["map"]).alias("maps"))
    return epochs.join(F.broadcast(side) if small else side, keys)


def next_maps(epochs: DataFrame, maps: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """keys, state, map after one round; a state without samples keeps its map. moved: 1 less the likeness to the one before."""
    kind = types(epochs, keys)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def passed() -> pd.DataFrame:
            rows = [(*key, s, i, row) for key, sums in held.items() for s, m in enumerate(sums) if m.any() for i, row in enumerate(m)]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "state", "line", "sums"])

        for pdf in frames:
            for *key, field, known in pdf[[*keys, "field", "maps"]].itertuples(index=False):
                x, m = matrix(field), np.stack(list(known))
                label = ((m @ x) ** 2).argmax(0)
                sums = held.setdefault(tuple(key), np.zeros((len(m), len(x), len(x))))
                for s in np.unique(label):
                    y = x[:, label == s]
                    sums[s] += y @ y.T
                if len(held) > SUMS_HELD:
                    yield passed()
        yield passed()

    def together(key, pdf):
        return pd.DataFrame([(*key, np.sum(np.stack(list(pdf["sums"])), axis=0))], columns=[*keys, "state", "line", "sums"])

    def leading(key, pdf):
        m = np.stack(list(pdf.sort_values("line")["sums"]))
        return pd.DataFrame([(*key, np.linalg.eigh(m)[1][:, -1])], columns=[*keys, "state", "_new"])

    part = f"{kind}, state int, line int, sums array<double>"
    sums = with_maps(epochs, maps, keys, small).select(*keys, "field", "maps").mapInPandas(add, part)
    whole = sums.groupBy(*keys, "state", "line").applyInPandas(together, part)
    found = whole.groupBy(*keys, "state").applyInPandas(leading, f"{kind}, state int, _new array<double>")
    alike = F.abs(F.aggregate(F.zip_with("map", "_new", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
    both = maps.select(*keys, "state", "map").join(found, [*keys, "state"], "left")
    return both.select(*keys, "state", F.coalesce("_new", "map").alias("map"), F.coalesce(1 - alike, F.lit(0.0)).alias("moved"))


def segmented(segments: DataFrame, keys: list[str], order: str, states: int = 4, seed: int = 42, rounds: int = 100, tolerance: float = 1e-6, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(maps: keys, state, map; runs: keys, order, place, length, n, state of each run of one state in an epoch of n samples).

    keys tell recordings apart and are not null; order is an epoch's number in its recording. Maps are of length 1, their sign
    is free. A recording of fewer samples than states has as many states as samples. start: maps to begin with, of any length above 0.
    Rounds end when no map moves by more than `tolerance` (1 less its likeness to the one before), or after `rounds` of them.
    """
    tables = Tables(segments.sparkSession, "microstates")
    epochs = tables.stored(epoch_matrices(segments, keys, order), "epochs")
    small = epochs.select(*keys).distinct().limit(BROADCAST_RECORDINGS + 1).count() <= BROADCAST_RECORDINGS
    first = start if start is not None else first_maps(epochs, keys, order, states, seed)
    norm = F.sqrt(F.aggregate("map", F.lit(0.0), lambda a, v: a + v * v))
    unit = F.transform("map", lambda v: v / norm)
    maps = tables.stored(first.select(*keys, F.col("state").cast("int").alias("state"), unit.alias("map")), "maps-0")
    for k in range(1, rounds + 1):
        maps = tables.stored(next_maps(epochs, maps, keys, small), f"maps-{k}")
        tables.drop(f"maps-{k - 1}")
        if (maps.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for *key, field, known in pdf[[*keys, order, "field", "maps"]].itertuples(index=False):
                x = matrix(field)
                label = ((np.stack(list(known)) @ x) ** 2).argmax(0)
                at = np.flatnonzero(np.diff(label, prepend=-1))
                rows += [(*key, int(p), int(n), len(label), int(label[p])) for p, n in zip(at, np.diff(at, append=len(label)), strict=True)]
            yield pd.DataFrame(rows, columns=[*keys, order, "place", "length", "n", "state"])

    shown = with_maps(epochs, maps, keys, small).select(*keys, order, "field", "maps")
    return maps.drop("moved"), shown.mapInPandas(told, f"{types(epochs, [*keys, order])}, place long, length long, n long, state int")


def state_metrics(runs: DataFrame, keys: list[str], order: str, fs: float = 250.0) -> DataFrame:
    """keys, state, samples, coverage, runs, mean_duration_s, per_second: runs go on from one epoch to the next number.

    Only runs at the edges of epochs, two an epoch at most, are put in order; an epoch that is missing ends a run.
    """
    edge = (F.col("place") == 0) | (F.col("place") + F.col("length") == F.col("n"))
    w = W.Window.partitionBy(*keys).orderBy(order, "place")
    goes_on = (F.col(order) == F.lag(order).over(w) + 1) & (F.col("state") == F.lag("state").over(w))
    joined = runs.filter(edge).withColumn("_new", F.when(goes_on, 0).otherwise(1)).groupBy(*keys, "state").agg(F.sum("length").alias("samples"), F.sum("_new").alias("runs"))
    inner = runs.filter(~edge).groupBy(*keys, "state").agg(F.sum("length").alias("samples"), F.count("*").alias("runs"))
    by = joined.unionByName(inner).groupBy(*keys, "state").agg(F.sum("samples").alias("samples"), F.sum("runs").alias("runs"))
    total = F.sum("samples").over(W.Window.partitionBy(*keys))  # a row a state
    return by.select(*keys, "state", "samples", (F.col("samples") / total).alias("coverage"), "runs", (F.col("samples") / F.col("runs") / fs).alias("mean_duration_s"), (F.col("runs") * fs / total).alias("per_second"))
