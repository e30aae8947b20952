"""Feature tables: any number of kernels in one Arrow pass over the segments, wide or long."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions.kernels import KERNELS, band_pass, resampled


def extract(segments: DataFrame, keys: list[str], groups: list[str] | None = None, fs: float = 250.0, more: dict[str, tuple[Callable, list[str]]] | None = None) -> DataFrame:
    """keys and a double a feature. A segment that is null, short or not finite has null features; so has one whose
    kernel fails, and the job goes on. more: further kernels, name to (function of samples and rate, feature names).
    """
    known = KERNELS | (more or {})
    chosen = {g: known[g] for g in (groups or known)}
    names = [n for _, ns in chosen.values() for n in ns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: [None] * batch.num_rows for n in names}
            for i, samples in enumerate(batch.column(len(keys))):
                x = np.array(samples.values.to_numpy(zero_copy_only=False), float) if samples.is_valid else np.zeros(0)
                if len(x) < 4 or not np.isfinite(x).all():
                    continue
                for f, ns in chosen.values():
                    try:
                        got = f(x, fs)
                    except (ValueError, ZeroDivisionError, FloatingPointError, np.linalg.LinAlgError):
                        continue
                    for n in ns:
                        v = got.get(n)
                        columns[n][i] = v if v is not None and np.isfinite(v) else None
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, pa.float64()) for c in columns.values())], [*keys, *names])

    typed = segments.select(*keys, "samples")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema.fields[:-1])
    return typed.mapInArrow(run, schema + "".join(f", {n} double" for n in names))


def long_form(wide: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, value of every feature that is there."""
    names = [c for c in wide.columns if c not in keys]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    return wide.select(*keys, cells.alias("c")).select(*keys, "c.name", "c.value").filter("value is not null")


def joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Feature tables side by side on their keys; an epoch that is in one only has nulls for the others."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out


def filtered(segments: DataFrame, group: list[str], order: str, low: float = 0.1, high: float = 40.0, fs: float = 250.0, block: int = 1 << 18) -> DataFrame:
    """Epochs of the band-passed signal. A group's epochs stand in a row: the filter does not see epoch edges.

    group: one channel of one recording, of any length. A task filters blocks of `block` samples, each with half a
    filter's length on both sides; over a whole group only places are counted, in a window that spills.
    """
    from functools import reduce
    from operator import and_

    from pyspark.sql import window as W

    rows = segments.select(*group, order, "samples").withColumn("_n", F.size("samples").cast("long"))
    before = W.Window.partitionBy(*group).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    totals = rows.groupBy(*group).agg(F.sum("_n").alias("_total"))
    same = reduce(and_, [F.col(f"p.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group])
    known = placed.alias("p").join(totals.alias("t"), same).select("p.*", "t._total")
    reach = math.ceil(1.65 * fs / max(low, 0.1))
    # an epoch goes to the block of each of its samples and to those within reach
    first, last = F.floor((F.col("_at") - reach) / block), F.floor((F.least(F.col("_at") + F.col("_n") + reach, F.col("_total") - 1)) / block)
    spread = known.withColumn("_block", F.explode(F.sequence(F.greatest(F.least(first, last), F.lit(0)), F.greatest(last, F.lit(0)))))
    kind = segments.select(*group, order, "samples").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", _at long, _from long"

    def run(pdf):
        pdf = pdf.sort_values("_at", kind="stable")
        at, n, total, b = pdf["_at"].to_numpy(), pdf["_n"].to_numpy(), int(pdf["_total"].iloc[0]), int(pdf["_block"].iloc[0])
        x, start = np.concatenate(list(pdf["samples"])), int(at[0])
        half = int(min(total // 2, reach))
        left, right = max(start, b * block - half), min(start + len(x), (b + 1) * block + half)
        # reflected samples stand only at the ends of the group, or beyond this block's reach
        y = band_pass(x[left - start : right - start], fs, low, high, half)
        begin, end = np.maximum(at, b * block), np.minimum(at + n, (b + 1) * block)
        mine = (begin < end) | ((n == 0) & (np.clip(at, 0, max(total - 1, 0)) // block == b))
        pdf["samples"] = [y[max(i, 0) - left : max(j, i) - left] for i, j in zip(begin, end, strict=True)]
        pdf["_from"] = begin
        return pdf[mine][[*group, order, "samples", "_at", "_from"]]

    pieces = spread.groupBy(*group, "_block").applyInPandas(run, schema)
    parts = F.array_sort(F.collect_list(F.struct("_from", "samples")))
    whole = pieces.groupBy(*group, order, "_at").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))
    return whole.select(*group, order, "samples")


def at_rate(segments: DataFrame, keys: list[str], fs: float, to: float) -> DataFrame:
    """keys, samples at the rate `to` instead of `fs`, as a trained model asks: band-limited, an epoch at a time.

    Null segments stay null, as do those of fewer than two samples or with a sample that is null or not finite.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for samples in batch.column(len(keys)):
                x = np.array(samples.values.to_numpy(zero_copy_only=False), float) if samples.is_valid else np.zeros(0)
                out.append(resampled(x, to / fs) if len(x) > 1 and np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], [*keys, "samples"])

    typed = segments.select(*keys, F.col("samples").cast("array<double>").alias("samples"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema.fields)
    return typed.mapInArrow(run, schema)


#: Groups of features by what their names hold; a feature may have several.
TAGS = {"spectral": ["spectral", "psd", "sef", "centroid"], "entropy": ["entropy"], "complexity": ["lz", "higuchi", "dfa"], "wavelet": ["wavelet"], "rqa": ["rqa"], "acf": ["acf"], "aperiodic": ["aperiodic"], "hjorth": ["hjorth", "mobility"]}
TAGS |= {"statistical": ["statistical"], "canonical": ["canonical", "hist_mode"], "large_set": ["tsfresh"], "connectivity": ["connectivity", "gfp", "omega"], "graph": ["graph", "path_length"]}


def tagged(names: DataFrame, column: str = "name") -> DataFrame:
    """A row a name and tag that fits; names that fit none are tagged other."""
    fits = F.array_compact(F.array(*[F.when(F.lower(column).rlike("|".join(parts)), F.lit(tag)) for tag, parts in TAGS.items()]))
    return names.withColumn("tag", F.explode(F.when(F.size(fits) > 0, fits).otherwise(F.array(F.lit("other")))))


def strided(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Every k-th row of a group in order, k the least that leaves about `most`."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy(group)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    return df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_k", k).filter("_i % _k = 0").drop("_i", "_k")


def subsample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows at random without replacement, the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed))).limit(n)
