"""Kernels on an array of samples as built-in expressions: they run in generated or vectorised JVM code; the transform alone is numpy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def centred(a: Column, m: Column) -> Column:
    """a less m; m should be a column of its own, so that it is not computed once an element."""
    return F.transform(a, lambda x: x - m)


def moment(x: Column, k: int) -> Column:
    """k-th moment of centred samples, population form."""
    return mean(F.transform(x, lambda v: F.pow(v, F.lit(float(k)))))


def diff(a: Column) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda y, x: y - x)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rms(a: Column) -> Column:
    return F.sqrt(mean(F.transform(a, lambda x: x * x)))


def line_length(a: Column) -> Column:
    return total(F.transform(diff(a), F.abs))


def zero_crossing_rate(a: Column) -> Column:
    """Sign changes over the number of samples."""
    signs = F.transform(a, lambda x: F.when(x < 0, 1.0).otherwise(0.0))
    return F.try_divide(total(F.transform(diff(signs), F.abs)), F.size(a))


def padded_diff(a: Column) -> Column:
    return F.concat(F.array(F.lit(0.0)), diff(a))


def variance(a: Column) -> Column:
    n = F.size(a)
    return F.try_divide(total(F.transform(a, lambda v: v * v)) - F.try_divide(total(a) * total(a), n), n - 1)


def mobility(a: Column) -> Column:
    """Square root of the variance of the differences (a zero before them) over that of the samples."""
    return F.sqrt(F.try_divide(variance(padded_diff(a)), variance(a)))


def complexity(a: Column) -> Column:
    return F.try_divide(mobility(padded_diff(a)), mobility(a))


def lag_correlation(x: Column, lag: int) -> Column:
    """Autocorrelation at a lag over that at lag 0, of centred samples."""
    n = F.size(x)
    products = F.zip_with(F.slice(x, lag + 1, F.greatest(n - lag, F.lit(0))), F.slice(x, 1, F.greatest(n - lag, F.lit(0))), lambda p, q: p * q)
    return F.try_divide(total(products), total(F.transform(x, lambda v: v * v)))


def decimated(a: Column, by: int) -> Column:
    return F.filter(a, lambda x, i: i % by == 0)


def dft_power(segments: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """keys, k, power of bins first to last, one row a bin: the squared fast transform, one Arrow pass.

    A bin beyond half the samples is the mirror of one below. Null and empty segments have no rows.
    """
    import numpy as np
    import pyarrow as pa

    typed = segments.filter(F.size("samples") > 0).select(*keys, "samples")

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(len(keys)):
                f = np.abs(np.fft.fft(x.values.to_numpy(zero_copy_only=False).astype(float))) ** 2
                out.append(f[np.arange(first, last + 1) % len(f)])
            flat = pa.array(np.concatenate([*out, np.zeros(0)]))
            splits = np.arange(0, len(flat) + 1, last + 1 - first, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(splits, flat)], [*keys, "power"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema.fields[:-1])
    powers = typed.mapInArrow(run, f"{schema}, power array<double>").select(*keys, F.posexplode("power").alias("_i", "power"))
    return powers.select(*keys, (F.col("_i") + first).alias("k"), "power")
