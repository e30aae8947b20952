"""Recurrence of segments as rows: near pairs of templates, their lines, and what the lines tell.

A segment of few templates stays a row, dealt out whole, and its pairs are compared in its task: neither templates nor
pairs move, and the work grows with the rows. Of longer segments, templates are rows. Pairs meet by the cell of their
first two values, cells being one radius wide, so that a template is compared with those of nine cells and not with its
whole segment; lines are islands over the near pairs. Every step is then a join or a window on the segment and a cell or
a line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Templates up to which a segment's pairs are compared in its task (32 MB a matrix of distances), and pairs held at once
#: where several such segments are taken together.
FEW_TEMPLATES, PAIRS_AT_ONCE = 2048, 1 << 16


def template_count(m: int, tau: int, decimate: int) -> Column:
    return F.ceil(F.size("samples") / decimate) - (m - 1) * tau


def sampled(segments: DataFrame, keys: list[str], decimate: int) -> DataFrame:
    """keys, _x: every `decimate`-th sample, as doubles; no segment that is null or has one that is null or not finite."""
    x = F.col("samples").cast("array<double>")
    s = segments.select(*keys, (F.filter(x, lambda _, i: i % decimate == 0) if decimate > 1 else x).alias("_x"))
    return s.filter(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))


def templates(segments: DataFrame, keys: list[str], m: int = 3, tau: int = 1, decimate: int = 1) -> DataFrame:
    """keys, i, t: the templates of m samples, tau apart, of every `decimate`-th sample; none of a segment that is null,
    too short or has a sample that is null or not finite."""
    s = sampled(segments.filter(template_count(m, tau, decimate) > 0), keys, decimate)
    places = s.select(*keys, "_x", F.explode(F.sequence(F.lit(0), F.size("_x") - (m - 1) * tau - 1)).alias("i"))
    return places.select(*keys, "i", F.array(*[F.col("_x")[F.col("i") + k * tau] for k in range(m)]).alias("t"))


def distance(a: Column, b: Column, m: int) -> Column:
    total = (a[0] - b[0]) * (a[0] - b[0])
    for k in range(1, m):
        total = total + (a[k] - b[k]) * (a[k] - b[k])
    return F.sqrt(total)


def diameters(points: DataFrame, keys: list[str], m: int = 3) -> DataFrame:
    """keys, n, diameter: the largest distance of two templates.

    With w the largest distance from the middle and d a distance that occurs, no template nearer the middle than d - w
    can be an end of the largest one: the others alone are compared. d is taken from the template farthest out.
    """
    w = W.Window.partitionBy(*keys)
    centre = F.array(*[F.avg(F.col("t")[k]).over(w) for k in range(m)])
    placed = points.dropna(subset=keys).select(*keys, "t", F.count("*").over(w).alias("n"), centre.alias("_c")).withColumn("_d", distance(F.col("t"), F.col("_c"), m)).drop("_c")
    seen = placed.withColumn("_far", F.max(F.struct("_d", "t")).over(w)).withColumn("_s", distance(F.col("t"), F.col("_far")["t"], m)).withColumn("_low", F.max("_s").over(w))
    low = seen.groupBy(*keys).agg(F.max("_low").alias("_low"), F.max("n").alias("n"))
    # the bound is loosened by more than rounding can take away
    ends = seen.filter(F.col("_d") >= F.col("_low") - F.col("_far")["_d"] - F.lit(1e-9) * F.col("_low")).select(*keys, "t").distinct()
    pairs = ends.join(ends.withColumnRenamed("t", "_u"), keys).filter("t < _u").withColumn("_e", distance(F.col("t"), F.col("_u"), m))
    widest = pairs.groupBy(*keys).agg(F.max("_e").alias("_widest"))
    return low.join(widest, keys, "left").select(*keys, "n", F.coalesce(F.greatest("_widest", "_low"), F.lit(0.0)).alias("diameter"))


def near_pairs(points: DataFrame, radii: DataFrame, keys: list[str], m: int = 3) -> DataFrame:
    """keys, i, j of the ordered pairs i <> j of templates within a segment's radius (radii: keys, radius, above 0).

    m is 2 or more: a grid is laid over the first two values of a template.
    """
    # cells a little wider than the radius, so that rounding puts no near pair two cells apart
    cell = lambda k: F.floor(F.col("t")[k] / (F.col("radius") * F.lit(1 + 1e-9))).cast("long")
    left = points.join(radii.select(*keys, "radius"), keys).select(*keys, "i", "t", "radius", cell(0).alias("_a"), cell(1).alias("_b"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    right = left.select(*keys, F.col("i").alias("j"), F.col("t").alias("_u"), "_a", "_b", F.explode(around).alias("_o"))
    right = right.select(*keys, "j", "_u", (F.col("_a") + F.col("_o.a")).alias("_a"), (F.col("_b") + F.col("_o.b")).alias("_b"))
    met = left.join(right, [*keys, "_a", "_b"]).filter("i <> j")
    return met.filter(distance(F.col("t"), F.col("_u"), m) <= F.col("radius")).select(*keys, "i", "j")


def lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (diagonal or vertical), length, count of the runs of near pairs along diagonals and columns."""
    both = F.array(F.struct(F.lit("diagonal").alias("kind"), (F.col("j") - F.col("i")).alias("line")), F.struct(F.lit("vertical").alias("kind"), F.col("j").alias("line")))
    w = W.Window.partitionBy(*keys, "kind", "line").orderBy("i")
    told = pairs.select(*keys, "i", F.explode(both).alias("l")).select(*keys, "i", "l.kind", "l.line")
    runs = told.withColumn("_run", F.col("i") - F.row_number().over(w)).groupBy(*keys, "kind", "line", "_run").agg(F.count("*").alias("length"))
    return runs.groupBy(*keys, "kind", "length").agg(F.count("*").alias("count"))


#: What the lines of a segment sum to: near pairs; pairs in and number of diagonal and of vertical lines; the longest
#: diagonal one; and count * log(count) over the lengths of diagonal ones.
SUMS = ["_points", "_dp", "_dn", "_vp", "_vn", "longest", "_clogc"]


def summed(told: DataFrame, keys: list[str], shortest: int) -> DataFrame:
    """keys, SUMS of lines (keys, kind, length, count)."""
    is_line = lambda kind: (F.col("kind") == kind) & (F.col("length") >= shortest)
    total = lambda kind, v: F.sum(F.when(is_line(kind), v))
    count, inside = F.col("count"), F.col("count") * F.col("length")
    found = [
        F.sum(F.when(F.col("kind") == "diagonal", inside)), total("diagonal", inside), total("diagonal", count), total("vertical", inside), total("vertical", count),
        F.max(F.when(is_line("diagonal"), F.col("length"))), total("diagonal", count * F.log(count)),
    ]
    return told.groupBy(*keys).agg(*[c.alias(name) for c, name in zip(found, SUMS, strict=True)])


def runs_by_length(near: np.ndarray) -> np.ndarray:
    """near: segments, lines, places. A row a segment: how many runs of True have each length from 0 on."""
    size, places = near.shape[0], near.shape[2]
    flat = np.pad(near, ((0, 0), (0, 0), (1, 1))).reshape(-1)
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    owner, length = edges[::2] // (near.shape[1] * (places + 2)), edges[1::2] - edges[::2]
    return np.bincount(owner * (places + 1) + length, minlength=size * (places + 1)).reshape(size, places + 1)


def compared(x: np.ndarray, m: int, tau: int, share: float, shortest: int) -> np.ndarray:
    """x: segments of equal length as rows. A row a segment: the diameter and SUMS, all pairs compared."""
    n = x.shape[1] - (m - 1) * tau
    total = np.zeros((len(x), n, n))
    with np.errstate(over="ignore"):
        for k in range(m):
            t = x[:, k * tau : k * tau + n]
            apart = t[:, :, None] - t[:, None, :]
            total += np.multiply(apart, apart, out=apart)
    d = np.sqrt(total, out=total)
    diameter = d.max((1, 2))
    near = np.pad(d <= (share * diameter)[:, None, None], ((0, 0), (0, 0), (0, n)))
    near[:, np.arange(n), np.arange(n)] = False
    # above the middle, place i of diagonal k is pair (i, i + k): one step down a row and one along it
    step = near.strides
    above = np.lib.stride_tricks.as_strided(near, (len(x), n, n), (step[0], step[2], step[1] + step[2]))
    diagonal, vertical = 2 * runs_by_length(above), runs_by_length(near[:, :, :n])
    length = np.arange(n + 1)
    line = length >= shortest
    longest = np.where((diagonal > 0) & line, length, 0).max(1)
    clogc = np.where(line, diagonal * np.log(np.maximum(diagonal, 1)), 0.0).sum(1)
    return np.stack([diameter, diagonal @ length, diagonal @ (length * line), diagonal @ line, vertical @ (length * line), vertical @ line, longest, clogc], 1)


def within_tasks(rows: DataFrame, keys: list[str], m: int, tau: int, share: float, shortest: int) -> DataFrame:
    """keys, n, diameter, SUMS of sampled segments of few templates, whose pairs are compared in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            flat, begin = lists.values.to_numpy(), lists.offsets.to_numpy()
            sizes, out = np.diff(begin), np.zeros((batch.num_rows, 1 + len(SUMS)))
            for size in np.unique(sizes):
                same, at_once = np.flatnonzero(sizes == size), max(1, PAIRS_AT_ONCE // int(size) ** 2)
                for some in (same[i : i + at_once] for i in range(0, len(same), at_once)):
                    out[some] = compared(flat[begin[some][:, None] + np.arange(size)], m, tau, share, shortest)
            whole = [pa.array(out[:, k].astype(np.int64)) for k in range(1, len(SUMS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes - (m - 1) * tau, pa.int64()), pa.array(out[:, 0]), *whole, pa.array(out[:, -1])], [*keys, "n", "diameter", *SUMS])

    # dealt by segment, so that a file of one row group is not one task
    typed = rows.select(*keys, "_x").repartition(*keys)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in typed.schema.fields[:-1])
    return typed.mapInArrow(run, schema + "n long, diameter double, " + ", ".join(f"{c} {'double' if c == '_clogc' else 'long'}" for c in SUMS))


def recurrence(segments: DataFrame, keys: list[str], m: int = 3, tau: int = 1, share: float = 0.1, shortest: int = 2, decimate: int = 5, few: int = FEW_TEMPLATES) -> DataFrame:
    """keys, n, rate, determinism, laminarity, longest, mean_length, trapping, entropy of each segment of ten templates or
    more whose templates differ; near is within `share` of their largest distance, and a line has `shortest` pairs or more.

    A segment without near pairs has rate 0 and nulls; entropy is that of the lengths of diagonals. keys tell segments
    apart: rows with a null key are left out, and rows of equal keys are not meant (short ones give a row each, long ones
    are one segment with repeated places). Segments of up to `few` templates are compared within their tasks, longer ones
    on the grid; what they give is the same.
    """
    n = template_count(m, tau, decimate)
    rows = segments.filter(n >= 10).dropna(subset=keys)
    short = within_tasks(sampled(rows.filter(n <= few), keys, decimate), keys, m, tau, share, shortest).filter("diameter > 0")
    points = templates(rows.filter(n > few), keys, m, tau, decimate)
    wide = diameters(points, keys, m).filter("diameter > 0").withColumn("radius", F.lit(share) * F.col("diameter"))
    long = wide.join(summed(lines(near_pairs(points, wide, keys, m), keys), keys, shortest), keys, "left").drop("radius")
    per = lambda c, of: c / F.nullif(F.col(of), F.lit(0))
    return short.unionByName(long).select(
        *keys, "n", (F.coalesce("_points", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("rate"), per(F.coalesce("_dp", F.lit(0)), "_points").alias("determinism"), per(F.coalesce("_vp", F.lit(0)), "_points").alias("laminarity"),
        F.nullif(F.col("longest"), F.lit(0)).alias("longest"), per(F.col("_dp"), "_dn").alias("mean_length"), per(F.col("_vp"), "_vn").alias("trapping"), (F.log(F.nullif(F.col("_dn"), F.lit(0))) - per(F.col("_clogc"), "_dn")).alias("entropy"),
    )
