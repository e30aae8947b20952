"""Several channels of a night: pairs, graphs, field power, regions and the choice of electrodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def pairs(signal: DataFrame, keys: list[str], channel: str, sample: str, value: str) -> DataFrame:
    """A row a sample and unordered pair of channels. A night has few channels; keys and sample are equi-joined."""
    a = signal.select(*keys, sample, F.col(channel).alias("ch_i"), F.col(value).alias("x"))
    b = signal.select(*keys, sample, F.col(channel).alias("ch_j"), F.col(value).alias("y"))
    return a.join(b, [*keys, sample]).filter("ch_i < ch_j")


def correlation_edges(signal: DataFrame, keys: list[str], channel: str, sample: str, value: str) -> DataFrame:
    made = pairs(signal, keys, channel, sample, value).groupBy(*keys, "ch_i", "ch_j")
    return made.agg(F.corr("x", "y").alias("value"), F.count("*").alias("n"))


def strong_edges(edges: DataFrame, keys: list[str], quantile: float = 0.8, whole: bool = False) -> DataFrame:
    """Edges of |value| above a quantile of a key's edges, or, whole, of its matrix: each edge twice and zeros on the diagonal."""
    w = W.Window.partitionBy(*keys)
    if not whole:
        return edges.withColumn("_t", F.percentile(F.abs("value"), F.lit(quantile)).over(w)).filter(F.abs("value") > F.col("_t"))
    nodes = edges.select(*keys, F.explode(F.array("ch_i", "ch_j")).alias("a")).distinct().select(*keys, F.lit(0.0).alias("v"), F.lit(1).alias("n"))
    entries = edges.select(*keys, F.abs("value").alias("v"), F.lit(2).alias("n")).unionByName(nodes).filter("v is not null")
    limits = entries.groupBy(*keys).agg(F.percentile("v", F.lit(quantile), F.col("n")).alias("_t"))  # a key has few channels
    return edges.join(limits, keys).filter(F.abs("value") > F.col("_t"))


def path_lengths(edges: DataFrame, keys: list[str], quantile: float = 0.8) -> DataFrame:
    """keys, largest, path_length: nodes of the largest component (of equal ones the one of the first channel) of the
    graph of strong edges, and the mean shortest path within it; no path for a single node.

    A key's graph is one task's: some hundreds of channels at most.
    """
    strong = strong_edges(edges, keys, quantile, whole=True).select(*keys, F.col("ch_i").alias("a"), F.col("ch_j").alias("b"))
    both = strong.unionByName(strong.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema)

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        names = sorted(set(pdf["a"]))
        at = {c: i for i, c in enumerate(names)}
        near = np.eye(len(names), dtype=bool)
        near[pdf["a"].map(at), pdf["b"].map(at)] = True
        reach, away = np.eye(len(names), dtype=bool), np.zeros((len(names), len(names)))
        steps = 0
        while True:
            new = (reach.astype(np.float32) @ near) > 0
            if (new == reach).all():
                break
            steps += 1
            away[new & ~reach] = steps
            reach = new
        sizes = reach.sum(1)
        mine = reach[sizes.argmax()]
        n = int(mine.sum())
        return pd.DataFrame([(*key, n, float(away[np.ix_(mine, mine)].sum() / (n * (n - 1))) if n > 1 else None)], columns=[*keys, "largest", "path_length"])

    return both.groupBy(*keys).applyInPandas(run, f"{schema}, largest int, path_length double")


def graph_metrics(edges: DataFrame, keys: list[str], quantile: float = 0.8, whole: bool = False) -> DataFrame:
    """Nodes, mean degree and mean local clustering of the graph of strong edges."""
    strong = strong_edges(edges, keys, quantile, whole)
    both = strong.select(*keys, F.col("ch_i").alias("a"), F.col("ch_j").alias("b"))
    both = both.union(both.select(*keys, "b", "a"))
    nodes = edges.select(*keys, F.explode(F.array("ch_i", "ch_j")).alias("a")).distinct()
    degree = nodes.join(both.groupBy(*keys, "a").agg(F.count("*").alias("d")), [*keys, "a"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    wedge = both.join(both.select(*keys, "a", F.col("b").alias("c")), [*keys, "a"]).filter("b < c")
    closed = wedge.join(both.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"), F.lit(1).alias("hit")), [*keys, "b", "c"])
    triangles = closed.groupBy(*keys, "a").agg(F.count("*").alias("t"))
    local = degree.join(triangles, [*keys, "a"], "left").withColumn("c", F.when(F.col("d") >= 2, F.coalesce("t", F.lit(0)) * 2.0 / (F.col("d") * (F.col("d") - 1))).otherwise(0.0))
    return local.groupBy(*keys).agg(F.count("*").alias("nodes"), F.avg("d").alias("mean_degree"), F.avg("c").alias("clustering"))


def global_field_power(signal: DataFrame, keys: list[str], sample: str, value: str) -> DataFrame:
    """Root mean square over channels of each sample, then the mean of a key."""
    field = signal.groupBy(*keys, sample).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("g"))
    return field.groupBy(*keys).agg(F.avg("g").alias("gfp_rms"))


def region_means(signal: DataFrame, regions: DataFrame, keys: list[str], channel: str, value: str) -> DataFrame:
    """Mean of the channels of a region; regions (channel, region) is a small dimension."""
    return signal.join(regions, channel).groupBy(*keys, "region").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def unit_sphere(electrodes: DataFrame) -> DataFrame:
    """x, y, z over their norm; a zero vector stays."""
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    by = F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))
    return electrodes.withColumns({c: F.col(c) / by for c in ("x", "y", "z")})


def region(x: Column, y: Column) -> Column:
    """The first that fits: frontal, occipital, temporal, parietal, else central."""
    return F.when(y > 0.3, "F").when(y < -0.5, "O").when(F.abs(x) > 0.5, "T").when(y <= -0.1, "P").otherwise("C")


def hemisphere_picks(electrodes: DataFrame, k: int, name: str = "name") -> DataFrame:
    """Of each half, k bins by descending y, and of each bin the electrode nearest to the bin's median of y and z."""
    side = F.when(F.col("x") < 0, "left").otherwise("right")
    w = W.Window.partitionBy("side")
    ranked = electrodes.withColumn("side", side).withColumn("_i", F.row_number().over(w.orderBy(F.desc("y"), name)) - 1).withColumn("_n", F.count("*").over(w))
    binned = ranked.withColumn("bin", F.floor(F.col("_i") * F.lit(k) / F.col("_n")).cast("int"))
    middle = binned.groupBy("side", "bin").agg(F.median("y").alias("_y"), F.median("z").alias("_z"))
    away = F.pow(F.col("y") - F.col("_y"), F.lit(2.0)) + F.pow(F.col("z") - F.col("_z"), F.lit(2.0))
    return binned.join(middle, ["side", "bin"]).groupBy("side", "bin").agg(F.min(F.struct(F.round(away, 9).alias("d"), name)).getField(name).alias(name))


def nearest_to_centres(electrodes: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """side, name: of each half k groups of electrodes by k-means on (y, z), and of each group the one nearest to its mean place."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["y", "z"], outputCol="_v").transform(electrodes.withColumn("side", F.when(F.col("x") < 0, "left").otherwise("right")))
    out = None
    for side in ("left", "right"):
        half = rows.filter(F.col("side") == side)
        if half.limit(k + 1).count() <= k:
            picked = half.select("side", "name")
        else:
            found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_g").fit(half).transform(half)
            middle = found.groupBy("_g").agg(*[F.avg(c).alias(f"_{c}") for c in ("x", "y", "z")])  # k rows
            away = sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2.0)) for c in ("x", "y", "z")), F.lit(0.0))
            picked = found.join(F.broadcast(middle), "_g").groupBy("side", "_g").agg(F.min(F.struct(F.round(away, 9).alias("d"), "name")).getField("name").alias("name")).select("side", "name")
        out = picked if out is None else out.unionByName(picked)
    return out
