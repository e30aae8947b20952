"""Quality control of feature tables, robust scaling, correlation and clustering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.schema import IQR_TO_SD, QC


def unpivoted(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("f")).select(*keys, "f.feature", "f.value")


def missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


def nan_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, n_missing, ratio, bucket: one pass of counts, turned to a row a feature."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(missing(F.col(c))).alias(c) for c in columns])
    long = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing")) for c in columns])).alias("f")).select("f.feature", "n", "f.n_missing")
    r = F.coalesce(F.try_divide(F.col("n_missing"), F.col("n")), F.lit(0.0))
    bucket = F.when(r == 0, "0").when(r <= 0.1, "0-10").when(r <= 0.3, "10-30").when(r <= 0.5, "30-50").when(r < 1, ">50").otherwise("100")
    return long.withColumn("ratio", r).withColumn("bucket", bucket)


CELLS = 4096
SKETCH_K, SKETCH_SLACK = 4096, 0.004  # a sketch of a few hundred KB a column; several times its error of rank
INF = float("inf")


def between_ranks(a: float, b: float, part: float) -> float:
    """The value `part` of the way from a to b; an infinite end rules, the lower one first."""
    if part == 0 or a == b or math.isinf(a):
        return a
    return b if math.isinf(b) else a + (b - a) * part


def exact_percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Percentiles between the two nearest ranks, exact, for each column; missing values do not count, infinities are ranks
    below and above all others.

    A mergeable quantile sketch brackets the wanted ranks in one scan. A second scan counts what lies below each bracket and
    what its cells hold; a bracket that does not hold its rank after all is widened to the whole range. Cells with a wanted rank
    are cut again, from their own least to their own largest value, until a cell holds one value; each is narrower than the
    one before, so that this ends. Every scan is one aggregation with map-side sums; the driver holds CELLS counts an interval.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    finite = {c: F.when(~missing(F.col(c)) & (F.abs(x) != INF), x) for c, x in value.items()}
    told = [F.struct(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_if(value[c] == -INF).alias("under"), F.count_if(value[c] == INF).alias("over"), F.kll_sketch_agg_double(x, SKETCH_K).alias("sketch")).alias(c) for c, x in finite.items()]
    summed = df.agg(*told)
    near = lambda c, q: F.when(F.col(f"{c}.n") > 0, F.kll_sketch_get_quantile_double(F.col(f"{c}.sketch"), F.lit(q)))
    ends = [F.array(*[near(f"`{c}`", min(1.0, max(0.0, q + d))) for q in shares for d in (-SKETCH_SLACK, SKETCH_SLACK)]).alias(f"{c}!") for c in columns]
    first = summed.select(*[F.struct(*[F.col(f"`{c}`.{k}") for k in ("n", "low", "high", "under", "over")]).alias(c) for c in columns], *ends).first()
    places = {c: [q * (first[c].n + first[c].under + first[c].over - 1) for q in shares] for c in columns if first[c].n + first[c].under + first[c].over}
    found: dict[tuple[str, int], float] = {}
    work, whole = [], []
    for c, ps in places.items():
        n, low, high, under, _ = first[c]
        for k, p in enumerate(ps):
            for r in (math.floor(p), math.ceil(p)):
                found |= {(c, r): -INF} if r < under else {(c, r): INF} if r >= under + n else {}
            ranks = {r - under for r in (math.floor(p), math.ceil(p)) if under <= r < under + n}
            if ranks:
                a, b = first[f"{c}!"][2 * k : 2 * k + 2]
                whole.append((c, low, high, 0, ranks))
                work.append((c, low if shares[k] <= SKETCH_SLACK else a, high if shares[k] >= 1 - SKETCH_SLACK else b, ranks))
    if work:
        below = df.agg(*[F.count_if(finite[c] < a).alias(f"a{i}") for i, (c, a, *_) in enumerate(work)], *[F.count_if(finite[c] <= b).alias(f"b{i}") for i, (c, _, b, _) in enumerate(work)]).first()
        work = [(c, a, b, below[f"a{i}"], ranks) if all(below[f"a{i}"] <= r < below[f"b{i}"] for r in ranks) else whole[i] for i, (c, a, b, ranks) in enumerate(work)]
    while work:
        found |= {(c, r + first[c].under): low for c, low, high, _, ranks in work if low == high for r in ranks}
        work = [w for w in work if w[1] != w[2]]
        if not work:
            break
        held = F.array_compact(F.array(*[F.when(finite[c].between(low, high), F.struct(F.lit(i).alias("i"), cell_of(finite[c], low, high).alias("cell"), finite[c].alias("v"))) for i, (c, low, high, *_) in enumerate(work)]))
        counted = df.select(F.explode(held).alias("h")).groupBy("h.i", "h.cell").agg(F.count("*").alias("n"), F.min("h.v").alias("low"), F.max("h.v").alias("high"))
        rows, new = sorted(counted.collect(), key=lambda r: (r.i, r.cell)), []
        for i, (c, _, _, before, ranks) in enumerate(work):
            for r in (r for r in rows if r.i == i):
                mine = {k for k in ranks if before <= k < before + r.n}
                if mine:
                    new.append((c, r.low, r.high, before, mine))
                before += r.n
        work = new
    out = {c: [None] * len(shares) for c in columns}
    for c, ps in places.items():
        out[c] = [between_ranks(found[c, math.floor(p)], found[c, math.ceil(p)], p - math.floor(p)) for p in ps]
    return out


def cell_of(x: Column, low: float, high: float) -> Column:
    """The cell of x between low and high; halves are compared where the range is beyond the largest number. The least and the largest part."""
    scale = 0.5 if math.isinf(high - low) else 1.0
    share = (x * scale - low * scale) / (high * scale - low * scale)
    return F.when(x == high, F.lit(CELLS)).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))


def apply_qc(df: DataFrame, columns: list[str], limits: dict = QC) -> tuple[DataFrame, list[str]]:
    """The five steps in order: sparse features, sparse rows, median imputation, flat features, rows of outliers.

    Each step's statistics are one aggregation; the driver sees a number a feature.
    """
    ratios = {r.feature: r.ratio for r in nan_profile(df, columns).collect()}
    kept = [c for c in columns if ratios[c] <= limits["feature_missing"]]
    if not kept:
        return df.limit(0), []
    gone = sum((missing(F.col(c)).cast("int") for c in kept), F.lit(0))
    df = df.filter(gone <= limits["row_missing"] * len(kept))
    clean = {c: F.when(~missing(F.col(c)), F.col(c).cast("double")) for c in kept}
    middle = exact_percentiles(df, kept, [0.5])
    df = df.withColumns({c: F.coalesce(x, F.lit(middle[c][0])) for c, x in clean.items()})
    spread = df.agg(*[F.var_samp(c).alias(c) for c in kept]).first()
    kept = [c for c in kept if (spread[c] or 0) >= limits["min_variance"]]
    if not kept:
        return df.limit(0), []
    quarts = exact_percentiles(df, kept, [0.25, 0.75])
    if quarts[kept[0]][0] is None:
        return df, kept
    out = F.lit(0)
    for c in kept:
        q1, q3 = quarts[c]
        reach = limits["iqr_factor"] * (q3 - q1)
        out = out + (~F.col(c).between(q1 - reach, q3 + reach)).cast("int")
    return df.filter(out <= int(limits["row_missing"] * len(kept))), kept


def fences(df: DataFrame, columns: list[str], factor: float = QC["iqr_factor"]) -> DataFrame:
    """feature, q1, q3, and the number of values beyond the fences."""
    long = unpivoted(df, columns, []).filter("value is not null")
    quarts = exact_percentiles(df, columns, [0.25, 0.75])
    q = df.sparkSession.createDataFrame([(c, *quarts[c]) for c in columns if quarts[c][0] is not None], "feature string, q1 double, q3 double")
    beyond = (F.col("value") < F.col("q1") - factor * (F.col("q3") - F.col("q1"))) | (F.col("value") > F.col("q3") + factor * (F.col("q3") - F.col("q1")))
    return long.join(F.broadcast(q), "feature").groupBy("feature").agg(F.max("q1").alias("q1"), F.max("q3").alias("q3"), F.count_if(beyond).alias("n_out"))  # a row a feature


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / (IQR / 1.349) with exact percentiles; a zero scale counts as 1."""
    quarts = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    scaled = lambda c, q1, q2, q3: (F.col(c) - F.lit(q2)) / F.lit((q3 - q1) / IQR_TO_SD or 1.0)
    return df.select(*[scaled(c, *quarts[c]).alias(c) if c in columns and quarts[c][0] is not None else F.col(c) for c in df.columns])


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, mean, sd, least, q1, median, q3, most: a row a feature."""
    quarts = exact_percentiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0])
    sums = df.agg(*[F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).alias(c) for c, x in ((c, F.when(~missing(F.col(c)), F.col(c).cast("double"))) for c in columns)]).first()
    rows = [(c, sums[c].n, sums[c]["mean"], sums[c].sd, *quarts[c]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, n long, mean double, sd double, least double, q1 double, median double, q3 double, most double")


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - least) / (most - least); a flat column is 0.5."""
    ends = df.agg(*[F.struct(F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("b")).alias(c) for c in columns]).first()

    def scaled(c):
        a, b = ends[c]
        if a is None:
            return F.col(c)
        return (F.when(F.col(c).isNotNull(), F.lit(0.5)) if a == b else (F.col(c) - a) / (b - a)).alias(c)

    return df.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def strong_pairs(df: DataFrame, columns: list[str], least: float = 0.8, top: int | None = None) -> DataFrame:
    """Pairs of features with |r| above a limit, the strongest first, with their rank."""
    w = W.Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.abs("r"), 9)), "feature_i", "feature_j")  # a row a pair of columns
    ranked = correlations(df, columns).filter(F.abs("r") > least).withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature_i, feature_j, r of each pair, in one aggregation."""
    named = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in named])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"), F.col(f"`{a}|{b}`").alias("r")) for a, b in named])).alias("p")).select("p.*")


def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of a bounded sample, each with chance by its squared distance from those before."""
    out = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        far = np.min([((sample - c) ** 2).sum(1) for c in out], 0)
        out.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))])
    return np.array(out)


def centre_sums(rows: DataFrame, columns: list[str], centres: dict[int, np.ndarray], weight: str | None = None) -> DataFrame:
    """start, cluster, n, cost and a sum a column of the rows nearest to each centre of each start: one scan for all starts.

    A row counts as often as weight says.
    """
    names = ["start", "cluster", "n", "cost", *(f"s{i}" for i in range(len(columns)))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros((len(c), 2 + len(columns))) for m, c in centres.items()}
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            times = batch.column(weight).to_numpy(zero_copy_only=False).astype(float) if weight else np.ones(x.shape[1])
            weighed = x * times
            for m, c in centres.items():
                at, far = np.zeros(x.shape[1], np.intp), (c**2).sum(1)[:, None] - 2 * (c @ x)
                least = far[0]
                for i in range(1, len(c)):
                    at[far[i] < least] = i
                    np.minimum(least, far[i], out=least)
                d = sum((v - c[:, j][at]) ** 2 for j, v in enumerate(x))
                sums[m] += np.column_stack([np.bincount(at, v, len(c)) for v in (times, times * d, *weighed)])
        told = [(m, i, *v) for m, c in sums.items() for i, v in enumerate(c.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k < 2 else pa.float64()) for k, v in enumerate(zip(*told, strict=True))], names)

    kind = "start int, cluster int, " + ", ".join(f"{c} double" for c in names[2:])
    return rows.mapInArrow(add, kind).groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in names[2:]])


def clustered(df: DataFrame, columns: list[str], k: int = 5, seeds: int = 20, seed: int = 42, rounds: int = 500, tolerance: float = 1e-4, sample: int = 10_000) -> tuple[DataFrame, float, Callable[[], float]]:
    """(rows with cluster, cost, silhouette): k-means from several starts, the least cost wins; rows with missing values are left out.

    All starts that still move share one scan a round: a task sums its rows a start and cluster, and only those sums meet.
    Equal rows are one row with a count, where that halves them or better. A
    start rests when its centres move less than `tolerance` of the mean variance. Centres begin in a bounded sample. The
    silhouette is a pass of its own, taken when it is called for: it comes as a function.
    """
    clean = df.filter(reduce(lambda a, b: a & b, [~missing(F.col(c)) for c in columns]))
    rows = clean.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()
    spread = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*columns)).alias("_distinct"), *[F.var_pop(c).alias(c) for c in columns]).first()
    if not spread.n:
        rows.unpersist()
        return clean.withColumn("cluster", F.lit(None).cast("int")), 0.0, lambda: 0.0
    h = F.xxhash64(*columns, F.lit(seed))  # the sample does not depend on how rows are dealt; about `sample` rows, cut at twice as many
    share = min(1.0, sample / spread.n)
    some = np.array(sorted(rows.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample).collect()) or rows.limit(sample).collect(), float)
    centres = {m: first_centres(some, k, np.random.default_rng((seed, m))) for m in range(seeds)}
    limit = tolerance * float(np.mean([spread[c] for c in columns]))
    if 2 * spread["_distinct"] <= spread.n:
        points, weight = rows.groupBy(*columns).agg(F.count("*").alias("_times")).persist(), "_times"
    else:
        points, weight = rows, None
    moving, cost = set(centres), {}
    for _ in range(rounds):
        new = {m: centres[m].copy() for m in moving}
        summed = centre_sums(points, columns, {m: centres[m] for m in moving}, weight).collect()  # starts * k rows
        for m in moving:
            cost[m] = sum(r.cost for r in summed if r.start == m)
        for r in summed:
            if r.n:  # an empty cluster keeps its centre
                new[r.start][r.cluster] = np.array(r[4:]) / r.n
        moving = {m for m in moving if ((new[m] - centres[m]) ** 2).sum() > limit}
        centres |= new
        if not moving:
            break
    final = centre_sums(points, columns, centres, weight).groupBy("start").agg(F.sum("cost").alias("cost")).collect()
    points.unpersist()
    rows.unpersist()
    least = min(r.cost for r in final)
    best = min((r for r in final if r.cost <= least * (1 + 1e-9)), key=lambda r: r.start)  # rounding does not choose
    square = [sum((F.pow(F.col(c).cast("double") - F.lit(float(v)), F.lit(2.0)) for c, v in zip(columns, one, strict=True)), F.lit(0.0)) for one in centres[best.start]]
    out = clean.withColumn("cluster", F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(square)]))["i"])
    silhouette = lambda: ClusteringEvaluator(featuresCol="_v", predictionCol="cluster").evaluate(VectorAssembler(inputCols=columns, outputCol="_v").transform(out))
    return out, best.cost, silhouette


def cluster_profile(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """cluster, feature, z, rank: how far a cluster's mean lies from the whole, in population deviations."""
    long = unpivoted(df, columns, ["cluster"])
    whole = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    by = long.groupBy("cluster", "feature").agg(F.avg("value").alias("c"))
    z = (F.col("c") - F.col("m")) / F.coalesce(F.nullif(F.col("s"), F.lit(0.0)), F.lit(1e-8))
    rated = by.join(F.broadcast(whole), "feature").select("cluster", "feature", z.alias("z"))  # a row a feature
    w = W.Window.partitionBy("cluster").orderBy(F.desc(F.round(F.abs("z"), 9)), "feature")
    return rated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def cluster_indices(df: DataFrame, columns: list[str]) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of a clustering, from sums a cluster."""
    centre = df.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_{c}") for c in columns])
    near = df.join(F.broadcast(centre), "cluster")  # a row a cluster
    square = sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2.0)) for c in columns), F.lit(0.0))
    inner = near.groupBy("cluster").agg(F.max("n").alias("n"), F.avg(F.sqrt(square)).alias("s"), F.sum(square).alias("w"), *[F.max(f"_{c}").alias(f"_{c}") for c in columns])
    other = inner.select(F.col("cluster").alias("d"), F.col("s").alias("t"), *[F.col(f"_{c}").alias(f"~{c}") for c in columns])
    gap = F.sqrt(sum((F.pow(F.col(f"_{c}") - F.col(f"~{c}"), F.lit(2.0)) for c in columns), F.lit(0.0)))
    worst = inner.join(other, F.col("cluster") != F.col("d")).groupBy("cluster").agg(F.max((F.col("s") + F.col("t")) / gap).alias("r"))
    grand = df.agg(*[F.avg(c).alias(f"g{c}") for c in columns])
    between = sum((F.pow(F.col(f"_{c}") - F.col(f"g{c}"), F.lit(2.0)) for c in columns), F.lit(0.0)) * F.col("n")
    sums = inner.join(grand).agg(F.sum(between).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    index = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return sums.join(worst.agg(F.avg("r").alias("davies_bouldin"))).select("davies_bouldin", index.alias("calinski_harabasz"))


def loadings(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """component, feature, loading, share: what each standardised feature weighs in a component, and the component's share
    of the variance. Of a component's two signs the one with a positive first loading."""
    rows = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(rows)
    parts = model.pc.toArray()
    told = [(i + 1, c, float(parts[j, i] * (1 if parts[0, i] >= 0 else -1)), float(model.explainedVariance[i])) for i in range(k) for j, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(told, "component int, feature string, loading double, share double")


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """(rows with pc array, shares of variance explained) of standardised features."""
    rows = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(rows)
    return model.transform(rows).withColumn("pc", vector_to_array("_p")).drop("_v", "_s", "_p"), list(model.explainedVariance)
