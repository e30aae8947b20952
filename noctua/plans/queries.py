"""Queries over the fixture tables, by name: each applies operators of the library to whole tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noctua.functions import segments as sg
from noctua.operators import channels, connectivity, epoching, events, features, microstates, models, nightly, quality, recurrence, spectral, staging
from noctua.functions.kernels import BANDS
from noctua.plans.fixtures import feature_rows, night_series, segments, stage_stream, table
from noctua.schema import PAIR_BANDS, PSD_SECONDS
from noctua.sources import bundles, recording, records, tables
from noctua.sources.folders import shared_folder
from noctua.streaming import ledger, streams

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# hypnograms


@query
def nightly_sleep_metrics(spark, sf):
    m = staging.nightly_metrics(stage_stream(spark, sf), "night")
    return m.select("night", "n_epochs", *[r6(c).alias(c) for c in m.columns if c not in ("night", "n_epochs")])


@query
def stage_label_join(spark, sf):
    return stage_stream(spark, sf).select("night", F.col("epoch").cast("long").alias("epoch"), staging.stage_name(F.col("stage")).alias("label"))


@query
def stage_distribution_pct(spark, sf):
    return staging.stage_counts(stage_stream(spark, sf), "night").select("night", "stage", "n", r6("pct").alias("pct"), "pct_text")


@query
def stage_matrix(spark, sf):
    m = staging.stage_matrix(stage_stream(spark, sf), "night")
    return m.select("night", *[r6(c).alias(c) for c in m.columns[1:]])


@query
def stage_transition_matrix(spark, sf):
    return staging.transitions(stage_stream(spark, sf), "night")


@query
def stage_runs(spark, sf):
    found = staging.runs(stage_stream(spark, sf), ["night"], "stage", "epoch")
    return found.select("night", "stage", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "length")


@query
def stage_run_metrics(spark, sf):
    m = staging.run_metrics(staging.runs(stage_stream(spark, sf), ["night"], "stage", "epoch"), "night", "stage", 30.0)
    return m.select("night", "stage", *[r6(c).alias(c) for c in ("coverage", "mean_duration_s", "onsets_per_min")])


@query
def trim_leading_wake(spark, sf):
    return epoching.without_leading_wake(stage_stream(spark, sf), "night").select("night", F.col("epoch").cast("long").alias("epoch"), "stage")


@query
def sleep_dashboard(spark, sf):
    d = staging.dashboard(staging.nightly_metrics(stage_stream(spark, sf), "night"))
    return d.select("metric", r6("mean").alias("mean"), r6("sd").alias("sd"), "nights")


# epochs


@query
def epoch_tumbling_stats(spark, sf):
    e = epoching.tumbling(stage_stream(spark, sf).withColumnRenamed("epoch", "idx"), "night", 10).groupBy("night", "epoch")
    return e.agg(r6(F.avg("value")).alias("mean"), r6(F.var_pop("value")).alias("var"), r6(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"), F.count("*").alias("n"))


@query
def epoch_sliding_mean(spark, sf):
    s = segments(spark, sf).select("epoch", F.posexplode(epoching.sliding(F.col("samples"), 16, 8)).alias("win", "w"))
    return s.select("epoch", "win", r6(sg.mean(F.col("w"))).alias("mean"))


@query
def epoch_range_window(spark, sf):
    w = W.Window.partitionBy("night").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return stage_stream(spark, sf).select("night", F.col("epoch").cast("long").alias("epoch"), F.count("*").over(w).alias("n"), r6(F.avg("value").over(w)).alias("mean"))


@query
def centred_rolling_mean(spark, sf):
    s = stage_stream(spark, sf).withColumn("m", epoching.rolling("value", "night", 10, 9, "epoch"))
    return s.select("night", F.col("epoch").cast("long").alias("epoch"), r6("m").alias("m"))


@query
def epoch_gap_fill(spark, sf):
    e = stage_stream(spark, sf).withColumn("epoch", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 43_200_000_000).cast("long"))
    e = e.groupBy("night", "epoch").agg(F.avg("value").alias("value"), F.max("stage").alias("stage"))
    return epoching.filled(e, "night", {"stage": 0}).select("night", "epoch", "stage", r6("value").alias("value"), "is_gap")


@query
def segment_gap_detect(spark, sf):
    s = stage_stream(spark, sf).withColumn("seconds", F.col("value"))
    return epoching.gaps(s, "night", "ts", "seconds").select("night", F.col("epoch").cast("long").alias("epoch"), F.round("gap_seconds", 3).alias("gap_seconds"), F.ceil(F.round(F.greatest("gap_seconds", F.lit(0.0)), 3) / 30).alias("gap_epochs"))


@query
def stage_epoch_align(spark, sf):
    stages = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("stage"))
    return epoching.aligned_stages(table(spark, sf, "documents").select("doc_id"), stages, "doc_id").select("doc_id", "stage")


@query
def window_to_epoch_counts(spark, sf):
    w = stage_stream(spark, sf).withColumnRenamed("epoch", "win")
    e = epoching.windows_to_epochs(w, "night", 7)
    return e.groupBy("night", "epoch").agg(*[F.count_if(F.col("stage") == k).alias(f"c{k}") for k in range(5)])


@query
def segment_renumber(spark, sf):
    a = table(spark, sf, "events").select("user_id", "ts", "event_id", F.lit("a").alias("segment")).filter("event_id % 2 = 0")
    b = table(spark, sf, "events").select("user_id", "ts", "event_id").filter("event_id % 2 = 1")
    both = a.unionByName(b, allowMissingColumns=True).withColumn("segment", F.coalesce("segment", F.lit("gap")))
    return epoching.renumbered(both, "user_id", "segment", "ts", "event_id").select("user_id", "segment", "event_id", F.col("epoch").cast("long").alias("epoch"))


@query
def time_slices(spark, sf):
    s = stage_stream(spark, sf).select("night", F.window(F.col("ts").cast("timestamp"), "600 seconds").alias("w"), "value")
    return s.groupBy("night", F.unix_seconds("w.start").alias("start")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query
def date_parts(spark, sf):
    t = F.col("ts")
    return table(spark, sf, "events").select("event_id", F.date_format(t, "yyyy-MM-dd").alias("date"), F.date_format(t, "HH:mm:ss").alias("time"), F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"))


# catalogues and state


@query
def recording_catalog(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^(https?)://([^/?#]*)/([a-z]+)/([0-9]+)", 0).alias("name"), *[F.regexp_extract("url", r"^(https?)://([^/?#]*)/([a-z]+)/([0-9]+)", k).alias(n) for k, n in ((2, "host"), (3, "lang"), (4, "num"))])
    w = W.Window.partitionBy("host", "lang", "num").orderBy("page_id")
    kept = p.filter("name <> ''").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return kept.select("page_id", "host", "lang", F.col("num").cast("long").alias("num"))


@query
def file_precedence_antijoin(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", F.lit("csv").alias("kind")), table(spark, sf, "labels").select("doc_id", F.lit("pkl").alias("kind"))
    return labels.unionByName(docs.join(labels.select("doc_id"), "doc_id", "left_anti"))


@query
def resume_not_done(spark, sf):
    done = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti")


@query
def latest_per_key(spark, sf):
    w = W.Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_type", "event_id", r6("value").alias("value"))


# segments


@query
def seg_moments(spark, sf):
    s = segments(spark, sf).filter(sg.finite(F.col("samples"))).withColumn("m", sg.mean(F.col("samples"))).withColumn("x", sg.centred(F.col("samples"), F.col("m")))
    s = s.select("epoch", "m", sg.rms(F.col("samples")).alias("rms"), *[sg.moment(F.col("x"), k).alias(f"m{k}") for k in (2, 3, 4)])
    return s.select("epoch", r6("m").alias("mean"), r6("m2").alias("variance"), r6(F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5)))).alias("skewness"), r6(F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")) - 3).alias("kurtosis"), r6("rms").alias("rms"))


@query
def seg_line_length_zcr(spark, sf):
    return segments(spark, sf).select("epoch", r6(sg.line_length(F.col("samples"))).alias("line_length"), r6(sg.zero_crossing_rate(F.col("samples"))).alias("zcr"))


@query
def hjorth(spark, sf):
    s = F.col("samples")
    return segments(spark, sf).select("epoch", r6(sg.mobility(s)).alias("mobility"), r6(sg.complexity(s)).alias("complexity"))


@query
def acf_lag_features(spark, sf):
    s = segments(spark, sf).withColumn("m", sg.mean(F.col("samples"))).withColumn("x", sg.centred(F.col("samples"), F.col("m")))
    return s.select("epoch", *[r6(sg.lag_correlation(F.col("x"), k)).alias(f"acf_lag{k}") for k in (1, 10)])


def powers(spark, sf, last=32):
    return sg.dft_power(segments(spark, sf).select("epoch", "samples"), ["epoch"], 1, last)


@query
def dft_band_power(spark, sf):
    b = spectral.band_power(powers(spark, sf), ["epoch"])
    return b.select("epoch", *[r6(c).alias(c) for c in b.columns[1:]])


@query
def spectral_entropy(spark, sf):
    return spectral.spectral_entropy(powers(spark, sf), ["epoch"]).select("epoch", r6("entropy").alias("entropy"))


@query
def spectral_moments_sef(spark, sf):
    m = spectral.spectral_moments(powers(spark, sf), ["epoch"])
    return m.select("epoch", *[r6(c).alias(c) for c in ("centroid", "spread", "sef50", "sef90", "sef95")])


@query
def loglog_slope(spark, sf):
    f = spectral.log_log_fit(powers(spark, sf), ["epoch"])
    return f.select("epoch", *[r6(c).alias(c) for c in ("slope", "intercept", "beta")], "bins")


@query
def permutation_entropy(spark, sf):
    return spectral.permutation_entropy(stage_stream(spark, sf), "night", "epoch", "value").select("night", r6("entropy").alias("entropy"))


# channels


def channel_signal(spark, sf):
    """night (month), sample (hour), channel (event type), value."""
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM").alias("night"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).cast("long").alias("sample"), F.col("event_type").alias("channel"), "value")
    return e.groupBy("night", "sample", "channel").agg(F.avg("value").alias("value"))


@query
def channel_corr_pairs(spark, sf):
    return channels.correlation_edges(channel_signal(spark, sf), ["night"], "channel", "sample", "value").select("night", "ch_i", "ch_j", r6("value").alias("value"), "n")


@query
def graph_degree_clustering(spark, sf):
    e = channels.correlation_edges(channel_signal(spark, sf), ["night"], "channel", "sample", "value").withColumn("value", F.round("value", 9))
    g = channels.graph_metrics(e, ["night"], 0.4)
    return g.select("night", "nodes", r6("mean_degree").alias("mean_degree"), r6("clustering").alias("clustering"))


@query
def gfp_rms(spark, sf):
    return channels.global_field_power(channel_signal(spark, sf), ["night"], "sample", "value").select("night", r6("gfp_rms").alias("gfp_rms"))


@query
def roi_mean(spark, sf):
    regions = spark.createDataFrame([("click", "front"), ("view", "front"), ("purchase", "back"), ("signup", "back")], "channel string, region string")
    return channels.region_means(channel_signal(spark, sf), F.broadcast(regions), ["night", "sample"], "channel", "value").select("night", "sample", "region", r6("mean").alias("mean"), "n")


def electrodes(spark, sf):
    c = table(spark, sf, "customer")
    at = lambda k, n: (F.col("c_custkey") * k % n) / F.lit(n / 2.0) - 1
    return c.select(F.col("c_name").alias("name"), at(37, 201).alias("x"), at(53, 301).alias("y"), at(71, 401).alias("z"))


@query
def rank_bin_channel_pick(spark, sf):
    return channels.hemisphere_picks(electrodes(spark, sf), 5)


@query
def region_case(spark, sf):
    e = channels.unit_sphere(electrodes(spark, sf))
    return e.groupBy(channels.region(F.round("x", 9), F.round("y", 9)).alias("region")).agg(F.count("*").alias("n"))


# detected events


def event_windows(spark, sf):
    s = stage_stream(spark, sf)
    label = F.element_at(F.array(*map(F.lit, ["SS", "KC", "SW", "SAW", "VSW"])), F.col("stage") + 1)
    return s.select("night", F.col("epoch").alias("win"), label.alias("label"), (F.floor(F.col("value") * 1000).cast("long") % 100 / F.lit(100.0)).alias("proba"))


@query
def event_intervals(spark, sf):
    i = events.event_intervals(event_windows(spark, sf), "night", 0.2)
    return i.select("night", "label", "start", "end", "duration", r6("predict_proba").alias("predict_proba"))


@query
def event_describe(spark, sf):
    t = spark.createDataFrame([("SS", 0.6), ("KC", 0.3)], "label string, threshold double")
    i = events.event_intervals(event_windows(spark, sf), "night", 0.2).withColumn("predict_proba", F.round("predict_proba", 9))
    d = events.described(events.above_thresholds(i, F.broadcast(t)))
    return d.select("label", "n", r6("mean_proba").alias("mean_proba"), r6("percentage").alias("percentage"))


@query
def annotation_json(spark, sf):
    a = events.annotations(events.event_intervals(event_windows(spark, sf), "night", 0.2), "night")
    return a.select("night", "label", "start", "id", F.get_json_object("body", "$.value.label").alias("body_label"), F.get_json_object("body", "$.value.end").cast("long").alias("body_end"))


# across nights


@query
def nightly_acf(spark, sf):
    a = nightly.acf(night_series(spark, sf), "n")
    return a.select("lag", r6("acf").alias("acf"), r6("bound").alias("bound"), "significant")


@query
def nightly_pacf(spark, sf):
    return nightly.pacf(night_series(spark, sf), "n").select("lag", r6("pacf").alias("pacf"))


@query
def nightly_ccf(spark, sf):
    return nightly.ccf(night_series(spark, sf), "n", "mean").select("lag", r6("r").alias("r"), "n")


@query
def weekly_rhythm(spark, sf):
    return nightly.weekly_rhythm(night_series(spark, sf), "n")


@query
def weekly_rhythm_lag7(spark, sf):
    return nightly.acf(night_series(spark, sf), "n", 7).filter("lag = 7").select(r6("acf").alias("r7"))


@query
def rolling_autocorr(spark, sf):
    return nightly.rolling_acf(night_series(spark, sf), "total", 1).select(F.col("idx").cast("long").alias("idx"), "lag", r6("r").alias("r"))


@query
def autocorr_report(spark, sf):
    r = nightly.report(night_series(spark, sf), ["n", "mean"])
    return r.select("metric", r6("mean").alias("mean"), r6("sd").alias("sd"), *[r6(f"acf{k}").alias(f"acf{k}") for k in (1, 3, 7, 14)], *[f"sig{k}" for k in (1, 3, 7, 14)])


# quality and clusters

FEATURES = ["quantity", "price", "discount", "tax"]


@query
def nan_profile(spark, sf):
    return quality.nan_profile(feature_rows(spark, sf), FEATURES).select("feature", "n", "n_missing", r6("ratio").alias("ratio"), "bucket")


@query
def qc_iqr_outliers(spark, sf):
    return quality.fences(feature_rows(spark, sf), FEATURES, 0.5).select("feature", r6("q1").alias("q1"), r6("q3").alias("q3"), "n_out")


@query
def qc_median_impute(spark, sf):
    rows, kept = quality.apply_qc(feature_rows(spark, sf), FEATURES)
    return rows.groupBy("grp").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in kept])


@query
def robust_scale(spark, sf):
    s = quality.robust_scaled(feature_rows(spark, sf).select("night", "epoch", "price", "tax"), ["price", "tax"])
    return s.select("night", "epoch", r6("price").alias("price"), r6("tax").alias("tax"))


@query
def feature_corr_pairs(spark, sf):
    return quality.correlations(feature_rows(spark, sf), FEATURES).select("feature_i", "feature_j", r6("r").alias("r"))


@query
def cluster_profile(spark, sf):
    p = quality.cluster_profile(feature_rows(spark, sf).withColumnRenamed("grp", "cluster"), ["price", "tax"], 2)
    return p.select("cluster", "feature", r6("z").alias("z"), "rank")


@query
def kmeans_clusters(spark, sf):
    rows, _, _ = quality.clustered(feature_rows(spark, sf).select("night", "epoch", "price", "tax"), ["price", "tax"])
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("price").alias("price"))


@query
def cluster_indices(spark, sf):
    i = quality.cluster_indices(feature_rows(spark, sf).withColumnRenamed("grp", "cluster"), ["price", "tax"])
    return i.select(r6("davies_bouldin").alias("davies_bouldin"), r6("calinski_harabasz").alias("calinski_harabasz"))


@query
def cluster_by_group(spark, sf):
    f = feature_rows(spark, sf).select("grp", (F.col("epoch") % 3).alias("cluster"))
    n = f.groupBy("cluster", "grp").agg(F.count("*").alias("n"))
    return n.select("cluster", "grp", r6(staging.percent(F.col("n"), F.sum("n").over(W.Window.partitionBy("cluster")))).alias("pct"))


@query
def pca_overview(spark, sf):
    rows, _ = quality.principal_components(feature_rows(spark, sf).select("night", "epoch", "price", "tax"), ["price", "tax"], 2)
    return rows.select("night", "epoch", F.abs(F.col("pc")[0]).alias("pc1"))


@query
def feature_histogram(spark, sf):
    b = F.width_bucket("price", F.lit(0.0), F.lit(120000.0), F.lit(50))
    return feature_rows(spark, sf).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


# relational shapes that the domain gets from Spark as they are


@query
def cube_rollup(spark, sf):
    return stage_stream(spark, sf).cube("night", "stage").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def joins_semi_anti(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    rich = customers.filter("c_acctbal > 5000")
    semi, anti = orders.join(rich, orders.o_custkey == rich.c_custkey, "left_semi"), orders.join(rich, orders.o_custkey == rich.c_custkey, "left_anti")
    count = lambda d, k: d.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k))
    return count(semi, "semi").unionByName(count(anti, "anti"))


@query
def set_ops(spark, sf):
    a, b = table(spark, sf, "events").select("user_id"), table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    one = lambda d, k: d.agg(F.count("*").alias("n"), F.sum("user_id").alias("total")).withColumn("op", F.lit(k))
    return one(a.union(b).distinct(), "union").unionByName(one(a.intersect(b), "intersect")).unionByName(one(a.subtract(b), "except"))


@query
def topk_per_group(spark, sf):
    w = W.Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("o_orderstatus", "rank", "o_orderkey")


# numpy kernels, one Arrow pass


@query
def segment_kernels(spark, sf):
    return features.extract(segments(spark, sf), ["night", "epoch"], fs=64.0)


@query
def segment_kernels_long(spark, sf):
    wide = features.extract(segments(spark, sf), ["night", "epoch"], ["sample_entropy", "lempel_ziv", "higuchi", "detrended_fluctuation"], fs=64.0)
    return features.long_form(wide, ["night", "epoch"])


def template_pairs(s: DataFrame) -> DataFrame:
    """Pairs of similar templates of three samples of each array of samples."""
    n = F.size("samples")
    r = s.select("epoch", "samples", (F.lit(0.2) * F.sqrt(sg.variance(F.col("samples")) * (n - 1) / n)).alias("r"))
    t = r.select("epoch", "r", F.posexplode(epoching.sliding(F.col("samples"), 3, 1)).alias("i", "t"))
    o = t.select("epoch", F.col("i").alias("j"), F.col("t").alias("u"))
    near = t.join(o, "epoch").filter("i < j").filter(F.greatest(*[F.abs(F.col("t")[k] - F.col("u")[k]) for k in range(3)]) < F.col("r"))
    return near.groupBy("epoch").agg(F.count("*").alias("pairs"))


@query
def sample_entropy_pairs(spark, sf):
    return template_pairs(segments(spark, sf))


@query
def sample_entropy_pairs_whole(spark, sf):
    """As sample_entropy_pairs, which took half of each segment in the first round; the name stays."""
    return template_pairs(segments(spark, sf))


def long_epochs(spark, sf, most=16):
    """night, epoch, samples: the segments of a label, up to 16 in a row, as one epoch of 1,024 samples."""
    w = W.Window.partitionBy("night").orderBy("vec")
    s = segments(spark, sf).withColumnRenamed("epoch", "vec")
    s = s.join(s.select("night", "vec", F.floor((F.row_number().over(w) - 1) / most).cast("int").alias("epoch")), ["night", "vec"])
    parts = F.array_sort(F.collect_list(F.struct("vec", "samples")))
    return s.groupBy("night", "epoch").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))


@query
def long_epoch_entropies(spark, sf):
    """Sample and approximate entropy of long epochs, whose near templates are counted and not enumerated."""
    e = features.extract(long_epochs(spark, sf), ["night", "epoch"], ["sample_entropy", "approximate_entropy"], fs=64.0)
    return e.select("night", "epoch", r6("sample_entropy").alias("sample_entropy"), r6("approximate_entropy").alias("approximate_entropy"))


@query
def recurrence_lines(spark, sf):
    """Recurrence of every segment, all its samples, near within three tenths of the largest distance."""
    r = recurrence.recurrence(segments(spark, sf), ["epoch"], share=0.3, decimate=1)
    return r.select("epoch", "n", r6("rate").alias("rate"), *[r6(c).alias(c) for c in ("determinism", "laminarity", "mean_length", "trapping", "entropy")], "longest")


def channel_segments(spark, sf):
    """night, epoch, channel, samples: the segments of a label, five at a time, as the channels of an epoch."""
    w = W.Window.partitionBy("night").orderBy("epoch")
    s = segments(spark, sf).withColumn("i", F.row_number().over(w) - 1)
    return s.select("night", F.floor(F.col("i") / 5).cast("int").alias("epoch"), F.concat(F.lit("E"), F.col("i") % 5 + 1).alias("channel"), "samples")


@query
def channel_connectivity(spark, sf):
    return connectivity.connectivity(channel_segments(spark, sf), ["night", "epoch"], fs=64.0)


@query
def channel_granger(spark, sf):
    return connectivity.granger(channel_segments(spark, sf), ["night", "epoch"]).drop("band")


@query
def channel_granger_bands(spark, sf):
    """F of each ordered pair of channels in each band that 64 Hz can hold."""
    bands = {b: e for b, e in PAIR_BANDS.items() if e[1] < 32}
    return connectivity.granger(channel_segments(spark, sf), ["night", "epoch"], bands=bands, fs=64.0)


@query
def channel_spatial(spark, sf):
    return connectivity.spatial(channel_segments(spark, sf), ["night", "epoch"])


@query
def recording_microstates(spark, sf):
    """Coverage, duration and occurrence of the four states of each label's whole signal of five channels.

    The signal is noise, whose maps settle slowly: the tolerance is 1e-4.
    """
    _, runs = microstates.segmented(channel_segments(spark, sf), ["night"], "epoch", tolerance=1e-4)
    m = microstates.state_metrics(runs, ["night"], "epoch", 64.0)
    return m.select("night", "state", "samples", r6("coverage").alias("coverage"), "runs", r6("mean_duration_s").alias("mean_duration_s"), r6("per_second").alias("per_second"))


@query
def band_passed_segments(spark, sf):
    f = features.filtered(segments(spark, sf), ["night"], "epoch", 1.0, 20.0, 64.0)
    return f.select("night", "epoch", F.posexplode("samples").alias("i", "v")).select("night", "epoch", "i", r6("v").alias("v"))


# streams, drained


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


@query
def stream_window_avg(spark, sf):
    w = streams.drained(streams.windowed(event_stream(spark, sf), ["event_type"], "ts", "value", "6 hours"), "complete")
    return w.select("event_type", F.unix_seconds("w.start").alias("start"), "n", F.round("total", 2).alias("total"))


@query
def stream_sliding_count(spark, sf):
    w = streams.drained(streams.windowed(event_stream(spark, sf), ["event_type"], "ts", "value", "2 hours", "1 hour"), "complete")
    return w.select("event_type", F.unix_seconds("w.start").alias("start"), "n")


@query
def stream_session(spark, sf):
    s = streams.drained(streams.sessions(event_stream(spark, sf), ["user_id"], "ts", "2 hours"), "complete")
    return s.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


@query
def stream_dedupe(spark, sf):
    return streams.drained(streams.once(event_stream(spark, sf), ["event_id"], "ts")).select("event_id", "user_id")


@query
def stream_gap_detect(spark, sf):
    events = streams.closed(event_stream(spark, sf).select("user_id", "ts"), "ts")
    return streams.drained(streams.stream_gaps(events, "user_id", "ts", 6 * 3600.0)).select("user_id", "start", F.round("gap_s", 3).alias("gap_s"))


# models, groups and samples


@query
def event_model_predict(spark, sf):
    """A stand-in of two classes: the share of a window's power in its differences."""
    def model(x):
        p = 1 / (1 + np.exp(-(x**2).mean(1) * 10))
        return np.stack([p, 1 - p], 1)

    return models.predict(segments(spark, sf), ["night", "epoch"], model, 16, 16).select("night", "epoch", "win", "cls")


@query
def roi_groups(spark, sf):
    return models.roi_groups(electrodes(spark, sf), 25).groupBy("roi").agg(F.count("*").alias("n"))


@query
def feature_tags(spark, sf):
    names = table(spark, sf, "events").select(F.concat(F.element_at(F.array(*map(F.lit, ["psd_", "acf_", "lz_", "rqa_", "x_"])), (F.col("event_id") % 5 + 1).cast("int")), F.col("event_type")).alias("name")).distinct()
    return features.tagged(names)


@query
def stride_subsample(spark, sf):
    return features.strided(stage_stream(spark, sf), "night", "epoch", 20).select("night", F.col("epoch").cast("long").alias("epoch"))


@query
def random_subsample(spark, sf):
    return features.subsample(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 500)


# stored tables, written and read again


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/noctua/query-{uuid.uuid4().hex}"


def few_nights(spark, sf):
    """night (8), epoch, price, tax."""
    f = table(spark, sf, "lineitem")
    return f.select((F.col("l_orderkey") % 8).cast("int").alias("night"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("epoch"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_tax").cast("double").alias("tax"))


@query
def recording_parts(spark, sf):
    """The catalogue of recordings whose names are made of the events."""
    e = table(spark, sf, "events")
    name = F.format_string("Subject-%d%s_%s.mff", F.col("user_id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise(""), F.date_format("ts", "yyyyMMdd_HHmm00"))
    paths = e.select(F.concat(F.lit("/recordings/"), F.when(F.col("event_id") % 11 == 0, "broken.mff").otherwise(name)).alias("path"), F.col("event_id").alias("source"))
    return recording.catalog(paths).select("night", "suffix", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start"), "name", "source")


@query
def feature_folder_load(spark, sf):
    """Nights as Parquet and as csv, some as both: then the csv rows, which differ, are left out."""
    path, f = scratch(spark), few_nights(spark, sf)
    tables.write_features(f.filter("night % 2 = 0"), f"{path}/binary")
    tables.write_features(f.filter("night % 3 = 0 or night % 2 = 1").withColumn("price", F.col("price") + 1000).withColumn("Unnamed: 0", F.lit(1)), f"{path}/text", "csv")
    got = tables.load_features(spark, f"{path}/binary", f"{path}/text")
    return got.groupBy("night").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(c) for c in tables.feature_columns(got)])


@query
def preferred_feature_files(spark, sf):
    p = table(spark, sf, "events").select(F.format_string("/features/features_night%d.%s", F.col("user_id"), F.when(F.col("event_type") == "click", "parquet").otherwise("csv")).alias("path")).distinct()
    return tables.preferred_files(p)


@query
def pipeline_csv_scan(spark, sf):
    path = scratch(spark)
    tables.write_features(few_nights(spark, sf), path, "csv", "%.6g")
    return tables.load_pipeline_csv(spark, path).groupBy("night").agg(F.count("*").alias("n"), F.round(F.sum("tax"), 4).alias("tax"))


def results(spark, sf):
    """night, ok, n_epochs, n_gaps, start: a batch's nightly results; some failed, some without epochs."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("night")).agg(F.count_if(F.col("event_type") != "error").alias("n_epochs"), F.count_if(F.col("event_type") == "error").alias("n_gaps"))
    return e.withColumn("ok", F.when(F.col("night") % 5 != 0, F.col("night") % 7 != 0))


@query
def nightly_results_load(spark, sf):
    path = scratch(spark)
    recording.write_nights(results(spark, sf), path)
    return tables.succeeded(spark.read.parquet(path)).select(F.col("night").cast("long").alias("night"), "n_epochs", "n_gaps")


@query
def batch_totals(spark, sf):
    return tables.batch_totals(results(spark, sf))


@query
def nights_in_order(spark, sf):
    starts = table(spark, sf, "events").filter("user_id % 3 <> 0").groupBy(F.col("user_id").alias("night")).agg(F.min("ts").alias("start"))
    placed = tables.in_order(results(spark, sf).select("night"), starts, "night", "start")
    return placed.select("night", F.col("place").cast("long").alias("place"))


@query
def cluster_results_written(spark, sf):
    path = scratch(spark)
    tables.write_clusters(feature_rows(spark, sf).select(F.col("grp").alias("cluster"), "night", "epoch", "price", "tax"), ["price", "tax"], path)
    got = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/centres")
    return got.select("cluster", F.col("n").cast("long").alias("n"), F.round("price", 4).alias("price"), r6("tax").alias("tax"))


@query
def channel_picks_stored(spark, sf):
    path = scratch(spark)
    tables.write_picks(channels.hemisphere_picks(electrodes(spark, sf), 4), path)
    return tables.load_picks(spark, path)


@query
def feature_table_summary(spark, sf):
    long = quality.unpivoted(feature_rows(spark, sf), FEATURES, ["epoch"]).withColumn("name", F.concat_ws("_", "feature", "epoch"))
    return tables.feature_summary(long.withColumn("tag", F.when(F.col("feature").isin("price", "tax"), "money").otherwise("other")))


@query
def window_labels_written(spark, sf):
    path = scratch(spark)
    tables.write_window_labels(event_windows(spark, sf), path)
    return spark.read.option("header", True).schema("night long, win long, label string").csv(path)


@query
def upserted_nights(spark, sf):
    """A stream of events in five batches, each with a part of every night, through the ledger."""
    path = scratch(spark)
    events = table(spark, sf, "events").select(F.col("user_id").alias("night"), "event_id", "value")
    files = spark.sparkContext.defaultParallelism  # of each part, so that a batch takes a part and batches stay five, whatever the size
    for k in range(5):
        events.filter(F.col("event_id") % 5 == k).repartition(files).write.mode("append").parquet(f"{path}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    work = lambda df: df.groupBy("night").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    ledger.upsert(stream, work, path, f"{path}/checkpoint")
    return ledger.current(spark, path, work(events).schema).select("night", "n", F.round("total", 2).alias("total"))


def recorded(spark, sf) -> str:
    """Recordings in two parts a label: each embedding is 16 samples of four channels, in the order of vec_id."""
    path = scratch(spark)
    e = epoching.numbered(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", name="place")
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    suffix = F.when(F.col("place") < F.floor(F.col("n") / 3), "a").otherwise("b")
    rows = e.join(n, "label").select(F.format_string("Subject-%d%s_20200101_220000.mff", F.col("label"), suffix).alias("recording"), "place", F.col("embedding").alias("values"))
    recording.write_signals(rows, path)
    recording.register(spark)
    return path


@query
def record_interleaved_load(spark, sf):
    """24-bit files of records, one a label: each embedding is a record of 16 samples of four channels; one is left out by a filter."""
    path = scratch(spark)
    e = epoching.numbered(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", name="place")
    rows = e.select(F.format_string("label-%d.bdf", F.col("label")).alias("recording"), "place", F.col("embedding").alias("values"))
    records.write_records(rows, path, ["A", "B", "C", "D"], 0.25, -1.0, 1.0)
    records.register(spark)
    r = spark.read.format("records").load(path).filter("channel <> 'D'")
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return r.select("recording", "channel", F.col("record").cast("long").alias("record"), "first_sample", "sfreq", F.size("samples").alias("n"), F.element_at("samples", 1).alias("x"), total.alias("total")).withColumns({c: r6(c) for c in ("x", "total")})


@query
def recordings_load(spark, sf):
    """All recordings of a folder in one load, parts of a night in order."""
    r = spark.read.format("recording").option("channel_count", 4).option("epoch_seconds", 16 / 250).load(recorded(spark, sf))
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return r.groupBy("night", "suffix", "channel").agg(F.count("*").alias("epochs"), F.max("night_sample").alias("last"), F.round(F.sum(total * F.col("night_sample")), 3).alias("weighed"))


@query
def recordings_range(spark, sf):
    """Filters that the source takes over: one channel of four, one part of two, some epochs."""
    r = spark.read.format("recording").option("channel_count", 4).option("epoch_seconds", 16 / 250).load(recorded(spark, sf))
    r = r.filter("channel = 'AUX1' and suffix = 'b' and first_sample >= 32 and first_sample < 480")
    return r.select("night", "epoch", "first_sample", "night_sample", r6(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query
def recordings_stream(spark, sf):
    """The same recordings as a stream: each epoch once."""
    r = spark.readStream.format("recording").option("channel_count", 4).option("epoch_seconds", 16 / 250).load(recorded(spark, sf))
    got = streams.drained(r.select("night", "suffix", "channel", "first_sample", F.element_at("samples", 1).alias("x")))
    return got.groupBy("night", "suffix", "channel").agg(F.count("*").alias("epochs"), F.sum("first_sample").alias("places"), F.round(F.sum("x"), 4).alias("x"))


@query
def feature_bundle_written(spark, sf):
    """Features of all rows with their header, as one bundle."""
    path = scratch(spark)
    bundles.register(spark)
    few_nights(spark, sf).write.format("feature_bundle").mode("append").option("channel", "price").option("sfreq", 250).save(path)
    header, got = bundles.read_bundle(spark, path)
    return got.groupBy("night").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price")).withColumn("channel", F.lit(header["channel"]))


@query
def array_features_long(spark, sf):
    s = segments(spark, sf).select("epoch", F.slice("samples", 1, 4).alias("short"), F.col("samples").alias("wide"))
    both = tables.expanded(s, ["epoch"], "short").unionByName(tables.expanded(s, ["epoch"], "wide"))
    return both.select("epoch", "name", r6("value").alias("value"))


# more of quality, graphs, series and spectra


@query
def feature_describe(spark, sf):
    d = quality.described(feature_rows(spark, sf), FEATURES)
    return d.select("feature", "n", *[r6(c).alias(c) for c in d.columns[2:]])


@query
def min_max_scale(spark, sf):
    f = feature_rows(spark, sf).select("night", "epoch", "price", F.lit(3.0).alias("flat"))
    return quality.min_max_scaled(f, ["price", "flat"]).select("night", "epoch", r6("price").alias("price"), "flat")


@query
def strong_feature_pairs(spark, sf):
    p = quality.strong_pairs(feature_rows(spark, sf), FEATURES, 0.001, 5)
    return p.select("feature_i", "feature_j", r6("r").alias("r"), "rank")


@query
def missing_first(spark, sf):
    w = W.Window.partitionBy(F.lit(0)).orderBy(F.desc("n_missing"), "feature")  # a row a feature
    return quality.nan_profile(feature_rows(spark, sf), FEATURES).select("feature", "n_missing", F.row_number().over(w).alias("place"))


@query
def pca_loadings(spark, sf):
    p = quality.loadings(feature_rows(spark, sf).select("price", "tax"), ["price", "tax"], 2)
    return p.select("component", "feature", r6("loading").alias("loading"), r6("share").alias("share"))


@query
def metric_matrix(spark, sf):
    m = nightly.metric_matrix(night_series(spark, sf), ["n", "mean"])
    return m.select("metric_i", "metric_j", "lag", r6("r").alias("r"))


@query
def graph_paths(spark, sf):
    e = channels.correlation_edges(channel_signal(spark, sf), ["night"], "channel", "sample", "value").withColumn("value", F.round("value", 9))
    return channels.path_lengths(e, ["night"], 0.6).select("night", "largest", r6("path_length").alias("path_length"))


@query
def hemisphere_kmeans_picks(spark, sf):
    return channels.nearest_to_centres(electrodes(spark, sf), 5)


@query
def welch_window_bands(spark, sf):
    """Relative band power of windows in a row; the segments are short, so that a window is PSD_SECONDS of 5 samples."""
    size = 5 * PSD_SECONDS
    w = segments(spark, sf).select("epoch", F.posexplode(epoching.sliding(F.col("samples"), size, size)).alias("win", "samples"))
    b = features.extract(w, ["epoch", "win"], ["welch_bands"], fs=64.0)
    return b.select("epoch", "win", *[r6(f"psd_{c}").alias(c) for c in BANDS])


@query
def granger_pair_f(spark, sf):
    """F of each source's past on each target at a lag of one."""
    g = connectivity.granger(channel_segments(spark, sf), ["night", "epoch"], 1)
    return g.select("night", "epoch", "source", "target", r6("f").alias("f"))


@query
def cross_correlation_edges(spark, sf):
    e = connectivity.connectivity(channel_segments(spark, sf), ["night", "epoch"], fs=64.0).filter("method = 'correlation'")
    return e.select("night", "epoch", "ch_i", "ch_j", r6("value").alias("value"))


@query
def region_correlation_edges(spark, sf):
    """Edges between regions, each the mean of its channels."""
    regions = spark.createDataFrame([("E1", "front"), ("E2", "front"), ("E3", "back"), ("E4", "back"), ("E5", "top")], "channel string, region string")
    means = connectivity.by_region(channel_segments(spark, sf), regions, ["night", "epoch"])
    e = connectivity.connectivity(means, ["night", "epoch"], fs=64.0).filter("method = 'correlation'")
    return e.select("night", "epoch", "ch_i", "ch_j", r6("value").alias("value"))


@query
def half_rate_segments(spark, sf):
    """Samples of the segments at 32 Hz instead of 64."""
    half = features.at_rate(segments(spark, sf), ["epoch"], 64.0, 32.0)
    return half.select("epoch", F.posexplode("samples").alias("i", "v")).select("epoch", "i", r6("v").alias("v"))
