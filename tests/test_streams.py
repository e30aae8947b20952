"""Streams are drained to files, batch by batch, and not through the driver."""

from pyspark.sql import functions as F

from noctua.streaming import streams


def landed(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return streams.landing(spark, f"{tmp_path}/in", "id long, ts timestamp", files_per_trigger=1)


def test_append_keeps_all_batches_in_files(spark, tmp_path):
    got = streams.drained(streams.once(landed(spark, tmp_path), ["id"], "ts"))
    assert sorted(r.id for r in got.collect()) == list(range(30))
    assert all("drained-" in f and f.endswith(".parquet") for f in got.inputFiles()) and len(got.inputFiles()) >= 3


def test_complete_keeps_the_last_batch(spark, tmp_path):
    got = streams.drained(landed(spark, tmp_path).groupBy((F.col("id") % 2).alias("k")).agg(F.count("*").alias("n")), "complete")
    assert {(r.k, r.n) for r in got.collect()} == {(0, 15), (1, 15)} and got.inputFiles()


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    """A row far behind the watermark that a batch begins with does not reach its window; one within it does."""
    hour = 3600
    for k, seconds in enumerate(([0, 10 * hour], [20 * hour], [19.5 * hour, 60], [40 * hour], [80 * hour])):
        spark.createDataFrame([(float(s), 1.0) for s in seconds], "s double, value double").select(F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/late{k}")
        spark.read.parquet(f"{tmp_path}/late{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = streams.landing(spark, f"{tmp_path}/in", "ts timestamp, value double", files_per_trigger=1)
    got = streams.drained(streams.windowed(rows.withColumn("k", F.lit("x")), ["k"], "ts", "value", "1 hour"))
    n = {r.start // hour: r.n for r in got.select(F.unix_seconds("w.start").alias("start"), "n").collect()}
    assert n[0] == 1 and n[10] == 1 and n[19] == 1 and n[20] == 1


def test_a_night_that_comes_again_is_replaced(spark, tmp_path):
    for n in (1, 2):
        spark.createDataFrame([(7, n)], "night int, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = streams.landing(spark, f"{tmp_path}/in", "night int, n int", files_per_trigger=1)
        streams.upsert_nights(rows, lambda df: df.groupBy("night").agg(F.max("n").alias("n")), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [(r.night, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(7, 2)]
