"""The ledger against whole tables, the bundle writer against tasks that fail, gaps against late events."""

import json

import pytest
from pyspark.sql import functions as F

from noctua.sources import bundles
from noctua.streaming import ledger, streams

ROWS = [(n, float(i * (n + 1) % 7)) for i in range(40) for n in range(6)]


@pytest.mark.parametrize("batches", [1, 5])
def test_results_do_not_depend_on_batches(spark, tmp_path, batches):
    for k in range(batches):
        mine = ROWS[k::batches]
        spark.createDataFrame(mine, "night long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.landing(spark, f"{tmp_path}/in", "night long, v double", files_per_trigger=1)
    work = lambda df: df.groupBy("night").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("top"))
    path, schema = f"{tmp_path}/out", work(stream).schema
    assert ledger.current(spark, path, schema).count() == 0
    ledger.upsert(stream, work, path, f"{tmp_path}/ck")
    want = sorted((n, 40, sum(v for m, v in ROWS if m == n), max(v for m, v in ROWS if m == n)) for n in range(6))
    assert sorted(map(tuple, ledger.current(spark, path, schema).select("night", "n", "total", "top").collect())) == want
    assert {r.version for r in ledger.versions(spark, path).collect()} == {batches - 1}
    assert ledger.swept(spark, path, schema) == list(range(batches - 1))
    wanted = spark.createDataFrame([(4,), (9,)], "night long")
    assert [r.night for r in ledger.not_done(wanted, spark, path).collect()] == [9]


def test_a_batch_taken_again_and_one_that_breaks_off(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(1, x) for x in v], "night long, v double")
    work = lambda df: df.groupBy("night").agg(F.sum("v").alias("total"))
    path, schema = str(tmp_path), work(rows(1.0)).schema
    total = lambda: [r.total for r in ledger.current(spark, path, schema).collect()]
    ledger.take(rows(1.0, 2.0), 0, work, path)
    ledger.take(rows(4.0), 1, work, path)
    ledger.take(rows(4.0), 1, work, path)  # the same batch again
    assert total() == [7.0]

    def breaks(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        ledger.take(rows(8.0), 2, breaks, path)
    assert total() == [7.0]  # not in the ledger
    ledger.take(rows(8.0), 2, work, path)
    assert total() == [15.0]


def test_bundle_round_trip(spark, tmp_path):
    bundles.register(spark)
    path = str(tmp_path / "b")
    df = spark.range(10).select(F.col("id").alias("epoch"), (F.col("id") * 1.5).alias("x"), F.array("id").alias("a")).repartition(3)
    write = lambda df, mode: df.write.format("feature_bundle").mode(mode).option("channel", "E1").option("sfreq", 250).save(path)
    write(df, "overwrite")
    write(df.limit(2), "append")
    header, got = bundles.read_bundle(spark, path)
    assert (header["channel"], header["sfreq"], header["columns"]) == ("E1", "250", ["epoch", "x", "a"]) and sum(header["files"].values()) == 12
    assert got.count() == 12 and got.agg(F.sum("x")).first()[0] >= 67.5
    write(df.limit(0), "overwrite")
    assert bundles.read_bundle(spark, path)[1].count() == 0
    assert {f.name for f in (tmp_path / "b").iterdir()} == {"header.json", *json.loads((tmp_path / "b" / "header.json").read_text())["files"]}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    bundles.register(spark)
    path = str(tmp_path / "b")
    good = spark.range(4).select(F.col("id").cast("double").alias("x"))
    good.write.format("feature_bundle").mode("append").option("channel", "E1").save(path)
    before = {f.name for f in (tmp_path / "b").iterdir()}
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken epoch")).cast("double")).otherwise(1.0).alias("x"))
    with pytest.raises(Exception, match="broken epoch"):
        bad.write.format("feature_bundle").mode("append").option("channel", "E1").save(path)
    assert {f.name for f in (tmp_path / "b").iterdir()} == before and bundles.read_bundle(spark, path)[1].count() == 4


def test_a_late_event_removes_the_gap_it_fills(spark, tmp_path):
    hour = 3600
    batches = ([0, 8 * hour], [4 * hour, 8.5 * hour], [30 * hour], [31 * hour, 1 * hour], [60 * hour], [90 * hour])
    for seconds in batches:
        spark.createDataFrame([("k", float(s)) for s in seconds], "key string, s double").select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.landing(spark, f"{tmp_path}/in", "key string, ts timestamp", files_per_trigger=1)
    rows = streams.drained(streams.stream_gaps(stream, "key", "ts", 6.0 * hour, late="6 hours")).collect()
    # 4 h comes late and fills the pause of 8 h; 1 h comes when the watermark has passed it; 90 h waits
    assert sorted((r.start / 1e6 / hour, r.gap_s / hour) for r in rows) == [(30, 21.5), (60, 29)]


def test_a_closed_input_settles_all(spark, tmp_path):
    rows = [(None, 0.0), (None, 9.0), ("k", 0.0), ("k", 7.0), ("k", 8.0), ("other", 50.0)]
    spark.createDataFrame(rows, "key string, h double").select("key", F.timestamp_seconds(1_700_000_000 + F.col("h") * 3600).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.closed(streams.landing(spark, f"{tmp_path}/in", "key string, ts timestamp"), "ts")
    got = streams.drained(streams.stream_gaps(stream, "key", "ts", 6 * 3600.0)).collect()
    assert sorted(((r.key, r.gap_s / 3600) for r in got), key=str) == [("k", 7.0), (None, 9.0)]


def test_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    from noctua.plans.queries import QUERIES

    rows = spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit(1.0).alias("value"))
    rows.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    taken, take = [], ledger.take
    monkeypatch.setattr(ledger, "take", lambda df, version, *rest: (taken.append(version), take(df, version, *rest)))
    got = QUERIES["upserted_nights"](spark, str(tmp_path)).collect()
    assert taken == [0, 1, 2, 3, 4]
    assert sorted((r.night, r.n, r.total) for r in got) == [(n, 86 if n < 5 else 85, 86.0 if n < 5 else 85.0) for n in range(7)]


def test_state_of_gaps_is_called_a_few_times(monkeypatch):
    """Three keys of a thousand events each and one group: calls do not grow with events or keys."""
    import numpy as np
    import pandas as pd

    from noctua.streaming.gaps import gap_processor

    calls = []

    class State:
        held = ()

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("put", "update"):
                    self.held = tuple(args[0]) if name == "put" else args[0]
                elif name in ("appendValue", "updateValue"):
                    self.held = (*self.held, args[0])
                elif name == "clear":
                    self.held = ()
                return bool(self.held) if name == "exists" else self.held

            return call

        def getListState(self, *_):
            return State()

        getMapState = getValueState = getListState

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    p, times = gap_processor(3600.0), Times()
    p.init(State())
    at = np.arange(1000) * 1_000_000
    at[500:] += 5_000_000_000
    pdf = pd.DataFrame({"none": False, "some": np.repeat([1, 2, 3], 1000), "at": np.tile(at, 3) + 1})
    assert not list(p.handleInputRows((0,), iter([pdf[:1500], pdf[1500:]]), times))
    times.now = 10**9
    told = pd.concat(list(p.handleExpiredTimer((0,), times, None)))
    assert sorted(told["some"]) == [1, 2, 3] and set(told["gap_s"]) == {5001.0} and set(told["start"]) == {5_500_000_001}
    assert len(calls) < 20
    assert not list(p.handleExpiredTimer((0,), times, None))
