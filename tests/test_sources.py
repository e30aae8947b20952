import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.operators import epoching, features
from noctua.sources import recording as rec


def make(path, channels=257, samples=4000):
    path.mkdir()
    x = (np.arange(samples)[:, None] * 1000 + np.arange(channels)[None]).astype("<f4")
    x.tofile(path / "signal1.bin")
    sensors = "".join(f"<sensor><name>{'E' + str(i + 1) if i else ''}</name><number>{i + 1}</number><type>{int(i == 256)}</type><x>{i}</x><y>1</y><z>2</z></sensor>" for i in range(channels))
    (path / "sensorLayout.xml").write_text(f'<sensorLayout xmlns="http://layout"><sensors>{sensors}</sensors></sensorLayout>')
    (path / "info1.xml").write_text("<info><sampRate>200</sampRate></info>")
    return x


def test_round_trip(spark, tmp_path):
    """More values than any chunk: every sample stays with its channel."""
    x = make(tmp_path / "r.mff")
    rec.register(spark)
    df = spark.read.format("recording").option("epoch_seconds", 2).option("epochs_per_task", 2).option("channels", "E1,E5,E256").load(str(tmp_path / "r.mff"))
    rows = df.collect()
    assert {r.channel for r in rows} == {"E1", "E5", "E256"}
    assert len(rows) == 30 and all(r.sfreq == 200 for r in rows)
    for r in rows:
        c = int(r.channel[1:]) - 1
        assert np.array_equal(r.samples, x[r.first_sample : r.first_sample + 400, c])


def test_slice_past_the_end(spark, tmp_path):
    make(tmp_path / "r.mff", samples=1000)
    rec.register(spark)
    read = spark.read.format("recording").option("channels", "E2").option("epoch_seconds", 1)
    assert read.option("start", 900).option("stop", 5000).load(str(tmp_path / "r.mff")).select(F.sum(F.size("samples"))).first()[0] == 100
    assert spark.read.format("recording").option("start", 2000).load(str(tmp_path / "r.mff")).count() == 0


def test_negated_filter(spark, tmp_path):
    """A filter that the source does not know stays with Spark."""
    make(tmp_path / "r.mff", samples=400)
    rec.register(spark)
    r = spark.read.format("recording").option("channels", "E1,E2,E3").load(str(tmp_path / "r.mff"))
    assert {x.channel for x in r.filter("channel <> 'E2' and epoch > -1").collect()} == {"E1", "E3"}


def test_layout(spark, tmp_path):
    make(tmp_path / "r.mff", samples=10)
    e = rec.layout(spark, str(tmp_path / "r.mff" / "sensorLayout.xml"))
    assert e.count() == 256
    assert e.filter("abs(x*x + y*y + z*z - 1) > 1e-9").count() == 0
    assert e.filter("number = 1").first()["name"] == "E1"


def test_channel_count():
    assert rec.channel_count(257 * 100) == 257
    assert rec.channel_count(260 * 7) == 260
    assert rec.channel_count(1) == 257


def test_catalog(spark):
    paths = [("/a/night-27a_20200101_220000.mff", 0), ("/b/night-27a_20200101_220000.mff", 1), ("/a/night-27b_20200102_010000.mff", 0), ("/a/other.mff", 0), ("/a/night-3_20191201_230000.mff", 0)]
    rows = rec.catalog(spark.createDataFrame(paths, "path string, source int")).orderBy("night", "suffix").collect()
    assert [(r.night, r.suffix, r.source) for r in rows] == [(3, "", 0), (27, "a", 0), (27, "b", 0)]


def test_nights_are_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    rec.write_nights(spark.createDataFrame([(1, 1.0), (2, 2.0)], "night int, v double"), path)
    rec.write_nights(spark.createDataFrame([(2, 3.0)], "night int, v double"), path)
    assert sorted((r.night, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 3.0)]


def test_many_nights_are_few_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    rec.write_nights(spark.range(600).select(F.col("id").alias("night"), F.lit(1.0).alias("v")), path)
    rec.write_nights(spark.createDataFrame([(None, 1.0), (599, 2.0), (600, 2.0)], "night long, v double"), path)
    rec.write_nights(spark.createDataFrame([(None, 3.0), (5, 3.0), (5, 4.0)], "night int, v double"), path)
    assert len([d for d in (tmp_path / "out").iterdir() if d.is_dir()]) <= 64
    want = [(None, 3.0), *((n, 1.0) for n in range(599) if n != 5), (5, 3.0), (5, 4.0), (599, 2.0), (600, 2.0)]
    assert sorted(((r.night, r.v) for r in spark.read.parquet(path).collect()), key=repr) == sorted(want, key=repr)


def test_features_of_odd_segments(spark):
    rows = [(0, None), (1, []), (2, [1.0, float("nan"), 2.0, 3.0]), (3, [float(i % 7) for i in range(300)])]
    got = features.extract(spark.createDataFrame(rows, "epoch int, samples array<double>"), ["epoch"], ["lempel_ziv", "higuchi"], 100.0).orderBy("epoch").collect()
    assert [r.lz_complexity is None for r in got] == [True, True, True, False]


def test_user_kernel_may_fail(spark):
    def bad(x, fs):
        raise ValueError

    df = spark.createDataFrame([(0, [1.0] * 10)], "epoch int, samples array<double>")
    assert features.extract(df, ["epoch"], ["bad"], more={"bad": (bad, ["b"])}).first().b is None


def test_all_wake_night_stays(spark):
    df = spark.createDataFrame([(1, i, 0) for i in range(3)] + [(2, 0, 0), (2, 1, 2)], "night int, epoch int, stage int")
    assert sorted((r.night, r.epoch) for r in epoching.without_leading_wake(df, "night").collect()) == [(1, 0), (1, 1), (1, 2), (2, 1)]


def many(folder, nights=(1, 2), samples=(300, 500)):
    """Two parts a night, of unequal sizes, three channels."""
    out = {}
    for night in nights:
        for suffix, n in zip("ab", samples, strict=True):
            path = folder / f"Subject-{night}{suffix}_20200101_22000{'ab'.index(suffix)}.mff"
            path.mkdir()
            x = (night * 10000 + 1000 * "ab".index(suffix) + np.arange(n)[:, None] + np.arange(3)[None] / 4).astype("<f4")
            x.tofile(path / "signal1.bin")
            out[night, suffix] = x
    return out


def reader_of(folder, **options):
    return rec.RecordingReader({"path": str(folder), "channel_count": "3", "epoch_seconds": "0.4", "epochs_per_task": "2", **options})


def test_many_recordings_in_one_load(spark, tmp_path):
    x = many(tmp_path)
    (tmp_path / "Subject-3_20200101_220000.mff").mkdir()  # no signal yet
    rec.register(spark)
    read = spark.read.format("recording").option("channel_count", 3).option("epoch_seconds", 0.4)
    with pytest.raises(Exception, match="no signal1.bin"):
        read.load(str(tmp_path)).collect()
    rows = read.option("missing", "skip").load(f"file://{tmp_path}").collect()
    for night in (1, 2):
        whole = np.concatenate([x[night, "a"], x[night, "b"]])
        for k in range(3):
            mine = sorted((r.night_sample, r.samples) for r in rows if r.night == night and r.channel == f"AUX{k}")
            assert np.array_equal(np.concatenate([s for _, s in mine]), whole[:, k])
            assert all(np.array_equal(s, whole[at : at + len(s), k]) for at, s in mine)


def test_filters_reach_the_source(spark, tmp_path):
    x = many(tmp_path)
    ds = rec.ds
    plain = reader_of(tmp_path)
    read = lambda r: sum((p.last - p.first) * p.recording.n * 4 for p in r.partitions())
    assert read(plain) == 2 * 800 * 3 * 4 and len(plain.partitions()) == 2 * (2 + 3)
    r = reader_of(tmp_path)
    left = list(r.pushFilters([ds.EqualTo(("night",), 2), ds.GreaterThanOrEqual(("first_sample",), 150), ds.LessThan(("first_sample",), 400), ds.In(("channel",), ("AUX1",)), ds.StringContains(("recording",), "b")]))
    assert [type(f) for f in left] == [ds.StringContains]
    assert [(p.recording.suffix, p.first, p.last) for p in r.partitions()] == [("a", 200, 300), ("b", 200, 400)] and read(r) == 300 * 3 * 4
    rec.register(spark)
    df = spark.read.format("recording").option("channel_count", 3).option("epoch_seconds", 0.4).load(str(tmp_path))
    got = df.filter("night = 2 and first_sample > 150 and epoch <= 3 and channel in ('AUX1') and suffix = 'b'")
    assert {(g.first_sample, tuple(g.samples)) for g in got.collect()} == {(a, tuple(x[2, "b"][a : a + 100, 1])) for a in (200, 300)}
    plan = got._jdf.queryExecution().toString()
    assert "Filter (" not in plan.split("Physical Plan")[1]
    assert df.filter("night = 9").count() == 0 and df.filter("channel is null").count() == 0


def test_appended_samples_come_once(spark, tmp_path):
    from noctua.streaming import streams

    folder = tmp_path / "in"
    folder.mkdir()
    x = many(folder, nights=(1,))
    rec.register(spark)

    def run():
        stream = spark.readStream.format("recording").option("channel_count", 3).option("epoch_seconds", 0.4).load(str(folder))
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").filter("channel = 'AUX0'").collect()
        return sorted((r.recording, r.first_sample, len(r.samples)) for r in rows)

    a, b = (f"Subject-1{s}_20200101_22000{i}.mff" for i, s in enumerate("ab"))
    want = [(a, k * 100, 100) for k in range(3)] + [(b, k * 100, 100) for k in range(5)]
    assert run() == want
    for more in (30, 90):  # less than an epoch, then the rest of it: the same checkpoint, a new query each time
        with open(folder / a / "signal1.bin", "ab") as f:
            np.full((more, 3), 7, "<f4").tofile(f)
        want += [(a, 300, 100)] * (more == 90)
        assert run() == sorted(want)
    assert x and streams


def test_signals_round_trip(spark, tmp_path):
    rows = [(f"Subject-{n}_20200101_220000.mff", k, [float(n * 100 + k * 6 + i) for i in range(6)]) for n in range(3) for k in range(10)]
    rec.write_signals(spark.createDataFrame(rows, "recording string, place long, values array<float>").repartition(5), str(tmp_path))
    assert np.array_equal(np.fromfile(tmp_path / rows[10][0] / "signal1.bin", "<f4"), np.arange(100, 160))
    assert [f.name for f in (tmp_path / rows[0][0]).iterdir()] == ["signal1.bin"]
