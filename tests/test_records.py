import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.sources import records


def make(path, told=5, records_there=5, extra=b"", kind24=True):
    """Three channels of 4, 2 and 3 samples a record; the last holds annotations."""
    width, top = (3, 1 << 23) if kind24 else (2, 1 << 15)
    rng = np.random.default_rng(1)
    digital = [rng.integers(-top, top, (records_there, n)) for n in (4, 2, 3)]
    digital[0][:1, :2] = -top, top - 1
    head = {"version": "\xffBIOSEMI" if kind24 else "0", "bytes": 256 * 4, "records": told, "seconds": 2, "channels": 3}
    each = {"label": ["Cz", "Pulse", "BDF Annotations"], "unit": ["uV", "mV", ""], "low": [-262144, -5, -1], "high": [262143, 5, 1], "digital_low": [-top, 0, -top], "digital_high": [top - 1, 100, top - 1], "samples": [4, 2, 3]}
    text = "".join(str(head.get(c, "")).ljust(w) for c, w in records.HEAD.items())
    text += "".join(str(each.get(c, [""] * 3)[i]).ljust(w) for c, w in records.CHANNEL.items() for i in range(3))
    body = b"".join(int(v).to_bytes(width, "little", signed=True) for k in range(records_there) for d in digital for v in d[k])
    path.write_bytes(text.encode("latin-1") + body + extra)
    return digital, top


@pytest.mark.parametrize("kind24", [True, False])
def test_every_sample(spark, tmp_path, kind24):
    digital, top = make(tmp_path / "a.bdf", kind24=kind24)
    records.register(spark)
    rows = spark.read.format("records").option("records_per_task", 2).load(str(tmp_path / "a.bdf")).collect()
    assert len(rows) == 10 and {r.channel for r in rows} == {"Cz", "Pulse"}
    gain = (262143 + 262144) / (2 * top - 1)
    for r in rows:
        if r.channel == "Cz":
            assert (r.sfreq, r.unit, r.first_sample) == (2.0, "uV", 4 * r.record)
            assert r.samples == pytest.approx((digital[0][r.record] + top) * gain - 262144, abs=1e-6)
        else:
            assert (r.sfreq, r.unit, r.first_sample) == (1.0, "mV", 2 * r.record)
            assert r.samples == pytest.approx(digital[1][r.record] * 0.1 - 5)
    assert [r.samples[0] for r in rows if r.channel == "Cz" and r.record == 0] == [pytest.approx(-262144)]


def test_records_that_are_there(spark, tmp_path):
    """An unknown count is told by the size, one too large is cut, an unfinished record is left out; other files are not read."""
    make(tmp_path / "a.bdf", told=-1, extra=b"\1" * 20)
    make(tmp_path / "b.bdf", told=9, records_there=3)
    make(tmp_path / "c.edf", told=2, kind24=False)
    make(tmp_path / "d.bdf", told=0, records_there=0)
    (tmp_path / "notes.txt").write_text("x")
    records.register(spark)
    got = spark.read.format("records").load(str(tmp_path)).filter("channel = 'Cz'").groupBy("recording").count().collect()
    assert {r.recording: r["count"] for r in got} == {"a.bdf": 5, "b.bdf": 3, "c.edf": 2}


def test_filters_reach_the_plan(tmp_path):
    from pyspark.sql import datasource as ds

    make(tmp_path / "a.bdf")
    make(tmp_path / "b.bdf")
    reader = records.RecordsReader({"path": str(tmp_path), "records_per_task": "2"})
    left = list(reader.pushFilters([ds.EqualTo(("recording",), "b.bdf"), ds.GreaterThan(("record",), 1), ds.In(("channel",), ("Pulse",)), ds.EqualTo(("unit",), "mV")]))
    assert [f.attribute for f in left] == [("unit",)]
    parts = reader.partitions()
    assert [(p.file.name, p.first, p.last) for p in parts] == [("b.bdf", 2, 4), ("b.bdf", 4, 5)]
    assert [b.column("channel").to_pylist() for p in parts for b in reader.read(p)] == [["Pulse"]] * 3
    reader.pushFilters([])
    none = records.RecordsReader({"path": str(tmp_path)})
    list(none.pushFilters([ds.EqualTo(("recording",), "z")]))
    assert [list(none.read(p)) for p in none.partitions()] == [[]]


def test_other_files_fail(spark, tmp_path):
    (tmp_path / "a.bdf").write_bytes(b"no header" * 100)
    with pytest.raises(ValueError, match="header"):
        records.File.opened(str(tmp_path / "a.bdf"))
    (tmp_path / "b.bdf").write_bytes(b"")
    with pytest.raises(ValueError, match="header"):
        records.File.opened(str(tmp_path / "b.bdf"))


def test_round_trip(spark, tmp_path):
    x = np.random.default_rng(2).uniform(-1, 1, (6, 8))
    x[0, 0], x[0, 1] = 7.0, -7.0
    df = spark.createDataFrame([(f"r{k % 2}.bdf", k // 2, v.tolist()) for k, v in enumerate(x)], "recording string, place int, values array<double>").repartition(4)
    records.write_records(df, str(tmp_path / "out"), ["A", "B"], 0.5, -1.0, 1.0)
    records.register(spark)
    got = spark.read.format("records").load(str(tmp_path / "out"))
    assert got.select(F.collect_set("sfreq")).first()[0] == [8.0]
    for r in got.collect():
        k = 2 * r.record + int(r.recording[1])
        want = np.clip(x[k], -1, 1)[:4] if r.channel == "A" else np.clip(x[k], -1, 1)[4:]
        assert r.samples == pytest.approx(want, abs=1.2e-7)
    assert got.count() == 12 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
