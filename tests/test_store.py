"""Commits of stored datasets: reruns, two writers, batches, pruning and summaries; checks that don't depend on how time is cut."""

import glob

import pytest
from pyspark.sql import functions as F

from gridloom.functions import metadata
from gridloom.operators import mapping
from gridloom.plans import process
from gridloom.sources import store

HOUR = 3_600_000_000
DAY = 24 * HOUR


def samples(spark, hours, value=0.0):
    return spark.createDataFrame([(h * HOUR, float(h) + value) for h in hours], "t long, v double")


def kept(spark, path, **limits):
    return sorted((r["t"] // HOUR, r["v"]) for r in store.read(spark, path, **limits).collect())


class Copy(process.Process):
    """Stores what it reads; a day may be left out."""

    data, left_out = None, ()

    def retrieve(self, begin, end):
        rows = self.data.where((F.col("t") >= begin) & (F.col("t") < end))
        self.inputs = {"out": rows.where(~F.floor(F.col("t") / DAY).isin(*self.left_out)) if self.left_out else rows}


def copying(spark, path, data, **more):
    p = Copy(spark, {}, {"out": process.Output(str(path), ["t"], [mapping.Target("v", "v", "double")], **more)})
    p.data = data
    return p


def test_rerun_leaves_its_own_rows(spark, tmp_path):
    p = copying(spark, tmp_path / "out", samples(spark, range(72)))
    count = lambda: store.read(spark, str(tmp_path / "out")).count()
    p.run(0, 3 * DAY, 3 * DAY)
    assert count() == 72
    p.left_out = (1,)
    p.run(0, 3 * DAY, 3 * DAY)
    assert count() == 48
    p.left_out = (0, 1, 2)
    p.run(0, 3 * DAY, 3 * DAY)
    assert count() == 0 and store.manifest(spark, str(tmp_path / "out")).count() == 0
    assert store.vacuum(spark, str(tmp_path / "out")) > 0
    p.left_out = ()
    p.run(DAY, 2 * DAY, DAY)
    assert count() == 24
    assert store.read(spark, str(tmp_path / "none")) is None


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "out")
    store.write(samples(spark, range(48)), path)
    one, two, three = (store.Commit(spark, path) for _ in range(3))
    one.replace(samples(spark, range(0, 24), 100.0), 0, DAY)
    two.replace(samples(spark, range(12, 36), 200.0), 12 * HOUR, 36 * HOUR)
    three.replace(samples(spark, range(24, 30), 300.0), DAY, 2 * DAY)
    one.commit()
    with pytest.raises(store.Conflict):
        two.commit()
    three.commit()  # other times: numbered anew
    assert kept(spark, path) == [(h, h + 100.0) for h in range(24)] + [(h, h + 300.0) for h in range(24, 30)]
    # what adds rows doesn't exclude another that adds some, but one that replaces them
    a, b, c = (store.Commit(spark, path) for _ in range(3))
    a.add(samples(spark, [50]))
    b.add(samples(spark, [51]))
    c.replace(samples(spark, [52]), 2 * DAY, 3 * DAY)
    a.commit()
    b.commit()
    with pytest.raises(store.Conflict):
        c.commit()
    assert kept(spark, path)[-2:] == [(50, 50.0), (51, 51.0)]
    # files of the commits that failed are no part of it
    assert store.vacuum(spark, path) > 0 and len(kept(spark, path)) == 32


def test_batches_summaries_and_pruning(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SUMMARY", 3)
    path = str(tmp_path / "out")
    for k in range(8):
        assert store.write(samples(spark, range(24 * k, 24 * k + 24)), path, batch=f"b{k}")
        assert not store.write(samples(spark, range(24 * k, 24 * k + 24)), path, batch=f"b{k // 2}")
    assert len(glob.glob(f"{path}/_log/*.summary.json")) == 2 and len(kept(spark, path)) == 192
    a, b = store.Commit(spark, path), store.Commit(spark, path)
    for c in (a, b):
        c.add(samples(spark, [500]), batch="same")
    a.commit()
    with pytest.raises(store.Conflict):
        b.commit()
    some = store.read(spark, path, 30 * HOUR, 50 * HOUR)
    assert len(some.inputFiles()) == 2 and kept(spark, path, begin=30 * HOUR, end=50 * HOUR) == [(h, float(h)) for h in range(30, 50)]
    # a reader that began before a commit still finds its files
    held = store.read(spark, path, 0, DAY)
    store.replace(samples(spark, range(3), 7.0), path, 0, DAY)
    assert held.count() == 24 and kept(spark, path, end=DAY) == [(h, h + 7.0) for h in range(3)]
    with pytest.raises(ValueError, match="other types"):
        store.write(samples(spark, [1]).withColumn("v", F.lit("x")), path)
    store.write(samples(spark, [600]).withColumn("w", F.lit(1)), path)
    assert [r["w"] for r in store.read(spark, path).where("w is not null").collect()] == [1]
    store.write(spark.createDataFrame([(None, 1.0)], "t long, v double"), path)
    assert store.read(spark, path).where("t is null").count() == 1


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_formats_keep_types(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    store.write(samples(spark, range(30)), path, fmt=fmt)
    store.replace(samples(spark, range(5, 7), 0.5), path, 4 * HOUR, 8 * HOUR, fmt=fmt)
    assert kept(spark, path, fmt=fmt) == [(h, float(h)) for h in range(4)] + [(5, 5.5), (6, 6.5)] + [(h, float(h)) for h in range(8, 30)]


def test_last_before(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", h, float(h)) for h in range(0, 400, 1)] + [("b", 3, 3.5), ("b", 1, 1.5)] + [("c", 390, 9.0)]
    data = spark.createDataFrame([(s, h * HOUR, v) for s, h, v in rows], "s string, t long, v double")
    store.write(data, path)
    wanted = spark.createDataFrame([("a",), ("b",), ("d",)], "s string")
    found = store.last_before(spark, path, 380 * HOUR, wanted, ["t"], ["s", "t", "v"])
    assert sorted((r["s"], r["t"] // HOUR, r["v"]) for r in found.collect()) == [("a", 379, 379.0), ("b", 3, 3.5)]
    assert [r["v"] for r in store.last_before(spark, path, 391 * HOUR, None, ["t", "s"], ["t", "s", "v"]).collect()] == [9.0]
    assert store.last_before(spark, path, 0, wanted, ["t"], ["s", "t", "v"]) is None
    assert store.last_before(spark, path, 9, wanted, ["t"], ["s", "t", "absent"]) is None


@pytest.mark.parametrize("parts", [1, 2, 24])
def test_checks_under_any_cut_of_time(spark, tmp_path, parts):
    data = samples(spark, range(48)).withColumn("v", F.when(F.col("t") >= DAY, 100.0).otherwise(0.0) + F.when(F.col("t") == 30 * HOUR, -500.0).otherwise(0.0))
    data = metadata.with_attributes(data, "v", valid_delta=50.0, valid_min=-100.0, missing_value=-9999.0)

    class Mine(Copy):
        def map_outputs(self, begin, end):
            self.outputs = dict(self.transformed)

    p = Mine(spark, {}, {"out": process.Output(str(tmp_path), ["t"], [], standard_checks=True)})
    p.data = data
    assert p.run(0, 2 * DAY, 2 * DAY // parts) == parts
    flags = {r["t"] // HOUR: r["qc_v"] for r in store.read(spark, str(tmp_path)).collect()}
    # the jump at midnight; the bad sample isn't stepped to or from
    assert flags == {h: 8 if h == 24 else 2 if h == 30 else 0 for h in range(48)}


def test_series_and_other_keys(spark, tmp_path):
    rows = [(h * HOUR, f"s{k}", h * 2 + k, 0.0 if (h < 5) == (k == 0) else 90.0) for h in range(10) for k in range(2)]
    data = metadata.with_attributes(spark.createDataFrame(rows, "t long, s string, record long, v double"), "v", valid_delta=50.0, missing_value=-1.0)

    class Mine(Copy):
        def map_outputs(self, begin, end):
            self.outputs = dict(self.transformed)

    for name, series, due in (("by", ["s"], {(5, "s0"), (5, "s1")}), ("one", [], {(h, "s1") for h in range(10)} | {(h, "s0") for h in range(1, 10) if h != 5})):
        p = Mine(spark, {}, {"out": process.Output(str(tmp_path / name), ["t", "s", "record"], [], standard_checks=True, series=series)})
        p.data = data
        p.run(0, 10 * HOUR, 5 * HOUR)
        assert {(r["t"] // HOUR, r["s"]) for r in store.read(spark, str(tmp_path / name)).where("qc_v = 8").collect()} == due


def test_values_that_are_not_finite(spark, tmp_path):
    data = spark.createDataFrame([(0, float("nan"), float("inf"), 1.0), (1, 2.0, 3.0, float("nan"))], "t long, v double, w double, x double")
    data = metadata.with_attributes(metadata.with_attributes(data, "v", missing_value=-9999.0, valid_max=1.0), "w", valid_max=1.0)

    class Mine(Copy):
        def map_outputs(self, begin, end):
            self.outputs = dict(self.transformed)

    p = Mine(spark, {}, {"out": process.Output(str(tmp_path), ["t"], [], standard_checks=True, filter_nans=True, unchecked=["w"])})
    p.data = data
    p.run(0, 10, 10)
    assert sorted(tuple(r) for r in store.read(spark, str(tmp_path)).select("t", "v", "w", "x", "qc_v").collect()) == [(0, -9999.0, None, 1.0, 1), (1, 2.0, 3.0, None, 4)]
