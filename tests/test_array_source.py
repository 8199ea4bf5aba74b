"""The array file source: ranges, columns and filters read only their bytes; files of failed tasks don't appear."""

import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import metadata
from gridloom.sources import array_source, netcdf
from tests.test_netcdf import by_hand


@pytest.fixture
def arrays(spark):
    array_source.register(spark)
    return lambda path, where=(), **options: array_source.load(spark, str(path), where=where, **options)


@pytest.mark.parametrize("version", [1, 2])
def test_files_by_hand(spark, arrays, tmp_path, version):
    (tmp_path / "a.nc").write_bytes(by_hand(version))
    (tmp_path / "b.nc").write_bytes(by_hand(version, 1))
    (tmp_path / "_hidden.nc").write_bytes(b"no array file")
    found = [(r["file"][-4:], r["index"], r["text"], r["x"], r["y"]) for r in arrays(tmp_path).orderBy("file", "index").collect()]
    assert found == [("a.nc", t, f"t{t}", (0, -99, 20)[t], [t, t + 0.25]) for t in range(3)] + [("b.nc", 0, "t0", 0, [0.0, 0.25])]
    rows = arrays(tmp_path / "a*.nc", nulls="true", variables=["x"])
    assert metadata.attributes(rows, "x") == {"missing_value": -99}
    assert [tuple(r)[1:] for r in rows.orderBy("index").collect()] == [(0, 0), (1, None), (2, 20)]
    assert [r["index"] for r in arrays(tmp_path / "a*.nc", [("x", "known", None), ("index", ">=", 1)], nulls="true").collect()] == [2]
    assert [r["index"] for r in rows.where("x is null").collect()] == [1]
    assert [r["index"] for r in arrays(tmp_path / "a.nc", dim="level").orderBy("index").collect()] == [0, 1]
    own = spark.read.format("arrays").schema("index long, x short, none double").load(str(tmp_path / "a.nc"))
    assert sorted(tuple(r) for r in own.collect()) == [(0, 0, None), (1, -99, None), (2, 20, None)]
    with pytest.raises(Exception, match="no leading dimension"):
        arrays(tmp_path, variables=["level"]).collect()
    with pytest.raises(Exception, match="no files"):
        arrays(tmp_path / "z*.nc").collect()


def large(path, records=20_000):
    """A file of fixed and one of record variables: t and a wide one."""
    wide = np.arange(records * 64, dtype=float).reshape(records, 64)
    return wide, netcdf.file_bytes({"t": ("long", list(range(records))), "v": ("double", wide[:, 0].tolist())}, "time", {}, {})


def test_ranges_read_only_their_bytes(spark, arrays, tmp_path):
    _, data = large(tmp_path)
    (tmp_path / "a.nc").write_bytes(data)
    rows = arrays(tmp_path, partition_bytes="40000")
    assert rows.rdd.getNumPartitions() == -(-len(data) // 40000)
    assert sorted(r["t"] for r in rows.collect()) == list(range(20_000))
    reader = array_source.ArrayReader({"path": str(tmp_path), "where": '[["index", ">=", 500], ["index", "<", 700]]'}, rows.schema)
    store = array_source.located(str(tmp_path))[0]
    file = array_source.ArrayFile(store, str(tmp_path / "a.nc"))
    opened = file.taken
    got = [t for batch in reader.records(file, 0, 20_000) for t in batch.column("t").to_pylist()]
    assert got == list(range(500, 700)) and file.taken - opened == 200 * 16
    # one variable of wide records: single values are fetched
    row = netcdf.file_bytes({"t": ("long", list(range(50))), "s": ("string", ["x" * 40_000] * 50)}, "time", {}, {})
    (tmp_path / "b.nc").write_bytes(row)
    file = array_source.ArrayFile(store, str(tmp_path / "b.nc"))
    opened = file.taken
    assert file.columns(["t"], 10, 30)["t"].tolist() == list(range(10, 30)) and file.taken - opened == 20 * 8


def test_filters_as_in_spark(spark, arrays, tmp_path):
    values = [1.5, None, float("nan"), -3.0, 8.0, float("inf"), 2.5] * 30
    rows = spark.createDataFrame([(k, v, k % 5) for k, v in enumerate(values)], "t long, v double, n int")
    rows = metadata.with_attributes(rows, "v", units="m", missing_value=-9999.0)
    path = str(tmp_path / "out")
    rows.repartition(3).write.format("arrays").mode("append").option("attributes", json.dumps({"title": "x"})).save(path)
    back = arrays(path, nulls="true")
    assert metadata.attributes(back, "v") == {"units": "m", "missing_value": -9999.0}
    assert netcdf.header(open(glob.glob(f"{path}/*.nc")[0], "rb").read()).attributes == {"title": "x"}
    tests = {
        "v > 2": [("v", ">", 2)], "v >= 2.5": [("v", ">=", 2.5)], "v < 2": [("v", "<", 2)], "v <= 1.5 and n = 3": [("v", "<=", 1.5), ("n", "==", 3)], "v = 8 and n = 1": [("v", "==", 8), ("n", "==", 1)],
        "v in (1.5, 8.0)": [("v", "in", [1.5, 8])], "v is not null and t > 100": [("v", "known", None), ("t", ">", 100)], "t between 40.5 and 60": [("t", ">=", 40.5), ("t", "<=", 60)], "n = 1.0": [("n", "==", 1.0)],
    }
    for test, where in tests.items():
        assert sorted(r["t"] for r in arrays(path, where, nulls="true").collect()) == sorted(r["t"] for r in rows.where(test).collect()), test
    # several scans of one DataFrame don't share what they select
    assert back.where("t < 10").union(back.where("t >= 100")).count() == 10 + 110
    for where in ([("v", "~", 1)], [("v", ">", "x")], [("missing", ">", 1)], [("v", ">", float("nan"))]):
        with pytest.raises(Exception, match="no such condition"):
            arrays(path, where).collect()


def test_types_and_shapes(spark, arrays, tmp_path):
    rows = spark.range(100).select(
        F.col("id").alias("t"), F.timestamp_micros(F.col("id") * 1_000_001).alias("when"), F.col("id").cast("byte").alias("b"), F.col("id").cast("short").alias("s"), F.col("id").cast("float").alias("f"),
        F.when(F.col("id") % 7 > 0, F.array(F.col("id").cast("double"), F.lit(None), F.lit(2.0))).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("ünï "), "id")).alias("c"),
    )
    path = str(tmp_path / "out")
    rows.repartition(4).write.format("arrays").mode("append").save(path)
    back = {r["t"]: r for r in arrays(path, nulls="true").collect()}
    for r in rows.collect():
        got = back[r["t"]]
        assert (got["b"], got["s"], got["f"], got["c"]) == (r["b"], r["s"], r["f"], r["c"] or "")
        assert got["a"] == (r["a"] or [None] * 3) and got["when"] == r["t"] * 1_000_001
    assert len(back) == 100
    with pytest.raises(Exception, match="set the option width"):
        rows.select("t", F.lit("x" * 99).alias("c")).write.format("arrays").mode("append").save(path)
    assert arrays(path).count() == 100 and not glob.glob(f"{path}/_staging*/*")
    rows.where("t < 5").select("t").write.format("arrays").mode("overwrite").save(path)
    assert sorted(r["t"] for r in arrays(path).collect()) == [0, 1, 2, 3, 4]
    rows.limit(0).write.format("arrays").mode("overwrite").save(path)
    assert arrays(path).count() == 0
    with pytest.raises(Exception, match="several lengths"):
        spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "a array<double>").coalesce(1).write.format("arrays").mode("append").save(path)
    with pytest.raises(Exception, match="no type"):
        spark.sql("select map('a', 1) as m").write.format("arrays").mode("append").save(path)
