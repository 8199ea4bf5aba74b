"""Classic array files, against files that are put together here byte by byte."""

import struct

import pytest

from gridloom.functions import metadata
from gridloom.sources import netcdf


def name(text):
    data = text.encode()
    return struct.pack(">i", len(data)) + data + b"\0" * (-len(data) % 4)


def by_hand(version, records=3):
    """time unlimited, level 2, letters 4; static scalar and level(level), text(time, letters), x(time) short, y(time, level) double."""
    offset = ">i" if version == 1 else ">q"

    def build(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", records)
        out += struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("level") + struct.pack(">i", 2) + name("letters") + struct.pack(">i", 4)
        out += struct.pack(">ii", 12, 1) + name("title") + struct.pack(">ii", 2, 3) + b"abc\0"
        out += struct.pack(">ii", 11, 5)
        fill = struct.pack(">ii", 12, 1) + name("missing_value") + struct.pack(">iih", 3, 1, -99) + b"\0\0"
        none = struct.pack(">ii", 0, 0)
        for k, (v, dims, attributes, kind, size) in enumerate([("station", [], none, 4, 4), ("level", [1], none, 5, 8), ("text", [0, 2], none, 2, 4), ("x", [0], fill, 3, 4), ("y", [0, 1], none, 6, 16)]):
            out += name(v) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", d) for d in dims) + attributes + struct.pack(">ii", kind, size) + struct.pack(offset, begins[k])
        return out

    head = len(build([0] * 5))
    data = struct.pack(">i", 7) + struct.pack(">2f", 0.5, 1.5)
    begins = [head, head + 4, head + 12, head + 16, head + 20]
    for t in range(records):
        data += f"t{t}".encode().ljust(4, b"\0") + struct.pack(">h", -99 if t == 1 else t * 10) + b"\0\0" + struct.pack(">2d", t, t + 0.25)
    return build(begins) + data


@pytest.mark.parametrize("version", [1, 2])
def test_files_by_hand(spark, tmp_path, version):
    (tmp_path / "a.nc").write_bytes(by_hand(version))
    (tmp_path / "b.nc").write_bytes(by_hand(version, 1))
    path = str(tmp_path)
    found = [(r["file"][-4:], r["index"], r["text"], r["x"], r["y"]) for r in netcdf.read(spark, path).orderBy("file", "index").collect()]
    assert found == [("a.nc", t, f"t{t}", (0, -99, 20)[t], [t, t + 0.25]) for t in range(3)] + [("b.nc", 0, "t0", 0, [0.0, 0.25])]
    part = netcdf.read(spark, path, variables=["x"], start=1, stop=3, nulls=True)
    assert [r["x"] for r in part.orderBy("index").collect()] == [None, 20] and metadata.attributes(part, "x") == {"missing_value": -99}
    assert {(r["variable"], r["value"]) for r in netcdf.static(spark, path).collect()} == {("station", "7"), ("level", "[0.5, 1.5]")}
    said = {(r["kind"], r["variable"], r["name"]): (r["type"], r["value"], r["length"]) for r in netcdf.describe(spark, f"{path}/a.nc").collect()}
    assert said["dimension", None, "time"] == ("unlimited", None, 3) and said["attribute", None, "title"][1] == '"abc"' and said["variable", "y", "y"] == ("double", '["time", "level"]', 6)
    with pytest.raises(ValueError):
        netcdf.read(spark, path, variables=["level"])
    # a file that a stream wrote doesn't say how many records it has
    (tmp_path / "c.nc").write_bytes(by_hand(version).replace(struct.pack(">i", 3), struct.pack(">i", -1), 1))
    assert netcdf.read(spark, f"{path}/c.nc").count() == 3


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k % 2}", k, 1.5 * k if k % 5 else None, k % 3, f"text {k}" if k % 4 else None) for k in range(40)], "file string, t long, v double, n short, s string")
    rows = metadata.with_attributes(rows, "v", units="degC", missing_value=-1.0, valid_max=50.0)
    for r in netcdf.encode(rows, "file", order="t", attributes={"title": "made here", "levels": [1, 2]}).collect():
        (tmp_path / f"{r['file']}.nc").write_bytes(r["content"])
    back = netcdf.read(spark, str(tmp_path), nulls=True)
    got = {r["t"]: (r["file"][-5:-3], r["v"], r["n"], r["s"]) for r in back.collect()}
    assert got == {k: (f"f{k % 2}", 1.5 * k if k % 5 else None, k % 3, f"text {k}" if k % 4 else "") for k in range(40)}
    assert metadata.attributes(back, "v") == {"units": "degC", "missing_value": -1.0, "valid_max": 50.0}
    one = netcdf.encode(rows.select("file", "n"), "file").first()["content"]
    head = netcdf.header(one)
    assert head.stride == 2 and head.records == 20 and netcdf.values(one, head, "n").tolist() == [r["n"] for r in rows.where("file = 'f0'").collect()]


def test_bad_files():
    for data in (b"", b"HDF\x01", b"CDF\x03" + b"\0" * 40):
        with pytest.raises((ValueError, IndexError)):
            netcdf.header(data)
