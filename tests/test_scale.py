"""Long lines, long series and large batches: results don't depend on how rows are dealt out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text, units
from gridloom.operators import chunks, grid, nearest, qc
from gridloom.functions import metadata
from gridloom.plans import process, transform
from gridloom.operators import mapping
from gridloom.sources import csv_ingest, store
from gridloom.streaming import pipelines


def test_split_delimited(spark):
    lines = ['a,"b,c",d', ' x , "y" ,z ', 'say,"a ""b"", c"', '"",,""', "", 'odd "x,y', "one  two   three", '1 "2 3" 4']
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    got = [r["c"] for r in rows.select("k", text.split_delimited(F.col("line")).alias("c")).orderBy("k").collect()]
    assert got[:5] == [["a", "b,c", "d"], ["x", "y", "z"], ["say", 'a "b", c'], ["", "", ""], [""]]
    assert got[5] == ["odd \"x,y"] or got[5] == ['odd "x', "y"]
    spaced = [r["c"] for r in rows.select("k", text.split_delimited(F.col("line"), " ").alias("c")).orderBy("k").collect()]
    assert spaced[6:] == [["one", "two", "three"], ["1", "2 3", "4"]]


def test_long_lines(spark):
    rows = spark.createDataFrame([(",".join(['"a,b"'] * 100_000),), (",".join(["x"] * 100_000),)], "line string")
    assert [r["n"] for r in rows.select(F.size(text.split_delimited(F.col("line"))).alias("n")).collect()] == [100_000, 100_000]


@pytest.mark.parametrize("delimiter", [",", " ", "\t", "||", "|"])
def test_lines_read_piece_by_piece(spark, monkeypatch, delimiter):
    rnd = random.Random(delimiter)
    lines = ["", delimiter, delimiter * 3, None, f"\x01b{delimiter}\x01a\x01", f'"a{delimiter}b', "\n", f"x{delimiter}\n"]
    lines += ["".join(rnd.choice([delimiter, '"', "'", "a", " ", "|", "\x01", "b", "\n", "é"]) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string").coalesce(1)
    got = []
    for most in (1000, -1):
        monkeypatch.setattr(text, "_MOST_QUOTES", most)
        got.append(rows.orderBy("k").select(text.split_delimited(F.col("line"), delimiter).alias("c"), text.count_delimiters(F.col("line"), delimiter).alias("n")).collect())
    assert got[0] == got[1]


@pytest.mark.parametrize(
    "source,target,scale",
    [
        ("kg m-2 s-1", "g/(m^2 s)", 1000), ("m2", "cm^2", 1e4), ("1/cm3", "m-3", 1e6), ("kg kg-1", "g/kg", 1000), ("W/(m^2)", "W m**-2", 1), ("m/s", "km/h", 3.6), ("kW.h", "MJ", 3.6), ("J kg-1 K-1", "kJ/(kg degK)", 1e-3),
        ("mm per hour", "m/s", 1e-3 / 3600), ("hPa", "mbar", 1), ("counts", "1", 1), ("uW", "W", 1e-6), ("10 m", "m", 10), ("degC/km", "K/m", 1e-3), ("days", "s", 86400), ("m s^-1", "m s-1", 1), ("cm3 cm-3", "1", 1),
    ],
)
def test_units(source, target, scale):
    found, offset = units.factors(source, target)
    assert found == pytest.approx(scale) and offset == 0


def test_odd_units():
    assert units.factors("degC", "degF") == (pytest.approx(1.8), pytest.approx(32)) and units.compare("mbar", "hPa") == "equal" and units.compare("m", "s") == "different" and units.compare("m", "km") == "convertible"
    for bad in ("furlongs", "m/", "(m", "m)", "m^", "m^x", "kdegC", "^2", "m/s furlong", "m^1.5"):
        with pytest.raises(ValueError):
            units.parse(bad)


def test_header_lines_and_patterns(spark, tmp_path):
    for name, body in (("a1.csv", "made by x\nDate,Time,Temp,Record\n2024-01-01,00:00:00,1.5,7\nDate,Time\n"), ("b2.csv", "Record,Temp,Date,Time\n8,2.5,2024-01-02,00:00:01\n"), ("c.txt", "no,such,file\n")):
        (tmp_path / name).write_text(body)
    conf = csv_ingest.parse_conf("FILE_NAME_PATTERNS: [ab]\\d[.]csv\nTIME_COLUMNS:\n  Date: %Y-%m-%d\n  Time: %H:%M:%S\nFIELD_MAP:\n  t: Temp\n  r: Record\n")
    found = csv_ingest.records(csv_ingest.read_lines(spark, str(tmp_path), conf), conf, file="file")
    rows = [(r["rejected"], r["cells"] and r["cells"]["Temp"], r["cells"] and r["cells"]["Record"]) for r in found.collect()]
    assert sorted(rows, key=str) == [("cells", None, None), ("cells", None, None), (None, "1.5", "7"), (None, "2.5", "8")]
    with pytest.raises(ValueError):
        csv_ingest.records(spark.createDataFrame([("x",)], "line string"), conf)


def test_roll_over_in_chunks(spark):
    hour = 3_600_000_000
    rows = [("f", k, k * 7 % 24 * hour) for k in range(200)] + [("g", k, k * hour) for k in range(20)]
    want, before, days = {}, None, 0
    for f, k, t in rows:
        if before and before[0] == f:
            days += t - before[1] < -12 * hour
        else:
            days = 0
        before = (f, t)
        want[f, k] = t + days * 24 * hour
    for chunk in (7, 1000):
        got = csv_ingest.roll_over(spark.createDataFrame(rows, "f string, k long, t long").repartition(5), ["f"], "k", chunk=chunk)
        assert {(r["f"], r["k"]): r["t"] for r in got.collect()} == want


def test_numbers_over_the_whole_table(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r["n"] == r["v"] + 1 for r in chunks.numbered(rows, [F.col("v")], "n").collect())
    assert chunks.numbered(rows.limit(0), [F.col("v")], "n").collect() == []


@pytest.mark.parametrize("whole", [True, False])
def test_sampling_interval_of_jittered_steps(spark, whole):
    rnd, data = random.Random(2), []
    want = {}
    for s in ("a", "b", None):
        at, own = (0 if whole else 0.0), []
        for _ in range(rnd.randint(50, 300)):
            own.append(at)
            at += rnd.choice((0, 1, rnd.randint(1, 10**9))) if whole else rnd.random() * 10 ** rnd.randint(-3, 6)
        steps = sorted(b - a for a, b in zip(own, own[1:]))
        want[s] = steps[len(steps) // 2]
        data += [(s, x) for x in own]
    rows = spark.createDataFrame(data, f"s string, x {'long' if whole else 'double'}")
    assert {r["s"]: r["interval"] for r in grid.sampling_interval(rows, ["s"], "x", 10**9).collect()} == want


def test_long_grids(spark, monkeypatch):
    monkeypatch.setattr(grid, "PART_POINTS", 10)
    rows = spark.createDataFrame([("a", 5), ("a", 108), ("b", 3)], "s string, t long")
    got = sorted((r["s"], r["bin"], r["coord"]) for r in grid.per_series(rows, ["s"], "t", 3).collect())
    assert got == [("a", k, 5 + 3 * k) for k in range(35)] + [("b", 0, 3)]
    monkeypatch.setattr(transform, "_PART", 4)
    points = transform._for_all(rows, grid.regular(spark, 0.5, 2.0, 11), ["s"])
    assert sorted((r["s"], r["bin"], r["coord"]) for r in points.collect()) == [(s, k, 0.5 + 2 * k) for s in "ab" for k in range(11)]
    assert transform._for_all(rows, grid.from_values(spark, [1.0]).limit(0), ["s"]).collect() == []


def test_interpolation_reads_its_input_once(spark):
    rows = spark.range(50).select(F.lit("a").alias("s"), (F.col("id") * 10).alias("coord"), F.col("id").cast("double").alias("value"), F.lit(0).alias("qc"))
    found = nearest.interpolate(rows, grid.per_series(rows, ["s"], "coord", 3), ["s"], 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and plan.count("Exchange") <= 8 and "Range (" not in plan


def stepwise(rows, limits):
    """The checks sample by sample."""
    last, out = {}, {}
    for s, t, v, q, k in rows:
        flag = 0
        if s in last:
            step = (t - last[s][0]).total_seconds()
            flag |= 16 if step <= 0 else 32 if step < limits["least_step"] else 64 if step > limits["most_step"] else 0
            flag |= 8 if not q & 7 and not last[s][2] & 7 and abs(v - last[s][1]) > limits["most_delta"] else 0
        last[s] = (t, v, q)
        out[k] = q | flag
    return out


def test_stream_step_checks_in_any_order_of_rows(spark, tmp_path):
    rnd, start, limits = random.Random(4), dt.datetime(2024, 1, 1), {"most_delta": 30.0, "least_step": 60.0, "most_step": 3000.0}
    rows = []
    for batch in range(3):
        own = [(rnd.choice("abc"), start + dt.timedelta(seconds=rnd.randint(0, 90_000) + 60_000 * batch), float(rnd.randint(0, 60)), rnd.choice((0, 0, 1, 8)), len(rows) + k) for k in range(400)]
        shuffled = spark.createDataFrame(own, "series string, ts timestamp, value double, qc int, k long").repartition(1)
        shuffled.write.mode("append").parquet(str(tmp_path / "in"))
        rows += sorted(own, key=lambda r: (r[1], r[4]))
    schema = "series string, ts timestamp, value double, qc int, k long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, held = str(tmp_path / "out"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        write = lambda df, n: df.write.mode("append").parquet(out)
        pipelines.start_step_checks(stream, ["series"], write, str(tmp_path / "last"), str(tmp_path / "state"), ties=["k"], **limits).awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert {r["k"]: r["qc"] for r in spark.read.parquet(out).collect()} == stepwise(rows, limits)


def test_stored_rows_are_filtered_and_checked(spark, tmp_path):
    hour = 3_600_000_000
    rows = [(k * hour, float(k)) for k in range(10)] + [(3 * hour, 3.0), (5 * hour, -1.0)]
    data = metadata.with_attributes(spark.createDataFrame(rows, "t long, v double"), "v", valid_min=0.0, warn_max=7.5, missing_value=-9999.0)

    class Mine(process.Process):
        def map_outputs(self, begin, end):
            self.outputs = {"out": self.transformed["out"]}

    def run(path, **more):
        out = process.Output(str(tmp_path / path), ["t"], [mapping.Target("v", "v", "double")], standard_checks=True, **more)
        Mine(spark, {"out": process.Input([lambda s: data])}, {"out": out}).run(0, 10 * hour, 10 * hour)
        return {r["t"] // hour: (r["v"], r["qc_v"]) for r in store.read(spark, out.path).collect()}

    got = run("first", duplicates="first", earliest=0, latest=8 * hour)
    assert got == {k: (float(k), 256 if k > 7 else 0) for k in range(1, 9) if k != 5} | {5: (-1.0, 2)}
    with pytest.raises(Exception, match="same keys differ"):
        run("fail")


def test_standard_checks_describe_their_bits(spark):
    rows = metadata.with_attributes(spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "t long, v double"), "v", valid_max=40.0, fail_delta=3.0)
    found = qc.standard_checks(rows, ["v"], [], ["t"], 10)
    assert [r["qc_v"] for r in found.orderBy("t").collect()] == [0, 1, 4]
    held = metadata.attributes(found, "qc_v")
    assert held["bit_3_assessment"] == "Bad" and held["bit_7_description"] == "fail_delta is 3.0" and "bit_2_description" not in held
