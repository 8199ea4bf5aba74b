import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text, times
from gridloom.operators import grid, mapping
from gridloom.plans import params, process, transform
from gridloom.sources import csv_ingest, store
from gridloom.streaming import pipelines

DAY = process.DAY
UTC = dt.timezone.utc


def us(*when):
    return int(dt.datetime(*when, tzinfo=UTC).timestamp() * 1_000_000)


def test_parameters():
    p = params.parse("""
    # comment
    time:transform = bin_average;
    range:values = 1, 2,
        3.5;
    var_1:time:width = 60; var_1:missing = -9999;
    """)
    assert p.get("range", "values", float) == [1, 2, 3.5] and p.get("time", "transform") == "bin_average"
    assert p.for_dimension("var_1", "time", "width", int) == 60 and p.for_dimension("var_2", "time", "transform") == "bin_average"
    child = params.Params(p)
    child.set("time", "transform", "x")
    assert child.get("time", "transform") == "x" and child.get("var_1", "missing", float) == -9999 and params.parse(str(p)).values == p.values
    with pytest.raises(ValueError):
        params.parse("nonsense;")
    assert params.dimension_groups("{time}, {station:lat,lon}") == [("time", ["time"]), ("station", ["lat", "lon"])]


def test_files_of_parameters(tmp_path):
    for name in ("abc", "abc.b1", "northabc.b1"):
        (tmp_path / name).write_text("")
    assert params.find_file([str(tmp_path)], "north", "C1", "abc", "b1").name == "northabc.b1"
    assert params.find_file([str(tmp_path)], "south", "C1", "abc", "b1").name == "abc.b1"
    assert params.find_file([str(tmp_path)], "south", "C1", "xyz", "b1") is None


def test_time_patterns(spark):
    cases = [
        ("%Y-%m-%d %H:%M:%S", "2024-02-29 12:30:15.25", us(2024, 2, 29, 12, 30, 15) + 250_000), ("%Y-%m-%d", "2023-02-29", None), ("%Y-%m-%d", "nothing", None),
        ("%m/%d/%y %h", "1/5/99 930", us(1999, 1, 5, 9, 30)), ("%Y %j", "2024 60", us(2024, 2, 29)), ("%d %b %Y %H:%M %p", "05 Mar 2020 12:05 AM", us(2020, 3, 5, 0, 5)), ("%s", "1700000000", 1_700_000_000_000_000),
        (r"x\.%0Y%0m%0d\.%0H%0M%0S\.", "x.20240102.030405.cdf", us(2024, 1, 2, 3, 4, 5)), ("%H:%M", "25:00", None),
    ]
    parts = {"year": F.lit(2020), "month": F.lit(1), "day": F.lit(1)}
    for pattern, said, want in cases:
        row = spark.range(1).select(times.TimePattern(pattern).parse(F.lit(said), **(parts if pattern == "%H:%M" else {})).alias("t")).first()
        assert row["t"] == want, (pattern, said)


def test_splits(spark):
    t = us(2024, 3, 17, 14, 30)
    want = {("hours", 1): us(2024, 3, 17, 14), ("hours", 6, 1): us(2024, 3, 17, 13), ("days", 1): us(2024, 3, 17), ("days", 10): us(2024, 3, 11), ("months", 1): us(2024, 3, 1), ("months", 3): us(2024, 1, 1), ("years", 1): us(2024, 1, 1), ("days", 1, 0, -7.0): us(2024, 3, 17, 7)}
    row = spark.range(1).select(*[times.split_key(F.lit(t), *k).alias(str(i)) for i, k in enumerate(want)]).first()
    assert list(row) == list(want.values())
    assert times.parse_split("daily") == ("days", 1) and times.parse_split("6 hours") == ("hours", 6)
    with pytest.raises(ValueError):
        times.parse_split("fortnightly")


def test_text(spark):
    row = spark.createDataFrame([('a, "b,c" ,d', "x  y   z", "f10.v9", "1, x, 3")], "l string, s string, n string, a string").select(
        text.split_delimited(F.col("l")).alias("l"), text.split_delimited(F.col("s"), " ").alias("s"), text.count_delimiters(F.col("l")).alias("c"), text.to_array(F.col("a"), "int", fill=-1).alias("a"),
        text.first_difference(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0))).alias("d"),
    ).first()
    assert row["l"] == ["a", "b,c", "d"] and row["s"] == ["x", "y", "z"] and row["c"] == 2 and row["a"] == [1, -1, 3] and row["d"] == 1


def test_csv_files(spark, tmp_path):
    conf = csv_ingest.parse_conf("""
    HEADER: TIME, V1, V2
    FILE_TIME_PATTERNS: raw.%0Y%0m%0d.csv
    TIME_COLUMNS:
      TIME: %H:%M
    FIELD_MAP:
      temp: V1, degF, -99
      state: V2
    """)
    conf.fields[0].out_unit, conf.fields[1].texts = "degC", {"on": 1.0, "off": 0.0}
    (tmp_path / "raw.20240131.csv").write_text("23:00,212,On\n23:30,-99,off\n00:10,32,\nbad\nxx,1,2\n")
    lines = csv_ingest.read_lines(spark, str(tmp_path))
    rows = csv_ingest.records(lines.withColumn("k", F.monotonically_increasing_id()), conf, file="file")
    assert sorted(r["rejected"] for r in rows.where("rejected is not null").collect()) == ["cells", "time"]
    rolled = csv_ingest.roll_over(rows.where("rejected is null"), ["file"], "k")
    got = [tuple(r) for r in csv_ingest.samples(rolled, conf).orderBy("t").collect()]
    assert [(t, c if c is None else round(c, 9), x) for t, c, x in got] == [(us(2024, 1, 31, 23), 100.0, 1.0), (us(2024, 1, 31, 23, 30), None, 0.0), (us(2024, 2, 1, 0, 10), 0.0, None)]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(us(2024, 1, d, h), float(d)) for d in range(1, 5) for h in (0, 12)], "t long, v double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        store.write(rows, path, fmt=fmt)
        back = store.read(spark, path, us(2024, 1, 2), us(2024, 1, 3, 12), fmt=fmt).orderBy("t").collect()
        assert [int(r["t"]) for r in back] == [us(2024, 1, 2), us(2024, 1, 2, 12), us(2024, 1, 3)]
    path = str(tmp_path / "parquet")
    store.write(rows.where(F.col("v") == 2).withColumn("v", F.lit(20.0)), path, save_mode="overwrite")
    assert sorted(r["v"] for r in store.read(spark, path).collect()) == [1, 1, 3, 3, 4, 4, 20, 20]
    files = store.manifest(spark, path)
    assert files.count() == 4 and store.overlapping(files, us(2024, 1, 2, 6), us(2024, 1, 3)).count() == 2


def test_transforms(spark):
    rows = spark.createDataFrame([(float(x), float(h), x + 10.0 * h, 0) for x in range(0, 40, 2) for h in (0, 1, 2)], "x double, h double, value double, qc int")
    steps = [
        {"dim": "x", "method": "bin_average", "targets": grid.regular(spark, 5.0, 10.0, 4), "chunk": 1000.0, "width": 10.0},
        {"dim": "h", "method": "interpolate", "targets": grid.from_values(spark, [0.5, 1.5]), "chunk": 1000.0},
    ]
    got = {(r["x"], r["h"]): r["value"] for r in transform.serial(rows, steps, ["x", "h"]).collect()}
    assert got == {(5.0 + 10 * k, h): 4.0 + 10 * k + 10 * h for k in range(4) for h in (0.5, 1.5)}
    transform.register("twice", lambda rows, targets, series: rows.withColumn("value", F.col("value") * 2))
    assert transform.transform(rows, rows, [], "twice", chunk=1.0).agg(F.sum("value")).first()[0] == 2 * rows.agg(F.sum("value")).first()[0]
    for method in ("multi_dimensional", "unknown"):
        with pytest.raises(ValueError):
            transform.transform(rows, rows, [], method, chunk=1.0)
    assert transform.choose(1, 2) == "bin_average" and transform.choose(2, 2) == "interpolate" and transform.choose(None, 2) == "passthrough"


def test_schemas(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "a long, b string, c double")
    b = a.select(F.col("a").cast("int").alias("a"), F.col("c").alias("c", metadata={"units": "m"}), F.lit(1).alias("d"))
    assert [x[:2] for x in mapping.compare_schemas(a, b)] == [("a", "type"), ("b", "removed"), ("c", "attributes"), ("d", "added")]


def test_process(spark, tmp_path):
    data = spark.createDataFrame([(us(2024, 1, 1 + h // 24, h % 24), float(h), 0) for h in range(72)], "t long, v double, qc_v int")
    called = []

    class Mine(process.Process):
        def init_process_hook(self):
            called.append("init")

        def transform_hook(self, begin, end):
            rows = self.inputs["in"]
            self.transformed = {"out": process.add_quality(rows, "v", (3, F.col("v") > 60))}

        def finish_process_hook(self):
            called.append("finish")

    empty = lambda s: data.where("false")
    out = process.Output(str(tmp_path / "out"), ["t"], [mapping.Target("speed", "v", "double", "m/s", "km/h")])
    p = Mine(spark, {"in": process.Input([empty, lambda s: data], value="v")}, {"out": out})
    assert p.run(us(2024, 1, 1), us(2024, 1, 4)) == 3 and p.run(us(2024, 1, 1), us(2024, 1, 4)) == 3 and called == ["init", "finish"] * 2
    got = {r["t"]: (r["speed"], r["qc_speed"]) for r in store.read(spark, out.path).collect()}
    assert len(got) == 72 and abs(got[us(2024, 1, 3, 23)][0] - 71 * 3.6) < 1e-9 and got[us(2024, 1, 3, 23)][1] == 4
    assert list(process.intervals(0, 25, 10)) == [(0, 10), (10, 20)] and list(process.intervals(0, 5, 10)) == [(0, 5)]
    assert process.real_time_end({"a": 25, "b": 38}, 40, 0, 10, max_wait=20) == 20
    assert process.real_time_end({"a": 5, "b": 38}, 40, 0, 10, max_wait=20) == 30 and process.real_time_end({"a": 5}, 40, 0, 10) is None


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k % 2}", dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=10 * k), float(k), 1 if k == 4 else 0) for k in range(60)], "series string, ts timestamp, value double, qc int")
    source = str(tmp_path / "in")
    for k in range(3):
        rows.where((F.col("value") >= 20 * k) & (F.col("value") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def collect(frame, name):
        out = str(tmp_path / name)
        pipelines.sink(frame, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / f"{name}-state")).awaitTermination(120)
        return spark.read.parquet(out)

    hourly = collect(pipelines.averages(stream(), ["series"], "1 hour", max_wait="1 hour"), "hourly").collect()
    got = {(r["series"], r["start"].hour): (r["value"], r["value_goodfraction"], r["qc"]) for r in hourly}
    assert got["s1", 0] == (3.0, 1.0, 0) and got["s0", 0] == (1.0, 2 / 3, 32) and ("s0", 9) not in got
    twice = stream().unionByName(stream())
    assert collect(pipelines.distinct_samples(twice, ["series", "ts"]), "distinct").count() == 60
    out = str(tmp_path / "steps")
    write = lambda df, n: df.write.mode("append").parquet(out)
    pipelines.start_step_checks(stream(), ["series"], write, str(tmp_path / "last"), f"{out}-state", most_delta=1.5, least_step=1500.0, most_step=3000.0).awaitTermination(120)
    checked = spark.read.parquet(out)
    flags = {(r["series"], r["value"]): r["qc"] for r in checked.collect()}
    assert len(flags) == 60 and flags["s0", 0.0] == 0 and flags["s0", 4.0] == 1 | 32 and flags["s0", 2.0] == 8 | 32 and flags["s0", 40.0] == 8 | 32
