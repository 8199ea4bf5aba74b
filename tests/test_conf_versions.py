"""Configurations chosen by each file's name and time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.sources import csv_ingest


def us(*when):
    return int(dt.datetime(*when, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


def conf(header, pattern, delimiter=",", field="v: V", time=True):
    names = "FILE_TIME_PATTERNS: met[.]%0Y%0m%0d[.]csv\n" if time else ""
    return csv_ingest.parse_conf(f"DELIMITER: {delimiter}\nHEADER: {header}\nFILE_NAME_PATTERNS: {pattern}\n{names}TIME_COLUMNS:\n  T: %Y-%m-%d %H:%M\nFIELD_MAP:\n  {field}\n")


def test_versions(spark, tmp_path):
    versions = [
        (us(2024, 2, 1), conf("V,T", r"met\..*csv", ";")), (None, conf("T,V", r"met\..*csv")), (us(2024, 3, 1), conf("T,X", r"met\..*csv", field="x: X")), (None, conf("T,V", r"rain.*", time=False)),
    ]
    for name, text in {
        "met.20240115.csv": "2024-01-15 10:00,1\nbad\n", "met.20240201.csv": "2;2024-02-01 10:00\n", "met.20240229.csv": "3;2024-02-29 10:00\n", "met.20240401.csv": "2024-04-01 10:00,4\n",
        "rain7": "2024-05-01 10:00,5\n", "other": "2024-05-01 10:00,9\n",
    }.items():
        (tmp_path / name).write_text(text)
    rows, bad = csv_ingest.samples_by_version(spark, str(tmp_path), versions)
    got = sorted((r["version"], r["t"], r["v"], r["x"]) for r in rows.collect())
    assert got == [(0, us(2024, 2, 1, 10), 2.0, None), (0, us(2024, 2, 29, 10), 3.0, None), (1, us(2024, 1, 15, 10), 1.0, None), (2, us(2024, 4, 1, 10), None, 4.0), (3, us(2024, 5, 1, 10), 5.0, None)]
    assert [(r["line"], r["version"], r["rejected"]) for r in bad.collect()] == [("bad", 1, "cells")]
    names = spark.createDataFrame([("/a/met.20231231.csv",), ("/a/met.none.csv",), ("/a/x",)], "f string")
    # a name without a time takes the version that is valid since last; one of before all but the first takes that
    assert [r["k"] for r in names.select("f", csv_ingest.version_of(F.col("f"), versions).alias("k")).orderBy("f").collect()] == [1, 2, None]
    with pytest.raises(ValueError, match="no configuration"):
        csv_ingest.samples_by_version(spark, str(tmp_path / "other"), versions)


def test_parts_of_times_once(spark, tmp_path):
    """The parts of a time are cut out once for a row, and only lines that hold all names are split in search of headers."""
    import io
    from contextlib import redirect_stdout

    from pyspark.sql import functions as F

    from gridloom.functions import times
    from gridloom.sources import csv_ingest

    rows = spark.createDataFrame([("x 2024-02-29 7:05:09.5 y",), ("2023-02-29 07:05:09",), ("no",), (None,)], "s string")
    found = rows.select(times.first_match(["%Y-%m-%d %H:%M:%S"], F.col("s")).alias("t"))
    assert [r["t"] for r in found.collect()] == [1_709_190_309_500_000, None, None, None]
    text = io.StringIO()
    with redirect_stdout(text):
        found.explain()
    assert 0 < text.getvalue().count("regexp_extract(") <= 6
    (tmp_path / "a.csv").write_text("junk\n 'Date' ,\"He said \"\"T\"\"\",Temp\n2024-01-01,1,2\n")
    conf = csv_ingest.CsvConf(time_columns={"Date": ("%Y-%m-%d",)}, fields=[csv_ingest.FieldMap("v", 'He said "T"')])
    got = csv_ingest.samples(csv_ingest.records(csv_ingest.read_lines(spark, str(tmp_path)), conf, file="file"), conf).collect()
    assert [(r["t"], r["v"]) for r in got] == [(1_704_067_200_000_000, 1.0)]
