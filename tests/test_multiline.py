"""Quotes: cells of a line, and records that span lines and blocks."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.sources import csv_ingest, multiline


def cells(line, delimiter=","):
    """One character after another."""
    out, own, quote = [], "", ""
    for c in line.strip(" ") if delimiter == " " else line:
        if not quote and c == delimiter:
            if not (delimiter == " " and own == "" and out):
                out.append(own)
            own = ""
            continue
        quote = "" if quote == c else quote if quote else c if c in "\"'" else ""
        own += c
    out = [x.strip() for x in [*out, own]]
    return [x[1:-1].replace('""', '"') if len(x) > 1 and x[0] == x[-1] == '"' else x[1:-1] if len(x) > 1 and x[0] == x[-1] == "'" else x for x in out]


@pytest.mark.parametrize("most", [1000, -1])
def test_cells(spark, monkeypatch, most):
    monkeypatch.setattr(text, "_MOST_QUOTES", most)
    fixed = {
        'a,b,"c': ["a", "b", '"c'], '1,2,"3,4" x,5': ["1", "2", '"3,4" x', "5"], "ab,c": ["ab", "c"], "'a,b',\"it's\",d": ["a,b", "it's", "d"], "": [""], ",": ["", ""], ",,x": ["", "", "x"],
        '"say ""a"", b",""': ['say "a", b', ""], "'": ["'"], '"a\nb",c': ["a\nb", "c"], " a , b ": ["a", "b"],
    }
    rnd = random.Random(1)
    lines = list(fixed) + ["".join(rnd.choice("ab,,\"\"' ") for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    for delimiter in (",", " "):
        got = {r["k"]: r["c"] for r in frame.select("k", text.split_delimited(F.col("line"), delimiter).alias("c")).collect()}
        for k, line in enumerate(lines):
            assert got[k] == cells(line, delimiter), (line, delimiter)
            assert delimiter == " " or line not in fixed or got[k] == fixed[line]
    assert frame.where("k = 1").select(text.count_delimiters(F.col("line"))).first()[0] == 3


def test_a_line_with_many_quotes(spark):
    line = ",".join('"a,b"' for _ in range(3000))
    assert spark.createDataFrame([(line,)], "line string").select(F.size(text.split_delimited(F.col("line")))).first()[0] == 3000


def records(data):
    out, own, quote = [], "", ""
    for c in data:
        if c == "\n" and not quote:
            out.append(own)
            own = ""
            continue
        quote = "" if quote == c else quote if quote else c if c in "\"'" else ""
        own += c
    return out + ([own] if own else [])


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_records_across_blocks(spark, tmp_path, size):
    rnd = random.Random(size)
    want = {}
    for k in range(2):
        data = "".join(rnd.choice(["ab,", "1", '"x\ny"', "'p\n\n\"q'", "\n", "\n", 'say ""', "'\n\n\n\n\n\n\n\n\n\n\n\n'"]) for _ in range(60)) + "\n"
        data += "" if k else "'open\nto the end\n"
        (tmp_path / f"f{k}.csv").write_text(data)
        want[f"f{k}.csv"] = records(data)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = csv_ingest.read_lines(spark, str(tmp_path), csv_ingest.CsvConf(multiline=True))
        if size == 40:
            assert multiline.entering(csv_ingest.read_lines(spark, str(tmp_path))).count() > 8
        got = {}
        for r in lines.orderBy("file", "at").collect():
            got.setdefault(r["file"].rpartition("/")[2], []).append(r["line"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    trimmed = lambda x: x[:-1] if x.endswith("\n") and x.startswith("'open") else x
    assert got == {f: [trimmed(x) for x in xs] for f, xs in want.items()}


def test_line_ends_and_headers(spark, tmp_path):
    conf = csv_ingest.parse_conf("""
    TIME_COLUMNS:
      T: %Y-%m-%d
    MULTILINE: yes
    FIELD_MAP:
      v: V
    """)
    (tmp_path / "a.csv").write_bytes(b"T,V,R\r\n2024-01-01,1,\"x\r\ny\"\r\nA,T,V\r\n2024-01-02,2,z\r\n")
    (tmp_path / "b.csv").write_bytes(b"V,T\r5,2024-01-05\r6,2024-01-06\r")
    found = csv_ingest.records(csv_ingest.read_lines(spark, str(tmp_path), conf), conf, file="file")
    got = {(r["file"][-5:], r["rejected"], r["cells"]["V"], r["cells"].get("R")) for r in found.collect()}
    assert got == {("a.csv", None, "1", "x\ny"), ("a.csv", "time", "T", "V"), ("a.csv", None, "2", "z"), ("b.csv", None, "5", None), ("b.csv", None, "6", None)}


def test_texts_and_turns(spark):
    conf = csv_ingest.parse_conf("HEADER: T, V\nTIME_COLUMNS:\n  T: %Y-%m-%d\nFIELD_MAP:\n  v: V, , -9")
    conf.fields[0].texts = {"on": 1.0}
    rows = csv_ingest.records(spark.createDataFrame([("2024-01-01,On",), ("2024-01-01,-9",), ("2024-01-01,",), ("2024-01-01,3",)], "line string"), conf)
    assert sorted(map(str, (r["v"] for r in csv_ingest.samples(rows, conf).collect()))) == ["1.0", "3.0", "None", "None"]
    odd = csv_ingest.records(spark.createDataFrame([("2024-01-01,what",)], "line string"), conf)
    with pytest.raises(Exception, match="no number stands for the text what"):
        csv_ingest.samples(odd, conf).collect()
    conf.strict_texts = False
    assert csv_ingest.samples(odd, conf).first()["v"] is None
    day = 86_400_000_000
    turns = spark.createDataFrame([(0, 300 * day), (1, 360 * day), (2, 5 * day), (3, 200 * day), (4, 2 * day)], "k long, t long")
    got = [r["t"] // day for r in csv_ingest.roll_over(turns.withColumn("f", F.lit("x")), ["f"], "k", part="years").orderBy("k").collect()]
    assert got == [300, 360, 365 + 5, 365 + 200, 730 + 2]
    turns = spark.createDataFrame([(0, 25 * day), (1, 2 * day), (2, 29 * day), (3, 0)], "k long, t long")
    got = [r["t"] // day for r in csv_ingest.roll_over(turns.withColumn("f", F.lit("x")), ["f"], "k", part="months").orderBy("k").collect()]
    assert got == [25, 31 + 2, 31 + 27, 31 + 28] or got == [25, 33, 58, 59]
