"""Arriving files: batches that run again, archive and quarantine."""

import datetime as dt
import os

import pytest

from gridloom.operators import mapping
from gridloom.plans import ingest, process
from gridloom.sources import csv_ingest, store
from gridloom.streaming.arrivals import Arrivals

CONF = """
HEADER: WHEN, V
FILE_NAME_PATTERNS: raw.*[.]csv
TIME_COLUMNS:
  WHEN: %Y-%m-%d %H:%M
FIELD_MAP:
  v: V
"""


class Failing(Arrivals):
    """Fails in some batches, after all is stored but before the stream knows."""

    fails = ()

    def batch(self, lines, n):
        super().batch(lines, n)
        if n in self.fails:
            self.fails = tuple(x for x in self.fails if x != n)
            raise RuntimeError("lost")


@pytest.fixture
def arrivals(spark, tmp_path):
    out = process.Output(str(tmp_path / "out"), ["t"], [mapping.Target("v", "v", "double")], split_mode="months")
    for folder in ("in", "in2"):
        (tmp_path / folder).mkdir()
    made = ingest.CsvIngest(spark, csv_ingest.parse_conf(CONF), out, "met")
    return Failing(made, str(tmp_path / "in*"), str(tmp_path / "done"), str(tmp_path / "bad"), str(tmp_path / "state"), most_files=1)


def put(tmp_path, name, text, at, folder="in"):
    path = tmp_path / folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def names(folder):
    return sorted(x for x in os.listdir(folder) if not x.startswith(".")) if os.path.isdir(folder) else []


def test_batches_that_run_again(spark, tmp_path, arrivals):
    for k in range(4):
        put(tmp_path, f"raw{k}.csv", f"2024-01-0{k + 1} 10:00,{k}\n2024-01-0{k + 1} 10:30,{k}.5\nbroken\n", 1000 + k)
    put(tmp_path, "raw5.csv", "no,times,here\nnor,here\n", 1010)
    put(tmp_path, "other.txt", "2024-01-09 10:00,1\n", 1020)
    arrivals.fails = (1, 3)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            arrivals.run()
    # the files of a batch that failed are still there
    assert "raw3.csv" in names(tmp_path / "in") and "raw0.csv" not in names(tmp_path / "in")
    assert arrivals.run() == []
    got = sorted(r["v"] for r in store.read(spark, str(tmp_path / "out")).collect())
    assert got == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5]
    assert arrivals.process.rejected().count() == 4 + 2
    assert sorted((r["records"], r["rejected"]) for r in arrivals.ledger().collect()) == [(2, 2)] + [(3, 1)] * 4
    assert names(tmp_path / "in") == ["other.txt"]
    assert names(tmp_path / "done") == [f"met.2024010{k + 1}.100000.raw.raw{k}.csv" for k in range(4)]
    assert [x.split(".")[-3:] for x in names(tmp_path / "bad")] == [["bad", "raw5", "csv"]]
    # files that come later, one with the content of an archived file and one that takes its name
    put(tmp_path, "raw2.csv", "2024-01-03 10:00,2\n2024-01-03 10:30,2.5\nbroken\n", 2000, "in2")
    put(tmp_path, "raw1.csv", "2024-01-02 10:00,77\n", 2001, "in2")
    put(tmp_path, "raw8.csv", "2024-01-01 10:00,88\n2024-01-08 10:00,8\n", 2002, "in2")
    assert [x[-8:] for x in arrivals.run()] == ["raw1.csv"]
    assert names(tmp_path / "in2") == ["raw1.csv"] and len(names(tmp_path / "done")) == 5
    assert sorted(r["v"] for r in store.read(spark, str(tmp_path / "out")).collect()) == [*got, 8.0]


def test_an_ingest_of_the_same_files_stores_nothing_twice(spark, tmp_path, arrivals):
    put(tmp_path, "raw0.csv", "2024-01-01 10:00,1\nbroken\n", 1000)
    p = arrivals.process
    assert p.ingest(str(tmp_path / "in")) == {"records": 2, "rejected": 1, "stored": 1}
    assert p.ingest(str(tmp_path / "in")) == {"records": 2, "rejected": 1, "stored": 0}
    assert p.ingest(str(tmp_path / "in"), "x") == {"records": 2, "rejected": 1, "stored": 0}
    assert p.rejected().count() == 1 and store.read(spark, str(tmp_path / "out")).count() == 1
    put(tmp_path, "raw1.csv", "2024-06-01 10:00,1\n", 1000)
    read = []
    p.stored = lambda begin, end: read.append((begin, end))
    p.ingest(str(tmp_path / "in") + "/raw1.csv")
    t = int(dt.datetime(2024, 6, 1, 10, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert read == [(t, t + 1)]


def test_records_that_span_lines(spark, tmp_path, arrivals):
    arrivals.process.conf.multiline, arrivals.process.conf.header = True, ("WHEN", "V", "REMARK")
    put(tmp_path, "raw0.csv", '2024-01-01 10:00,1,"a\nb"\n2024-01-01 10:10,2,\'c\n\'\n', 1000)
    assert arrivals.run() == [] and names(tmp_path / "in") == []
    assert sorted(r["v"] for r in store.read(spark, str(tmp_path / "out")).collect()) == [1.0, 2.0]
