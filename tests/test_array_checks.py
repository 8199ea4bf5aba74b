"""Limits and deltas of arrays of several dimensions, along every axis and from record to record."""

import itertools

import pytest

from gridloom.operators import qc

SHAPE = [4, 5]
SCHEMA = "s string, t long, v array<float>, q array<int>"


def data():
    """Three records of four by five, and the record before them."""
    before = [k + 0.5 for k in range(20)]
    before[2], before[3] = -9999.0, before[3] - 1
    own = [20 + k + 0.5 for k in range(60)]
    for part, value in ((range(10, 15), -9999.0), (range(47, 52), -8888.0), (range(18, 23), 40.0), (range(35, 40), 57.0)):
        for k in part:
            own[k] = value
    return before, own


def brute(before, own, deltas, bad):
    flag = lambda x: 1 if x == -9999 else 2 if x == -8888 else 4 if x < 22 else 8 if x > 77 else 0
    values = {(r, i, j): own[20 * r + 5 * i + j] for r, i, j in itertools.product(range(3), range(4), range(5))}
    limits = {k: flag(x) for k, x in values.items()}
    if before is not None:
        values |= {(-1, i, j): before[5 * i + j] for i, j in itertools.product(range(4), range(5))}
        limits |= {(-1, i, j): 1 if before[5 * i + j] == -9999 else 0 for i, j in itertools.product(range(4), range(5))}
    out = dict(limits)
    for k, x in values.items():
        for axis, delta in enumerate(deltas):
            last = tuple(n - (a == axis) for a, n in enumerate(k))
            if delta and last in values and not limits[k] & bad and not limits[last] & bad and abs(x - values[last]) > delta:
                out[k] |= (0x10, 0x20, 0x40)[axis]
    return [[out[r, i, j] for i in range(4) for j in range(5)] for r in range(3)]


@pytest.mark.parametrize("prior", [False, True])
@pytest.mark.parametrize("deltas", [[20.0], [20.0, 5.0], [20.0, 5.0, 1.0], [0.0, 0.0, 1.0]])
def test_deltas_along_axes(spark, prior, deltas):
    before, own = data()
    rows = spark.createDataFrame([("a", r, own[20 * r : 20 * r + 20], None) for r in range(3)] + [("b", 0, [1.0], None), ("b", 1, None, None)], SCHEMA)
    rows = rows.withColumn("q", qc.limits_arrays(rows["v"], missing=[-9999.0, -8888.0], missing_flags=[1, 2], low=22.0, high=77.0))
    earlier = spark.createDataFrame([("a", -1, before, [int(x == -9999) for x in before])], SCHEMA) if prior else None
    found = qc.delta_arrays(rows, ["s"], ["t"], "v", "q", SHAPE, deltas, [0x10, 0x20, 0x40], 10, bad=15, before=earlier).orderBy("s", "t").collect()
    want = brute(before if prior else None, own, deltas, 15)
    assert [r["q"] for r in found[:3]] == want
    assert found[3]["q"] == [4] and found[4]["q"] is None
    if deltas == [20.0] and not prior:
        assert [want[r][k] for k in (0, 2, 3, 7) for r in range(3)] == [4, 0, 16, 0, 0, 16, 0, 0, 0, 0, 0, 2]


def test_places_in_arrays(spark):
    from pyspark.sql import functions as F

    assert qc.strides([2, 3, 4]) == [12, 4, 1] and qc.strides([7]) == [1]
    got = [tuple(r)[1:] for r in spark.range(24).select("id", *[p.alias(f"p{k}") for k, p in enumerate(qc.place(F.col("id"), [2, 3, 4]))]).orderBy("id").collect()]
    assert got == list(itertools.product(range(2), range(3), range(4)))
