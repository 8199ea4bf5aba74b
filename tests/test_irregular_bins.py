"""Bins of very different widths, and bins that change along the coordinate, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import bin_average, grid


def share(i0, i1, t0, t1):
    return 1.0 if i0 == i1 else 1 - max(0, (t0 - i0) / (i1 - i0)) - max(0, (i1 - t1) / (i1 - i0))


def brute(cells, bins):
    """{bin: (value, goodfraction, qc is outside)} by all pairs."""
    out = {}
    for s, b, t0, t1 in bins:
        met = [(share(i0, i1, t0, t1), i1 - i0, v, qc) for x, i0, i1, v, qc in cells if x == s and i1 >= t0 and i0 < t1]
        good = [(w, v) for w, _, v, qc in met if w > 0 and v is not None and not qc & 1]
        total = sum(w for w, _ in good)
        out[s, b] = (round(sum(w * v for w, v in good) / total, 6) if total else 0.0 if met and not any(w > 0 for w, *_ in met) else None, len(met) == 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_of_any_widths(spark, seed):
    rnd = random.Random(seed)
    cells = [(rnd.choice("ab"), a := rnd.uniform(-50, 200), a + rnd.choice([0, 1e-3, 0.5, 4, 30, 1000, 64]), rnd.choice([None, 1.0, 5.0, 7.5]), rnd.choice([0, 0, 1])) for _ in range(200)]
    bins = [(s, k, float(lo), float(lo) + w) for s in "ab" for k, (lo, w) in enumerate([(0, 1), (0, 2), (1, 0.25), (2, 2), (4, 4), (8, 8), (16, 16), (32, 32), (-1000, 5000), (64, 64), (3, 1e-4), (5, 0), (-30, 10)])]
    rows = spark.createDataFrame(cells, "series string, lo double, hi double, value double, qc int")
    targets = spark.createDataFrame(bins, "series string, bin long, lo double, hi double")
    got = {(r["series"], r["bin"]): (None if r["value"] is None else round(r["value"], 6), r["qc"] & bin_average.bits.OUTSIDE > 0) for r in bin_average.average_cells(rows, targets, ["series"]).collect()}
    assert got == brute(cells, bins)
    same = {(r["series"], r["bin"]): r["qc"] for r in bin_average.average_cells(rows, targets, ["series"], 100.0).collect()}
    assert same == {(r["series"], r["bin"]): r["qc"] for r in bin_average.average_cells(rows, targets, ["series"]).collect()}


def test_a_cell_gives_few_rows(spark):
    """However wide it is: two for each level, where equal buckets would take one for each bucket."""
    levels = list(range(-10, 41))
    cells = spark.createDataFrame([(0.3, 0.3 + 2.0**k * f) for k in range(-10, 41) for f in (1.0, 0.7)], "lo double, hi double")
    own = cells.select(F.size(bin_average.nodes(F.col("lo"), F.col("hi"), F.filter(F.array(*map(F.lit, levels)), lambda n: n >= bin_average.level(F.col("lo"), F.col("hi"), -10)))).alias("n"), F.size(bin_average.nodes(F.col("lo"), F.col("hi"), F.array(bin_average.level(F.col("lo"), F.col("hi"), -10)))).alias("home"))
    assert max(r["n"] for r in own.collect()) <= 2 * len(levels) and max(r["home"] for r in own.collect()) <= 2


def test_bins_from_bounds(spark):
    rows = spark.createDataFrame([(1, [5.0, 2.0], (0.0, 1.0)), (2, [None, 3.0], (1.0, None)), (3, [1.0, 1.5], (2.0, 9.0))], "k long, b array<double>, s struct<lo: double, hi: double>")
    assert [(r["bin"], r["lo"], r["hi"]) for r in grid.from_bounds(rows, "b", "k").orderBy("k").collect()] == [(1, 2.0, 5.0), (3, 1.0, 1.5)]
    assert [(r["bin"], r["lo"], r["hi"]) for r in grid.from_bounds(rows, "s", "k").orderBy("k").collect()] == [(1, 0.0, 1.0), (3, 2.0, 9.0)]


def test_bins_that_change(spark):
    rnd = random.Random(3)
    points = [(s, rnd.randint(-20, 220), rnd.choice([None, 1.0, 2.0, 8.0]), rnd.choice([0, 0, 2, 1])) for s in "ab" for _ in range(300)]
    props = [("a", 0, 10, 3), ("a", 55, 7, 0), ("a", 56, 40, 5), ("b", 10, 1000, 0), ("b", 150, 3, 1), ("b", 300, 5, 0)]
    end = 200
    rows = spark.createDataFrame(points, "series string, t long, value double, qc int")
    properties = spark.createDataFrame(props, "series string, start long, width long, origin long")
    got = {(r["series"], r["lo"], r["hi"]): (None if r["value"] is None else round(r["value"], 6), r["qc"]) for r in bin_average.average_by_properties(rows, properties, ["series"], "t", end, 50).collect()}
    want = {}
    for k, (s, start, width, origin) in enumerate(props):
        until = min([end, *(p[1] for p in props if p[0] == s and p[1] > start)])
        edges = sorted({start, until} | {origin + n * width for n in range(-200, 200) if start < origin + n * width < until}) if start < until else []
        for lo, hi in zip(edges, edges[1:]):
            own = [(v, q) for x, t, v, q in points if x == s and lo <= t < hi]
            good = [v for v, q in own if v is not None and not q & 1]
            want[s, lo, hi] = (round(sum(good) / len(good), 6) if good else None, len(own))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want)
    assert all((got[k][1] & bin_average.bits.OUTSIDE > 0) == (want[k][1] == 0) for k in want)
    assert math.isclose(sum(v for v, _ in want.values() if v), sum(v for v, _ in got.values() if v), rel_tol=1e-9)
