"""Interpolation and subsampling against plain loops over one series."""

import math
import random

import pytest

from gridloom.operators import nearest

BAD, IND, WALKED, EXTRA, FARTHER, OUTSIDE, ALL_BAD = 1, 2, 4, 8, 16, 128, 256


def is_good(p):
    return p[1] is not None and math.isfinite(p[1]) and not p[2] & 1


def loop_interpolate(points, targets, reach):
    out, n = [], len(points)
    good = [is_good(p) for p in points]
    for x in targets:
        if n < 2:
            out.append((None, OUTSIDE | BAD))
            continue
        if points[0][0] - x > abs(points[1][0] - points[0][0]) / 2 or x - points[-1][0] > abs(points[-1][0] - points[-2][0]) / 2:
            out.append((None, OUTSIDE | BAD))
            continue
        hit = [p for p, g in zip(points, good) if g and abs(p[0] - x) < 1e-8]
        if hit:
            out.append((hit[0][1], 0))
            continue
        i = next((k for k in range(n) if points[k][0] > x), n)
        a, b = (0, 1) if i == 0 else (n - 2, n - 1) if i == n else (i - 1, i)
        if i and i < n and points[a][0] == x:
            b = a  # a bad input on the target stands on both sides of it
        flag = 0 if good[a] and good[b] else WALKED
        if sum(good) < 2:
            out.append((None, ALL_BAD | BAD))
            continue
        n1 = next((k for k in range(a, -1, -1) if good[k]), None)
        if n1 is None:
            n1 = next(k for k in range(a, n) if good[k])
            n2 = next(k for k in range(n1 + 1, n) if good[k])
        else:
            n2 = next((k for k in range(max(b, n1 + 1), n) if good[k]), None)
            if n2 is None:
                n2 = n1
                n1 = next(k for k in range(n2 - 1, -1, -1) if good[k])
        (x1, y1, q1), (x2, y2, q2) = points[n1], points[n2]
        if abs(x1 - x) > reach or abs(x2 - x) > reach:
            out.append((None, OUTSIDE | BAD | flag))
            continue
        u = (x - x1) / (x2 - x1)
        flag |= EXTRA if not 0 <= u <= 1 else 0
        flag |= IND if (q1 & ~1 and abs(1 - u) > 1e-5) or (q2 & ~1 and abs(u) > 1e-5) else 0
        out.append((u * y2 + (1 - u) * y1, flag))
    return out


def loop_subsample(points, targets, reach):
    out = []
    for x in targets:
        near = min((p for p in points if is_good(p)), key=lambda p: (abs(p[0] - x), p[0]), default=None)
        if near is None or abs(near[0] - x) > reach:
            out.append((None, BAD | (OUTSIDE if not points or x - reach > points[-1][0] else ALL_BAD)))
            continue
        raw = min(abs(p[0] - x) for p in points)
        out.append((near[1], (IND if near[2] & ~1 else 0) | (FARTHER if abs(near[0] - x) > raw else 0)))
    return out


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(8)
    series = {}
    for s in range(25):
        xs = sorted(rnd.sample(range(0, 200), rnd.choice([0, 1, 2, 3, 10, 40])))
        series[f"s{s}"] = [(float(x), rnd.choice([None, float("nan"), round(rnd.uniform(-5, 5), 3), round(rnd.uniform(-5, 5), 3), 1.0]), rnd.choice([0, 0, 0, 1, 2])) for x in xs]
    series["none_good"] = [(float(x), None, 0) for x in range(0, 50, 5)]
    series["first_two_good"] = [(0.0, 1.0, 0), (4.0, 3.0, 0), *[(float(x), None, 0) for x in range(8, 30, 4)]]
    targets = [-3.0, -1.0, 0.0, 0.5, *[float(x) for x in range(3, 210, 7)], 26.0]
    rows = spark.createDataFrame([(s, *p) for s, points in series.items() for p in points], "series string, coord double, value double, qc int").repartition(5)
    wanted = spark.createDataFrame([(s, k, x) for s in series for k, x in enumerate(targets)], "series string, bin long, coord double").repartition(3)
    return series, targets, rows, wanted


@pytest.mark.parametrize("reach", [None, 12.0])
@pytest.mark.parametrize("chunk", [7.0, 1000.0])
@pytest.mark.parametrize("kind", ["interpolate", "subsample"])
def test_against_loops(case, kind, chunk, reach):
    series, targets, rows, wanted = case
    act, loop = (nearest.interpolate, loop_interpolate) if kind == "interpolate" else (nearest.subsample, loop_subsample)
    found = {(r["series"], r["bin"]): (r["value"], r["qc"]) for r in act(rows, wanted, ["series"], chunk, reach=reach).collect()}
    assert len(found) == len(series) * len(targets)
    for s, points in series.items():
        for k, (value, flag) in enumerate(loop(points, targets, math.inf if reach is None else reach)):
            got = found[s, k]
            assert got[1] == flag, (s, targets[k], got, value, flag, points)
            assert (got[0] is None) == (value is None) and (value is None or abs(got[0] - value) < 1e-9), (s, targets[k], got, value)
