import math
import random

from gridloom.operators import bin_average, grid


def loop(inputs, bins, mask=1, limits=bin_average.Limits()):
    out = []
    for t0, t1 in bins:
        n, most, qc, s0, s1, s2, total, good, flags = 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0
        for i0, i1, x, q, weight in inputs:
            if not (i1 >= t0 and i0 < t1):
                continue
            n += 1
            size = i1 - i0
            w = 1.0 if size == 0 else 1 - max(0, (t0 - i0) / size) - max(0, (i1 - t1) / size)
            span = 1.0 if size == 0 else w * size
            total += span
            most = max(most, weight) if w > 0 else most
            if w > 0 and (x is None or not math.isfinite(x) or q & mask):
                qc |= 32
                continue
            good += span
            if w > 0:
                s0, s1, s2 = s0 + w * weight, s1 + w * weight * x, s2 + w * weight * x * x
                flags |= q if w * weight > 0 else 0
        std, fraction, value = None, 0.0, None
        if n and most == 0:
            value, std, qc = 0.0, 0.0, qc | 64
        elif not n:
            qc |= 129
        elif s0 == 0:
            qc |= 257
        else:
            value, fraction = s1 / s0, good / total
            variance = (s0 * s2 - s1 * s1) / (s0 * s0)
            std = 0.0 if abs(variance) < 1e-12 else math.sqrt(variance)
            qc |= 2 if flags & ~mask else 0
        if std is not None:
            qc |= 512 if std > limits.std_bad_max else 1024 if std > limits.std_ind_max else 0
        qc |= 2048 if fraction < limits.goodfrac_bad_min else 4096 if fraction < limits.goodfrac_ind_min else 0
        out.append((value, std, fraction, qc))
    return out


def test_cells_against_loop(spark):
    rnd = random.Random(3)
    series, limits = {}, bin_average.Limits(2.5, 1.0, 0.2, 0.9)
    for s in range(12):
        at, cells = 0.0, []
        for _ in range(rnd.randint(0, 40)):
            size = rnd.choice([0, 0, 1, 2, 3.5])
            cells.append((at, at + size, rnd.choice([None, float("nan"), *[round(rnd.uniform(-4, 4), 2)] * 5]), rnd.choice([0, 0, 1, 2]), rnd.choice([0.0, 1.0, 2.0])))
            at += size + rnd.choice([0.5, 0, 4])
        series[f"s{s}"] = cells
    bins = [(b - 1.0, b + 2.0) for b in range(0, 90, 2)]
    rows = spark.createDataFrame([(s, *c) for s, cells in series.items() for c in cells], "series string, lo double, hi double, value double, qc int, w double").repartition(4)
    wanted = spark.createDataFrame([(s, k, *b) for s in series for k, b in enumerate(bins)], "series string, bin long, lo double, hi double")
    for bucket in (1.0, 5.0, 500.0):
        found = bin_average.average_cells(rows, wanted, ["series"], bucket, weight=rows["w"], limits=limits).collect()
        got = {(r["series"], r["bin"]): (r["value"], r["value_std"], r["value_goodfraction"], r["qc"]) for r in found}
        for s, cells in series.items():
            for k, want in enumerate(loop(cells, bins, limits=limits)):
                have = got[s, k]
                assert have[3] == want[3], (s, bins[k], have, want)
                assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for a, b in zip(have, want)), (have, want)


def test_points_are_half_open_and_empty_bins_stay(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 0), ("a", 10, 3.0, 2), ("a", 19, None, 0), ("b", 25, 5.0, 1)], "series string, coord long, value double, qc int")
    bins = grid.per_series(rows, ["series"], "coord", 10, start=grid.F.lit(0))
    got = {(r["series"], r["bin"]): (r["value"], r["value_goodfraction"], r["qc"]) for r in bin_average.average_points(rows, bins, ["series"], "coord", 0, 10).collect()}
    assert got == {("a", 0): (1.0, 1.0, 0), ("a", 1): (3.0, 0.5, 2 | 32), ("b", 0): (None, 0.0, 129), ("b", 1): (None, 0.0, 129), ("b", 2): (None, 0.0, 257 | 32)}


def test_only_touching_cells_give_zero(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0, float("nan"), 0)], "series string, lo double, hi double, value double, qc int")
    bins = spark.createDataFrame([("a", 0, 1.0, 2.0)], "series string, bin long, lo double, hi double")
    r = bin_average.average_cells(rows, bins, ["series"], 1.0).first()
    assert (r["value"], r["value_std"], r["value_goodfraction"], r["qc"]) == (0.0, 0.0, 0.0, 64)
