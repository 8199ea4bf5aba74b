import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import outliers, spans

THRESHOLDS = {"iqd": (1.03, 0.71), "mean_dev": (1.503, 1.101), "mean_mad": (2.31, 1.71), "median_mad": (2.71, 1.91), "std": (2.11, 1.61)}


def expected(method: str, x: float, window: np.ndarray) -> int:
    s, n = np.sort(window), len(window) // 2
    centre = np.mean(s) if method in ("mean_dev", "mean_mad", "std") else np.median(s)
    spread = {
        "iqd": lambda: np.median(s[-n:]) - np.median(s[:n]), "mean_dev": lambda: 1.0, "mean_mad": lambda: np.mean(np.abs(s - centre)),
        "median_mad": lambda: np.median(np.abs(s - centre)), "std": lambda: np.std(s),
    }[method]()
    return sum(flag for flag, k in zip((16, 32), THRESHOLDS[method], strict=True) if abs(x - centre) > spread * k)


@pytest.mark.parametrize("method", ["median_mad", "iqd", "mean_mad"])
def test_dense_windows(spark, method):
    """Windows of 40,000 samples, of which each has many at the same time: the work must not grow with the windows' lengths."""
    n, width = 120_000, 4_000
    rows = spark.range(n).select("id", F.lit("a").alias("s"), F.floor(F.col("id") / 10).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)).alias("u"))
    rows = rows.select("id", "s", "t", F.when(F.col("id") % 7 > 0, F.pow("u", F.lit(-0.4))).alias("value"), F.when(F.col("id") % 11 == 0, 1).otherwise(0).alias("qc"))
    bad, ind = THRESHOLDS[method]
    began = time.monotonic()
    found = outliers.flag_outliers(rows, ["s"], "t", "value", "qc", method, width, min_points=5, bad_threshold=bad, ind_threshold=ind).toPandas().sort_values("id")
    took = time.monotonic() - began
    given = rows.toPandas().sort_values("id")
    t, x, good = given["t"].to_numpy(), given["value"].to_numpy(), (given["value"].notna() & (given["qc"] == 0)).to_numpy()
    assert len(found) == n and (found["qc"].to_numpy() != 0).sum() > n // 10
    for i in range(0, n, 331):
        window = x[good & (np.abs(t - t[i]) <= width // 2)]
        assert found["qc"].iloc[i] == given["qc"].iloc[i] | (expected(method, x[i], window) if good[i] else 0), i
    assert took < 60


def test_blocks_and_groups(spark, monkeypatch):
    """Groups of all sizes, cut into blocks anywhere: rows pass through with all their columns, series without a name too."""
    monkeypatch.setattr(outliers, "BLOCK", 7)
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([rnd.randint(-50, 50), rnd.randint(-100_000, 100_000)]), rnd.choice([None, rnd.gauss(5, 1), rnd.gauss(5, 9)]), rnd.choice([0, 0, 2, 1]), [i]) for i in range(900)]
    frame = spark.createDataFrame(rows, "i long, s string, t long, value double, qc int, more array<int>")
    found = outliers.flag_outliers(frame, ["s"], "t", "value", "qc", "iqd", 20, min_points=3, bad_threshold=1.03).collect()
    assert sorted(r["i"] for r in found) == list(range(900)) and all(r["more"] == [r["i"]] for r in found)
    got = {r["i"]: r["qc"] for r in found}
    for i, s, t, x, q, _ in rows:
        window = np.array([r[3] for r in rows if r[1] == s and abs(r[2] - t) <= 10 and r[3] is not None and r[4] != 1])
        flag = 0 if x is None or q == 1 else 64 if len(window) < 3 else expected("iqd", x, window) & 16
        assert got[i] == q | flag, (i, s, t)


def test_spans():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 64, 131):
        for values in (rnd.normal(size=n), rnd.integers(0, 4, n) * 1.0, 1e6 + rnd.normal(size=n) * 1e-3, np.full(n, 0.1), np.zeros(n)):
            lo = rnd.integers(0, n, 50)
            hi = rnd.integers(lo, n) + 1
            mean, variance = spans.moments(values, lo, hi)
            ordered = spans.Ordered(values)
            median = ordered.median(lo, hi)
            apart, off = ordered.median_distance(lo, hi, median), ordered.mean_distance(lo, hi, mean)
            for k in range(50):
                s = values[lo[k] : hi[k]]
                assert abs(mean[k] - s.mean()) <= 1e-15 * n * np.abs(s).max() and abs(np.sqrt(variance[k]) - s.std()) <= 1e-15 * n * max(1, np.abs(s).max())
                assert median[k] == np.median(s) and apart[k] == np.median(np.abs(s - median[k]))
                assert abs(off[k] - np.abs(s - mean[k]).mean()) <= 1e-15 * n * np.abs(s).max()
    # equal values have no spread at all
    assert not spans.moments(np.full(100, 0.1), np.arange(50), np.arange(50) + 49)[1].any()


@pytest.mark.parametrize("method", ["std", "mean_dev"])
def test_dense_windows_of_means(spark, method):
    """Windows of up to 400,000 samples: sums over them must not be made anew for each row. A large offset costs no digits."""
    n, width, offset = 400_000, 40_000, 1e7
    rows = spark.range(n).select("id", F.lit("a").alias("s"), F.floor(F.col("id") / 10).alias("t"), (offset + F.pow(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20), F.lit(-0.4))).alias("value"), F.when(F.col("id") % 11 == 0, 1).otherwise(0).alias("qc"))
    bad, ind = THRESHOLDS[method]
    began = time.monotonic()
    found = outliers.flag_outliers(rows, ["s"], "t", "value", "qc", method, width, min_points=5, bad_threshold=bad, ind_threshold=ind).toPandas().sort_values("id")
    took = time.monotonic() - began
    t, x, good = found["t"].to_numpy(), found["value"].to_numpy(), np.arange(n) % 11 != 0
    assert len(found) == n
    for i in range(0, n, 4001):
        window = x[good & (np.abs(t - t[i]) <= width // 2)] - offset
        assert found["qc"].iloc[i] == (expected(method, x[i] - offset, window) if good[i] else 1), i
    assert took < 60
