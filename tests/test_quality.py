import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import bits, solar, units
from gridloom.operators import chunks, objective, outliers, overlap, qc, retrieve


def test_time_index(spark):
    times = [5, 5, 5, 6, 7, 8, 9, 10, 10, 10, 11, 12, 13, 14, 15, 15, 15]
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "s string, idx long, t long")
    refs = spark.createDataFrame([("a", r) for r in (3, 5, 7, 10, 12, 15, 17)], "s string, ref long")
    want = {3: (-1, -1, 0, 0, -1), 5: (-1, 2, 3, 0, 0), 7: (3, 4, 5, 4, 4), 10: (6, 9, 10, 7, 7), 12: (10, 11, 12, 11, 11), 15: (13, 16, -1, 14, 14), 17: (16, 16, -1, -1, -1)}
    for chunk in (1, 4, 100):
        found = retrieve.find_index(rows, refs, ["s"], chunk).collect()
        assert {r["ref"]: (r["lt"], r["lteq"], r["gt"], r["gteq"], r["eq"]) for r in found} == want


def test_limits_and_deltas(spark):
    before = [(i, i + 0.5, 0) for i in range(20)]
    before[2], before[3] = (2, -9999.0, 1), (3, 2.5, 0)
    data = []
    for k in range(60):
        v = 20 + k + 0.5
        v = -9999.0 if 10 <= k <= 14 else -8888.0 if 47 <= k <= 51 else 40.0 if 18 <= k <= 22 else 57.0 if 35 <= k <= 39 else v
        data.append((20 + k, v, 0))
    rows = spark.createDataFrame([(i % 20, i // 20, float(v), q) for i, v, q in before + data], "cell int, sample int, value double, qc int")
    flags = F.when(F.col("value") == -9999, 1).when(F.col("value") == -8888, 2).when(F.col("value") < 22, 4).when(F.col("value") > 77, 8).otherwise(0)
    checked = rows.withColumn("qc", F.when(F.col("sample") == 0, F.col("qc")).otherwise(flags))
    found = qc.delta(checked, ["cell"], ["sample"], "value", "qc", 20.0, 2, flag=16, bad=15)
    got = {(r["cell"], r["sample"]): r["qc"] for r in found.collect()}
    held = {(i % 20, i // 20): (v, q) for i, v, q in before + data}
    plain = {(r["cell"], r["sample"]): r["qc"] for r in checked.collect()}
    for (c, s), flag in got.items():
        jump = s > 0 and not plain[c, s] & 15 and not plain[c, s - 1] & 15 and abs(held[c, s][0] - held[c, s - 1][0]) > 20
        assert flag == plain[c, s] | (16 if jump else 0)
    kinds = qc.limits(F.col("value"), missing=[-9999.0, -8888.0], low=22, high=77)
    got = {r["value"]: r["f"] for r in rows.select("value", kinds.alias("f")).collect()}
    assert got[-9999.0] == 1 and got[20.5] == 2 and got[22.5] == 0 and got[77.5] == 4


def test_time_steps(spark):
    rows = spark.createDataFrame([("a", i, t, 0) for i, t in enumerate([10, 20, 20, 15, 16, 100])], "s string, a long, t long, qc int")
    found = qc.time_steps(rows, ["s"], ["a"], "t", "qc", 2, least=5, most=50).orderBy("a").collect()
    assert [r["qc"] for r in found] == [0, 0, 1, 1, 2, 4]


@pytest.mark.parametrize("method", outliers.METHODS)
def test_outliers_against_loops(spark, method):
    rnd = random.Random(9)
    rows = [(s, rnd.randint(0, 300), rnd.choice([None, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 4)]), rnd.choice([0, 0, 0, 1, 2])) for s in "abc" for _ in range(60)] + [("few", 1, 1.0, 0)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, "i long, s string, t long, value double, qc int")
    found = {r["i"]: r["qc"] for r in outliers.flag_outliers(frame, ["s"], "t", "value", "qc", method, 40, min_points=4, bad_threshold=1.31, ind_threshold=0.97).collect()}
    for i, s, t, x, q in rows:
        own = [r for r in rows if r[1] == s]
        flag = q
        good = sorted(r[3] for r in own if r[3] is not None and not r[4] & 1 and abs(r[2] - t) <= 20)
        if len(own) < 4:
            flag |= 64
        elif x is not None and not q & 1:
            if len(good) < 4:
                flag |= 64
            else:
                n = len(good) // 2
                centre = statistics.mean(good) if method in ("mean_dev", "mean_mad", "std") else statistics.median(good)
                spread = {
                    "iqd": lambda: statistics.median(good[-n:]) - statistics.median(good[:n]), "mean_dev": lambda: 1.0, "std": lambda: statistics.pstdev(good),
                    "mean_mad": lambda: statistics.mean(abs(v - centre) for v in good), "median_mad": lambda: statistics.median(abs(v - centre) for v in good),
                }[method]()
                flag |= (16 if abs(x - centre) > 1.31 * spread else 0) | (32 if abs(x - centre) > 0.97 * spread else 0)
        assert found[i] == flag, (i, s, t, x, q)


def test_carried_across_chunks(spark):
    rows = spark.createDataFrame([("a", t, float(t) if t % 5 == 0 else None) for t in range(0, 60)] + [(None, 3, 1.0), (None, 4, None)], "s string, t long, v double")
    for chunk in (1, 7, 1000):
        found = chunks.carried(rows, ["s"], ["t"], F.col("v"), "last", chunk)
        found = chunks.carried(found, ["s"], ["t"], F.col("v"), "next", chunk, backward=True, inclusive=False)
        got = {(r["s"], r["t"]): (r["last"], r["next"]) for r in found.collect()}
        assert all(got["a", t] == (t // 5 * 5.0, (t // 5 + 1) * 5.0 if t < 55 else None) for t in range(60))
        assert got[None, 3] == (1.0, None) and got[None, 4] == (1.0, None)


def test_overlaps(spark):
    rows = [("a", 0, 10, 1.0), ("a", 1, 20, 2.0), ("a", 2, 10, 1.0), ("a", 3, 20, 9.0), ("a", 4, 15, 3.0), ("a", 5, 30, 4.0)]
    frame = spark.createDataFrame(rows, "s string, arrival long, t long, v double")
    for chunk in (1, 2, 100):
        marks = overlap.mark_overlaps(frame, ["s"], "t", "arrival", ["v"], chunk).orderBy("arrival").collect()
        assert [r["overlap"] for r in marks] == ["none", "none", "duplicate", "conflict", "shift", "none"]
    kept = overlap.drop_overlaps(frame, ["s"], "t", "arrival", ["v"], 2, allow={"duplicate", "conflict", "shift"})
    assert sorted(r["arrival"] for r in kept.collect()) == [0, 1, 5]
    with pytest.raises(Exception, match="overlapping samples: conflict"):
        overlap.drop_overlaps(frame.where("arrival < 4"), ["s"], "t", "arrival", ["v"], 2).collect()


def test_observations(spark):
    def kept(first, second):
        rows = [("a", 1, t, first[1]) for t in range(first[0])] + [("a", 2, t + 1, second[1]) for t in range(second[0])]
        frame = spark.createDataFrame(rows, "k string, obs_id long, t long, created long")
        return {r["obs_id"] for r in overlap.merge_observations(frame, ["k"], "t").collect()}

    assert kept((8, 5), (6, 9)) == {2} and kept((9, 5), (6, 9)) == {1}
    assert kept((6, 9), (8, 5)) == {1} and kept((5, 9), (8, 5)) == {2}
    assert kept((6, None), (3, 1)) == {2} and kept((6, 1), (9, None)) == {1}
    assert kept((6, None), (5, None)) == {1} and kept((5, None), (5, None)) == {2}


def test_units_and_casts(spark):
    rows = spark.createDataFrame([(v,) for v in (-3, 0, 20, -9999, 60, -2147483647, 100, 103)], "c int")
    found = [r[0] for r in rows.select(units.convert(F.col("c").cast("double"), "degC", "degF", missing=[-9999.0])).collect()]
    assert [round(v, 4) for v in found[:5]] == [26.6, 32, 68, -9999, 140]
    km = spark.createDataFrame([(float(v),) for v in (-64, -32, -128, -8, 8, -127, 64, 127)], "c double")
    metres = units.convert(F.col("c"), "km", "m", missing=[-128.0, -127.0])
    out = [r[0] for r in km.select(units.cast_rounded(metres, "short", missing={-128.0: -128, -127.0: -32767}, outside=-128)).collect()]
    assert out == [-128, -32000, -128, -8000, 8000, -32767, -128, -128]
    halves = spark.createDataFrame([(v,) for v in (-2.5, -1.5, -0.5, 0.5, 1.5, 127.4, 127.5, -128.5)], "c double")
    assert [r[0] for r in halves.select(units.cast_rounded(F.col("c"), "byte")).collect()] == [-3, -2, -1, 1, 2, 127, -127, -127]
    assert units.compare("m", "km") == "convertible" and units.compare("degC", "celsius") == "equal" and units.compare("m", "s") == "different"
    with pytest.raises(ValueError):
        units.parse("furlong")
    with pytest.raises(ValueError):
        units.factors("m", "s")
    assert units.missing_map([-9999, -100], "byte") == {-9999: -100, -100: -100} and units.missing_map([-9999], "byte") == {-9999: -127}
    assert bits.mask_for({1: "Bad", 3: "Bad", 2: "Indeterminate"}) == 5 and bits.mask_for({}) == 1


def test_sun(spark):
    # noon at the equinox on the equator and the prime meridian: overhead; at the solstice in Oklahoma: 76.9 degrees high
    rows = spark.createDataFrame([(1710936420.0, 0.0, 0.0), (1718908200.0, 36.6, -97.5)], "s double, lat double, lon double")
    sun = solar.position(F.col("s"), F.col("lat"), F.col("lon"))
    a, b = rows.select(*[v.alias(k) for k, v in sun.items()]).collect()
    assert a["altitude"] > 88.5 and abs(a["declination"]) < 0.2 and abs(a["distance"] - 0.996) < 0.002
    assert abs(b["altitude"] - 76.8) < 0.5 and abs(b["declination"] - 23.43) < 0.02 and abs(b["azimuth"] - 180) < 5


def test_objective_analysis(spark):
    rnd = random.Random(2)
    stations = [(f"s{k}", 36 + rnd.random() * 2, -98 + rnd.random() * 2) for k in range(20)]
    rows = [(t, s, lat, lon, 3.0 + t if t < 2 else lat, 1 if s == "s3" and t == 1 else 0) for t in range(3) for s, lat, lon in stations] + [(9, *stations[0], 1.0, 0)]
    frame = spark.createDataFrame(rows, "t long, station string, lat double, lon double, value double, qc int")
    grid = spark.createDataFrame([(36.5, -97.5), (37.2, -96.9)], "lat double, lon double")
    found = objective.objective_analysis(frame, ["t"], grid, min_stations=15).orderBy("t", "lat").collect()
    got = {(r["t"], r["lat"]): (r["value"], r["nstat"], r["qc"]) for r in found}
    assert abs(got[0, 36.5][0] - 3) < 1e-6 and got[0, 36.5][1:] == (20, 0)
    assert abs(got[1, 37.2][0] - 4) < 1e-6 and got[1, 37.2][1:] == (19, 32)
    assert abs(got[2, 37.2][0] - 37.2) < 0.4
    assert got[9, 36.5] == (None, 1, 1 | 32)
    # many parts, repeated points and points without a coordinate, times of any type, ties and nulls among stations
    rows = [("a", "2024-01-01", s, lat, lon, lat * lon, None if s == "s1" else 0) for s, lat, lon in stations] * 2 + [(None, "2024-01-02", "s0", None, 1.0, 2.0, 0), (None, "2024-01-02", "s0", 1.0, 1.0, None, 0)]
    frame = spark.createDataFrame(rows, "g string, d string, station string, lat double, lon double, value double, qc int").withColumn("d", F.to_timestamp("d"))
    places = [(36 + rnd.random() * 2, -98 + rnd.random() * 2) for _ in range(57)]
    grid = spark.createDataFrame([*places, places[0], (None, 1.0)], "lat double, lon double")
    found = objective.objective_analysis(frame, ["g", "d"], grid, min_stations=15, part=5)
    rows = found.collect()
    assert len(rows) == 2 * 58 and found.limit(0).collect() == [] and objective.objective_analysis(frame, ["g", "d"], grid.limit(0)).collect() == []
    assert {(r["value"], r["nstat"], r["qc"]) for r in rows if r["g"] is None} == {(None, 0, 1 | 256)}
    lat, lon = np.array([s[1] for s in stations * 2]), np.array([s[2] for s in stations * 2])
    values = objective.corrected(lat * lon, lat, lon, 16, 100.0)
    for r in rows:
        if r["g"]:
            at = lambda y, x: objective.field(values, lat, lon, np.array([y]), np.array([x]), 100.0)[0, 0]
            assert abs(r["value"] - at(r["lat"], r["lon"])) < 1e-9
            # slopes against differences
            assert abs(r["deriv_lat"] - (at(r["lat"] + 1e-5, r["lon"]) - at(r["lat"] - 1e-5, r["lon"])) / 2e-5) < 1e-3
            assert abs(r["deriv_lon"] - (at(r["lat"], r["lon"] + 1e-5) - at(r["lat"], r["lon"] - 1e-5)) / 2e-5) < 1e-3


def test_objective_analysis_of_many_stations(spark, monkeypatch):
    """Stations at few places count as their means there; strips of weights change nothing."""
    rnd = np.random.default_rng(5)
    lat, lon, value = 36 + rnd.integers(0, 6, 90) / 4, -98 + rnd.integers(0, 4, 90) / 4, rnd.normal(size=90)
    values = objective.corrected(value, lat, lon, 16, 100.0)
    y, x = np.array([36.3, 37.1]), np.array([-97.9, -97.2])
    each = objective.field(values, lat, lon, y, x, 100.0)
    frame = spark.createDataFrame([(1, k, float(a), float(b), float(v), 0) for k, (a, b, v) in enumerate(zip(lat, lon, value, strict=True))] + [(1, 99, 36.0, -98.0, float("nan"), 0)], "t long, station long, lat double, lon double, value double, qc int")
    grid = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x, strict=True)], "lat double, lon double")
    found = objective.objective_analysis(frame, ["t"], grid).orderBy("lat").collect()
    assert np.allclose([[r[c] for r in found] for c in ("value", "deriv_lat", "deriv_lon")], each, atol=1e-9) and {(r["nstat"], r["qc"]) for r in found} == {(90, 32)}
    monkeypatch.setattr(objective, "STRIP", 200)
    for kept in (0, 1 << 22):
        monkeypatch.setattr(objective, "KEPT", kept)
        assert np.allclose(objective.corrected(value, lat, lon, 16, 100.0), values, atol=1e-12)
    # a time of 60,000 stations, whose weights for each other would take 29 GB
    many = spark.range(60_000).select(F.lit(1).alias("t"), F.col("id").alias("station"), (36 + F.col("id") % 13 / 10).alias("lat"), (-98 + F.col("id") % 17 / 10).alias("lon"), F.lit(2.5).alias("value"), F.lit(0).alias("qc"))
    found = objective.objective_analysis(many, ["t"], grid).collect()
    assert len(found) == 2 and all(abs(r["value"] - 2.5) < 1e-9 and r["nstat"] == 60_000 for r in found)
