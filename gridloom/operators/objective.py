"""Objective analysis of station values onto a latitude-longitude grid by repeated Gaussian corrections.

Stations at one place have the same weights, so what is corrected for them is the mean of their values, which counts as often as there are stations: that gives
the same field. Each time is first one group of its places, whose means are corrected once, with at most ``KEPT`` weights between places held at once, whatever their number. The grid is cut into parts of
``GRID_PART`` points on average; every time then meets every part in a row of its own, so a task holds one time's places and a part
of the grid, whatever the size of the grid and the number of times. The work of a time grows with the square of its places, not of its stations; times are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bits

METRES_PER_DEGREE = 111190.0
GRID_PART = 1024
#: Keys that times are dealt out over, at least, however few parts a grid has.
SPREAD = 64
#: Rows (a time's stations and a part of the grid each) that a Python worker gets at once.
BATCH_ROWS = 500
#: Weights between places (or points) that are held at once.
STRIP = 1 << 20
#: Weights of a time's places that are kept from pass to pass; those of more places are made anew in each.
KEPT = 1 << 22


def distances(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres between all pairs, with a degree of longitude shortened by the mean latitude."""
    mean = np.radians((lat1[:, None] + lat2[None, :]) / 2)
    return METRES_PER_DEGREE * np.hypot(lat1[:, None] - lat2[None, :], (lon1[:, None] - lon2[None, :]) * np.cos(mean))


def corrected(values: np.ndarray, lat: np.ndarray, lon: np.ndarray, passes: int, scale_km: float, counts: np.ndarray | None = None) -> np.ndarray:
    """Values of places after a number of passes, each of which adds what the weighted means of the values so far leave of the observed ones.

    ``counts``: of how many stations at its place a value is the mean (none: of one each).
    """
    n, step = len(values), max(1, STRIP // max(1, len(values)))

    def weights(at: int) -> np.ndarray:
        part = np.exp(-((distances(lat[at : at + step], lon[at : at + step], lat, lon) / (scale_km * 1000)) ** 2))
        if counts is not None:
            part *= counts
        part /= part.sum(axis=1, keepdims=True)
        return part

    held = [weights(at) for at in range(0, n, step)] if n * n <= KEPT else None
    found = np.zeros(n)
    for _ in range(passes):
        means = [part @ found for part in (held if held is not None else map(weights, range(0, n, step)))]
        found = found + values - np.concatenate(means)
    return found


def field(values: np.ndarray, lat: np.ndarray, lon: np.ndarray, grid_lat: np.ndarray, grid_lon: np.ndarray, scale_km: float, counts: np.ndarray | None = None) -> np.ndarray:
    """Weighted means of (corrected) values of places at points, and their slopes along latitude and longitude (per degree); NaN where no place has weight. ``counts`` as for corrected()."""
    out, strip = [np.zeros((3, 0))], max(1, STRIP // max(1, len(values)))
    for at in range(0, len(grid_lat), strip):
        y, x = grid_lat[at : at + strip], grid_lon[at : at + strip]
        onto = np.exp(-((distances(y, x, lat, lon) / (scale_km * 1000)) ** 2))
        if counts is not None:
            onto *= counts
        total = onto.sum(axis=1)
        # derivatives of the squared distance: of its latitude part, of the shortening of a degree of longitude, of its longitude part
        mean = np.radians((y[:, None] + lat[None, :]) / 2)
        up, along = y[:, None] - lat[None, :], x[:, None] - lon[None, :]
        scale = (METRES_PER_DEGREE / (scale_km * 1000)) ** 2
        by_lat = -scale * (2 * up - along**2 * np.sin(2 * mean) * np.radians(0.5)) * onto
        by_lon = -scale * 2 * along * np.cos(mean) ** 2 * onto
        with np.errstate(invalid="ignore", divide="ignore"):
            found = np.where(total > 0, onto @ values / total, np.nan)
            slopes = [np.where(total > 0, (d @ values - found * d.sum(axis=1)) / total, np.nan) for d in (by_lat, by_lon)]
        out.append(np.stack([found, *slopes]))
    return np.concatenate(out, axis=1)


def station_fields(rows: DataFrame, times: list[str], *, passes: int = 16, scale_km: float = 100.0, min_stations: int = 15, mask: int = 1) -> DataFrame:
    """(times, nstat, qc, lats, lons, counts, values): the places of each time's good stations, how many are there, and their corrected mean values; none where they are too few.

    ``rows`` are (times, station, lat, lon, value, qc). Bad stations are left out: SOME_BAD, or BAD with ALL_BAD or SOME_BAD below ``min_stations`` good ones.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*times).schema)
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    small = F.coalesce(F.abs("_value") < float(np.finfo(np.float32).max), F.lit(False))
    good = finite("_value") & small & finite("_lat") & finite("_lon") & ~bits.any_of(F.col("qc"), mask)
    placed = rows.select(*times, "qc", *[F.col(c).cast("double").alias(f"_{c}") for c in ("lat", "lon", "value")]).withColumn("_good", good)
    # bad stations are counted only, in one row for each time
    placed = placed.select(*times, "_good", *[F.when(F.col("_good"), F.col(c)).alias(c) for c in ("_lat", "_lon", "_value")])
    places = placed.groupBy(*times, "_good", "_lat", "_lon").agg(F.avg("_value").alias("_mean"), F.count("*").alias("_count"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        fine = group[group["_good"]].sort_values(["_lat", "_lon"], kind="stable")
        count = fine["_count"].to_numpy(float)
        n, lists = int(count.sum()), [[], [], [], []]
        if n < min_stations:
            qc = bits.BAD | (bits.ALL_BAD if n == 0 else bits.SOME_BAD)
        else:
            qc = bits.SOME_BAD if n < group["_count"].sum() else 0
            lat, lon, mean = (fine[c].to_numpy(float) for c in ("_lat", "_lon", "_mean"))
            lists = [lat, lon, count, corrected(mean, lat, lon, passes, scale_km, count)]
        found = {c: [group[c].iloc[0]] for c in times} | {"nstat": [n], "qc": [qc]}
        return pd.DataFrame(found | {c: [x] for c, x in zip(("lats", "lons", "counts", "values"), lists, strict=True)})

    return places.groupBy(*times).applyInPandas(one, f"{fields}, nstat int, qc int, lats array<double>, lons array<double>, counts array<double>, values array<double>")


def objective_analysis(rows: DataFrame, times: list[str], grid: DataFrame, *, scale_km: float = 100.0, part: int = GRID_PART, **options) -> DataFrame:
    """(times, lat, lon, value, deriv_lat, deriv_lon, nstat, qc) for rows (times, station, lat, lon, value, qc) at the points (lat, lon) of ``grid``.

    deriv_lat and deriv_lon are the true slopes of the analysed field per degree (some older implementations always give 0). Points without both
    coordinates are left out, repeated ones stay. The session's Arrow batches are lowered to ``BATCH_ROWS`` rows. ``options`` are those of ``station_fields``; where it finds too few stations, there are no values.
    """
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(rows.sparkSession.conf.get(batches)) <= BATCH_ROWS:
        rows.sparkSession.conf.set(batches, BATCH_ROWS)
    grid = grid.select(F.col("lat").cast("double"), F.col("lon").cast("double")).where("lat is not null and lon is not null")
    n = max(1, math.ceil(grid.count() / part))
    salts = max(1, SPREAD // n)
    parts = grid.groupBy(F.pmod(F.xxhash64("lat", "lon"), F.lit(n)).cast("int").alias("_part")).agg(F.sort_array(F.collect_list(F.struct("lat", "lon"))).alias("_p"))
    parts = parts.select("_part", F.col("_p.lat").alias("_lats"), F.col("_p.lon").alias("_lons"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    found = station_fields(rows, times, scale_km=scale_km, **options)
    found = found.withColumns({"_salt": F.pmod(F.xxhash64(*times), F.lit(salts)).cast("int"), "_part": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    both = found.join(parts, ["_part", "_salt"]).select(*times, "nstat", "qc", "lats", "lons", "counts", "values", "_lats", "_lons")
    names = ["value", "deriv_lat", "deriv_lon"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*times).schema)
    kept = [*times, "nstat", "qc"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lats, lons, counts, values, y, x = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("lats", "lons", "counts", "values", "_lats", "_lons"))
                out = field(values, lats, lons, y, x, scale_km, counts) if len(values) else np.full((3, len(y)), np.nan)
                own = {c: batch.column(c).take(pa.array(np.full(len(y), k))) for c in kept}
                yield pa.RecordBatch.from_pydict(own | {"lat": pa.array(y), "lon": pa.array(x)} | {c: pa.array(v, mask=np.isnan(v)) for c, v in zip(names, out, strict=True)})

    made = both.mapInArrow(place, f"{fields}, nstat int, qc int, lat double, lon double, value double, deriv_lat double, deriv_lon double")
    return made.select(*times, "lat", "lon", *names, "nstat", "qc")
