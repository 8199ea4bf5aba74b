"""Outliers in a time window around each sample, both ends included.

Bad samples are neither judged nor members; a sample is a member of its own window. Samples whose window has fewer than
max(2, min_points) good members, and all of a series with fewer than min_points samples, get the skipped flag only.

Rows are dealt out by series and chunk of the coordinate and stream through tasks in order. A task holds about twice what one window has, or ``BLOCK`` rows
if that is more; centres and spreads are exact, and their time grows with the number of rows and hardly with that of a window's members (``spans``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions import bits
from gridloom.operators.chunks import with_margins
from gridloom.operators.spans import Ordered, moments

METHODS = ("iqd", "mean_dev", "mean_mad", "median_mad", "std")
#: Rows that a task takes up before it judges those whose windows are complete, at least.
BLOCK = 1 << 16
#: Rows of an output batch at most.
BATCH_ROWS = 10_000


def centre_and_spread(method: str, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of finite values, given by its first and the one after its last."""
    if method in ("mean_dev", "std"):
        centre, variance = moments(values, lo, hi)
        return centre, np.sqrt(variance) if method == "std" else np.ones(len(lo))
    ordered = Ordered(values)
    if method == "mean_mad":
        centre, _ = moments(values, lo, hi)
        return centre, ordered.mean_distance(lo, hi, centre)
    centre = ordered.median(lo, hi)
    return centre, ordered.quartile_distance(lo, hi) if method == "iqd" else ordered.median_distance(lo, hi, centre)


class _Held:
    """Rows of some groups that follow each other (series and chunk; numbered from 1), in order of the coordinate, until their windows are complete."""

    def __init__(self, method: str, half: int, kept: list[str], least: int):
        self.method, self.half, self.kept, self.least = method, half, kept, least
        self.rows: pa.Table | None = None
        self.waiting: list[pa.RecordBatch] = []
        #: Rows that wait, those that are held besides, and how many of the held ones are judged.
        self.new = self.old = self.judged = 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.waiting.append(batch)
        self.new += batch.num_rows
        if self.new >= max(BLOCK, self.old):
            yield from self.judge(False)

    def judge(self, ended: bool) -> Iterator[pa.RecordBatch]:
        """Judges the rows whose windows are complete, and drops those that no later window reaches."""
        tables = [*([self.rows] if self.rows is not None else []), *([pa.Table.from_batches(self.waiting)] if self.waiting else [])]
        if not tables:
            return
        rows = pa.concat_tables(tables).combine_chunks()
        self.waiting, self.new = [], 0
        column = lambda name: rows.column(name).to_numpy()
        t, at, home = column("_t"), column("_at"), column("_home").astype(bool)
        n = len(t)
        if n == 0:
            return
        group = np.cumsum(at == 1)
        last = int(np.searchsorted(group, group[-1]))
        # the last group may go on with rows at its last coordinate or after it
        ready = n if ended else last + int(np.searchsorted(t[last:], t[-1] - self.half))
        x = rows.column("_x")
        good = ~x.is_null().to_numpy()
        members, centre, spread = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        asked = np.zeros(n, bool)
        asked[self.judged : ready] = True
        asked &= home & good
        if asked.any():
            lo, hi = self.windows(t, group, good, asked)
            members[asked] = hi - lo
            # those with too few members are skipped, whatever their spread is
            enough = np.flatnonzero(hi - lo >= max(2, self.least))
            if len(enough):
                own = np.flatnonzero(asked)[enough]
                centre[own], spread[own] = centre_and_spread(self.method, x.drop_null().to_numpy().astype(float), lo[enough], hi[enough])
        yield from self.out(rows, np.flatnonzero(home[self.judged : ready]) + self.judged, members, centre, spread)
        first = n if ready == n else last + int(np.searchsorted(t[last:], t[ready] - self.half))
        self.rows, self.old, self.judged = rows.slice(first), n - first, ready - first

    def windows(self, t: np.ndarray, group: np.ndarray, good: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of the rows begin and end among the good rows. Both ends rise with the rows of a group, so each group is looked up by itself."""
        tg, begins = t[good], np.searchsorted(group[good], np.arange(group[0], group[-1] + 2))
        ta, own = t[asked], np.searchsorted(group[asked], np.arange(group[0], group[-1] + 2))
        lo, hi = np.empty(len(ta), np.int64), np.empty(len(ta), np.int64)
        if len(begins) > 2 and len(t) < 64 * len(begins):
            # many small groups: all at once, set apart by more than a window
            starts = np.searchsorted(group, np.arange(group[0], group[-1] + 1))
            lowest = t[starts]
            reach = t[np.append(starts[1:], len(t)) - 1] - lowest
            room = reach.astype(float).sum() + float(len(reach)) * (2 * self.half + 2)
            if room < 2**62:
                shift = np.concatenate([[0], np.cumsum(reach + 2 * self.half + 2)[:-1]]) - lowest
                tg, ta = tg + shift[group[good] - group[0]], ta + shift[group[asked] - group[0]]
                return np.searchsorted(tg, ta - self.half), np.searchsorted(tg, ta + self.half, side="right")
        for k in np.flatnonzero(np.diff(own)):
            a, b, part = begins[k], begins[k + 1], slice(own[k], own[k + 1])
            lo[part] = a + np.searchsorted(tg[a:b], ta[part] - self.half)
            hi[part] = a + np.searchsorted(tg[a:b], ta[part] + self.half, side="right")
        return lo, hi

    def out(self, rows: pa.Table, own: np.ndarray, members: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(own), BATCH_ROWS):
            part = own[k : k + BATCH_ROWS]
            found = rows.slice(part[0], part[-1] + 1 - part[0]).take(part - part[0]) if len(part) else rows.slice(0, 0)
            found = found.select(self.kept)
            for name, values in (("_n", members), ("_centre", centre), ("_spread", spread)):
                found = found.append_column(name, pa.array(values[part]))
            yield from found.combine_chunks().to_batches()


def flag_outliers(
    rows: DataFrame, series: list[str], coord: str, value: str, qc: str, method: str, width: int, *, min_points: int = 2, bad_threshold: float, ind_threshold: float | None = None,
    bad_flag: int = 16, ind_flag: int = 32, skipped_flag: int = 64, mask: int = 1,
) -> DataFrame:
    """Sets flags by the distance from the window's centre. coord: whole numbers.

    Methods: iqd (median, inter-quartile distance), mean_dev (mean, absolute), mean_mad and median_mad (mean distance from mean,
    median distance from median), std (mean, population standard deviation).
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    half = width // 2
    placed = with_margins(rows, coord, half, max(width * 8, 1))
    good = bits.is_good(F.col(value), F.col(qc), mask)
    placed = placed.withColumns({"_x": F.when(good, F.col(value).cast("double")), "_t": F.col(coord).cast("long")})
    placed = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*series, "_chunk").orderBy("_t")))
    kept = [*rows.columns, "_x"]
    schema = T.StructType([*rows.schema.fields, T.StructField("_x", T.DoubleType()), T.StructField("_n", T.LongType()), T.StructField("_centre", T.DoubleType()), T.StructField("_spread", T.DoubleType())])

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(method, half, kept, min_points)
        for batch in batches:
            yield from held.take(batch)
        yield from held.judge(True)

    placed = placed.select(*kept, "_t", "_at", "_home").mapInArrow(windowed, schema)
    # a struct of the keys is never null, so that series without a name stay
    counts = rows.groupBy(F.struct(*series).alias("_of")).agg(F.count("*").alias("_all"))
    own = placed.withColumn("_of", F.struct(*series)).join(counts, "_of")
    short = F.col("_all") < min_points
    skipped = short | (F.col("_x").isNotNull() & (F.col("_n") < max(2, min_points)))
    judged = ~short & F.col("_x").isNotNull() & (F.col("_n") >= max(2, min_points))
    distance = F.abs(F.col("_x") - F.col("_centre"))
    flags = [F.coalesce(F.col(qc), F.lit(0)), bits.bit_if(skipped, skipped_flag), bits.bit_if(judged & (distance > F.col("_spread") * bad_threshold), bad_flag)]
    if ind_threshold is not None:
        flags.append(bits.bit_if(judged & (distance > F.col("_spread") * ind_threshold), ind_flag))
    return own.withColumn(qc, bits.either(*flags)).select(*rows.columns)
