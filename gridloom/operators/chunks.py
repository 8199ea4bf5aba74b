"""Ordered operations on long series.

A series may hold a large part of all rows, so no window here spans a whole series: rows are windowed within
chunks of the coordinate, what crosses a chunk's edge comes from a summary with one row per chunk, and centred windows get
copies of the neighbouring chunk's margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources import scratch

#: Microseconds of a day: the usual chunk where coordinates are times.
DAY = 86_400_000_000


def keyed(rows: DataFrame, series: list[str], coord: str, chunk: float) -> DataFrame:
    """Adds _k, the series and chunk of a row. As one struct it is never null and equals itself where a series column is null,
    and rows dealt out by it stay where they are for every window, summary and join of carry()."""
    return rows.withColumn("_k", F.struct(*series, F.floor(F.col(coord) / F.lit(chunk)).alias("_chunk")))


def carry(rows: DataFrame, series: list[str], order: list[str], last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, *, inclusive: bool = True) -> DataFrame:
    """carried() for several values and both directions at once, for rows that keyed() has prepared; _k stays.

    last: values whose last one at or before a row is wanted, by output column; first: those whose first one at or after it is.
    One summary serves all of them, so the rows are computed twice in all, however many values there are.
    """
    wanted = [(out, value, False) for out, value in (last or {}).items()] + [(out, value, True) for out, value in (first or {}).items()]
    rows = rows.withColumns({f"_v_{out}": value for out, value, _ in wanted})
    place = F.struct(*order)
    edges = rows.groupBy("_k").agg(*[(F.min_by if back else F.max_by)(f"_v_{out}", F.when(F.col(f"_v_{out}").isNotNull(), place)).alias(f"_e_{out}") for out, _, back in wanted])

    def window(back: bool, by: list[Column], over: list[Column], end: int):
        return Window.partitionBy(*by).orderBy(*[c.desc() if back else c.asc() for c in over]).rowsBetween(Window.unboundedPreceding, end)

    names = [F.col(f"_k.{c}") for c in series]
    edges = edges.select("_k", *[F.last(f"_e_{out}", ignorenulls=True).over(window(back, names, [F.col("_k._chunk")], -1)).alias(f"_c_{out}") for out, _, back in wanted])
    inside = [F.col("_k")]
    rows = rows.withColumns({f"_o_{out}": F.last(f"_v_{out}", ignorenulls=True).over(window(back, inside, [F.col(c) for c in order], 0 if inclusive else -1)) for out, _, back in wanted})
    joined = rows.join(edges, "_k", "left").withColumns({out: F.coalesce(f"_o_{out}", f"_c_{out}") for out, _, _ in wanted})
    return joined.drop(*[f"_{x}_{out}" for out, _, _ in wanted for x in "voc"])


def carried(rows: DataFrame, series: list[str], order: list[str], value: Column, out: str, chunk: float, *, backward: bool = False, inclusive: bool = True) -> DataFrame:
    """Adds ``out``: the last value that isn't null at or before each row of its series.

    order: the coordinate, then columns that settle ties. backward: the first value at or after the row.
    inclusive: whether the row itself counts.
    """
    values = {out: value}
    return carry(keyed(rows, series, order[0], chunk), series, order, None if backward else values, values if backward else None, inclusive=inclusive).drop("_k")


def previous(rows: DataFrame, series: list[str], order: list[str], columns: list[str], out: str, chunk: float, *, backward: bool = False) -> DataFrame:
    """Adds the struct ``out`` of the row before (backward: after) in its series; null for the first."""
    return carried(rows, series, order, F.struct(*columns), out, chunk, backward=backward, inclusive=False)


def with_margins(rows: DataFrame, coord: str, half: int, chunk: int) -> DataFrame:
    """Copies each row to every chunk that a window of +-half around it reaches: _chunk, and _home for the row's own one."""
    reach = F.sequence(F.floor((F.col(coord) - half) / chunk), F.floor((F.col(coord) + half) / chunk))
    return rows.withColumn("_chunk", F.explode(reach)).withColumn("_home", F.col("_chunk") == F.floor(F.col(coord) / chunk))


def running_sum(rows: DataFrame, series: list[str], order: list[str], value: Column, out: str, chunk: float) -> DataFrame:
    """Adds ``out``: the sum of a value up to each row of its series, from the sums of chunks and the sum within one."""
    rows = keyed(rows.withColumn("_v", value), series, order[0], chunk)
    names = [F.col(f"_k.{c}") for c in series]
    earlier = Window.partitionBy(*names).orderBy("_k._chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_k").agg(F.sum("_v").alias("_s")).select("_k", F.sum("_s").over(earlier).alias("_before"))
    own = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum("_v").over(own)).join(sums, "_k", "left")
    return rows.withColumn(out, F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_k", "_v", "_own", "_before")


def numbered(rows: DataFrame, keys: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the row's number (from 1) in the order of the keys over the whole table: ranges of the keys are
    numbered where they are, after the counts of the ranges before (one row each)."""
    names = [f"_key{k}" for k in range(len(keys))]
    rows = rows.withColumns(dict(zip(names, keys, strict=True)))
    ranges = rows.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_id", F.monotonically_increasing_id())
    # the number of a range is in the upper bits of the id, the row's place in the lower ones
    ranges = scratch.written(ranges.withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return ranges.join(before, "_range").withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_id", "_range", "_place", "_before", *names)
