"""Target grids, cell edges and sampling intervals."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.chunks import carry, keyed, previous
from gridloom.sources import scratch


def regular(spark: SparkSession, start: float, interval: float, length: int) -> DataFrame:
    """(bin, coord) of ``length`` grid points."""
    return spark.range(length).select(F.col("id").alias("bin"), (F.lit(start) + F.col("id") * F.lit(interval)).alias("coord"))


def from_values(spark: SparkSession, values: list[float]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "bin long, coord double")


def length_of(start: Column | float, end: Column | float, interval: float) -> Column:
    """Number of grid points from start up to end."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return (F.floor((end - start) / F.lit(interval)) + 1).cast("long")


#: Grid points that one row gives at a time.
PART_POINTS = 100_000


def per_series(rows: DataFrame, series: list[str], coord: str, interval: int, start: Column | None = None) -> DataFrame:
    """(series, bin, coord): a grid over each series' extent, from ``start`` (default: its first coordinate).

    A long grid is made in parts, which are dealt out over the tasks.
    """
    extent = rows.groupBy(*series).agg(F.min(coord).alias("_low"), F.max(coord).alias("_high"))
    extent = extent.withColumn("_start", F.col("_low") if start is None else start).withColumn("_n", length_of(F.col("_start"), F.col("_high"), interval))
    parts = extent.where("_n > 0").withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 1) div {PART_POINTS})")))
    parts = parts.repartition(*series, "_part")
    grid = parts.select(*series, "_start", F.explode(F.expr(f"sequence(_part * {PART_POINTS}, least(_n, (_part + 1) * {PART_POINTS}) - 1)")).alias("bin"))
    return grid.select(*series, "bin", (F.col("_start") + F.col("bin") * interval).alias("coord"))


def from_bounds(rows: DataFrame, bounds: str, bin: str) -> DataFrame:
    """Adds lo and hi from a bounds variable, a struct or array of two edges in either order; ``bin`` names the bins. Rows without both edges go."""
    kind = rows.schema[bounds].dataType
    a, b = (F.col(bounds)[f.name] for f in kind.fields[:2]) if hasattr(kind, "fields") else (F.get(bounds, F.lit(k)) for k in (0, 1))
    found = rows.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)}).withColumn("bin", F.col(bin))
    return found.where(a.isNotNull() & b.isNotNull())


def with_width(rows: DataFrame, coord: str, width: Column | float, alignment: float = 0.5) -> DataFrame:
    """Adds lo and hi: cells of a width, aligned 0 (coordinate in front), 0.5 (in the middle) or 1 (at the back)."""
    width = width if isinstance(width, Column) else F.lit(width)
    return rows.withColumns({"lo": F.col(coord) - width * F.lit(alignment), "hi": F.col(coord) + width * F.lit(1 - alignment)})


def inferred_edges(rows: DataFrame, series: list[str], coord: str, chunk: float) -> DataFrame:
    """Adds lo and hi: contiguous cells that meet half-way; the outer ones are as wide outside as inside."""
    rows = carry(keyed(rows, series, coord, chunk), series, [coord], {"_before": F.struct(coord)}, {"_after": F.struct(coord)}, inclusive=False)
    c, before, after = F.col(coord), F.col(f"_before.{coord}"), F.col(f"_after.{coord}")
    lo = F.coalesce((c + before) / 2, c - (after - c) / 2, c)
    hi = F.coalesce((c + after) / 2, c + (c - before) / 2, c)
    return rows.withColumns({"lo": lo, "hi": hi}).drop("_before", "_after", "_k")


def midpoint(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2


#: Ranges of distances for each power of two.
_RANGES = 4096


def sampling_interval(rows: DataFrame, series: list[str], coord: str, chunk: float) -> DataFrame:
    """(series, interval): the element at index (n - 1) div 2 of the sorted distances of n coordinates.

    Distances are counted by ranges (4096 for each power of two) first; only those in the range that holds the middle are sorted.
    """
    steps = previous(rows.select(*series, coord), series, [coord], [coord], "_before", chunk)
    steps = steps.select(*series, F.abs(F.col(coord) - F.col(f"_before.{coord}")).alias("step")).where("step is not null")
    power = F.when(F.col("step") > 0, F.floor(F.log2("step")))
    place = F.coalesce(power * _RANGES + F.floor((F.col("step") / F.pow(F.lit(2.0), power) - 1) * _RANGES), F.lit(-(1 << 40)))
    counted = scratch.written(steps.groupBy(*series, "step").agg(F.count("*").alias("n")).withColumn("_range", place.cast("long")))

    def upto(counts: DataFrame, by: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*series).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))

    ranges = counted.groupBy(*series, "_range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumns({"_upto": upto(ranges, "_range"), "_all": F.sum("n").over(Window.partitionBy(*series))})
    middle = ranges.where((F.col("_upto") > F.floor(F.col("_all") / 2)) & (F.col("_upto") - F.col("n") <= F.floor(F.col("_all") / 2)))
    middle = middle.select(*[F.col(c).alias(f"_s_{c}") for c in series], F.col("_range").alias("_r"), (F.floor(F.col("_all") / 2) - (F.col("_upto") - F.col("n"))).alias("_want"))
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in series], F.col("_range") == F.col("_r"))
    inside = counted.join(middle, same)
    return inside.withColumn("_upto", upto(inside, "step")).where("_upto > _want").groupBy(*series).agg(F.min("step").alias("interval"))
