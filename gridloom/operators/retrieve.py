"""Inputs for a processing interval: prioritised sources, alternate names, times and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.chunks import carried, carry, keyed


def in_interval(rows: DataFrame, coord: str, begin, end, begin_offset=0, end_offset=0) -> DataFrame:
    """Rows of [begin - begin_offset, end + end_offset)."""
    return rows.where((F.col(coord) >= begin - begin_offset) & (F.col(coord) < end + end_offset))


def prioritised(sources: list[DataFrame], groups: list[str], value: str) -> DataFrame:
    """All rows, for each group from the first source that has a value for it; source: its place in the list."""
    tagged = [s.withColumn("source", F.lit(k)) for k, s in enumerate(sources)]
    rows = tagged[0]
    for s in tagged[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    first = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.min("source").alias("source"))
    return rows.join(first, [*groups, "source"], "left_semi")


def first_present(rows: DataFrame, names: list[str], out: str, qc_required: bool = False) -> DataFrame:
    """The first of the alternate names that the table has (with its qc_ column, if required) as ``out``."""
    for name in names:
        if name in rows.columns and (not qc_required or f"qc_{name}" in rows.columns):
            found = rows.withColumn(out, F.col(name))
            return found.withColumn(f"qc_{out}", F.col(f"qc_{name}")) if f"qc_{name}" in rows.columns else found
    raise ValueError(f"none of {names} is present")


def time_range(rows: DataFrame, series: list[str], coord: str) -> DataFrame:
    return rows.groupBy(*series).agg(F.min(coord).alias("start"), F.max(coord).alias("end"), F.count(coord).alias("n"))


def find_index(times: DataFrame, refs: DataFrame, series: list[str], chunk: float) -> DataFrame:
    """For every ref: the indices lt, lteq, gt, gteq, eq (-1: none) among the ordered times of its series.

    times: (series, idx, t); refs: (series, ref). Of equal times, lt and lteq give the last, gt, gteq and eq the first.
    """
    known = times.groupBy(*series, "t").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    point = F.struct("t", "first", "last")
    rows = known.select(*series, F.col("t").alias("at"), F.lit(1).alias("place"), point.alias("point"))
    kind = rows.schema["point"].dataType
    asked = refs.select(*series, "ref").distinct()
    # a ref stands before equal times (place 0) for lt and gteq, and after them (place 2) for lteq and gt
    for place in (0, 2):
        rows = rows.unionByName(asked.select(*series, F.col("ref").alias("at"), F.lit(place).alias("place"), F.lit(None).cast(kind).alias("point")))
    rows = carry(keyed(rows, series, "at", chunk), series, ["at", "place"], {"before": F.col("point")}, {"after": F.col("point")})
    number = lambda column, place: F.max(F.when(F.col("place") == place, F.coalesce(F.col(column), F.lit(-1)))).cast("long")
    found = rows.where("place <> 1").groupBy(*series, F.col("at").alias("ref")).agg(
        number("before.last", 0).alias("lt"), number("before.last", 2).alias("lteq"), number("after.first", 2).alias("gt"), number("after.first", 0).alias("gteq"),
        F.max(F.when((F.col("place") == 0) & (F.col("after.t") == F.col("at")), F.col("after.first"))).alias("_eq"),
    )
    return found.withColumn("eq", F.coalesce("_eq", F.lit(-1)).cast("long")).drop("_eq")


def samples_between(rows: DataFrame, coord: str, begin=None, end=None, series: list[str] = ()) -> DataFrame:
    """Rows of [begin, end]; with one bound missing, the last sample before end or the first after begin of each series."""
    if begin is not None and end is not None:
        return rows.where((F.col(coord) >= begin) & (F.col(coord) <= end))
    test, pick = (F.col(coord) < end, F.max) if begin is None else (F.col(coord) > begin, F.min)
    near = rows.where(test).groupBy(*series).agg(pick(coord).alias(coord))
    return rows.join(near, [*series, coord], "left_semi")


def as_of(rows: DataFrame, properties: DataFrame, series: list[str], coord: str, valid_from: str, columns: list[str], chunk: float) -> DataFrame:
    """Rows with the properties that hold at their coordinate: those of the latest valid_from at or before it."""
    held = F.struct(*columns)
    told = properties.select(*series, F.col(valid_from).alias("_at"), F.lit(0).alias("_place"), held.alias("_held"))
    keep = F.struct(*[F.col(c) for c in rows.columns])
    asked = rows.select(*series, F.col(coord).alias("_at"), F.lit(1).alias("_place"), F.lit(None).cast(told.schema["_held"].dataType).alias("_held"), keep.alias("_row"))
    both = asked.unionByName(told, allowMissingColumns=True)
    both = carried(both, series, ["_at", "_place"], F.col("_held"), "_now", chunk)
    return both.where("_place = 1").select("_row.*", *[F.col(f"_now.{c}").alias(c) for c in columns])
