"""Hooks that users write as table functions and aggregations, for the steps of a process that no operator covers.

A table function gets the rows of a partition in order, one after another, and gives any number of rows of its own schema, which it derives from that of
its input; Spark deals the partitions out and sorts them. It should keep little: a partition may hold a large part of all rows. An aggregation gets the good
values of one target bin at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gridloom.functions import bits
from gridloom.operators import bin_average, grid
from gridloom.plans import transform


def apply(rows: DataFrame, hook: type, partition_by: list[str], order_by: list[str], **options) -> DataFrame:
    """The rows that a table function (a class with eval, terminate and a static analyze) gives for each partition; options are its named arguments."""
    given = rows.asTable().partitionBy(*partition_by) if partition_by else rows.asTable().withSinglePartition()
    return F.udtf(hook)(given.orderBy(*order_by), **{k: F.lit(v) for k, v in options.items()})


class Runs:
    """A row for each run of rows whose column ``time`` goes on by at most ``gap``: the columns in ``keys`` (comma-separated), begin, end and n. A null time ends a run."""

    def __init__(self) -> None:
        self.held: list | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, time: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        known = {f.name: f.dataType for f in rows.dataType}
        names = [k for k in keys.value.split(",") if k]
        missing = [c for c in [*names, time.value] if c not in known]
        if missing:
            raise ValueError(f"the table has no columns {missing}")
        own = [T.StructField(k, known[k]) for k in names]
        return AnalyzeResult(T.StructType([*own, T.StructField("begin", known[time.value]), T.StructField("end", known[time.value]), T.StructField("n", T.LongType())]))

    def eval(self, rows, keys: str, time: str, gap: int) -> Iterator[tuple]:
        t = rows[time]
        if self.held is not None and (t is None or t - self.held[-2] > gap):
            yield tuple(self.held)
            self.held = None
        if t is None:
            return
        if self.held is None:
            self.held = [*(rows[k] for k in keys.split(",") if k), t, t, 0]
        self.held[-2], self.held[-1] = t, self.held[-1] + 1

    def terminate(self) -> Iterator[tuple]:
        if self.held is not None:
            yield tuple(self.held)


def register_aggregate(name: str, aggregate: Callable[[Column], Column], width: float, *, alignment: float = 0.5, mask: int = 1) -> None:
    """A transform, by name, that aggregates the good points in a bin of each target; ``aggregate`` may be a grouped-aggregate pandas UDF.

    Like others it gives (series, bin, coord, value, qc); bins without points are outside, those with bad ones only are all bad.
    """

    def act(rows: DataFrame, targets: DataFrame, series: list[str]) -> DataFrame:
        inputs = rows.select(*series, F.col("coord").cast("double").alias("_i0"), F.col("coord").cast("double").alias("_i1"), "value", F.coalesce("qc", F.lit(0)).alias("qc"))
        bins = grid.with_width(targets, "coord", width, alignment).select(*series, "bin", F.col("lo").cast("double").alias("_t0"), F.col("hi").cast("double").alias("_t1"))
        met = bin_average._met_in_nodes(inputs, bins, series)
        good = bits.is_good(F.col("value"), F.col("qc"), mask)
        values = met.where(good).groupBy(*series, "bin").agg(aggregate(F.col("value")).alias("value"))
        counts = met.groupBy(*series, "bin").agg(F.count("*").alias("_n"), F.count(F.when(~good, 1)).alias("_bad"), F.bit_or(F.when(good, F.col("qc")).otherwise(0)).alias("_qc"))
        found = targets.join(counts, [*series, "bin"], "left").join(values, [*series, "bin"], "left")
        none, all_bad = F.col("_n").isNull(), F.col("_n") == F.col("_bad")
        qc = bits.either(
            bits.bit_if(none, bits.OUTSIDE | bits.BAD), bits.bit_if(F.coalesce(all_bad, F.lit(False)), bits.ALL_BAD | bits.BAD), bits.bit_if(F.coalesce(F.col("_bad") > 0, F.lit(False)), bits.SOME_BAD),
            bits.bit_if(F.coalesce(F.col("_qc").bitwiseAND(F.lit(~mask)) != 0, F.lit(False)), bits.INDETERMINATE),
        )
        return found.select(*series, "bin", "coord", "value", qc.cast("int").alias("qc"))

    transform.register(name, act)
