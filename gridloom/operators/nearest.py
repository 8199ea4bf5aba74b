"""Linear interpolation and nearest-neighbour sampling at target coordinates.

Both merge the targets into the ordered inputs and carry what is needed from the nearest good inputs, so no pairs of inputs and
targets are formed. Targets: (series, bin, coord); inputs: (series, coord, value, qc) with different coordinates within a series.

Where only one side of a target has good inputs, the two nearest of that side are used, also when one of them is the first input of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bits
from gridloom.operators.chunks import carry, keyed
from gridloom.sources import scratch

_EXACT = 1e-8


def _merged(rows: DataFrame, targets: DataFrame, series: list[str], mask: int, chunk: float) -> DataFrame:
    """Inputs and targets in one table. point: the input; good: the input if it can be used; place: inputs first."""
    good = bits.is_good(F.col("value"), F.col("qc"), mask)
    point = F.struct(F.col("coord").cast("double").alias("x"), F.col("value").cast("double").alias("y"), F.coalesce(F.col("qc"), F.lit(0)).cast("int").alias("qc"), good.alias("good"))
    inputs = rows.select(*series, F.lit(None).cast("long").alias("bin"), F.col("coord").cast("double").alias("coord"), F.lit(0).alias("place"), point.alias("point"))
    wanted = targets.select(*series, F.col("bin").cast("long").alias("bin"), F.col("coord").cast("double").alias("coord"), F.lit(1).alias("place"), F.lit(None).cast(inputs.schema["point"].dataType).alias("point"))
    # both passes and the ends read the merged table, not what it is made of
    return keyed(scratch.written(inputs.unionByName(wanted)), series, "coord", chunk)


def _good() -> Column:
    return F.when(F.col("point.good"), F.col("point"))


def _edges(rows: DataFrame, series: list[str]) -> DataFrame:
    """Per series: number of inputs and good inputs, first and last coordinate."""
    return rows.groupBy(*series).agg(
        F.count("point").alias("_n"), F.sum(F.when(F.col("point.good"), 1).otherwise(0)).alias("_goods"), F.min("point.x").alias("_first"), F.max("point.x").alias("_last")
    )


def interpolate(rows: DataFrame, targets: DataFrame, series: list[str], chunk: float, *, reach: float | None = None, mask: int = 1) -> DataFrame:
    """(series, bin, coord, value, dist_1, dist_2, qc) by the good inputs on both sides of each target."""
    merged = _merged(rows, targets, series, mask, chunk)
    order = ["coord", "place"]
    # for each input the good one and the one of any kind before and after it; targets don't come between
    beside = carry(merged, series, order, {"_pg": _good(), "_pp": F.col("point")}, {"_ng": _good(), "_np": F.col("point")}, inclusive=False)
    own = F.when(F.col("place") == 0, F.struct("point", "_pg", "_ng", "_pp", "_np"))
    both = keyed(scratch.written(beside.withColumn("own", own).drop("_pg", "_ng", "_pp", "_np", "_k")), series, "coord", chunk)
    good = F.when(F.col("own.point.good"), F.col("own"))
    both = carry(both, series, order, {"g1": good, "r1": F.col("own")}, {"g2": good, "r2": F.col("own")})
    wanted = both.where("place = 1").join(_edges(merged, series), series, "left")
    x = F.col("coord")
    # the raw bracket; beyond an end it is the two points of that end
    n1 = F.when(F.col("r1").isNull(), F.col("r2.point")).when(F.col("r2").isNull(), F.col("r1._pp")).otherwise(F.col("r1.point"))
    n2 = F.when(F.col("r1").isNull(), F.col("r2._np")).when(F.col("r2").isNull(), F.col("r1.point")).otherwise(F.col("r2.point"))
    wanted = wanted.withColumns({"n1": n1, "n2": n2})
    one = F.when(F.col("g1").isNull(), F.col("g2.point")).when(F.col("g2").isNull() & F.col("r2").isNull(), F.col("g1._pg")).otherwise(F.col("g1.point"))
    two = F.when(F.col("g1").isNull(), F.col("g2._ng")).when(F.col("g2").isNull(), F.when(F.col("r2").isNull(), F.col("g1.point")).otherwise(F.col("g1._pg"))).otherwise(F.col("g2.point"))
    hit = F.when(F.col("r1.point.good") & (F.abs(F.col("r1.point.x") - x) < _EXACT), F.col("r1.point")).when(F.col("r2.point.good") & (F.abs(F.col("r2.point.x") - x) < _EXACT), F.col("r2.point"))
    wanted = wanted.withColumns({"one": one, "two": two, "hit": hit})
    few = F.coalesce(F.col("_n"), F.lit(0)) < 2
    low = F.when(F.col("r1").isNull(), F.abs(F.col("n2.x") - F.col("n1.x")) / 2)
    high = F.when(F.col("r2").isNull(), F.abs(F.col("n2.x") - F.col("n1.x")) / 2)
    beyond = ~few & (F.coalesce(F.col("_first") - x > low, F.lit(False)) | F.coalesce(x - F.col("_last") > high, F.lit(False)))
    no_pair = F.col("_goods") < 2
    far = F.lit(False) if reach is None else (F.abs(F.col("one.x") - x) > reach) | (F.abs(F.col("two.x") - x) > reach)
    u = (x - F.col("one.x")) / (F.col("two.x") - F.col("one.x"))
    wanted = wanted.withColumn("u", u)
    exact = ~few & ~beyond & F.col("hit").isNotNull()
    outside = few | beyond
    poor = ~outside & ~exact & no_pair
    out_of_reach = ~outside & ~exact & ~poor & F.coalesce(far, F.lit(False))
    used = ~outside & ~exact & ~poor & ~out_of_reach
    walked = ~F.coalesce(F.col("n1.good"), F.lit(False)) | ~F.coalesce(F.col("n2.good"), F.lit(False))
    unsure = lambda side, weight: (F.col(f"{side}.qc").bitwiseAND(F.lit(~mask)) != 0) & (F.abs(weight) > 1e-5)
    qc = bits.either(
        bits.bit_if(outside | out_of_reach, bits.OUTSIDE | bits.BAD),
        bits.bit_if(poor, bits.ALL_BAD | bits.BAD),
        bits.bit_if((used | out_of_reach) & walked, bits.INTERPOLATED),
        bits.bit_if(used & ((F.col("u") < 0) | (F.col("u") > 1)), bits.EXTRAPOLATED),
        bits.bit_if(used & (unsure("one", 1 - F.col("u")) | unsure("two", F.col("u"))), bits.INDETERMINATE),
    )
    value = F.when(exact, F.col("hit.y")).when(used, F.col("u") * F.col("two.y") + (1 - F.col("u")) * F.col("one.y"))
    distance = lambda side: F.when(exact, F.lit(0.0)).when(used, F.col(f"{side}.x") - x)
    return wanted.select(*series, "bin", "coord", value.alias("value"), distance("one").alias("dist_1"), distance("two").alias("dist_2"), qc.cast("int").alias("qc"))


def subsample(rows: DataFrame, targets: DataFrame, series: list[str], chunk: float, *, reach: float | None = None, mask: int = 1) -> DataFrame:
    """(series, bin, coord, value, dist, qc): the nearest good input within reach; of two equally near ones the earlier."""
    merged = _merged(rows, targets, series, mask, chunk)
    order = ["coord", "place"]
    both = carry(merged, series, order, {"g1": _good(), "r1": F.col("point")}, {"g2": _good(), "r2": F.col("point")})
    wanted = both.where("place = 1").join(_edges(merged, series), series, "left")
    x = F.col("coord")
    d = {c: F.abs(F.col(f"{c}.x") - x) for c in ("g1", "g2", "r1", "r2")}
    nearer = F.when(F.col("g2").isNull() | (d["g1"] <= d["g2"]), F.col("g1")).otherwise(F.col("g2"))
    wanted = wanted.withColumns({"near": nearer, "raw": F.least(d["r1"], d["r2"])})
    chosen = F.abs(F.col("near.x") - x)
    found = F.col("near").isNotNull() if reach is None else F.coalesce(chosen <= reach, F.lit(False))
    past = F.coalesce(F.lit(False) if reach is None else x - F.lit(reach) > F.col("_last"), F.lit(True)) | (F.coalesce(F.col("_n"), F.lit(0)) == 0)
    qc = bits.either(
        bits.bit_if(~found & past, bits.OUTSIDE | bits.BAD),
        bits.bit_if(~found & ~past, bits.ALL_BAD | bits.BAD),
        bits.bit_if(found & (F.col("near.qc").bitwiseAND(F.lit(~mask)) != 0), bits.INDETERMINATE),
        bits.bit_if(found & (chosen > F.col("raw")), bits.NOT_CLOSEST),
    )
    return wanted.select(*series, "bin", "coord", F.when(found, F.col("near.y")).alias("value"), F.when(found, F.col("near.x") - x).alias("dist"), qc.cast("int").alias("qc"))


def pass_through(rows: DataFrame, series: list[str], target_lengths: DataFrame | None = None) -> DataFrame:
    """Values and qc as they are; raises in the job if a series' length differs from that of its target (series, length)."""
    if target_lengths is None:
        return rows
    counts = rows.groupBy(*series).agg(F.count("*").alias("_n")).join(target_lengths, series, "left")
    checked = counts.select(*series, F.when(F.col("_n") == F.col("length"), F.lit(True)).otherwise(F.raise_error(F.lit("input and target lengths differ")).cast("boolean")).alias("_ok"))
    return rows.join(checked, series).where("_ok").drop("_ok")
