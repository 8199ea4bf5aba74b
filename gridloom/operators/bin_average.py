"""Weighted averages in target bins, with coverage and quality bits.

Inputs are points, or cells that count with the share of their width inside a bin. Bad inputs (null, not finite or with a
masked bit) are left out and noted; bins without good inputs are null. Results: value, value_std (population), value_goodfraction, qc.

A cell that only touches a bin is a candidate of weight 0, so a bin with nothing but such cells gives 0 and ZERO_WEIGHT; unlike good
inputs, values of such cells never enter the sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import bits
from gridloom.operators.chunks import carried
from gridloom.operators.grid import PART_POINTS


@dataclass(frozen=True)
class Limits:
    std_bad_max: float = float("inf")
    std_ind_max: float = float("inf")
    goodfrac_bad_min: float = -1.0
    goodfrac_ind_min: float = -1.0


def _sums(share: Column, span: Column, weight: Column, mask: int) -> list[Column]:
    value, qc = F.col("value"), F.coalesce(F.col("qc"), F.lit(0))
    good = bits.is_good(value, qc, mask)
    inside = share > 0
    counts = inside & good
    w = F.when(counts, share * weight).otherwise(0.0)
    x = F.when(counts, value).otherwise(0.0)
    return [
        F.count("*").alias("_n"),
        F.max(F.when(inside, weight)).alias("_most"),
        F.max(F.when(inside & ~good, 1).otherwise(0)).alias("_some_bad"),
        F.sum(w).alias("_s0"),
        F.sum(w * x).alias("_s1"),
        F.sum(w * x * x).alias("_s2"),
        F.sum(span).alias("_total"),
        F.sum(F.when(~inside | good, span).otherwise(0.0)).alias("_good"),
        F.bit_or(F.when(w > 0, qc).otherwise(0)).alias("_qc"),
    ]


def _finish(bins: DataFrame, keys: list[str], mask: int, limits: Limits) -> DataFrame:
    none = F.coalesce(F.col("_n"), F.lit(0)) == 0
    zero = ~none & (F.coalesce(F.col("_most"), F.lit(0.0)) == 0)
    all_bad = ~none & ~zero & (F.col("_s0") == 0)
    used = ~none & ~zero & ~all_bad
    variance = (F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1")) / (F.col("_s0") * F.col("_s0"))
    std = F.when(zero, F.lit(0.0)).when(used, F.when(F.abs(variance) < 1e-12, F.lit(0.0)).when(variance > 0, F.sqrt(variance)))
    fraction = F.when(used, F.col("_good") / F.col("_total")).otherwise(F.lit(0.0))
    bins = bins.withColumns({"value": F.when(zero, F.lit(0.0)).when(used, F.col("_s1") / F.col("_s0")), "value_std": std, "value_goodfraction": fraction})
    std, fraction = F.col("value_std"), F.col("value_goodfraction")
    qc = bits.either(
        bits.bit_if(none, bits.OUTSIDE | bits.BAD),
        bits.bit_if(zero, bits.ZERO_WEIGHT),
        bits.bit_if(all_bad, bits.ALL_BAD | bits.BAD),
        bits.bit_if(F.col("_some_bad") == 1, bits.SOME_BAD),
        bits.bit_if(used & (F.col("_qc").bitwiseAND(F.lit(~mask)) != 0), bits.INDETERMINATE),
        F.when(std > limits.std_bad_max, F.lit(bits.BAD_STD)).when(std > limits.std_ind_max, F.lit(bits.IND_STD)).otherwise(F.lit(0)),
        F.when(fraction < limits.goodfrac_bad_min, F.lit(bits.BAD_GOODFRAC)).when(fraction < limits.goodfrac_ind_min, F.lit(bits.IND_GOODFRAC)).otherwise(F.lit(0)),
    )
    return bins.withColumn("qc", qc.cast("int")).select(*keys, "value", "value_std", "value_goodfraction", "qc")


def average_points(rows: DataFrame, grid: DataFrame, series: list[str], coord: str, start: float, width: float, *, weight: Column | None = None, mask: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Point inputs (series, coord, value, qc) into contiguous bins of one width: a hash aggregation, no join of rows with bins.

    grid: (series, bin, coord) with bin k covering [start + k width, start + (k + 1) width); every bin of it is in the result.
    """
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    placed = rows.withColumn("bin", F.floor((F.col(coord) - F.lit(start)) / F.lit(width)).cast("long"))
    sums = placed.groupBy(*series, "bin").agg(*_sums(F.lit(1.0), F.lit(1.0), weight, mask))
    return _finish(grid.join(sums, [*series, "bin"], "left"), [*series, "bin", "coord"], mask, limits)


def level(lo: Column, hi: Column, least: int) -> Column:
    """The level of a cell: its width is at most 2 ** level, so it reaches two nodes of that size, or one."""
    return F.greatest(F.when(hi > lo, F.ceil(F.log2(hi - lo))).otherwise(F.lit(least)), F.lit(least)).cast("int")


def nodes(lo: Column, hi: Column, levels: Column) -> Column:
    """(level, node) of the dyadic intervals of the given levels that a cell reaches: node k of a level covers [k, k + 1) times 2 ** level."""
    size = lambda n: F.pow(F.lit(2.0), n.cast("double"))
    each = lambda n: F.transform(F.sequence(F.floor(lo / size(n)), F.floor(hi / size(n))), lambda k: F.struct(n.alias("level"), k.alias("node")))
    return F.flatten(F.transform(levels, each))


def _met_in_nodes(inputs: DataFrame, targets: DataFrame, series: list[str]) -> DataFrame:
    """Pairs of inputs and bins with a common point, for cells of any widths.

    Of each pair the wider cell is looked up at its own level, in the nodes that the other one reaches there: a cell gives at most two rows for each level
    that the other side has, however wide it is.
    """
    of = lambda lo, hi: F.when(F.col(hi) > F.col(lo), F.ceil(F.log2(F.col(hi) - F.col(lo)))).cast("int")
    # one row for each power of two among the widths
    have = {side: sorted(r[0] for r in rows.select(of(f"_{side}0", f"_{side}1").alias("n")).where("n is not null").distinct().collect()) for side, rows in (("i", inputs), ("t", targets))}
    least = min([*have["i"][:1], *have["t"][:1]], default=0)
    both = {side: sorted({*have[side], least}) for side in have}
    placed = {}
    for side, rows in (("i", inputs), ("t", targets)):
        placed[side] = rows.withColumn("_own", level(F.col(f"_{side}0"), F.col(f"_{side}1"), least))
    i0, i1, t0, t1 = (F.col(c) for c in ("_i0", "_i1", "_t0", "_t1"))

    def reaching(side: str, other: str, strictly: bool) -> DataFrame:
        wider = F.filter(F.array(*map(F.lit, both[other])), lambda n: (n > F.col("_own")) if strictly else (n >= F.col("_own")))
        return placed[side].withColumn("_k", F.explode(nodes(F.col(f"_{side}0"), F.col(f"_{side}1"), wider))).drop("_own")

    def home(side: str) -> DataFrame:
        return placed[side].withColumn("_k", F.explode(nodes(F.col(f"_{side}0"), F.col(f"_{side}1"), F.array("_own")))).drop("_own")

    size = F.pow(F.lit(2.0), F.col("_k.level").cast("double"))
    first = F.floor(F.greatest(i0, t0) / size) == F.col("_k.node")
    met = reaching("i", "t", False).join(home("t"), [*series, "_k"]).unionByName(home("i").join(reaching("t", "i", True), [*series, "_k"]))
    return met.where((i1 >= t0) & (i0 < t1) & first)


def average_cells(rows: DataFrame, bins: DataFrame, series: list[str], bucket: float | None = None, *, weight: Column | None = None, mask: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Input cells or points (series, lo, hi, value, qc) into bins (series, bin, lo, hi) that may overlap each other.

    A bucketed range join: cells and bins meet in the buckets of the coordinate that both reach, and count in the first of these
    only. ``bucket`` should be about the width of the wider of the two; without it, widths may differ by any factor, and cells meet in dyadic intervals.
    """
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    inputs = rows.withColumn("_w", weight).select(*series, F.col("lo").alias("_i0"), F.col("hi").alias("_i1"), "value", "qc", "_w")
    targets = bins.select(*series, "bin", F.col("lo").alias("_t0"), F.col("hi").alias("_t1"))
    i0, i1, t0, t1 = (F.col(c) for c in ("_i0", "_i1", "_t0", "_t1"))
    if bucket is None:
        met = _met_in_nodes(inputs, targets, series)
    else:
        reach = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
        first = F.greatest(F.floor(i0 / bucket), F.floor(t0 / bucket)) == F.col("_b")
        met = inputs.withColumn("_b", reach("_i0", "_i1")).join(targets.withColumn("_b", reach("_t0", "_t1")), [*series, "_b"]).where((i1 >= t0) & (i0 < t1) & first)
    size = i1 - i0
    share = F.when(size == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(0.0), (t0 - i0) / size) - F.greatest(F.lit(0.0), (i1 - t1) / size))
    met = met.withColumns({"_share": share, "_span": F.when(size == 0, F.lit(1.0)).otherwise(share * size)})
    sums = met.groupBy(*series, "bin").agg(*_sums(F.col("_share"), F.col("_span"), F.col("_w"), mask))
    return _finish(bins.join(sums, [*series, "bin"], "left"), [*series, "bin", "lo", "hi"], mask, limits)


def average_by_properties(rows: DataFrame, properties: DataFrame, series: list[str], coord: str, end: float, chunk: float, *, weight: Column | None = None, mask: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Points (series, coord, value, qc) into bins whose width and origin change along the coordinate, as (series, start, width, origin) of ``properties`` say.

    A property holds from its start up to the next one's, the last up to ``end``. Within its reach bins begin at the origin plus multiples of the width, and are cut
    where it begins and ends; points before the first property are in no bin. Each point takes the property that holds (no join of points with bins).
    Results: (series, lo, hi) with value, value_std, value_goodfraction and qc, also of bins without points.
    """
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    held = F.struct("start", "width", "origin", F.col("_until").alias("until"))
    order = Window.partitionBy(*series).orderBy("start")
    known = properties.select(*series, "start", "width", "origin").withColumn("_until", F.least(F.coalesce(F.lead("start").over(order), F.lit(end)), F.lit(end)))
    # properties come before the points at their own coordinate
    points = rows.withColumn("_w", weight).select(*series, F.col(coord).alias("_at"), F.lit(1).alias("_point"), "value", "qc", "_w")
    marks = known.where("start < _until").select(*series, F.col("start").cast(points.schema["_at"].dataType).alias("_at"), F.lit(0).alias("_point"), held.alias("_held"))
    both = carried(points.unionByName(marks, allowMissingColumns=True), series, ["_at", "_point"], F.col("_held"), "_p", chunk).where((F.col("_point") == 1) & (F.col("_at") < F.lit(end)) & F.col("_p").isNotNull())
    p = lambda c: F.col(f"_p.{c}")
    k = F.floor((F.col("_at") - p("origin")) / p("width"))
    placed = both.withColumns({"lo": F.greatest(p("origin") + k * p("width"), p("start"))})
    sums = placed.groupBy(*series, "lo").agg(*_sums(F.lit(1.0), F.lit(1.0), F.col("_w"), mask))
    # the bins of each property, in parts that are dealt out over the tasks
    spans = known.where("start < _until").withColumns({"_first": F.floor((F.col("start") - F.col("origin")) / F.col("width")), "_last": F.ceil((F.col("_until") - F.col("origin")) / F.col("width")) - 1})
    spans = spans.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_last - _first) div {PART_POINTS})"))).repartition(*series, "start", "_part")
    bins = spans.withColumn("_k", F.explode(F.expr(f"sequence(_first + _part * {PART_POINTS}, least(_last, _first + (_part + 1) * {PART_POINTS} - 1))")))
    bins = bins.select(*series, F.greatest(F.col("origin") + F.col("_k") * F.col("width"), "start").alias("lo"), F.least(F.col("origin") + (F.col("_k") + 1) * F.col("width"), "_until").alias("hi"))
    return _finish(bins.join(sums, [*series, "lo"], "left"), [*series, "lo", "hi"], mask, limits)
