"""Quality checks that set bits and never drop rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bits, metadata
from gridloom.operators.chunks import previous


def limits(value: Column, *, missing: list[float] = (), low: float | None = None, high: float | None = None, missing_flag: int = 1, low_flag: int = 2, high_flag: int = 4) -> Column:
    """The flag of the first test that a value meets: missing (or null), below low, above high; limits themselves pass."""
    flag = F.when(value.isNull() | (value.isin(*missing) if missing else F.lit(False)), F.lit(missing_flag))
    if low is not None:
        flag = flag.when(value < low, F.lit(low_flag))
    if high is not None:
        flag = flag.when(value > high, F.lit(high_flag))
    return flag.otherwise(F.lit(0))


def delta(rows: DataFrame, series: list[str], order: list[str], value: str, qc: str, most: float, chunk: float, *, flag: int = 8, bad: int = 7) -> DataFrame:
    """Sets the flag where a value differs from the one before by more than ``most`` and neither is bad; most <= 0 switches it off."""
    if most <= 0:
        return rows
    rows = previous(rows, series, order, [value, qc], "_before", chunk)
    fine = ~bits.any_of(F.col(qc), bad) & ~bits.any_of(F.col(f"_before.{qc}"), bad)
    jump = F.abs(F.col(value) - F.col(f"_before.{value}")) > most
    return rows.withColumn(qc, bits.either(F.coalesce(F.col(qc), F.lit(0)), bits.bit_if(F.col("_before").isNotNull() & fine & jump, flag))).drop("_before")


def time_steps(rows: DataFrame, series: list[str], order: list[str], time: str, qc: str, chunk: float, *, least: float | None = None, most: float | None = None, flags: tuple[int, int, int] = (1, 2, 4)) -> DataFrame:
    """Flags for a step to the time before in arrival order that is 0 or negative, else too short, else too long.

    order: the arrival order, whose first column is cut into chunks.
    """
    rows = previous(rows, series, order, [time], "_before", chunk)
    step = F.col(time) - F.col(f"_before.{time}")
    flag = F.when(step <= 0, F.lit(flags[0]))
    if least is not None:
        flag = flag.when(step < least, F.lit(flags[1]))
    if most is not None:
        flag = flag.when(step > most, F.lit(flags[2]))
    return rows.withColumn(qc, bits.either(F.coalesce(F.col(qc), F.lit(0)), flag.otherwise(F.lit(0)))).drop("_before")


# The limits that standard_checks() reads from a column's attributes, and the bit of each test.
STANDARD_TESTS = {"missing": 1, "valid_min": 2, "valid_max": 3, "valid_delta": 4, "fail_min": 5, "fail_max": 6, "fail_delta": 7, "warn_min": 8, "warn_max": 9, "warn_delta": 10}
#: Missing, below valid_min, above valid_max: bits of a value that no step is taken from or to.
BAD_FOR_STEPS = 7


def standard_checks(rows: DataFrame, variables: list[str], series: list[str], order: list[str], chunk: float, before: DataFrame | None = None) -> DataFrame:
    """Adds or extends qc_<variable> by the tests that a variable's attributes ask for: missing values, and minimum, maximum and greatest step
    of the kinds valid, fail (both bad) and warn (indeterminate). Tests without an attribute set nothing; a missing value fails no other test,
    and steps from or to a value with one of the bits ``BAD_FOR_STEPS`` aren't judged.

    before: the last earlier row of each series (with its qc columns), which steps are also taken from; it isn't returned.
    All steps are taken by one ordered pass over the rows. Descriptions and assessments of the bits are attributes of qc_<variable>.
    """
    held = {v: metadata.attributes(rows, v) for v in variables}
    stepped = [v for v in variables if any(held[v].get(f"{k}_delta", 0) > 0 for k in ("valid", "fail", "warn"))]
    old = {c: metadata.attributes(rows, c) for c in rows.columns}
    missing = {v: metadata.missing_mask(rows, v) for v in variables}
    flags, said = {}, {}
    for v in variables:
        qc, value = f"qc_{v}", F.col(v)
        known = F.coalesce(F.col(qc), F.lit(0)) if qc in rows.columns else F.lit(0)
        parts, said[v] = [known, bits.bit_if(missing[v], 1)], {"bit_1_description": "value is missing", "bit_1_assessment": "Bad"}
        for kind in ("valid", "fail", "warn"):
            for what, test in (("min", lambda limit: value < limit), ("max", lambda limit: value > limit)):
                limit, bit = held[v].get(f"{kind}_{what}"), STANDARD_TESTS[f"{kind}_{what}"]
                if limit is not None:
                    parts.append(bits.bit_if(F.coalesce(test(limit) & ~missing[v], F.lit(False)), 1 << (bit - 1)))
        flags[v] = bits.either(*parts).cast("int")
    rows = rows.withColumns({f"qc_{v}": flags[v] for v in variables})
    if stepped:
        wanted = [c for v in stepped for c in (v, f"qc_{v}")]
        if before is not None:
            types = {f.name: f.dataType for f in rows.schema}
            earlier = before.select(*[F.col(c).cast(types[c]).alias(c) for c in dict.fromkeys([*series, *order, *wanted]) if c in before.columns], F.lit(True).alias("_earlier"))
            rows = rows.withColumn("_earlier", F.lit(False)).unionByName(earlier, allowMissingColumns=True)
        rows = previous(rows, series, order, wanted, "_before", chunk)
        rows = rows.where("not _earlier").drop("_earlier") if before is not None else rows
        for v in stepped:
            value, qc, last = F.col(v), F.col(f"qc_{v}"), F.col(f"_before.{v}")
            fine = ~bits.any_of(qc, BAD_FOR_STEPS) & last.isNotNull() & ~bits.any_of(F.coalesce(F.col(f"_before.qc_{v}"), F.lit(0)), BAD_FOR_STEPS)
            parts = [qc]
            for kind in ("valid", "fail", "warn"):
                limit, bit = held[v].get(f"{kind}_delta"), STANDARD_TESTS[f"{kind}_delta"]
                if limit is not None and limit > 0:
                    parts.append(bits.bit_if(F.coalesce(fine & (F.abs(value - last) > limit), F.lit(False)), 1 << (bit - 1)))
            rows = rows.withColumn(f"qc_{v}", bits.either(*parts).cast("int"))
        rows = rows.drop("_before")
    for v in variables:
        for kind, what in ((k, w) for k in ("valid", "fail", "warn") for w in ("min", "max", "delta")):
            limit, bit = held[v].get(f"{kind}_{what}"), STANDARD_TESTS[f"{kind}_{what}"]
            if limit is not None and not (what == "delta" and limit <= 0):
                said[v] |= {f"bit_{bit}_description": f"{kind}_{what} is {limit}", f"bit_{bit}_assessment": "Indeterminate" if kind == "warn" else "Bad"}
        old[f"qc_{v}"] = {**old.get(f"qc_{v}", {}), **said[v]}
    for c, values in old.items():
        rows = rows.withMetadata(c, values)
    return rows


def limits_arrays(values: Column, *, missing: list[float] = (), missing_flags: list[int] = (), low: float | None = None, high: float | None = None, low_flag: int = 4, high_flag: int = 8) -> Column:
    """limits() of each element of an array, with a flag for each missing value."""

    def flag(x: Column) -> Column:
        out = F.when(x.isNull(), F.lit(missing_flags[0] if missing_flags else 1))
        for value, own in zip(missing, missing_flags, strict=True):
            out = out.when(x == value, F.lit(own))
        out = out.when(x < low, F.lit(low_flag)) if low is not None else out
        out = out.when(x > high, F.lit(high_flag)) if high is not None else out
        return out.otherwise(F.lit(0))

    return F.transform(values, flag)


def strides(shape: list[int]) -> list[int]:
    """How far apart neighbours along each axis are in an array that has its last axis' elements side by side."""
    out = [1] * len(shape)
    for k in range(len(shape) - 1, 0, -1):
        out[k - 1] = out[k] * shape[k]
    return out


def place(index: Column, shape: list[int]) -> list[Column]:
    """The place along each axis of an element, by its index in such an array."""
    return [(F.floor(index / step) % n).cast("int") for step, n in zip(strides(shape), shape)]


def delta_arrays(rows: DataFrame, series: list[str], order: list[str], value: str, qc: str, shape: list[int], deltas: list[float], flags: list[int], chunk: float, *, bad: int = 7, before: DataFrame | None = None) -> DataFrame:
    """Sets flags where elements of arrays differ from those before them, along the order of the rows and along each axis, by more than the axis' delta.

    The arrays of ``value``, and those of flags in ``qc``, hold ``shape`` elements of one record, the last axis' side by side. The first delta is for the row before in its
    series (or the last of ``before``, with the same columns), the next are for the axes of the shape; 0, or none, leaves an axis alone. Elements with a flag of ``bad`` are neither
    judged nor compared with; arrays of another length than the shape's keep their flags. All axes are judged in one pass over an array.
    """
    deltas = [*deltas, *[0.0] * (len(shape) + 1 - len(deltas))]
    flags = [*flags, *[0] * (len(deltas) - len(flags))]
    steps, length, columns = strides(shape), math.prod(shape), rows.columns
    if deltas[0] > 0:
        if before is not None:
            rows = rows.withColumn("_earlier", F.lit(False)).unionByName(before.select(*columns).withColumn("_earlier", F.lit(True)))
        rows = previous(rows, series, order, [value, qc], "_before", chunk)
        rows = rows.where("not _earlier").drop("_earlier") if before is not None else rows
    own, held = F.col(value), F.col(qc)

    def judged(x: Column, i: Column) -> Column:
        known, mark = F.get(held, i), F.lit(0)
        free = lambda of: (F.coalesce(of, F.lit(0)).bitwiseAND(F.lit(bad)) == 0)
        for axis, (delta, own_flag) in enumerate(zip(deltas, flags)):
            if delta <= 0:
                continue
            if axis == 0:
                last, last_flag, there = F.get(F.col(f"_before.{value}"), i), F.get(F.col(f"_before.{qc}"), i), F.col("_before").isNotNull()
            else:
                at = i - F.lit(steps[axis - 1])
                there = place(i, shape)[axis - 1] > 0
                last, last_flag = (F.get(c, F.greatest(at, F.lit(0))) for c in (own, held))
            jump = there & free(known) & free(last_flag) & (F.abs(x - last) > delta)
            mark = mark.bitwiseOR(F.when(jump, F.lit(own_flag)).otherwise(F.lit(0)))
        return F.coalesce(known, F.lit(0)).bitwiseOR(mark)

    found = F.when((F.size(own) == length) & (F.size(held) == length), F.transform(own, judged)).otherwise(held)
    return rows.withColumn(qc, found).select(*columns)


def nan_to_missing(value: Column, missing: float | None) -> Column:
    """Values that aren't finite become the missing value; they stay if there is none."""
    return value if missing is None else F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(missing)).otherwise(value)


@dataclass(frozen=True)
class Shade:
    """A rectangle of the sky in degrees; az_min > az_max goes through north."""

    az_min: float
    az_max: float
    el_min: float
    el_max: float


def shaded(azimuth: Column, elevation: Column, shades: list[Shade]) -> Column:
    """Whether the sun stands in any of the rectangles, edges included."""
    out = F.lit(False)
    for s in shades:
        across = (azimuth >= s.az_min) & (azimuth <= s.az_max) if s.az_min <= s.az_max else (azimuth >= s.az_min) | (azimuth <= s.az_max)
        out = out | (across & (elevation >= s.el_min) & (elevation <= s.el_max))
    return out


def shaded_between(azimuth: tuple[Column, Column], elevation: tuple[Column, Column], shades: list[Shade]) -> Column:
    """Whether the way of the sun over a sample's cell, from first to last place, touches any of the rectangles.

    Azimuth and elevation are taken as closed intervals; an azimuth interval whose first end is the larger goes through north.
    """
    first, last = azimuth
    low, high = F.least(*elevation), F.greatest(*elevation)
    out = F.lit(False)
    for s in shades:
        # an interval through north is two intervals
        theirs = [(s.az_min, s.az_max)] if s.az_min <= s.az_max else [(s.az_min, 360.0), (0.0, s.az_max)]
        across = F.lit(False)
        for a, b in theirs:
            whole = (first <= b) & (last >= a)
            split = (F.lit(360.0) >= a) & (first <= b) | (last >= a) & (F.lit(0.0) <= b)
            across = across | F.when(first <= last, whole).otherwise(split)
        out = out | (across & (low <= s.el_max) & (high >= s.el_min))
    return out


def with_reports(rows: DataFrame, reports: DataFrame, keys: list[str], coord: str, bucket: float) -> DataFrame:
    """Rows joined with the quality reports (keys, report, code, start, end) that cover them, ends included: a bucketed range join."""
    spread = reports.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    placed = rows.withColumn("_b", F.floor(F.col(coord) / bucket))
    return placed.join(spread, [*keys, "_b"]).where((F.col(coord) >= F.col("start")) & (F.col(coord) <= F.col("end"))).drop("_b")
