"""Several inputs of a real-time process as streams: pairs of samples, and intervals that wait for the slowest input.

Every input has a watermark of its own. Spark takes the least of them (the session's multipleWatermarkPolicy, min unless it was changed), so an
input that lags holds back what needs it, for as long as it has anything to say, and state is kept until then and in the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.chunks import DAY

MAX_WAIT = "72 hours"
_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": DAY // 24, "day": DAY}


def duration(text: str) -> int:
    """Microseconds of a duration such as '90 minutes'."""
    n, _, unit = text.strip().partition(" ")
    try:
        return int(float(n) * _UNITS[unit.strip().rstrip("s")])
    except (KeyError, ValueError):
        raise ValueError(f"{text!r} is no duration") from None


@dataclass
class Stream:
    """An input: rows with ts and series columns; how much before an interval's begin and after its end it is wanted; how late it may be."""

    rows: DataFrame
    begin_offset: str = "0 seconds"
    end_offset: str = "0 seconds"
    max_wait: str = MAX_WAIT


def intervals(inputs: dict[str, Stream], series: list[str], width: str, measures: dict[str, dict[str, Callable[[Column], Column]]]) -> DataFrame:
    """A row for each series and interval that is complete: begin, series, and for each input its samples' number (n_<input>) and measures.

    measures: by input and column, an aggregation of the values from begin - begin_offset up to (not including) end + end_offset, as <input>_<column>. An interval
    is complete when every input has passed it by its own max_wait.
    """
    step, parts = duration(width), []
    columns = {(name, c) for name, own in measures.items() for c in own}
    for name, one in inputs.items():
        before, after = duration(one.begin_offset), duration(one.end_offset)
        t = F.unix_micros(F.col("ts"))
        # the intervals whose extended range holds the sample: begin - before <= t < begin + step + after
        first, last = F.floor((t - step - after) / step) + 1, F.floor((t + before) / step)
        slots = F.transform(F.sequence(first, last), lambda k: F.timestamp_micros((k * step).cast("long")))
        values = [(F.col(c) if name == of else F.lit(None).cast(inputs[of].rows.schema[c].dataType)).alias(f"_{of}_{c}") for of, c in sorted(columns)]
        rows = one.rows.where(F.col("ts").isNotNull()).select(F.explode(slots).alias("begin"), *series, F.lit(name).alias("_input"), *values)
        parts.append(rows.withWatermark("begin", one.max_wait))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    counts = [F.count(F.when(F.col("_input") == name, 1)).alias(f"n_{name}") for name in inputs]
    return rows.groupBy("begin", *series).agg(*counts, *[measures[name][c](F.col(f"_{name}_{c}")).alias(f"{name}_{c}") for name, c in sorted(columns)])


def paired(left: Stream, right: Stream, keys: list[str], how: str = "inner") -> DataFrame:
    """Each sample of the left input with all of the right one from begin_offset before to end_offset after it (those of ``right``), ends included.

    The right input's other columns get the prefix right_. how: inner, or left_outer, where samples without any come when none can come any more.
    """
    a = left.rows.withWatermark("ts", left.max_wait).alias("a")
    b = right.rows.select(*[F.col(c).alias(f"right_{c}") for c in right.rows.columns]).withWatermark("right_ts", right.max_wait)
    near = (F.col("right_ts") >= F.col("ts") - F.expr(f"interval {right.begin_offset}")) & (F.col("right_ts") <= F.col("ts") + F.expr(f"interval {right.end_offset}"))
    for k in keys:
        near = near & (F.col(k) == F.col(f"right_{k}"))
    return a.join(b, near, how).drop(*[f"right_{k}" for k in keys])
