"""The same operators over streams of samples: rows with ts (timestamp), series columns, value and qc."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bits
from gridloom.operators import chunks
from gridloom.operators.chunks import DAY

MAX_WAIT = "72 hours"


def averages(stream: DataFrame, series: list[str], width: str, *, slide: str | None = None, start: str | None = None, max_wait: str = MAX_WAIT, mask: int = 1) -> DataFrame:
    """Averages, population deviations and coverage of tumbling or sliding windows, final once the watermark has passed."""
    value, qc = F.col("value"), F.coalesce(F.col("qc"), F.lit(0))
    good = bits.is_good(value, qc, mask)
    x = F.when(good, value)
    out = stream.withWatermark("ts", max_wait).groupBy(F.window("ts", width, slide, start), *series)
    out = out.agg(F.avg(x).alias("value"), F.stddev_pop(x).alias("value_std"), (F.count(x) / F.count("*")).alias("value_goodfraction"), F.bit_or(F.when(good, qc).otherwise(0)).alias("_qc"), F.max(F.when(good, 0).otherwise(1)).alias("_bad"))
    flags = bits.either(bits.bit_if(F.col("value").isNull(), bits.ALL_BAD | bits.BAD), bits.bit_if(F.col("_bad") == 1, bits.SOME_BAD), bits.bit_if(F.col("_qc").bitwiseAND(F.lit(~mask)) != 0, bits.INDETERMINATE))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *series, "value", "value_std", "value_goodfraction", flags.alias("qc"))


def distinct_samples(stream: DataFrame, keys: list[str], max_wait: str = MAX_WAIT) -> DataFrame:
    """Drops samples that repeat the keys within the watermark."""
    return stream.withWatermark("ts", max_wait).dropDuplicatesWithinWatermark(keys)


def step_checks(
    batch: DataFrame, before: DataFrame, series: list[str], *, ties: list[str] = (), chunk: int = DAY, most_delta: float, least_step: float = 0.0, most_step: float = float("inf"),
    delta_flag: int = 8, step_flags: tuple[int, int, int] = (16, 32, 64), bad: int = 7,
) -> DataFrame:
    """Delta and time-step flags of one batch against the sample before, in order of time (then ``ties``) within the batch.

    before: (series, t, value, qc), the last sample of each series in earlier batches; a batch's first sample is judged against it, even if it is the later one.
    No series is gathered in one task, so a batch may be of any size and in any order of rows.
    """
    rows = batch.select(*series, "ts", *ties, "value", F.coalesce(F.col("qc"), F.lit(0)).cast("int").alias("qc"), F.unix_micros("ts").alias("_t"))
    rows = chunks.previous(rows, series, ["_t", *ties], ["_t", "value", "qc"], "_own", chunk)
    known = before.select(*[F.col(c).alias(f"_s_{c}") for c in series], F.struct(F.col("t").alias("_t"), "value", "qc").alias("_known"))
    rows = rows.join(known, functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in series]), "left")
    rows = rows.withColumn("_last", F.coalesce("_own", "_known"))
    step = (F.col("_t") - F.col("_last._t")) / 1e6
    flag = F.when(step <= 0, step_flags[0]).when(step < least_step, step_flags[1]).when(step > most_step, step_flags[2]).otherwise(0)
    fair = (F.col("qc").bitwiseAND(F.lit(bad)) == 0) & (F.col("_last.qc").bitwiseAND(F.lit(bad)) == 0)
    jump = fair & (F.abs(F.col("value") - F.col("_last.value")) > most_delta) & F.lit(most_delta > 0)
    return rows.select(*series, "ts", *ties, "value", bits.either(F.col("qc"), flag, bits.bit_if(F.coalesce(jump, F.lit(False)), delta_flag)).cast("int").alias("qc"))


def last_samples(batch: DataFrame, before: DataFrame, series: list[str], ties: list[str] = ()) -> DataFrame:
    """(series, t, value, qc): the last sample of each series in the batch, or in earlier ones where the batch has none."""
    rows = batch.select(*series, F.unix_micros("ts").alias("t"), "value", F.coalesce(F.col("qc"), F.lit(0)).cast("int").alias("qc"), F.struct(F.lit(1).alias("new"), F.unix_micros("ts").alias("t"), *ties).alias("_o"))
    older = before.select(*series, "t", "value", "qc", F.struct(F.lit(0).alias("new"), "t", *[F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in ties]).alias("_o"))
    return rows.unionByName(older).groupBy(*series).agg(F.max_by(F.struct("t", "value", "qc"), "_o").alias("x")).select(*series, "x.*")


def start_step_checks(stream: DataFrame, series: list[str], write: Callable[[DataFrame, int], None], state: str, checkpoint: str, *, ties: list[str] = (), available_now: bool = True, **limits):
    """Starts a stream that flags steps and deltas across its batches.

    The last sample of each series goes from batch to batch as a small table in the folder ``state``. A batch writes the slot that
    the next one reads, and leaves its own alone, so a batch that is run again finds what it found before.
    """

    def act(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            if n == 0:
                fields = ", ".join(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in series)
                before = batch.sparkSession.createDataFrame([], f"{fields}, t long, value double, qc int")
            else:
                before = batch.sparkSession.read.parquet(f"{state}/{(n - 1) % 2}")
            write(step_checks(batch, before, series, ties=ties, **limits), n)
            last_samples(batch, before, series, ties).write.mode("overwrite").parquet(f"{state}/{n % 2}")
        finally:
            batch.unpersist()

    return sink(stream, act, checkpoint, available_now=available_now)


def sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = True):
    """Starts the stream; every micro-batch goes to ``write`` with its number, which makes repeated writes recognisable."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its number, so that one that runs again replaces what it wrote."""
    return lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
