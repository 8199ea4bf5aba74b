"""Repeated and overlapping samples and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.chunks import carried


def mark_overlaps(rows: DataFrame, series: list[str], coord: str, arrival: str, data: list[str], chunk: float) -> DataFrame:
    """Adds overlap: how a sample that arrives at or before the latest time so far relates to earlier arrivals.

    duplicate: an earlier one has its time and data; conflict: its time, other data; shift: none has its time; none: not late.
    """
    # the running maximum of the time over arrivals, chunk by chunk
    placed = rows.withColumn("_c", F.floor(F.col(arrival) / F.lit(chunk)))
    own = Window.partitionBy(*series, "_c").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy(*series, "_c").agg(F.max(coord).alias("_top"))
    tops = tops.withColumn("_carry", F.max("_top").over(Window.partitionBy(*series).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    placed = placed.withColumn("_own", F.max(coord).over(own)).join(tops, [*series, "_c"], "left")
    latest = F.greatest("_own", "_carry")
    same_time = Window.partitionBy(*series, coord).orderBy(arrival)
    same_data = Window.partitionBy(*series, coord, *data).orderBy(arrival)
    placed = placed.withColumns({"_late": F.coalesce(F.col(coord) <= latest, F.lit(False)), "_k": F.row_number().over(same_time), "_d": F.row_number().over(same_data)})
    kind = F.when(~F.col("_late"), "none").when(F.col("_d") > 1, "duplicate").when(F.col("_k") > 1, "conflict").otherwise("shift")
    return placed.withColumn("overlap", kind).drop("_c", "_own", "_carry", "_late", "_k", "_d")


def drop_overlaps(rows: DataFrame, series: list[str], coord: str, arrival: str, data: list[str], chunk: float, *, allow: set[str] = frozenset({"duplicate"})) -> DataFrame:
    """Keeps the first arrival. Overlaps of kinds outside ``allow`` make the job fail."""
    marked = mark_overlaps(rows, series, coord, arrival, data, chunk)
    refused = [k for k in ("duplicate", "conflict", "shift") if k not in allow]
    failing = F.raise_error(F.concat(F.lit("overlapping samples: "), F.col("overlap"))).cast("boolean")
    keep = F.when(F.col("overlap").isin(*refused), failing).otherwise(F.col("overlap") == "none") if refused else F.col("overlap") == "none"
    return marked.where(keep).drop("overlap")


def drop_exact_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropDuplicates(keys)


def not_stored(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that aren't in the stored data; null equals null."""
    old = stored.select(*[F.col(k).alias(f"_o_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return rows.join(old, same, "left_anti")


def observation_extents(rows: DataFrame, keys: list[str], coord: str) -> DataFrame:
    """(keys, obs_id, start, end, n, created) of each observation (rows have obs_id and created)."""
    return rows.groupBy(*keys, "obs_id").agg(F.min(coord).alias("start"), F.max(coord).alias("end"), F.count("*").alias("n"), F.max("created").alias("created"))


def choose_observations(extents: DataFrame, keys: list[str]) -> DataFrame:
    """Extents with kept: whether an observation survives against its neighbours in time.

    Two observations overlap if the later starts at or before the earlier one's end. The newer one stays if it has at least
    three quarters of the other's samples; one without a creation time loses against one with; of two without, the longer stays,
    or the second of equals.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end", "obs_id")
    pair = extents.withColumns({f"_{way}": f(F.struct("start", "end", "n", "created")).over(order) for way, f in (("p", F.lag), ("q", F.lead))})

    def second_wins(first: dict, second: dict):
        newer = second["created"] > first["created"]
        return (
            F.when(first["created"].isNull() & second["created"].isNull(), second["n"] >= first["n"])
            .when(first["created"].isNull(), F.lit(True))
            .when(second["created"].isNull(), F.lit(False))
            .when(newer, second["n"] >= 0.75 * first["n"])
            .otherwise(~(first["n"] >= 0.75 * second["n"]))
        )

    fields = ("start", "end", "n", "created")
    own = {c: F.col(c) for c in fields}
    before, after = ({c: F.col(f"_{w}.{c}") for c in fields} for w in ("p", "q"))
    loses_left = F.coalesce((own["start"] <= before["end"]) & ~second_wins(before, own), F.lit(False))
    loses_right = F.coalesce((after["start"] <= own["end"]) & second_wins(own, after), F.lit(False))
    return pair.withColumn("kept", ~loses_left & ~loses_right).drop("_p", "_q")


def merge_observations(rows: DataFrame, keys: list[str], coord: str) -> DataFrame:
    """The rows of the observations that are kept."""
    kept = choose_observations(observation_extents(rows, keys, coord), keys).where("kept").select(*keys, "obs_id")
    return rows.join(kept, [*keys, "obs_id"], "left_semi")


def latest_before(rows: DataFrame, series: list[str], order: list[str], columns: list[str], out: str, chunk: float) -> DataFrame:
    return carried(rows, series, order, F.struct(*columns), out, chunk, inclusive=False)
