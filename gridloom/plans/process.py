"""A data process: retrieve, merge, transform, map and store, with hooks between the steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import bits, metadata
from gridloom.operators import mapping, qc, retrieve
from gridloom.sources import store

DAY = 86_400_000_000


@dataclass
class Input:
    """Prioritised sources of one dataset; each gives its samples (t in microseconds) lazily."""

    sources: list[Callable[[SparkSession], DataFrame]]
    begin_offset: int = 0
    end_offset: int = 0
    groups: list[str] = field(default_factory=list)
    value: str | None = None


@dataclass
class Output:
    path: str
    keys: list[str]
    targets: list[mapping.Target]
    split_mode: str = "days"
    split_interval: int = 1
    split_start: int = 0
    tz_hours: float = 0.0
    dynamic: bool = False
    fmt: str = "parquet"
    #: Rows that repeat all columns go; of those that repeat the keys only, the job fails unless told to keep the ``first`` by the other columns.
    duplicates: str = "fail"
    #: Whether limits among the variables' attributes set quality bits before rows are stored.
    standard_checks: bool = False
    #: The keys that tell series apart, within which steps of samples are judged; other keys only settle their order.
    series: list[str] = field(default_factory=list)
    #: Whether steps are taken from the last stored sample too, so that results don't depend on how the time is cut into intervals.
    prior_sample: bool = True
    #: Whether values that aren't finite become the variable's missing value, or null where it has none.
    filter_nans: bool = False
    #: Variables that standard checks leave alone.
    unchecked: list[str] = field(default_factory=list)
    #: Rows at or before this time, or after ``latest``, aren't stored (microseconds; None: no limit).
    earliest: int | None = None
    latest: int | None = None


class Process:
    """Subclass it and override hooks; datasets are DataFrames by name in inputs, transformed and outputs."""

    def __init__(self, spark: SparkSession, inputs: dict[str, Input], outputs: dict[str, Output]):
        self.spark, self.input_specs, self.output_specs = spark, inputs, outputs
        self.inputs: dict[str, DataFrame] = {}
        self.transformed: dict[str, DataFrame] = {}
        self.outputs: dict[str, DataFrame] = {}
        self.shift = 0
        self.interval = (0, 0)

    # hooks, in the order they are called
    def init_process_hook(self) -> None: ...
    def pre_retrieval_hook(self, begin: int, end: int) -> None: ...
    def post_retrieval_hook(self, begin: int, end: int) -> None: ...
    def pre_transform_hook(self, begin: int, end: int) -> None: ...
    def transform_hook(self, begin: int, end: int) -> None:
        self.transformed = dict(self.inputs)

    def post_transform_hook(self, begin: int, end: int) -> None: ...
    def process_data_hook(self, begin: int, end: int) -> None: ...
    def quality_hook(self, name: str, rows: DataFrame) -> DataFrame:
        return rows

    def quicklook_hook(self, begin: int, end: int) -> None: ...
    def finish_process_hook(self) -> None: ...

    def set_time_offsets(self, name: str, begin_offset: int, end_offset: int) -> None:
        self.input_specs[name].begin_offset, self.input_specs[name].end_offset = begin_offset, end_offset

    def shift_processing_interval(self, seconds: float) -> None:
        self.shift = int(seconds * 1_000_000)

    def retrieve(self, begin: int, end: int) -> None:
        for name, spec in self.input_specs.items():
            found = [retrieve.in_interval(s(self.spark), "t", begin, end, spec.begin_offset, spec.end_offset) for s in spec.sources]
            self.inputs[name] = retrieve.prioritised(found, spec.groups, spec.value) if len(found) > 1 else found[0]

    def find_variable(self, name: str) -> str | None:
        """The first input dataset that has a variable."""
        return next((k for k, rows in self.inputs.items() if name in rows.columns), None)

    def map_outputs(self, begin: int, end: int) -> None:
        for name, spec in self.output_specs.items():
            rows = self.transformed.get(name)
            if rows is not None:
                rows = rows.where((F.col("t") >= begin) & (F.col("t") < end))
                self.outputs[name] = mapping.map_outputs(rows, spec.keys, spec.targets, dynamic=spec.dynamic)

    def filtered(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows that are stored: without repeated ones, checked, through quality_hook(), and with valid times."""
        spec = self.output_specs[name]
        attributes = {c: metadata.attributes(rows, c) for c in rows.columns}
        others = [c for c in rows.columns if c not in spec.keys]
        if spec.filter_nans:
            floats = [c for c in others if rows.schema[c].dataType.simpleString() in ("float", "double")]
            missing = {c: next(iter(attributes[c].get(a) for a in ("missing_value", "_FillValue") if a in attributes[c]), None) for c in floats}
            missing = {c: x[0] if isinstance(x, list) else x for c, x in missing.items()}
            rows = rows.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(missing[c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in floats})
        # one shuffle by the keys: rows that repeat all columns are one distinct struct
        row = F.struct(*others)
        if not others:
            rows = rows.dropDuplicates()
        elif spec.duplicates == "first":
            rows = rows.groupBy(*spec.keys).agg(F.min(row).alias("_row")).select(*spec.keys, *[F.col(f"_row.`{c}`").alias(c) for c in others])
        else:
            failing = F.raise_error(F.concat(F.lit(f"{name}: samples with the same keys differ: "), F.to_json(F.struct(*spec.keys))))
            counted = rows.groupBy(*spec.keys).agg(F.min(row).alias("_row"), F.max(row).alias("_other"))
            one = F.col("_row").eqNullSafe(F.col("_other"))
            rows = counted.select(*spec.keys, *[F.when(one, F.col(f"_row.`{c}`")).otherwise(failing.cast(rows.schema[c].dataType)).alias(c) for c in others])
        for c, held in attributes.items():
            rows = rows.withMetadata(c, held)
        if spec.standard_checks:
            limits = [f"{k}_{w}" for k in ("valid", "warn", "fail") for w in ("min", "max", "delta")]
            checked = [c for c in others if c not in spec.unchecked and any(attributes[c].get(x) is not None for x in limits)]
            order = ["t", *[k for k in spec.keys if k != "t" and k not in spec.series]]
            stepped = [c for c in checked if any(attributes[c].get(f"{k}_delta") for k in ("valid", "warn", "fail"))]
            before = self.prior(spec, rows, order, stepped) if stepped and spec.prior_sample else None
            rows = qc.standard_checks(rows, checked, spec.series, order, DAY, before)
        rows = self.quality_hook(name, rows)
        if spec.earliest is not None:
            rows = rows.where(F.col("t") > spec.earliest)
        return rows if spec.latest is None else rows.where(F.col("t") <= spec.latest)

    def prior(self, spec: Output, rows: DataFrame, order: list[str], variables: list[str]) -> DataFrame | None:
        """The last stored sample before the interval, of each series that has rows now, with the quality that it was stored with."""
        series = rows.select(*spec.series).distinct() if spec.series else None
        columns = [*spec.series, *order, *[c for v in variables for c in (v, f"qc_{v}")]]
        return store.last_before(self.spark, spec.path, self.interval[0], series, order, columns, fmt=spec.fmt)

    def store(self) -> None:
        for name, rows in self.outputs.items():
            spec = self.output_specs[name]
            rows = self.filtered(name, rows)
            store.replace(rows, spec.path, *self.interval, mode=spec.split_mode, interval=spec.split_interval, start=spec.split_start, tz_hours=spec.tz_hours, fmt=spec.fmt)

    def run_interval(self, begin: int, end: int) -> None:
        begin, end = begin + self.shift, end + self.shift
        self.interval = begin, end
        self.inputs, self.transformed, self.outputs = {}, {}, {}
        self.pre_retrieval_hook(begin, end)
        self.retrieve(begin, end)
        self.post_retrieval_hook(begin, end)
        self.pre_transform_hook(begin, end)
        self.transform_hook(begin, end)
        self.post_transform_hook(begin, end)
        self.map_outputs(begin, end)
        self.process_data_hook(begin, end)
        self.store()
        self.quicklook_hook(begin, end)

    def run(self, begin: int, end: int, interval: int = DAY) -> int:
        """Runs every whole interval, or the partial one if it is the first; returns how many ran."""
        self.init_process_hook()
        n = 0
        for a, b in intervals(begin, end, interval):
            self.run_interval(a, b)
            n += 1
        self.finish_process_hook()
        return n


def intervals(begin: int, end: int, interval: int) -> Iterator[tuple[int, int]]:
    at = begin
    while at + interval <= end:
        yield at, at + interval
        at += interval
    if at == begin < end:
        yield begin, end


def observation_intervals(files: list[tuple[int, int]], begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Intervals of the observation loop: the extent of the next file after the one before, of files that begin together the longest."""
    at = begin
    for first, last in sorted(files, key=lambda f: (f[0], -f[1])):
        if at <= first < end:
            yield first, last
            at = last + 1


def real_time_end(latest: dict[str, int], now: int, begin: int, interval: int, max_wait: int = 3 * DAY, end_offsets: dict[str, int] | None = None) -> int | None:
    """End of the interval to process: the earliest of the inputs' latest times that aren't older than max_wait, else the newest.

    Floored to whole intervals from begin; None means wait.
    """
    offsets = end_offsets or {}
    usable = [min(t, now) - offsets.get(k, 0) for k, t in latest.items()]
    if not usable:
        return None
    fresh = [t for t in usable if t > now - max_wait]
    newest = min(fresh) if fresh else max(usable)
    end = begin + (newest - begin) // interval * interval
    return end if end > begin else None


def add_quality(rows: DataFrame, name: str, *tests) -> DataFrame:
    """Adds or extends qc_<name>: tests are (bit, Column)."""
    flags = F.col(f"qc_{name}") if f"qc_{name}" in rows.columns else F.lit(0)
    for bit, test in tests:
        flags = bits.record(flags, bit, test)
    return rows.withColumn(f"qc_{name}", flags)
