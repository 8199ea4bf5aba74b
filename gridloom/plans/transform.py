"""The transform of a variable onto target grids, one dimension after another, with the method by parameter or by intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bits
from gridloom.operators import bin_average, chunks, grid, nearest
from gridloom.plans import provenance
from gridloom.plans.params import Params

#: Transforms that users add by name; they come before the built-in ones.
REGISTERED: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, act: Callable[..., DataFrame]) -> None:
    REGISTERED[name] = act


def choose(input_interval: float | None, output_interval: float | None) -> str:
    """Averaging onto a coarser grid, interpolation onto any other; no coordinates: pass-through."""
    if input_interval is None or output_interval is None:
        return "passthrough"
    return "bin_average" if output_interval > input_interval else "interpolate"


def transform(
    rows: DataFrame, targets: DataFrame, series: list[str], method: str, *, chunk: float, width: float | None = None, alignment: float = 0.5, reach: float | None = None, mask: int = 1,
    bad_codes: list[int] | None = None, limits: bin_average.Limits = bin_average.Limits(),
) -> DataFrame:
    """Rows (series, coord, value, qc) onto targets (series, bin, coord): (series, bin, coord, value, metrics, qc)."""
    if method == "multi_dimensional":
        raise ValueError("only one dimension is transformed at a time")
    if bad_codes is not None:
        rows = rows.withColumn("qc", bits.map_codes(F.col("qc"), bad_codes))
    if method in REGISTERED:
        return REGISTERED[method](rows, targets, series)
    if method == "bin_average":
        if not width:
            raise ValueError("bins need a width")
        cells = rows.withColumns({"lo": F.col("coord").cast("double"), "hi": F.col("coord").cast("double")})
        bins = grid.with_width(targets, "coord", width, alignment)
        found = bin_average.average_cells(cells, bins, series, width, mask=mask, limits=limits)
        return found.join(targets, [*series, "bin"]).drop("lo", "hi")
    if method == "interpolate":
        return nearest.interpolate(rows, targets, series, chunk, reach=reach, mask=mask)
    if method == "subsample":
        return nearest.subsample(rows, targets, series, chunk, reach=reach, mask=mask)
    if method == "passthrough":
        return rows
    raise ValueError(f"no transform is named {method!r}")


def target_grid(rows: DataFrame, series: list[str], params: Params, obj: str, dim: str, chunk: float, mapped: DataFrame | None = None) -> DataFrame:
    """The grid (series, bin, coord) of a dimension. The first of these that there is counts: a mapped coordinate variable (bin, coord, and series columns if
    they differ), the parameter values, the parameter interval (with start and length, else the extent of the data), the coordinates of the data.
    """
    find = lambda name, kind: params.for_dimension(obj, dim, name, kind)
    listed = find("values", float)
    if mapped is None and listed is not None:
        mapped = grid.from_values(rows.sparkSession, listed if isinstance(listed, list) else [listed])
    if mapped is not None:
        missing = [s for s in series if s not in mapped.columns]
        return _for_all(rows, mapped, missing) if missing else mapped.select(*series, "bin", "coord")
    interval, start, length = find("interval", float), find("start", float), find("length", int)
    if interval is None:
        known = rows.select(*series, "coord").where("coord is not null").distinct()
        return chunks.running_sum(known, series, ["coord"], F.lit(1), "_n", chunk).select(*series, (F.col("_n") - 1).alias("bin"), "coord")
    whole = float(interval).is_integer() and (start is None or float(start).is_integer())
    number = (lambda x: int(x)) if whole else float
    if length is not None and start is not None:
        return _for_all(rows, grid.regular(rows.sparkSession, number(start), number(interval), length), series)
    found = grid.per_series(rows, series, "coord", number(interval), None if start is None else F.lit(number(start)))
    return found if length is None else found.where(F.col("bin") < length)


def by_parameters(rows: DataFrame, series: list[str], params: Params, obj: str, dim: str, *, chunk: float, mapped: DataFrame | None = None, default_width: bool = True) -> DataFrame:
    """Rows (series, coord, value, qc) onto the grid that parameters describe, by the method that they name or that the intervals suggest.

    Looked up for the object and dimension: transform, width (default: interval), alignment, range, qc_mask, qc_bad, std_bad_max, std_ind_max,
    goodfrac_bad_min, goodfrac_ind_min, and what target_grid() reads. The column value keeps its attributes; cell_transform says what was done.
    Without ``default_width``, averages need a width among the parameters.
    """
    find = lambda name, kind, default=None: params.for_dimension(obj, dim, name, kind, default)
    targets = target_grid(rows, series, params, obj, dim, chunk, mapped)
    method, interval = find("transform", str), find("interval", float)
    if method is None:
        # the middle of the series' sampling intervals is one number
        steps = grid.sampling_interval(rows, series, "coord", chunk).agg(F.median("interval")).first()[0]
        method = choose(steps, interval)
    limits = {name: v for name in ("std_bad_max", "std_ind_max", "goodfrac_bad_min", "goodfrac_ind_min") if (v := find(name, float)) is not None}
    codes, width, alignment, reach, mask = find("qc_bad", int), find("width", float, interval if default_width else None), find("alignment", float, 0.5), find("range", float), find("qc_mask", int, 1)
    codes = codes if codes is None or isinstance(codes, list) else [codes]
    found = transform(rows, targets, series, method, chunk=chunk, width=width, alignment=alignment, reach=reach, mask=mask, bad_codes=codes, limits=bin_average.Limits(**limits))
    if method == "passthrough" or "value" not in found.columns:
        return provenance.kept(rows, found, ["value"])
    # what the method made use of
    used = {"bin_average": {"width": width, "alignment": alignment, **limits}, "interpolate": {"range": reach}, "subsample": {"range": reach}}.get(method, {})
    return provenance.transformed(rows, found, "value", provenance.transform_text(dim, method, **used, qc_bad=codes))


def serial(rows: DataFrame, steps: list[dict], keys: list[str]) -> DataFrame:
    """Transforms several dimensions one after another: each step names its ``dim`` (a column) and has transform()'s arguments.

    While one dimension is transformed, all other keys make up the series; the output of a step is the input of the next.
    """
    for step in steps:
        step, before = dict(step), rows
        dim = step.pop("dim")
        series = [k for k in keys if k != dim]
        targets = step.pop("targets")
        # targets without series columns hold for every series
        missing = [s for s in series if s not in targets.columns]
        if missing:
            targets = _for_all(rows, targets, missing)
        out = transform(rows.withColumnRenamed(dim, "coord"), targets, series, chunk=step.pop("chunk"), **step)
        rows = out.withColumnRenamed("coord", dim).drop("bin")
        if "value" in rows.columns:
            said = {k: step.get(k) for k in {"bin_average": ("width", "alignment"), "interpolate": ("reach",), "subsample": ("reach",)}.get(step["method"], ())}
            rows = provenance.kept(before, rows, ["value"]) if step["method"] == "passthrough" else provenance.transformed(before, rows, "value", provenance.transform_text(dim, step["method"], **said))
    return rows


#: Grid points that one row of the join in _for_all stands for.
_PART = 4096


def _for_all(rows: DataFrame, targets: DataFrame, series: list[str]) -> DataFrame:
    """The targets for each of the series: every series takes each part of the grid, whose points are joined to it by part."""
    points = targets.select(F.col("bin").cast("long").alias("bin"), F.col("coord").cast("double").alias("coord")).withColumn("_part", F.floor(F.col("bin") / _PART))
    # two numbers come to the driver
    low, high = points.agg(F.min("_part"), F.max("_part")).first()
    parts = F.array().cast("array<long>") if low is None else F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))
    grids = points.groupBy("_part").agg(F.collect_list(F.struct("bin", "coord")).alias("_g"))
    wanted = rows.select(*series).distinct().withColumn("_part", F.explode(parts))
    return wanted.join(grids, "_part").select(*series, F.explode("_g").alias("_p")).select(*series, "_p.bin", "_p.coord")
