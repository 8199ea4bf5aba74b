"""Outputs: columns with names, types and units of a target, cell bounds, station views and schema comparison."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bits, units
from gridloom.functions.metadata import METRICS, PROVENANCE, in_unit


@dataclass
class Target:
    """One output column: where it comes from, and its type, unit and missing value."""

    name: str
    source: str
    kind: str | None = None
    source_unit: str | None = None
    unit: str | None = None
    missing: float | None = None
    roll_up_mask: int | None = None
    attributes: dict[str, object] = field(default_factory=dict)


def _column(t: Target, held: dict, dynamic: bool) -> Column:
    out = F.col(t.source)
    if t.source_unit and t.unit:
        out = units.convert(out, t.source_unit, t.unit)
    if t.kind in units.RANGES:
        out = units.cast_rounded(out, t.kind)
    elif t.kind:
        out = out.cast(t.kind)
    if t.missing is not None:
        out = F.coalesce(out, F.lit(t.missing).cast(t.kind) if t.kind else F.lit(t.missing))
    inherited = (in_unit(held, t.unit) if t.unit else held) if dynamic else {k: held[k] for k in PROVENANCE if k in held}
    return out.alias(t.name, metadata={**inherited, **t.attributes, **({"units": t.unit} if t.unit else {}), "source": t.source})


def map_outputs(rows: DataFrame, keys: list[str], targets: list[Target], *, dynamic: bool = False) -> DataFrame:
    """Selects the targets with their quality and metric companions.

    Where a variable comes from follows it; its other attributes do so if ``dynamic``, with those of the target before them.
    Targets whose source is absent are left out if ``dynamic``, else they are null; a target without a quality column in the input gets 0.
    """
    out = [F.col(k) for k in keys]
    for t in targets:
        if t.source not in rows.columns:
            if not dynamic:
                out += [F.lit(t.missing).cast(t.kind or "double").alias(t.name), F.lit(bits.BAD).alias(f"qc_{t.name}")]
            continue
        out.append(_column(t, dict(rows.schema[t.source].metadata), dynamic))
        qc = F.coalesce(F.col(f"qc_{t.source}"), F.lit(0)) if f"qc_{t.source}" in rows.columns else F.lit(0)
        out.append((qc if t.roll_up_mask is None else bits.roll_up(qc, t.roll_up_mask)).cast("int").alias(f"qc_{t.name}"))
        out += [F.col(f"{t.source}_{m}").alias(f"{t.name}_{m}") for m in METRICS if f"{t.source}_{m}" in rows.columns]
    return rows.select(*out)


def with_bounds(rows: DataFrame, coord: str, low: float, high: float) -> DataFrame:
    """Adds the struct <coord>_bounds with the coordinate's cell edges."""
    return rows.withColumn(f"{coord}_bounds", F.struct((F.col(coord) + F.lit(low)).alias("lo"), (F.col(coord) + F.lit(high)).alias("hi")))


def station_view(rows: DataFrame, keys: list[str], separator: str = "@") -> DataFrame:
    """Columns field@station as rows (keys, station) with a column for each field."""
    parts = [(c, *c.split(separator, 1)) for c in rows.columns if separator in c]
    fields = list(dict.fromkeys(f for _, f, _ in parts))
    stations = list(dict.fromkeys(s for *_, s in parts))
    held = {(f, s): c for c, f, s in parts}
    each = [F.struct(F.lit(s).alias("station"), *[(F.col(f"`{held[f, s]}`") if (f, s) in held else F.lit(None).cast("double")).alias(f) for f in fields]) for s in stations]
    return rows.select(*keys, F.explode(F.array(*each)).alias("_s")).select(*keys, "_s.*")


#: Attributes that change from run to run without meaning, by column (None: of any column).
EXCLUDED: dict[str | None, list[str]] = {None: ["history", "source_dataset"], "time": ["units"], "time_bounds": ["units"], "time_offset": ["units"], "base_time": ["string"]}


def compare_schemas(old: DataFrame, new: DataFrame, exclude: dict[str | None, list[str]] | None = None, ignore: list[str] = ()) -> list[tuple[str, str, str]]:
    """(column, what, detail): added, removed, type or attribute differences, in order of name.

    exclude: attributes that aren't compared, by column (None: of all columns), such as ``EXCLUDED``; ignore: columns that aren't compared.
    """
    a, b = ({f.name: f for f in x.schema if f.name not in ignore} for x in (old, new))
    exclude = exclude or {}
    out = [(c, "removed", a[c].dataType.simpleString()) for c in a if c not in b] + [(c, "added", b[c].dataType.simpleString()) for c in b if c not in a]
    for c in a.keys() & b.keys():
        if a[c].dataType != b[c].dataType:
            out.append((c, "type", f"{a[c].dataType.simpleString()} to {b[c].dataType.simpleString()}"))
        left = {*exclude.get(None, ()), *exclude.get(c, ())}
        before, after = ({k: v for k, v in x[c].metadata.items() if k not in left} for x in (a, b))
        if before != after:
            out.append((c, "attributes", f"{before} to {after}"))
    return sorted(out)
