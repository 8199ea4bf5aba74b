"""Declared retrievals: groups of prioritised sources, the variables wanted from them, and the grids they belong on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import metadata, units
from gridloom.operators import retrieve
from gridloom.plans import provenance


@dataclass
class Wanted:
    """A variable of a group: its alternate names in the sources, the unit and type it gets, and what must come with it.

    system: the coordinate system that it is transformed to; companions: whether its quality column must come too.
    """

    name: str
    names: list[str] = field(default_factory=list)
    unit: str | None = None
    kind: str | None = None
    required: bool = True
    companions: bool = False
    system: str | None = None


@dataclass
class Group:
    """Sources in order of priority, each a name and its samples, and what is wanted from the first that has it.

    keys: columns that a source has besides its variables; the source is chosen for each of their combinations, but for ``coord``.
    """

    name: str
    sources: list[tuple[str, Callable[[SparkSession], DataFrame]]]
    variables: list[Wanted]
    keys: list[str] = field(default_factory=list)
    coord: str = "t"
    begin_offset: int = 0
    end_offset: int = 0


def _column(rows: DataFrame, want: Wanted) -> dict:
    """The variable's column with its attributes, and its quality column, by the first alternate name that the source has."""
    for name in want.names or [want.name]:
        if name in rows.columns and (not want.companions or f"qc_{name}" in rows.columns):
            value, held = F.col(name), metadata.attributes(rows, name)
            if want.unit and held.get("units"):
                said = held.get("missing_value", [])
                value = units.convert(value, held["units"], want.unit, missing=said if isinstance(said, list) else [said])
                held = metadata.in_unit(held, want.unit)
            value = units.cast_rounded(value, want.kind) if want.kind in units.RANGES else value.cast(want.kind) if want.kind else value
            flags = F.coalesce(F.col(f"qc_{name}"), F.lit(0)).cast("int") if f"qc_{name}" in rows.columns else F.lit(0)
            held[provenance.SOURCE_VARIABLE] = name
            return {want.name: value.alias(want.name, metadata=held), f"qc_{want.name}": flags.alias(f"qc_{want.name}", metadata=metadata.attributes(rows, f"qc_{name}") if f"qc_{name}" in rows.columns else {})}
    return {}


def compiled(spark: SparkSession, group: Group, begin: int, end: int) -> list[tuple[str, DataFrame]]:
    """The sources of a group that have all required variables, with the wanted columns, lazily over the interval."""
    found = []
    for source, read in group.sources:
        rows = retrieve.in_interval(read(spark), group.coord, begin, end, group.begin_offset, group.end_offset)
        columns, complete = {}, True
        for want in group.variables:
            own = _column(rows, want)
            complete &= bool(own) or not want.required
            columns |= own or {want.name: F.lit(None).cast(want.kind or "double").alias(want.name), f"qc_{want.name}": F.lit(1).alias(f"qc_{want.name}")}
        if complete:
            found.append((source, rows.select(group.coord, *group.keys, *columns.values())))
    return found


def retrieve_group(spark: SparkSession, group: Group, begin: int, end: int) -> DataFrame:
    """(coord, keys, variables, their qc_ columns, source): for each combination of the keys all samples of the first source that has a value of
    every required variable in the interval. Raises ValueError if no source has the required variables at all.
    """
    found = compiled(spark, group, begin, end)
    if not found:
        raise ValueError(f"no source of {group.name!r} has {[w.name for w in group.variables if w.required]}")
    tagged = None
    for k, (source, rows) in enumerate(found):
        rows = rows.withColumns({"_rank": F.lit(k), "source": F.lit(source)})
        tagged = rows if tagged is None else tagged.unionByName(rows)
    needed = [w.name for w in group.variables if w.required] or [w.name for w in group.variables]
    has = tagged.groupBy(*group.keys, "_rank").agg(*[F.count(c).alias(f"_n{k}") for k, c in enumerate(needed)])
    best = has.where(" and ".join(f"_n{k} > 0" for k in range(len(needed)))).groupBy(*group.keys).agg(F.min("_rank").alias("_rank"))
    chosen = tagged.join(best, [*group.keys, "_rank"], "left_semi").select(*[c for c in tagged.columns if c != "_rank"])
    # attributes are those of the first source that has the variable
    for want in group.variables:
        having = [(source, rows) for source, rows in found if provenance.source_variable(rows, want.name)]
        if having:
            held = metadata.attributes(having[0][1], want.name)
            chosen = chosen.withMetadata(want.name, {**held, provenance.SOURCE_DATASET: ", ".join(source for source, _ in having)})
    return chosen


def by_system(rows: DataFrame, group: Group) -> dict[str | None, DataFrame]:
    """The variables of a retrieved group by the coordinate system that they belong on (None: their own)."""
    out: dict[str | None, list[str]] = {}
    for want in group.variables:
        out.setdefault(want.system, []).append(want.name)
    return {s: rows.select(group.coord, *group.keys, "source", *[c for n in names for c in (n, f"qc_{n}")]) for s, names in out.items()}
