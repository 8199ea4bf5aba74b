"""Working on datasets by variable: what user code does between retrieval and output."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import bits, metadata, units


def variables_exist(rows: DataFrame, names: list[str]) -> dict[str, bool]:
    return {n: n in rows.columns for n in names}


def add_variable(rows: DataFrame, name: str, value: Column | None, kind: str = "double", **attributes) -> DataFrame:
    """A new column with attributes; without a value it is null."""
    column = F.lit(None) if value is None else value
    return rows.withColumn(name, column.cast(kind).alias(name, metadata={k: v for k, v in attributes.items() if v is not None}))


def add_qc_variable(rows: DataFrame, name: str) -> DataFrame:
    return rows if f"qc_{name}" in rows.columns else rows.withColumn(f"qc_{name}", F.lit(0))


def record_qc_results(rows: DataFrame, name: str, bit: int, test: Column, assessment: str = "Bad", description: str | None = None) -> DataFrame:
    """Sets a bit where the test holds and notes what it means."""
    rows = add_qc_variable(rows, name)
    held = metadata.attributes(rows, f"qc_{name}")
    held |= {f"bit_{bit}_assessment": assessment} | ({f"bit_{bit}_description": description} if description else {})
    return rows.withColumn(f"qc_{name}", bits.record(F.col(f"qc_{name}"), bit, test).alias(f"qc_{name}", metadata=held))


def convert_units(rows: DataFrame, source: str, target: str, only: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """All columns whose units attribute is ``source``, and their limits, in another unit; missing values stay."""
    out = rows
    for f in rows.schema:
        held = dict(f.metadata)
        if held.get("units") != source or f.name in exclude or (only is not None and f.name not in only):
            continue
        said = held.get("missing_value", [])
        missing = said if isinstance(said, list) else [said]
        column = units.convert(F.col(f.name).cast("double"), source, target, missing=missing)
        out = out.withColumn(f.name, column.alias(f.name, metadata=metadata.in_unit(held, target)))
    return out


def drop_transform_metadata(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.drop(*[c for n in names for c in metadata.companions(rows, n)])


def union_observations(parts: list[DataFrame]) -> DataFrame:
    """Observations one after another; they must have the same columns and types."""
    first = [(f.name, f.dataType) for f in parts[0].schema]
    out = parts[0]
    for part in parts[1:]:
        if sorted((f.name, str(f.dataType)) for f in part.schema) != sorted((n, str(t)) for n, t in first):
            raise ValueError("observations with different columns can't be merged")
        out = out.unionByName(part)
    return out


@dataclass
class SchemaRegistry:
    """Versions of output schemas by dataset, each valid from a time on."""

    versions: dict[str, list[tuple[int, str, T.StructType]]] = field(default_factory=dict)

    def add(self, dataset: str, valid_from: int, version: str, schema: T.StructType) -> None:
        held = self.versions.setdefault(dataset, [])
        held.append((valid_from, version, schema))
        held.sort(key=lambda v: v[0])

    def at(self, dataset: str, time: int) -> tuple[str, T.StructType]:
        found = [v for v in self.versions.get(dataset, []) if v[0] <= time]
        if not found:
            raise ValueError(f"no schema of {dataset!r} is valid at {time}")
        return found[-1][1:]

    def conform(self, rows: DataFrame, dataset: str, time: int) -> DataFrame:
        """Columns in the schema's order and types; absent ones are null, others are left out."""
        _, schema = self.at(dataset, time)
        out = []
        for f in schema:
            column = F.col(f.name) if f.name in rows.columns else F.lit(None)
            kind = f.dataType.simpleString()
            whole = {"tinyint": "byte", "smallint": "short", "int": "int", "bigint": "long"}.get(kind)
            fractional = f.name in rows.columns and isinstance(rows.schema[f.name].dataType, (T.FloatType, T.DoubleType))
            column = units.cast_rounded(column, whole) if whole and fractional else column.cast(f.dataType)
            out.append(column.alias(f.name, metadata=f.metadata))
        return rows.select(*out)
