"""Attributes of columns: units, missing values, bounds, quality assessments. They live in the schema and follow a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.bits import mask_for
from gridloom.functions.units import FILLS, factors

METRICS = ("std", "goodfraction", "dist", "dist_1", "dist_2", "nstat", "deriv_lat", "deriv_lon")

#: Attributes that say where values come from; they follow a variable to its targets.
PROVENANCE = ("source_dataset", "source_variable", "cell_transform")

#: Type names of array datasets and the types that hold them here; unsigned ones take the next wider type.
TYPES = {
    "char": T.StringType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "ubyte": T.ShortType(), "ushort": T.IntegerType(), "uint": T.LongType(),
    "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "string": T.StringType(),
}


def attributes(rows: DataFrame, column: str) -> dict:
    return dict(rows.schema[column].metadata)


def with_attributes(rows: DataFrame, column: str, **values) -> DataFrame:
    """The column with attributes set; None removes one."""
    merged = {k: v for k, v in {**attributes(rows, column), **values}.items() if v is not None}
    return rows.withMetadata(column, merged)


def in_unit(held: dict, unit: str) -> dict:
    """Attributes of a column after its values are converted: the unit, limits and steps."""
    if not held.get("units") or held["units"] == unit:
        return {**held, "units": unit}
    scale, offset = factors(held["units"], unit)
    limits = {f"{k}_{w}": held[f"{k}_{w}"] * scale + offset for k in ("valid", "warn", "fail") for w in ("min", "max") if f"{k}_{w}" in held}
    steps = {f"{k}_delta": held[f"{k}_delta"] * scale for k in ("valid", "warn", "fail") if f"{k}_delta" in held}
    return {**held, **limits, **steps, "units": unit}


def missing_values(rows: DataFrame, column: str) -> list:
    """missing_value and _FillValue attributes, else the default fill of the type."""
    held = attributes(rows, column)
    found: list = []
    for name in ("missing_value", "_FillValue"):
        value = held.get(name, [])
        found += value if isinstance(value, list) else [value]
    return list(dict.fromkeys(found)) or [FILLS.get({"tinyint": "byte", "smallint": "short", "bigint": "long"}.get(k := rows.schema[column].dataType.simpleString(), k), "")]


def sentinels_to_null(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values become null, for the columns given or all that have such attributes."""
    chosen = columns if columns is not None else [c for c in rows.columns if {"missing_value", "_FillValue"} & attributes(rows, c).keys()]
    held = {c: attributes(rows, c) for c in chosen}
    out = rows.withColumns({c: F.when(~F.col(c).isin(*missing_values(rows, c)), F.col(c)) for c in chosen})
    for c in chosen:
        out = out.withMetadata(c, held[c])
    return out


def nulls_to_sentinel(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls become the first missing value."""
    chosen = columns if columns is not None else [c for c in rows.columns if {"missing_value", "_FillValue"} & attributes(rows, c).keys()]
    held = {c: attributes(rows, c) for c in chosen}
    out = rows.withColumns({c: F.coalesce(F.col(c), F.lit(missing_values(rows, c)[0]).cast(rows.schema[c].dataType)) for c in chosen})
    for c in chosen:
        out = out.withMetadata(c, held[c])
    return out


def qc_column(rows: DataFrame, column: str) -> str | None:
    return f"qc_{column}" if f"qc_{column}" in rows.columns else None


def bounds_column(rows: DataFrame, column: str) -> str | None:
    name = attributes(rows, column).get("bounds", f"{column}_bounds")
    return name if name in rows.columns else None


def companions(rows: DataFrame, column: str) -> list[str]:
    """Quality and metric columns that transforms add to a column."""
    return [c for c in (f"qc_{column}", f"source_{column}", *(f"{column}_{m}" for m in METRICS)) if c in rows.columns]


def assessments(rows: DataFrame, qc: str) -> dict[int, str]:
    """bit_<n>_assessment attributes of a quality column."""
    held = attributes(rows, qc)
    return {int(k.split("_")[1]): v for k, v in held.items() if k.startswith("bit_") and k.endswith("_assessment")}


def bad_mask(rows: DataFrame, column: str, bits: list[int] = (), indeterminate: bool = False) -> int:
    """Mask of the bits assessed Bad (and Indeterminate), with the given ones added."""
    held = assessments(rows, f"qc_{column}")
    mask = sum(1 << (b - 1) for b in bits)
    mask |= mask_for(held, "Bad") if held or not bits else 0
    return mask | (mask_for(held, "Indeterminate") if indeterminate else 0)


def missing_mask(rows: DataFrame, *columns: str) -> Column:
    """Whether any of the columns is null or holds one of its missing values."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull() | F.col(c).isin(*missing_values(rows, c))
    return out
