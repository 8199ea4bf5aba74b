"""Where the values of a column come from: its source and the transforms that it went through, as attributes of the column.

They live in the schema, so they are written with a dataset and read with it, and cost nothing while data flow. Steps that make new columns
(groupings, tasks in Python) lose attributes; ``kept`` puts them on what such a step gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.functions import metadata

SOURCE_DATASET, SOURCE_VARIABLE, CELL_TRANSFORM = metadata.PROVENANCE


def number(value: float | int | str) -> str:
    """A parameter as text, whole numbers without a fraction."""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def transform_text(dim: str, method: str, **parameters) -> str:
    """'dim: method (name: value name: value)', of the parameters that are set."""
    said = [f"{k}: {', '.join(map(number, v)) if isinstance(v, (list, tuple)) else number(v)}" for k, v in parameters.items() if v is not None]
    return f"{dim}: {method}" + (f" ({' '.join(said)})" if said else "")


def kept(before: DataFrame, after: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``after`` with the attributes that columns of the same name have in ``before``; attributes that it has itself count first."""
    for c in columns if columns is not None else before.columns:
        if c in before.columns and c in after.columns and (held := metadata.attributes(before, c)):
            after = after.withMetadata(c, {**held, **metadata.attributes(after, c)})
    return after


def transformed(before: DataFrame, after: DataFrame, column: str, text: str) -> DataFrame:
    """``after`` with the column's attributes from ``before``, and one more transform after those that it had."""
    held = metadata.attributes(before, column)
    earlier = held.get(CELL_TRANSFORM)
    return after.withMetadata(column, {**held, **metadata.attributes(after, column), CELL_TRANSFORM: f"{earlier} {text}" if earlier else text})


def source_dataset(rows: DataFrame, column: str) -> str | None:
    """The dataset that a column was retrieved from; several possible ones in order of priority, comma-joined (the column ``source`` tells them apart by row)."""
    return metadata.attributes(rows, column).get(SOURCE_DATASET)


def source_variable(rows: DataFrame, column: str) -> str | None:
    return metadata.attributes(rows, column).get(SOURCE_VARIABLE)


def cell_transform(rows: DataFrame, column: str) -> str | None:
    return metadata.attributes(rows, column).get(CELL_TRANSFORM)


def lineage(rows: DataFrame) -> list[tuple[str, str | None, str | None, str | None]]:
    """(column, source dataset, source variable, transforms) of the columns that have any of them."""
    found = [(c, *(metadata.attributes(rows, c).get(k) for k in metadata.PROVENANCE)) for c in rows.columns]
    return [x for x in found if any(x[1:])]
