"""Array files of the netCDF classic formats (CDF-1, CDF-2 and CDF-5) as DataFrames, and back.

Spark's binary file reader brings the files to the tasks, so any store that Spark reads will do and files are read in parallel; a
file is one row and must fit in memory. Definitions come as rows (``describe``), data as a row for each index of a
leading dimension (``read``) or for each variable (``static``). ``encode`` gives files as rows (file, content).

Defined results: fill and missing values stay as they are unless they are asked for as nulls; characters become text, cut at the first
zero byte; variables of several dimensions become nested arrays; a dimension of length 0 gives no rows; a file that isn't of these formats makes the job fail.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: type numbers with their NumPy types, Spark types and default fills; tags of the header's lists.
TYPES = {1: ("i1", "byte", -127), 2: ("S1", "string", 0), 3: (">i2", "short", -32767), 4: (">i4", "int", -2147483647), 5: (">f4", "float", 9.96921e36), 6: (">f8", "double", 9.96921e36), 7: ("u1", "short", 255), 8: (">u2", "int", 65535), 9: (">u4", "long", 4294967295), 10: (">i8", "long", -9223372036854775806), 11: (">u8", "decimal(20,0)", 18446744073709551614)}
NUMBERS = {"byte": 1, "string": 2, "short": 3, "int": 4, "float": 5, "double": 6, "long": 10}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    name: str
    kind: int
    dims: list[str]
    attributes: dict
    begin: int = 0
    size: int = 0


@dataclass
class Header:
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    records: int = 0
    unlimited: str | None = None
    #: Bytes from one record to the next.
    stride: int = 0
    types: dict[str, str] = field(default_factory=dict)


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        magic = data[:4]
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a file of the netCDF classic formats")
        self.at, self.wide = 4, magic[3] == 5
        self.offset = ">i" if magic[3] == 1 else ">q"

    def take(self, form: str) -> int:
        value = struct.unpack_from(form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def count(self) -> int:
        return self.take(">q" if self.wide else ">i")

    def name(self) -> str:
        n = self.count()
        text = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return text

    def listed(self, tag: int) -> int:
        found, n = self.take(">i"), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header of a file is damaged")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.listed(_ATTRIBUTES)):
            name, kind, n = self.name(), self.take(">i"), self.count()
            form = np.dtype(TYPES[kind][0])
            raw = self.data[self.at : self.at + n * form.itemsize]
            self.at += -(-len(raw) // 4) * 4
            values = np.frombuffer(raw, form).tolist()
            out[name] = raw.split(b"\0")[0].decode(errors="replace") if kind == 2 else values[0] if len(values) == 1 else values
        return out


def header(data: bytes, whole: int | None = None) -> Header:
    """The definitions in a file's first bytes; ``whole`` is how many it has, where these are not all."""
    b = _Bytes(data)
    records = b.count()
    names, dims, unlimited = [], {}, None
    for _ in range(b.listed(_DIMENSIONS)):
        name, n = b.name(), b.count()
        names.append(name)
        dims[name] = n
        if n == 0:
            unlimited = name
    out = Header(dims, b.attributes(), {}, unlimited=unlimited)
    for _ in range(b.listed(_VARIABLES)):
        name = b.name()
        own = [names[b.count()] for _ in range(b.count())]
        attributes, kind, size = b.attributes(), b.take(">i"), b.count()
        out.variables[name] = Variable(name, kind, own, attributes, b.take(b.offset), size)
    held = [v for v in out.variables.values() if v.dims and v.dims[0] == unlimited]
    for v in held:
        v.size = math.prod(dims[d] for d in v.dims[1:]) * np.dtype(TYPES[v.kind][0]).itemsize
    out.stride = held[0].size if len(held) == 1 else sum(-(-v.size // 4) * 4 for v in held)
    if unlimited is not None:
        if records < 0 or records == 0xFFFFFFFF:
            # written by a stream: as many as the file holds
            whole = len(data) if whole is None else whole
            first = min((v.begin for v in held), default=whole)
            records = (whole - first) // out.stride if out.stride else 0
        out.records = dims[unlimited] = records
    return out


def values(data: bytes, head: Header, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """A variable's values, of a range of its first dimension."""
    v = head.variables[name]
    form, shape = np.dtype(TYPES[v.kind][0]), [head.dims[d] for d in v.dims]
    if not shape:
        return np.frombuffer(data, form, 1, v.begin)[0]
    stop = shape[0] if stop is None else min(stop, shape[0])
    n, inner = max(0, stop - start), math.prod(shape[1:])
    if v.dims[0] != head.unlimited:
        return np.frombuffer(data, form, n * inner, v.begin + start * inner * form.itemsize).reshape(n, *shape[1:])
    if not n or not inner:
        return np.zeros((n, *shape[1:]), form)
    end = v.begin + (stop - 1) * head.stride + v.size
    if end > len(data):
        raise ValueError("a file is shorter than its header says")
    view = np.ndarray((n, inner), form, data, v.begin + start * head.stride, (head.stride, form.itemsize))
    return view.reshape(n, *shape[1:])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


_DEFINITIONS = "file string, kind string, variable string, name string, type string, value string, length long"


def describe(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, variable, name, type, value, length): a row for each dimension, attribute (value as JSON) and variable of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = header(data)
                rows += [(file, "dimension", None, d, "unlimited" if d == head.unlimited else "fixed", None, n) for d, n in head.dims.items()]
                rows += [(file, "attribute", None, a, type(x).__name__, json.dumps(x), None) for a, x in head.attributes.items()]
                for v in head.variables.values():
                    rows.append((file, "variable", v.name, v.name, TYPES[v.kind][1], json.dumps(v.dims), math.prod(head.dims[d] for d in v.dims)))
                    rows += [(file, "attribute", v.name, a, type(x).__name__, json.dumps(x), None) for a, x in v.attributes.items()]
            kinds = [pa.string()] * 6 + [pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [p.split()[0] for p in _DEFINITIONS.split(", ")])

    return _files(spark, path).mapInArrow(run, _DEFINITIONS)


def _definitions(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], dict[str, str], dict[str, dict]]:
    """Dimensions, types and attributes of the variables of all files; where files differ the first by name counts. A few rows come to the driver."""
    rows = describe(spark, path).where("variable is not null").groupBy("variable", "kind", "name").agg(F.min_by(F.struct("type", "value"), "file").alias("x")).collect()
    variables = {r["variable"]: r["x"] for r in rows if r["kind"] == "variable"}
    attributes: dict[str, dict] = {v: {} for v in variables}
    for r in rows:
        if r["kind"] == "attribute":
            attributes[r["variable"]][r["name"]] = json.loads(r["x"]["value"])
    return {v: json.loads(x["value"]) for v, x in variables.items()}, {v: x["type"] for v, x in variables.items()}, attributes


def _plain(found: np.ndarray, kind: int):
    """Values as Python ones; the last dimension of characters is a text."""
    if kind != 2:
        return found.tolist()
    if found.ndim == 0:
        return bytes(found).split(b"\0")[0].decode(errors="replace")
    if found.ndim == 1:
        return found.tobytes().split(b"\0")[0].decode(errors="replace")
    return [_plain(x, kind) for x in found]


def _rank(kind: str, dims: list[str], leading: int) -> str:
    """The Spark type of a cell of a variable, given how many dimensions are rows."""
    inner = max(0, len(dims) - leading - (kind == "string"))
    return "array<" * inner + kind + ">" * inner


def read(spark: SparkSession, path: str, dim: str = "time", variables: list[str] | None = None, start: int = 0, stop: int | None = None, nulls: bool = False) -> DataFrame:
    """(file, index, variables): a row for each index of a dimension, from ``start`` up to ``stop``, of the variables that it leads.

    nulls: whether missing_value, _FillValue and default fills become nulls. Attributes go to the columns' metadata.
    """
    dims, types, attributes = _definitions(spark, path)
    chosen = [v for v in (variables or sorted(dims)) if dims.get(v, [None])[:1] == [dim]]
    unknown = [v for v in variables or [] if v not in chosen]
    if unknown:
        raise ValueError(f"{unknown} have no leading dimension {dim!r}")
    kinds = {v: _rank(types[v], dims[v], 1) for v in chosen}
    schema = ", ".join(["file string", "index long", *[f"`{v}` {kinds[v]}" for v in chosen]])
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = header(data)
                end = head.dims.get(dim, 0) if stop is None else min(stop, head.dims.get(dim, 0))
                for at in range(start, end, 1000):
                    last = min(end, at + 1000)
                    columns = []
                    for v in chosen:
                        held = v in head.variables
                        found = values(data, head, v, at, last) if held else [None] * (last - at)
                        columns.append([_plain(x, head.variables[v].kind) for x in found] if held else found)
                    columns = [[file] * (last - at), range(at, last), *columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = _files(spark, path).mapInArrow(run, schema)
    for v in chosen:
        if nulls and not kinds[v].startswith(("array", "string")):
            said = [attributes[v].get(a) for a in ("missing_value", "_FillValue")]
            missing = [x for one in said if one is not None for x in (one if isinstance(one, list) else [one])] or [fill for _, kind, fill in TYPES.values() if kind == types[v]]
            rows = rows.withColumn(v, F.when(~F.col(f"`{v}`").isin(*[F.lit(x).cast(types[v]) for x in missing]), F.col(f"`{v}`")))
        rows = rows.withMetadata(v, attributes[v])
    return rows


def static(spark: SparkSession, path: str, dim: str = "time") -> DataFrame:
    """(file, variable, dims, value): the variables that a dimension doesn't lead, value as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = header(data)
                rows += [(file, v.name, v.dims, json.dumps(_plain(values(data, head, v.name), v.kind))) for v in head.variables.values() if v.dims[:1] != [dim]]
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "variable", "dims", "value"])

    return _files(spark, path).mapInArrow(run, "file string, variable string, dims array<string>, value string")


def _put(out: bytearray, *parts: tuple[str, int] | bytes) -> None:
    for part in parts:
        out += part if isinstance(part, bytes) else struct.pack(*part)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def _named(text: str) -> bytes:
    data = text.encode()
    return struct.pack(">q", len(data)) + _padded(data)


def _coded(attributes: dict) -> bytes:
    out = bytearray(struct.pack(">iq", _ATTRIBUTES if attributes else 0, len(attributes)))
    for name, value in attributes.items():
        held = value if isinstance(value, list) else [value]
        kind = 2 if isinstance(value, str) else 6 if any(isinstance(x, float) for x in held) else 10
        data = value.encode() if kind == 2 else np.array(held, TYPES[kind][0]).tobytes()
        _put(out, _named(name), (">i", kind), (">q", len(data) if kind == 2 else len(held)), _padded(data))
    return bytes(out)


def file_bytes(columns: dict[str, tuple[str, list]], dim: str, attributes: dict[str, dict], whole: dict) -> bytes:
    """A file (CDF-5) whose records are the rows of ``columns`` (type and values by name). Nulls become the column's missing value or the type's fill."""
    n = len(next(iter(columns.values()))[1]) if columns else 0
    dims, data = {dim: 0}, {}
    for name, (kind, held) in columns.items():
        number = NUMBERS[kind]
        if number == 2:
            coded = [(x or "").encode() for x in held]
            width = max([len(x) for x in coded], default=0) or 1
            dims[f"{name}_strlen"] = width
            data[name] = np.array(coded, f"S{width}").tobytes(), width
            continue
        fill = attributes.get(name, {}).get("missing_value", TYPES[number][2])
        fill = fill[0] if isinstance(fill, list) else fill
        form = np.dtype(TYPES[number][0])
        data[name] = np.array([fill if x is None else x for x in held], form).tobytes(), form.itemsize
    names = list(dims)

    def definitions(begins: dict[str, int]) -> bytes:
        out = bytearray(b"CDF\x05")
        _put(out, (">q", n), (">i", _DIMENSIONS), (">q", len(dims)))
        for d, length in dims.items():
            _put(out, _named(d), (">q", length))
        _put(out, _coded(whole), (">i", _VARIABLES if columns else 0), (">q", len(columns)))
        for name, (kind, _) in columns.items():
            own = [0, names.index(f"{name}_strlen")] if kind == "string" else [0]
            _put(out, _named(name), (">q", len(own)), *[(">q", d) for d in own], _coded(attributes.get(name, {})), (">i", NUMBERS[kind]), (">q", -(-data[name][1] // 4) * 4), (">q", begins.get(name, 0)))
        return bytes(out)

    at, begins, alone = len(definitions({})), {}, len(columns) == 1
    sizes = {name: width if alone else -(-width // 4) * 4 for name, (_, width) in data.items()}
    for name in columns:
        begins[name] = at
        at += sizes[name]
    records = [np.frombuffer(raw, np.uint8).reshape(n, width) for raw, width in data.values()]
    padded = [np.pad(x, ((0, 0), (0, sizes[name] - x.shape[1]))) for name, x in zip(columns, records, strict=True)]
    return definitions(begins) + (np.concatenate(padded, axis=1).tobytes() if padded else b"")


def encode(rows: DataFrame, file: str, dim: str = "time", order: str | None = None, attributes: dict | None = None) -> DataFrame:
    """(file, content): the rows of each value of the column ``file`` as one file, in the order of a column. Columns' metadata become attributes.

    A file's rows are one group, as they are one file.
    """
    names = [c for c in rows.columns if c != file]
    kinds = {"tinyint": "byte", "smallint": "short", "bigint": "long"}
    types = {c: kinds.get(t := rows.schema[c].dataType.simpleString(), t) for c in names}
    bad = [c for c in names if types[c] not in NUMBERS]
    if bad:
        raise ValueError(f"columns {bad} have types that these formats lack")
    held = {c: dict(rows.schema[c].metadata) for c in names}
    whole = attributes or {}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order) if order else table
        content = file_bytes({c: (types[c], table[c].to_pylist()) for c in names}, dim, held, whole)
        return pa.table({"file": pa.array([str(table[file][0].as_py())]), "content": pa.array([content], pa.binary())})

    return rows.groupBy(file).applyInArrow(run, "file string, content binary")
