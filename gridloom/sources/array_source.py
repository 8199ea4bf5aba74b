"""Array files of the classic netCDF formats as a data source: ``spark.read.format("arrays")`` and ``.write.format("arrays")``.

``register(spark)`` makes the name known. Files are read in ranges: the driver lists them and reads one header for the schema; a partition is
some files, or a share of a large file's records, and its task seeks to what it needs. It reads

- only the columns of the schema: all variables that the dimension ``dim`` leads, those in the option ``variables``, or those of ``.schema(...)``;
- only records that conditions on ``index`` leave, and of the other columns only the blocks in which conditions on numbers leave rows.

Options for reading: dim (default: time), variables (comma-separated), nulls (true: missing_value, _FillValue or default fills become null),
partition_bytes, and where: a JSON list of [column, test, value] with the tests ==, >, >=, <, <=, in and known (not null), all of which a row
must meet (``load`` takes them as a list). Conditions are given with the load rather than taken from ``DataFrame.where``: Spark 4.1 keeps what a
Python source was given for one scan of a DataFrame for its other scans too, so a union of two selections would read one of them twice. Columns: file, index (the place along dim), and the variables with their attributes as metadata.

Options for writing: dim, width (bytes kept for a text, 64; a longer one fails the job rather than being cut), attributes (JSON, of the whole
file). Every task writes its rows as one file, a batch at a time, under a staging folder; the files of the tasks that succeeded are moved into
place when all have, so that a lost executor or a repeated task leaves nothing behind. Timestamps are written as microseconds with units; arrays of
numbers need one length in a file; nulls become the column's missing_value or the type's fill.

Files are reached through pyarrow's file systems, so any path with a scheme that pyarrow knows will do; ``netcdf.read`` goes through
Spark's own reader for the rest.
"""

from __future__ import annotations

import fnmatch
import json
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.sources import netcdf

NAME = "arrays"
#: Bytes of a file for a partition, of a block of records, and of a first look at a header.
PARTITION_BYTES, BLOCK_BYTES, HEADER_BYTES = 128 << 20, 4 << 20, 1 << 16
#: A record's wanted bytes are read one by one if they are less than this share of it and there are at least so many others between them.
SPARSE_SHARE, SPARSE_BYTES = 8, 1 << 14
_SPARK = {"byte": T.ByteType(), "string": T.StringType(), "short": T.ShortType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "long": T.LongType(), "decimal(20,0)": T.DecimalType(20, 0)}
_TESTS = ("==", ">", ">=", "<", "<=", "in", "known")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ArraySource)


def load(spark: SparkSession, path: str, variables: list[str] | None = None, where: list[tuple[str, str, object]] = (), **options: str) -> DataFrame:
    """The records of files that meet all conditions, with the chosen variables only."""
    register(spark)
    chosen = {"variables": ",".join(variables)} if variables else {}
    return spark.read.format(NAME).options(**chosen, where=json.dumps(list(where)), **options).load(path)


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or under a path, whose last part may have wildcards."""
    store, at = located(path)
    if any(c in at for c in "*?["):
        folder, _, pattern = at.rpartition("/")
        found = [x for x in store.get_file_info(arrow_fs.FileSelector(folder)) if fnmatch.fnmatch(x.base_name, pattern)]
    else:
        one = store.get_file_info(at)
        found = [one] if one.is_file else store.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    hidden = lambda x: any(part[:1] in ("_", ".") for part in x.path.removeprefix(at).split("/") if part)
    return sorted((x.path, x.size) for x in found if x.is_file and not hidden(x))


class ArrayFile:
    """An open file; ``read`` counts the bytes that are asked for."""

    def __init__(self, store: arrow_fs.FileSystem, path: str):
        self.path, self.taken = path, 0
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        n = HEADER_BYTES
        while True:
            try:
                self.head = netcdf.header(self.read(0, min(n, self.size)), self.size)
                return
            except (struct.error, IndexError):
                if n >= self.size:
                    raise ValueError(f"the header of {path} is damaged") from None
                n *= 4

    def read(self, at: int, n: int) -> bytes:
        self.taken += n
        found = self.file.read_at(n, at)
        if len(found) < n:
            raise ValueError(f"{self.path} is shorter than its header says")
        return found

    def length(self, dim: str) -> int:
        return self.head.dims.get(dim, 0)

    def columns(self, names: list[str], start: int, stop: int) -> dict[str, np.ndarray]:
        """Values of [start, stop) along their first dimension, in the file's byte order."""
        head, out, n = self.head, {}, stop - start
        shapes = {v: tuple(head.dims[d] for d in head.variables[v].dims[1:]) for v in names}
        forms = {v: np.dtype(netcdf.TYPES[head.variables[v].kind][0]) for v in names}
        moving = [v for v in names if head.variables[v].dims[0] == head.unlimited]
        for v in names:
            if v not in moving:
                one = math.prod(shapes[v]) * forms[v].itemsize
                out[v] = np.frombuffer(self.read(head.variables[v].begin + start * one, n * one), forms[v]).reshape(n, *shapes[v])
        if not moving or not n:
            return out | {v: np.zeros((n, *shapes[v]), forms[v]) for v in moving}
        low = min(head.variables[v].begin for v in moving)
        wide = max(head.variables[v].begin + head.variables[v].size for v in moving) - low
        if wide * SPARSE_SHARE < head.stride and head.stride - wide > SPARSE_BYTES:
            data, step = b"".join(self.read(low + k * head.stride, wide) for k in range(start, stop)), wide
        else:
            data, step = self.read(low + start * head.stride, (n - 1) * head.stride + wide), head.stride
        for v in moving:
            one = math.prod(shapes[v])
            view = np.ndarray((n, one), forms[v], data, head.variables[v].begin - low, (step, forms[v].itemsize))
            out[v] = view.reshape(n, *shapes[v])
        return out


@dataclass
class Share(InputPartition):
    """(path, k, n): the k-th of n equal ranges of a file's records."""

    parts: list[tuple[str, int, int]]


def schema_of(head: netcdf.Header, dim: str, chosen: list[str] | None) -> T.StructType:
    led = {v.name: v for v in head.variables.values() if v.dims[:1] == [dim]}
    unknown = [v for v in chosen or [] if v not in led]
    if unknown:
        raise ValueError(f"{unknown} have no leading dimension {dim!r}")
    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("index", T.LongType())])
    for v in (led[c] for c in chosen or led):
        kind = netcdf.TYPES[v.kind][1]
        found = _SPARK[kind]
        for _ in range(max(0, len(v.dims) - 1 - (kind == "string"))):
            found = T.ArrayType(found)
        out.add(T.StructField(v.name, found, metadata=v.attributes))
    return out


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no files at {self.options['path']}")
        chosen = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]
        return schema_of(ArrayFile(located(self.options["path"])[0], files[0][0]).head, self.options.get("dim", "time"), chosen or None)

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), schema, overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.schema, self.dim = options["path"], schema, options.get("dim", "time")
        self.nulls = options.get("nulls", "false").lower() == "true"
        self.share = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests = [(column, test, value) for column, test, value in json.loads(options.get("where", "[]"))]
        numbers = {f.name for f in schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))}
        for column, test, value in self.tests:
            given = value if test == "in" else [] if test == "known" else [value]
            if column not in numbers or test not in _TESTS or not all(type(x) in (int, float) and x == x for x in given):
                raise ValueError(f"no such condition on a column of numbers: {[column, test, value]}")

    def partitions(self) -> list[Share]:
        out, held, room = [], [], self.share
        for path, size in listed(self.path):
            n = max(1, -(-size // self.share))
            if n > 1:
                out += [Share([(path, k, n)]) for k in range(n)]
                continue
            if held and size > room:
                out.append(Share(held))
                held, room = [], self.share
            held.append((path, 0, 1))
            room -= size
        return out + ([Share(held)] if held else [])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store = located(self.path)[0]
        for path, k, n in partition.parts:
            file = ArrayFile(store, path)
            length = file.length(self.dim)
            yield from self.records(file, length * k // n, length * (k + 1) // n)

    def records(self, file: ArrayFile, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        """The rows of [start, stop) that pass the filters."""
        for column, test, value in self.tests:
            if column == "index" and test in ("==", ">", ">=", "<", "<="):
                start = max(start, math.ceil(value) if test in ("==", ">=") else math.floor(value) + 1) if test in ("==", ">", ">=") else start
                stop = min(stop, math.floor(value) + 1 if test in ("==", "<=") else math.ceil(value)) if test in ("==", "<", "<=") else stop
        held = [f.name for f in self.schema if f.name in file.head.variables]
        for name in held:
            if file.head.variables[name].dims[:1] != [self.dim]:
                raise ValueError(f"{name} of {file.path} has no leading dimension {self.dim!r}")
        first = [v for v in held if any(v == column for column, *_ in self.tests)]
        size = sum(math.prod(file.head.dims[d] for d in file.head.variables[v].dims[1:]) * 8 for v in held) or 8
        if any(file.head.variables[v].dims[0] == file.head.unlimited for v in held):
            size = max(size, file.head.stride)
        step = max(1, min(10_000, BLOCK_BYTES // size))
        for at in range(start, stop, step):
            end = min(stop, at + step)
            found = file.columns(first, at, end)
            keep = np.ones(end - at, bool)
            for column, test, value in self.tests:
                keep &= self.passing(file, column, test, value, np.arange(at, end) if column == "index" else found.get(column), end - at)
            if not keep.any():
                continue
            found |= file.columns([v for v in held if v not in first], at, end)
            yield self.batch(file, np.arange(at, end)[keep], {v: x[keep] for v, x in found.items()})

    def passing(self, file: ArrayFile, column: str, test: str, value, x: np.ndarray | None, n: int) -> np.ndarray:
        if x is None:  # a file without the variable: null
            return np.zeros(n, bool)
        known = ~self.missing(file, column, x) if column != "index" else np.ones(n, bool)
        if test == "known":
            return known
        if test == "in":
            return known & np.isin(x, value)
        # as in Spark, NaN is larger than all numbers
        nan = np.isnan(x) if x.dtype.kind == "f" else np.zeros(n, bool)
        return known & {"==": lambda: x == value, ">": lambda: (x > value) | nan, ">=": lambda: (x >= value) | nan, "<": lambda: x < value, "<=": lambda: x <= value}[test]()

    def missing(self, file: ArrayFile, column: str, x: np.ndarray) -> np.ndarray:
        if not self.nulls:
            return np.zeros(x.shape, bool)
        v = file.head.variables[column]
        said = [v.attributes.get(a) for a in ("missing_value", "_FillValue")]
        values = [y for one in said if one is not None for y in (one if isinstance(one, list) else [one])] or [netcdf.TYPES[v.kind][2]]
        return np.isin(x, np.array(values).astype(x.dtype))

    def batch(self, file: ArrayFile, index: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = []
        for f in self.schema:
            kind = to_arrow_type(f.dataType)
            if f.name == "file":
                columns.append(pa.array([file.path] * len(index)))
            elif f.name == "index":
                columns.append(pa.array(index))
            elif f.name not in found:
                columns.append(pa.nulls(len(index), kind))
            else:
                columns.append(self.column(file, f.name, found[f.name]).cast(kind))
        return pa.RecordBatch.from_arrays(columns, self.schema.names)

    def column(self, file: ArrayFile, name: str, x: np.ndarray) -> pa.Array:
        if file.head.variables[name].kind == netcdf.NUMBERS["string"]:
            texts = [b.tobytes().split(b"\0")[0].decode(errors="replace") for b in x.reshape(-1, x.shape[-1] if x.ndim > 1 else 1)]
            values, shape = pa.array(texts, pa.string()), x.shape[:-1] if x.ndim > 1 else x.shape
        else:
            flat = np.ascontiguousarray(x.reshape(-1)).astype(x.dtype.newbyteorder("="))
            values, shape = pa.array(flat, mask=self.missing(file, name, flat)), x.shape
        for k in range(len(shape) - 1, 0, -1):
            values = pa.ListArray.from_arrays(pa.array(np.arange(math.prod(shape[:k]) + 1, dtype=np.int32) * shape[k], pa.int32()), values)
        return values


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.dim, self.width, self.attributes = options.get("dim", "time"), int(options.get("width", 64)), json.loads(options.get("attributes", "{}"))
        self.staging = f"_staging-{uuid.uuid4().hex}"
        self.kinds = {f.name: self.kind(f) for f in schema}

    def kind(self, f: T.StructField) -> str:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.TimestampType):
            inner = T.LongType()
        name = next((k for k, x in _SPARK.items() if x == inner and k in netcdf.NUMBERS), None)
        if name is None or (name == "string" and isinstance(f.dataType, T.ArrayType)):
            raise ValueError(f"the formats have no type for column {f.name!r} ({f.dataType.simpleString()})")
        return name

    def said(self, f: T.StructField) -> dict:
        units = {"units": "microseconds since 1970-01-01 00:00:00"} if isinstance(f.dataType, T.TimestampType) else {}
        return units | dict(f.metadata or {})

    def fill(self, f: T.StructField):
        fill = self.said(f).get("missing_value", netcdf.TYPES[netcdf.NUMBERS[self.kinds[f.name]]][2])
        return fill[0] if isinstance(fill, list) else fill

    def encoded(self, f: T.StructField, column: pa.Array) -> np.ndarray:
        """The column's values, all of one shape."""
        kind = self.kinds[f.name]
        if kind == "string":
            texts = [(x or "").encode() for x in column.to_pylist()]
            longest = max(map(len, texts), default=0)
            if longest > self.width:
                raise ValueError(f"a text of {f.name!r} has {longest} bytes: set the option width, now {self.width}")
            return np.array(texts, f"S{self.width}").reshape(-1)
        form = np.dtype(netcdf.TYPES[netcdf.NUMBERS[kind]][0])
        if not isinstance(f.dataType, T.ArrayType):
            column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()) if pa.types.is_timestamp(column.type) else column
            return column.fill_null(pa.scalar(self.fill(f)).cast(column.type)).to_numpy(zero_copy_only=False).astype(form)
        lengths = {len(x) for x in column if x.is_valid}
        if len(lengths) > 1:
            raise ValueError(f"arrays of {f.name!r} have several lengths")
        n = lengths.pop() if lengths else 0
        out = np.full((len(column), n), self.fill(f), form)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        values = column.flatten()
        out[known] = values.fill_null(pa.scalar(self.fill(f)).cast(values.type)).to_numpy(zero_copy_only=False).reshape(-1, n)
        return out

    def header(self, lengths: dict[str, int]) -> tuple[bytes, np.dtype]:
        """A file's definitions, for any number of records to come, and the layout of one record."""
        dims, own, forms = {self.dim: 0}, {}, []
        for f in self.schema:
            number = netcdf.NUMBERS[self.kinds[f.name]]
            form, own[f.name] = np.dtype(netcdf.TYPES[number][0]), [self.dim]
            inner = self.width if number == 2 else lengths.get(f.name)
            if inner is not None:
                name = f"{f.name}_strlen" if number == 2 else f"{f.name}_length"
                dims[name] = inner
                own[f.name].append(name)
            forms.append(np.dtype(f"S{self.width}") if number == 2 else np.dtype((form, (inner,))) if inner is not None else form)
        alone = len(forms) == 1
        sizes = [x.itemsize if alone else -(-x.itemsize // 4) * 4 for x in forms]
        names, starts = list(dims), np.cumsum([0, *sizes]).tolist()

        def definitions(first: int) -> bytes:
            # the number of records is left to the length of the file, so a batch can be written before the next is known
            out = bytearray(b"CDF\x05" + b"\xff" * 8)
            netcdf._put(out, (">i", netcdf._DIMENSIONS), (">q", len(dims)))
            for d, n in dims.items():
                netcdf._put(out, netcdf._named(d), (">q", n))
            netcdf._put(out, netcdf._coded(self.attributes), (">i", netcdf._VARIABLES), (">q", len(forms)))
            for f, form, at in zip(self.schema, forms, starts):
                places = [(">q", names.index(d)) for d in own[f.name]]
                netcdf._put(out, netcdf._named(f.name), (">q", len(places)), *places, netcdf._coded(self.said(f)), (">i", netcdf.NUMBERS[self.kinds[f.name]]), (">q", -(-form.itemsize // 4) * 4), (">q", first + at))
            return bytes(out)

        return definitions(len(definitions(0))), np.dtype({"names": [f"f{k}" for k in range(len(forms))], "formats": forms, "offsets": starts[:-1], "itemsize": starts[-1]})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = located(self.path)
        name, out, layout, rows = f"part-{uuid.uuid4().hex}.nc", None, None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                columns = [self.encoded(f, c) for f, c in zip(self.schema, batch.columns)]
                lengths = {f.name: x.shape[1] for f, x in zip(self.schema, columns) if x.ndim > 1}
                if out is None:
                    head, layout = self.header(lengths)
                    known = lengths
                    store.create_dir(f"{folder}/{self.staging}", recursive=True)
                    out = store.open_output_stream(f"{folder}/{self.staging}/{name}")
                    out.write(head)
                if lengths != known:
                    raise ValueError(f"arrays of several lengths: {known}, {lengths}")
                records = np.zeros(batch.num_rows, layout)
                for k, x in enumerate(columns):
                    records[f"f{k}"] = x
                out.write(records.tobytes())
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Puts the files of the tasks that succeeded in place."""
        store, folder = located(self.path)
        kept = [m.name for m in messages if m is not None and m.name]
        store.create_dir(folder, recursive=True)
        before = [x.path for x in store.get_file_info(arrow_fs.FileSelector(folder)) if x.is_file] if self.overwrite else []
        if not kept and (self.overwrite or not listed(self.path)):
            # no rows at all: one file with the definitions
            kept = [f"part-{uuid.uuid4().hex}.nc"]
            store.create_dir(f"{folder}/{self.staging}", recursive=True)
            with store.open_output_stream(f"{folder}/{self.staging}/{kept[0]}") as out:
                out.write(self.header({f.name: 0 for f in self.schema if isinstance(f.dataType, T.ArrayType)})[0])
        for name in kept:
            store.move(f"{folder}/{self.staging}/{name}", f"{folder}/{name}")
        for path in before:
            store.delete_file(path)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        store, folder = located(self.path)
        if store.get_file_info(f"{folder}/{self.staging}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.staging}")
