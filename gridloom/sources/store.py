"""Stored datasets: files split by time, versions, and a log of commits that says which files there are.

A dataset is a folder with data files, one batch of them for each commit, and the folder ``_log``. A commit is one file of the log, put in place by a
rename that fails where the name is taken; it holds the files that come and go, with the extents of their times. So readers see a commit whole or
not at all, open only the files that reach their interval, and never list the data folders. Two commits that were prepared on
the same state don't both get in if one replaces times that the other touches (``Conflict``); else the later one is numbered anew. Files that a
commit replaced stay for those who read them until ``vacuum``. The log is read by Spark, from the latest summary on that every
``SUMMARY``-th commit writes. Columns have the attributes that were stored last; ``changes`` tells when they got them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions import times

SUMMARY = 20
_LOG = "action string, file string, split string, start long, end long, n long, batch string, kind string"


class Conflict(RuntimeError):
    """Another writer has committed what this one's commit doesn't know of."""


def _split(coord: Column, *kind) -> Column:
    return F.date_format(F.timestamp_micros(times.split_key(coord, *kind)), "yyyyMMdd'T'HHmmss")


class _Folder:
    """A dataset's folder, reached through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path, spark._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[str]:
        """The log's files, by number."""
        log = self.child("_log")
        found = [x.getPath().getName() for x in self.files.listStatus(log)] if self.files.exists(log) else []
        return sorted(x for x in found if x[:1].isdigit())

    def put(self, name: str, lines: list[dict]) -> bool:
        """Writes a file of the log; False if it is there already."""
        made = self.child(f"_log/.{uuid.uuid4().hex}")
        out = self.files.create(made, False)
        out.write(bytearray("\n".join(json.dumps(x) for x in lines).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(made, self.child(f"_log/{name}"), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.files.delete(made, False)
            return False
        return True


def _logged(folder: _Folder, names: list[str]) -> DataFrame:
    """The lines of the log's files, from the latest summary on."""
    last = max((k for k, x in enumerate(names) if ".summary." in x), default=0)
    names = names[last:]
    rows = folder.spark.read.schema(_LOG).json([f"{folder.path}/_log/{x}" for x in names]) if names else folder.spark.createDataFrame([], _LOG)
    return rows.withColumn("version", F.substring(F.col("_metadata.file_name"), 1, 12).cast("long")) if names else rows.withColumn("version", F.lit(0).cast("long"))


def _live(log: DataFrame) -> DataFrame:
    gone = log.where("action = 'remove'").select("file")
    return log.where("action = 'add'").join(gone, "file", "left_anti")


def _reaching(files: DataFrame, begin: int | None, end: int | None) -> DataFrame:
    if begin is not None:
        files = files.where(F.col("end") >= begin)
    return files if end is None else files.where(F.col("start") < end)


class Commit:
    """A change of a dataset, prepared on the state that it finds: add rows, or replace those of an interval; then commit()."""

    def __init__(self, spark: SparkSession, path: str, coord: str = "t", *, mode: str = "days", interval: int = 1, start: int = 0, tz_hours: float = 0.0, fmt: str = "parquet"):
        self.spark, self.folder, self.coord, self.kind, self.fmt = spark, _Folder(spark, path), coord, (mode, interval, start, tz_hours), fmt
        self.names = self.folder.versions()
        self.log = _logged(self.folder, self.names)
        self.held = {r["batch"]: r["file"] for r in self.log.where("action in ('schema', 'batch')").orderBy("version").select(F.when(F.col("action") == "schema", "").otherwise(F.col("batch")).alias("batch"), "file").collect()}
        self.schema = T.StructType.fromJson(json.loads(self.held.pop(""))) if "" in self.held else None
        self.lines: list[dict] = []

    def has(self, batch: str) -> bool:
        """Whether a batch of that name was committed."""
        return batch in self.held

    def _written(self, rows: DataFrame) -> list[dict]:
        """Writes rows as new files, and gives their lines of the log."""
        types = {f.name: f.dataType for f in self.schema or []}
        changed = [f.name for f in rows.schema if types.get(f.name, f.dataType) != f.dataType]
        if changed:
            raise ValueError(f"columns {changed} are stored with other types")
        at = f"{self.folder.path}/data/{uuid.uuid4().hex}"
        split = F.coalesce(_split(F.col(self.coord), *self.kind), F.lit("none"))
        # ranges of time, so that a split with most of the rows is written by several tasks
        out = rows.withColumn("split", split).repartitionByRange("split", self.coord).sortWithinPartitions("split", self.coord)
        writer = out.write.partitionBy("split").format(self.fmt)
        (writer.option("header", True) if self.fmt == "csv" else writer).save(at)
        known = T.StructType([*self._described({f.name: f.metadata for f in rows.schema}), *(f for f in rows.schema if f.name not in types)])
        try:
            back = self.spark.read.format(self.fmt).schema(T.StructType([*rows.schema, T.StructField("split", T.StringType())])).option("header", self.fmt == "csv").load(at)
            found = back.groupBy(F.col("_metadata.file_path").alias("file"), "split").agg(F.min(self.coord).alias("start"), F.max(self.coord).alias("end"), F.count("*").alias("n")).collect()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            found = []
        self._know(known, min((r["start"] for r in found if r["start"] is not None), default=None))
        return [{"action": "add", **r.asDict()} for r in found]

    def _described(self, attributes: dict[str, dict]) -> list[T.StructField]:
        """The stored columns with new values of attributes."""
        return [T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **attributes.get(f.name, {})}) for f in self.schema or []]

    def _know(self, known: T.StructType, start: int | None) -> None:
        """Notes a schema that has other columns or attributes than the stored one; samples have them from ``start`` on."""
        if self.schema is not None and known.json() == self.schema.json():
            return
        self.lines.append({"action": "schema", "file": known.json()})
        before = {f.name: f.metadata for f in self.schema or []}
        for f in known:
            old = before.get(f.name, {})
            changed = {k: f.metadata.get(k) for k in {*old, *f.metadata} if old.get(k) != f.metadata.get(k)}
            if self.schema is not None and (changed or f.name not in before):
                self.lines.append({"action": "change", "batch": f.name, "file": json.dumps(changed, sort_keys=True), **({} if start is None else {"start": start})})
        self.schema = known

    def describe(self, attributes: dict[str, dict]) -> None:
        """New values of attributes of stored columns, without new samples; None removes one."""
        absent = attributes.keys() - {f.name for f in self.schema or []}
        if absent:
            raise ValueError(f"no columns {sorted(absent)} are stored")
        fields = [T.StructField(f.name, f.dataType, f.nullable, {k: v for k, v in f.metadata.items() if v is not None}) for f in self._described(attributes)]
        self._know(T.StructType(fields), None)

    def _load(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.format(self.fmt).schema(self.schema).option("header", self.fmt == "csv").load(files)

    def add(self, rows: DataFrame, batch: str | None = None) -> None:
        lines = self._written(rows)
        extent = [x[k] for x in lines for k in ("start", "end") if x[k] is not None]
        self.lines += [*lines, {"action": "commit", "kind": "add", "start": min(extent, default=None), "end": max(extent, default=None)}]
        self.lines += [{"action": "batch", "batch": batch, "file": ""}] if batch is not None else []

    def replace(self, rows: DataFrame, begin: int, end: int) -> None:
        """The rows take the place of all that is stored in [begin, end), also where there are none."""
        old = _reaching(_live(self.log), begin, end).select("file", "start", "end").collect()
        # files that reach over the interval's ends are written again without what is in it
        over = [r["file"] for r in old if r["start"] < begin or r["end"] >= end]
        if over:
            stored = self._load(over).where((F.col(self.coord) < begin) | (F.col(self.coord) >= end))
            rows = rows.unionByName(stored, allowMissingColumns=True)
        lines = self._written(rows)
        self.lines += [*lines, *({"action": "remove", "file": r["file"]} for r in old)]
        self.lines.append({"action": "commit", "kind": "replace", "start": min([begin, *(r["start"] for r in old)]), "end": max([end - 1, *(r["end"] for r in old)])})

    def replace_splits(self, rows: DataFrame) -> None:
        """The rows take the place of all that is stored in the splits that they belong to."""
        lines = self._written(rows)
        splits = {x["split"] for x in lines}
        old = [r for r in _live(self.log).select("file", "split", "start", "end").collect() if r["split"] in splits]
        extent = [x[k] for x in [*lines, *(r.asDict() for r in old)] for k in ("start", "end") if x[k] is not None]
        self.lines += [*lines, *({"action": "remove", "file": r["file"]} for r in old)]
        self.lines.append({"action": "commit", "kind": "replace", "start": min(extent, default=None), "end": max(extent, default=None)})

    def _check(self, names: list[str]) -> None:
        """Fails if commits since this one was prepared touch what it replaces, or replace what it touches."""
        own = [x for x in self.lines if x["action"] == "commit"]
        batches = {x["batch"] for x in self.lines if x["action"] == "batch"}
        schemas = [x["file"] for x in self.lines if x["action"] == "schema"]
        for r in _logged(self.folder, names).where("action in ('commit', 'batch', 'schema')").collect():
            if r["action"] == "schema" and schemas and r["file"] != schemas[-1]:
                raise Conflict("another writer has changed columns or attributes")
            if r["action"] == "batch" and r["batch"] in batches:
                raise Conflict(f"batch {r['batch']} was committed by another writer")
            for x in own:
                both = None not in (r["start"], r["end"], x["start"], x["end"]) and r["start"] <= x["end"] and x["start"] <= r["end"]
                if r["action"] == "commit" and both and "replace" in (r["kind"], x["kind"]):
                    raise Conflict(f"another writer has changed times from {r['start']} to {r['end']}")

    def commit(self) -> int:
        """Puts the change in place and gives its number."""
        if not self.lines:
            return len(self.names)
        known = [x for x in self.names if ".summary." not in x]
        while True:
            number = int(known[-1][:12]) + 1 if known else 1
            if self.folder.put(f"{number:012d}.json", self.lines):
                break
            newer = [x for x in self.folder.versions() if ".summary." not in x and int(x[:12]) >= number]
            self._check(newer)
            known = newer
        if number % SUMMARY == 0:
            log = _logged(self.folder, [x for x in self.folder.versions() if int(x[:12]) <= number])
            held = _live(log).unionByName(log.where("action in ('schema', 'batch', 'change')")).orderBy("version").drop("version").collect()
            last = max((k for k, r in enumerate(held) if r["action"] == "schema"), default=None)
            held = [r.asDict() for k, r in enumerate(held) if r["action"] != "schema" or k == last]
            self.folder.put(f"{number:012d}.summary.json", [{k: v for k, v in r.items() if v is not None} for r in held])
        return number


def write(rows: DataFrame, path: str, coord: str = "t", *, save_mode: str = "append", batch: str | None = None, **kind) -> bool:
    """Adds microsecond samples, split by time and sorted within each file. Formats: parquet, orc, json, csv (with header).

    save_mode overwrite replaces the splits that the rows belong to. A batch that was committed before is not written again (False).
    """
    change = Commit(rows.sparkSession, path, coord, **kind)
    if batch is not None and change.has(batch):
        return False
    change.replace_splits(rows) if save_mode == "overwrite" else change.add(rows, batch)
    change.commit()
    return True


def replace(rows: DataFrame, path: str, begin: int, end: int, coord: str = "t", **kind) -> None:
    """The rows take the place of what is stored in [begin, end); without rows the interval becomes empty."""
    change = Commit(rows.sparkSession, path, coord, **kind)
    change.replace(rows, begin, end)
    change.commit()


def read(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None, coord: str = "t", fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame | None:
    """Samples of [begin, end): files that don't reach the interval aren't opened. None if nothing was ever stored."""
    change = Commit(spark, path, coord, fmt=fmt)
    if change.schema is None:
        return None
    rows = change._load([r["file"] for r in _reaching(_live(change.log), begin, end).select("file").collect()])
    if begin is not None:
        rows = rows.where(F.col(coord) >= begin)
    if end is not None:
        rows = rows.where(F.col(coord) < end)
    return rows.select(*columns) if columns else rows


def last_before(spark: SparkSession, path: str, before: int, series: DataFrame | None, order: list[str], columns: list[str], coord: str = "t", fmt: str = "parquet") -> DataFrame | None:
    """The last stored row before a time, or of each of the ``series``. None if there is none.

    Newest files first, twice as many in each round, until every series has its row: mostly one round, and only the named columns.
    """
    change = Commit(spark, path, coord, fmt=fmt)
    if change.schema is None or not set(columns) <= set(change.schema.names):
        return None
    files = [tuple(r) for r in _live(change.log).where(F.col("start") < before).orderBy(F.desc("end")).select("file", "end").collect()]
    by, wanted, taken, found, many = (series.columns, series.count(), 0, None, 4) if series is not None else ([], 1, 0, None, 4)
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    while taken < len(files):
        taken, many = min(len(files), taken + many), many * 2
        rows = change._load([f for f, _ in files[:taken]]).where(F.col(coord) < before).select(*columns)
        if series is not None:
            rows = rows.join(series, by, "left_semi")
        found = rows.groupBy(*by).agg(newest).where("_row is not null").select("_row.*")
        # rows of the files that are left are not newer than their ends
        if taken == len(files) or found.where(F.col(coord) > files[taken][1]).count() == wanted:
            break
    return found


def describe(spark: SparkSession, path: str, attributes: dict[str, dict]) -> None:
    """Sets attributes of stored columns (None removes one) in a commit of their own; the data files stay as they are."""
    change = Commit(spark, path)
    change.describe(attributes)
    change.commit()


def changes(spark: SparkSession, path: str) -> DataFrame:
    """(column, attributes, start): what was new in columns after the first commit, as JSON, and the first sample stored with it (null: none)."""
    folder = _Folder(spark, path)
    return _logged(folder, folder.versions()).where("action = 'change'").select(F.col("batch").alias("column"), F.col("file").alias("attributes"), "start")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, start, end, n) of every file that the dataset has."""
    folder = _Folder(spark, path)
    return _live(_logged(folder, folder.versions())).select("file", "split", "start", "end", "n")


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the data files that no commit has any more; for when nobody reads or writes. Returns how many went."""
    folder, n = _Folder(spark, path), 0
    held = {r["file"].rpartition("/data/")[2] for r in manifest(spark, path).select("file").collect()}
    found = folder.files.listFiles(folder.child("data"), True)
    while found.hasNext():
        file = found.next().getPath()
        name = file.toUri().toString().rpartition("/data/")[2]
        if name not in held:
            folder.files.delete(file, False)
            n += not name.rpartition("/")[2].startswith((".", "_"))
    return n


def overlapping(files: DataFrame, begin: int, end: int) -> DataFrame:
    return files.where((F.col("start") <= end) & (F.col("end") >= begin))


def highest_versions(files: DataFrame, name: str = "name") -> DataFrame:
    """Of files that differ only in .v<number>, the highest; one without a version is the highest."""
    version = F.regexp_extract(name, r"\.v(\d+)(?:\.|$)", 1).try_cast("long")
    base = F.regexp_replace(name, r"\.v\d+(?=\.|$)", "")
    w = Window.partitionBy(base).orderBy(F.coalesce(version, F.lit(2**62)).desc(), F.col(name))
    return files.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def file_time(name: Column, patterns: list[str]) -> Column:
    """Time (microseconds) in a file's name."""
    return times.first_match(patterns, name)


def valid_times(rows: DataFrame, coord: str, least: int, now: int, latest: int | None = None) -> DataFrame:
    """Adds invalid: early (below least), future (after now), old (at or before the latest stored time), or null."""
    why = F.when(F.col(coord) < least, F.lit("early")).when(F.col(coord) > now, F.lit("future"))
    return rows.withColumn("invalid", why if latest is None else why.when(F.col(coord) <= latest, F.lit("old")))
