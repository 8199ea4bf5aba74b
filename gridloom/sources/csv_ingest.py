"""Delimited raw files as typed samples, by a declarative configuration."""

from __future__ import annotations

import textwrap
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times, units
from gridloom.functions.text import split_delimited
from gridloom.operators import chunks
from gridloom.sources import multiline


@dataclass
class FieldMap:
    """An output variable from a column: its unit there, missing texts, and texts that stand for numbers."""

    name: str
    column: str
    unit: str | None = None
    out_unit: str | None = None
    missing: tuple[str, ...] = ()
    texts: dict[str, float] = field(default_factory=dict)


@dataclass
class CsvConf:
    delimiter: str = ","
    header: tuple[str, ...] = ()
    file_patterns: tuple[str, ...] = ()
    file_time_patterns: tuple[str, ...] = ()
    time_columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    fields: list[FieldMap] = field(default_factory=list)
    time_offset: float = 0.0
    #: Whether quotes hold line ends, so that a record may have several lines.
    multiline: bool = False
    #: Whether a text that is neither a number nor in a variable's table of texts fails the job; else it becomes null.
    strict_texts: bool = True


def parse_conf(text: str) -> CsvConf:
    """Reads 'KEY: value' sections; continuation lines are indented or follow their key.

    DELIMITER, HEADER (names; without it the files' own header lines count), FILE_NAME_PATTERNS, FILE_TIME_PATTERNS, TIME_COLUMNS (column: pattern, ...),
    TIME_OFFSET, MULTILINE (yes: quotes hold line ends), and FIELD_MAP with lines 'variable: column, unit, missing[, missing ...]'. # starts a comment.
    """
    sections: dict[str, list[str]] = {}
    key = None
    for raw in textwrap.dedent(text).splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        head, colon, rest = line.partition(":")
        if colon and head.strip().isupper() and not raw[:1].isspace():
            key = head.strip()
            sections.setdefault(key, [])
            line = rest.strip()
        if key is None:
            raise ValueError(f"{line!r} stands before any key")
        if line:
            sections[key].append(line)
    listed = lambda k: tuple(x.strip() for line in sections.get(k, []) for x in line.split(",") if x.strip())
    conf = CsvConf(header=listed("HEADER"), file_patterns=listed("FILE_NAME_PATTERNS"), file_time_patterns=listed("FILE_TIME_PATTERNS"))
    for name in sections.get("DELIMITER", []):
        conf.delimiter = {"space": " ", "tab": "\t", "comma": ","}.get(name.lower(), name.strip("'\""))
    for line in sections.get("TIME_OFFSET", []):
        conf.time_offset = float(line)
    conf.multiline = any(line.lower() in ("yes", "true", "1") for line in sections.get("MULTILINE", []))
    for line in sections.get("TIME_COLUMNS", []):
        column, _, patterns = line.partition(":")
        conf.time_columns[column.strip()] = tuple(p.strip() for p in patterns.split(",") if p.strip())
    for line in sections.get("FIELD_MAP", []):
        name, _, rest = line.partition(":")
        parts = [p.strip() for p in rest.split(",")]
        conf.fields.append(FieldMap(name.strip(), parts[0], parts[1] if len(parts) > 1 and parts[1] else None, missing=tuple(parts[2:])))
    return conf


def read_lines(spark: SparkSession, path: str, conf: CsvConf | None = None) -> DataFrame:
    """(file, line, at) of all text files under a path; of those whose names match one of the configuration's patterns, if it has any.

    at: what orders the lines of a file. Lines end with LF, CR or both; with the configuration's ``multiline`` those inside quotes hold on.
    """
    return lines_of(spark.read.text(path), conf)


def lines_of(texts: DataFrame, conf: CsvConf | None) -> DataFrame:
    """The same of a text source's rows."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), at.alias("at"))
    lines = lines if conf is None else of_patterns(lines, conf)
    return multiline.joined(lines) if conf is not None and conf.multiline else lines


def of_patterns(lines: DataFrame, conf: CsvConf) -> DataFrame:
    """The lines of the files whose names match one of the configuration's patterns, if it has any."""
    if not conf.file_patterns:
        return lines
    name = F.element_at(F.split("file", "/"), -1)
    return lines.where(F.greatest(*[name.rlike(f"^(?:{p})$") for p in conf.file_patterns], F.lit(False)))


def _columns_of_files(rows: DataFrame, conf: CsvConf, file: str, line: str) -> DataFrame:
    """(file, _names): the header line of each file, i.e. a line whose cells hold all columns that the configuration needs."""
    needed = {*conf.time_columns, *(f.column for f in conf.fields)}
    # lines that lack a name aren't split for this; a name with quotes may be written with doubled ones
    for name in sorted(needed):
        if not set("\"'") & set(name):
            rows = rows.where(F.col(line).contains(F.lit(name)))
    heads = rows.where(F.size(F.array_intersect("_cells", F.array(*map(F.lit, sorted(needed))))) == len(needed))
    # the first of several, where the order of lines is known; later ones are rejected as records
    first = F.min_by("_cells", "at") if "at" in rows.columns else F.min("_cells")
    return heads.groupBy(F.col(file).alias("_head_of")).agg(first.alias("_names"))


def number(text: Column, f: FieldMap, strict: bool = False) -> Column:
    """The number a cell stands for; null if it is empty, listed as missing, or no number. strict: a text that a table of texts lacks fails the job."""
    out = text.try_cast("double")
    if strict and f.texts:
        out = F.when(out.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit(f"{f.name}: no number stands for the text "), text)).cast("double")).otherwise(out)
    for said, value in f.texts.items():
        out = F.when(F.lower(text) == said.lower(), F.lit(float(value))).otherwise(out)
    if f.unit and f.out_unit:
        out = units.convert(out, f.unit, f.out_unit)
    return F.when((text == "") | text.isin(*f.missing), None).otherwise(out) if f.missing else F.when(text == "", None).otherwise(out)


def records(lines: DataFrame, conf: CsvConf, line: str = "line", file: str | None = None) -> DataFrame:
    """Adds cells (map of text by column), t (microseconds) and rejected (why, or null) to every record line.

    Columns are those of the configuration's HEADER; without one, each file's header line gives them and is no record (``file`` must name its column; lines before it
    are rejected as others are). A record is rejected if its number of cells isn't that of the header or no time pattern matches. Time columns are merged, later
    ones override; year, month and day that they lack come from the file name.
    """
    # explode(array(x)) evaluates x once, however often it is used later
    rows = lines.withColumn("_cells", F.explode(F.array(split_delimited(F.col(line), conf.delimiter))))
    if conf.header:
        rows = rows.withColumn("_names", F.array(*map(F.lit, conf.header)))
    elif file is None:
        raise ValueError("without HEADER the column of file names is needed")
    else:
        # one small row for each file; whether it is broadcast is left to its size
        rows = rows.join(_columns_of_files(rows, conf, file, line), F.col(file) == F.col("_head_of"), "left").where(~F.col("_cells").eqNullSafe(F.col("_names"))).drop("_head_of")
    cells = F.when(F.size("_cells") == F.size("_names"), F.map_from_arrays("_names", "_cells"))
    rows = rows.withColumn("cells", F.explode(F.array(cells)))
    parts: dict[str, Column] = {}
    if file and conf.file_time_patterns:
        name = F.element_at(F.split(F.col(file), "/"), -1)
        rows = rows.withColumn("_file_time", F.explode(F.array(times.first_match(list(conf.file_time_patterns), name))))
        stamp = F.timestamp_micros("_file_time")
        parts = {"year": F.year(stamp), "month": F.month(stamp), "day": F.day(stamp)}
    t = F.lit(None).cast("long")
    columns = list(conf.time_columns)
    if len(columns) > 1:
        # several columns are read as one text by the patterns side by side
        text = F.concat_ws(" ", *[F.col("cells")[c] for c in columns])
        t = times.first_match([" ".join(p) for p in zip(*(conf.time_columns[c] for c in columns), strict=False)], text, **parts)
    elif columns:
        t = times.first_match(list(conf.time_columns[columns[0]]), F.col("cells")[columns[0]], **parts)
    rows = rows.withColumn("t", F.explode(F.array(t + int(conf.time_offset * times.MICROS))))
    why = F.when(F.col("cells").isNull(), F.lit("cells")).when(F.col("t").isNull(), F.lit("time"))
    return rows.withColumn("rejected", why).drop("_cells", "_names", "_file_time")


def roll_over(rows: DataFrame, keys: list[str], order: str, t: str = "t", *, part: str = "days", chunk: float = 100_000) -> DataFrame:
    """Adds a day (``part`` months, years: a month, a year) to times that begin anew within a file (keys): each step back of more than half of one.

    order: a number that rises with the records; ``chunk`` of it is windowed at a time, so a long file isn't one task's work.
    """
    months = {"days": 0, "months": 1, "years": 12}[part]
    length = {"days": 1, "months": 31, "years": 366}[part] * 86400 * times.MICROS
    rows = chunks.previous(rows, list(keys), [order], [t], "_before", chunk)
    back = F.when(F.col(t) - F.col(f"_before.{t}") < -length // 2, 1).otherwise(0)
    rows = chunks.running_sum(rows.withColumn("_back", back).drop("_before"), list(keys), [order], F.col("_back"), "_turns", chunk)
    later = F.unix_micros(F.timestamp_micros(F.col(t)) + F.make_ym_interval(F.lit(0), F.col("_turns").cast("int") * months)) if months else F.col(t) + F.col("_turns") * length
    return rows.withColumn(t, later).drop("_back", "_turns")


def samples(rows: DataFrame, conf: CsvConf, keys: list[str] = ()) -> DataFrame:
    """(keys, t, variables) of the records that aren't rejected."""
    return rows.where("rejected is null").select(*keys, "t", *[number(F.col("cells")[f.column], f, conf.strict_texts).alias(f.name) for f in conf.fields])


def version_of(file: Column, versions: list[tuple[int | None, CsvConf]]) -> Column:
    """Which configuration (its place in the list) is for a file: of those with a pattern that its name matches, the one that is valid since last at the time in its name.

    A configuration without a time is valid from the beginning, one without patterns for any name; a file whose name tells no time takes the last one. Null if none is for it.
    """
    name = F.element_at(F.split(file, "/"), -1)
    best = F.lit(None).cast("struct<since: bigint, k: int>")
    for k, (since, conf) in enumerate(versions):
        fits = F.greatest(*[name.rlike(f"^(?:{p})$") for p in conf.file_patterns], F.lit(False)) if conf.file_patterns else F.lit(True)
        at = times.first_match(list(conf.file_time_patterns), name) if conf.file_time_patterns else F.lit(None).cast("long")
        began = F.lit(since if since is not None else -(1 << 62)).cast("long")
        valid = fits & (at.isNull() | (at >= began))
        best = F.greatest(best, F.when(valid, F.struct(began.alias("since"), F.lit(k).alias("k"))))
    return best["k"]


def samples_by_version(spark: SparkSession, path: str, versions: list[tuple[int | None, CsvConf]], keys: list[str] = ("file",)) -> tuple[DataFrame, DataFrame]:
    """(keys, version, t, variables) of the files under a path, each read by the configuration for it, and (file, line, version, rejected) of the records that
    no sample comes from. A file is read once, by its own configuration; the names of the files come to the driver, as they do for any read."""
    names = spark.read.format("binaryFile").load(path).select("path").withColumn("version", version_of(F.col("path"), versions))
    files: dict[int, list[str]] = {}
    for r in names.where("version is not null").collect():
        files.setdefault(r["version"], []).append(r["path"])
    good, bad = [], []
    for k, own in sorted(files.items()):
        conf = versions[k][1]
        found = records(lines_of(spark.read.text(own), conf), conf, file="file").withColumn("version", F.lit(k))
        good.append(samples(found, conf, [*keys, "version"]))
        bad.append(found.where("rejected is not null").select("file", "line", "version", "rejected"))
    if not good:
        raise ValueError(f"no configuration is for the files of {path}")
    for rows in (good, bad):
        while len(rows) > 1:
            rows.append(rows.pop(0).unionByName(rows.pop(0), allowMissingColumns=True))
    return good[0], bad[0]
