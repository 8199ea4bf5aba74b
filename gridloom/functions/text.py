"""Text and array functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_array(text: Column, kind: str, delimiter: str = r"[,\s]+", fill: float | None = None) -> Column:
    """Delimited text as an array; parts that aren't of the kind become ``fill``."""
    parts = F.filter(F.split(F.trim(text), delimiter), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(x.try_cast(kind), F.lit(fill).cast(kind)))


def from_array(values: Column, delimiter: str = ", ") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), delimiter)


def first_difference(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Index (from 0) of the first pair that differs by more than the threshold, or where one array ends; -1 if none."""
    apart = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.coalesce(F.abs(p["a"] - p["b"]) > threshold, F.lit(True)))
    return F.array_position(apart, True).cast("long") - 1


def differ(a: Column, b: Column, threshold: float = 0.0) -> Column:
    return first_difference(a, b, threshold) >= 0


def numeric_keys(text: Column) -> list[Column]:
    """Sort keys: the numbers in a text one after another, then the text."""
    return [F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)")), lambda x: x.cast("decimal(38,0)")), text]


def count_delimiters(line: Column, delimiter: str = ",") -> Column:
    """Delimiters outside quotes."""
    return (F.size(_cells(line, delimiter)) - 1).cast("int")


#: A regular expression takes a cell with so many quotes on the stack of its matcher; lines with more are read piece by piece.
_MOST_QUOTES = 1000


def _cells(line: Column, delimiter: str) -> Column:
    """The cells between the delimiters that stand outside quotes, as they are.

    From left to right a quote, single or double, opens and the next of its kind closes; one that is never closed holds the rest of the line.
    """
    d = re.escape(delimiter)
    cut = f"{d}+" if delimiter == " " else d
    plain = f"[^{d}\"']*+" if len(delimiter) == 1 else f"(?:(?!{d})[^\"'])*+"
    cell = f"{plain}(?:(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)){plain})*+"
    # each match takes a delimiter, so none is empty
    fast = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f"(?s){cut}({cell})"), F.lit(1))
    quotes = F.length(line) - F.length(F.translate(line, "\"'", ""))
    # the same by single quoted, plain and cutting pieces: cuts become marks that nothing else in the line can be, as its own \x01 are marked too
    pieces = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f"(?s)\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|{cut}|{plain[:-2]}++"), F.lit(0))
    marked = F.transform(pieces, lambda x: F.when(x.startswith(delimiter), F.lit("\x01b")).otherwise(F.replace(x, F.lit("\x01"), F.lit("\x01a"))))
    cells = F.split(F.array_join(marked, ""), "\x01b")
    slow = F.transform(F.slice(cells, 2, F.size(cells)), lambda x: F.replace(x, F.lit("\x01a"), F.lit("\x01")))
    return F.when(quotes > _MOST_QUOTES, slow).otherwise(fast)


def split_delimited(line: Column, delimiter: str = ",") -> Column:
    """Fields of a delimited line: quotes of either kind hold delimiters, a doubled quote inside double ones is one, fields are trimmed, a run of spaces counts as
    one delimiter. Quotes around a whole field go; those that are never closed, or stand inside it, stay."""
    line = F.trim(line) if delimiter == " " else line

    def bare(x: Column) -> Column:
        x = F.regexp_replace(x, r"^[\s]+|[\s]+$", "") if delimiter != "\t" else F.trim(x)
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        return F.when((F.length(x) > 1) & x.startswith('"') & x.endswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when((F.length(x) > 1) & x.startswith("'") & x.endswith("'"), inner).otherwise(x)

    return F.transform(_cells(line, delimiter), bare)


def version_parts(text: Column) -> Column:
    """struct(major, minor, micro); missing parts are 0."""
    part = lambda k: F.coalesce(F.get(F.split(text, r"\."), F.lit(k)).try_cast("int"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("micro"))


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """Index of the first pattern found in the text, or -1."""
    out = F.lit(-1)
    for k in reversed(range(len(patterns))):
        out = F.when(text.rlike(patterns[k]), F.lit(k)).otherwise(out)
    return out
