"""Records of delimited files that span lines, as quotes hold line ends.

Whether a line begins inside quotes depends on all before it. So each block of a file (what one task reads) is first summed up as a map from
the quote that is open where it begins (none, double or single) to the one that is open where it ends; the maps of a file's blocks, one small
row for each, are composed in order; then every block knows how it begins, and is joined by itself. Only the records across the edges of blocks are put together
from their pieces, one or a few a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources import scratch

_QUOTES = re.compile("[\"']")
STATES = ("", '"', "'")
#: Characters of a record at most; more of them are a quote that was never closed, and fail the job.
MOST_CHARACTERS = 64 << 20


def after(state: str, line: str) -> str:
    """The quote that is open after a line, given the one before it."""
    for quote in _QUOTES.findall(line):
        state = quote if not state else "" if state == quote else state
    return state


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, order = {}, []
    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) not in held:
                held[file, block] = STATES
                order.append((file, block))
            if '"' in line or "'" in line:
                held[file, block] = tuple(after(s, line) for s in held[file, block])
    rows = [(*key, list(held[key])) for key in order]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.list_(pa.string())))], ["file", "block", "ends"])


def entering(lines: DataFrame) -> DataFrame:
    """(file, block, state): the quote that is open where each block begins. A row for each block."""
    maps = lines.select("file", F.col("at.block").alias("block"), F.coalesce("line", F.lit("")).alias("line")).mapInArrow(_maps, "file string, block long, ends array<string>")
    through = lambda state, ends: F.when(state == "", ends[0]).when(state == '"', ends[1]).otherwise(ends[2])
    blocks = maps.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("b"))
    step = lambda s, x: F.struct(through(s["state"], x["ends"]).alias("state"), F.concat(s["found"], F.array(F.struct(x["block"].alias("block"), s["state"].alias("state")))).alias("found"))
    start = F.struct(F.lit("").alias("state"), F.array().cast("array<struct<block: bigint, state: string>>").alias("found"))
    return blocks.select("file", F.explode(F.aggregate("b", start, step, lambda s: s["found"])).alias("x")).select("file", "x.block", "x.state")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, row, piece, line): records of each block; piece tells those that began before it (-1) and go on after it (1) from whole ones (0).

    One that does both (2) is a whole block inside quotes.
    """
    key, state, own, at, began, size = None, "", [], 0, True, 0
    out: list[tuple] = []

    def settle(goes_on: bool) -> None:
        nonlocal own, size
        if own:
            kind = (2 if goes_on else -1) if not began else 1 if goes_on else 0
            out.append((*key, at, kind, "\n".join(own)))
        own, size = [], 0

    for batch in batches:
        for file, block, row, line, first in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != key:
                if key is not None:
                    settle(True)
                key, state, at, began = (file, block), first, row, not first
            if not own:
                at = row
            own.append(line)
            size += len(line)
            if size > MOST_CHARACTERS:
                raise ValueError(f"a quote of {file} isn't closed within {MOST_CHARACTERS} characters")
            state = after(state, line) if '"' in line or "'" in line else state
            if not state:
                settle(False)
                began = True
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 5, kinds)], ["file", "block", "row", "piece", "line"])
        out.clear()
    if key is not None:
        settle(True)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 5, kinds)], ["file", "block", "row", "piece", "line"])


def joined(lines: DataFrame) -> DataFrame:
    """(file, line, at): the records of the lines (file, line, at) of files, whose line ends inside quotes are LF."""
    # one row for each block of a file, so about a millionth of the files' size
    states = scratch.written(entering(lines), "quotes")
    rows = lines.select("file", F.col("at.block").alias("block"), F.col("at.row").alias("row"), F.coalesce("line", F.lit("")).alias("line"))
    rows = rows.join(F.broadcast(states), ["file", "block"]).select("file", "block", "row", "line", "state")
    found = scratch.written(rows.mapInArrow(_pieces, "file string, block long, row long, piece byte, line string"), "records")
    whole = found.where("piece = 0").select("file", "line", F.struct("block", "row").alias("at"))
    # a record across blocks: its first piece, whole blocks, its last piece; numbered by the first pieces so far
    parts = found.where("piece <> 0")
    ends = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "row", "piece"))).alias("p"))
    step = lambda s, x: F.struct(
        F.when(x["piece"] == 1, F.struct(x["block"], x["row"])).otherwise(s["begin"]).alias("begin"),
        F.concat(s["found"], F.array(F.struct(x["block"].alias("block"), x["row"].alias("row"), F.when(x["piece"] == 1, F.struct(x["block"], x["row"])).otherwise(s["begin"]).alias("begin")))).alias("found"),
    )
    kind = "struct<block: bigint, row: bigint>"
    start = F.struct(F.lit(None).cast(kind).alias("begin"), F.array().cast(f"array<struct<block: bigint, row: bigint, begin: {kind}>>").alias("found"))
    named = ends.select("file", F.explode(F.aggregate("p", start, step, lambda s: s["found"])).alias("x")).select("file", "x.block", "x.row", "x.begin")
    across = parts.join(named, ["file", "block", "row"]).groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("block", "row", "line"))).alias("p"))
    return whole.unionByName(across.select("file", F.array_join(F.col("p.line"), "\n").alias("line"), F.col("begin").alias("at")))
