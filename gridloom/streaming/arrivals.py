"""An ingest of files as they arrive: a stream of batches, each stored once, and what becomes of the files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.plans.ingest import CsvIngest
from gridloom.sources import csv_ingest, multiline, store
from gridloom.streaming import pipelines


@dataclass
class Arrivals:
    """Ingests the files that come into a folder, in batches.

    A batch stores its samples, rejected records and a ledger of its files under its number, each by one commit; a batch that is run
    again, as after a lost driver, finds them and stores nothing twice. Files are moved only when the stream has committed their batch, since a batch that
    runs again reads them again: those with samples go to the archive, under the time of their first one, those without any to the quarantine.
    A moved file that is there already with the same content goes; with other content it stays where it came, and ``run`` names it.
    Files without lines, and those whose names no pattern of the configuration matches, stay. A stream reads a path once: a file that comes later needs
    another name or folder (``source`` may have wildcards).
    """

    process: CsvIngest
    source: str
    archive: str
    quarantine: str
    checkpoint: str
    #: Files of a batch at most: their names and times come to the driver.
    most_files: int = 100

    def __post_init__(self) -> None:
        self.spark, self.name = self.process.spark, self.process.name
        self.left: list[str] = []
        self.ledger_path = f"{self.process.output_specs[self.name].path}-files"

    def lines(self) -> DataFrame:
        found = self.spark.readStream.schema("value string").option("maxFilesPerTrigger", self.most_files).text(self.source)
        found = found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"))
        return csv_ingest.of_patterns(found, self.process.conf)

    def batch(self, lines: DataFrame, n: int) -> None:
        """One batch; override it to do more with its rows."""
        self.settle()
        # a stream's rows have no numbers, those of a batch do
        lines = lines.select("file", "line", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("at"))
        lines = multiline.joined(lines) if self.process.conf.multiline else lines
        self.process.ingest_lines(lines, f"{self.name}-{n}")
        rows = self.process.records.groupBy("file").agg(
            F.count("*").alias("records"), F.count("rejected").alias("rejected"), F.min(F.when(F.col("rejected").isNull(), F.col("t"))).alias("begin"), F.max(F.when(F.col("rejected").isNull(), F.col("t"))).alias("end")
        )
        rows = rows.withColumns({"t": F.unix_micros(F.current_timestamp()), "batch": F.lit(n).cast("long")})
        store.write(rows, self.ledger_path, mode="months", batch=f"{self.name}-{n}")

    def ledger(self) -> DataFrame | None:
        """(file, records, rejected, begin, end, t, batch) of every file that was ingested; t is when."""
        return store.read(self.spark, self.ledger_path)

    def committed(self) -> int:
        """The number of the last batch that the stream won't run again, or -1."""
        folder = store._Folder(self.spark, self.checkpoint)
        at = folder.child("commits")
        return max((int(x.getPath().getName()) for x in folder.files.listStatus(at) if x.getPath().getName().isdigit()), default=-1) if folder.files.exists(at) else -1

    def settle(self) -> None:
        """Moves the files of the batches that are committed; ``left`` gets those that stay as another file has their new name."""
        rows, last = self.ledger(), self.committed()
        if rows is None:
            return
        folder = store._Folder(self.spark, self.checkpoint)
        mark = folder.child("settled")
        done = max((int(x.getPath().getName()) for x in folder.files.listStatus(mark)), default=-1) if folder.files.exists(mark) else -1
        if last <= done:
            return
        for r in rows.where((F.col("batch") > done) & (F.col("batch") <= last)).collect():
            at = r["begin"] if r["begin"] is not None else r["t"]
            kind, to = ("raw", self.archive) if r["begin"] is not None else ("bad", self.quarantine)
            if not self._move(r["file"], f"{to}/{self.new_name(r['file'], at, kind)}"):
                self.left.append(r["file"])
        folder.files.mkdirs(folder.child(f"settled/{last}"))

    def new_name(self, file: str, at: int, kind: str) -> str:
        return f"{self.name}.{times.name_stamp(at)}.{kind}.{file.rpartition('/')[2]}"

    def _move(self, file: str, to: str) -> bool:
        old, new = store._Folder(self.spark, file), store._Folder(self.spark, to)
        if not old.files.exists(old.at):
            return True  # moved before
        if new.files.exists(new.at):
            sums = self.spark.read.format("binaryFile").load([file, to]).select(F.md5("content")).distinct().count()
            if sums > 1:
                return False
            old.files.delete(old.at, False)
            return True
        new.files.mkdirs(new.at.getParent())
        return old.files.rename(old.at, new.at)

    def run(self, available_now: bool = True) -> list[str]:
        """Ingests what is there (or, without available_now, what comes until the stream is stopped); gives the files that couldn't be moved."""
        self.left = []
        self.settle()
        pipelines.sink(self.lines(), self.batch, self.checkpoint, available_now=available_now).awaitTermination()
        self.settle()
        return self.left
