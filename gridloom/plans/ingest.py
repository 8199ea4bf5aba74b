"""An ingest as a process: files of delimited text into a stored dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import mapping, overlap
from gridloom.plans.process import Output, Process
from gridloom.sources import csv_ingest, scratch, store


class CsvIngest(Process):
    """Subclass it and override hooks. Files are read in parallel, whatever their number; one ingest is one pass over their lines.

    Records are parsed by the configuration, rejected ones are kept apart with the reason, samples are mapped, filtered and checked as those of any process,
    those that are stored already (by the output's keys) are left out, and the rest is added to the splits of its times.
    """

    def __init__(self, spark: SparkSession, conf: csv_ingest.CsvConf, output: Output, name: str = "raw", order: str | None = None):
        super().__init__(spark, {}, {name: output})
        self.conf, self.name, self.order = conf, name, order
        #: Records of the ingest that ran last, with file, line, cells, t and rejected.
        self.records: DataFrame | None = None

    def read_files(self, path: str) -> DataFrame:
        return csv_ingest.read_lines(self.spark, path, self.conf)

    def records_hook(self, records: DataFrame) -> DataFrame:
        """Records with file, line, cells, t and rejected."""
        return records

    def samples_hook(self, samples: DataFrame) -> DataFrame:
        return samples

    def stored(self, begin: int, end: int) -> DataFrame | None:
        """The stored samples of [begin, end); only files that reach it are read."""
        spec = self.output_specs[self.name]
        return store.read(self.spark, spec.path, begin, end, fmt=spec.fmt)

    def rejected(self) -> DataFrame | None:
        """(file, line, rejected, t) of all records that were rejected so far, t being the time of the ingest."""
        return store.read(self.spark, f"{self.output_specs[self.name].path}-rejected")

    def ingest(self, path: str, batch: str | None = None) -> dict[str, int]:
        """Runs over the files under a path; returns how many records were read and rejected, and how many samples were stored.

        A batch that has a name is stored once: run again after a failure, or twice, it adds neither samples nor rejected records.
        """
        return self.ingest_lines(self.read_files(path), batch)

    def ingest_lines(self, lines: DataFrame, batch: str | None = None) -> dict[str, int]:
        spec = self.output_specs[self.name]
        kind = {"mode": spec.split_mode, "interval": spec.split_interval, "start": spec.split_start, "tz_hours": spec.tz_hours, "fmt": spec.fmt}
        records = self.records_hook(csv_ingest.records(lines, self.conf, file="file"))
        # counted, split and mapped from one place
        self.records = records = scratch.written(records, "records")
        counts = records.agg(F.count("*").alias("records"), F.count("rejected").alias("rejected")).first()
        samples = self.samples_hook(csv_ingest.samples(records, self.conf, ["file"]))
        rows = mapping.map_outputs(samples, spec.keys, spec.targets, dynamic=spec.dynamic)
        extent = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
        n = 0
        if extent["a"] is not None:
            self.interval = extent["a"], extent["b"] + 1
            rows = self.filtered(self.name, rows)
            old = self.stored(*self.interval)
            if old is not None:
                types = {f.name: f.dataType for f in rows.schema}
                rows = overlap.not_stored(rows, old.select(*[F.col(k).cast(types[k]).alias(k) for k in spec.keys]), spec.keys)
            rows = scratch.written(rows, "samples")
            n = rows.count()
        if counts["rejected"]:
            # a file that is read again brings no new rejects: file and line tell records apart
            bad = records.where("rejected is not null").select("file", "line", "rejected")
            held = self.rejected()
            if held is not None:
                bad = overlap.not_stored(bad, held.select("file", "line", "rejected"), ["file", "line", "rejected"])
            bad = scratch.written(bad.dropDuplicates().withColumn("t", F.unix_micros(F.current_timestamp())), "rejected")
            if not bad.isEmpty():
                store.write(bad, f"{spec.path}-rejected", mode="months", batch=batch)
        if n and not store.write(rows, spec.path, batch=batch, **kind):
            n = 0
        return {"records": counts["records"], "rejected": counts["rejected"], "stored": n}
