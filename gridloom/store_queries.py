"""Queries of array files, ingests, stores and processes on the sample tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bits, metadata, times
from gridloom.operators import bin_average, chunks, grid, mapping, qc
from gridloom.operators.chunks import DAY
from gridloom.plans import hooks, ingest, params, process, retriever, transform
from gridloom.queries import HOUR, HOURS, OBS, START, _average_sql, _days, observations, query, rounded, table
from gridloom.sources import array_source, csv_ingest, scratch, store
from gridloom.streaming import arrivals, inputs, pipelines


@query("SELECT vec_id, label, len(embedding) AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings WHERE label >= 3 AND vec_id > 40")
def array_files_roundtrip(spark, sf_dir):
    """Vectors written as array files by several tasks, and read again: three of the variables, of the records that meet conditions."""
    array_source.register(spark)
    path = scratch.folder(spark, "arrays")
    rows = table(spark, sf_dir, "embeddings").withColumn("weight", F.col("vec_id") / 2)
    rows.repartition(4, "vec_id").sortWithinPartitions("vec_id").write.format(array_source.NAME).option("dim", "row").mode("append").save(path)
    back = array_source.load(spark, path, ["vec_id", "label", "embedding"], [("label", ">=", 3), ("vec_id", ">", 40)], dim="row", nulls="true")
    return back.select("vec_id", "label", F.size("embedding").alias("n"), F.col("embedding")[0].alias("first"), F.element_at("embedding", -1).alias("last"))


def _checked(spark, sf_dir):
    """Events as samples whose steps of more than 40 are bad, and those below 2."""
    e = table(spark, sf_dir, "events").select(times.micros(F.col("ts")).alias("t"), "event_id", F.col("event_type").alias("series"), "value")
    return metadata.with_attributes(e, "value", valid_min=2.0, valid_delta=40.0, missing_value=-9999.0)


class _Stored(process.Process):
    """Stores its input as it is."""

    rows: DataFrame

    def retrieve(self, begin, end):
        self.inputs = {"out": self.rows.where((F.col("t") >= begin) & (F.col("t") < end))}

    def map_outputs(self, begin, end):
        self.outputs = dict(self.transformed)


@query("""WITH e AS (SELECT epoch_us(ts) AS t, event_id, event_type AS series, value FROM events),
p AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY t, event_id) AS before FROM e),
q AS (SELECT event_id, (CASE WHEN value < 2 THEN 2 WHEN before >= 2 AND abs(value - before) > 40 THEN 8 ELSE 0 END)::INTEGER AS qc FROM p)
SELECT event_id, qc AS qc_1, qc AS qc_2, qc AS qc_7 FROM q""")
def process_checks(spark, sf_dir):
    """The same process over one, two and seven intervals: steps are judged across them, from the last sample that each series has in the store."""
    rows = _checked(spark, sf_dir)
    begin, end = rows.agg(F.min("t"), F.max("t") + 1).first()
    found = None
    for parts in (1, 2, 7):
        out = process.Output(scratch.folder(spark, "checked"), ["t", "event_id", "series"], [], standard_checks=True, series=["series"], split_mode="months")
        one = _Stored(spark, {}, {"out": out})
        one.rows = rows
        length = -(-(end - begin) // parts)
        one.run(begin, begin + parts * length, length)
        own = store.read(spark, out.path).select("event_id", F.col("qc_value").alias(f"qc_{parts}"))
        found = own if found is None else found.join(own, "event_id", "full")
    return found


@query("""WITH e AS (SELECT epoch_us(ts) AS t, event_id, event_type, value, date_trunc('day', ts) AS d FROM events), b AS (SELECT min(d) AS d FROM e)
SELECT t, event_id, CASE WHEN e.d >= b.d + INTERVAL 3 DAY AND e.d < b.d + INTERVAL 6 DAY THEN value * 2 ELSE value END AS value FROM e, b
WHERE NOT (e.d >= b.d + INTERVAL 3 DAY AND e.d < b.d + INTERVAL 6 DAY AND (event_type = 'click' OR e.d = b.d + INTERVAL 4 DAY))""")
def reprocess_interval(spark, sf_dir):
    """Three days in the middle of stored months are processed again, with other values and fewer rows, none on one day: the rerun leaves exactly its own rows there."""
    e = table(spark, sf_dir, "events").select(times.micros(F.col("ts")).alias("t"), "event_id", "event_type", "value")
    begin, end = e.agg(F.min("t"), F.max("t")).first()
    first = begin // chunks.DAY * chunks.DAY
    p = _Stored(spark, {}, {"out": process.Output(scratch.folder(spark, "reprocessed"), ["t", "event_id"], [], split_mode="months")})
    p.rows = e
    p.run(first, end + 1, end + 1 - first)
    p.rows = e.where(F.col("event_type") != "click").where(~F.col("t").between(first + 4 * chunks.DAY, first + 5 * chunks.DAY - 1)).withColumn("value", F.col("value") * 2)
    p.run(first + 3 * chunks.DAY, first + 6 * chunks.DAY, 3 * chunks.DAY)
    return store.read(spark, p.output_specs["out"].path).select("t", "event_id", "value")


_ARRIVING = """
HEADER: WHEN, VALUE, EVENT
FILE_NAME_PATTERNS: part-.*[.]txt
TIME_COLUMNS:
  WHEN: %Y-%m-%d %H:%M:%S
FIELD_MAP:
  event_id: EVENT
  value: VALUE
"""


class _LostOnce(arrivals.Arrivals):
    """Loses the driver in the second batch: all is stored, but the stream hasn't committed."""

    lost = False

    def batch(self, lines, n):
        super().batch(lines, n)
        if n == 1 and not self.lost:
            self.lost = True
            raise InterruptedError("the driver is lost here on purpose")


@query("""SELECT epoch_us(date_trunc('second', ts)) AS t, event_id, value, 'archived' AS state FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT NULL, event_id, NULL, 'rejected' FROM events WHERE event_id % 11 = 0""")
def stream_ingest(spark, sf_dir):
    """Files of raw records ingested as they arrive, in batches of which one is run twice: samples, and records that were rejected, once each; the files end in the archive."""
    e = table(spark, sf_dir, "events")
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws(",", F.when(F.col("event_id") % 11 == 0, "never").otherwise(when), "value", "event_id")
    raw, out = scratch.folder(spark, "arriving"), scratch.folder(spark, "arrived")
    e.select(line.alias("value")).repartition(6, "value").write.text(raw)
    output = process.Output(out, ["t", "event_id"], [mapping.Target("value", "value", "double")], split_mode="months")

    class Numbered(ingest.CsvIngest):
        def samples_hook(self, samples):
            return samples.withColumn("event_id", F.col("event_id").cast("long"))

    loop = _LostOnce(Numbered(spark, csv_ingest.parse_conf(_ARRIVING), output, "events"), raw, f"{out}-archive", f"{out}-bad", f"{out}-state", most_files=2)
    try:
        loop.run()
    except StreamingQueryException:
        if not loop.lost:
            raise
    loop.run()
    # the rejected records' lines, as the archive has them
    bad = loop.process.rejected().select(F.element_at(F.split("file", "/"), -1).alias("name"))
    files = spark.read.text(f"{out}-archive").where("value like 'never%'").select("value", F.regexp_extract(F.col("_metadata.file_path"), r"raw\.([^/]*)$", 1).alias("name"))
    counted = bad.groupBy("name").agg(F.count("*").alias("n"))
    # of each file as many as were rejected, or else none
    found = files.groupBy("name").agg(F.collect_list(F.element_at(F.split("value", ","), -1).cast("long")).alias("ids")).join(counted, "name").where(F.size("ids") == F.col("n"))
    rejected = found.select(F.lit(None).cast("long").alias("t"), F.explode("ids").alias("event_id"), F.lit(None).cast("double").alias("value"), F.lit("rejected").alias("state"))
    return store.read(spark, out).select("t", "event_id", "value", F.lit("archived").alias("state")).unionByName(rejected)


def _two_inputs(spark, sf_dir, start, name: str):
    """Clicks and views as two inputs whose files come one a batch, views two batches late; the stream is stopped in the middle and started anew."""
    e = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("user"), "event_id", "value", "event_type")
    low, high = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    path, files = scratch.folder(spark, name), 6
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * files / (high - low + 1)), F.lit(files - 1)).cast("int")
    parts = e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("part", part)
    schema = parts.drop("part", "event_type").schema

    def put(kind: str, k: int) -> None:
        rows = parts.where((F.col("event_type") == kind) & (F.col("part") == k)).drop("part", "event_type")
        rows.coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(f"{path}-{kind}")

    def source(kind: str):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-{kind}")

    out, last = f"{path}-out", 0
    for clicks, views in ((3, 1), (files, files - 2)):
        for kind, n in (("click", clicks), ("view", views)):
            for k in range(0 if not last else last - (2 if kind == "view" else 0), n):
                put(kind, k)
        last = clicks
        pipelines.sink(start(source("click"), source("view")), pipelines.to_folder(out), f"{path}-state").awaitTermination()
    return spark.read.parquet(out).drop("batch")


_INPUTS = """e AS (SELECT ts, epoch_us(ts) AS t, user_id AS user, event_id, value, event_type FROM events), r AS (SELECT min(t) AS low, max(t) AS high FROM e),
p AS (SELECT e.*, least(floor((t - low) * 6 / (high - low + 1)), 5) AS part FROM e, r),
clicks AS (SELECT * FROM p WHERE event_type = 'click'), views AS (SELECT * FROM p WHERE event_type = 'view' AND part < 4)"""


@query(f"""WITH {_INPUTS},
c AS (SELECT t // {6 * HOUR} AS k, user % 5 AS station, value FROM clicks),
v AS (SELECT unnest([t // {6 * HOUR} - 1, t // {6 * HOUR}, t // {6 * HOUR} + 1]) AS k, t, user % 5 AS station, value FROM views),
w AS (SELECT * FROM v WHERE t >= k * {6 * HOUR} - {2 * HOUR} AND t < (k + 1) * {6 * HOUR} + {HOUR}),
x AS (SELECT k, station, count(*) FILTER (s = 1) AS n_clicks, count(*) FILTER (s = 2) AS n_views, avg(value) FILTER (s = 1) AS a, max(value) FILTER (s = 2) AS b
  FROM (SELECT k, station, value, 1 AS s FROM c UNION ALL SELECT k, station, value, 2 FROM w) GROUP BY k, station)
SELECT k * {6 * HOUR} AS t, station, n_clicks, n_views, round(a, 6) AS clicks_value, b AS views_value FROM x
WHERE k * {6 * HOUR} <= least((SELECT max(k) FROM c), (SELECT max(k) FROM w)) * {6 * HOUR} - {12 * HOUR}""")
def stream_two_inputs(spark, sf_dir):
    """Intervals of six hours of two streams, one wanted from two hours before to one after; those that the slower input has passed by half a day."""

    def start(clicks, views):
        station = lambda rows: rows.withColumn("station", F.col("user") % 5)
        both = {"clicks": inputs.Stream(station(clicks), max_wait="12 hours"), "views": inputs.Stream(station(views), "2 hours", "1 hour", "12 hours")}
        return inputs.intervals(both, ["station"], "6 hours", {"clicks": {"value": F.avg}, "views": {"value": F.max}})

    rows = _two_inputs(spark, sf_dir, start, "intervals")
    return rows.select(F.unix_micros("begin").alias("t"), "station", "n_clicks", "n_views", F.round("clicks_value", 6).alias("clicks_value"), "views_value")


@query(f"""WITH {_INPUTS}
SELECT c.event_id, v.event_id AS view_id, v.t - c.t AS apart FROM clicks c JOIN views v ON v.user = c.user AND v.t BETWEEN c.t - {6 * HOUR} AND c.t + {HOUR}""")
def stream_pairs(spark, sf_dir):
    """Each click with the same user's views from six hours before it to one after, as both arrive."""

    def start(clicks, views):
        return inputs.paired(inputs.Stream(clicks, max_wait="3 days"), inputs.Stream(views, "6 hours", "1 hour", "3 days"), ["user"])

    rows = _two_inputs(spark, sf_dir, start, "pairs")
    return rows.select("event_id", F.col("right_event_id").alias("view_id"), (F.unix_micros("right_ts") - F.unix_micros("ts")).alias("apart"))


_SPANNING = """
TIME_COLUMNS:
  WHEN: %Y-%m-%d %H:%M:%S
MULTILINE: yes
FIELD_MAP:
  value: VALUE
  event_id: EVENT
"""


@query("""SELECT event_id, epoch_us(date_trunc('second', ts)) AS t, value, CASE WHEN event_id % 3 = 0 THEN 'first, "' || event_type || chr(34) || chr(10) || 'it''s the second' || chr(10) ELSE event_type END AS remark FROM events""")
def csv_multiline(spark, sf_dir):
    """Raw files whose quotes hold line ends, delimiters and other quotes, cut into many blocks: whole records, wherever a block ends."""
    e = table(spark, sf_dir, "events")
    remark = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"first, ""'), "event_type", F.lit('""\nit\'s the second\n"'))).otherwise(F.col("event_type"))
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "value", remark, "event_id")
    path = scratch.folder(spark, "spanning")
    head = spark.createDataFrame([(0, "WHEN,VALUE,REMARK,EVENT")], "o int, value string")
    for k in range(2):
        rows = e.where(F.col("event_id") % 2 == k).select(F.lit(1).alias("o"), line.alias("value"))
        head.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{path}/{k}")
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    # blocks of a sixteenth of the table
    size = e.count() * 80 // 16
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", max(4096, size))
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        conf = csv_ingest.parse_conf(_SPANNING)
        lines = csv_ingest.read_lines(spark, f"{path}/*", conf)
    finally:
        for c, value in held.items():
            spark.conf.set(c, value)
    found = csv_ingest.records(lines, conf, file="file").where("rejected is null")
    return found.select(F.col("cells")["EVENT"].cast("long").alias("event_id"), "t", F.col("cells")["VALUE"].cast("double").alias("value"), F.col("cells")["REMARK"].alias("remark"))


_LOG_BINS = """bins AS (SELECT series, k AS bin, CASE WHEN k = 0 THEN 0.0 ELSE pow(2.0, k - 1) END::DOUBLE AS lo, pow(2.0, k)::DOUBLE AS hi FROM (SELECT DISTINCT series FROM obs), (SELECT unnest(generate_series(0, 24)) AS k)),
cells AS (SELECT series, value, qc, (coord - (SELECT min(coord) FROM obs)) / 1000000.0 AS i0, (coord - (SELECT min(coord) FROM obs)) / 1000000.0 + pow(4.0, event_id % 9) AS i1 FROM obs),
met AS (SELECT series, bin, value, qc, 1.0 AS weight, 1 - greatest(0, (lo - i0) / (i1 - i0)) - greatest(0, (i1 - hi) / (i1 - i0)) AS share,
  (1 - greatest(0, (lo - i0) / (i1 - i0)) - greatest(0, (i1 - hi) / (i1 - i0))) * (i1 - i0) AS span FROM bins JOIN cells USING (series) WHERE i1 >= lo AND i0 < hi)"""


@query(f"WITH {OBS}, {_LOG_BINS}, {_average_sql('bins', 'met', 'series, bin').format(columns='series, bin, lo, hi')}")
def bin_average_irregular(spark, sf_dir):
    """Samples that last from a second to 18 hours into bins each twice as wide as the one before, given by a bounds variable."""
    rows = observations(spark, sf_dir, "event_id")
    start = rows.agg(F.min("coord")).first()[0]
    begin = (F.col("coord") - start) / 1_000_000
    cells = rows.select("series", begin.alias("lo"), (begin + F.pow(F.lit(4.0), F.col("event_id") % 9)).alias("hi"), "value", "qc")
    edges = F.struct(F.when(F.col("k") == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("k") - 1)).alias("lo"), F.pow(F.lit(2.0), F.col("k")).alias("hi"))
    bounds = rows.select("series").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")))).withColumn("bounds", edges)
    bins = grid.from_bounds(bounds, "bounds", "k").select("series", "bin", "lo", "hi")
    return rounded(bin_average.average_cells(cells, bins, ["series"]), "value", "value_std", "value_goodfraction")


_PROPS = f"""props AS (SELECT series, low + k * {5 * chunks.DAY + 5 * HOUR} AS start, [{6 * HOUR}, {HOUR}, {11 * HOUR}][k + 1] AS width, low + {HOUR // 2} AS origin
  FROM (SELECT series, min(coord) AS low FROM obs GROUP BY series), (SELECT unnest([0, 1, 2]) AS k)),
reach AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY series ORDER BY start), (SELECT max(coord) + 1 FROM obs)) AS until FROM props),
bins AS (SELECT series, greatest(origin + k * width, start) AS lo, least(origin + (k + 1) * width, until) AS hi FROM (
  SELECT *, unnest(generate_series(floor((start - origin) / width)::BIGINT, ceil((until - origin) / width)::BIGINT - 1)) AS k FROM reach WHERE start < until)),
met AS (SELECT o.series, lo, value, qc, 1.0 AS share, 1.0 AS span, 1.0 AS weight FROM bins b JOIN obs o ON o.series = b.series AND coord >= lo AND coord < hi)"""


@query(f"WITH {OBS}, {_PROPS}, {_average_sql('bins', 'met', 'series, lo').format(columns='series, lo, hi')}")
def bin_average_by_properties(spark, sf_dir):
    """Bins of six hours, then of one, then of eleven, cut where the width changes, which is at other times for each series."""
    rows = observations(spark, sf_dir)
    end = rows.agg(F.max("coord")).first()[0] + 1
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(width).alias("width")) for n, width in enumerate((6 * HOUR, HOUR, 11 * HOUR))]))
    props = rows.groupBy("series").agg(F.min("coord").alias("low")).withColumn("k", k)
    props = props.select("series", (F.col("low") + F.col("k.n") * (5 * chunks.DAY + 5 * HOUR)).alias("start"), "k.width", (F.col("low") + HOUR // 2).alias("origin"))
    found = bin_average.average_by_properties(rows, props, ["series"], "coord", end, chunks.DAY)
    return rounded(found, "value", "value_std", "value_goodfraction")


@query("""WITH e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) WHERE label IS NOT NULL),
f AS (SELECT *, x < -0.25 OR x > 0.3 AS bad FROM e),
d AS (SELECT *, lag(x) OVER r AS px, lag(bad) OVER r AS pbad, lag(x, 8) OVER a AS ax, lag(bad, 8) OVER a AS abad, CASE WHEN (i - 1) % 8 > 0 THEN lag(x) OVER a END AS bx, lag(bad) OVER a AS bbad
  FROM f WINDOW r AS (PARTITION BY label, i ORDER BY vec_id), a AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, list((CASE WHEN x < -0.25 THEN 2 WHEN x > 0.3 THEN 4 ELSE 0 END | CASE WHEN NOT bad AND NOT pbad AND abs(x - px) > 0.3 THEN 16 ELSE 0 END
  | CASE WHEN NOT bad AND NOT abad AND abs(x - ax) > 0.25 THEN 32 ELSE 0 END | CASE WHEN NOT bad AND NOT bbad AND abs(x - bx) > 0.2 THEN 64 ELSE 0 END)::INTEGER ORDER BY i)::VARCHAR AS qc FROM d GROUP BY vec_id""")
def qc_delta_arrays(spark, sf_dir):
    """Vectors as records of eight by eight: limits, and steps to the vector before of the same label and along both axes."""
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = e.withColumn("q", qc.limits_arrays(F.col("v"), low=-0.25, high=0.3, low_flag=2, high_flag=4))
    found = qc.delta_arrays(rows, ["label"], ["vec_id"], "v", "q", [8, 8], [0.3, 0.25, 0.2], [16, 32, 64], 1000)
    return found.select("vec_id", F.concat(F.lit("["), F.array_join(F.transform("q", lambda x: x.cast("string")), ", "), F.lit("]")).alias("qc"))


_OLD_LAYOUT = """
HEADER: WHEN, VALUE, EVENT
FILE_NAME_PATTERNS: met[.].*[.]csv
FILE_TIME_PATTERNS: met[.]%0Y%0m%0d[.]csv
TIME_COLUMNS:
  WHEN: %Y-%m-%d %H:%M:%S
FIELD_MAP:
  value: VALUE, degC
  event_id: EVENT
"""
_NEW_LAYOUT = _OLD_LAYOUT.replace("HEADER: WHEN, VALUE, EVENT", "DELIMITER: ;\nHEADER: EVENT, WHEN, VALUE")


@query("""SELECT event_id, epoch_us(date_trunc('second', ts)) AS t, value, (CASE WHEN date_trunc('day', ts) >= (SELECT date_trunc('day', min(ts)) + INTERVAL 10 DAY FROM events) THEN 1 ELSE 0 END)::INTEGER AS version FROM events""")
def csv_conf_versions(spark, sf_dir):
    """Raw files of five days each, in one layout up to the tenth day and in another one since: each is read by the configuration that is valid at its time."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.date_trunc("day", F.min("ts")).cast("timestamp").alias("a"), F.max("ts").alias("b")).select(F.unix_micros("a"), F.unix_micros("b")).first()
    path = scratch.folder(spark, "versions")
    when, step = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), 5 * chunks.DAY
    folder = store._Folder(spark, path)
    for k in range((last - first) // step + 1):
        line = F.concat_ws(",", when, "value", "event_id") if k < 2 else F.concat_ws(";", "event_id", when, "value")
        part = F.unix_micros("ts").between(first + k * step, first + (k + 1) * step - 1)
        e.where(part).select(line.alias("value")).coalesce(1).write.text(f"{path}/made-{k}")
        for x in folder.files.listStatus(folder.child(f"made-{k}")):
            if x.getPath().getName().startswith("part-"):
                folder.files.mkdirs(folder.child("raw"))
                folder.files.rename(x.getPath(), folder.child(f"raw/met.{times.name_stamp(first + k * step)[:8]}.csv"))
    versions = [(None, csv_ingest.parse_conf(_OLD_LAYOUT)), (first + 2 * step, csv_ingest.parse_conf(_NEW_LAYOUT))]
    rows, _ = csv_ingest.samples_by_version(spark, f"{path}/raw", versions)
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "t", "value", "version")


@query(f"""WITH e AS (SELECT epoch_us(ts) AS t, event_type AS series FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series ORDER BY t) <= {HOUR} THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT series, min(t) AS begin_t, max(t) AS end_t, count(*) AS n FROM r GROUP BY series, run""")
def hook_table_function(spark, sf_dir):
    """Runs of samples without a gap of over an hour, by a user's table function over ordered partitions, in the hook of a process."""

    class Sessions(_Stored):
        def process_data_hook(self, begin, end):
            runs = hooks.apply(self.outputs["out"], hooks.Runs, ["series"], ["t"], keys="series", time="t", gap=HOUR)
            self.outputs["out"] = runs.withColumnsRenamed({"begin": "t"})

    e = table(spark, sf_dir, "events").select(times.micros(F.col("ts")).alias("t"), F.col("event_type").alias("series"))
    begin, end = e.agg(F.min("t"), F.max("t")).first()
    out = process.Output(scratch.folder(spark, "runs"), ["series", "t"], [], split_mode="months")
    one = Sessions(spark, {}, {"out": out})
    one.rows = e
    one.run(begin, end + 1, end + 1 - begin)
    return store.read(spark, out.path).select("series", F.col("t").alias("begin_t"), F.col("end").alias("end_t"), "n")


@query(f"""WITH {OBS}, {HOURS}, g AS (SELECT series, (coord - {START}) // {HOUR} AS bin, value, qc, value IS NOT NULL AND qc & 1 = 0 AS good FROM obs),
m AS (SELECT series, bin, median(value) FILTER (good) AS v, count(*) AS n, count(*) FILTER (NOT good) AS bad, coalesce(bit_or(qc) FILTER (good), 0) AS q FROM g GROUP BY series, bin)
SELECT h.series, h.bin, round(v, 6) AS value, (CASE WHEN n IS NULL THEN {bits.OUTSIDE | bits.BAD} ELSE CASE WHEN n = bad THEN {bits.ALL_BAD | bits.BAD} ELSE 0 END | CASE WHEN bad > 0 THEN {bits.SOME_BAD} ELSE 0 END
  | CASE WHEN q & 2 <> 0 THEN {bits.INDETERMINATE} ELSE 0 END END)::INTEGER AS qc FROM hours h LEFT JOIN m USING (series, bin)""")
def transform_registered(spark, sf_dir):
    """Hourly medians by a transform that a user has registered: a grouped-aggregate function over each bin's good values."""

    @F.pandas_udf("double")
    def median(x: pd.Series) -> float:
        return float(x.median())

    hooks.register_aggregate("hourly_median", median, HOUR, alignment=0.0)
    rows = observations(spark, sf_dir)
    found = transform.transform(rows, grid.per_series(rows, ["series"], "coord", HOUR, start=F.lit(START)), ["series"], "hourly_median", chunk=chunks.DAY)
    return rounded(found.select("series", "bin", "value", "qc"), "value")


_LINEAGE = "time: bin_average (width: 7200000000 alignment: 0)"


@query(f"""SELECT event_type AS series, ({START} + (epoch_us(ts) - {START}) // {2 * HOUR} * {2 * HOUR})::DOUBLE AS coord, round(avg(value) * 3.6, 6) AS wind,
  CASE WHEN event_type = 'click' THEN 'backup' ELSE 'main' END AS source, 'main, backup' AS source_dataset, 'speed' AS source_variable, '{_LINEAGE}' AS cell_transform, 'km/h' AS units, 180.0::DOUBLE AS valid_max
FROM events GROUP BY 1, 2""")
def provenance_stored(spark, sf_dir):
    """Two-hourly means of what two sources have under different names and units, stored and read again: where they come from is read with them."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), times.micros(F.col("ts")).alias("coord"), "value")
    low, high = _days(e, "coord")
    main = metadata.with_attributes(e.where("series <> 'click'").withColumnRenamed("value", "speed"), "speed", units="m/s", valid_max=50.0)
    backup = metadata.with_attributes(e.withColumn("velocity", F.col("value") * 100).drop("value"), "velocity", units="cm/s", valid_max=6000.0)
    group = retriever.Group("winds", [("main", lambda s: main), ("backup", lambda s: backup)], [retriever.Wanted("value", ["speed", "velocity"], unit="km/h")], ["series"], "coord")
    found = retriever.retrieve_group(spark, group, low, high).withColumnRenamed("qc_value", "qc")
    by_time = params.parse(f"value:transform = bin_average; time:interval = {2 * HOUR}; time:start = {START}; time:alignment = 0;")
    means = transform.by_parameters(found, ["series", "source"], by_time, "value", "time", chunk=DAY)
    rows = mapping.map_outputs(means.withColumn("t", F.col("coord").cast("long")), ["series", "source", "t"], [mapping.Target("wind", "value")], dynamic=True)
    path = scratch.folder(spark, "lineage")
    store.write(rows, path, mode="months")
    stored = store.read(spark, path)
    held = metadata.attributes(stored, "wind")
    said = [F.lit(held.get(k)).alias(k) for k in ("source_dataset", "source_variable", "cell_transform", "units")]
    return stored.where("wind is not null").select("series", F.col("t").cast("double").alias("coord"), F.round("wind", 6).alias("wind"), "source", *said, F.round(F.lit(held.get("valid_max")).cast("double"), 6).alias("valid_max"))
