"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Labels may be learnt only from rows whose crc32(doc_id as text) mod 3 differs from this.
HELD_OUT_REMAINDER = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a private one only in a local session that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors and the lineage is cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which may be long after an iterative job has filled the disks with those of its past rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/gridloom-{uuid.uuid4().hex}/{tag}"


def held_out(doc_id="doc_id"):
    """True for the rows that are kept for evaluation (null doc_id: never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == HELD_OUT_REMAINDER, F.lit(False))


def training_ids(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled training rows (doc_id, label), chosen by a hash of doc_id.

    The bound makes the result safe to broadcast. Rows with a null label or doc_id are left out;
    of several labels of one document the largest counts.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


#: Rows and bytes that a Python worker gets at a time; the usual 10,000 rows are too many for long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; lower ones stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    held = spark.conf.get(size)
    if not (held.rstrip("b").isdigit() and 0 < int(held.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(size, f"{BATCH_BYTES}b")


def training_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of the bounded training sample; of several texts of one doc_id the smallest."""
    bounded_batches(docs.sparkSession)
    ids = training_ids(labels, label, bound)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def utf8_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ddl(kind: DataType) -> str:
    """A type as text, with the names in it quoted where they need it."""
    if isinstance(kind, StructType):
        return f"struct<{', '.join(f'{quoted(f.name)}: {ddl(f.dataType)}' for f in kind)}>"
    return kind.simpleString()


def packed(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and all others in the struct _row, so that no working column can clash with them."""
    others = [F.col(quoted(c)).alias(c) for c in docs.columns if c not in named]
    return docs.select(*[F.col(quoted(c)) for c in named], F.struct(*others or [F.lit(0).alias("_")]).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], named: Iterable[str], *appended: str) -> DataFrame:
    """The columns that were packed, in their order, then the appended ones; those replace columns of the same name."""
    named = set(named)
    kept = [F.col(quoted(c)) if c in named else F.col(f"_row.{quoted(c)}").alias(c) for c in columns if c not in appended]
    return rows.select(*kept, *[F.col(quoted(c)) for c in appended])


def map_rows(rows: DataFrame, make, appended: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``rows`` with columns appended that ``make()`` computes from a batch's text column in each task.

    keep_text: whether the text column comes back from Python with the others.

    make returns a function from an Arrow array of texts to the list of the appended Arrow arrays.
    """
    bounded_batches(rows.sparkSession)
    at = rows.columns.index(text)
    names = [part.split()[0] for part in appended.split(", ")]

    def run(batches):
        act = make()
        for batch in batches:
            found = act(batch.column(at))
            batch = batch if keep_text else batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *names])

    fields = ", ".join(f"{quoted(f.name)} {ddl(f.dataType)}" for f in rows.schema if keep_text or f.name != text)
    return rows.mapInArrow(run, f"{fields}, {appended}")
